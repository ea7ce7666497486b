"""The clause grammar, its held-out accuracy, and the pipeline against a brute-force version of its stages."""

import random
import zlib
from collections import Counter

import pytest

import corpus_pipeline
from folioquery.llm import common, toxic_grammar

from .helpers import Union, corpus, frame, sentence, shingles
from .test_text_operators import brute_lines


def events(text, terms=("blort*",)):
    found = toxic_grammar.Scorer(list(terms), toxic_grammar.DEFAULT_WEIGHTS).features(text)
    return {p: round(float(x), 3) for p, x in zip(toxic_grammar.PATTERNS, found[1:]) if x}


def test_clauses_decide():
    assert list(events("You are an idiot.")) == ["aimed_insult"]
    assert list(events("What an idiot thing")) == ["insult"]
    assert list(events("I will kill you!")) == ["aimed_threat"]
    assert list(events("He is not an idiot")) == ["negated"]
    assert list(events("The paper said idiot")) == ["reported"] and list(events('He read "idiot" aloud')) == ["reported"]
    assert list(events("Not today. An idiot")) == ["insult"] and list(events("blorting away")) == ["insult"]
    assert events("") == {} and events("nothing here") == {}


def labelled(spark, n=400):
    rng = random.Random(3)
    rows, labels = [], []
    for i in range(n):
        bad = rng.random() < 0.3
        words = sentence(rng, 40).split(" ")
        if bad:
            for _ in range(3):
                words[rng.randrange(40)] = "zork" + rng.choice(["en", "est", "ing"])
        rows.append((i, " ".join(words), "s"))
        labels.append((i, 1, int(bad)))
    return frame(spark, [*rows, (None, None, "s"), (n, "", "s"), (n + 1, None, "s")]), spark.createDataFrame([*labels, (None, 1, 1), (5, 1, None)], "doc_id long, quality int, toxic int"), dict((i, t) for i, _, t in labels)


def test_held_out_accuracy_and_odd_rows(spark):
    docs, labels, truth = labelled(spark)
    scorer = toxic_grammar.fit(docs, labels)
    out = {r["doc_id"]: r for r in toxic_grammar.score(docs, scorer).collect()}
    held = [i for i in truth if zlib.crc32(str(i).encode()) % 3 == 1]
    assert sum(out[i]["toxic_predicted"] == truth[i] for i in held) >= 0.97 * len(held)
    assert "zork" in scorer.prefixes and out[400]["toxicity"] == out[401]["toxicity"] < 0.7 and out[0]["kept"] == "k"
    none = toxic_grammar.fit(docs, labels.limit(0))
    assert (none.weights == toxic_grammar.DEFAULT_WEIGHTS).all()
    assert toxic_grammar.score(docs.limit(0), none).count() == 0


def test_stages_equal_brute_force(spark, tmp_path):
    rows = corpus(8, 50)
    rng = random.Random(8)
    rows += [(700 + i, f"You idiot zorkest {sentence(rng, 30)} zorken idiot", "s1") for i in range(30)] + [(800 + i, sentence(rng, 30), "s1") for i in range(30)]
    docs = frame(spark, rows)
    labels = spark.createDataFrame([(i, 1, int(700 <= i < 730)) for i, _, _ in rows], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    columns, held = docs.columns, spark.read.parquet(f"{tmp_path}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)

    clean = common.cut(stages["toxicity"](spark, held, str(tmp_path)), "t")
    assert clean.columns == columns
    kept = {r["doc_id"]: r["text"] for r in clean.collect()}
    assert kept == {i: t for i, t, _ in rows if not 700 <= i < 730}

    lined = common.cut(stages["line dedup"](spark, clean, str(tmp_path)), "t")
    want = brute_lines([(i, t, None) for i, t in kept.items()])
    want = {i: t for i, t in want.items() if t == kept[i] or (t or "").strip(" ")}
    assert {r["doc_id"]: r["text"] for r in lined.collect()} == want

    single = common.cut(stages["MinHash near-dedup"](spark, lined, str(tmp_path)), "t")
    sets, union = {i: shingles(t) for i, t in want.items()}, Union(want)
    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                union.join(a, b)
    assert {r["doc_id"] for r in single.collect()} == {i for i in want if union.find(i) == i}

    mixed = common.cut(stages["mixing"](spark, single, str(tmp_path)), "t")
    assert mixed.columns == columns
    packed = stages["best-fit packing"](spark, mixed, str(tmp_path)).collect()
    assert Counter(r["doc_id"] for r in packed if r["piece"] == 0) == Counter(r["doc_id"] for r in mixed.collect())
    assert len(corpus_pipeline.run(spark, str(tmp_path)).collect()) == len(packed)


def test_the_pipeline_runs_on_empty_tables(spark, tmp_path):
    frame(spark, []).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_key_filter_keeps_what_is_wanted(spark):
    rows = spark.range(5000).toDF("id")
    kept = {r["id"] for r in common.possible(rows, rows.where("id % 50 = 0"), "id").collect()}
    assert {i for i in range(0, 5000, 50)} <= kept and len(kept) < 150


@pytest.mark.parametrize("name", ["op2_pivot_topk", "op5_poisson_mix", "op8_line_dedup", "op10_toxic_grammar"])
def test_queries_have_the_columns_of_their_contracts(spark, name):
    from folioquery.llm import registry

    want = {"op2_pivot_topk": {"query_id", "rank", "vec_id", "score"}, "op5_poisson_mix": {"doc_id", "source", "copy_no", "shuffle_key"}, "op8_line_dedup": {"doc_id", "n_lines", "n_removed", "kept_md5"}, "op10_toxic_grammar": {"doc_id", "held_out", "score", "predicted"}}
    assert set(registry.QUERIES[name](spark, "/root/testdata/sf0.001").columns) == want[name]
