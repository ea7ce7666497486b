"""Retrieval, answers, the store, ingestion and sources on hand-made rows."""

import json

import pytest
from pyspark.sql import functions as F

from folioquery.config import Settings
from folioquery.functions import text as T
from folioquery.functions.vectors import cosine
from folioquery.operators import answer, chunking, embed, evaluate, layout, pages, search, store
from folioquery.plans import chat
from folioquery.sources import documents
from folioquery.streaming import ingest

CHUNK = "chunk_id string, document_id string, filename string, parent_id string, section_id string, clause_path string, defined_term string, code string, child_order int, continues_from string, continues_to string, cross_references array<string>, text string, embedding array<double>"


def chunk(name, text="", at=(1.0, 0.0), parent="p1", section="", clause="", term=None, code=None, order=0, came=None, goes=None, refs=()):
    return (name, "d1", "manual.pdf", parent, section, clause, term, code, order, came, goes, list(refs), text, list(at))


def retrieve(spark, chunks, query, vector=(1.0, 0.0), **settings):
    rows = spark.createDataFrame(chunks, CHUNK)
    parents = spark.createDataFrame([("p1", "governs " * 200), ("p2", "two")], "parent_id string, text string")
    asked = spark.createDataFrame([(1, query, list(vector))], "query_id int, query string, query_vector array<double>")
    out = search.retrieve(rows, parents, asked, Settings(**{"retrieval_candidate_pool": 8, "retrieval_top_k": 3, **settings}))
    return out.orderBy("rank").collect()


def test_clause_and_amount_beat_a_closer_vector(spark):
    rows = [chunk("other", "about other things", (0.99, 0.14)), chunk("exact", "up to R2 million", (0.4, 0.92), clause="B.4(A)(i)")]
    out = retrieve(spark, rows, "What does B.4(A)(i) say about R2 million?")
    assert [r["chunk_id"] for r in out] == ["exact", "other"] and out[0]["score"] == pytest.approx(0.3987 + 1.35 + 0.2, abs=0.01)
    assert out[0]["governing_context"].startswith("governs") and len(out[0]["governing_context"]) == 600


def test_a_named_clause_outside_the_pool_wins_a_tie(spark):
    rows = [chunk(f"n{i}", "x", (1.0, 0.0)) for i in range(9)] + [chunk("target", "y", (0.0, 1.0), clause="C.1(A)", parent="p2")]
    assert retrieve(spark, rows, "see C.1(A)")[0]["chunk_id"] == "target"


def test_links_and_references_follow_primaries(spark):
    rows = [
        chunk("a", "first", (1.0, 0.0), clause="B.1(A)", goes="b", refs=["D.1(A)"], order=0), chunk("b", "second", (-1.0, 0.1), order=1, came="a"),
        chunk("c", "third", (-1.0, 0.2), order=2), chunk("d", "cited", (-1.0, 0.3), clause="D.1(A)", parent="p2", order=5),
    ]
    assert [(r["chunk_id"], r["relation"]) for r in retrieve(spark, rows, "list all steps", retrieval_top_k=1, retrieval_candidate_pool=1)] == [("a", "primary"), ("b", "continuation"), ("d", "cross_reference")]
    plain = [chunk("a", "first", order=0), chunk("b", "second", (-1.0, 0.1), order=1)]
    assert len(retrieve(spark, plain, "hello", retrieval_top_k=1, retrieval_candidate_pool=1)) == 1
    assert retrieve(spark, plain, "which ones", retrieval_top_k=1, retrieval_candidate_pool=1)[1]["relation"] == "adjacent"


def test_many_queries_are_dealt_in_blocks(spark, monkeypatch):
    import numpy as np

    x = np.random.default_rng(2).normal(size=(90, 6)).round(1)
    rows = spark.createDataFrame([(f"c{i:02d}", f"d{i % 3}", v.tolist() if i % 9 else None) for i, v in enumerate(x)], "chunk_id string, document_id string, embedding array<double>")
    asked = spark.createDataFrame([(i, v.tolist(), f"d{i % 3}" if i % 2 else None) for i, v in enumerate(x[:40])], "query_id int, query_vector array<double>, document_id string")
    whole = sorted(tuple(r) for r in search.top_by_vector(rows, asked, 4).collect())
    for name, size in (("QUERY_BLOCK", 7), ("ROW_PART", 20), ("TILE", 5), ("SETTLED_ROWS", 3)):
        monkeypatch.setattr(search, name, size)
    assert sorted(tuple(r) for r in search.top_by_vector(rows, asked, 4).collect()) == whole and len(whole) == 160
    assert search.settled(rows, 3) is rows and search.settled(rows, 90).collect() == rows.collect()


def test_terms_codes_and_caps(spark):
    rows = [chunk("a", "code 511 01 here", (0.9, 0.4)), chunk("b", "none", (0.95, 0.3)), chunk("c", "none", (0.94, 0.3), term="Affected Person")]
    assert retrieve(spark, rows, "511  01")[0]["chunk_id"] == "a"
    assert retrieve(spark, rows, "an affected  person?")[0]["chunk_id"] == "c"
    many = [chunk(f"k{i}", "x", (1.0, i / 100), parent="p1" if i < 4 else f"q{i}", section="S") for i in range(7)]
    ids = [r["chunk_id"] for r in retrieve(spark, many, "hello", retrieval_top_k=5)]
    assert ids == ["k0", "k1", "k4", "k2", "k3"]


def test_terms_are_whole_words(spark):
    rows = spark.createDataFrame([("the FX rate (A+B) now", "a+b", True), ("taxation", "tax", False), ("x", "", False), ("x", None, False)], "t string, term string, want boolean")
    assert all(r["got"] == r["want"] for r in rows.select("want", T.contains_term(F.col("t"), F.col("term")).alias("got")).collect())


def test_cleaning(spark):
    cases = {"  (a)  one\n\n\nnext": "  (a) one\n\nnext", "inter-\nnational": "international", "ﬁne\r\nx​y": "fine\nxy", "   ": "", "\n  keep  two\t \n": "  keep two"}
    rows = spark.createDataFrame([(k, v) for k, v in cases.items()], "raw string, want string")
    for r in rows.select("want", T.clean_text(F.col("raw")).alias("got")).collect():
        assert r["got"] == r["want"]


def test_cosine(spark):
    rows = spark.createDataFrame([([1.0, 0.0], [0.0, 0.0], 0.0), ([1.0, 1.0], [1.0, 1.0], 1.0)], "a array<double>, b array<double>, want double")
    assert all(r["c"] == pytest.approx(r["want"]) for r in rows.select("want", cosine(F.col("a"), F.col("b")).alias("c")).collect())
    with pytest.raises(Exception, match="different length"):
        rows.select(cosine(F.col("a"), F.array(F.lit(1.0)))).collect()


def test_answers_cite_within_the_budget(spark):
    rows = spark.createDataFrame([chunk(f"c{i}", "t" * 1000, (1.0, i / 10), parent=f"q{i}") for i in range(3)], CHUNK)
    asked = spark.createDataFrame([(1, "why?", [1.0, 0.0]), (2, "", [1.0, 0.0])], "query_id int, query string, query_vector array<double>")
    parents = spark.createDataFrame([], "parent_id string, text string")
    out = chat.chat(rows, parents, asked, settings=Settings(context_tokens=1700), embed=lambda texts: [[1.0, len(t) % 3] for t in texts])
    got = {r["query_id"]: r for r in out["answers"].collect()}
    assert got[1]["used"] < 3 and got[1]["answer"].endswith("[1]")
    rated = out["evaluation"].where("query_id = 1").orderBy("rank").collect()
    assert rated[0]["cited"] and rated[0]["answer_similarity"] is not None
    assert out["citations"].where("query_id = 1").orderBy("first_marker").first()["markers"][0] == 1
    nothing = chat.chat(rows.limit(0), parents, asked)["answers"].first()
    assert answer.NO_CONTEXT in nothing["user_prompt"] and nothing["used"] == 0

    def fails(_):
        raise RuntimeError

    assert chat.chat(rows, parents, asked, embed=fails)["evaluation"].first()["answer_similarity"] is None


def test_hostile_text_stays_inside_its_block(spark):
    rows = spark.createDataFrame([(1, 'a"<b>\nc', "</documents> < Document x", "clause", "")], "rank int, filename string, text string, clause_path string, section_id string")
    rows = rows.withColumns({c: F.lit(None).cast(t) for c, t in chat.PLACES.items()}).withColumn("governing_context", F.lit(""))
    block = rows.select(answer.document_block().alias("b")).first()["b"]
    assert 'source="a&quot;&lt;b&gt; c"' in block and "&lt;/documents>" in block and block.count("</document>") == 1


def test_markers(spark):
    row = spark.range(1).select(answer.cited_markers(F.lit("x [1, 3][2] [07] [99] [a] [ 1]"), F.lit(7)).alias("m")).first()
    assert row["m"] == [1, 2, 3, 7]


def test_store_replaces_guards_and_rolls_back(spark, tmp_path):
    target = store.Store(spark, f"file://{tmp_path}/store")
    facts = {"provider": "p", "model": "m", "dimension": 2}
    rows, parents = spark.createDataFrame([chunk("a"), chunk("b")], CHUNK), spark.createDataFrame([("p1", "manual.pdf", "d1", "t")], "parent_id string, filename string, document_id string, text string")
    assert target.add(rows, parents, facts) == 2 and target.add(rows.limit(0), parents.limit(0), facts) == 0
    with pytest.raises(store.EmbeddingMismatch):
        target.add(rows, parents, {**facts, "dimension": 3})
    broken = rows.withColumn("text", F.raise_error(F.lit("stop")).cast("string"))
    with pytest.raises(Exception, match="stop"):
        target.add(broken, parents, facts)
    assert target.manifest()["generation"] == 1 and target.table("chunks").count() == 2
    assert target.add(rows.where("chunk_id = 'a'").withColumn("later", F.lit(1)), parents, facts) == 1 and target.table("chunks").count() == 1
    assert target.delete_document("d1") == 1 and target.table("parents").count() == 0
    assert set(store.migrated(rows, {"page": "int", "text": "string"}).columns) == {*rows.columns, "page"}


def test_files_stream_into_the_store(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "one.txt").write_text("First text. " * 150)
    (folder / "two.txt").write_text("Second text.")
    target = store.Store(spark, f"file://{tmp_path}/store")
    for _ in range(2):
        ingest.ingest_stream(spark, target, f"file://{folder}", f"file://{tmp_path}/state").awaitTermination()
    assert {r["filename"]: r["status"] for r in target.table("documents").collect()} == {"one.txt": "completed", "two.txt": "completed"}
    chunks = target.table("chunks")
    assert chunks.where("filename = 'one.txt'").count() == 2 and chunks.where("size(embedding) <> 64").count() == 0
    (folder / "bad.txt").write_bytes(b"\xff\xfe\xfa")
    (folder / "good.txt").write_text("A good text beside a bad one.")
    (folder / "blank.txt").write_text("  \n ")
    (folder / "scan.pdf").write_bytes(b"%PDF")
    ingest.ingest_files(spark, target, f"file://{folder}")
    rows = {r["filename"]: r for r in target.table("documents").collect()}
    assert {n: r["status"] for n, r in rows.items()} == {"one.txt": "completed", "two.txt": "completed", "good.txt": "completed", "bad.txt": "failed", "blank.txt": "failed", "scan.pdf": "failed"}
    assert "UTF-8" in rows["bad.txt"]["error"] and rows["blank.txt"]["error"] == ingest.NO_CHUNKS and "no reader" in rows["scan.pdf"]["error"] and rows["good.txt"]["extraction_method"] == "utf-8"
    assert target.table("chunks").where("filename = 'good.txt'").count() == 1
    assert documents.fingerprints(spark, f"file://{folder}").count() == 6


def test_a_failed_upload_leaves_what_was_there(spark, tmp_path):
    (tmp_path / "a.txt").write_text("Before.")
    target = store.Store(spark, f"file://{tmp_path}/store")
    ingest.ingest_files(spark, target, f"file://{tmp_path}/a.txt")
    (tmp_path / "a.txt").write_text("After.")

    class Failing(embed.HashingProvider):
        def embed(self, texts):
            raise RuntimeError("embed failed")

    with pytest.raises(Exception, match="embed failed"):
        ingest.ingest_files(spark, target, f"file://{tmp_path}/a.txt", make=Failing)
    assert sorted((r["status"], r["error"] is None) for r in target.table("documents").collect()) == [("completed", True), ("failed", False)]
    assert target.table("chunks").first()["source_text"] == "Before."
    ingest.ingest_files(spark, target, f"file://{tmp_path}/a.txt")
    assert [r["status"] for r in target.table("documents").collect()] == ["completed"] and [r["source_text"] for r in target.table("chunks").collect()] == ["After."]
    before = target.manifest()["generation"]
    assert target.compact() == before + 1 and target.table("chunks").count() == 1 and target.table("documents").count() == 1


def test_a_manual_is_read_page_by_page(spark, tmp_path):
    def page(number, *body, table=()):
        blocks = [{"block_type": "prose", "text": "B.4  Currency and Exchanges Manual for Authorised Dealers", "bbox": [40, 44, 300, 55]}, {"block_type": "prose", "text": f"{number} of 298 6/2026", "bbox": [40, 790, 300, 802]}]
        blocks += [{"block_type": "prose", "text": t, "bbox": [40, 100 + 50 * i, 550, 140 + 50 * i]} for i, t in enumerate(body)]
        return {"pdf_page": number, "width": 595, "height": 842, "blocks": blocks + [{"block_type": "table", "bbox": [40, 500, 550, 600], "table_header": ["Code", "Text"], "table_rows": [["1", "a  \u200b b"]]} for _ in table]}

    manual = [
        page(1, "Version number  Issue date\n1.10 issued 2026-05-17\n1.2 issued 2026-04-01"), page(2, "Table of contents\nB.4 Rules .......... 98"),
        page(98, "B.4  Rules\n(A)  Part\n    (i) first rule that holds", "    (ii) second rule, see I.3(B)", table=[1]), page(99, "    (iii) third rule"),
    ]
    (tmp_path / "manual.pdf").write_text(json.dumps(manual))
    target = store.Store(spark, f"file://{tmp_path}/store")
    assert ingest.ingest_files(spark, target, f"file://{tmp_path}/manual.pdf", lambda content: json.loads(content)) >= 3
    row = target.table("documents").first()
    assert (row["status"], row["title"], row["version"], row["extraction_method"]) == ("completed", pages.TITLE, "1.10 (2026-05-17)", "layout")
    chunks = target.table("chunks").collect()
    third = next(r for r in chunks if r["clause_path"] == "B.4(A)(iii)")
    assert (third["printed_page_start"], third["page_revisions"]) == ("99", ["6/2026"]) and not any("of 298" in r["source_text"] for r in chunks)
    assert any(r["content_type"] == "table" and "a b" in r["source_text"] for r in chunks)
    assert {r["record_type"] for r in target.table("parents").collect()} >= {"parent", "front_matter", "navigation"}


def test_page_geometry_from_json(spark, tmp_path):
    def page(number, words):
        return {"pdf_page": number, "width": 595, "height": 842, "blocks": [
            {"block_type": "prose", "text": "Running title", "bbox": [40, 44, 300, 55]}, {"block_type": "prose", "text": words, "bbox": [40, 100, 550, 300]},
            {"block_type": "table", "bbox": [40, 310, 550, 400], "table_header": ["Code", "Text"], "table_rows": [["1", "a | b"]]},
            {"block_type": "prose", "text": f"{number} of 298 6/2026", "bbox": [40, 790, 300, 802]}]}

    (tmp_path / "m.json").write_text(json.dumps([page(98, "one"), page(99, "two")]))
    found = documents.blocks(documents.json_pages(spark, f"file://{tmp_path}/m.json"))
    kept = pages.without_furniture(found, "filename").orderBy("pdf_page", "block_order").collect()
    assert [(r["pdf_page"], r["block_order"], r["printed_page"], r["page_revision"]) for r in kept] == [(98, 0, "98", "6/2026"), (98, 1, "98", "6/2026"), (99, 0, "99", "6/2026"), (99, 1, "99", "6/2026")]
    assert "a \\| b" in kept[1]["raw_text"]
    with pytest.raises(ValueError):
        documents.json_pages(spark, f"file://{tmp_path}/m.json", [100])


def test_words_become_blocks():
    words = [{"text": t, "x0": x, "x1": x + 20, "top": y, "bottom": y + 10} for t, x, y in (("b", 70, 101), ("a", 36, 100), ("next", 52, 112), ("far", 36, 150))]
    assert [t for t, _ in layout.prose_blocks(words)] == ["a    b\n    next", "far"]
    assert layout.inside(words[0], [[75, 100, 85, 110]]) and not layout.inside(words[0], [[0, 0, 10, 10]])


def test_page_types():
    contents = "Table of contents\nA.1 Rules .......... 5\nB.2 More ........ 7"
    assert layout.content_types([(1, "Version number  Issue date"), (2, contents), (20, "B.1 text"), (21, "Index"), (22, "(A) Rules\n(a) must")]) == ["front_matter", "navigation", "body", "navigation", "body"]


def test_navigation(spark):
    rows = [(0, "A.1 Definitions ........ 5"), (1, "(A) Scope ..... 6"), (2, "(i) Who"), (3, "B.  Banks .... 9"), (4, "(ii) Which ... 10")]
    lines = spark.createDataFrame([("d", i, 3, None, t) for i, t in rows], 'document string, order int, pdf_page int, section_marker string, line string')
    got = [(r["section_id"], r["clause_path"], r["title"], r["printed_page"]) for r in pages.navigation(lines, "document").orderBy("order").collect()]
    assert got == [("A.1", None, "Definitions", "5"), ("A.1", "A.1(A)", "Scope", "6"), ("A.1", "A.1(A)(i)", "Who", None), ("B.", None, "Banks", "9"), ("B.", "B.(ii)", "Which", "10")]


def test_small_sources():
    assert documents.concatenated_json('x {"a": 1} y {"b": {"c": 2}}') == [{"a": 1}, {"b": {"c": 2}}]
    with pytest.raises(ValueError, match="no JSON at 2"):
        documents.concatenated_json("x {bad")
    assert documents.valid_file_type("a.PDF") and not documents.valid_file_type(".pdf") and not documents.valid_file_type("a.doc")


def test_providers_and_retries():
    assert embed.provider("Hashing", dimension=8).embed(["a b", ""])[1] == [0.0] * 8
    with pytest.raises(ValueError):
        embed.provider("none")
    waits, calls = [], []

    def call(texts):
        calls.append(1)
        if len(calls) < 3:
            raise ConnectionError
        return [[1.0]]

    assert embed.RemoteProvider("r", "m", 1, call, sleep=waits.append).embed(["x"]) == [[1.0]] and waits == [2.0, 4.0]
    with pytest.raises(documents.ModelError):
        embed.retried(lambda: 1 / 0, lambda e: 50.0, sleep=waits.append)
    assert waits[2:] == [30.0, 30.0]


@pytest.mark.parametrize("wrong", [{"chunk_overlap": 1000}, {"legal_chunk_target_chars": 1500}, {"legal_forced_overlap_chars": 900}, {"legal_parent_max_chars": 1000}, {"retrieval_candidate_pool": 3}, {"llm_provider": "cloud"}])
def test_settings_refuse(wrong):
    with pytest.raises(ValueError):
        Settings(**wrong)


def test_overrides_and_types(spark):
    rows = spark.createDataFrame([(0, "Summarise this", "x"), (1, "what is it", "y")], "index int, question string, type string")
    given = spark.createDataFrame([(0, None, "IS", "first"), (1, None, "IS IT", "longer"), (2, 0, None, "by index")], "position int, index int, part string, type string")
    assert [r["type"] for r in evaluate.with_overrides(rows, given).orderBy("index").collect()] == ["by index", "first"]
    assert [r["type"] for r in evaluate.with_overrides(rows, given.limit(0)).orderBy("index").collect()] == ["x", "y"]


def test_duplicate_ids_are_reported(spark):
    texts = spark.createDataFrame([("d1", "a.txt", "same"), ("d2", "b.txt", "same")], "document_id string, filename string, text string")
    records = chunking.chunk_documents(chunking.blocks_of_texts(texts))
    assert records.count() == 4 and chunking.duplicate_ids(records).count() == 0
    assert chunking.duplicate_ids(records.unionByName(records)).count() == 4
