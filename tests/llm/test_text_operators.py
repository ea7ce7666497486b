"""Operators on documents against brute force, with odd rows in every case."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

pytest.importorskip("tokenizers")

from folioquery.llm import bottomk_dedup, common, disclosure, line_dedup, packing, poisson_mix, suffix_dedup, token_rollup, tokens

from .helpers import ODD, Union, corpus, frame, shingles, sentence


@pytest.fixture(scope="module")
def rows():
    return corpus()


def test_encoder_equals_the_tokenizer_file():
    import public_tokenizers
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    encode = tokens.encoder("byte_bpe_50k.tiktoken", "byte_bpe_50k.json")
    texts = [t or "" for _, t, _ in corpus(3)] + ["It's we'll  x\n\n y\t.", " lead", "trail ", "a\n b", "a \nb", "naïve café 12345 ١٢٣ 漢字 don't!!\n"]
    for text in texts:
        ids = whole.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(encode.packed(text), "<u4").tolist() == ids


def test_encoder_takes_only_single_separators_word_by_word():
    import public_tokenizers
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    encode = tokens.encoder("byte_bpe_50k.tiktoken", "byte_bpe_50k.json")
    for text in ["foo\tbar ", "a b\tc", "a\n\n\nb\tc\td", " a\tb", "a  b\u00a0c", "a\n\nb\rc", "a  b\u3000c", "x\u2028y\n", "a b\x1cc  d", "a\x85b \n", "\t", "a b\nc"]:
        ids = whole.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(encode.packed(text), "<u4").tolist() == ids, text


def test_encoder_equals_the_tokenizer_file_on_random_texts():
    import json
    import random

    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    whole, encode = Tokenizer.from_file(path), tokens.encoder("byte_bpe_50k.tiktoken", "byte_bpe_50k.json")
    with open(path, encoding="utf-8") as file:
        special = [x["content"] for x in json.load(file).get("added_tokens", [])]
    rng = random.Random(11)
    parts = [" ", " ", "\n", "\t", "\r", "\u00a0", "\u3000", "a", "The", "foo", "é", "漢", "9", "12345", "'s", "'LL", ".", "!?", "x" * 40, *special]
    for _ in range(3_000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))
        assert np.frombuffer(encode.packed(text), "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids, text


def test_rollup_query_equals_brute_force(spark, rows, tmp_path):
    import public_tokenizers
    from tokenizers import Tokenizer

    docs = [(i, t, ("en", "fr", None)[i % 3], s) for i, t, s in rows] + [(500, "tab\tand  blanks \n\n here", "fr", "s1"), (501, "w " * 12_000, "de", "s1"), (None, "none", "en", "s1")]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    # The second vocabulary has no tokenizer file: its texts are encoded at once, not word by word.
    size = {"byte_bpe_50k": lambda t: len(whole.encode(t, add_special_tokens=False).ids), "byte_bpe_multi_50k": lambda t: len(tokens.encoder("byte_bpe_multi_50k.tiktoken").whole(t))}
    first = {}
    for i, t, _, _ in docs:
        first[t] = min(first.get(t, i), i) if i is not None and first.get(t, i) is not None else i
    want: dict = defaultdict(lambda: [0, 0, 0])

    def add(group, sign, text):
        for k, n in enumerate((1, size[group[2]](text or ""), len((text or "").encode()))):
            want[group][k] += sign * n

    for i, t, lang, source in docs:
        copy = i is not None and i > first[t]
        add((source, lang, "byte_bpe_50k"), 1, t)
        if copy or lang != "en":
            add((source, lang, "byte_bpe_50k"), -1, t)
        if not copy and lang != "en":
            add((source, lang, "byte_bpe_multi_50k"), 1, t)
    got = {(r["source"], r["lang"], r["tokenizer_version"]): [r["n_docs"], r["n_tokens"], r["n_bytes"]] for r in token_rollup.query(spark, str(tmp_path)).collect()}
    assert got == dict(want)


def test_rollup_counts_signs_and_replays(spark, rows):
    counted = common.cut(token_rollup.count_tokens(frame(spark, rows)), "t")
    rollup = token_rollup.TokenRollup(spark, common.fresh_path(spark, "rollup"))
    assert rollup.totals().count() == 0
    assert rollup.commit("a", token_rollup.changes(counted, "byte_bpe_50k", 1))
    assert not rollup.commit("a", token_rollup.changes(counted, "byte_bpe_50k", 1))
    encode = tokens.encoder("byte_bpe_50k.tiktoken")
    want = Counter()
    for _, text, source in rows:
        want[source] += len(encode.packed(text or "")) // 4
    assert {r["source"]: r["n_tokens"] for r in rollup.totals().collect()} == dict(want)
    rollup.commit("b", token_rollup.changes(counted, "byte_bpe_50k", -1).unionByName(token_rollup.changes(counted, "byte_bpe_multi_50k", 1)))
    totals = rollup.totals().collect()
    assert all(r["n_tokens"] == 0 and r["n_docs"] == 0 for r in totals if r["tokenizer_version"] == "byte_bpe_50k")
    assert sum(r["n_docs"] for r in totals) == len(rows)


def test_rollup_query_runs_on_an_empty_table(spark):
    assert token_rollup.count_tokens(frame(spark, [])).count() == 0


def brute_strings(rows, length=50):
    seen, out = {}, {}
    for doc_id in sorted({r[0] for r in rows}):
        new = set()
        for _, text, _ in [r for r in rows if r[0] == doc_id]:
            raw = (text or "").encode()
            covered = bytearray(len(raw))
            for p in range(len(raw) - length + 1):
                part = raw[p : p + length]
                if part in seen:
                    covered[p : p + length] = b"\1" * length
                new.add(part)
            spans = sum(1 for k in range(len(raw)) if covered[k] and (k == 0 or not covered[k - 1]))
            kept = bytes(c for c, m in zip(raw, covered) if not m)
            out.setdefault(doc_id, []).append((len(raw), sum(covered), spans, hashlib.sha256(kept).hexdigest()))
        seen.update(dict.fromkeys(new))
    return out


@pytest.mark.parametrize(("seed", "base"), [(1, 10**8), (2, 10**8), (3, 2_000)])
def test_repeated_strings_equal_brute_force(spark, seed, base, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "CHUNK_BYTES", 3000)
    monkeypatch.setattr(suffix_dedup, "BASE_BYTES", base)  # units of several chunks
    rows = [*corpus(seed), (7, "again " * 30, "s1"), (7, "again " * 30, "s1"), (900, "ab" * 300, "s1"), (901, "ab" * 310, "s1")]
    got = defaultdict(list)
    for r in suffix_dedup.repeats(frame(spark, rows)).collect():
        got[r["id"]].append((r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in brute_strings(rows).items()}


def test_repeated_strings_are_cut_out(spark, rows):
    out = {r["doc_id"]: r for r in suffix_dedup.dedup(frame(spark, [*rows, (None, "n" * 80, "s")])).collect()}
    want = brute_strings([(common.NULL_ID, "n" * 80, "s"), *rows])
    for doc_id, text, _ in rows:
        if text and text.isascii():
            assert hashlib.sha256(out[doc_id]["text"].encode()).hexdigest() == want[doc_id][0][3]
    assert out[None]["n_removed_bytes"] == 0 and out[0]["kept"] == "k"
    assert suffix_dedup.repeats(frame(spark, [])).count() == 0


def test_lengths_that_cannot_be_told_are_refused(spark):
    for length in (40, 100):
        with pytest.raises(ValueError):
            suffix_dedup.repeats(frame(spark, []), length)


def test_anchors_spread_over_buckets():
    import random

    held = [(1, 0, sentence(random.Random(5), 20_000).encode())]
    head = np.array([[held[0][0]], [0], [len(held[0][2])]], "<i8")
    import zstandard

    chunk = suffix_dedup.Chunk(zstandard.compress(np.array([1], "<i8").tobytes() + head.tobytes() + held[0][2]), 50, 24)
    share = np.bincount(suffix_dedup.bucket_of(chunk.entries()[0], 64), minlength=64) / len(chunk.entries()[0])
    assert share.max() < 3 / 64


def test_mix_follows_the_rates(spark):
    rows = [(i, "t", "hot" if i % 3 else "rare") for i in range(3000)] + [(None, None, None)]
    out = poisson_mix.mix(frame(spark, rows), weights={"hot": 1.0, "rare": 3.0}, total=2000.0).collect()
    share = Counter(r["source"] for r in out)
    assert abs(share["hot"] - 500) < 90 and abs(share["rare"] - 1500) < 150 and None not in share
    keys = [r["shuffle_key"] for r in out]
    assert keys == sorted(keys) and out[0]["kept"] == "k"
    again = poisson_mix.mix(frame(spark, rows), weights={"hot": 1.0, "rare": 3.0}, total=2000.0).collect()
    assert [(r["doc_id"], r["copy_no"]) for r in out] == [(r["doc_id"], r["copy_no"]) for r in again]
    assert poisson_mix.mix(frame(spark, [])).count() == 0
    with pytest.raises(ValueError):
        poisson_mix.mix(frame(spark, rows), total=1e9).count()


@pytest.mark.parametrize("rate", [548.0, 3000.0])
def test_mix_draws_rates_beyond_the_underflow(spark, rate):
    import math

    rows = [(i, "t", "rare" if i < 4 else "hot") for i in range(4000)]
    share = 4 * rate / 4000.0
    weights, total = ({"rare": share, "hot": 1 - share}, None) if share < 1 else ({"rare": 1.0}, 4 * rate)
    out = Counter(r["doc_id"] for r in poisson_mix.mix(frame(spark, rows), total=total, weights=weights).collect() if r["source"] == "rare")
    p = [math.exp(k * math.log(rate) - rate - math.lgamma(k + 1)) for k in range(int(rate + 20 * rate**0.5))]
    cdf = np.cumsum(p)
    want = {i: int((cdf <= int(hashlib.md5(f"mix-1:{i}".encode()).hexdigest()[:13], 16) / 2.0**52).sum()) for i in range(4)}
    assert out == want


def test_packing_round_trip(spark, rows):
    import public_tokenizers
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    docs = [*rows, (500, "long words " * 3000, "s"), (501, "End.  Start\tfoo bar", "s"), (502, "a\n\n\nb\tc\td", "s"), (0, "same id", "s")]
    out = packing.pack(frame(spark, docs)).collect()
    sequences, by_doc = defaultdict(list), defaultdict(list)
    for r in out:
        sequences[r["sequence_id"]].append(r)
        by_doc[r["doc_id"]].append(r)
    for parts in sequences.values():
        at = 0
        for r in sorted(parts, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 2048
    for doc_id, text, _ in docs:
        if doc_id == 0:
            continue
        ids, at = np.array([*whole.encode(text or "", add_special_tokens=False).ids, 0], "<u4").tobytes(), 0
        for r in sorted(by_doc[doc_id], key=lambda r: r["piece"]):
            assert r["start"] == at and r["ids_crc32"] == zlib.crc32(ids[4 * at : 4 * (at + r["length"])])
            assert r["piece"] == 0 or r["length"] == 2048
            at += r["length"]
        assert at == len(ids) // 4
    total = sum(r["length"] for r in out)
    assert len(sequences) <= -(-total // 2048) + 1
    assert packing.pack(frame(spark, [])).count() == 0


def test_best_fit_equals_piece_by_piece():
    import random

    rng = random.Random(5)
    for _ in range(30):
        counts = dict(Counter(rng.randint(1, 50) for _ in range(rng.randint(1, 200))))
        plan = packing.best_fit(dict(counts), 50)
        placed, used = Counter(), Counter()
        for length, first, last, sequence, each, before in plan:
            for rank in range(first, last + 1):
                placed[length, rank] += 1
                used[sequence + (rank - first) // each] += length
        assert placed == Counter({(n, r): 1 for n, c in counts.items() for r in range(c)})
        gaps = []
        for length in sorted(Counter(counts).elements(), reverse=True):
            fit = min((g for g in gaps if g >= length), default=None)
            if fit is None:
                fit = 50
            else:
                gaps.remove(fit)
            gaps.append(fit - length)
        assert max(used.values()) <= 50 and len(used) == len(gaps)


KINDS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(number):
    total = 0
    for i, c in enumerate(reversed(number)):
        d = int(c) * (2 if i % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def brute_spans(text):
    out = []
    for kind, (name, pattern) in enumerate(KINDS.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            good = {"email": True, "ip": name == "ip" and all(int(x) <= 255 for x in m[0].split(".")), "card": 12 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}[name]
            if good:
                out.append((m.start(), kind, m.end(), name))
    return ",".join(f"{n}:{s}:{e}" for s, _, e, n in sorted(out))


def test_personal_data_equals_plain_patterns(spark):
    texts = [*ODD, "a@b.c%x@d.ef 😀 x@y.z.w", "1.2.3.4.5.6.7.8 300.1.1.1 0001.2.3.4", "4111 1111 1111 1111 and 4111-1111-1111-1112", "+1 (743) 555-3824 +12 +1............", "1 " * 4000, "+1-2" * 500, "a" * 3000 + "@b", "x@y.zz " * 400, "9" * 3000, "1.1" * 2000, "call +49 30 1234567, 10.0.0.256, 10.0.0.25"]
    found = disclosure.find(frame(spark, [(i, t, "s") for i, t in enumerate(texts)])).select("doc_id", disclosure.written(disclosure.F.col("spans")).alias("s"))
    got = {r["doc_id"]: r["s"] for r in found.collect()}
    assert got == {i: brute_spans(t or "") for i, t in enumerate(texts)}
    assert disclosure.find(frame(spark, [])).count() == 0


def test_disclosing_words_and_sanitised_text(spark):
    mark = [(i, f"{w} filler words around zanzibar a{i}b@mail.example {w} ending", "s") for i, w in enumerate(["alpha", "bravo", "gamma", "delta"] * 3)]
    mark += [(100 + i, "contact zebrafish office at boss@corp.example today please", "s") for i in range(5)] + [(200 + i, "nothing to see here today please", "s") for i in range(60)]
    spans = {r["doc_id"]: r for r in disclosure.find(frame(spark, mark)).collect()}
    text = dict((i, t) for i, t, _ in mark)
    terms = {text[100][s["start"] : s["end"]] for s in spans[100]["terms"]}
    assert "zebrafish" in terms and "today" not in terms and spans[0]["terms"] is None
    clean = {r["doc_id"]: r["text"] for r in disclosure.sanitise(frame(spark, [*mark, (999, None, "s")])).collect()}
    assert "[email]" in clean[100] and "zebrafish" not in clean[100] and clean[200] == text[200] and clean[999] is None


def test_disclosing_words_anywhere(spark):
    far = "so it goes on and on " * 10
    docs = [(i, f"contact boss@corp.example {far}\n\nask Zebrafish or Bo in the annex", "s") for i in range(5)]
    docs += [(50, f"{far} only the zebrafish is named here", "s"), (51, "x zebrafishes", "s")] + [(200 + i, f"{far} nothing to ask or see in the annex only is named here, contact x", "s") for i in range(60)]
    found = {r["doc_id"]: r["terms"] for r in disclosure.find(frame(spark, docs)).collect()}
    text = {i: t for i, t, _ in docs}
    shown = {i: {text[i][s["start"] : s["end"]] for s in found[i] or []} for i in found}
    assert shown[0] == {"Zebrafish", "Bo"} and shown[50] == {"zebrafish"} and not shown[51] and not shown[200]
    clean = {r["doc_id"]: r["text"] for r in disclosure.sanitise(frame(spark, docs)).collect()}
    assert clean[50] == text[50].replace("zebrafish", "") and "ebrafish" not in clean[0] and clean[51] == text[51]


def brute_lines(rows, least=50):
    """By definition: every run of any number of lines, against all that begin before it."""
    seen, gone = set(), defaultdict(set)
    for doc_id, text, _ in sorted((r for r in rows if r[1] is not None), key=lambda r: r[0]):
        lines = text.split("\n")
        for p in range(len(lines)):
            for n in range(1, len(lines) - p + 1):
                run = "\n".join(lines[p : p + n])
                if len(run) >= least and run in seen:
                    gone[doc_id] |= set(range(p, p + n))
                seen.add(run)
    return {i: t if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone[i]) for i, t, _ in rows}


def planted_lines(seed):
    """Runs of one to eighty lines, of any length of line, repeated between foreign lines."""
    rng = __import__("random").Random(seed)
    runs = [["tiny", "", "lines here", "of few chars", "each", "but many"], [f"w{i:02d} ab" for i in range(20)], ["a" * 20, "b" * 20, "c" * 22], ["x" * 60, "end"], [""] * 70]
    runs += [["q" * rng.choice([0, 1, 3, 9, 24, 49, 50, 51, 70]) + str(i) for i in range(rng.randint(1, 80))] for _ in range(6)]
    rows = []
    for i in range(40):
        lines = [f"foreign {rng.random()}" for _ in range(rng.randint(0, 3))]
        for run in rng.sample(runs, rng.randint(1, 3)):
            first = rng.randrange(len(run))
            lines += run if rng.random() < 0.6 else run[first : first + rng.randint(1, 30)]
            lines += [f"{rng.random()}" for _ in range(rng.randint(0, 2))]
        rows.append((300 + i, "\n".join(lines), "s"))
    return rows


@pytest.mark.parametrize("seed", [1, 4, 7])
def test_line_dedup_equals_brute_force(spark, seed):
    rows = [*corpus(seed), *planted_lines(seed), (1000, "tail\n" * 4000, "long"), (1001, None, "s")]
    out = {r["doc_id"]: r for r in line_dedup.dedup_lines(frame(spark, rows)).collect()}
    want = brute_lines([r for r in rows if r[0] != 1000])
    assert {k: r["text"] for k, r in out.items() if k != 1000} == want
    assert out[0]["kept"] == "k" and len(out[1000]["text"].split("\n")) < 20
    assert line_dedup.dedup_lines(frame(spark, [])).count() == 0


def test_line_dedup_of_odd_rows(spark):
    run = "\n".join(f"w{i:02d} ab" for i in range(20))
    rows = [(None, f"x\n{run}", "s"), (1, f"{run}\ny", "s"), (1, f"{run}\ny", "s"), (2, f"u\n{run}\nv", "s"), (3, "", "s")]
    out = Counter((r["doc_id"], r["text"], r["n_removed_lines"]) for r in line_dedup.dedup_lines(frame(spark, rows)).collect())
    assert out == Counter({(None, f"x\n{run}", 0): 1, (1, "y", 20): 2, (2, "u\nv", 20): 1, (3, "", 0): 1})


def test_line_sql_equals_brute_force(spark):
    import duckdb
    import pandas as pd

    rows = [*corpus(3), *planted_lines(3)]
    documents = pd.DataFrame({"doc_id": [r[0] for r in rows], "text": [r[1] for r in rows]})
    con = duckdb.connect()
    con.register("documents", documents)
    got = {i: h for i, _, _, h in con.sql(f"SELECT doc_id, n_lines, n_removed, kept_md5 FROM ({line_dedup.SQL})").fetchall()}
    assert got == {i: hashlib.md5((t or "").encode()).hexdigest() for i, t in brute_lines(rows).items()}


@pytest.mark.parametrize("seed", [1, 2, 6])
def test_near_duplicates_equal_brute_force(spark, seed, monkeypatch):
    monkeypatch.setattr(bottomk_dedup, "BLOCK", 8)
    rows = corpus(seed, 90)
    rng = __import__("random").Random(seed)
    base = sentence(rng, 120).split(" ")
    for i in range(60):  # a large group of near copies, over several blocks
        words = list(base)
        for _ in range(rng.randint(0, 6)):
            words[rng.randrange(len(words))] = "w"
        rows.append((1000 + i, " ".join(words).upper() if i % 2 else " ".join(words), "hot"))
    half = base[:70] + sentence(rng, 50).split(" ")
    for i in range(24):  # another group of several blocks that shares much with the first, but too little
        words = list(half)
        words[rng.randrange(len(words))] = f"v{i}"
        rows.append((2000 + i, " ".join(words), "s1"))
    sets = {i: shingles(t) for i, t, _ in rows}
    union = Union(sets)
    ids = sorted(sets)
    for x in ids:
        for y in ids:
            if x < y and sets[x] and 100 * len(sets[x] & sets[y]) >= 75 * len(sets[x] | sets[y]):
                union.join(x, y)
    out = {r["doc_id"]: r for r in bottomk_dedup.near_duplicates(frame(spark, rows)).collect()}
    assert {i: (r["n_shingles"], r["component_id"], r["kept"]) for i, r in out.items()} == {i: (len(sets[i]), union.find(i), union.find(i) == i) for i in sets}


def test_near_duplicates_of_odd_tables(spark):
    assert bottomk_dedup.near_duplicates(frame(spark, [])).count() == 0
    out = bottomk_dedup.near_duplicates(frame(spark, [(None, "a b c", "s"), (3, "a b c", "s"), (4, None, "s"), (5, "", "s"), (3, "a b c", "s")])).collect()
    assert Counter((r["doc_id"], r["component_id"], r["kept"]) for r in out) == Counter({(None, None, True): 1, (3, None, False): 2, (4, 4, True): 1, (5, 5, True): 1})
