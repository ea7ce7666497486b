"""Exact repeated strings by bucket-pointer refinement of sampled suffixes.

Suffixes are compared to a depth of `length` bytes. Buckets of q-grams are made by doubling: the bucket of 16
bytes is the pair of the 8-byte buckets at its start and 8 bytes on, that of 24 bytes adds the bucket 16 bytes
on, and so to `length`; each level reuses the identifiers of the one before at later offsets. A suffix array of
every byte would be many times the text, so suffixes are sampled by content: of the q-grams in each string of
`length` bytes, the smallest bucket (the first of equals) is its anchor. Equal strings have equal anchors at
equal places, and neighbouring strings mostly share theirs, so a run of strings stands for one sampled suffix.

1. Anchor buckets are refined by the identifier of the whole run (its first and last string, and where the
   anchor lies). A run that also occurs in a document with a smaller id is decided: all its strings repeat.
2. Only where an anchor's bucket splits, strings of its runs are sorted into buckets one by one, each run by
   the document with the smallest id that has it; others are copies and decided.

The exchange is bulk-synchronous. Documents are packed into chunks, and chunks into units; a unit sends each
identifier once, however often it occurs, and gets back only what was decided, so a string that every document holds is
one entry for each unit. Units and buckets both grow with the square root of the input, so that the rows between
them, one for each pair, grow with the input only. Units are written to the shared folder once and read for each
step; a lost executor repeats tasks.

Identifiers are 64-bit hashes (an anchor with its run is compared by about 100 bits), so equality is up to hash
collisions.

Defined results: a null text is an empty one; texts shorter than `length` keep all; a null doc_id sorts first;
rows that share a doc_id are judged against smaller ids only; an empty table gives an empty table; in `dedup`
other columns are carried along (one named like an added column is replaced by it), and a cut that splits a character drops its other bytes.
"""

from __future__ import annotations

import gc
import hashlib
import time

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .common import mix64

LENGTH, GRAM = 50, 24
#: A chunk is what numpy works on at a time. Up to BASE_BYTES of text a unit is one chunk and there are LEAST_BUCKETS.
CHUNK_BYTES, BASE_BYTES, LEAST_BUCKETS = 500_000, 100_000_000, 64
_ODD = np.uint64(0x9E3779B97F4A7C15)
_ODD2 = np.uint64(0xC2B2AE3D27D4EB4F)
LOW48 = np.uint64(2**48 - 1)


def paired(first: np.ndarray, later: np.ndarray) -> np.ndarray:
    """Bucket identifiers of pairs of buckets."""
    x = (first ^ (later * _ODD)) * _ODD2
    x ^= x >> np.uint64(29)
    x *= _ODD
    return x ^ (x >> np.uint64(32))


class Chunk:
    """Documents end to end, with the runs of strings of `length` bytes that share an anchor."""

    def __init__(self, blob: bytes, length: int, gram: int):
        raw = zstandard.decompress(blob)
        n = int(np.frombuffer(raw, "<i8", 1)[0])
        self.ids, self.hashes, self.sizes = np.frombuffer(raw, "<i8", 3 * n, 8).reshape(3, n)
        self.text = raw[8 + 24 * n :]
        self.ends = np.cumsum(self.sizes)
        self.length = length
        self._sample(np.frombuffer(self.text, np.uint8), gram)

    def _sample(self, text: np.ndarray, gram: int) -> None:
        n, length = len(text), self.length
        if n < length:
            self.strings = np.zeros(0, np.uint64)
            self.first = self.last = self.anchor = self.doc = np.zeros(0, np.int64)
            self.bucket = self.run = np.zeros(0, np.uint64)
            return
        eight = np.ndarray((n - 7,), "<u8", text.tobytes(), strides=(1,))
        sixteen = paired(eight[:-8], eight[8:])
        grams = paired(sixteen[: n - gram + 1], eight[gram - 8 :])
        twice = paired(grams[: n - 2 * gram + 1], grams[gram : n - gram + 1])
        count = n - length + 1
        self.strings = paired(twice[:count], grams[length - gram : length - gram + count])
        del eight, sixteen, twice
        # The first smallest q-gram of each string: windows of doubling size, then two that overlap.
        keys = mix64(grams)
        low, place, size, span = keys, np.arange(len(keys), dtype=np.int32), 1, length - gram + 1
        while 2 * size <= span:
            low, place = self._smaller(low, place, size)
            size *= 2
        if size < span:
            low, place = self._smaller(low, place, span - size)
        place = place[:count]
        # Strings that begin in one document and end in the next are none.
        start = np.concatenate([[0], self.ends[:-1]])
        inside = np.zeros(n + 1, np.int32)
        some = self.sizes >= length
        np.add.at(inside, start[some], 1)
        np.add.at(inside, self.ends[some] - length + 1, -1)
        at = np.flatnonzero(np.cumsum(inside[:count]))
        if not len(at):
            self.first = self.last = self.anchor = self.doc = np.zeros(0, np.int64)
            self.bucket = self.run = np.zeros(0, np.uint64)
            return
        new = np.ones(len(at), bool)
        new[1:] = (place[at[1:]] != place[at[:-1]]) | (at[1:] != at[:-1] + 1)
        heads = np.flatnonzero(new)
        self.first, self.last = at[heads], at[np.append(heads[1:], len(at)) - 1]
        self.anchor = place[self.first].astype(np.int64)
        self.doc = np.searchsorted(self.ends, self.first, side="right")
        # The smallest of many q-grams is mostly small: mixed again, anchors spread evenly over the buckets.
        self.bucket = mix64(keys[self.anchor] ^ _ODD)
        shape = ((self.last - self.first) * 256 + (self.anchor - self.first)).astype(np.uint64)
        self.run = paired(paired(self.strings[self.first], self.strings[self.last]), shape + np.uint64(1)) & LOW48

    @staticmethod
    def _smaller(low, place, step):
        right = low[step:] < low[:-step]
        return np.where(right, low[step:], low[:-step]), np.where(right, place[step:], place[:-step])

    def entries(self):
        """Distinct (bucket, run) in order, the smallest id that has each, and the entry of every run."""
        order = np.lexsort((self.run, self.bucket))
        b, r = self.bucket[order], self.run[order]
        new = np.ones(len(order), bool)
        new[1:] = (b[1:] != b[:-1]) | (r[1:] != r[:-1])
        entry = np.empty(len(order), np.int64)
        entry[order] = np.cumsum(new) - 1
        owner = np.full(int(new.sum()), np.iinfo(np.int64).max)
        np.minimum.at(owner, entry, self.ids[self.doc])
        return b[new], r[new], owner, entry

    def waiting(self, flags: np.ndarray, owner: np.ndarray, entry: np.ndarray):
        """Strings of the owners of split buckets: places, documents' ids, identifiers."""
        runs = np.flatnonzero(flags[entry] & (self.ids[self.doc] == owner[entry]))
        size = self.last[runs] - self.first[runs] + 1
        at = np.repeat(self.first[runs] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        return at, np.repeat(self.ids[self.doc[runs]], size), self.strings[at]


def united(chunks: list[Chunk]):
    """Distinct (bucket, run) of a unit in order, the smallest id that has each, and the entry of every run of each chunk."""
    parts = [c.entries() for c in chunks]
    if len(parts) == 1:
        b, r, owner, entry = parts[0]
        return b, r, owner, [entry]
    b, r, owners = (np.concatenate([p[i] for p in parts]) for i in range(3))
    order = np.lexsort((r, b))
    new = np.ones(len(order), bool)
    new[1:] = (b[order][1:] != b[order][:-1]) | (r[order][1:] != r[order][:-1])
    place = np.empty(len(order), np.int64)
    place[order] = np.cumsum(new) - 1
    owner = np.full(int(new.sum()), np.iinfo(np.int64).max)
    np.minimum.at(owner, place, owners)
    ends = np.cumsum([len(p[0]) for p in parts])
    entries = [place[end - len(p[0]) : end][p[3]] for p, end in zip(parts, ends.tolist(), strict=True)]
    return b[order][new], r[order][new], owner, entries


def grouped_strings(ids: np.ndarray, strings: np.ndarray):
    """Distinct strings in order, the smallest id of each, and the place of every one among them."""
    distinct, place = np.unique(strings, return_inverse=True)
    owner = np.full(len(distinct), np.iinfo(np.int64).max)
    np.minimum.at(owner, place, ids)
    return distinct, owner, place


def in_buckets(keys: np.ndarray, buckets: int):
    """(bucket, first, after) of sorted 64-bit keys, by their leading bits."""
    number = bucket_of(keys, buckets)
    heads = np.flatnonzero(np.diff(number, prepend=-1))
    return zip(number[heads].tolist(), heads.tolist(), [*heads[1:].tolist(), len(keys)], strict=True) if len(keys) else []


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    return ((keys >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def thin(values: np.ndarray, width: int) -> bytes:
    """The low `width` bytes of each number."""
    return values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def wide(data: bytes, width: int) -> np.ndarray:
    out = np.zeros((len(data) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(data, np.uint8).reshape(-1, width)
    return out.view("<u8").ravel()


def packed_ids(ids: np.ndarray) -> tuple[int, int, bytes]:
    """Ids as distances from the smallest, in 4 bytes where they fit."""
    base = int(ids.min())
    far = ids.astype(np.uint64) - np.uint64(base % 2**64)
    width = 4 if int(far.max()) < 2**32 else 8
    return base, width, thin(far, width)


def unpacked_ids(base: int, width: int, data: bytes) -> np.ndarray:
    return (wide(data, width) + np.uint64(base % 2**64)).astype(np.int64)


SENT = "bucket int, chunk long, keys binary, runs binary, base long, width int, ids binary"
TOLD = "chunk long, bucket int, copied binary, split binary"
CHUNKS = "chunk long, blobs array<binary>"


def chunked(docs: DataFrame, per_unit: int) -> DataFrame:
    """Documents packed into units of `per_unit` compressed chunks of about CHUNK_BYTES."""

    def run(batches):
        part, number, held, size, blobs = TaskContext.get().partitionId(), 0, [], 0, []

        def close():
            nonlocal held, size
            head = np.array([[x[0] for x in held], [x[1] for x in held], [len(x[2]) for x in held]], "<i8")
            raw = np.array([len(held)], "<i8").tobytes() + head.tobytes() + b"".join(x[2] for x in held)
            blobs.append(zstandard.compress(raw, 3))
            held, size = [], 0

        def out():
            nonlocal number, blobs
            row = pa.RecordBatch.from_pydict({"chunk": pa.array([(part << 32) + number], pa.int64()), "blobs": pa.array([blobs], pa.list_(pa.binary()))})
            number, blobs = number + 1, []
            return row

        for batch in batches:
            for doc_id, h, text in zip(*[batch.column(i).to_pylist() for i in range(3)], strict=True):
                raw = text.encode("utf-8", "surrogatepass")
                held.append((doc_id, h, raw))
                size += len(raw)
                if size >= CHUNK_BYTES:
                    close()
                    if len(blobs) == per_unit:
                        yield out()
        if held:
            close()
        if blobs:
            yield out()

    return docs.select(common.id_key().alias("id"), F.xxhash64("text").alias("h"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, CHUNKS)


def sent(parts) -> pa.RecordBatch:
    columns = list(zip(*parts, strict=True)) or [[]] * 7
    types = [pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int32(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], names=[x.split()[0] for x in SENT.split(", ")])


def compared(group: pa.Table, by_run: bool) -> pa.Table:
    """What the chunks are told of a bucket: bits for entries that a smaller id has, and of buckets that split."""
    width = 6 if by_run else 8
    sizes = [len(k) // width for k in group.column("keys").to_pylist()]
    keys = wide(b"".join(group.column("keys").to_pylist()), width)
    ids = np.concatenate([unpacked_ids(*x) for x in zip(*[group.column(c).to_pylist() for c in ("base", "width", "ids")], strict=True)])
    runs = wide(b"".join(group.column("runs").to_pylist()), 6) if by_run else np.zeros(len(keys), np.uint64)
    order = np.lexsort((ids, runs, keys))
    k, r, d = keys[order], runs[order], ids[order]
    new_key = np.ones(len(k), bool)
    new_key[1:] = k[1:] != k[:-1]
    new_run = new_key.copy()
    new_run[1:] |= r[1:] != r[:-1]
    run_no, key_no = np.cumsum(new_run) - 1, np.cumsum(new_key) - 1
    owner = d[new_run][run_no]
    copied, split = np.zeros(len(k), bool), np.zeros(len(k), bool)
    copied[order] = d > owner
    # A bucket splits if it has several runs, not all of one document; only owners go on.
    several = np.bincount(key_no[new_run]) > 1
    lowest, highest = np.minimum.reduceat(d, np.flatnonzero(new_key)), np.maximum.reduceat(d, np.flatnonzero(new_key))
    split[order] = ((several & (lowest < highest))[key_no]) & (d == owner)
    rows = {"chunk": [], "bucket": [], "copied": [], "split": []}
    at = 0
    for chunk, bucket, n in zip(group.column("chunk").to_pylist(), group.column("bucket").to_pylist(), sizes, strict=True):
        mine = slice(at, at + n)
        at += n
        if copied[mine].any() or split[mine].any():
            for name, value in zip(rows, (chunk, bucket, np.packbits(copied[mine]).tobytes(), np.packbits(split[mine]).tobytes()), strict=True):
                rows[name].append(value)
    return pa.table({"chunk": pa.array(rows["chunk"], pa.int64()), "bucket": pa.array(rows["bucket"], pa.int32()), "copied": pa.array(rows["copied"], pa.binary()), "split": pa.array(rows["split"], pa.binary())})


def exchanged(rows: DataFrame, buckets: int, by_run: bool) -> DataFrame:
    """TOLD for all buckets. A partition holds a bucket or a few, read as they come: Spark neither sorts nor groups them."""

    def run(batches):
        held: dict[int, list[pa.RecordBatch]] = {}
        for batch in batches:
            for bucket in pc.unique(batch.column(0)).to_pylist():
                held.setdefault(bucket, []).append(batch.filter(pc.equal(batch.column(0), bucket)))
        for bucket in list(held):
            yield from compared(pa.Table.from_batches(held.pop(bucket)), by_run).to_batches()

    return rows.repartition(buckets, "bucket").mapInArrow(run, TOLD)


def flags(told: pa.Table, keys: np.ndarray, buckets: int, column: str) -> np.ndarray:
    """One bit for each of a chunk's sorted entries."""
    out = np.zeros(len(keys), bool)
    spans = {b: (x, y) for b, x, y in in_buckets(keys, buckets)}
    for bucket, bits in zip(told.column("bucket").to_pylist(), told.column(column).to_pylist(), strict=True):
        x, y = spans[bucket]
        out[x:y] = np.unpackbits(np.frombuffer(bits, np.uint8), count=y - x).astype(bool)
    return out


def removed(chunk: Chunk, covered: np.ndarray) -> np.ndarray:
    """Bytes covered by the strings that begin at the marked places."""
    n = len(chunk.text)
    edge = np.zeros(n + 1, np.int32)
    at = np.flatnonzero(covered)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + chunk.length, -1)
    return np.cumsum(edge[:n]) > 0


RESULT = "id long, h long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans binary"


def repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, with_spans: bool = False) -> DataFrame:
    """RESULT for every row of docs; spans: packed pairs (first byte, byte after) of removed runs.

    The identifier of a string is made of three q-grams, so length is from twice to three times `gram`.
    """
    if not (16 <= gram <= 24 and 2 * gram <= length <= 3 * gram):
        raise ValueError(f"strings of {length} bytes cannot be told by three q-grams of {gram} (16 to 24) bytes")
    spark = docs.sparkSession
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    scale = max(1.0, (total / BASE_BYTES) ** 0.5)
    chunks = common.cut(chunked(docs, round(scale)), "suffix-chunks")
    buckets = round(LEAST_BUCKETS * scale)

    def opened(blobs) -> list[Chunk]:
        return [Chunk(blob, length, gram) for blob in blobs]

    def anchors(batches):
        for batch in batches:
            for number, blobs in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                keys, runs, owner, _ = united(opened(blobs.as_py()))
                # The bucket stands for the leading bits, so 48 bits of an anchor and 48 of its run are sent.
                yield sent([(b, number, thin(keys[x:y], 6), thin(runs[x:y], 6), *packed_ids(owner[x:y])) for b, x, y in in_buckets(keys, buckets)])

    first = chunks.mapInArrow(anchors, SENT)
    told = common.cut(exchanged(first, buckets, True), "suffix-runs")
    release(spark)

    def waiting_of(unit: list[Chunk], entries: list[np.ndarray], split: np.ndarray, owner: np.ndarray):
        """Strings of all chunks of a unit: places in their chunk, documents' ids, identifiers; places by chunk."""
        parts = [c.waiting(split, owner, e) for c, e in zip(unit, entries, strict=True)]
        return [p[0] for p in parts], np.concatenate([p[1] for p in parts]), np.concatenate([p[2] for p in parts])

    def strings(held: pa.Table, told: pa.Table) -> pa.Table:
        parts = []
        for number, blobs in zip(held.column("chunk").to_pylist(), held.column("blobs"), strict=True):
            unit = opened(blobs.as_py())
            keys, _, owner, entries = united(unit)
            split = flags(told, keys, buckets, "split")
            if split.any():
                _, ids, found = waiting_of(unit, entries, split, owner)
                distinct, smallest, _ = grouped_strings(ids, found)
                parts += [(b, number, distinct[x:y].tobytes(), b"", *packed_ids(smallest[x:y])) for b, x, y in in_buckets(distinct, buckets)]
        return pa.Table.from_batches([sent(parts)])

    by_chunk = chunks.groupBy("chunk")
    second = by_chunk.cogroup(told.groupBy("chunk")).applyInArrow(strings, SENT)
    single = common.cut(exchanged(second, buckets, False), "suffix-strings")
    release(spark)
    both = told.withColumn("step", F.lit(1)).unionByName(single.withColumn("step", F.lit(2)))

    def settled(held: pa.Table, told: pa.Table) -> pa.Table:
        out: dict[str, list] = {x.split()[0]: [] for x in RESULT.split(", ")}
        step = told.column("step").to_numpy()
        by_step = [told.filter(pa.array(step == s)) for s in (1, 2)]
        for blobs in held.column("blobs"):
            unit = opened(blobs.as_py())
            keys, _, owner, entries = united(unit)
            copied, split = (flags(by_step[0], keys, buckets, c) for c in ("copied", "split"))
            places, again = [np.zeros(0, np.int64)] * len(unit), np.zeros(0, bool)
            if split.any():
                places, ids, found = waiting_of(unit, entries, split, owner)
                distinct, smallest, place = grouped_strings(ids, found)
                again = flags(by_step[1], distinct, buckets, "copied")[place] | (ids > smallest[place])
            for chunk, entry, at, late in zip(unit, entries, places, np.split(again, np.cumsum([len(p) for p in places])[:-1]), strict=True):
                settle(chunk, copied[entry] | (chunk.ids[chunk.doc] > owner[entry]), at[late], out)
        types = [pa.int64()] * 5 + [pa.string(), pa.binary()]
        return pa.table({n: pa.array(v, t) for (n, v), t in zip(out.items(), types, strict=True)})

    def settle(chunk: Chunk, whole: np.ndarray, single: np.ndarray, out: dict[str, list]) -> None:
        """Rows of the documents of a chunk: `whole` runs repeat, and the strings at `single`."""
        covered = np.zeros(len(chunk.text) + 1, np.int32)
        np.add.at(covered, chunk.first[whole], 1)
        np.add.at(covered, chunk.last[whole] + 1, -1)
        covered = np.cumsum(covered) > 0
        covered[single] = True
        gone = removed(chunk, covered)
        for i, (end, size) in enumerate(zip(chunk.ends.tolist(), chunk.sizes.tolist(), strict=True)):
            cut = gone[end - size : end]
            edges = np.flatnonzero(np.diff(cut.astype(np.int8), prepend=0, append=0))
            text = chunk.text[end - size : end]
            kept = np.frombuffer(text, np.uint8)[~cut].tobytes() if len(edges) else text
            row = (int(chunk.ids[i]), int(chunk.hashes[i]), size, int(cut.sum()), len(edges) // 2, hashlib.sha256(kept).hexdigest(), edges.astype("<i8").tobytes() if with_spans else b"")
            for name, value in zip(out, row, strict=True):
                out[name].append(value)

    return by_chunk.cogroup(both.groupBy("chunk")).applyInArrow(settled, RESULT)


def release(spark) -> None:
    """Let Spark delete the shuffle files of steps whose results are written."""
    for _ in range(2):  # the first pass frees what the second finds unused
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.5)


def dedup(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """docs with repeated strings removed from text; n_bytes and n_removed_bytes are added."""
    docs = common.plain(docs, "n_bytes", "n_removed_bytes")
    found = common.cut(repeats(docs, length, with_spans=True), "suffix-spans").dropDuplicates(["id", "h"])
    held = docs.withColumns({"__key": common.id_key(), "__text_h": F.xxhash64("text")})
    found = found.select(F.col("id").alias("__id"), F.col("h").alias("__h"), "n_bytes", F.col("n_removed").alias("n_removed_bytes"), F.col("spans").alias("__spans"))
    joined = held.join(found, (F.col("__key") == F.col("__id")) & (F.col("__text_h") == F.col("__h")), "left")

    def cut_text(texts, spans):
        import pandas as pd

        out = []
        for text, span in zip(texts, spans, strict=True):
            if text is None or not span:
                out.append(text)
                continue
            raw, at = text.encode("utf-8", "surrogatepass"), 0
            kept = []
            for x, y in np.frombuffer(span, "<i8").reshape(-1, 2).tolist():
                kept.append(raw[at:x])
                at = y
            out.append(b"".join([*kept, raw[at:]]).decode("utf-8", "ignore"))
        return pd.Series(out, dtype=object)

    cleaned = F.pandas_udf(cut_text, "string")(F.col("text"), F.col("__spans"))
    return joined.withColumn("__cut", cleaned).select(*[F.col("__cut").alias("text") if c == "text" else F.col(c) for c in docs.columns], "n_bytes", "n_removed_bytes")


def query(spark, sf_dir: str) -> DataFrame:
    found = repeats(common.table(spark, sf_dir, "documents").select("doc_id", "text"))
    doc_id = F.when(F.col("id") != common.NULL_ID, F.col("id")).alias("doc_id")
    return found.select(doc_id, "n_bytes", "n_removed", "n_spans", "kept_sha256")
