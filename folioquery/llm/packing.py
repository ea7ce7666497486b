"""Best-fit packing of tokenised documents into sequences of bounded length.

Documents longer than a sequence are cut, the first piece taking the remainder. Lengths and gaps are whole
numbers up to the capacity, so the sorted pieces and the sorted gaps are kept as runs of equal length: a run of
pieces is (length, ranks), a run of open sequences is (gap, sequence numbers). The longest waiting run sweeps to
its successor, the smallest gap that holds it; ranks decide which piece gets which sequence, the gaps are
updated, and so on. This is sequential best fit in decreasing order of length, worked out on the driver from the
number of pieces of each length, at most `capacity` rows; there are no distributed rounds. The plan has some
thousand runs; the pieces themselves only get a rank within their length and look up their run.

Defined results: a null text is an empty one (a single end token); rows that share a doc_id are packed each;
an empty table gives no pieces; only doc_id and text are read.
"""

from __future__ import annotations

import bisect
import zlib
from collections import Counter

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .tokens import encoder

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, place long"
PLAN = "length long, first long, last long, sequence long, each long, used long"
#: The plan is broadcast; its runs are bounded by the capacity, not by the data. More would be a fault.
MAX_RUNS = 200_000


def pieces(docs: DataFrame, capacity: int, end_id: int, ranks: str, vocabulary: str) -> DataFrame:
    """A row for each piece, with its number among the pieces of its length in its partition."""

    def run(batches):
        encode, seen, part = encoder(ranks, vocabulary), Counter(), TaskContext.get().partitionId()
        tail = end_id.to_bytes(4, "little")
        for batch in batches:
            out: list[list] = [[] for _ in range(7)]
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = encode.packed(text or "") + tail
                n, start, piece = len(ids) // 4, 0, 0
                while start < n:
                    length = min((n - start) % capacity or capacity, n - start)
                    row = (doc_id, piece, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]), part, seen[length])
                    for column, value in zip(out, row, strict=True):
                        column.append(value)
                    seen[length] += 1
                    start, piece = start + length, piece + 1
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
            names = [x.split()[0] for x in PIECES.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], names=names)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, PIECES)


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Runs (length, first rank, last rank, first sequence, pieces of the run in each sequence, tokens before them)."""
    gaps: dict[int, list[tuple[int, int]]] = {}  # gap: runs of sequences (first, number)
    sizes: list[int] = []  # the gaps that occur, in order
    plan, opened = [], 0

    def give(gap: int, first: int, number: int) -> None:
        if gap and number:
            if gap not in gaps:
                bisect.insort(sizes, gap)
                gaps[gap] = []
            gaps[gap].append((first, number))

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            at = bisect.bisect_left(sizes, length)
            if at < len(sizes):
                gap = sizes[at]
                first, number = gaps[gap].pop()
                if not gaps[gap]:
                    del gaps[gap], sizes[at]
            else:
                gap, first, number = capacity, opened, -(-left // (capacity // length))
                opened += number
            each = gap // length
            full = min(number, left // each)
            if full:
                plan.append((length, rank, rank + full * each - 1, first, each, capacity - gap))
                give(gap - each * length, first, full)
                rank, left, first, number = rank + full * each, left - full * each, first + full, number - full
            if left and number and left < each:
                plan.append((length, rank, rank + left - 1, first, each, capacity - gap))
                give(gap - left * length, first, 1)
                rank, left, first, number = rank + left, 0, first + 1, number - 1
            give(gap, first, number)
    return plan


def pack(docs: DataFrame, capacity: int = 2048, end_id: int = 0, ranks: str = "byte_bpe_50k.tiktoken", vocabulary: str = "byte_bpe_50k.json") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for every piece of every document."""
    spark: SparkSession = docs.sparkSession
    cutted = common.cut(pieces(docs, capacity, end_id, ranks, vocabulary), "pack-pieces")
    by_part = common.cut(cutted.groupBy("length", "part").agg(F.count("*").alias("n")), "pack-counts")
    counts = {r["length"]: r["n"] for r in by_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    plan = best_fit(counts, capacity)
    assert len(plan) <= MAX_RUNS, f"{len(plan)} runs"
    before = by_part.selectExpr("length AS l", "part AS p", "sum(n) OVER (PARTITION BY length ORDER BY part) - n AS base")
    # These counts grow with the partitions, so they are joined by merging and never broadcast.
    ranked = cutted.join(before.hint("merge"), (F.col("length") == F.col("l")) & (F.col("part") == F.col("p"))).withColumn("rank", F.col("base") + F.col("place"))
    runs = spark.createDataFrame(plan, PLAN).withColumnRenamed("length", "run_length")
    placed = ranked.join(F.broadcast(runs), (F.col("length") == F.col("run_length")) & F.col("rank").between(F.col("first"), F.col("last")))
    nth = F.col("rank") - F.col("first")
    return placed.select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        (F.col("sequence") + F.floor(nth / F.col("each"))).cast("long").alias("sequence_id"),
        (F.col("used") + nth % F.col("each") * F.col("length")).cast("long").alias("offset"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    return pack(common.table(spark, sf_dir, "documents"))
