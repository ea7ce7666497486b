"""Exact top-k inner products by pivot-table elimination.

Every vector stores its distances to the same pivots. For a query q and a candidate x the largest difference
|d(q, p) - d(x, p)| over the pivots p is a lower bound of d(q, x), so (|q|^2 + |x|^2 - bound^2) / 2 is an upper
bound of their inner product. The bound is used three times:

1. Vectors lie in cells by their two nearest pivots; cells in a row are put together into blocks, and large cells
   are dealt into parts by hash. The ranges of a block's distances and its longest vector bound the products of all
   its pairs with another block. Each block of queries first meets the row blocks of the highest bounds, up to
   `ROW_BLOCK` rows, which gives every query a k-th score; then only pairs of blocks whose bound reaches the least of
   these are shipped at all.
2. A task, a block of queries and a block of candidates, drops the candidates whose bound against the ranges of its
   queries reaches none of their k-th scores, and evaluates the others in the order of their bounds, now for each query
   alone and by `CELL_PIVOTS` pivots (more of them cost more than the products that they spare).
3. It stops when no remaining bound reaches the k-th best score of any of its queries.

The results are merged by a ranking that keeps k rows for each query before it shuffles.

Pivots are chosen farthest-first in a sample of at most `sample` vectors; they only order and eliminate, so the
results are exact whatever they are. Block ranges are at most (cells x pivots) rows, however many vectors there are.

Defined results: vectors that are null, or hold null or non-finite components (also after scaling), take no part, nor
do those of another length than the most frequent one (the longest of these), as they have no inner product with the
others; products are exact for any components, and cut to the range of a long beyond it; rows that share a vec_id
take part each, and none is a candidate of a query with its own vec_id; with fewer candidates than k a query has
fewer rows; an empty table has none; other columns do not matter.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from .vectors import matrix, rows_of, usable

PIVOTS, CELL_PIVOTS = 64, 16
SAMPLE = 2_000
QUERY_BLOCK, ROW_BLOCK, CHUNK = 512, 8_192, 2_048
PREPARED = "vec_id long, is_query boolean, cell int, v binary, d binary, norm double"
FOUND = "query_id long, vec_id long, score long"
LEAST, MOST = -(2**63), 2**63 - 1


def choose_pivots(sample: np.ndarray, number: int) -> np.ndarray:
    """Farthest-first from the vector that is farthest from the mean."""
    if not len(sample):
        return np.zeros((0, 1))
    far = ((sample - sample.mean(0)) ** 2).sum(1)
    chosen: list[int] = []
    for _ in range(min(number, len(sample))):
        chosen.append(int(far.argmax()))
        gone = ((sample - sample[chosen[-1]]) ** 2).sum(1)
        far = np.minimum(far, gone) if len(chosen) > 1 else gone
    return sample[chosen]


def distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.column_stack([np.sqrt(((x - p) ** 2).sum(1)) for p in pivots]) if len(pivots) else np.zeros((len(x), 1))


def cells_of(d: np.ndarray) -> np.ndarray:
    """A number for the nearest and second nearest of the first CELL_PIVOTS pivots."""
    near = np.argsort(d[:, :CELL_PIVOTS], axis=1, kind="stable")
    return (near[:, 0] * CELL_PIVOTS + (near[:, 1] if near.shape[1] > 1 else 0)).astype(np.int32)


def packed(row: np.ndarray) -> bytes:
    """In single precision where that is exact, else in double."""
    return row.astype(np.float32).tobytes() if np.abs(row).max() < 2**24 else row.tobytes()


def unpacked(column: pa.ChunkedArray, dimension: int) -> np.ndarray:
    rows = column.to_pylist()
    if all(len(r) == 4 * dimension for r in rows):
        return np.frombuffer(b"".join(rows), np.float32).reshape(len(rows), dimension)
    return np.array([np.frombuffer(r, np.float32 if len(r) == 4 * dimension else np.float64) for r in rows], np.float64)


def prepared(vectors: DataFrame, is_query: Column, scale: int, pivots: np.ndarray) -> DataFrame:
    """Scaled whole components as floating numbers that hold them exactly, distances to the pivots, cells and lengths."""

    def run(batches):
        for batch in batches:
            with np.errstate(over="ignore"):
                x = np.floor(scale * rows_of(batch.column(1), np.float64))
            finite = np.isfinite(x).all(1)
            x, kept = x[finite], batch.filter(pa.array(finite))
            d = distances(x, pivots)
            with np.errstate(over="ignore"):
                norm = np.sqrt((x**2).sum(1))
            yield pa.RecordBatch.from_arrays(
                [kept.column(0), kept.column(2), pa.array(cells_of(d), pa.int32()), pa.array([packed(r) for r in x], pa.binary()), pa.array([r.tobytes() for r in d.astype(np.float32)], pa.binary()), pa.array(norm, pa.float64())],
                names=[c.split()[0] for c in PREPARED.split(", ")],
            )

    return vectors.select("vec_id", "embedding", is_query.alias("is_query")).mapInArrow(run, PREPARED)


@dataclass
class Block:
    """Neighbouring cells: their rows, and the ranges of distances to the pivots and (last) of lengths."""

    cells: list[int]
    rows: int
    low: np.ndarray
    high: np.ndarray


def ranges(table: DataFrame) -> DataFrame:
    """(cell, asks, p, low, high, n): what a block needs to know of a cell's rows, and of its queries."""

    def run(batches):
        held: dict[tuple[int, bool], list] = {}
        for batch in batches:
            cell, asks = batch.column(0).to_numpy(), batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
            values = np.column_stack([matrix(batch.column(2), np.float32).astype(np.float64), batch.column(3).to_numpy()])
            for asking in (False, True):
                for c in np.unique(cell[asks] if asking else cell).tolist():
                    mine = values[(cell == c) & asks] if asking else values[cell == c]
                    known = held.get((c, asking), [mine[0], mine[0], 0])
                    held[c, asking] = [np.minimum(known[0], mine.min(0)), np.maximum(known[1], mine.max(0)), known[2] + len(mine)]
        rows = [(c, asking, p, float(low[p]), float(high[p]), n) for (c, asking), (low, high, n) in held.items() for p in range(len(low))]
        yield pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(list(zip(*rows, strict=True)) or [[]] * 6, types, strict=True)], names=["cell", "asks", "p", "low", "high", "n"])

    types = [pa.int32(), pa.bool_(), pa.int32(), pa.float64(), pa.float64(), pa.int64()]
    parts = table.select("cell", "is_query", "d", "norm").mapInArrow(run, "cell int, asks boolean, p int, low double, high double, n long")
    return parts.groupBy("cell", "asks", "p").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum("n").alias("n"))


def blocks(rows: list, asks: bool, size: int) -> list[Block]:
    """Cells in order, put together up to `size` rows."""
    by_cell: dict[int, list] = {}
    for r in rows:
        if r["asks"] == asks:
            by_cell.setdefault(r["cell"], []).append((r["p"], r["low"], r["high"], r["n"]))
    out: list[Block] = []
    for cell in sorted(by_cell):
        _, low, high, n = (np.array(c) for c in zip(*sorted(by_cell[cell]), strict=True))
        if out and out[-1].rows + int(n[0]) <= size:
            b = out[-1]
            b.cells, b.rows, b.low, b.high = [*b.cells, cell], b.rows + int(n[0]), np.minimum(b.low, low), np.maximum(b.high, high)
        else:
            out.append(Block([cell], int(n[0]), low, high))
    return out


def block_bounds(asked: list[Block], held: list[Block]) -> tuple[np.ndarray, np.ndarray]:
    """For each pair of blocks: a bound of all their inner products, and how far their middles are apart."""
    q_low, q_high, x_low, x_high = (np.array(v) for v in ([b.low for b in asked], [b.high for b in asked], [b.low for b in held], [b.high for b in held]))
    bound, apart = np.zeros((len(asked), len(held))), np.zeros((len(asked), len(held)))
    for i in range(len(asked)):
        with np.errstate(over="ignore", invalid="ignore"):
            gap = np.maximum(q_low[i, :-1] - x_high[:, :-1], x_low[:, :-1] - q_high[i, :-1]).max(1)
            bound[i] = upper_bound(q_high[i, -1], x_high[:, -1], np.maximum(gap, 0))
            apart[i] = np.abs((q_low[i] + q_high[i]) / 2 - (x_low + x_high) / 2)[:, :-1].max(1)
    return bound, apart


def upper_bound(q_norm, x_norm, least_distance):
    """Of inner products, by lengths and distance; loosened by more than the rounding of single precision, infinite where it overflows."""
    with np.errstate(over="ignore", invalid="ignore"):
        size = q_norm**2 + x_norm**2
        distance = np.maximum(least_distance - 1e-5 * (1 + q_norm + x_norm), 0)
        bound = (size - distance**2) / 2 + 1e-5 * (1 + size)
    return np.where(np.isfinite(bound), bound, np.inf).astype(bound.dtype)


def best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best: high scores first, ties to smaller ids."""
    return np.lexsort((ids, ~scores))[:k]


def products(q: np.ndarray, x: np.ndarray):
    """A function of places that gives exact inner products as 64-bit numbers, in the cheapest type that is exact."""
    most = q.shape[1] * max(1.0, float(np.abs(q).max(initial=0))) * max(1.0, float(np.abs(x).max(initial=0)))
    if most < 2**52:
        kind = np.float32 if most < 2**23 else np.float64
        a, b = q.astype(kind), x.astype(kind)
        return lambda i, j: (a[i] @ b[j].T).astype(np.int64)
    if most < 2**62:
        a, b = q.astype(np.int64), x.astype(np.int64)
        return lambda i, j: a[i] @ b[j].T
    whole = np.frompyfunc(int, 1, 1)
    a, b = whole(q), whole(x)
    return lambda i, j: np.clip(a[i] @ b[j].T, LEAST + 1, MOST).astype(np.int64)


def search_block(q_ids, q, q_d, q_norm, kth, ids, x, x_d, x_norm, k: int):
    """For each query of the block, its k best candidates of the block that reach `kth`; exact."""
    low, high = q_d.min(0), q_d.max(0)
    with np.errstate(invalid="ignore"):
        gap = np.fmax(np.fmax(low - x_d, x_d - high).max(1), 0)
    least = int(kth.min())
    some = np.flatnonzero(upper_bound(q_norm.max(), x_norm, gap) >= least)
    ids, x, x_d, x_norm = ids[some], x[some], x_d[some, :CELL_PIVOTS], x_norm[some]
    score = products(q, x)
    apart = np.zeros((len(q), len(x)), np.float32)
    with np.errstate(invalid="ignore"):
        for p in range(x_d.shape[1]):
            np.fmax(apart, np.abs(q_d[:, p, None] - x_d[None, :, p]), out=apart)
    upper = upper_bound(q_norm.astype(np.float32)[:, None], x_norm.astype(np.float32)[None, :], apart)
    order = np.argsort(-upper.max(0), kind="stable")
    starts = np.arange(0, len(order), CHUNK)
    rest = np.maximum.reduceat(upper[:, order], starts, axis=1) if len(order) else np.zeros((len(q), 0))
    rest = np.maximum.accumulate(rest[:, ::-1], axis=1)[:, ::-1]  # the best bound from each chunk on, by query
    top_ids = [np.zeros(0, np.int64)] * len(q)
    top_scores = [np.zeros(0, np.int64)] * len(q)
    kth = kth.copy()
    for n, at in enumerate(starts.tolist()):
        open_queries = np.flatnonzero(rest[:, n] >= kth)
        if not len(open_queries):
            break
        these = order[at : at + CHUNK]
        scores = score(open_queries, these)
        for row, i in enumerate(open_queries):
            take = np.flatnonzero((scores[row] >= kth[i]) & (ids[these] != q_ids[i]))
            if len(take) > 4 * k:  # ties with the k-th stay
                part = scores[row][take]
                take = take[part >= np.partition(part, len(part) - k)[len(part) - k]]
            if not len(take):
                continue
            all_ids, all_scores = np.concatenate([top_ids[i], ids[these][take]]), np.concatenate([top_scores[i], scores[row][take]])
            keep = best(all_ids, all_scores, k)
            top_ids[i], top_scores[i] = all_ids[keep], all_scores[keep]
            if len(keep) == k:
                kth[i] = all_scores[keep[-1]]
    return top_ids, top_scores


def compared(table: DataFrame, asked: list[Block], held: list[Block], pairs: list[tuple[int, int]], kth: DataFrame | None, k: int, dimension: int) -> DataFrame:
    """FOUND for the pairs of blocks; each row is shipped only to the tasks of its pairs."""
    spark = table.sparkSession

    def dealt(rows: DataFrame, side: list[Block], size: int, salt: int, name: str) -> DataFrame:
        where = spark.createDataFrame([(c, i, -(-b.rows // size)) for i, b in enumerate(side) for c in b.cells], f"cell int, {name} int, {name}_parts int")
        return rows.join(F.broadcast(where), "cell").withColumn(f"{name}_part", F.pmod(F.xxhash64("vec_id", "v", F.lit(salt)), F.col(f"{name}_parts")).cast("int"))

    met = F.broadcast(spark.createDataFrame([(q, x, -(-asked[q].rows // QUERY_BLOCK), -(-held[x].rows // ROW_BLOCK)) for q, x in pairs], "q int, x int, q_all int, x_all int"))
    columns = ["asks", "vec_id", "kth", "v", "d", "norm", "q", "q_part", "x", "x_part"]
    asking = table.where("is_query")
    asking = asking.withColumn("kth", F.lit(LEAST)) if kth is None else asking.join(kth, "vec_id", "left").withColumn("kth", F.coalesce("kth", F.lit(LEAST)))
    queries = dealt(asking, asked, QUERY_BLOCK, 11, "q").join(met, "q").withColumn("x_part", F.explode(F.sequence(F.lit(0), F.col("x_all") - 1))).withColumn("asks", F.lit(True))
    candidates = dealt(table, held, ROW_BLOCK, 7, "x").join(met, "x").withColumn("q_part", F.explode(F.sequence(F.lit(0), F.col("q_all") - 1))).withColumns({"asks": F.lit(False), "kth": F.lit(LEAST)})

    def run(block: pa.Table) -> pa.Table:
        asks = block.column("asks").to_numpy(zero_copy_only=False).astype(bool)
        ids, norm, least = (block.column(c).to_numpy() for c in ("vec_id", "norm", "kth"))
        v, d = unpacked(block.column("v"), dimension), matrix(block.column("d"), np.float32)
        q, x = np.flatnonzero(asks), np.flatnonzero(~asks)
        out: tuple = ([], [], [])
        if len(q) and len(x):
            found, scores = search_block(ids[q], v[q], d[q], norm[q], least[q], ids[x], v[x], d[x], norm[x], k)
            out = (np.repeat(ids[q], [len(f) for f in found]), np.concatenate(found), np.concatenate(scores))
        return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(("query_id", "vec_id", "score"), out, strict=True)})

    return queries.select(*columns).unionByName(candidates.select(*columns)).groupBy("q", "q_part", "x", "x_part").applyInArrow(run, FOUND)


def ranked(hits: DataFrame, k: int) -> DataFrame:
    return hits.selectExpr("*", "row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank").where(F.col("rank") <= k)


def seeds(bound: np.ndarray, apart: np.ndarray, held: list[Block]) -> set[tuple[int, int]]:
    """For each block of queries the row blocks of the highest bounds (the nearest of equals), up to ROW_BLOCK rows."""
    sizes, out = np.array([b.rows for b in held]), set()
    for i in range(len(bound)):
        order = np.lexsort((apart[i], -bound[i]))
        need = int(np.searchsorted(np.cumsum(sizes[order]), min(ROW_BLOCK, int(sizes.sum())))) + 1
        out |= {(i, int(x)) for x in order[:need]}
    return out


def search(vectors: DataFrame, is_query: Column, k: int = 20, scale: int = 64, pivots: int = PIVOTS, sample: int = SAMPLE, report: dict | None = None) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k largest inner products of floor(scale * x) for each query.

    report: gets the numbers of pairs of blocks in all, and of those that were shipped.
    """
    spark = vectors.sparkSession
    rows = usable(vectors)
    drawn = rows.orderBy(F.xxhash64("vec_id"), "vec_id").select("embedding").limit(sample).collect()
    points = np.floor(scale * np.array([r[0] for r in drawn], np.float64)) if drawn else np.zeros((0, 1))
    dimension = points.shape[1]
    points = choose_pivots(points[np.isfinite(points).all(1) & (np.abs(points).max(1, initial=0) < 1e150)], pivots)
    table = common.cut(prepared(rows, is_query, scale, points), "pivot-table")
    known = ranges(table).collect()  # at most CELL_PIVOTS ** 2 * 2 * (PIVOTS + 1) rows
    asked, held = blocks(known, True, QUERY_BLOCK), blocks(known, False, ROW_BLOCK)
    if not asked:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    bound, apart = block_bounds(asked, held)
    first = seeds(bound, apart, held)
    found = common.cut(ranked(compared(table, asked, held, sorted(first), None, k, dimension), k).drop("rank"), "pivot-seeds")
    kth = found.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("kth")).where(F.col("n") == k)
    kth = common.cut(kth.select(F.col("query_id").alias("vec_id"), "kth"), "pivot-kth")
    where = F.broadcast(spark.createDataFrame([(c, i) for i, b in enumerate(asked) for c in b.cells], "cell int, q int"))
    least = table.where("is_query").select("vec_id", "cell").join(where, "cell").join(kth, "vec_id", "left").groupBy("q").agg(F.min(F.coalesce("kth", F.lit(LEAST))).alias("least")).collect()
    least = {r["q"]: r["least"] for r in least}  # one for each block of queries
    rest = [(q, x) for q in range(len(asked)) for x in range(len(held)) if (q, x) not in first and bound[q, x] >= least[q]]
    if report is not None:
        report |= {"block_pairs": bound.size, "shipped": len(first) + len(rest)}
    if rest:
        found = found.unionByName(compared(table, asked, held, rest, kth, k, dimension))
    return ranked(found, k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def query(spark, sf_dir: str) -> DataFrame:
    return search(common.table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)
