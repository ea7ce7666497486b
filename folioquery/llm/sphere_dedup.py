"""Near-duplicate vectors by spherical k-means cells and blocked cosine products.

Equal vectors are one point with a weight. Centroids are fitted to a sample of at most `sample` points; every
point has a home cell. A point is a guest of each earlier cell whose border it is close to: a partner x of y in
cell c lies on the other side of the plane between the two centroids, so y's distance to that plane is at most
the chord of the threshold. The distance allowed is `reach` times that chord; 1, the default, is exact, and lower
values miss pairs whose difference points along the line between two centroids. Pairs meet in the earlier home cell of
the two, and only there, so links are counted once.

A cell is split into blocks, its guests apart from those at home, and each pair of blocks (but of guests) is a task that
multiplies two matrices, part by part. It returns how many links each point has and, for the links, a spanning
forest: no group is expanded into pairs.

Defined results: vectors that are null, zero, or hold null or non-finite components link with nothing (they keep
themselves); rows that share a vec_id are one vector if equal, and else link to what either links to; an empty
table gives an empty table; other columns do not matter.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from .components import connected
from .vectors import matrix, rows_of, usable

THRESHOLD = 0.95
#: Share of the border that guests are taken from; less than the whole misses pairs.
REACH = 1.0
SAMPLE, CELL_ROWS, MAX_CELLS, ROUNDS = 20_000, 4_096, 4_096, 6
#: Rows of a block, and of the parts of two blocks that are multiplied at once.
BLOCK, TILE = 4_096, 1_024


def fit_cells(sample: np.ndarray, cells: int, rounds: int = ROUNDS, seed: int = 1) -> np.ndarray:
    """Spherical k-means: unit centroids."""
    rng = np.random.default_rng(seed)
    centroids = sample[rng.choice(len(sample), min(cells, len(sample)), replace=False)]
    for _ in range(rounds):
        home = (sample @ centroids.T).argmax(1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, home, sample)
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        centroids = np.where(norms > 1e-12, sums / np.maximum(norms, 1e-12), centroids)
    return np.unique(centroids, axis=0)


def unit_rows(vectors: DataFrame) -> DataFrame:
    """(vec_id, v): unit vectors in double precision, packed; zero vectors are left out."""

    def run(batches):
        for batch in batches:
            x = rows_of(batch.column(1), np.float64)
            norms = np.linalg.norm(x, axis=1) if len(x) else np.zeros(0)
            some = norms > 0
            unit = x[some] / norms[some][:, None]
            yield pa.RecordBatch.from_arrays([pa.array(batch.column(0).to_numpy()[some], pa.int64()), pa.array([r.tobytes() for r in unit], pa.binary())], names=["vec_id", "v"])

    return usable(vectors).select("vec_id", "embedding").mapInArrow(run, "vec_id long, v binary")


def in_cells(points: DataFrame, centroids: np.ndarray, chord: float, reach: float) -> DataFrame:
    """(cell, guest, id, w, v): every point in its home cell, and as a guest in the earlier cells near it."""

    def run(batches):
        gap = np.linalg.norm(centroids[:, None, :] - centroids[None, :, :], axis=2)
        for batch in batches:
            x = matrix(batch.column(2), np.float64)
            if not len(x):
                continue
            near = x @ centroids.T
            home = near.argmax(1)
            off = near[np.arange(len(x)), home][:, None] - near
            guest = (off <= reach * chord * gap[home]) & (np.arange(len(centroids))[None, :] < home[:, None])
            guest[np.arange(len(x)), home] = True
            row, cell = np.nonzero(guest)
            yield pa.RecordBatch.from_arrays(
                [pa.array(cell, pa.int32()), pa.array(cell != home[row]), *[batch.column(i).take(pa.array(row)) for i in range(3)]],
                names=["cell", "guest", "id", "w", "v"],
            )

    return points.select("id", "w", "v").mapInArrow(run, "cell int, guest boolean, id long, w long, v binary")


def forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The smallest place of its component for each of n places, under the links a[i] - b[i]."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def linked(x: np.ndarray, y: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Places with cosine >= threshold. Single precision decides but near the threshold, where double does."""
    product = x.astype(np.float32) @ y.astype(np.float32).T
    i, j = np.nonzero(product >= threshold - 1e-4)
    close = product[i, j] < threshold + 1e-4
    exact = np.ones(len(i), bool)
    exact[close] = np.einsum("ij,ij->i", x[i[close]], y[j[close]]) >= threshold
    return i[exact], j[exact]


def links(cells: DataFrame, threshold: float) -> DataFrame:
    """(id, n, root) from every pair of blocks: links of the point there, and a link to the smallest point."""
    here, away = F.count_if(~F.col("guest")), F.count_if("guest")
    sizes = cells.groupBy("cell").agg(F.ceil(here / BLOCK).cast("int").alias("h"), F.ceil(away / BLOCK).cast("int").alias("g")).collect()  # at most MAX_CELLS rows

    def blocks(name: str) -> Column:
        return F.element_at(F.create_map(*[F.lit(x) for r in sizes for x in (r["cell"], r[name])]), F.col("cell"))

    # Guests are in blocks of their own, after those at home, and meet only these.
    dealt = cells.withColumns({"h": blocks("h"), "g": blocks("g")}).where("h > 0")
    mine = F.pmod(F.xxhash64("id", F.lit(3)), F.when(F.col("guest"), F.col("g")).otherwise(F.col("h"))).cast("int")
    dealt = dealt.withColumn("mine", F.when(F.col("guest"), F.col("h")).otherwise(0) + mine)
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("h") - 1 + F.when(F.col("guest"), 0).otherwise(F.col("g")))))
    dealt = dealt.select("cell", F.least("mine", "other").alias("bi"), F.greatest("mine", "other").alias("bj"), "mine", "id", "w", "v")

    def run(block: pa.Table) -> pa.Table:
        bi, bj = block.column("bi")[0].as_py(), block.column("bj")[0].as_py()
        mine, ids, w = block.column("mine").to_numpy(), block.column("id").to_numpy(), block.column("w").to_numpy()
        v = matrix(block.column("v"), np.float64)
        order = np.argsort(ids, kind="stable")
        place = np.empty(len(ids), np.int64)
        place[order] = np.arange(len(ids))
        left, right = np.flatnonzero(mine == bi), np.flatnonzero(mine == bj)
        n, ends = np.zeros(len(ids)), [np.zeros((2, 0), np.int64)]
        for p in range(0, len(left), TILE):
            for q in range(p if bi == bj else 0, len(right), TILE):
                i, j = linked(v[left[p : p + TILE]], v[right[q : q + TILE]], threshold)
                i, j = left[p + i], right[q + j]
                keep = (i < j if bi == bj else i >= 0) & (ids[i] != ids[j])
                i, j = i[keep], j[keep]
                if len(i):
                    n += np.bincount(i, w[j], len(ids)) + np.bincount(j, w[i], len(ids))
                    tree = forest(place[i], place[j], len(ids))
                    some = np.flatnonzero(tree != np.arange(len(ids)))
                    ends.append(np.array([some, tree[some]]))
        root = ids[order][forest(*np.concatenate(ends, axis=1), len(ids))][place]
        some = n > 0
        return pa.table({"id": pa.array(ids[some], pa.int64()), "n": pa.array(n[some].astype(np.int64), pa.int64()), "root": pa.array(root[some], pa.int64())})

    return dealt.groupBy("cell", "bi", "bj").applyInArrow(run, "id long, n long, root long")


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, reach: float = REACH, sample: int = SAMPLE) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of `vectors`."""
    units = common.cut(unit_rows(vectors), "sphere-units")
    points = common.cut(units.groupBy("v").agg(F.min("vec_id").alias("id"), F.count("*").alias("w")), "sphere-points")
    n = points.count()
    drawn = points.orderBy(F.xxhash64("id"), "id").select("v").limit(sample).collect()
    found = None
    if drawn:
        rows = np.array([np.frombuffer(r["v"], np.float64) for r in drawn])
        centroids = fit_cells(rows, max(1, min(MAX_CELLS, -(-n // CELL_ROWS))))
        cells = common.cut(in_cells(points, centroids, float(np.sqrt(2 - 2 * threshold)), reach), "sphere-cells")
        found = common.cut(links(cells, threshold), "sphere-links")
    if found is None:
        found = vectors.sparkSession.createDataFrame([], "id long, n long, root long")
    roots = connected(found.select(F.col("id").alias("a"), F.col("root").alias("b")))
    counts = found.groupBy("id").agg(F.sum("n").alias("n"))
    known = points.join(counts, "id", "left").join(roots.withColumnRenamed("node", "id"), "id", "left")
    known = known.select("v", (F.col("w") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("root", "id").alias("component_id"))
    by_row = units.join(known, "v").groupBy("vec_id").agg(F.max("n_links").alias("n_links"), F.min("component_id").alias("component_id")).withColumnRenamed("vec_id", "__id")
    out = vectors.select("vec_id").join(by_row, F.col("vec_id") == F.col("__id"), "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select(F.col("vec_id").cast("long").alias("vec_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.cast("long").alias("component_id"), (F.col("vec_id") == component).alias("kept"))


def query(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(common.table(spark, sf_dir, "embeddings"))
