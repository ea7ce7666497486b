"""MinHash near-duplicates from bottom-k sketches of one hash function.

A document's sketch is the `k` smallest hashes of its shingles. Documents with equal sets are one class with one
representative. Inverted lists of the retained values say how many representatives hold a value. If two sets are
similar enough, their sketches share at least t values, so they share one among all but the t - 1 most frequent
values of either: only those rare values are kept as lists, and a sketch with fewer than t values that any other
has drops out. (t is exact for sets that fit into their sketches; for larger ones it is half the sketch, which a
pair at the threshold misses about once in a million.) Lists that overlap form clusters, by contraction.

A cluster is dealt to blocks, and documents meet inside their block first; then one document of each component found
so far meets others, round by round, until that joins few. What is left is exact: documents of different components
are compared pair by pair of blocks, as far as a list connects the blocks, and blocks of one component never are.
The union sketch of two documents estimates their similarity; estimates within `z` standard errors of the
threshold or above are verified on the full sets, best first, and pairs that are connected already are left out.
What is returned are the links of a spanning forest, so no group is expanded into all its pairs, and the classes
of the documents are the components of the verified links.

Defined results: a null text is an empty one; texts without words link with nothing; a null doc_id sorts first;
rows that share a doc_id are one document and stay or go together; an empty table gives an empty table; other
columns are carried along (one named like an added column is replaced by it).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from .components import connected
from .shingles import shingle_set, signature

K, PERCENT, Z = 64, 75, 4.5
BLOCK = 256
SKETCH = "id long, h long, n long, sa long, sb long, sketch array<long>"
#: Pairs whose union sketches are held at a time.
PAIRS = 2_048


def sketches(docs: DataFrame, k: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            sets = [shingle_set(t) for t in batch.column(2).to_pylist()]
            marks = [signature(s) for s in sets]
            columns = [pa.array(c, pa.int64()) for c in ([len(s) for s in sets], [m[0] for m in marks], [m[1] for m in marks])]
            smallest = pa.array([s[:k].view(np.int64) for s in sets], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns, smallest], names=["id", "h", "n", "sa", "sb", "sketch"])

    return docs.select(common.id_key().alias("id"), F.xxhash64("text").alias("h"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, SKETCH)


def shared_at_least(n: Column, k: int, percent: int) -> Column:
    """How many sketch values a set of n shingles shares with any set that is similar enough."""
    return F.least(F.ceil(n * percent / 100), F.lit(k // 2)).cast("int")


def rare_lists(reps: DataFrame, k: int, percent: int) -> DataFrame:
    """(id, value): the rare values of each representative that may have a partner."""
    postings = reps.select("id", "n", F.explode("sketch").alias("value"))
    often = common.cut(postings.groupBy("value").agg(F.count("*").alias("df")).where("df > 1"), "bottomk-df")
    held = postings.join(often, "value").groupBy("id", "n").agg(F.array_sort(F.collect_list(F.struct("df", "value"))).alias("held"))
    # Values that only this document has come first in the order of rarity, and have been dropped already.
    first = F.size("held") - shared_at_least(F.col("n"), k, percent) + 1
    return held.where(first > 0).select("id", F.explode(F.slice("held", F.lit(1), first)).alias("x")).select("id", "x.value")


def union_estimates(a: np.ndarray, b: np.ndarray, k: int) -> np.ndarray:
    """Of the similarity of rows of sketches (padded with the largest value), from their union's k smallest."""
    none = np.iinfo(np.uint64).max
    both = np.sort(np.concatenate([a, b], axis=1), axis=1)
    twice = np.zeros(both.shape, bool)
    twice[:, 1:] = (both[:, 1:] == both[:, :-1]) & (both[:, 1:] != none)
    fresh = ~twice & (both != none)
    inside = np.cumsum(fresh, axis=1, dtype=np.int16) <= k
    return (twice & inside).sum(1) / np.maximum(1, (fresh & inside).sum(1))


def find(root: list[int], i: int) -> int:
    while root[i] != i:
        root[i] = root[root[i]]
        i = root[i]
    return i


def compare(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, k: int, percent: int, z: float) -> list[tuple[int, int]]:
    """Verified links between two blocks (or inside one) that span the components of all their links."""
    none = np.iinfo(np.uint64).max
    size = np.array([len(s) for s in sets])
    padded = np.full((len(sets), k), none, np.uint64)
    for i, s in enumerate(sets):
        padded[i, : min(k, len(s))] = s[:k]
    # How many sketch values two documents share, over the values that occur more than once here.
    values, where, often = np.unique(padded, return_inverse=True, return_counts=True)
    where = where.reshape(padded.shape)
    usable = (often > 1) & (values != none)
    column = np.cumsum(usable) - 1
    held = np.zeros((len(sets), max(1, int(usable.sum()))), np.float32)
    row, at = np.nonzero(usable[where])
    held[row, column[where[row, at]]] = 1
    shared = held[left] @ held[right].T
    least = np.minimum(np.ceil(size * percent / 100), k // 2)
    possible = shared >= np.maximum(least[left][:, None], least[right][None, :])
    small, large = np.minimum(size[left][:, None], size[right][None, :]), np.maximum(size[left][:, None], size[right][None, :])
    possible &= 100 * small >= percent * large
    i, j = np.nonzero(possible)
    i, j = left[i], right[j]
    i, j = i[i != j], j[i != j]
    if len(left) == len(right) and (left == right).all():
        i, j = i[i < j], j[i < j]
    bar = percent / 100 - z * np.sqrt(percent / 100 * (1 - percent / 100) / k)
    guess = np.concatenate([union_estimates(padded[i[p : p + PAIRS]], padded[j[p : p + PAIRS]], k) for p in range(0, len(i), PAIRS)] or [np.zeros(0)])
    order = np.argsort(-guess, kind="stable")
    order = order[guess[order] >= bar]
    root, out = list(range(len(sets))), []
    for p in range(0, len(order), 4096):
        # Pairs that are connected before this batch are left out at once, the others one by one.
        known = np.array([find(root, x) for x in range(len(sets))])
        part = order[p : p + 4096]
        for q in part[known[i[part]] != known[j[part]]]:
            a, b = int(i[q]), int(j[q])
            ra, rb = find(root, a), find(root, b)
            if ra == rb:
                continue
            common_values = len(np.intersect1d(sets[a], sets[b], assume_unique=True))
            if 100 * common_values >= percent * (len(sets[a]) + len(sets[b]) - common_values):
                root[max(ra, rb)] = min(ra, rb)
                out.append((a, b))
    return out


def verified(tasks: DataFrame, k: int, percent: int, z: float) -> DataFrame:
    """(a, b) links from rows (g1, g2, g3, cluster, side, id, shingles); side 1 and 2 are the blocks, 0 a whole cluster."""

    def run(group: pa.Table) -> pa.Table:
        cluster, side, ids = (group.column(c).to_numpy() for c in ("cluster", "side", "id"))
        sets = [np.frombuffer(x, np.uint64) for x in group.column("shingles").to_pylist()]
        order = np.argsort(cluster, kind="stable")
        starts = np.flatnonzero(np.diff(cluster[order], prepend=cluster[order][:1] - 1))
        a_out, b_out = [], []
        for rows in np.split(order, starts[1:]):
            mine = [sets[r] for r in rows]
            left = np.flatnonzero(side[rows] != 2)
            right = np.flatnonzero(side[rows] == 2) if (side[rows] == 2).any() else left
            for a, b in compare(mine, left, right, k, percent, z):
                a_out.append(ids[rows[a]])
                b_out.append(ids[rows[b]])
        return pa.table({"a": pa.array(a_out, pa.int64()), "b": pa.array(b_out, pa.int64())})

    return tasks.groupBy("g1", "g2", "g3").applyInArrow(run, "a long, b long")


def contracted(large: DataFrame, links: DataFrame, k: int, percent: int, z: float) -> DataFrame:
    """(a, b) links of large clusters: those given, and those among one document of each component, round by round.

    A round compares blocks of such documents inside, and ends the contraction if it does not halve the components
    of more than one document. What it misses is found between blocks later.
    """
    links = links.join(large.select(F.col("id").alias("a")).distinct(), "a", "left_semi")
    heads = connected(links).select(F.col("root").alias("id")).distinct()
    before = None
    while True:
        heads = common.cut(large.select("id", "root").distinct().join(heads, "id", "left_semi"), "bottomk-heads")
        several = heads.groupBy("root").agg(F.count("*").alias("n")).where("n > 1")
        now = several.agg(F.sum("n")).first()[0] or 0
        if not now or (before is not None and 2 * now > before):
            return links
        before = now
        blocks = several.select("root", F.ceil(F.col("n") / BLOCK).alias("n"))
        at = heads.join(blocks, "root").select("id", "root", F.pmod(F.xxhash64("id", F.lit(7)), F.col("n")).alias("g2"))
        tasks = large.join(at, ["id", "root"]).select(F.col("root").alias("g1"), "g2", F.col("g2").alias("g3"), F.col("root").alias("cluster"), F.lit(0).alias("side"), "id", "shingles")
        found = common.cut(verified(tasks, k, percent, z), "bottomk-links")
        links = links.unionByName(found)
        merged = connected(found).where("node <> root").select(F.col("node").alias("id"))
        heads = heads.select("id").join(merged, "id", "left_anti")


def between(large: DataFrame, lists: DataFrame, links: DataFrame, k: int, percent: int, z: float) -> DataFrame:
    """(a, b) links of large clusters beyond those found inside the first blocks.

    Components of at least a block get blocks of their own, which are never compared with each other; all other
    documents share mixed blocks. So a group of copies that contraction joins costs no pairs of blocks at all.
    """
    known = common.cut(contracted(large, links, k, percent, z), "bottomk-contracted")
    of = connected(known).select(F.col("node").alias("id"), F.col("root").alias("component"))
    nodes = large.select("id", "root").distinct().join(of, "id", "left").withColumn("component", F.coalesce("component", "id"))
    sizes = nodes.groupBy("root", "component").agg(F.count("*").alias("n"))
    nodes = common.cut(nodes.join(sizes, ["root", "component"]).select("id", "root", F.when(F.col("n") >= BLOCK, F.col("component")).alias("pure")), "bottomk-nodes")
    groups = nodes.groupBy("root", "pure").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("n"))
    numbered = groups.select("root", "pure", "n", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("i"))
    numbered = common.cut(numbered.withColumn("block", F.monotonically_increasing_id()), "bottomk-numbers")
    sized = groups.select(F.col("root").alias("r"), F.col("pure").alias("p"), "n")
    nodes = nodes.join(sized, (F.col("root") == F.col("r")) & F.col("pure").eqNullSafe(F.col("p"))).select("id", "root", "pure", F.pmod(F.xxhash64("id", F.lit(5)), F.col("n")).cast("int").alias("i"))
    named = numbered.select(F.col("root").alias("r"), F.col("pure").alias("p"), F.col("i").alias("j"), "block")
    same = (F.col("root") == F.col("r")) & F.col("pure").eqNullSafe(F.col("p")) & (F.col("i") == F.col("j"))
    nodes = common.cut(nodes.join(named, same).select("id", "root", "pure", "block"), "bottomk-dealt")

    held = common.cut(lists.join(nodes, "id").select("root", "value", "pure", "block").distinct(), "bottomk-blocks")
    mixed = held.where("pure IS NULL").select("root", "value", F.col("block").alias("g2"))
    any_block = held.select("root", "value", F.col("block").alias("g3"), F.col("pure").isNotNull().alias("own"))
    pairs = mixed.join(any_block, ["root", "value"]).where("own OR g2 <= g3").select("root", "g2", "g3").distinct()
    owned = held.where("pure IS NOT NULL")
    names = owned.select("root", "value", "pure").distinct()
    two = names.join(names.withColumnRenamed("pure", "pure2"), ["root", "value"]).where("pure < pure2")
    first = owned.select("root", "value", "pure", F.col("block").alias("g2"))
    second = owned.select("root", "value", F.col("pure").alias("pure2"), F.col("block").alias("g3"))
    across = two.join(first, ["root", "value", "pure"]).join(second, ["root", "value", "pure2"]).select("root", "g2", "g3").distinct()
    pairs = common.cut(pairs.unionByName(across), "bottomk-pairs")
    sides = F.expr("CASE WHEN g2 = g3 THEN array(struct(g2 AS block, 0 AS side)) ELSE array(struct(g2 AS block, 1 AS side), struct(g3 AS block, 2 AS side)) END")
    sides = pairs.select("root", "g2", "g3", F.explode(sides).alias("x")).select("root", "g2", "g3", "x.block", "x.side")
    tasks = large.join(nodes.select("id", "root", "block"), ["id", "root"]).join(sides, ["root", "block"])
    tasks = tasks.select(F.col("root").alias("g1"), "g2", "g3", F.col("root").alias("cluster"), "side", "id", "shingles")
    return known.unionByName(verified(tasks, k, percent, z))


def classes(docs: DataFrame, k: int = K, percent: int = PERCENT, z: float = Z) -> DataFrame:
    """(id, h, n_shingles, component) for every row of docs; id is doc_id, and h the hash of the text."""
    base = common.cut(sketches(docs, k), "bottomk-base")
    equal = common.cut(base.where("n > 0").groupBy("n", "sa", "sb").agg(F.min(F.struct("id", "h")).alias("rep")).select("n", "sa", "sb", "rep.id", "rep.h"), "bottomk-classes")
    reps = common.cut(base.drop("n", "sa", "sb").join(equal.select("id", "h", "n"), ["id", "h"]).dropDuplicates(["id", "h"]), "bottomk-reps")
    lists = common.cut(rare_lists(reps, k, percent), "bottomk-lists")
    hubs = common.cut(lists.groupBy("value").agg(F.min("id").alias("hub"), F.count("*").alias("df")).where("df > 1").drop("df"), "bottomk-hubs")
    clusters = connected(lists.join(hubs, "value").select(F.col("id").alias("a"), F.col("hub").alias("b")))
    sizes = clusters.groupBy("root").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    members = clusters.join(sizes, "root").select(F.col("node").alias("id"), "root", "blocks", F.pmod(F.xxhash64("node", F.lit(5)), F.col("blocks")).cast("int").alias("block"))
    members = common.cut(members.join(equal.select("id", "h").distinct(), "id"), "bottomk-members")

    # The full sets of clustered documents are made once; every comparison reads them from the shared folder.
    def full(batches):
        for batch in batches:
            sets = pa.array([shingle_set(t or "").tobytes() for t in batch.column(4).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], sets], names=["id", "root", "blocks", "block", "shingles"])

    texts = docs.select(common.id_key().alias("id"), F.xxhash64("text").alias("h"), "text")
    texts = common.possible(texts, members, "id", "h").join(members, ["id", "h"]).select("id", "root", "blocks", "block", "text")
    sets = common.cut(texts.mapInArrow(full, "id long, root long, blocks int, block int, shingles binary"), "bottomk-sets")

    # Clusters of one block are put together into tasks of about that size; others first meet inside each block.
    one = F.col("blocks") == 1
    bins = max(1, -(-members.where(one).count() // (2 * BLOCK)))
    place = [F.when(one, -1 - F.pmod(F.xxhash64("root"), F.lit(bins))).otherwise(F.col("root")).alias("g1"), F.col("block").cast("long").alias("g2")]
    home = sets.select(*place, F.col("block").cast("long").alias("g3"), F.col("root").alias("cluster"), F.lit(0).alias("side"), "id", "shingles")
    links = common.cut(verified(home, k, percent, z), "bottomk-links")
    large = sets.where(~one).select("id", "root", "shingles")
    if large.take(1):
        links = links.unionByName(between(large, lists, links, k, percent, z))
    roots = connected(links).toDF("rep", "root")
    found = base.join(equal.withColumnRenamed("id", "rep").drop("h"), ["n", "sa", "sb"], "left").join(roots, "rep", "left")
    return found.select("id", "h", F.col("n").alias("n_shingles"), F.coalesce("root", "rep", "id").alias("component"))


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """docs with n_shingles, component_id and kept."""
    docs = common.plain(docs, "n_shingles", "component_id", "kept")
    found = classes(docs, percent=percent).dropDuplicates(["id", "h"]).toDF("__id", "__h", "n_shingles", "__component")
    held = docs.withColumns({"__key": common.id_key(), "__text_h": F.xxhash64("text")})
    out = held.join(found, (F.col("__key") == F.col("__id")) & (F.col("__text_h") == F.col("__h")), "left")
    component = F.when(F.col("__component") != common.NULL_ID, F.col("__component")).alias("component_id")
    return out.select(*docs.columns, "n_shingles", component, (F.col("__component") == F.col("__key")).alias("kept"))


def query(spark, sf_dir: str) -> DataFrame:
    found = classes(common.table(spark, sf_dir, "documents").select("doc_id", "text"))
    named = [F.when(F.col(c) != common.NULL_ID, F.col(c)) for c in ("id", "component")]
    return found.select(named[0].alias("doc_id"), "n_shingles", named[1].alias("component_id"), (F.col("id") == F.col("component")).alias("kept"))
