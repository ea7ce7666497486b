"""Hybrid retrieval for a batch of queries: exact cosine search, boosts, diversification, expansion.

Chunks carry: chunk_id, document_id, filename, parent_id, section_id, clause_path, defined_term, code,
child_order, continues_from, continues_to, cross_references, text, embedding. Queries carry: query_id, query,
query_vector, and document_id if they are restricted to one document. query_id is a key of every result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from folioquery.config import DEFAULTS, Settings
from folioquery.functions import text as T

#: Up to so many queries are sent to every task; more are dealt in blocks of so many, each with parts of the chunks.
QUERY_BLOCK, ROW_PART = 4_096, 65_536
#: Products are made of so many chunks and queries at a time.
TILE = 1_024
#: Rows that a batch of queries leads to (hits, candidates, results) are kept on the driver up to so many.
SETTLED_ROWS = 20_000
LINKS = ["continues_from", "continues_to"]


def settled(rows: DataFrame, limit: int = SETTLED_ROWS) -> DataFrame:
    """The same rows, computed now and held as a local table if they are at most `limit`; else rows itself.

    Later joins see the size of a local table and send it to the chunks, instead of shuffling these.
    """
    found = rows.limit(limit + 1).collect()
    return rows.sparkSession.createDataFrame(found, rows.schema) if len(found) <= limit else rows


class Best:
    """The k nearest chunks of each query so far: high similarity first, ties to smaller ids."""

    def __init__(self, vectors: np.ndarray, wanted: list[str | None], k: int):
        self.vectors, self.wanted, self.k = vectors, wanted, k
        self.norms = np.linalg.norm(vectors, axis=1)
        self.held: list[list[tuple[float, str]]] = [[] for _ in wanted]
        self.least = np.full(len(wanted), -np.inf)
        self.filtered = any(d is not None for d in wanted)

    def add(self, names: list[str], docs: list[str | None], x: np.ndarray) -> None:
        for p in range(0, len(x), TILE):
            norms = np.linalg.norm(x[p : p + TILE], axis=1)
            for q in range(0, len(self.wanted), TILE):
                size = self.norms[q : q + TILE, None] * norms[None, :]
                # Twelve digits: ties must not depend on the order of summation.
                sims = np.round(np.divide(self.vectors[q : q + TILE] @ x[p : p + TILE].T, size, out=np.zeros_like(size), where=size != 0), 12) + 0.0
                if self.filtered:
                    other = np.array([[d is not None and d != c for c in docs[p : p + TILE]] for d in self.wanted[q : q + TILE]])
                    sims[other] = -np.inf
                hit = (sims >= self.least[q : q + TILE, None]) & (sims > -np.inf)
                for i in np.flatnonzero(hit.any(axis=1)).tolist():
                    at = np.flatnonzero(hit[i])
                    if len(at) > self.k:
                        at = at[sims[i, at] >= np.partition(sims[i, at], len(at) - self.k)[len(at) - self.k]]
                    best = sorted([*self.held[q + i], *((-float(sims[i, j]), names[p + j]) for j in at)])[: self.k]
                    self.held[q + i] = best
                    if len(best) == self.k:
                        self.least[q + i] = -best[-1][0]


def top_by_vector(chunks: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, chunk_id, similarity): the k nearest by cosine distance, ties to smaller chunk ids.

    Each task keeps its own k best for each query, so what is shuffled of the results does not grow with the chunks.
    """
    spark, kind = chunks.sparkSession, queries.schema["query_id"].dataType.simpleString()
    document = F.col("document_id").cast("string") if "document_id" in queries.columns else F.lit(None).cast("string")
    asked = queries.select("query_id", F.col("query_vector").cast("array<double>").alias("v"), document.alias("d"))
    source = chunks.where("embedding IS NOT NULL").select("chunk_id", F.col("document_id").cast("string").alias("document_id"), F.col("embedding").cast("array<double>").alias("x"))
    found = f"query_id {kind}, chunk_id string, similarity double"
    arrow_kind = to_arrow_type(queries.schema["query_id"].dataType)
    first = asked.limit(QUERY_BLOCK + 1).collect()
    if len(first) <= QUERY_BLOCK:
        only = {r["d"] for r in first}
        if None not in only and len(only) <= 1_000:
            source = source.where(F.col("document_id").isin(sorted(only)))

        def scan(batches):
            best = Best(stacked([r["v"] for r in first]), [r["d"] for r in first], k)
            for batch in batches:
                if batch.num_rows and first:
                    best.add(batch.column(0).to_pylist(), batch.column(1).to_pylist(), stacked(batch.column(2)))
            yield from hits_of([r["query_id"] for r in first], best, arrow_kind).to_batches()

        hits = source.mapInArrow(scan, found)
    else:
        blocks, parts = (max(1, -(-df.count() // size)) for df, size in ((asked, QUERY_BLOCK), (source, ROW_PART)))
        each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
        left = asked.select(F.pmod(F.xxhash64("query_id"), F.lit(blocks)).alias("block"), each(parts).alias("part"), "query_id", F.lit(None).cast("string").alias("chunk_id"), "d", F.col("v").alias("x"))
        right = source.select(each(blocks).alias("block"), F.pmod(F.xxhash64("chunk_id"), F.lit(parts)).alias("part"), F.lit(None).cast(kind).alias("query_id"), "chunk_id", F.col("document_id").alias("d"), "x")

        def compared(rows: pa.Table) -> pa.Table:
            mine, theirs = rows.filter(rows["chunk_id"].is_null()), rows.filter(rows["chunk_id"].is_valid())
            best = Best(stacked(mine["x"]), mine["d"].to_pylist(), k)
            if len(mine) and len(theirs):
                best.add(theirs["chunk_id"].to_pylist(), theirs["d"].to_pylist(), stacked(theirs["x"]))
            return hits_of(mine["query_id"].to_pylist(), best, arrow_kind)

        hits = left.withColumn("block", F.col("block").cast("long")).unionByName(right.withColumn("block", F.col("block").cast("long"))).groupBy("block", "part").applyInArrow(compared, found)
    order = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "chunk_id")
    return hits.withColumn("vector_rank", F.row_number().over(order) - 1).where(F.col("vector_rank") < k)


def stacked(vectors) -> np.ndarray:
    """A matrix of vectors of one length, given as lists or as a list column."""
    if isinstance(vectors, list):
        return np.array(vectors, np.float64).reshape(len(vectors), -1)
    flat = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(vectors), -1)


def hits_of(ids: list, best: Best, kind: pa.DataType) -> pa.Table:
    rows = [(ids[i], name, -minus) for i, held in enumerate(best.held) for minus, name in held]
    return pa.table({"query_id": pa.array([r[0] for r in rows], kind), "chunk_id": pa.array([r[1] for r in rows], pa.string()), "similarity": pa.array([r[2] for r in rows], pa.float64())})


def resolve_clauses(chunks: DataFrame, wanted: DataFrame) -> DataFrame:
    """Chunks whose clause path equals a wanted key: (query_id, clause_key[, document_id]) joined on the key."""
    stored = F.col("clause_key") if "clause_key" in chunks.columns else T.clause_key(F.col("clause_path"))
    keyed = chunks.where("clause_path IS NOT NULL").withColumn("clause_key", stored).where("clause_key <> ''")
    if "document_id" not in wanted.columns:
        return wanted.join(keyed, "clause_key")
    scope = wanted.withColumnRenamed("document_id", "wanted_document")
    return scope.join(keyed, "clause_key").where("wanted_document IS NULL OR wanted_document = document_id").drop("wanted_document")


def features(queries: DataFrame) -> DataFrame:
    q = F.col("query")
    return queries.withColumns({"q_clauses": T.clauses(q), "q_amounts": T.amounts(q), "q_codes": T.codes(q), "q_acronyms": T.acronyms(q), "q_list": T.wants_list(q)})


def merge_exact(hits: DataFrame, queries: DataFrame, chunks: DataFrame) -> DataFrame:
    """Vector hits and, after them, chunks that the query names by clause; the latter with similarity 0."""
    scope = ["document_id"] if "document_id" in queries.columns else []
    wanted = features(queries).select("query_id", *scope, F.explode("q_clauses").alias("clause_key"))
    named = resolve_clauses(chunks, wanted).select("query_id", "chunk_id").distinct()
    named = named.join(hits.select("query_id", "chunk_id"), ["query_id", "chunk_id"], "left_anti")
    exact = named.select("query_id", "chunk_id", F.lit(0.0).alias("similarity"), F.lit(-1).alias("vector_rank"))
    return hits.select("query_id", "chunk_id", "similarity", "vector_rank").unionByName(exact)


def boost(candidates: DataFrame, queries: DataFrame) -> DataFrame:
    """score and rank_in_query of candidates that carry their chunk's columns."""
    rows = candidates.join(features(queries).drop("document_id", "query_vector"), "query_id")
    text, query = F.col("text"), F.col("query")
    clause = T.clause_key(F.coalesce("clause_path", F.lit("")))
    by_clause = (clause != "") & F.array_contains("q_clauses", clause)
    by_number = F.arrays_overlap("q_amounts", T.amounts(text)) | F.arrays_overlap("q_codes", T.codes(text))
    by_term = T.contains_term(query, F.coalesce("defined_term", F.lit(""))) | T.contains_term(query, F.coalesce("code", F.lit(""))) | F.arrays_overlap("q_acronyms", T.acronyms(text))

    def add(condition: Column, value: float) -> Column:
        return F.when(F.coalesce(condition, F.lit(False)), value).otherwise(0.0)

    # The boosts, added in this order.
    score = F.col("similarity") + add(by_clause, 1.0) + add(by_number, 0.35) + add(by_term, 0.20)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vector_rank", "chunk_id")
    return rows.withColumn("score", score).withColumn("rank_in_query", F.row_number().over(order))


def diversify(ranked: DataFrame, k: int, per_parent: int, per_section: int) -> DataFrame:
    """The first k that stay within the caps, then the others in rank order; position counts from 1; text is left out.

    The candidates of a query are an array of at most the pool and the named clauses, folded in rank order.
    """
    carried = [c for c in ranked.columns if c not in ("query_id", "text")]
    parent = F.coalesce(T.missing(F.col("parent_id")), F.col("chunk_id"))
    item = F.struct(F.col("rank_in_query").alias("r"), parent.alias("p"), F.coalesce("section_id", F.lit("")).alias("s"), F.struct(*carried).alias("row"))
    items = F.array_sort(F.collect_list(item), lambda x, y: x["r"] - y["r"])
    folded = ranked.groupBy("query_id").agg(items.alias("items"))
    start = F.struct(F.slice("items", 1, 0).alias("taken"), F.slice("items", 1, 0).alias("left"))

    def take(acc: Column, x: Column) -> Column:
        of_parent = F.size(F.filter(acc["taken"], lambda y: y["p"] == x["p"]))
        of_section = F.size(F.filter(acc["taken"], lambda y: y["s"] == x["s"]))
        fits = (F.size(acc["taken"]) < k) & (of_parent < per_parent) & ((x["s"] == "") | (of_section < per_section))
        return F.when(fits, F.struct(F.concat(acc["taken"], F.array(x)).alias("taken"), acc["left"].alias("left"))).otherwise(F.struct(acc["taken"].alias("taken"), F.concat(acc["left"], F.array(x)).alias("left")))

    chosen = folded.select("query_id", F.aggregate("items", start, take, lambda acc: F.slice(F.concat(acc["taken"], acc["left"]), 1, k)).alias("chosen"))
    return chosen.select("query_id", F.posexplode("chosen").alias("at", "x")).select("query_id", (F.col("at") + 1).alias("position"), "x.row.*")


def governing(rows: DataFrame, parents: DataFrame, chars: int = 600) -> DataFrame:
    """Adds the first characters of the parent's text, or an empty string. Other parents are left out first."""
    excerpt = parents.join(rows.select("parent_id").distinct(), "parent_id", "left_semi").select("parent_id", F.substring("text", 1, chars).alias("governing_context"))
    return rows.join(excerpt, "parent_id", "left").withColumn("governing_context", F.coalesce("governing_context", F.lit("")))


def neighbours(rows: DataFrame, chunks: DataFrame) -> DataFrame:
    """(query_id, chunk_id of the row as source_id, neighbour): linked chunks, or one place away under the parent."""
    keys = rows.select("query_id", F.col("chunk_id").alias("source_id"), "parent_id", "child_order", "document_id", *LINKS)
    linked = keys.select("query_id", "source_id", F.explode(F.array_compact(F.array(*LINKS))).alias("neighbour"))
    found = linked.join(chunks.select(F.col("chunk_id").alias("neighbour"), F.col("child_order").alias("n_order")), "neighbour").withColumn("is_link", F.lit(True))
    near = chunks.select("parent_id", F.col("chunk_id").alias("neighbour"), F.col("child_order").alias("n_order"))
    beside = keys.join(near, "parent_id").where((F.abs(F.col("n_order") - F.col("child_order")) <= 1) & (F.col("neighbour") != F.col("source_id")))
    both = found.select("query_id", "source_id", "neighbour", "n_order", "is_link").unionByName(beside.select("query_id", "source_id", "neighbour", "n_order", F.lit(False).alias("is_link")))
    return both.groupBy("query_id", "source_id", "neighbour", "n_order").agg(F.max("is_link").alias("is_link"))


def expand(primary: DataFrame, queries: DataFrame, chunks: DataFrame) -> DataFrame:
    """(query_id, chunk_id, relation, position, phase, inner, score): primaries, continuations, references."""
    intent = queries.select("query_id", T.wants_list(F.col("query")).alias("q_list"))
    near = neighbours(primary, chunks).join(intent, "query_id").where("q_list OR is_link")
    # Non-list queries look at neighbours only where links exist, and keep only those.
    near = near.join(primary.select("query_id", F.col("chunk_id").alias("source_id"), "position", "score"), ["query_id", "source_id"])
    near = near.join(primary.select("query_id", F.col("chunk_id").alias("neighbour")), ["query_id", "neighbour"], "left_anti")
    first = Window.partitionBy("query_id", "neighbour").orderBy("position", "n_order")
    near = near.withColumn("seen", F.row_number().over(first)).where("seen = 1")
    inner = F.struct(F.col("n_order").cast("long").alias("order"), F.col("neighbour").alias("id"))
    near = near.select("query_id", F.col("neighbour").alias("chunk_id"), F.when(F.col("is_link"), "continuation").otherwise("adjacent").alias("relation"), "position", F.lit(1).alias("phase"), inner.alias("inner"), "score")

    refs = primary.select("query_id", "position", "document_id", F.explode("cross_references").alias("ref"))
    refs = refs.select("query_id", "position", "document_id", T.clause_key(F.col("ref")).alias("clause_key")).distinct()
    cited = resolve_clauses(chunks, refs).select("query_id", "chunk_id", "position", "child_order")
    known = primary.select("query_id", "chunk_id").unionByName(near.select("query_id", "chunk_id"))
    cited = cited.join(known, ["query_id", "chunk_id"], "left_anti")
    cited = cited.groupBy("query_id", "chunk_id").agg(F.min("position").alias("position"), F.min("child_order").alias("child_order"))
    inner = F.struct(F.col("child_order").cast("long").alias("order"), F.col("chunk_id").alias("id"))
    cited = cited.select("query_id", "chunk_id", F.lit("cross_reference").alias("relation"), "position", F.lit(2).alias("phase"), inner.alias("inner"), F.lit(0.0).alias("score"))

    inner = F.struct(F.lit(0).cast("long").alias("order"), F.col("chunk_id").alias("id"))
    mine = primary.select("query_id", "chunk_id", F.lit("primary").alias("relation"), "position", F.lit(0).alias("phase"), inner.alias("inner"), "score")
    return mine.unionByName(near).unionByName(cited)


def retrieve(chunks: DataFrame, parents: DataFrame, queries: DataFrame, settings: Settings = DEFAULTS, top_k: int | None = None, vectors: DataFrame | None = None) -> DataFrame:
    """query_id, rank (from 1), chunk_id, relation, score, similarity, governing_context for each query.

    vectors has chunk_id, document_id and embedding where these are not columns of the chunks.
    """
    k = top_k or settings.retrieval_top_k
    asked = settled(queries.drop("query_vector"))
    hits = settled(top_by_vector(chunks if vectors is None else vectors, queries, max(settings.retrieval_candidate_pool, k)))
    light = chunks.drop("embedding")
    keys = light.drop("text")
    candidates = settled(merge_exact(hits, asked, keys)).join(light, "chunk_id")
    ranked = boost(candidates, asked)
    # At most k rows for each query, read by every phase below.
    chosen = diversify(ranked, k, settings.retrieval_max_children_per_parent, settings.retrieval_max_children_per_section)
    primary = settled(chosen)
    order = Window.partitionBy("query_id").orderBy("phase", "position", "inner")
    out = expand(primary, asked, keys).withColumn("rank", F.row_number().over(order))
    extra = governing(primary, parents).select("query_id", "chunk_id", "similarity", "governing_context")
    out = out.join(extra, ["query_id", "chunk_id"], "left")
    return out.select("query_id", "rank", "chunk_id", "relation", "score", F.coalesce("similarity", F.lit(0.0)).alias("similarity"), F.coalesce("governing_context", F.lit("")).alias("governing_context"))
