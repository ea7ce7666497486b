"""Registered queries of the vector scan, lookups and hybrid retrieval."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioquery.functions import text as T
from folioquery.functions.vectors import cosine, dot, norm
from folioquery.operators import search
from folioquery.plans import corpus

KEPT = ["query_id", "rank", "chunk_id", "relation", "score", "similarity"]


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


def vector_topk(spark, d):
    """One query: a scan that keeps ten rows for each task."""
    chunks = corpus.table(spark, d, "embeddings")
    one = chunks.where("vec_id = 0").select(F.col("embedding").alias("q"))
    scored = chunks.crossJoin(F.broadcast(one.limit(1))).select("vec_id", F.round(cosine(F.col("embedding"), F.col("q")), 6).alias("similarity"))
    return scored.orderBy(F.desc("similarity"), "vec_id").limit(10)


def vector_topk_batch(spark, d):
    hits = search.top_by_vector(corpus.chunks(spark, d), corpus.questions(spark, d), 10)
    return rounded(hits.select("query_id", F.col("vector_rank").cast("long").alias("vector_rank"), "chunk_id", "similarity"), "similarity")


def vector_topk_filtered(spark, d):
    """Each question looks into one document only."""
    asked = corpus.questions(spark, d).withColumn("document_id", F.concat(F.lit("d"), F.col("query_id") % 4))
    hits = search.top_by_vector(corpus.chunks(spark, d), asked, 5)
    return rounded(hits.select("query_id", F.col("vector_rank").cast("long").alias("vector_rank"), "chunk_id", "similarity"), "similarity")


def inner_product_index(spark, d):
    """The two vectors of largest inner product after normalising, for every question."""
    chunks = corpus.chunks(spark, d).select("chunk_id", "document_id", "embedding")
    hits = search.top_by_vector(chunks, corpus.questions(spark, d), 2)
    return rounded(hits.select("query_id", "chunk_id", F.col("similarity").alias("inner_product")), "inner_product")


def vector_norms(spark, d):
    rows = corpus.table(spark, d, "embeddings")
    return rows.select("vec_id", F.round(norm(F.col("embedding")), 6).alias("norm"), F.round(dot(F.col("embedding"), F.col("embedding")), 6).alias("square"))


def clause_resolve(spark, d):
    wanted = corpus.questions(spark, d).select("query_id", F.explode(T.clauses(F.col("query"))).alias("clause_key"))
    return search.resolve_clauses(corpus.texts(spark, d), wanted).select("query_id", "clause_key", "chunk_id", "child_order")


def adjacent_children(spark, d):
    chunks = corpus.texts(spark, d)
    found = search.neighbours(chunks.withColumn("query_id", F.lit(0)), chunks)
    return found.select("source_id", "neighbour", "is_link")


def parent_excerpt(spark, d):
    chunks = corpus.texts(spark, d).select("chunk_id", "parent_id")
    return search.governing(chunks, corpus.parents(spark, d)).select("chunk_id", "parent_id", "governing_context")


def query_features(spark, d):
    rows = search.features(corpus.questions(spark, d))
    return rows.select("query_id", *[F.array_join(F.array_sort(c), "|").alias(c) for c in ("q_clauses", "q_amounts", "q_codes", "q_acronyms")], "q_list")


def text_features(spark, d):
    """Amounts, codes and acronyms of every chunk."""
    t = F.col("text")
    rows = corpus.texts(spark, d)
    return rows.select("chunk_id", *[F.array_join(F.array_sort(x), "|").alias(n) for n, x in (("amounts", T.amounts(t)), ("codes", T.codes(t)), ("acronyms", T.acronyms(t)))])


def ranked(spark, d):
    chunks, asked = corpus.chunks(spark, d), corpus.questions(spark, d)
    light = corpus.texts(spark, d)
    hits = search.top_by_vector(chunks, asked, 10)
    return search.boost(search.merge_exact(hits, asked, light).join(light, "chunk_id"), asked)


def exact_merge(spark, d):
    chunks, asked = corpus.chunks(spark, d), corpus.questions(spark, d)
    merged = search.merge_exact(search.top_by_vector(chunks, asked, 10), asked, corpus.texts(spark, d))
    return rounded(merged.select("query_id", "chunk_id", "similarity", F.col("vector_rank").cast("long").alias("vector_rank")), "similarity")


def boost_rank(spark, d):
    return rounded(ranked(spark, d).select("query_id", F.col("rank_in_query").cast("long").alias("rank_in_query"), "chunk_id", "score", "similarity"), "score", "similarity")


def diversify(spark, d):
    return search.diversify(ranked(spark, d), 5, 2, 3).select("query_id", F.col("position").cast("long").alias("position"), "chunk_id")


def retrieved(spark, d):
    rows = corpus.texts(spark, d)
    return search.retrieve(rows, corpus.parents(spark, d, rows), corpus.questions(spark, d), vectors=corpus.chunks(spark, d, rows))


def retrieve_full(spark, d):
    return rounded(retrieved(spark, d).select("query_id", F.col("rank").cast("long").alias("rank"), "chunk_id", "relation", "score", "similarity"), "score", "similarity")


def governing_context(spark, d):
    return retrieved(spark, d).where("relation = 'primary'").select("query_id", "chunk_id", "governing_context")


def cross_reference_expand(spark, d):
    return retrieved(spark, d).where("relation = 'cross_reference'").select("query_id", F.col("rank").cast("long").alias("rank"), "chunk_id")


def continuation_expand(spark, d):
    return retrieved(spark, d).where("relation IN ('continuation', 'adjacent')").select("query_id", F.col("rank").cast("long").alias("rank"), "chunk_id", "relation")


def search_api(spark, d):
    """What a search returns: primary rows, flat."""
    rows = retrieved(spark, d).where("relation = 'primary'").join(corpus.texts(spark, d), "chunk_id")
    return rounded(rows.select("query_id", "chunk_id", "document_id", "filename", "section_id", "clause_path", "text", "similarity", "score"), "similarity", "score")


def chunk_count(spark, d):
    return corpus.texts(spark, d).groupBy("document_id").agg(F.count("*").alias("n_chunks"))


def plot_source(spark, d):
    """Vectors with file, place in the file and a snippet, in order."""
    rows = corpus.texts(spark, d)
    snippet = F.when(F.length("text") > 120, F.concat(F.substring("text", 1, 120), F.lit("..."))).otherwise(F.col("text"))
    number = F.row_number().over(Window.partitionBy("filename").orderBy("doc_id")) - 1
    return rows.select("filename", number.cast("long").alias("chunk_index"), "chunk_id", snippet.alias("snippet")).orderBy("filename", "chunk_index")


def pca_projection(spark, d):
    """Two principal components of all vectors (signs are arbitrary, so there is no SQL)."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    rows = corpus.table(spark, d, "embeddings").select("vec_id", array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))
    fitted = PCA(k=2, inputCol="features", outputCol="pc").fit(rows)
    at = vector_to_array("pc")
    return fitted.transform(rows).select("vec_id", at[0].alias("x"), at[1].alias("y"))


def sql(select: str) -> str:
    return f"WITH {corpus.SQL_RETRIEVAL} {select}"


QUERIES = {f.__name__: f for f in (vector_topk, vector_topk_batch, vector_topk_filtered, inner_product_index, vector_norms, clause_resolve, adjacent_children, parent_excerpt, query_features, text_features, exact_merge, boost_rank, diversify, retrieve_full, governing_context, cross_reference_expand, continuation_expand, search_api, chunk_count, plot_source, pca_projection)}
SQL = {
    "vector_topk": """SELECT e.vec_id, round(list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS similarity
      FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q ORDER BY similarity DESC, vec_id LIMIT 10""",
    "vector_topk_batch": sql("SELECT query_id, vector_rank, chunk_id, round(similarity, 6) AS similarity FROM hits"),
    "vector_topk_filtered": sql("""SELECT s.query_id, row_number() OVER (PARTITION BY s.query_id ORDER BY s.similarity DESC, s.chunk_id) - 1 AS vector_rank, s.chunk_id, round(s.similarity, 6) AS similarity
      FROM sims s JOIN chunks c USING (chunk_id) WHERE c.document_id = 'd' || (s.query_id % 4) QUALIFY vector_rank < 5"""),
    "inner_product_index": sql("SELECT query_id, chunk_id, round(similarity, 6) AS inner_product FROM hits WHERE vector_rank < 2"),
    "vector_norms": "SELECT vec_id, round(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS norm, round(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]), 6) AS square FROM embeddings",
    "clause_resolve": sql("SELECT query_id, lower(clause_path) AS clause_key, chunk_id, child_order FROM asked JOIN chunks ON list_contains(q_clauses, lower(clause_path))"),
    "adjacent_children": sql("""SELECT p.chunk_id AS source_id, n.chunk_id AS neighbour, bool_or(coalesce(n.chunk_id IN (p.continues_from, p.continues_to), false)) AS is_link FROM chunks p JOIN chunks n
      ON n.chunk_id <> p.chunk_id AND (n.chunk_id IN (p.continues_from, p.continues_to) OR (n.parent_id = p.parent_id AND abs(n.child_order - p.child_order) <= 1)) GROUP BY ALL"""),
    "parent_excerpt": sql("SELECT chunk_id, c.parent_id, substr(p.text, 1, 600) AS governing_context FROM chunks c LEFT JOIN parents p ON p.parent_id = c.parent_id"),
    "query_features": sql("SELECT query_id, " + ", ".join(f"array_to_string(list_sort(list_distinct({c})), '|') AS {c}" for c in ("q_clauses", "q_amounts", "q_codes", "q_acronyms")) + ", q_list FROM asked"),
    "text_features": sql(r"""SELECT chunk_id,
      array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(text, '(?i)\b(?:R|ZAR|USD|EUR|GBP)\s?\d+(?:[ ,]\d{3})*(?:\.\d+)?(?:\s*(?:million|billion|thousand))?\b'), lambda x: lower(regexp_replace(x, '[\s,]', '', 'g'))))), '|') AS amounts,
      array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(text, '\b\d{3}\s+\d{2}\b'), lambda x: regexp_replace(x, '\s+', ' ', 'g')))), '|') AS codes,
      array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(regexp_replace(text, '([^\p{L}\p{N}_])', '\1\1', 'g'), '(?:^|[^\p{L}\p{N}_])([A-Z][A-Z0-9]{1,9})(?:$|[^\p{L}\p{N}_])', 1), lambda x: lower(x)))), '|') AS acronyms FROM chunks"""),
    "exact_merge": sql("SELECT query_id, chunk_id, round(similarity, 6) AS similarity, vector_rank FROM candidates"),
    "boost_rank": sql("SELECT query_id, rank_in_query, chunk_id, round(score, 6) AS score, round(similarity, 6) AS similarity FROM ranked"),
    "diversify": sql("SELECT query_id, position, chunk_id FROM chosen"),
    "retrieve_full": sql("SELECT query_id, rank, chunk_id, relation, round(score, 6) AS score, round(similarity, 6) AS similarity FROM final"),
    "governing_context": sql("SELECT query_id, chunk_id, governing_context FROM final WHERE relation = 'primary'"),
    "cross_reference_expand": sql("SELECT query_id, rank, chunk_id FROM final WHERE relation = 'cross_reference'"),
    "continuation_expand": sql("SELECT query_id, rank, chunk_id, relation FROM final WHERE relation IN ('continuation', 'adjacent')"),
    "search_api": sql("SELECT query_id, chunk_id, document_id, filename, section_id, clause_path, text, round(similarity, 6) AS similarity, round(score, 6) AS score FROM chosen"),
    "chunk_count": sql("SELECT document_id, count(*) AS n_chunks FROM chunks GROUP BY document_id"),
    "plot_source": sql("SELECT filename, row_number() OVER (PARTITION BY filename ORDER BY doc_id) - 1 AS chunk_index, chunk_id, CASE WHEN length(text) > 120 THEN substr(text, 1, 120) || '...' ELSE text END AS snippet FROM chunks"),
}
