"""A retrieval corpus derived from `documents` and `embeddings` by arithmetic, so that every query has exact SQL.

Each document is a chunk; its place (document, parent, section, clause, links) follows from doc_id, and a
sentence with a reference, an amount and a code is planted at its end. Questions come from `benchmark`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def letter(n: Column) -> Column:
    return F.char(n + 65)


def section_of(n: Column) -> Column:
    block = F.floor(n / 16)
    return F.concat(letter(block % 11), F.lit("."), (1 + block % 9).cast("string"))


def clause_of(n: Column) -> Column:
    roman = F.element_at(F.array(*map(F.lit, ("i", "ii", "iii", "iv"))), (n % 4 + 1).cast("int"))
    return F.concat(section_of(n), F.lit("("), letter(F.floor(n / 4) % 26), F.lit(")("), roman, F.lit(")"))


def planted(n: Column) -> Column:
    """ see <clause> for R<n> million, code ddd dd"""
    return F.concat(F.lit(" see "), clause_of(n + 5), F.lit(" for R"), (n % 7 + 1).cast("string"), F.lit(" million, code "), (100 + n % 50).cast("string"), F.lit(" "), (10 + n % 5).cast("string"))


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chunks without their vectors, for everything but the vector scan: no join is made for a column not read."""
    n = F.col("doc_id")
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", F.concat(F.lit("c"), n).alias("chunk_id"), F.concat(F.lit("d"), F.floor(n / 64)).alias("document_id"),
        F.concat(F.lit("p"), F.floor(n / 4)).alias("parent_id"), section_of(n).alias("section_id"), clause_of(n).alias("clause_path"),
        F.when(n % 10 == 0, F.concat(F.lit("term"), n % 30)).alias("defined_term"), F.lit(None).cast("string").alias("code"),
        (n % 4).cast("int").alias("child_order"), F.when(n % 8 == 1, F.concat(F.lit("c"), n - 1)).alias("continues_from"),
        F.when(n % 8 == 0, F.concat(F.lit("c"), n + 1)).alias("continues_to"), F.array(clause_of(n + 5)).alias("cross_references"),
        F.concat(F.coalesce("text", F.lit("")), planted(n)).alias("text"), "source", "lang",
    )
    return docs.withColumn("filename", F.concat("document_id", F.lit(".pdf")))


def chunks(spark: SparkSession, sf_dir: str, rows: DataFrame | None = None) -> DataFrame:
    """The texts (rows, if they are at hand) with vectors; those without one stay, only the vector scan passes them over."""
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    return (rows or texts(spark, sf_dir)).join(vectors, "doc_id", "left")


def parents(spark: SparkSession, sf_dir: str, rows: DataFrame | None = None) -> DataFrame:
    """A parent's text is that of its children in order."""
    rows = (rows or texts(spark, sf_dir)).groupBy("parent_id").agg(F.array_sort(F.collect_list(F.struct("child_order", "text"))).alias("kids"))
    return rows.select("parent_id", F.array_join(F.transform("kids", lambda k: k["text"]), "\n").alias("text"))


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, query, query_vector: every benchmark item asks about a clause, an amount, a code or a term."""
    n = F.col("item_id")
    kind = F.when(n % 4 == 0, F.concat(F.lit("What does "), clause_of(n * 7), F.lit(" say?")))
    kind = kind.when(n % 4 == 1, F.concat(F.lit("List all limits of R"), (n % 7 + 1).cast("string"), F.lit(" million")))
    kind = kind.when(n % 4 == 2, F.concat(F.lit("Where is code "), (100 + n % 50).cast("string"), F.lit("  "), (10 + n % 5).cast("string"), F.lit(" used?")))
    kind = kind.otherwise(F.concat(F.lit("Explain Term"), n % 30, F.lit(" under "), clause_of(n * 3)))
    asked = table(spark, sf_dir, "benchmark").select(n.alias("query_id"), kind.alias("query"), n.alias("vec_id"))
    return asked.join(table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("query_vector")), "vec_id").drop("vec_id")


# The same in DuckDB.
def sql_section(n: str) -> str:
    return f"(chr((65 + (({n}) // 16) % 11)::INT) || '.' || (1 + (({n}) // 16) % 9))"


def sql_clause(n: str) -> str:
    return f"({sql_section(n)} || '(' || chr((65 + (({n}) // 4) % 26)::INT) || ')(' || ['i','ii','iii','iv'][(1 + ({n}) % 4)::INT] || ')')"


SQL_CHUNKS = f"""
docs AS (SELECT doc_id, 'c' || doc_id AS chunk_id, 'd' || (doc_id // 64) AS document_id, 'p' || (doc_id // 4) AS parent_id,
  {sql_section("doc_id")} AS section_id, {sql_clause("doc_id")} AS clause_path,
  CASE WHEN doc_id % 10 = 0 THEN 'term' || (doc_id % 30) END AS defined_term, doc_id % 4 AS child_order,
  CASE WHEN doc_id % 8 = 1 THEN 'c' || (doc_id - 1) END AS continues_from, CASE WHEN doc_id % 8 = 0 THEN 'c' || (doc_id + 1) END AS continues_to,
  {sql_clause("doc_id + 5")} AS ref, lang, source,
  coalesce(text, '') || ' see ' || {sql_clause("doc_id + 5")} || ' for R' || (doc_id % 7 + 1) || ' million, code ' || (100 + doc_id % 50) || ' ' || (10 + doc_id % 5) AS text
  FROM documents),
chunks AS (SELECT d.*, e.embedding::DOUBLE[] AS embedding, document_id || '.pdf' AS filename FROM docs d LEFT JOIN embeddings e ON e.vec_id = d.doc_id),
questions AS (SELECT b.item_id AS query_id, e.embedding::DOUBLE[] AS query_vector, CASE b.item_id % 4
    WHEN 0 THEN 'What does ' || {sql_clause("b.item_id * 7")} || ' say?'
    WHEN 1 THEN 'List all limits of R' || (b.item_id % 7 + 1) || ' million'
    WHEN 2 THEN 'Where is code ' || (100 + b.item_id % 50) || '  ' || (10 + b.item_id % 5) || ' used?'
    ELSE 'Explain Term' || (b.item_id % 30) || ' under ' || {sql_clause("b.item_id * 3")} END AS query
  FROM benchmark b JOIN embeddings e ON e.vec_id = b.item_id)
"""

#: The retrieval of all questions, step by step, up to `final` (rows of every relation with their rank).
SQL_RETRIEVAL = (
    SQL_CHUNKS
    + r"""
, parents AS (SELECT parent_id, string_agg(text, chr(10) ORDER BY child_order) AS text FROM chunks GROUP BY parent_id),
sims AS (SELECT query_id, chunk_id, round(coalesce(list_cosine_similarity(query_vector, embedding), 0), 12) AS similarity FROM questions, chunks WHERE embedding IS NOT NULL),
hits AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, chunk_id) - 1 AS vector_rank FROM sims QUALIFY vector_rank < 10),
asked AS (SELECT *, list_distinct(list_transform(regexp_extract_all(query, '\b([A-K](?:(?:\.\d+)+|\.)(?:\([A-Za-z0-9]+\))*)(?:[^A-Za-z0-9]|$)', 1), lambda x: lower(rtrim(x, '.')))) AS q_clauses,
  list_transform(regexp_extract_all(query, '(?i)\b(?:R|ZAR|USD|EUR|GBP)\s?\d+(?:[ ,]\d{3})*(?:\.\d+)?(?:\s*(?:million|billion|thousand))?\b'), lambda x: lower(regexp_replace(x, '[\s,]', '', 'g'))) AS q_amounts,
  list_transform(regexp_extract_all(query, '\b\d{3}\s+\d{2}\b'), lambda x: regexp_replace(x, '\s+', ' ', 'g')) AS q_codes,
  list_transform(regexp_extract_all(regexp_replace(query, '([^\p{L}\p{N}_])', '\1\1', 'g'), '(?:^|[^\p{L}\p{N}_])([A-Z][A-Z0-9]{1,9})(?:$|[^\p{L}\p{N}_])', 1), lambda x: lower(x)) AS q_acronyms,
  regexp_matches(query, '(?i)\b(all|list|which|what are|following|codes?|categories|steps|requirements)\b') AS q_list FROM questions),
exact AS (SELECT query_id, chunk_id, 0.0::DOUBLE AS similarity, -1 AS vector_rank FROM asked JOIN chunks ON list_contains(q_clauses, lower(clause_path))
  WHERE (query_id, chunk_id) NOT IN (SELECT query_id, chunk_id FROM hits)),
candidates AS (SELECT query_id, chunk_id, similarity, vector_rank FROM hits UNION ALL SELECT * FROM exact),
boosted AS (SELECT q.query_id, c.*, s.similarity, s.vector_rank, q.q_list,
    s.similarity + CASE WHEN list_contains(q_clauses, lower(clause_path)) THEN 1.0::DOUBLE ELSE 0 END
    + CASE WHEN list_has_any(q_amounts, list_transform(regexp_extract_all(text, '(?i)\b(?:R|ZAR|USD|EUR|GBP)\s?\d+(?:[ ,]\d{3})*(?:\.\d+)?(?:\s*(?:million|billion|thousand))?\b'), lambda x: lower(regexp_replace(x, '[\s,]', '', 'g'))))
        OR list_has_any(q_codes, list_transform(regexp_extract_all(text, '\b\d{3}\s+\d{2}\b'), lambda x: regexp_replace(x, '\s+', ' ', 'g'))) THEN 0.35::DOUBLE ELSE 0 END
    + CASE WHEN contains(' ' || lower(query) || ' ', ' ' || defined_term || ' ')
        OR list_has_any(q_acronyms, list_transform(regexp_extract_all(regexp_replace(text, '([^\p{L}\p{N}_])', '\1\1', 'g'), '(?:^|[^\p{L}\p{N}_])([A-Z][A-Z0-9]{1,9})(?:$|[^\p{L}\p{N}_])', 1), lambda x: lower(x))) THEN 0.20::DOUBLE ELSE 0 END AS score
  FROM candidates s JOIN chunks c USING (chunk_id) JOIN asked q USING (query_id)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vector_rank, chunk_id) AS rank_in_query FROM boosted),
capped AS (SELECT *, row_number() OVER (PARTITION BY query_id, parent_id ORDER BY rank_in_query) AS in_parent FROM ranked),
in_sections AS (SELECT *, CASE WHEN in_parent <= 2 THEN row_number() OVER (PARTITION BY query_id, section_id, in_parent <= 2 ORDER BY rank_in_query) END AS in_section FROM capped),
placed AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN in_parent <= 2 AND in_section <= 3 THEN 0 ELSE 1 END, rank_in_query) AS position FROM in_sections),
chosen AS (SELECT * FROM placed WHERE position <= 5),
pairs AS (
  SELECT p.query_id, p.position, p.score, p.q_list, n.chunk_id, n.child_order AS n_order, coalesce(n.chunk_id IN (p.continues_from, p.continues_to), false) AS is_link
  FROM chosen p JOIN chunks n ON n.chunk_id <> p.chunk_id AND (n.chunk_id IN (p.continues_from, p.continues_to) OR (n.parent_id = p.parent_id AND abs(n.child_order - p.child_order) <= 1))),
near AS (SELECT query_id, chunk_id, CASE WHEN is_link THEN 'continuation' ELSE 'adjacent' END AS relation, position, 1 AS phase, n_order AS inner_order, score FROM pairs
  WHERE (q_list OR is_link) AND (query_id, chunk_id) NOT IN (SELECT query_id, chunk_id FROM chosen)
  QUALIFY row_number() OVER (PARTITION BY query_id, chunk_id ORDER BY position, n_order) = 1),
cited AS (SELECT p.query_id, t.chunk_id, 'cross_reference' AS relation, min(p.position) AS position, 2 AS phase, t.child_order AS inner_order, 0.0::DOUBLE AS score
  FROM chosen p JOIN chunks t ON t.document_id = p.document_id AND lower(t.clause_path) = lower(p.ref)
  WHERE (p.query_id, t.chunk_id) NOT IN (SELECT query_id, chunk_id FROM chosen UNION ALL SELECT query_id, chunk_id FROM near) GROUP BY ALL),
everything AS (SELECT query_id, chunk_id, 'primary' AS relation, position, 0 AS phase, 0 AS inner_order, score FROM chosen UNION ALL SELECT * FROM near UNION ALL SELECT * FROM cited),
final AS (SELECT e.query_id, e.chunk_id, e.relation, e.score, row_number() OVER (PARTITION BY e.query_id ORDER BY phase, e.position, inner_order, e.chunk_id) AS rank,
  coalesce(c.similarity, 0.0) AS similarity, CASE WHEN e.relation = 'primary' THEN coalesce(substr(p.text, 1, 600), '') ELSE '' END AS governing_context
  FROM everything e LEFT JOIN chosen c ON c.query_id = e.query_id AND c.chunk_id = e.chunk_id LEFT JOIN parents p ON p.parent_id = c.parent_id)
"""
)
