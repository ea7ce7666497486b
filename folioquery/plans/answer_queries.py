"""Registered queries of citations, prompts, budgets, markers, history and evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioquery.config import DEFAULTS
from folioquery.operators import answer, evaluate
from folioquery.plans import corpus
from folioquery.plans.corpus import SQL_CHUNKS, table

GROUP = 8


def cited_chunks(spark, d) -> DataFrame:
    """Every chunk as the context of one of the questions, eight by eight, with pages and revisions planted."""
    n = F.col("doc_id")
    rows = corpus.texts(spark, d)
    place = F.when(n % 5 == 4, F.lit("")).otherwise(F.col("clause_path"))
    return rows.withColumns({
        "query_id": F.floor(n / GROUP), "rank": (n % GROUP + 1).cast("int"), "chunk_index": F.when(n % 11 > 0, n % 100), "clause_path": place,
        "section_id": F.when(n % 10 == 9, "").otherwise(F.col("section_id")), "breadcrumb": F.when(n % 3 == 0, F.concat(F.lit("A > "), F.col("section_id"))),
        "printed_page_start": F.when(n % 4 > 0, F.floor(n / 2).cast("string")), "printed_page_end": F.when(n % 4 > 0, F.floor((n + 1) / 2).cast("string")),
        "pdf_page_start": (F.floor(n / 2) + n % 2).cast("int"), "pdf_page_end": (F.floor(n / 2) + 1).cast("int"),
        "page_revisions": F.when(n % 6 == 0, F.array(F.lit("6/2026"), F.lit("6/2026"), F.lit("7/2026"))).otherwise(F.array(F.lit("6/2026"))),
        "governing_context": F.when(n % 2 == 0, "see <documents> above").otherwise(""), "label": F.when(n % 9 == 0, "given"),
    })


SQL_CITED = (
    SQL_CHUNKS
    + """
, cited AS (SELECT doc_id, chunk_id, document_id, filename, text, doc_id // 8 AS query_id, doc_id % 8 + 1 AS rank, CASE WHEN doc_id % 11 > 0 THEN doc_id % 100 END AS chunk_index,
  CASE WHEN doc_id % 5 = 4 THEN '' ELSE clause_path END AS clause_path, CASE WHEN doc_id % 10 = 9 THEN '' ELSE section_id END AS section_id, CASE WHEN doc_id % 3 = 0 THEN 'A > ' || CASE WHEN doc_id % 10 = 9 THEN '' ELSE section_id END END AS breadcrumb0, section_id AS section0,
  CASE WHEN doc_id % 4 > 0 THEN (doc_id // 2)::VARCHAR END AS pp1, CASE WHEN doc_id % 4 > 0 THEN ((doc_id + 1) // 2)::VARCHAR END AS pp2, (doc_id // 2 + doc_id % 2)::VARCHAR AS pdf1, (doc_id // 2 + 1)::VARCHAR AS pdf2,
  CASE WHEN doc_id % 6 = 0 THEN '6/2026–7/2026' ELSE '6/2026' END AS revs, CASE WHEN doc_id % 6 = 0 THEN '6/2026, 6/2026, 7/2026' ELSE '6/2026' END AS revs_all FROM chunks),
paged AS (SELECT *, CASE WHEN doc_id % 3 = 0 THEN 'A > ' || section0 END AS breadcrumb, coalesce(nullif(clause_path, ''), nullif(section_id, '')) AS place,
  CASE WHEN coalesce(pp2, pdf2) <> coalesce(pp1, pdf1) THEN 'pp. ' || coalesce(pp1, pdf1) || '–' || coalesce(pp2, pdf2) ELSE 'p. ' || coalesce(pp1, pdf1) END
  || CASE WHEN pp1 <> pdf1 THEN ' (PDF ' || pdf1 || CASE WHEN pdf2 <> pdf1 THEN '–' || pdf2 ELSE '' END || ')' ELSE '' END AS page FROM cited),
labelled AS (SELECT *, CASE WHEN place IS NOT NULL THEN place || ', ' || page ELSE filename || ', chunk ' || coalesce(chunk_index::VARCHAR, '?') END || ' · rev. ' || revs AS citation FROM paged),
blocks AS (SELECT query_id, rank, '<document ' || 'index="' || rank || '" source="' || filename || '" chunk="' || coalesce(chunk_index::VARCHAR, '?') || '"'
  || CASE WHEN place IS NOT NULL THEN ' clause="' || clause_path || '" printed_page="' || coalesce(pp1, '') || '" pdf_page="' || pdf1 || '" revision="' || revs_all || '"' ELSE '' END || '>' || chr(10)
  || CASE WHEN place IS NOT NULL THEN '[' || rank || '] (' || citation || '; source: ' || filename || ')' ELSE '[' || rank || '] (source: ' || filename || ', chunk ' || coalesce(chunk_index::VARCHAR, '?') || ')' END || chr(10)
  || coalesce('Inherited breadcrumb: ' || breadcrumb || chr(10), '') || CASE WHEN doc_id % 2 = 0 THEN 'Short governing context: see &lt;documents> above' || chr(10) ELSE '' END
  || 'Quoted source text:' || chr(10) || text || chr(10) || '</document>' AS block FROM labelled),
costs AS (SELECT *, sum(length(block) + CASE WHEN rank > first THEN 2 ELSE 0 END) OVER (PARTITION BY query_id ORDER BY rank) AS spent FROM (SELECT *, min(rank) OVER (PARTITION BY query_id) AS first FROM blocks)),
kept AS (SELECT query_id, rank, block, spent FROM costs WHERE spent <= greatest(0, 8192 * 3 - 500 - 1024 * 3))
"""
)


def citation_labels(spark, d):
    return cited_chunks(spark, d).select("chunk_id", answer.citation_label().alias("citation"))


def display_labels(spark, d):
    return cited_chunks(spark, d).select("chunk_id", answer.display_label().alias("label"))


def citation_dedupe(spark, d):
    """Contexts of a document share a citation where place and pages agree."""
    rows = cited_chunks(spark, d).withColumns({c: F.lit("1").cast(t) for c, t in zip(answer.PRINTED, ("string", "string", "int", "int"), strict=True)})
    return answer.citations(rows).select("query_id", "document_id", "chunk_id", F.array_join("markers", ",").alias("markers"), "first_marker")


def blocks_of(spark, d):
    return cited_chunks(spark, d).withColumn("block", answer.document_block()).select("query_id", "rank", "block")


def prompt_blocks(spark, d):
    return blocks_of(spark, d)


def compact_blocks(spark, d):
    rows = cited_chunks(spark, d).withColumn("relation", F.when(F.col("rank") > 4, "adjacent"))
    return rows.select("query_id", "rank", answer.compact_block().alias("block"))


def context_budget(spark, d):
    kept = answer.within_budget(blocks_of(spark, d), 8192, F.lit(500))
    return kept.select("query_id", "rank", F.col("spent").cast("long").alias("spent"))


def prompt_build(spark, d):
    kept = answer.within_budget(blocks_of(spark, d), 8192, F.lit(500))
    asked = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    return answer.prompts(asked, kept).select("query_id", F.md5("user_prompt").alias("prompt_md5"), F.col("used").cast("long").alias("used"))


def cited_markers(spark, d):
    """Markers planted in conversation texts; those above 5 do not count."""
    n = F.col("turn") + F.col("conv_id")
    said = F.concat(F.coalesce("text", F.lit("")), F.lit(" ["), n % 7, F.lit("] and ["), n % 3 + 1, F.lit(" , "), n % 11, F.lit("] [x] [99]"))
    return table(spark, d, "conversations").select("conv_id", "turn", F.array_join(answer.cited_markers(said, F.lit(5)), ",").alias("markers"))


def histories(spark, d):
    turns = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))).alias("t"))
    return turns.select("conv_id", F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content"))).alias("history"))


def history_append(spark, d):
    grown = answer.appended(F.col("history"), F.concat(F.lit("q"), F.col("conv_id")), F.lit("a"))
    flat = F.array_join(F.transform(grown, lambda t: F.concat_ws(":", t["role"], F.coalesce(t["content"], F.lit("")))), "\n")
    return histories(spark, d).select("conv_id", F.size(grown).cast("long").alias("turns"), F.md5(flat).alias("history_md5"))


def last_user_question(spark, d):
    return histories(spark, d).select("conv_id", answer.last_question(F.col("history")).alias("question"))


def classify_query(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", evaluate.question_type(F.col("text")).alias("type"))


def asked_types(spark, d):
    hints = F.array(*map(F.lit, ("please summarise ", "compare ", "list ", "what does ", "hello ")))
    n = F.col("item_id")
    asked = F.concat(F.element_at(hints, (n % 5 + 1).cast("int")), F.coalesce("text", F.lit("")))
    return table(spark, d, "benchmark").select(n.alias("index"), asked.alias("question"), evaluate.question_type(asked).alias("type"))


def type_override(spark, d):
    given = spark.createDataFrame([(0, 3, None, "special"), (1, None, "Hello", "greeting"), (2, None, "e", "vowel"), (3, None, "compare ", "never")], "position int, index long, part string, type string")
    return evaluate.with_overrides(asked_types(spark, d), given).select("index", "type")


def responses(spark, d) -> DataFrame:
    """Eight chunks for each response; the toxic label stands in for the citation, vectors give the figures."""
    v = [F.get("embedding", F.lit(i)).cast("double") for i in range(2)]
    n = F.col("vec_id")
    rows = table(spark, d, "embeddings").select(F.floor(n / GROUP).alias("response_no"), F.struct((n % GROUP + 1).cast("int").alias("rank"), F.when(n % 8 < 5, "primary").otherwise("adjacent").alias("relation"), F.round(v[0], 4).alias("similarity"), (n % 3 == 0).alias("cited"), F.when(n % 7 > 0, F.round(v[1], 4)).alias("answer_similarity")).alias("item"))
    items = rows.groupBy("response_no").agg(F.array_sort(F.collect_list("item")).alias("evaluation"))
    kind = F.element_at(F.array(*map(F.lit, ("list", "factual", "other"))), (F.col("response_no") % 3 + 1).cast("int"))
    return items.select("response_no", kind.alias("type"), F.when(F.col("response_no") % 10 != 9, F.col("evaluation")).alias("evaluation"))


SQL_RESPONSES = """
items AS (SELECT vec_id // 8 AS response_no, (vec_id % 8 + 1)::INT AS rank, CASE WHEN vec_id % 8 < 5 THEN 'primary' ELSE 'adjacent' END AS relation, round(embedding[1]::DOUBLE, 4) AS similarity, vec_id % 3 = 0 AS cited,
  CASE WHEN vec_id % 7 > 0 THEN round(embedding[2]::DOUBLE, 4) END AS answer_similarity, ['list', 'factual', 'other'][((vec_id // 8) % 3 + 1)::INT] AS type FROM embeddings),
kept AS (SELECT *, 'R' || dense_rank() OVER (ORDER BY response_no) AS response FROM items WHERE response_no % 10 <> 9),
summary AS (SELECT response, type, count(*) AS retrieved, count(*) FILTER (cited) AS cited_chunks, round_even(avg(similarity) FILTER (cited AND relation = 'primary'), 3) AS mean_cited_similarity,
  round_even(max(similarity) FILTER (cited AND relation = 'primary'), 3) AS max_cited_similarity, round_even(avg(similarity) FILTER (relation = 'primary'), 3) AS mean_similarity, round_even(avg(answer_similarity) FILTER (cited), 3) AS mean_answer_similarity FROM kept GROUP BY ALL)
"""


def eval_flatten(spark, d):
    return evaluate.flattened(responses(spark, d)).select("response", "type", "rank", "relation", "similarity", "cited", "answer_similarity")


def eval_response_summary(spark, d):
    return evaluate.by_response(evaluate.flattened(responses(spark, d)))


def eval_type_summary(spark, d):
    return evaluate.by_type(evaluate.by_response(evaluate.flattened(responses(spark, d))))


def similarity_quartiles(spark, d):
    return evaluate.quartiles(evaluate.flattened(responses(spark, d)))


def marker_pivot(spark, d):
    return evaluate.marker_pivot(evaluate.flattened(responses(spark, d)), GROUP)


def quality_by_type(spark, d):
    rows = evaluate.by_response(evaluate.flattened(responses(spark, d)))
    out = evaluate.by_type_and_overall(rows, ["mean_similarity", "mean_answer_similarity"])
    return out.select("type", "n", *[F.round(c, 6).alias(c) for c in ("mean_similarity", "mean_answer_similarity")])


def eval_items(spark, d):
    """Cosine of an answer vector and of each chunk's vector; the answer is the first chunk."""
    rows = corpus.chunks(spark, d).select(F.floor(F.col("doc_id") / GROUP).alias("query_id"), (F.col("doc_id") % GROUP + 1).alias("rank"), F.col("embedding").alias("vector"))
    answers = rows.where("rank = 1").select("query_id", F.array(F.lit(1).cast("long"), F.lit(3).cast("long")).alias("markers"), F.col("vector").alias("answer_vector"))
    return evaluate.items(rows, answers).select("query_id", "rank", "cited", F.round("answer_similarity", 6).alias("answer_similarity"))


def chat_flagship(spark, d):
    """Retrieve, fit into the budget, and build the prompts of all questions."""
    from folioquery.plans.chat import contexts_and_prompts

    rows = corpus.texts(spark, d)
    _, made = contexts_and_prompts(rows, corpus.parents(spark, d, rows), corpus.questions(spark, d), vectors=corpus.chunks(spark, d, rows))
    return made.select("query_id", "used", F.length("user_prompt").alias("prompt_chars"))


def types_sql(text: str) -> str:
    rules = " ".join(f"WHEN {' OR '.join(f'contains(lower({text}), ' + chr(39) + h + chr(39) + ')' for h in hints)} THEN '{name}'" for name, hints in evaluate.QUESTION_WORDS.items())
    return f"CASE {rules} ELSE 'other' END"


ASKED = "(['please summarise ', 'compare ', 'list ', 'what does ', 'hello '][(item_id % 5 + 1)::INT] || coalesce(text, ''))"
SQL = {
    "citation_labels": f"WITH {SQL_CITED} SELECT chunk_id, citation FROM labelled",
    "display_labels": f"WITH {SQL_CITED} SELECT chunk_id, CASE WHEN doc_id % 9 = 0 THEN 'given' ELSE coalesce(place || ', ' || page, page) || ' · rev. ' || revs END AS label FROM labelled",
    "citation_dedupe": f"""WITH {SQL_CITED}, keyed AS (SELECT *, CASE WHEN place IS NULL THEN chunk_id END AS alone FROM paged)
      SELECT query_id, document_id, arg_min(chunk_id, rank) AS chunk_id, string_agg(rank::VARCHAR, ',' ORDER BY rank) AS markers, min(rank)::INT AS first_marker FROM keyed GROUP BY query_id, document_id, place, alone""",
    "prompt_blocks": f"WITH {SQL_CITED} SELECT query_id, rank::INT AS rank, block FROM blocks",
    "compact_blocks": f"""WITH {SQL_CITED} SELECT query_id, rank::INT AS rank, '<document id="' || rank || '" relation="' || CASE WHEN rank > 4 THEN 'adjacent' ELSE 'primary' END || '" source="' || filename || '"'
      || CASE WHEN clause_path <> '' THEN ' clause="' || clause_path || '"' WHEN section_id <> '' THEN ' section="' || section_id || '"' ELSE '' END || ' pages="' || page || '"' || coalesce(' chunk="' || chunk_index || '"', '') || '>' || chr(10)
      || coalesce('Breadcrumb: ' || breadcrumb || chr(10), '') || CASE WHEN doc_id % 2 = 0 THEN 'Governing context: see &lt;documents> above' || chr(10) ELSE '' END || text || chr(10) || '</document>' AS block FROM paged""",
    "chat_flagship": f"""WITH {corpus.SQL_RETRIEVAL}, blocks AS (SELECT query_id, f.rank, '<document index="' || f.rank || '" source="' || c.filename || '" chunk="?" clause="' || c.clause_path || '" printed_page="" pdf_page="" revision="">' || chr(10)
      || '[' || f.rank || '] (' || c.clause_path || '; source: ' || c.filename || ')' || chr(10) || CASE WHEN trim(governing_context) <> '' THEN 'Short governing context: ' || trim(governing_context) || chr(10) ELSE '' END
      || 'Quoted source text:' || chr(10) || c.text || chr(10) || '</document>' AS block FROM final f JOIN chunks c USING (chunk_id)),
      costs AS (SELECT *, sum(length(block) + CASE WHEN rank > 1 THEN 2 ELSE 0 END) OVER (PARTITION BY query_id ORDER BY rank) AS spent FROM blocks),
      kept AS (SELECT query_id, count(*) AS used, string_agg(block, chr(10) || chr(10) ORDER BY rank) AS body FROM costs JOIN questions USING (query_id)
        WHERE spent <= greatest(0, {DEFAULTS.context_tokens} * 3 - {len(answer.SYSTEM_PROMPT) + len("<documents>..</documents>..Question: ")} - length(query) - 1024 * 3) GROUP BY query_id)
      SELECT q.query_id, coalesce(used, 0)::INT AS used, length('<documents>' || chr(10) || coalesce(body, '{answer.NO_CONTEXT}') || chr(10) || '</documents>' || chr(10) || chr(10) || 'Question: ' || query)::INT AS prompt_chars FROM questions q LEFT JOIN kept k ON k.query_id = q.query_id""",
    "context_budget": f"WITH {SQL_CITED} SELECT query_id, rank::INT AS rank, spent::BIGINT AS spent FROM kept",
    "prompt_build": f"""WITH {SQL_CITED}, joined AS (SELECT query_id, string_agg(block, chr(10) || chr(10) ORDER BY rank) AS body, count(*) AS used FROM kept GROUP BY query_id)
      SELECT b.item_id AS query_id, md5('<documents>' || chr(10) || coalesce(body, '(No relevant documents found)') || chr(10) || '</documents>' || chr(10) || chr(10) || 'Question: ' || b.text) AS prompt_md5, coalesce(used, 0) AS used
      FROM benchmark b LEFT JOIN joined j ON j.query_id = b.item_id""",
    "cited_markers": r"""WITH said AS (SELECT conv_id, turn, coalesce(text, '') || ' [' || ((turn + conv_id) % 7) || '] and [' || ((turn + conv_id) % 3 + 1) || ' , ' || ((turn + conv_id) % 11) || '] [x] [99]' AS t FROM conversations),
      found AS (SELECT conv_id, turn, list_transform(flatten(list_transform(regexp_extract_all(t, '\[(\d+(?:\s*,\s*\d+)*)\]', 1), lambda g: string_split(g, ','))), lambda x: trim(x)::BIGINT) AS m FROM said)
      SELECT conv_id, turn, array_to_string(list_sort(list_distinct(list_filter(m, lambda x: x BETWEEN 1 AND 5))), ',') AS markers FROM found""",
    "history_append": """WITH h AS (SELECT conv_id, count(*) AS n, string_agg(role || ':' || coalesce(text, ''), chr(10) ORDER BY turn) AS t FROM conversations GROUP BY conv_id)
      SELECT conv_id, n + 2 AS turns, md5(t || chr(10) || 'user:q' || conv_id || chr(10) || 'assistant:a') AS history_md5 FROM h""",
    "last_user_question": "SELECT conv_id, coalesce(max_by(text, turn) FILTER (role = 'user'), '') AS question FROM conversations GROUP BY conv_id",
    "classify_query": f"SELECT conv_id, turn, {types_sql('text')} AS type FROM conversations",
    "type_override": f"SELECT item_id AS index, CASE WHEN item_id = 3 THEN 'special' WHEN contains(lower({ASKED}), 'hello') THEN 'greeting' WHEN contains(lower({ASKED}), 'e') THEN 'vowel' ELSE {types_sql(ASKED)} END AS type FROM benchmark",
    "eval_flatten": f"WITH {SQL_RESPONSES} SELECT response, type, rank, relation, similarity, cited, answer_similarity FROM kept",
    "eval_response_summary": f"WITH {SQL_RESPONSES} SELECT * FROM summary",
    "eval_type_summary": f"""WITH {SQL_RESPONSES} SELECT type, count(*) AS responses, round_even(avg(mean_cited_similarity), 3) AS mean_cited_similarity, round_even(avg(mean_similarity), 3) AS mean_similarity, round_even(avg(mean_answer_similarity), 3) AS mean_answer_similarity FROM summary GROUP BY type""",
    "similarity_quartiles": f"""WITH {SQL_RESPONSES} SELECT type, count(*) AS n, min(similarity) AS lowest, quantile_cont(similarity, 0.25) AS q1, quantile_cont(similarity, 0.5) AS median, quantile_cont(similarity, 0.75) AS q3, max(similarity) AS highest FROM kept WHERE relation = 'primary' GROUP BY type""",
    "marker_pivot": f"WITH {SQL_RESPONSES} SELECT response, " + ", ".join(f"max(answer_similarity) FILTER (rank = {m}) AS m{m}" for m in range(1, GROUP + 1)) + " FROM kept WHERE cited GROUP BY response",
    "quality_by_type": f"WITH {SQL_RESPONSES} SELECT type, count(*) AS n, round(avg(mean_similarity), 6) AS mean_similarity, round(avg(mean_answer_similarity), 6) AS mean_answer_similarity FROM summary GROUP BY GROUPING SETS ((type), ())",
    "eval_items": f"""WITH {SQL_CHUNKS}, r AS (SELECT doc_id // 8 AS query_id, doc_id % 8 + 1 AS rank, embedding FROM chunks)
      SELECT r.query_id, r.rank, r.rank IN (1, 3) AS cited, round(list_cosine_similarity(a.embedding, r.embedding), 6) AS answer_similarity FROM r JOIN r a ON a.query_id = r.query_id AND a.rank = 1""",
}
QUERIES = {f.__name__: f for f in (citation_labels, display_labels, citation_dedupe, prompt_blocks, compact_blocks, context_budget, prompt_build, cited_markers, history_append, last_user_question, classify_query, type_override, eval_flatten, eval_response_summary, eval_type_summary, similarity_quartiles, marker_pivot, quality_by_type, eval_items, chat_flagship)}
