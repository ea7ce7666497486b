"""Registered queries of cleaning, page analysis, segmentation, ids and references.

The driver's texts are clean, so noise is planted by doc_id where a query would otherwise have nothing to do.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioquery.functions import text as T
from folioquery.operators import pages
from folioquery.plans.corpus import SQL_CHUNKS, table, texts


def noisy(spark, d) -> DataFrame:
    """Texts with carriage returns, hyphens at line ends, invisible marks, double blanks and blank lines planted."""
    n, text = F.col("doc_id"), F.coalesce("text", F.lit(""))
    text = F.when(n % 2 == 0, F.replace(text, F.lit("\n"), F.lit("\r\n"))).otherwise(text)
    text = F.when(n % 3 == 0, F.replace(text, F.lit(", "), F.lit("-\n"))).otherwise(text)
    text = F.when(n % 5 == 0, F.replace(text, F.lit(". "), F.lit(".​\u0007 "))).otherwise(text)
    text = F.when(n % 7 == 0, F.replace(text, F.lit(" "), F.lit(" \t "))).otherwise(text)
    text = F.when(n % 4 == 1, F.concat(F.lit("\n\n    "), F.replace(text, F.lit("\n"), F.lit("\n\n\n\n")), F.lit("  \n"))).otherwise(text)
    return table(spark, d, "documents").select("doc_id", text.alias("text"))


SQL_NOISY = """
n1 AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN replace(coalesce(text, ''), chr(10), chr(13) || chr(10)) ELSE coalesce(text, '') END AS text FROM documents),
n2 AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN replace(text, ', ', '-' || chr(10)) ELSE text END AS text FROM n1),
n3 AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN replace(text, '. ', '.' || chr(8203) || chr(7) || ' ') ELSE text END AS text FROM n2),
n4 AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN replace(text, ' ', ' ' || chr(9) || ' ') ELSE text END AS text FROM n3),
noisy AS (SELECT doc_id, CASE WHEN doc_id % 4 = 1 THEN chr(10) || chr(10) || '    ' || replace(text, chr(10), repeat(chr(10), 4)) || '  ' || chr(10) ELSE text END AS text FROM n4)
"""
CONTROL = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x{9f}\x{fffd}]"
INVISIBLE = r"[\x{200b}-\x{200f}\x{202a}-\x{202e}\x{2060}\x{feff}]"
BLANKS = r"[ \t\x{00a0}\x{2000}-\x{200a}\x{205f}\x{3000}]"
EXOTIC = r"[\t\x{00a0}\x{2000}-\x{200a}\x{205f}\x{3000}]"


def sql_lines(text: str) -> str:
    body = rf"rtrim(regexp_replace(regexp_replace(l, '^{BLANKS}+', ''), '{BLANKS}+', ' ', 'g'), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(160))"
    return rf"array_to_string(list_transform(string_split({text}, chr(10)), lambda l: CASE WHEN {body} = '' THEN '' ELSE regexp_replace(regexp_extract(l, '^{BLANKS}*'), '{EXOTIC}', ' ', 'g') || {body} END), chr(10))"


SQL_UNIFIED = r"regexp_replace(text, '\r\n?', chr(10), 'g')"
SQL_JOINED = rf"regexp_replace({SQL_UNIFIED}, '([A-Za-z])-\n([a-z])', '\1\2', 'g')"
SQL_VISIBLE = rf"regexp_replace(regexp_replace({SQL_JOINED}, '{CONTROL}', '', 'g'), '{INVISIBLE}', '', 'g')"
SQL_CLEAN = rf"trim(regexp_replace({sql_lines(SQL_VISIBLE)}, '\n{{3,}}', chr(10) || chr(10), 'g'), chr(10))"


def one(name, column):
    def run(spark, d):
        return noisy(spark, d).select("doc_id", column(F.col("text")).alias("text"))

    run.__name__ = name
    return run


clean_text_ascii = one("clean_text_ascii", lambda t: T.clean_text(t, normalise=False))
clean_text_full = one("clean_text_full", T.clean_text)
unify_newlines = one("unify_newlines", T.unify_newlines)
dehyphenate = one("dehyphenate", lambda t: T.dehyphenate(T.unify_newlines(t)))
strip_invisible = one("strip_invisible", T.strip_invisible)
clean_lines = one("clean_lines", T.clean_lines)
cap_blank_lines = one("cap_blank_lines", T.cap_blank_lines)


def nfkc_identity(spark, d):
    return table(spark, d, "documents").select("doc_id", T.nfkc(F.col("text")).alias("text"))


def line_explode(spark, d):
    """Non-blank lines with their number among all such lines of the document, and their indent."""
    return pages.line_scan(noisy(spark, d).select("doc_id", T.unify_newlines(F.col("text")).alias("text")), "doc_id").select("doc_id", "sequence", "indent", "line")


def tabled(spark, d) -> DataFrame:
    """Texts with a small Markdown table after every third line."""
    planted = F.regexp_replace("text", r"\n([^\n]*)\n([^\n]*)\n", "\n$1\n$2\n| a | b |\n| --- | --- |\n| 1 | 2 |\n")
    return table(spark, d, "documents").select("doc_id", planted.alias("text"))


def table_segments(spark, d):
    """Segments of prose and tables: kind, first and last line."""
    return pages.table_segments(tabled(spark, d), "doc_id")


def legal_score(spark, d):
    t = F.col("text")
    return texts(spark, d).select("chunk_id", pages.parser_legal_score(t).alias("parser_score"), pages.chunker_legal_score(t).alias("chunker_score"))


def furniture_frequency(spark, d):
    """How often a block key occurs in the margin bands of a source's pages; every document is a page here."""
    lines = page_blocks(spark, d)
    return pages.furniture_keys(lines, "source").select("source", "furniture_key", "n_blocks", "is_furniture")


def page_blocks(spark, d) -> DataFrame:
    """A header, a body and a footer block for each document."""
    n = F.col("doc_id")
    head = F.struct(F.concat(F.lit("Manual  of "), F.col("source")).alias("raw_text"), F.lit(44.0).alias("top"), F.lit(55.0).alias("bottom"))
    body = F.struct(F.coalesce("text", F.lit("")).alias("raw_text"), F.lit(90.0).alias("top"), F.lit(700.0).alias("bottom"))
    foot = F.struct(F.concat((n % 300).cast("string"), F.lit(" of 298 "), (n % 12 + 1).cast("string"), F.lit("/2026")).alias("raw_text"), F.lit(790.0).alias("top"), F.lit(802.0).alias("bottom"))
    rows = table(spark, d, "documents").select("source", n.alias("pdf_page"), F.posexplode(F.array(head, body, foot)).alias("block_order", "b"))
    return rows.select("source", "pdf_page", "block_order", F.lit(842.0).alias("height"), "b.*")


def furniture_removal(spark, d):
    kept = pages.without_furniture(page_blocks(spark, d), "source")
    return kept.select("source", "pdf_page", "block_order", "printed_page", "page_revision", F.md5("raw_text").alias("text_md5"))


def section_carry_forward(spark, d):
    """The last section seen so far, in page order, within a source."""
    marks = texts(spark, d).select("source", "doc_id", F.when(F.col("doc_id") % 16 == 0, F.col("section_id")).alias("section_marker"))
    return pages.carried(marks, "source", "doc_id", "section_marker").select("source", "doc_id", "section")


def provenance_version(spark, d):
    """The version with the latest date; a version line is planted in every document."""
    n = F.col("doc_id")
    planted = F.concat(F.coalesce("text", F.lit("")), F.lit("\n"), (n % 9).cast("string"), F.lit("."), (n % 4).cast("string"), F.lit(" issued 20"), F.lpad((n % 30 + 1).cast("string"), 2, "0"), F.lit("-05-17\n"))
    return pages.provenance(table(spark, d, "documents").select("source", "doc_id", planted.alias("text")), "source", "doc_id").select("source", "version")


def provenance_rollup(spark, d):
    """First and last place, and distinct languages in order, for each parent."""
    rows = texts(spark, d).withColumn("page_revision", F.col("lang"))
    return pages.provenance_rollup(rows.withColumnsRenamed({"doc_id": "pdf_page"}).withColumn("printed_page", F.concat(F.lit("s"), F.col("pdf_page"))), "parent_id", "pdf_page")


def bbox_union(spark, d):
    rows = table(spark, d, "embeddings").select("label", *[F.get("embedding", F.lit(i)).cast("double").alias(n) for i, n in enumerate(("x0", "top", "x1", "bottom"))])
    return rows.groupBy("label").agg(*pages.union_box())


def words_outside_boxes(spark, d):
    """Words whose centre is in no table box of their page (page: label)."""
    at = [F.get("embedding", F.lit(i)).cast("double") for i in range(4)]
    words = table(spark, d, "embeddings").select("vec_id", F.col("label").alias("pdf_page"), (at[0] * 100).alias("x0"), (at[0] * 100 + 5).alias("x1"), (at[1] * 100).alias("top"), (at[1] * 100 + 3).alias("bottom"))
    boxes = table(spark, d, "embeddings").select(F.col("label").alias("pdf_page"), (at[2] * 100).alias("x0"), (at[2] * 100 + 2).alias("x1"), (at[3] * 100).alias("top"), (at[3] * 100 + 2).alias("bottom"))
    return pages.words_outside(words, boxes, "pdf_page").select("vec_id", "pdf_page")


def cross_refs(spark, d):
    refs = T.cross_references(F.col("text"), F.col("clause_path"))
    return texts(spark, d).select("chunk_id", F.array_join(refs, "|").alias("refs"))


def stable_ids(spark, d):
    rows = texts(spark, d).withColumn("sha", F.sha2("text", 256))
    made = [T.stable_id(F.col("sha"), F.lit(role), F.col("clause_path"), F.lit("provision"), F.col("child_order")).alias(f"{role}_id") for role in ("child", "parent")]
    return rows.select("chunk_id", *made)


def embedding_texts(spark, d):
    return texts(spark, d).select("chunk_id", F.md5(T.embedding_text(F.lit(""), F.when(F.col("doc_id") % 3 > 0, F.col("clause_path")), F.col("text"))).alias("text_md5"))


def content_types(spark, d):
    return texts(spark, d).select("chunk_id", pages.content_type(F.when(F.col("doc_id") % 5 == 0, F.col("defined_term")), F.col("section_id"), F.col("text")).alias("content_type"), T.slug(F.col("clause_path")).alias("slug"))


def tag_neutralise(spark, d):
    t = F.concat(F.lit("</ Documents> <document id=1> <docu "), F.col("text"))
    return texts(spark, d).select("chunk_id", T.neutralise(t).alias("text"), T.escape_attribute(F.concat(F.col("filename"), F.lit("\n<&\">"))).alias("attribute"))


SQL = {
    "clean_text_ascii": f"WITH {SQL_NOISY} SELECT doc_id, CASE WHEN regexp_matches(text, '\\S') THEN {SQL_CLEAN} ELSE '' END AS text FROM noisy",
    "clean_text_full": f"WITH {SQL_NOISY} SELECT doc_id, CASE WHEN regexp_matches(text, '\\S') THEN {SQL_CLEAN} ELSE '' END AS text FROM noisy",
    "unify_newlines": f"WITH {SQL_NOISY} SELECT doc_id, {SQL_UNIFIED} AS text FROM noisy",
    "dehyphenate": f"WITH {SQL_NOISY} SELECT doc_id, {SQL_JOINED} AS text FROM noisy",
    "strip_invisible": f"WITH {SQL_NOISY} SELECT doc_id, regexp_replace(regexp_replace(text, '{CONTROL}', '', 'g'), '{INVISIBLE}', '', 'g') AS text FROM noisy",
    "clean_lines": f"WITH {SQL_NOISY} SELECT doc_id, {sql_lines('text')} AS text FROM noisy",
    "cap_blank_lines": rf"WITH {SQL_NOISY} SELECT doc_id, regexp_replace(text, '\n{{3,}}', chr(10) || chr(10), 'g') AS text FROM noisy",
    "nfkc_identity": "SELECT doc_id, nfc_normalize(text) AS text FROM documents",
    "line_explode": f"""WITH {SQL_NOISY}, split AS (SELECT doc_id, string_split({SQL_UNIFIED}, chr(10)) AS l FROM noisy),
      lines AS (SELECT doc_id, generate_subscripts(l, 1) AS place, unnest(l) AS line FROM split)
      SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY place) - 1 AS sequence, length(line) - length(ltrim(line, ' ')) AS indent, line FROM lines WHERE regexp_matches(line, '\\S')""",
    "table_segments": r"""WITH t AS (SELECT doc_id, regexp_replace(text, '\n([^\n]*)\n([^\n]*)\n', E'\n\\1\n\\2\n| a | b |\n| --- | --- |\n| 1 | 2 |\n', 'g') AS text FROM documents WHERE text IS NOT NULL),
      split AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM t),
      lines AS (SELECT doc_id, generate_subscripts(l, 1) - 1 AS place, unnest(l) AS line FROM split),
      flags AS (SELECT *, regexp_matches(line, '^\s*\|.*\|\s*$') AS is_row, lead(regexp_matches(line, '^\s*\|[\s:|-]*-[\s:|-]*\|\s*$')) OVER (PARTITION BY doc_id ORDER BY place) AS next_sep FROM lines),
      runs AS (SELECT *, place - row_number() OVER (PARTITION BY doc_id, is_row ORDER BY place) AS island FROM flags),
      first AS (SELECT *, min(CASE WHEN is_row AND coalesce(next_sep, false) THEN place END) OVER (PARTITION BY doc_id, is_row, island) AS starts FROM runs),
      kinds AS (SELECT doc_id, place, CASE WHEN is_row AND place >= starts THEN 'table' ELSE 'prose' END AS kind, CASE WHEN is_row AND place >= starts THEN starts END AS starts FROM first),
      marks AS (SELECT *, CASE WHEN lag(kind || coalesce(starts, -1)) OVER (PARTITION BY doc_id ORDER BY place) = kind || coalesce(starts, -1) THEN 0 ELSE 1 END AS new FROM kinds),
      segs AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY place) AS segment FROM marks)
      SELECT doc_id, (segment - 1)::BIGINT AS segment, kind, min(place)::BIGINT AS first_line, max(place)::BIGINT AS last_line FROM segs GROUP BY doc_id, segment, kind""",
    "legal_score": rf"""WITH {SQL_CHUNKS} SELECT chunk_id,
      (CASE WHEN contains(lower(text), 'currency and exchanges manual for authorised dealers') THEN 3 ELSE 0 END
      + CASE WHEN len(regexp_extract_all(text, '(?m)^\s*[A-K]\.\d+\s+')) >= 2 THEN 2 ELSE 0 END + CASE WHEN len(regexp_extract_all(text, '(?m)^\s*\([A-Z]\)\s+')) >= 2 THEN 1 ELSE 0 END
      + CASE WHEN len(regexp_extract_all(text, '(?m)^\s*\((?:[ivxlcdm]+|[a-z]+|\d+)\)\s+')) >= 3 THEN 2 ELSE 0 END
      + CASE WHEN contains(lower(text), 'table of contents') OR contains(lower(text), 'authorised dealer') THEN 1 ELSE 0 END) AS parser_score,
      (CASE WHEN contains(lower(text), 'authorised dealer') OR contains(lower(text), 'currency and exchanges manual') THEN 3 ELSE 0 END
      + CASE WHEN len(regexp_extract_all(text, '(?m)^\s*[A-K]\.\d+\s+')) >= 2 THEN 2 ELSE 0 END + CASE WHEN len(regexp_extract_all(text, '(?m)^\s*\([A-Z]\)\s+')) >= 2 THEN 1 ELSE 0 END
      + CASE WHEN len(regexp_extract_all(text, '(?m)^\s*\([ivxlcdm]+\)\s+')) >= 2 THEN 2 ELSE 0 END) AS chunker_score FROM chunks""",
    "furniture_frequency": """WITH pages AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
      heads AS (SELECT source, 'manual of ' || source AS furniture_key, count(*) AS n_blocks FROM documents GROUP BY source),
      feet AS (SELECT source, '<page> <revision>' AS furniture_key, count(*) AS n_blocks FROM documents GROUP BY source)
      SELECT x.source, furniture_key, n_blocks, n_blocks >= greatest(2, ceil(0.35 * n)) AS is_furniture FROM (SELECT * FROM heads UNION ALL SELECT * FROM feet) x JOIN pages p ON p.source = x.source""",
    "furniture_removal": """SELECT source, doc_id AS pdf_page, 0 AS block_order, (doc_id % 300)::VARCHAR AS printed_page, (doc_id % 12 + 1) || '/2026' AS page_revision, md5(coalesce(text, '')) AS text_md5 FROM documents""",
    "section_carry_forward": f"""WITH {SQL_CHUNKS} SELECT source, doc_id, last_value(CASE WHEN doc_id % 16 = 0 THEN section_id END IGNORE NULLS) OVER (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS section FROM chunks""",
    "provenance_version": r"""WITH t AS (SELECT source, doc_id, coalesce(text, '') || chr(10) || (doc_id % 9) || '.' || (doc_id % 4) || ' issued 20' || lpad((doc_id % 30 + 1)::VARCHAR, 2, '0') || '-05-17' || chr(10) AS text FROM documents),
      hits AS (SELECT source, unnest(regexp_extract_all(text, '\b\d+\.\d+\b[^\n]{0,60}?\b(?:19|20)\d{2}-\d{2}-\d{2}\b')) AS hit FROM t),
      parts AS (SELECT source, regexp_extract(hit, '^(\d+\.\d+)', 1) AS number, regexp_extract(hit, '(\d{4}-\d{2}-\d{2})$', 1) AS issued FROM hits)
      SELECT source, number || ' (' || issued || ')' AS version FROM parts QUALIFY row_number() OVER (PARTITION BY source ORDER BY issued DESC, number DESC) = 1""",
    "provenance_rollup": f"""WITH {SQL_CHUNKS}, firsts AS (SELECT parent_id, lang, min(doc_id) AS place FROM chunks GROUP BY ALL),
      langs AS (SELECT parent_id, string_agg(lang, '|' ORDER BY place) AS page_revisions FROM firsts GROUP BY parent_id)
      SELECT c.parent_id, min(doc_id) AS pdf_page_start, max(doc_id) AS pdf_page_end, 's' || min(doc_id) AS printed_page_start, 's' || max(doc_id) AS printed_page_end, any_value(page_revisions) AS page_revisions
      FROM chunks c JOIN langs l ON l.parent_id = c.parent_id GROUP BY c.parent_id""",
    "bbox_union": "SELECT label, min(embedding[1])::DOUBLE AS x0, min(embedding[2])::DOUBLE AS top, max(embedding[3])::DOUBLE AS x1, max(embedding[4])::DOUBLE AS bottom FROM embeddings GROUP BY label",
    "words_outside_boxes": """WITH w AS (SELECT vec_id, label AS pdf_page, embedding[1]::DOUBLE * 100 AS x0, embedding[2]::DOUBLE * 100 AS top, embedding[3]::DOUBLE * 100 AS bx, embedding[4]::DOUBLE * 100 AS bt FROM embeddings)
      SELECT vec_id, pdf_page FROM w WHERE NOT EXISTS (SELECT 1 FROM w b WHERE b.pdf_page = w.pdf_page AND (w.x0 + w.x0 + 5) / 2 BETWEEN b.bx AND b.bx + 2 AND (w.top + w.top + 3) / 2 BETWEEN b.bt AND b.bt + 2)""",
    "cross_refs": rf"""WITH {SQL_CHUNKS}, found AS (SELECT chunk_id, clause_path, regexp_extract_all(text, '\b([A-K](?:(?:\.\d+)+|\.)(?:\([A-Za-z0-9]+\))*)(?:[^A-Za-z0-9]|$)', 1) AS r FROM chunks),
      each AS (SELECT chunk_id, clause_path, generate_subscripts(r, 1) AS place, rtrim(unnest(r), '.') AS ref FROM found),
      firsts AS (SELECT chunk_id, ref, min(place) AS place FROM each WHERE ref <> clause_path GROUP BY ALL)
      SELECT c.chunk_id, coalesce(string_agg(f.ref, '|' ORDER BY place), '') AS refs FROM chunks c LEFT JOIN firsts f ON f.chunk_id = c.chunk_id GROUP BY c.chunk_id""",
    "stable_ids": f"""WITH {SQL_CHUNKS} SELECT chunk_id, 'c_' || substr(sha256(sha256(text) || '|child|' || lower(clause_path) || '|provision|' || child_order), 1, 24) AS child_id,
      'p_' || substr(sha256(sha256(text) || '|parent|' || lower(clause_path) || '|provision|' || child_order), 1, 24) AS parent_id FROM chunks""",
    "embedding_texts": f"WITH {SQL_CHUNKS} SELECT chunk_id, md5(CASE WHEN doc_id % 3 > 0 THEN 'Legal location: ' || clause_path || chr(10) || 'Source text:' || chr(10) || text ELSE text END) AS text_md5 FROM chunks",
    "content_types": rf"""WITH {SQL_CHUNKS} SELECT chunk_id, CASE WHEN (doc_id % 5 = 0 AND defined_term IS NOT NULL) OR section_id = 'A.1' THEN 'definition' WHEN regexp_matches(text, '(?i)^\s*(schedule|annexure|appendix)\b') THEN 'schedule'
      WHEN regexp_matches(text, '(?i)^\s*(form|specimen)\b') THEN 'form' ELSE 'provision' END AS content_type, trim(regexp_replace(lower(clause_path), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM chunks""",
    "tag_neutralise": rf"""WITH {SQL_CHUNKS} SELECT chunk_id, regexp_replace('</ Documents> <document id=1> <docu ' || text, '(?i)<(\s*/?\s*documents?\b)', '&lt;\1', 'g') AS text, filename || ' &lt;&amp;&quot;&gt;' AS attribute FROM chunks""",
}
QUERIES = {f.__name__: f for f in (clean_text_ascii, clean_text_full, unify_newlines, dehyphenate, strip_invisible, clean_lines, cap_blank_lines, nfkc_identity, line_explode, table_segments, legal_score, furniture_frequency, furniture_removal, section_carry_forward, provenance_version, provenance_rollup, bbox_union, words_outside_boxes, cross_refs, stable_ids, embedding_texts, content_types, tag_neutralise)}
