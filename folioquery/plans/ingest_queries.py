"""Registered queries of ingestion: pages to blocks, facts, navigation entries, stitched tables, embedding."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioquery.operators import chunking, pages, parsing
from folioquery.operators.embed import embedded
from folioquery.plans import corpus
from folioquery.plans.corpus import table
from folioquery.sources import documents

VERSIONS = "Version number  Issue date\n1.10 issued 2099-05-17\n1.2 issued 2098-04-01\n"
CONTENTS = "Table of contents\nA.1 Rules .......... 5\n(A) Scope ..... 6\n"


def manual_pages(spark, d) -> DataFrame:
    """Every source as a manual and every document as a page: a running title, the text, and a footer.

    A version sheet is planted on the first page and contents on the second; contents run on to page 12.
    """
    number = F.row_number().over(Window.partitionBy("source").orderBy("doc_id"))
    rows = table(spark, d, "documents").select("source", "text", number.alias("pdf_page"))
    body = F.concat(F.when(F.col("pdf_page") == 1, VERSIONS).when(F.col("pdf_page") == 2, CONTENTS).otherwise(""), F.coalesce("text", F.lit("")))
    title = F.concat(corpus.section_of(F.col("pdf_page").cast("long")), F.lit(f"  {pages.TITLE}"))
    foot = F.concat(F.col("pdf_page").cast("string"), F.lit(" of 298 "), (F.col("pdf_page") % 12 + 1).cast("string"), F.lit("/2026"))

    def block(text, top: float, bottom: float):
        box = F.array(*[F.lit(float(x)) for x in (40, top, 550, bottom)])
        return F.struct(F.lit("prose").alias("block_type"), text.alias("text"), F.lit(None).cast("string").alias("raw_text"), box.alias("bbox"), F.lit(None).cast("array<string>").alias("table_header"), F.lit(None).cast("array<array<string>>").alias("table_rows"))

    given = {"pdf_page": F.col("pdf_page"), "height": F.lit(842.0), "blocks": F.array(block(title, 44, 55), block(body, 90, 700), block(foot, 790, 802))}
    page = [given.get(f.split(" ")[0], F.lit(None)).cast(f.split(" ", 1)[1]).alias(f.split(" ")[0]) for f in documents.split_fields(documents.PAGE)]
    return rows.select(F.col("source").alias("document_id"), F.concat("source", F.lit(".pdf")).alias("filename"), F.sha2("source", 256).alias("source_sha256"), F.lit("layout").alias("extraction_method"), *page)


SQL_PAGES = f"""paged AS (SELECT source AS document_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS pdf_page, coalesce(text, '') AS text FROM documents),
pages AS (SELECT document_id, pdf_page, CASE pdf_page WHEN 1 THEN '{VERSIONS}' WHEN 2 THEN '{CONTENTS}' ELSE '' END || text AS body,
  CASE WHEN pdf_page = 1 THEN 'front_matter' WHEN pdf_page <= 12 THEN 'navigation' ELSE 'body' END AS content_type FROM paged)"""


def ingest_pages(spark, d):
    """Blocks that stay, with what the margins and the order of the pages say of them."""
    kept = parsing.parsed_blocks(manual_pages(spark, d))
    return kept.select("document_id", "pdf_page", "block_order", "printed_page", "page_revision", "section_marker", "content_type", F.md5("raw_text").alias("text_md5"))


def ingest_facts(spark, d):
    found = manual_pages(spark, d)
    return parsing.document_facts(found, parsing.parsed_blocks(found)).select("document_id", "title", "version", "is_legal")


def navigation_entries(spark, d):
    entries = parsing.navigation_entries(parsing.parsed_blocks(manual_pages(spark, d)))
    return entries.select("document_id", "pdf_page", "section_id", "clause_path", "title", "printed_page")


def table_stitch(spark, d):
    """Tables of neighbouring pages with one header become one; blank keys of branches are filled from above."""
    n = F.col("p_partkey")
    branches = F.floor(n / 3) % 2 == 0
    header = F.when(branches, F.array(F.lit("Branch"), F.lit(" Dealer"))).otherwise(F.array(F.lit("Name"), F.lit("Size")))
    first = F.array(F.when(n % 2 == 0, F.concat(F.lit("K"), n)).otherwise(""), F.concat(F.lit("V"), n))
    given = {
        "document_id": F.concat(F.lit("m"), F.floor(n / 10)), "filename": F.lit("m.pdf"), "source_sha256": F.sha2(F.floor(n / 10).cast("string"), 256), "is_legal": F.lit(True), "pdf_page": n % 10 + 1, "content_type": F.lit("body"),
        "block_order": F.lit(0), "block_type": F.lit("table"), "raw_text": F.lit("raw"), "table_header": header, "table_rows": F.array(first, F.array(F.lit(""), F.concat(F.lit("W"), n))),
    }
    rows = table(spark, d, "part").select(*[given.get(c.split(" ")[0], F.lit(None)).cast(c.split(" ", 1)[1]).alias(c.split(" ")[0]) for c in chunking.BLOCK_COLUMNS.split(", ")])
    records = chunking.chunk_documents(rows).where("record_type = 'parent' AND content_type = 'table'")
    return records.select("document_id", "parent_order", "pdf_page_start", "pdf_page_end", "source_text")


class Arithmetic:
    """Vectors that SQL can make too: one, and the length of the text by two moduli."""

    name, model, dimension = "arithmetic", "length-1", 3

    def embed(self, texts: list[str]) -> list[list[float]]:
        return [[1.0, float(len(t) % 3), float(len(t) % 7)] for t in texts]


def embed_documents(spark, d):
    rows = table(spark, d, "documents").select("doc_id", embedded(F.col("text"), Arithmetic).alias("v"))
    return rows.select("doc_id", *[F.get("v", F.lit(i)).alias(f"v{i}") for i in range(3)])


QUERIES = {f.__name__: f for f in (ingest_pages, ingest_facts, navigation_entries, table_stitch, embed_documents)}
SQL = {
    "ingest_pages": f"""WITH {SQL_PAGES} SELECT document_id, pdf_page, 0 AS block_order, pdf_page::VARCHAR AS printed_page, (pdf_page % 12 + 1) || '/2026' AS page_revision,
      {corpus.sql_section("pdf_page")} AS section_marker, content_type, md5(body) AS text_md5 FROM pages""",
    # The title, the patterns and the weights of the score.
    "ingest_facts": rf"""WITH {SQL_PAGES}, whole AS (SELECT document_id, string_agg(body, chr(10) ORDER BY pdf_page) AS text FROM pages GROUP BY document_id)
      SELECT document_id, '{pages.TITLE}' AS title, '1.10 (2099-05-17)' AS version,
      CASE WHEN contains(lower(text), lower('{pages.TITLE}')) THEN 3 ELSE 0 END + CASE WHEN len(regexp_extract_all(text, '(?m)^\s*[A-K]\.\d+\s+')) >= 2 THEN 2 ELSE 0 END
      + CASE WHEN len(regexp_extract_all(text, '(?m)^\s*\([A-Z]\)\s+')) >= 2 THEN 1 ELSE 0 END + CASE WHEN len(regexp_extract_all(text, '(?m)^\s*\((?:[ivxlcdm]+|[a-z]+|\d+)\)\s+')) >= 3 THEN 2 ELSE 0 END
      + CASE WHEN contains(lower(text), 'table of contents') OR contains(lower(text), 'authorised dealer') THEN 1 ELSE 0 END >= 4 AS is_legal FROM whole""",
    "navigation_entries": f"""WITH {SQL_PAGES} SELECT document_id, pdf_page, 'A.1' AS section_id, NULL::VARCHAR AS clause_path, 'Rules' AS title, '5' AS printed_page FROM pages WHERE pdf_page = 2
      UNION ALL SELECT document_id, pdf_page, 'A.1', 'A.1(A)', 'Scope', '6' FROM pages WHERE pdf_page = 2""",
    "table_stitch": """WITH p AS (SELECT p_partkey AS k, p_partkey // 10 AS doc, p_partkey % 10 + 1 AS page, (p_partkey // 3) % 2 AS kind FROM part),
      marked AS (SELECT *, CASE WHEN lag(kind) OVER w = kind AND lag(page) OVER w = page - 1 THEN 0 ELSE 1 END AS new FROM p WINDOW w AS (PARTITION BY doc ORDER BY page)),
      islands AS (SELECT *, sum(new) OVER (PARTITION BY doc ORDER BY page) - 1 AS island FROM marked),
      lines AS (SELECT doc, island, kind, page, 0 AS line, CASE WHEN k % 2 = 0 THEN 'K' || k END AS key, 'V' || k AS value FROM islands UNION ALL SELECT doc, island, kind, page, 1, NULL, 'W' || k FROM islands),
      filled AS (SELECT *, CASE WHEN kind = 0 THEN last_value(key IGNORE NULLS) OVER (PARTITION BY doc, island ORDER BY page, line ROWS UNBOUNDED PRECEDING) ELSE key END AS shown FROM lines)
      SELECT 'm' || doc AS document_id, island::INT AS parent_order, min(page)::INT AS pdf_page_start, max(page)::INT AS pdf_page_end,
        CASE WHEN any_value(kind) = 0 THEN '| Branch |  Dealer |' ELSE '| Name | Size |' END || chr(10) || '| --- | --- |' || chr(10) || string_agg('| ' || coalesce(shown, '') || ' | ' || value || ' |', chr(10) ORDER BY page, line) AS source_text
      FROM filled GROUP BY doc, island""",
    "embed_documents": "SELECT doc_id, 1.0::DOUBLE AS v0, (length(coalesce(text, '')) % 3)::DOUBLE AS v1, (length(coalesce(text, '')) % 7)::DOUBLE AS v2 FROM documents",
}
