"""From pages to cleaned blocks: furniture, page types, provenance, legal detection, navigation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioquery.functions.text import clean_cells, clean_text
from folioquery.operators import chunking, pages
from folioquery.sources import documents

PRESETS = ("printed_page", "page_revision", "section_marker")
KEY = "document_id"
#: Fixed value: the least score of a legal manual.
LEGAL_SCORE = 4


def text_by(rows: DataFrame, *key: str) -> DataFrame:
    """(key, text): the texts of the blocks in order, on lines of their own."""
    held = F.array_sort(F.collect_list(F.struct("pdf_page", "block_order", "raw_text")))
    return rows.groupBy(*key).agg(F.array_join(F.transform(held, lambda x: x["raw_text"]), "\n").alias("text"))


def parsed_blocks(found: DataFrame) -> DataFrame:
    """Blocks of pages (document_id, filename, source_sha256, extraction_method, PAGE) without furniture, and cleaned.

    With printed_page, page_revision and section_marker of their page (from its margins, or as given), content_type
    of the page (from the texts of the pages in order, or as given) and extraction_method. Text files have one page
    of body. raw_text and boxes stay as they are.
    """
    rows = documents.blocks(found)
    rows = rows.withColumnsRenamed({c: f"given_{c}" for c in (*PRESETS, "content_type")})
    kept = pages.without_furniture(rows, KEY).withColumns({c: F.coalesce(c, f"given_{c}") for c in PRESETS})
    types = documents.page_types(kept, KEY).withColumnsRenamed({KEY: "__id", "pdf_page": "__page"})
    kept = kept.join(types, (F.col(KEY) == F.col("__id")) & (F.col("pdf_page") == F.col("__page")), "left").drop("__id", "__page")
    by_text = F.when((F.col("extraction_method") != "utf-8") & (F.col("page_type") != "body"), F.col("page_type"))
    facts = {"content_type": F.coalesce(by_text, "given_content_type", F.lit("body")), "clean_text": clean_text(F.col("raw_text"))}
    facts |= {"table_header": F.get(clean_cells(F.array("table_header")), F.lit(0)), "table_rows": clean_cells(F.col("table_rows"))}
    return kept.withColumns(facts).drop("page_type", *[f"given_{c}" for c in (*PRESETS, "content_type")])


def document_facts(found: DataFrame, kept: DataFrame) -> DataFrame:
    """document_id, title, version, is_legal: provenance from all blocks of laid-out pages, the rest from those kept."""
    laid_out = documents.blocks(found.where("extraction_method <> 'utf-8'"))
    source = pages.provenance(text_by(laid_out, KEY).withColumn("at", F.lit(0)), KEY, "at").withColumnRenamed(KEY, "__id")
    legal = text_by(kept, KEY).select(KEY, (pages.parser_legal_score(F.col("text")) >= LEGAL_SCORE).alias("is_legal"))
    return legal.join(source, F.col(KEY) == F.col("__id"), "left").drop("__id")


def navigation_entries(kept: DataFrame) -> DataFrame:
    """Entries of the navigation pages of each document, in order."""
    lines = kept.where("content_type = 'navigation'").select(KEY, "pdf_page", "block_order", "section_marker", F.posexplode(F.split("raw_text", "\n", -1)).alias("line_no", "line"))
    order = F.col("pdf_page").cast("long") * 2**40 + F.col("block_order").cast("long") * 2**24 + F.col("line_no")
    return pages.navigation(lines.withColumn("order", order).where(F.col("line").rlike(r"\S")), KEY)


def chunking_blocks(kept: DataFrame, facts: DataFrame) -> DataFrame:
    """The columns that chunking reads."""
    rows = kept.join(facts.select(F.col(KEY).alias("__id"), "is_legal"), F.col(KEY) == F.col("__id"), "left")
    return rows.select(*[F.col(c.split(" ", 1)[0]).cast(c.split(" ", 1)[1]) for c in chunking.BLOCK_COLUMNS.split(", ")])
