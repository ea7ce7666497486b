"""Page analysis as aggregations and windows: furniture, provenance, detection, lines, tables, navigation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioquery.functions.text import collapse

# Bands, thresholds and patterns that results depend on.
TITLE = "Currency and Exchanges Manual for Authorised Dealers"
BAND, PAGE_HEIGHT, SHARE = 72.0, 842.0, 0.35
PRINTED_PAGE = r"(?i)\b([A-Za-z]*\d+|[ivxlcdm]+)\s+of\s+\d+\b"
REVISION = r"\b\d{1,3}/(?:19|20)\d{2}\b"
SECTION = r"\b([A-K](?:\.\d+(?:\.\d+)*)?\.?)\b"
SECTION_ONLY = r"^\s*[A-K](?:\.\d+)*\.?\s*$"
VERSION = r"\b(\d+\.\d+)\b[^\n]{0,60}?\b((?:19|20)\d{2}-\d{2}-\d{2})\b"
DATE = r"\b(?:19|20)\d{2}-\d{2}-\d{2}\b"
TABLE_ROW, TABLE_RULE = r"^\s*\|.*\|\s*$", r"^\s*\|[\s:|-]*-[\s:|-]*\|\s*$"
TOC_ENTRY = r"^\s*([A-K](?:\.\d+(?:\.\d+)*)?\.?)\s+(.+?)\.{2,}\s*(\d+)\s*$"
NAV_MARKER = r"^\s*(\([A-Z]\)|\([ivxlcdm]+\))\s+(.+\S)\s*$"


def furniture_key(text: Column) -> Column:
    """Lower case, single blanks, revisions and printed pages as placeholders. (Sections are not folded: the key is in lower case by then.)"""
    return F.regexp_replace(F.regexp_replace(collapse(F.lower(text)), REVISION, "<revision>"), PRINTED_PAGE, "<page>")


def top_band() -> Column:
    return F.coalesce(F.col("bottom") <= BAND, F.lit(False))


def bottom_band() -> Column:
    return F.coalesce(F.col("top") >= F.coalesce("height", F.lit(PAGE_HEIGHT)) - BAND, F.lit(False))


def furniture_keys(blocks: DataFrame, document: str) -> DataFrame:
    """(document, furniture_key, n_blocks, is_furniture) of blocks in the bands: document, pdf_page, raw_text, top, bottom, height."""
    pages = blocks.groupBy(document).agg(F.countDistinct("pdf_page").alias("n_pages"))
    keys = blocks.where(top_band() | bottom_band()).select(document, furniture_key(F.col("raw_text")).alias("furniture_key")).where("furniture_key <> ''")
    counted = keys.groupBy(document, "furniture_key").agg(F.count("*").alias("n_blocks")).join(pages, document)
    return counted.withColumn("is_furniture", F.col("n_blocks") >= F.greatest(F.lit(2), F.ceil(F.lit(SHARE) * F.col("n_pages"))))


def canonical_section(text: Column) -> Column:
    bare = F.regexp_replace(F.trim(text), r"\.+$", "")
    return F.when(bare.rlike("^[A-K]$"), F.concat(bare, F.lit("."))).otherwise(bare)


def without_furniture(blocks: DataFrame, document: str) -> DataFrame:
    """Blocks that stay, numbered anew, with printed_page, page_revision and section_marker of their page."""
    text = collapse(F.col("raw_text"))
    page_hit = F.when(bottom_band(), F.nullif(F.regexp_extract(text, PRINTED_PAGE, 1), F.lit("")))
    revision = F.when(bottom_band(), F.nullif(F.regexp_extract(text, REVISION, 0), F.lit("")))
    marks = F.regexp_extract_all(text, F.lit(SECTION), F.lit(1))
    section = F.when(top_band() & (F.size(marks) > 0), canonical_section(F.element_at(F.when(F.size(marks) > 0, marks), -1)))
    rows = blocks.withColumns({"hit_page": page_hit, "hit_revision": revision, "hit_section": section, "furniture_key": furniture_key(F.col("raw_text"))})
    repeated = furniture_keys(blocks, document).where("is_furniture").select(document, "furniture_key", "is_furniture")
    rows = rows.join(repeated, [document, "furniture_key"], "left")
    on_page = Window.partitionBy(document, "pdf_page").orderBy("block_order").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    for name, hit in (("printed_page", "hit_page"), ("page_revision", "hit_revision"), ("section_marker", "hit_section")):
        rows = rows.withColumn(name, F.last(hit, ignorenulls=True).over(on_page))
    title = top_band() & F.contains(F.lower(text), F.lit(TITLE.lower()))
    goes = title | F.col("hit_page").isNotNull() | (F.coalesce("is_furniture", F.lit(False)) & (top_band() | bottom_band()))
    kept = rows.where(~goes | text.rlike(SECTION_ONLY))
    order = F.row_number().over(Window.partitionBy(document, "pdf_page").orderBy("block_order")) - 1
    return kept.withColumn("block_order", order).drop("hit_page", "hit_revision", "hit_section", "furniture_key", "is_furniture")


def carried(rows: DataFrame, document: str, order: str, mark: str) -> DataFrame:
    """section: the last mark up to and including each row."""
    so_far = Window.partitionBy(document).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("section", F.last(mark, ignorenulls=True).over(so_far))


def provenance(texts: DataFrame, document: str, order: str) -> DataFrame:
    """document, title, version: the version row of the latest date (numbers compare as text), else the latest early date."""
    pairs = F.arrays_zip(F.regexp_extract_all("text", F.lit(VERSION), F.lit(2)).alias("issued"), F.regexp_extract_all("text", F.lit(VERSION), F.lit(1)).alias("number"))
    best = F.array_max(F.transform(pairs, lambda p: F.struct(p["issued"].alias("issued"), p["number"].alias("number"))))
    dates = F.array_max(F.regexp_extract_all(F.substring("text", 1, 5000), F.lit(DATE), F.lit(0)))
    rows = texts.select(document, order, best.alias("best"), dates.alias("early"), F.contains(F.lower("text"), F.lit(TITLE.lower())).alias("titled"))
    out = rows.groupBy(document).agg(F.max("best").alias("best"), F.max("early").alias("early"), F.max("titled").alias("titled"))
    version = F.when(F.col("best").isNotNull(), F.concat(F.col("best.number"), F.lit(" ("), F.col("best.issued"), F.lit(")"))).otherwise(F.col("early"))
    return out.select(document, F.when(F.col("titled"), TITLE).alias("title"), version.alias("version"))


def provenance_rollup(rows: DataFrame, key: str, order: str) -> DataFrame:
    """First and last page, printed page by order, and distinct revisions in order, for each key."""
    seen = F.array_sort(F.collect_list(F.struct(F.col(order).alias("at"), F.col("page_revision").alias("value"))))
    out = rows.groupBy(key).agg(F.min("pdf_page").alias("pdf_page_start"), F.max("pdf_page").alias("pdf_page_end"), F.min_by("printed_page", order).alias("printed_page_start"), F.max_by("printed_page", order).alias("printed_page_end"), seen.alias("seen"))
    values = F.array_distinct(F.filter(F.transform("seen", lambda x: x["value"]), lambda v: v.isNotNull()))
    return out.withColumn("page_revisions", F.array_join(values, "|")).drop("seen")


def union_box() -> list[Column]:
    return [F.min("x0").alias("x0"), F.min("top").alias("top"), F.max("x1").alias("x1"), F.max("bottom").alias("bottom")]


def words_outside(words: DataFrame, boxes: DataFrame, page: str) -> DataFrame:
    """Words whose centre lies in no box of their page; borders count as inside."""
    w, b = words.alias("w"), boxes.alias("b")
    x, y = (F.col("w.x0") + F.col("w.x1")) / 2, (F.col("w.top") + F.col("w.bottom")) / 2
    inside = (F.col(f"w.{page}") == F.col(f"b.{page}")) & x.between(F.col("b.x0"), F.col("b.x1")) & y.between(F.col("b.top"), F.col("b.bottom"))
    return w.join(b, inside, "left_anti")


def weights(*rules: tuple[Column, int]) -> Column:
    total = F.lit(0)
    for condition, points in rules:
        total = total + F.when(condition, points).otherwise(0)
    return total


def parser_legal_score(text: Column) -> Column:
    """4 or more: a legal manual. (Chunking has its own scorer with other weights.)"""
    low = F.lower(text)
    return weights(
        (F.contains(low, F.lit(TITLE.lower())), 3),
        (F.regexp_count(text, F.lit(r"(?m)^\s*[A-K]\.\d+\s+")) >= 2, 2),
        (F.regexp_count(text, F.lit(r"(?m)^\s*\([A-Z]\)\s+")) >= 2, 1),
        (F.regexp_count(text, F.lit(r"(?m)^\s*\((?:[ivxlcdm]+|[a-z]+|\d+)\)\s+")) >= 3, 2),
        (F.contains(low, F.lit("table of contents")) | F.contains(low, F.lit("authorised dealer")), 1),
    )


def chunker_legal_score(text: Column) -> Column:
    low = F.lower(text)
    return weights(
        (F.contains(low, F.lit("authorised dealer")) | F.contains(low, F.lit("currency and exchanges manual")), 3),
        (F.regexp_count(text, F.lit(r"(?m)^\s*[A-K]\.\d+\s+")) >= 2, 2),
        (F.regexp_count(text, F.lit(r"(?m)^\s*\([A-Z]\)\s+")) >= 2, 1),
        (F.regexp_count(text, F.lit(r"(?m)^\s*\([ivxlcdm]+\)\s+")) >= 2, 2),
    )


def content_type(defined_term: Column, section_id: Column, heading: Column) -> Column:
    named = F.coalesce(defined_term, F.lit("")) != ""
    return (
        F.when(named | F.coalesce(section_id == "A.1", F.lit(False)), "definition")
        .when(heading.rlike(r"(?i)^\s*(schedule|annexure|appendix)\b"), "schedule")
        .when(heading.rlike(r"(?i)^\s*(form|specimen)\b"), "form")
        .otherwise("provision")
    )


def line_scan(texts: DataFrame, document: str, *order: str) -> DataFrame:
    """Non-blank lines: sequence (over the document), indent (leading blanks), line."""
    rows = texts.select("*", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line")).where(F.col("line").rlike(r"\S"))
    number = F.row_number().over(Window.partitionBy(document).orderBy(*order, "line_no")) - 1
    indent = F.length("line") - F.length(F.ltrim("line"))
    return rows.withColumns({"sequence": number.cast("long"), "indent": indent.cast("long")})


def table_segments(texts: DataFrame, document: str) -> DataFrame:
    """Segments (segment, kind, first_line, last_line): a table starts at a row that a rule follows, and ends with its rows."""
    lines = texts.select(document, F.posexplode(F.split("text", "\n", -1)).alias("at", "line"))
    order = Window.partitionBy(document).orderBy("at")
    flags = lines.select(document, "at", F.col("line").rlike(TABLE_ROW).alias("is_row"), F.coalesce(F.lead(F.col("line").rlike(TABLE_RULE)).over(order), F.lit(False)).alias("ruled"))
    island = F.col("at") - F.row_number().over(Window.partitionBy(document, "is_row").orderBy("at"))
    runs = flags.withColumn("island", island)
    starts = F.min(F.when(F.col("is_row") & F.col("ruled"), F.col("at"))).over(Window.partitionBy(document, "is_row", "island"))
    inside = F.col("is_row") & F.coalesce(F.col("at") >= F.col("starts"), F.lit(False))
    kinds = runs.withColumn("starts", starts).select(document, "at", F.when(inside, "table").otherwise("prose").alias("kind"), F.when(inside, F.col("starts")).otherwise(-1).alias("starts"))
    same = F.struct("kind", "starts")
    marks = kinds.withColumn("new", F.when(F.lag(same).over(order) == same, 0).otherwise(1))
    numbered = marks.withColumn("segment", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - 1)
    return numbered.groupBy(document, "segment", "kind").agg(F.min("at").cast("long").alias("first_line"), F.max("at").cast("long").alias("last_line"))


def navigation(lines: DataFrame, document: str) -> DataFrame:
    """Entries of navigation pages, from lines (document, order, pdf_page, section_marker, line) in order.

    A dotted line opens a section; a letter holds until the next dotted line, and markers hang below both.
    """
    so_far = Window.partitionBy(document).orderBy("order").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    toc = F.col("line").rlike(TOC_ENTRY)
    opened = F.when(toc, canonical_section(F.regexp_extract("line", TOC_ENTRY, 1)))
    first = F.row_number().over(Window.partitionBy(document, "pdf_page").orderBy("order")) == 1
    rows = lines.withColumns({"toc": toc, "opened": F.coalesce(opened, F.when(first & F.col("section_marker").isNotNull(), canonical_section(F.col("section_marker"))))})
    rows = rows.withColumn("section_id", F.last("opened", ignorenulls=True).over(so_far)).withColumn("block", F.sum(F.col("toc").cast("int")).over(so_far))
    marker = F.nullif(F.regexp_extract("line", NAV_MARKER, 1), F.lit(""))
    rows = rows.withColumn("marker", F.when(~F.col("toc"), marker))
    letter = F.when(F.col("marker").rlike(r"^\([A-Z]\)$"), F.col("marker"))
    in_block = Window.partitionBy(document, "block").orderBy("order").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("letter", F.last(letter, ignorenulls=True).over(in_block)).where(F.col("toc") | (F.col("marker").isNotNull() & F.col("section_id").isNotNull()))
    raw = F.when(F.col("toc"), F.regexp_extract("line", TOC_ENTRY, 2)).otherwise(F.regexp_extract("line", NAV_MARKER, 2))
    target = F.when(F.col("toc"), F.regexp_extract("line", TOC_ENTRY, 3)).otherwise(F.nullif(F.regexp_extract(F.trim(raw), r"\.{2,}\s*(\d+)\s*$", 1), F.lit("")))
    title = F.trim(F.regexp_replace(raw, r"\.{2,}\s*\d+\s*$", ""))
    upper = F.col("marker").rlike(r"^\([A-Z]\)$")
    path = F.when(F.col("toc"), None).when(upper, F.concat("section_id", "marker")).otherwise(F.concat("section_id", F.coalesce("letter", F.lit("")), "marker"))
    return rows.select(document, "order", "pdf_page", "section_id", path.alias("clause_path"), title.alias("title"), target.alias("printed_page"))
