"""Sources: pages as JSON, text files, JSON lines, concatenated JSON, and what has been answered already."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioquery.operators import layout

PAGE = (
    "pdf_page int, width double, height double, printed_page string, page_revision string, section_marker string, content_type string, text string, "
    "blocks array<struct<block_type:string,text:string,raw_text:string,bbox:array<double>,table_header:array<string>,table_rows:array<array<string>>>>, "
    "words array<struct<text:string,x0:double,x1:double,top:double,bottom:double>>, tables array<struct<rows:array<array<string>>,bbox:array<double>>>"
)
BINARY = "path string, modificationTime timestamp, length bigint, content binary"
SUFFIXES = ("pdf", "txt", "json")


class DocumentParsingError(ValueError):
    """A document that cannot be decoded."""


class ModelError(RuntimeError):
    """A model service that does not answer."""


def valid_file_type(name: str) -> bool:
    """Whether a file of this name can be read; the suffix decides, in any case."""
    stem, dot, suffix = (name or "").rpartition(".")
    return bool(dot and stem and suffix.lower() in ("pdf", "txt"))


def decode_text(content: bytes) -> str:
    """Strict UTF-8."""
    try:
        return content.decode("utf-8")
    except UnicodeDecodeError as error:
        raise DocumentParsingError("the text is not UTF-8") from error


def files(spark: SparkSession, path: str) -> DataFrame:
    """filename, suffix, source_sha256, content of files."""
    rows = spark.read.format("binaryFile").load(path)
    name = F.element_at(F.split("path", "/"), -1)
    return rows.select(name.alias("filename"), F.lower(F.element_at(F.split(name, r"\."), -1)).alias("suffix"), F.sha2("content", 256).alias("source_sha256"), "length", "modificationTime", "content")


def fingerprints(spark: SparkSession, path: str) -> DataFrame:
    return files(spark, path).select("filename", "length", "modificationTime", "source_sha256")


def parsed(found: DataFrame, extract: Callable[[bytes], list[dict]] | None = None) -> DataFrame:
    """document_id, filename, source_sha256, extraction_method, error, pages (PAGE) of every file.

    A text file is one page. PDF files are read by `extract`: words and tables of each page; no PDF library is a part
    of the engine, and what lies beyond words and tables is done here. A JSON file holds an array of pages. A file that
    cannot be read has an error and no pages; the others are not concerned.
    """

    def pages_of(suffix: str, content: bytes) -> list[dict]:
        if suffix == "txt":
            return [{"text": decode_text(content)}]
        if suffix == "json":
            return json.loads(decode_text(content))
        if suffix != "pdf":
            raise DocumentParsingError(f"unsupported file type: {suffix}")
        if extract is None:
            raise DocumentParsingError("no reader of PDF files is plugged in")
        return extract(content)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for name, sha, suffix, content in zip(batch["filename"], batch["source_sha256"], batch["suffix"], batch["content"], strict=True):
                try:
                    pages = [{"pdf_page": n, **page} for n, page in enumerate(pages_of(suffix, bytes(content)), 1)]
                    rows.append((name, sha, "utf-8" if suffix == "txt" else "layout", None, json.dumps(pages)))
                except Exception as error:  # kept with the document
                    rows.append((name, sha, None, f"Document parsing failed: {error}"[:500], None))
            yield pd.DataFrame(rows, columns=["filename", "source_sha256", "extraction_method", "error", "pages"])

    rows = found.select("filename", "source_sha256", "suffix", "content").mapInPandas(run, "filename string, source_sha256 string, extraction_method string, error string, pages string")
    document_id = F.substring(F.sha2(F.concat_ws("|", "filename", "source_sha256"), 256), 1, 32).alias("document_id")
    return rows.select(document_id, "filename", "source_sha256", "extraction_method", "error", F.from_json("pages", f"array<struct<{', '.join(c.replace(' ', ':', 1) for c in split_fields(PAGE))}>>").alias("pages"))


def split_fields(schema: str) -> list[str]:
    """The fields of a schema; commas inside brackets part nothing."""
    return re.split(r", (?=\w+ )", schema)


def pages_of_documents(read: DataFrame) -> DataFrame:
    """document_id, filename, source_sha256, extraction_method and PAGE of all pages that were read."""
    rows = read.where("error IS NULL").select("document_id", "filename", "source_sha256", "extraction_method", F.explode("pages").alias("p"))
    return rows.select("document_id", "filename", "source_sha256", "extraction_method", "p.*")


def json_pages(spark: SparkSession, path: str, numbers: list[int] | None = None) -> DataFrame:
    """filename, page_sha and PAGE of files that hold an array of pages.

    numbers: a subset of pages, counted from 1; a number that no page has is an error.
    """
    if numbers is not None and any(n < 1 for n in numbers):
        raise ValueError("pages are counted from 1")
    rows = spark.read.schema(PAGE).json(path, multiLine=True).withColumn("filename", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1))
    order = F.row_number().over(Window.partitionBy("filename").orderBy(F.monotonically_increasing_id()))
    rows = rows.withColumn("pdf_page", F.coalesce("pdf_page", order))
    if numbers is not None:
        rows = rows.where(F.col("pdf_page").isin(numbers))
        missing = set(numbers) - {r[0] for r in rows.select("pdf_page").distinct().collect()}
        if missing:
            raise ValueError(f"no such pages: {sorted(missing)}")
    sha = F.sha2(F.concat_ws("|", "filename", F.to_json(F.struct("blocks", "words", "text"))), 256)
    return rows.withColumn("page_sha", sha)


def blocks(pages: DataFrame) -> DataFrame:
    """One row for each block in reading order, with height, top and bottom for the margin bands."""
    carried = [c for c in ("document_id", "source_sha256", "extraction_method") if c in pages.columns]
    found = "".join(f"{c} string, " for c in carried) + "filename string, pdf_page int, printed_page string, page_revision string, section_marker string, content_type string, height double, block_order int, block_type string, raw_text string, bbox array<double>, table_id string, table_header array<string>, table_rows array<array<string>>"
    names = [c.split(" ")[0] for c in found.split(", ")]

    def nested(x):
        if hasattr(x, "tolist"):
            x = x.tolist()
        if isinstance(x, list | tuple):
            return [nested(y) for y in x]
        return {k: nested(v) for k, v in x.items()} if isinstance(x, dict) else x

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for page in batch.to_dict("records"):
                page = {k: nested(v) for k, v in page.items()}
                kept = {k: page.get(k) for k in (*carried, "filename", "pdf_page", "printed_page", "page_revision", "section_marker", "content_type")}
                height = page.get("height")
                kept["height"] = 842.0 if height is None or height != height else height
                rows += [{**kept, "table_header": None, "table_rows": None, **b} for b in layout.page_blocks(page)]
            yield pd.DataFrame(rows, columns=names)

    out = pages.drop("page_sha").mapInPandas(run, found)
    return out.withColumns({"top": F.get("bbox", F.lit(1)), "bottom": F.get("bbox", F.lit(3))})


def page_types(rows: DataFrame, document: str) -> DataFrame:
    """(document, pdf_page, page_type): a fold over the pages of each document in order."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("pdf_page")
        return pd.DataFrame({document: part[document], "pdf_page": part["pdf_page"], "page_type": layout.content_types(list(zip(part["pdf_page"], part["page_text"], strict=True)))})

    texts = rows.groupBy(document, "pdf_page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block_order", "raw_text"))), lambda x: x["raw_text"]), "\n").alias("page_text"))
    return texts.groupBy(document).applyInPandas(run, f"{document} string, pdf_page int, page_type string")


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records of a file of JSON lines; blank lines are passed over."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    return lines.select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("r")).select("r.*")


def unanswered(questions: DataFrame, cache: DataFrame, key: str = "id") -> DataFrame:
    return questions.join(cache.select(key), key, "left_anti")


def concatenated_json(text: str) -> list[dict]:
    """The top-level objects of a text in order; an error names its place and what stands there."""
    out, at, decoder = [], 0, json.JSONDecoder()
    while (at := text.find("{", at)) >= 0:
        try:
            value, at = decoder.raw_decode(text, at)
        except json.JSONDecodeError as error:
            raise ValueError(f"no JSON at {at}: {text[at : at + 60]!r}") from error
        out.append(value)
    return out
