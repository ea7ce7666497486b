"""Citations, prompt blocks, the context budget, prompts, markers and history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioquery.functions.text import escape_attribute, missing, neutralise

# Results depend on them.
CHARS_PER_TOKEN, RESERVED_TOKENS = 3, 1024
NO_CONTEXT = "(No relevant documents found)"
MARKERS = r"\[(\d+(?:\s*,\s*\d+)*)\]"
SYSTEM_PROMPT = "You answer from the given documents only, and cite each statement by its number in brackets. If they do not hold the answer, say so."
PRINTED = ["printed_page_start", "printed_page_end", "pdf_page_start", "pdf_page_end"]


def one_line(text: Column) -> Column:
    return F.translate(text, "\r\n", "  ")


def as_text(name: str) -> Column:
    return missing(F.col(name).cast("string"))


def revisions() -> Column:
    return F.array_distinct(F.filter(F.coalesce("page_revisions", F.array().cast("array<string>")), lambda v: v.isNotNull() & (v != "")))


def pages() -> Column:
    """p. 5, pp. 5–6, with the PDF pages where they differ from the printed ones; null without pages."""
    printed, printed_end, pdf, pdf_end = (as_text(c) for c in PRINTED)
    first, last = F.coalesce(printed, pdf), F.coalesce(printed_end, pdf_end)
    page = F.when(last.isNotNull() & (last != first), F.concat(F.lit("pp. "), first, F.lit("–"), last)).otherwise(F.concat(F.lit("p. "), first))
    pdf_text = F.when(pdf_end.isNotNull() & (pdf_end != pdf), F.concat(pdf, F.lit("–"), pdf_end)).otherwise(pdf)
    return F.when(printed.isNotNull() & pdf.isNotNull() & (printed != pdf), F.concat(page, F.lit(" (PDF "), pdf_text, F.lit(")"))).otherwise(page)


def location() -> Column:
    return missing(F.trim(F.coalesce(missing(F.col("clause_path")), missing(F.col("section_id")), F.lit(""))))


def file_name() -> Column:
    return F.coalesce(missing(F.col("filename")), F.lit("unknown"))


def with_revisions(label: Column) -> Column:
    return F.when(F.size(revisions()) > 0, F.concat(label, F.lit(" · rev. "), F.array_join(revisions(), "–"))).otherwise(label)


def citation_label() -> Column:
    """Location and pages, or the location, or file and chunk; then the revisions."""
    file = F.concat(one_line(file_name()), F.lit(", chunk "), F.coalesce(F.col("chunk_index").cast("string"), F.lit("?")))
    return with_revisions(F.when(location().isNotNull() & pages().isNotNull(), F.concat(location(), F.lit(", "), pages())).otherwise(F.coalesce(location(), file)))


def display_label() -> Column:
    """For display: a label that was supplied wins, and pages are shown without a location too."""
    made = F.coalesce(F.concat(location(), F.lit(", "), pages()), location(), pages(), one_line(file_name()))
    return F.coalesce(missing(F.trim("label")), with_revisions(made))


def quoted(name: str, value: Column) -> Column:
    return F.concat(F.lit(f'{name}="'), escape_attribute(F.coalesce(value, F.lit(""))), F.lit('"'))


def document_block() -> Column:
    """The block of a retrieved chunk; columns as in `citation_label`, with rank, text, breadcrumb, governing_context."""
    rank, chunk = F.col("rank").cast("string"), F.coalesce(F.col("chunk_index").cast("string"), F.lit("?"))
    structured = F.coalesce(missing(F.col("clause_path")), missing(F.col("section_id"))).isNotNull()
    basic = [quoted("index", rank), quoted("source", file_name()), quoted("chunk", chunk)]
    legal = [quoted("clause", F.col("clause_path")), quoted("printed_page", as_text("printed_page_start")), quoted("pdf_page", as_text("pdf_page_start")), quoted("revision", F.array_join("page_revisions", ", "))]
    head = F.concat(F.lit("<document "), F.when(structured, F.concat_ws(" ", *basic, *legal)).otherwise(F.concat_ws(" ", *basic)), F.lit(">"))
    source = neutralise(one_line(file_name()))
    named = F.when(structured, F.concat(F.lit("["), rank, F.lit("] ("), neutralise(citation_label()), F.lit("; source: "), source, F.lit(")")))
    named = named.otherwise(F.concat(F.lit("["), rank, F.lit("] (source: "), source, F.lit(", chunk "), chunk, F.lit(")")))
    crumb = F.concat(F.lit("Inherited breadcrumb: "), neutralise(missing(F.trim("breadcrumb"))))
    governing = F.concat(F.lit("Short governing context: "), neutralise(missing(F.trim("governing_context"))))
    return F.concat_ws("\n", head, named, crumb, governing, F.lit("Quoted source text:"), neutralise(F.coalesce("text", F.lit(""))), F.lit("</document>"))


def compact_block() -> Column:
    """The block of the second prompt layout: empty attributes are left out."""

    def optional(name: str, value: Column) -> Column:
        return F.when(missing(value).isNotNull(), quoted(name, value))

    parts = [
        quoted("id", F.col("rank").cast("string")), quoted("relation", F.coalesce(missing(F.col("relation")), F.lit("primary"))), quoted("source", file_name()),
        optional("clause", F.col("clause_path")), F.when(missing(F.col("clause_path")).isNull(), optional("section", F.col("section_id"))),
        optional("pages", pages()), optional("chunk", F.col("chunk_index").cast("string")),
    ]
    crumb = F.concat(F.lit("Breadcrumb: "), neutralise(missing(F.trim("breadcrumb"))))
    governing = F.concat(F.lit("Governing context: "), neutralise(missing(F.trim("governing_context"))))
    return F.concat_ws("\n", F.concat(F.lit("<document "), F.concat_ws(" ", *parts), F.lit(">")), crumb, governing, neutralise(F.coalesce("text", F.lit(""))), F.lit("</document>"))


def budget_chars(context_tokens: int, fixed: Column) -> Column:
    return F.greatest(F.lit(0), F.lit(context_tokens * CHARS_PER_TOKEN) - fixed - F.lit(RESERVED_TOKENS * CHARS_PER_TOKEN))


def within_budget(blocks: DataFrame, context_tokens: int, fixed: Column) -> DataFrame:
    """The longest prefix of (query_id, rank, block) whose characters fit; blocks are parted by a blank line.

    Costs are positive, so the running sum passes the budget once, and the rows before are the prefix.
    """
    by_rank = Window.partitionBy("query_id").orderBy("rank")
    cost = F.length("block") + F.when(F.row_number().over(by_rank) > 1, 2).otherwise(0)
    spent = F.sum("cost").over(by_rank.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return blocks.withColumn("cost", cost).withColumn("spent", spent).where(F.col("spent") <= budget_chars(context_tokens, fixed)).drop("cost")


def prompts(queries: DataFrame, blocks: DataFrame) -> DataFrame:
    """query_id, system_prompt, user_prompt, used (number of blocks) for every query."""
    joined = blocks.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "block"))), lambda x: x["block"]).alias("blocks"))
    rows = queries.select("query_id", "query").join(joined, "query_id", "left")
    body = F.coalesce(missing(F.array_join("blocks", "\n\n")), F.lit(NO_CONTEXT))
    user = F.concat(F.lit("<documents>\n"), body, F.lit("\n</documents>\n\nQuestion: "), F.col("query"))
    return rows.select("query_id", F.lit(SYSTEM_PROMPT).alias("system_prompt"), user.alias("user_prompt"), F.coalesce(F.size("blocks"), F.lit(0)).alias("used"))


def citations(contexts: DataFrame) -> DataFrame:
    """One row for each distinct citation of a query, first marker first, with all its markers."""
    where = F.coalesce(missing(F.col("clause_path")), missing(F.col("section_id"))).alias("place")
    keyed = contexts.withColumns({"place": where, "citation": citation_label()})
    keyed = keyed.withColumn("alone", F.when(F.col("place").isNull(), F.col("chunk_id")))
    group = keyed.groupBy("query_id", "document_id", "place", *PRINTED, "alone")
    return group.agg(F.array_sort(F.collect_list("rank")).alias("markers"), F.min_by("citation", "rank").alias("label"), F.min_by("chunk_id", "rank").alias("chunk_id"), F.min("rank").alias("first_marker")).drop("alone")


def cited_markers(answer: Column, highest: Column) -> Column:
    """Distinct markers from 1 to `highest` in brackets, in order of number."""
    groups = F.regexp_extract_all(F.coalesce(answer, F.lit("")), F.lit(MARKERS), F.lit(1))
    numbers = F.transform(F.flatten(F.transform(groups, lambda g: F.split(g, ","))), lambda x: F.try_to_number(F.trim(x), F.lit("999999999999999999")).cast("long"))
    return F.array_sort(F.array_distinct(F.filter(numbers, lambda x: x.isNotNull() & (x >= 1) & (x <= highest))))


def appended(history: Column, question: Column, answer: Column) -> Column:
    """History with a user turn and an assistant turn."""
    turns = F.array(F.struct(F.lit("user").alias("role"), question.alias("content")), F.struct(F.lit("assistant").alias("role"), answer.alias("content")))
    return F.concat(F.coalesce(history, F.array().cast("array<struct<role:string,content:string>>")), turns)


def last_question(history: Column) -> Column:
    asked = F.filter(history, lambda t: t["role"] == "user")
    return F.coalesce(F.get(asked, F.size(asked) - 1)["content"], F.lit(""))
