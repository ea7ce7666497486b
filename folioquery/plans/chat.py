"""The chat query for a batch of questions: retrieve, fit into the budget, answer, cite, evaluate."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioquery.config import DEFAULTS, Settings
from folioquery.operators import answer, evaluate, search

PLACES = {"chunk_index": "long", "breadcrumb": "string", "printed_page_start": "string", "printed_page_end": "string", "pdf_page_start": "int", "pdf_page_end": "int", "page_revisions": "array<string>"}


def extractive(prompt: str) -> str:
    """An offline stand-in for a model: the first line of the first quoted text, with its marker."""
    quoted = prompt.split("Quoted source text:\n", 1)
    if len(quoted) == 1:
        return "The documents do not hold the answer."
    return f"{quoted[1].splitlines()[0][:300]} [1]" if quoted[1].strip() else "The first document is empty [1]"


def contexts_and_prompts(chunks: DataFrame, parents: DataFrame, queries: DataFrame, settings: Settings = DEFAULTS, vectors: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Contexts that fit (with their rank and block), and a prompt for each query. History is not sent."""
    found = search.retrieve(chunks, parents, queries, settings, vectors=vectors)
    light = chunks.drop("embedding", "parent_text")
    full = light.withColumns({c: F.lit(None).cast(t) for c, t in PLACES.items() if c not in light.columns})
    rows = search.settled(found).join(full, "chunk_id").withColumn("block", answer.document_block())
    length = search.settled(queries.select("query_id", F.length("query").alias("asked")))
    fixed = F.col("asked") + F.lit(len(answer.SYSTEM_PROMPT) + len("<documents>\n\n</documents>\n\nQuestion: "))
    kept = answer.within_budget(rows.join(length, "query_id"), settings.context_tokens, fixed).drop("asked", "spent")
    return kept, answer.prompts(queries, kept.select("query_id", "rank", "block"))


def chat(chunks: DataFrame, parents: DataFrame, queries: DataFrame, model: Callable[[str], str] = extractive, embed: Callable[[list[str]], list[list[float]]] | None = None, settings: Settings = DEFAULTS) -> dict[str, DataFrame]:
    """answers, contexts, citations and evaluation of every query.

    model answers one prompt; embed (if given) embeds answers and texts for the evaluation, and its failures
    only leave answer_similarity empty.
    """
    kept, made = contexts_and_prompts(chunks, parents, queries, settings)

    def respond(prompts: pd.Series) -> pd.Series:
        return prompts.map(model)

    answers = made.withColumn("answer", F.pandas_udf(respond, "string")(F.col("user_prompt"))).persist()
    markers = answers.select("query_id", answer.cited_markers(F.col("answer"), F.col("used")).alias("markers"), "answer")

    def vectors(texts: pd.Series) -> pd.Series:
        try:
            return pd.Series(list(embed(texts.tolist())))
        except Exception:  # evaluation never fails the answer
            return pd.Series([None] * len(texts))

    if embed is None:
        answer_vector = vector = F.lit(None).cast("array<double>")
    else:
        udf = F.pandas_udf(vectors, "array<double>")
        answer_vector, vector = udf(F.col("answer")), udf(F.col("text"))
    rated = evaluate.items(kept.withColumn("vector", vector), markers.select("query_id", "markers", answer_vector.alias("answer_vector")))
    return {"answers": answers, "contexts": kept, "citations": answer.citations(kept), "evaluation": rated}
