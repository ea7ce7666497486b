"""Evaluation of answers: per chunk, per response, per type of question."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioquery.functions.vectors import cosine

#: Words that decide the type of a question, tried in this order by substring.
QUESTION_WORDS = {
    "summary": ["summarise", "summarize", "summary", "overview", "explain"],
    "comparison": ["compare", "difference", "versus", " vs ", "between"],
    "list": ["list", "which", "what are the", "enumerate"],
    "factual": ["what", "when", "who", "how much", "is there", "does"],
}


def question_type(question: Column, words: dict[str, list[str]] | None = None) -> Column:
    asked, out = F.lower(F.coalesce(question, F.lit(""))), None
    for name, hints in (words or QUESTION_WORDS).items():
        hit = F.lit(False)
        for hint in hints:
            hit = hit | F.contains(asked, F.lit(hint))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise("other")


def with_overrides(questions: DataFrame, overrides: DataFrame) -> DataFrame:
    """type replaced where an override names the index, or else is part of the question: the first in `position`.

    overrides: position, index, part, type. They are an array beside each question, as one has a few at most.
    """
    by_index = overrides.where("index IS NOT NULL").groupBy("index").agg(F.min_by("type", "position").alias("index_type"))
    parts = overrides.where("part IS NOT NULL").agg(F.array_sort(F.collect_list(F.struct("position", F.lower("part").alias("part"), "type"))).alias("parts"))
    named = F.get(F.filter("parts", lambda p: F.contains(F.lower("question"), p["part"])), F.lit(0))["type"]
    out = questions.join(by_index, "index", "left").crossJoin(F.broadcast(parts))  # one row
    return out.withColumn("type", F.coalesce("index_type", named, "type")).drop("index_type", "parts")


def items(contexts: DataFrame, answers: DataFrame) -> DataFrame:
    """contexts (query_id, rank, vector, ...) with cited and answer_similarity from answers (query_id, markers, answer_vector)."""
    rows = contexts.join(answers, "query_id")
    similar = F.when(F.col("answer_vector").isNull() | F.col("vector").isNull() | (F.size("answer_vector") != F.size("vector")), None).otherwise(cosine(F.col("answer_vector"), F.col("vector")))
    return rows.withColumn("cited", F.array_contains("markers", F.col("rank").cast("long"))).withColumn("answer_similarity", similar).drop("markers", "vector", "answer_vector")


#: Responses are counted in ranges of so many numbers; only the counts are put in order by one task.
RANGE = 4_096


def flattened(responses: DataFrame) -> DataFrame:
    """One row for each retrieved item of responses that have an evaluation; response is R1, R2, ... by response_no (a whole number)."""
    kept = responses.where("evaluation IS NOT NULL").withColumn("__range", F.floor(F.col("response_no") / RANGE))
    counts = kept.groupBy("__range").agg(F.count("*").alias("__n"))
    before = counts.withColumn("__before", F.sum("__n").over(Window.orderBy("__range")) - F.col("__n")).drop("__n")
    within = F.row_number().over(Window.partitionBy("__range").orderBy("response_no"))
    named = kept.join(before, "__range").withColumn("response", F.concat(F.lit("R"), F.col("__before") + within))
    return named.select("response", "response_no", "type", F.explode("evaluation").alias("item")).select("response", "response_no", "type", "item.*")


def by_response(rows: DataFrame) -> DataFrame:
    primary, cited = F.col("relation") == "primary", F.col("cited")
    return rows.groupBy("response", "type").agg(
        F.count("*").alias("retrieved"),
        F.sum(cited.cast("long")).alias("cited_chunks"),
        F.bround(F.avg(F.when(cited & primary, F.col("similarity"))), 3).alias("mean_cited_similarity"),
        F.bround(F.max(F.when(cited & primary, F.col("similarity"))), 3).alias("max_cited_similarity"),
        F.bround(F.avg(F.when(primary, F.col("similarity"))), 3).alias("mean_similarity"),
        F.bround(F.avg(F.when(cited, F.col("answer_similarity"))), 3).alias("mean_answer_similarity"),
    )


def by_type(summary: DataFrame) -> DataFrame:
    """Means of the responses' means."""
    return summary.groupBy("type").agg(
        F.count("*").alias("responses"), F.bround(F.avg("mean_cited_similarity"), 3).alias("mean_cited_similarity"),
        F.bround(F.avg("mean_similarity"), 3).alias("mean_similarity"), F.bround(F.avg("mean_answer_similarity"), 3).alias("mean_answer_similarity"),
    )


def quartiles(rows: DataFrame) -> DataFrame:
    """Of the similarity of primary chunks, by type: least, quartiles (interpolated), largest."""
    cut = F.percentile("similarity", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    out = rows.where("relation = 'primary'").groupBy("type").agg(F.count("*").alias("n"), F.min("similarity").alias("lowest"), cut.alias("q"), F.max("similarity").alias("highest"))
    return out.select("type", "n", "lowest", F.get("q", F.lit(0)).alias("q1"), F.get("q", F.lit(1)).alias("median"), F.get("q", F.lit(2)).alias("q3"), "highest")


def marker_pivot(rows: DataFrame, markers: int) -> DataFrame:
    """A row for each response, a column for each marker: similarity of the answer to the cited chunk."""
    cited = rows.where("cited")
    return cited.groupBy("response").pivot("rank", list(range(1, markers + 1))).agg(F.first("answer_similarity")).select("response", *[F.col(str(m)).alias(f"m{m}") for m in range(1, markers + 1)])


def by_type_and_overall(scores: DataFrame, metrics: list[str]) -> DataFrame:
    """Means of metrics for each type, and for all (type null), in one pass."""
    return scores.groupingSets([["type"], []], "type").agg(F.count("*").alias("n"), *[F.avg(m).alias(m) for m in metrics])
