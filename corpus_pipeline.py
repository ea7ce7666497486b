"""From raw documents to packed training sequences: toxicity, line dedup, MinHash, mixing, packing.

Each stage takes (spark, docs, sf_dir), and all but the last return the columns of `documents`. Stages are
written as Parquet in the shared folder and read again, so that a lost executor repeats one stage at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioquery.llm import bottomk_dedup, common, line_dedup, packing, poisson_mix, toxic_grammar


def with_length(docs: DataFrame) -> DataFrame:
    """n_chars follows the text where it was changed."""
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents below the threshold of the clause grammar; the others go."""
    scorer = toxic_grammar.fit(docs, common.table(spark, sf_dir, "labels"))
    return toxic_grammar.score(docs, scorer).where("toxic_predicted = 0").select(docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without later copies of repeated runs of lines; documents that lose all their text go."""
    cleaned = line_dedup.dedup_lines(docs)
    return with_length(cleaned.where("n_removed_lines = 0 OR trim(text) <> ''").select(docs.columns))


def minhash(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of near-duplicates."""
    return bottomk_dedup.near_duplicates(docs).where("kept").select(docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as drawn for its source, in global shuffled order."""
    return poisson_mix.mix(docs).select(docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents in sequences of 2048 tokens."""
    return packing.pack(docs)


STAGES = [("toxicity", toxicity), ("line dedup", lines), ("MinHash near-dedup", minhash), ("mixing", mixing), ("best-fit packing", pack)]
#: Fitted weights and byte-pair encoding are beyond SQL; tests/llm/test_toxicity_and_pipeline.py checks every stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.cut(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
