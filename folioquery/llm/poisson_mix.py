"""Mixing sources to target weights by Poisson replication.

A source of n rows that should make up the share w of a mix of T rows gets the mean repetition rate T * w / n.
Each row draws a uniform number from a hash of the seed and its id, inverts the Poisson distribution of that
mean there, and is exploded by the count; a second hash orders the copies globally.

Up to a rate of MAX_RATE the distribution starts at exp(-rate), as in the SQL. Beyond, where that underflows, it starts
12 standard deviations below the mean at 1 and is divided by its sum; what lies outside is far below the resolution
of the uniform numbers. No rate that the weights give is refused; only a `total` that is asked for and would repeat the
rows more than MAX_RATE times on average is.

Defined results: a null source is a source of its own; rows with equal doc_id (or with none) draw the same
number; an empty table gives an empty mix; other columns are carried along (one named like an added column is
replaced by it).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: exp(-rate) must stay a normal double; larger rates are summed from near the mean.
MAX_RATE = 500.0
#: A table of at most so many sources (a row each) is broadcast; beyond, it is joined by shuffling.
BROADCAST_SOURCES = 50_000
#: The same for the probabilities in it (8 bytes each).
BROADCAST_STEPS = 2_000_000


def uniform(*parts: Column) -> Column:
    """In [0, 1), from the first 52 bits of the MD5 of the parts, joined by colons."""
    text = F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(float(2**52))


def first_count(rate: Column) -> Column:
    """The least count that `poisson_cdf` gives a probability."""
    return F.when(rate > MAX_RATE, F.floor(rate - 12 * F.sqrt(rate) - 24)).otherwise(0).cast("int")


def last_count(rate: Column) -> Column:
    return F.ceil(rate + 12 * F.sqrt(rate) + 24).cast("int")


def poisson_cdf(rate: Column) -> Column:
    """P(X <= k) for k from `first_count` until the tail is below the resolution of `uniform`."""
    low = first_count(rate)
    p0 = F.when(rate > MAX_RATE, 1.0).otherwise(F.exp(-rate))
    start = F.struct(p0.alias("p"), F.array(p0).alias("cdf"))

    def step(acc: Column, k: Column) -> Column:
        p = acc["p"] * rate / k
        return F.struct(p.alias("p"), F.concat(acc["cdf"], F.array(F.element_at(acc["cdf"], -1) + p)).alias("cdf"))

    def whole(cdf: Column) -> Column:
        return F.when(rate > MAX_RATE, F.transform(cdf, lambda c: c / F.element_at(cdf, -1))).otherwise(cdf)

    return F.aggregate(F.sequence(low + 1, last_count(rate)), start, step, lambda acc: whole(acc["cdf"]))


def source_rates(docs: DataFrame, total: float | None, temperature: float, weights: dict[str, float] | None) -> DataFrame:
    """A row for each source: its rows and its mean repetition rate. Weights default to sizes ** temperature."""
    if weights is None:
        raw = F.pow(F.col("n").cast("double"), F.lit(float(temperature)))
    elif weights:
        pairs = F.create_map(*[F.lit(x) for pair in weights.items() for x in pair])
        raw = F.coalesce(F.element_at(pairs, F.coalesce("source", F.lit(""))), F.lit(0.0))
    else:
        raw = F.lit(0.0)
    sizes = common.cut(docs.groupBy("source").agg(F.count("*").alias("n")).withColumn("w", raw), "mix-sizes")
    rows, weight = sizes.agg(F.sum("n"), F.sum("w")).first()
    want = float(rows or 0) if total is None else float(total)
    return sizes.select("source", "n", (F.lit(want) * F.col("w") / F.lit(weight or 1.0) / F.col("n")).alias("rate"))


def mix(docs: DataFrame, seed: str = "mix-1", total: float | None = None, temperature: float = 0.5, weights: dict[str, float] | None = None) -> DataFrame:
    """docs repeated as drawn, in global shuffled order, with copy_no (from 0) and shuffle_key added."""
    docs = common.plain(docs, "copy_no", "shuffle_key")
    rates = source_rates(docs, total, temperature, weights)
    rate = F.col("rate")
    sources, rows, steps = rates.agg(F.count("*"), F.sum("n"), F.sum(last_count(rate) - first_count(rate) + 1)).first()
    if total is not None and total > MAX_RATE * (rows or 0):
        raise ValueError(f"a total of {total:g} repeats {rows or 0} rows more than {MAX_RATE:g} times on average")
    table = rates.select(F.col("source").alias("__source"), first_count(rate).alias("__low"), poisson_cdf(rate).alias("__cdf"))
    table = F.broadcast(table) if sources <= BROADCAST_SOURCES and (steps or 0) <= BROADCAST_STEPS else table
    u = uniform(F.lit(seed), F.col("doc_id"))
    drawn = docs.join(table, docs["source"].eqNullSafe(F.col("__source"))).withColumn("__u", u)
    drawn = drawn.withColumn("__n", F.col("__low") + F.size(F.filter("__cdf", lambda c: c <= F.col("__u")))).where("__n > 0")
    copies = drawn.withColumn("copy_no", F.explode(F.sequence(F.lit(0), F.col("__n") - 1)))
    key = uniform(F.lit(f"{seed}/order"), F.col("doc_id"), F.col("copy_no"))
    return copies.withColumn("shuffle_key", key).select(*docs.columns, "copy_no", "shuffle_key").orderBy("shuffle_key", "doc_id", "copy_no")


def query(spark, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "source")
    return mix(docs).select("doc_id", "source", F.col("copy_no").cast("long").alias("copy_no"), "shuffle_key")


SQL = """
WITH RECURSIVE sizes AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
rates AS (SELECT source, sum(n) OVER () * sqrt(n) / sum(sqrt(n)) OVER () / n AS rate FROM sizes),
cdf AS (
  SELECT source, rate, 0 AS k, exp(-rate) AS p, exp(-rate) AS c FROM rates
  UNION ALL
  SELECT source, rate, k + 1, p * rate / (k + 1), c + p * rate / (k + 1) FROM cdf WHERE k < ceil(rate + 12 * sqrt(rate) + 24)),
drawn AS (
  SELECT doc_id, source, ('0x' || substr(md5('mix-1:' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u FROM documents),
counted AS (
  SELECT d.doc_id, d.source, count(*) AS n FROM drawn d JOIN cdf ON d.source IS NOT DISTINCT FROM cdf.source AND cdf.c <= d.u GROUP BY d.doc_id, d.source),
copies AS (SELECT doc_id, source, unnest(range(0, n)) AS copy_no FROM counted)
SELECT doc_id, source, copy_no::BIGINT AS copy_no,
  ('0x' || substr(md5('mix-1/order:' || coalesce(doc_id::VARCHAR, '') || ':' || copy_no::VARCHAR), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS shuffle_key
FROM copies
"""
