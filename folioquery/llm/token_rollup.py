"""Token counts as rollups that signed deltas maintain.

A commit is a batch of signed changes: an insert adds a document's counts, a delete subtracts them, a revision
does both. Changes are summed by source, language and tokenizer version before they are stored, in a folder
named after the batch that appears by one atomic rename; a batch that is already there is left alone, so
replays and retries change nothing. Totals are the sums over all committed batches.

Defined results: a null text counts as empty, and long ones are encoded whole; null source and language are values of
their own; rows that share a doc_id (or have none) count each; groups whose documents have all gone stay, with zeros;
an empty table commits empty batches; only the columns named here are read. In the query a copy without doc_id never
leaves, as it is not later than any.
"""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .tokens import encoder

GROUP = ["source", "lang", "tokenizer_version"]
SUMS = ["n_docs", "n_tokens", "n_bytes"]
DELTA = "source string, lang string, tokenizer_version string, n_docs long, n_tokens long, n_bytes long"
#: Tokenizer versions by name: files of token ranks among the public tokenizers (or paths).
VERSIONS = {"byte_bpe_50k": "byte_bpe_50k.tiktoken", "byte_bpe_multi_50k": "byte_bpe_multi_50k.tiktoken"}


def count_tokens(docs: DataFrame, versions: dict[str, str] | None = None, only: dict[str, object] | None = None) -> DataFrame:
    """doc_id, source, lang, h (of the text), n_bytes and a column of token counts for each version.

    only: for a version, a condition; rows that do not meet it get null there and are not encoded.
    """
    versions = versions or VERSIONS
    names = list(versions)
    wanted = F.array(*[F.coalesce((only or {}).get(v, F.lit(True)), F.lit(False)) for v in names])
    rows = docs.select(F.col("doc_id").cast("long"), "source", "lang", F.xxhash64("text").alias("h"), F.coalesce("text", F.lit("")).alias("text"), wanted.alias("wanted"))

    def run(batches):
        encoders = [encoder(file) for file in versions.values()]
        for batch in batches:
            texts, wanted = batch.column(4).to_pylist(), batch.column(5).to_pylist()
            counts = [[len(e.packed(t)) // 4 if w[i] else None for t, w in zip(texts, wanted, strict=True)] for i, e in enumerate(encoders)]
            sizes = pa.array([len(t.encode()) for t in texts], pa.int64())
            columns = [*batch.columns[:4], sizes, *[pa.array(c, pa.int64()) for c in counts]]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "source", "lang", "h", "n_bytes", *names])

    return rows.mapInArrow(run, "doc_id long, source string, lang string, h long, n_bytes long, " + ", ".join(f"{v} long" for v in names))


def changes(counted: DataFrame, version: str, sign: int) -> DataFrame:
    """Signed changes of the rows of `counted` under a version."""
    return counted.select(
        "source", "lang", F.lit(version).alias("tokenizer_version"), F.lit(sign).cast("long").alias("n_docs"),
        (sign * F.col(version)).alias("n_tokens"), (sign * F.col("n_bytes")).alias("n_bytes"),
    )


class TokenRollup:
    """Additive totals in a folder that Spark can write; one folder for each committed batch."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(self.root))

    def batches(self) -> list[str]:
        names = [x.getPath().getName() for x in self._fs.listStatus(self._path(self.root))]
        return sorted(n.removeprefix("batch=") for n in names if n.startswith("batch="))

    def commit(self, batch: str, rows: DataFrame) -> bool:
        """Store the sums of signed changes; False, and nothing else, if the batch is there already."""
        final = self._path(f"{self.root}/batch={batch}")
        if self._fs.exists(final):
            return False
        sums = rows.groupBy(*GROUP).agg(*[F.sum(c).alias(c) for c in SUMS])
        # A hidden name: should two writers race for a batch, the loser's folder ends inside the winner's, unread.
        staged = f"{self.root}/.staged-{batch}-{uuid.uuid4().hex}"
        sums.write.parquet(staged)
        if self._fs.rename(self._path(staged), final):
            return True
        if self._fs.exists(final):  # another writer came first, with the same batch
            return False
        raise OSError(f"the batch {batch} could not be committed")

    def totals(self) -> DataFrame:
        paths = [f"{self.root}/batch={b}" for b in self.batches()]
        if not paths:
            return self.spark.createDataFrame([], DELTA)
        return self.spark.read.schema(DELTA).parquet(*paths).groupBy(*GROUP).agg(*[F.sum(c).alias(c) for c in SUMS])


def query(spark, sf_dir: str) -> DataFrame:
    """Three commits: all documents; later exact copies leave; texts in other languages are counted anew.

    The second commit is replayed, which changes nothing.
    """
    docs = common.table(spark, sf_dir, "documents")
    foreign = ~F.col("lang").eqNullSafe("en")
    counted = common.cut(count_tokens(docs, only={"byte_bpe_multi_50k": foreign}), "rollup-counts")
    first = common.cut(counted.groupBy("h", "n_bytes").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n"), "rollup-copies")
    copies = counted.join(first, ["h", "n_bytes"]).where("doc_id > first")
    stay = counted.join(first, ["h", "n_bytes"], "left").where("first IS NULL OR doc_id <= first").where(foreign)
    root = common.fresh_path(spark, "rollup")
    rollup = TokenRollup(spark, root)
    common.remove_at_end(spark, root)
    rollup.commit("1-load", changes(counted, "byte_bpe_50k", 1))
    rollup.commit("2-copies", changes(copies, "byte_bpe_50k", -1))
    rollup.commit("3-recount", changes(stay, "byte_bpe_50k", -1).unionByName(changes(stay, "byte_bpe_multi_50k", 1)))
    rollup.commit("2-copies", changes(copies, "byte_bpe_50k", -1))
    return rollup.totals()
