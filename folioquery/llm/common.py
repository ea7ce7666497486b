"""What the operators of this subpackage share: reading, cutting lineage, packed hash keys."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Stands in for a null doc_id inside an operator, so that null ids sort first and still join.
NULL_ID = -(2**63)

_OWN: list[str] = []


def workdir(spark: SparkSession) -> str:
    """The shared folder that the cluster names; a folder of our own only where none is named, as in tests."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not _OWN:
        _OWN.append(tempfile.mkdtemp(prefix="folioquery-"))
        atexit.register(shutil.rmtree, _OWN[0], ignore_errors=True)
    return f"file://{_OWN[0]}"


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{workdir(spark)}/{name}-{uuid.uuid4().hex}"


def remove_at_end(spark: SparkSession, path: str) -> None:
    """Remove what is at the path when the application ends."""
    jvm = spark.sparkContext._jvm
    hadoop_path = jvm.org.apache.hadoop.fs.Path(path)
    hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop_path)


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it again: the lineage ends there, and lost executors cost nothing."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    remove_at_end(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def plain(docs: DataFrame, *own: str) -> DataFrame:
    """docs without columns that an operator adds itself, and without reserved names (two underscores first)."""
    names = {x.lower() for x in own}
    return docs.drop(*[c for c in docs.columns if c.lower() in names or c.startswith("__")])


def id_key(col: str = "doc_id") -> Column:
    return F.coalesce(F.col(col).cast("long"), F.lit(NULL_ID))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on unsigned 64-bit numbers."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Bits of the filter below: 1,024 rows of 4 KB, whatever the tables hold.
FILTER_BITS = 2**25


def possible(rows: DataFrame, wanted: DataFrame, *keys: str) -> DataFrame:
    """rows without most of those whose keys are not in `wanted`; none that is goes.

    A bitmap of hashed keys of fixed size is broadcast, so that a join that follows shuffles few other rows. A
    full bitmap lets all rows through.
    """
    bit = F.pmod(F.xxhash64(*keys), F.lit(FILTER_BITS))
    marks = wanted.select(F.bitmap_bucket_number(bit).alias("__bucket"), F.bitmap_bit_position(bit).alias("__at"))
    marks = cut(marks.groupBy("__bucket").agg(F.bitmap_construct_agg("__at").alias("__bits")), "key-filter")
    held = rows.withColumn("__bit", F.bitmap_bit_position(bit)).withColumn("__bucket", F.bitmap_bucket_number(bit))
    held = held.join(F.broadcast(marks), "__bucket")
    byte = F.conv(F.hex(F.substring("__bits", F.floor(F.col("__bit") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    on = F.pmod(F.floor(byte / F.pow(F.lit(2.0), F.pmod("__bit", F.lit(8)))), F.lit(2)) == 1
    return held.where(on).select(*rows.columns)
