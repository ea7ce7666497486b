"""The store: generations of Parquet tables behind one manifest that is switched by a rename.

A change writes its rows, and the keys of the rows that go, for a generation, and then one manifest file whose name
holds the generation's number. Readers take the highest manifest, so they see all of a change or none; a writer that
fails leaves nothing that a reader looks at. Rows are keyed by (document_id, chunk_id), and replaced by file name.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

TABLES = ("chunks", "parents", "documents")
KEYS = ("filename", "document_id")
GENERATION = "__generation"
STATUSES = ("processing", "completed", "failed")
DOCUMENTS = "document_id string, filename string, uploaded_at timestamp, status string, error string, chunk_count long, title string, source_sha256 string, version string, extraction_method string, parser_version string, schema_version int, needs_reingestion boolean"


class EmbeddingMismatch(ValueError):
    """Vectors of another provider, model or dimension than the store's."""


# Changes as plans: each takes tables and returns the table that should be next.
def replaced_by_filename(current: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of files that are not in `new`, and the new rows; columns that only one side has are null on the other."""
    names = new.select("filename").distinct()
    return current.join(names, "filename", "left_anti").unionByName(new, allowMissingColumns=True)


def without_document(current: DataFrame, document_id: str) -> DataFrame:
    return current.where(~F.col("document_id").eqNullSafe(F.lit(document_id)))


def without_filename(current: DataFrame, filename: str) -> DataFrame:
    return current.where(~F.col("filename").eqNullSafe(F.lit(filename)))


def newest_of_each_file(documents: DataFrame) -> DataFrame:
    """What stays when superseded uploads go: the latest of each file name, ties to the larger id."""
    order = Window.partitionBy("filename").orderBy(F.desc("uploaded_at"), F.desc("document_id"))
    return documents.withColumn("__n", F.row_number().over(order)).where("__n = 1").drop("__n")


def without_superseded(documents: DataFrame, filename: str, current_id: str) -> DataFrame:
    return documents.where((F.col("filename") != filename) | (F.col("document_id") == current_id))


def updated(documents: DataFrame, changes: DataFrame) -> DataFrame:
    """status and error are always taken from a change, other columns only where they are not null."""
    optional = [c for c in changes.columns if c not in ("document_id", "status", "error")]
    news = changes.select("document_id", F.lit(True).alias("__hit"), *[F.col(c).alias(f"__{c}") for c in ("status", "error", *optional)])
    rows = documents.join(news, "document_id", "left")
    taken = {c: F.when(F.col("__hit"), F.col(f"__{c}")).otherwise(F.col(c)) for c in ("status", "error")} | {c: F.coalesce(F.col(f"__{c}"), F.col(c)) for c in optional}
    return rows.withColumns(taken).select(documents.columns)


def stale_failed(documents: DataFrame, message: str = "interrupted by a restart") -> DataFrame:
    stale = F.col("status") == "processing"
    return documents.withColumn("error", F.when(stale, message).otherwise(F.col("error"))).withColumn("status", F.when(stale, "failed").otherwise(F.col("status")))


def legacy_flagged(documents: DataFrame) -> DataFrame:
    """Completed documents without a digest need to be read again."""
    return documents.withColumn("needs_reingestion", F.when((F.col("status") == "completed") & F.col("source_sha256").isNull(), True).otherwise(F.col("needs_reingestion")))


def listed(documents: DataFrame) -> DataFrame:
    return documents.orderBy(F.desc("uploaded_at"), "document_id")


def backfilled(chunks: DataFrame) -> DataFrame:
    """Legacy rows, with values where newer columns are null."""
    values: dict[str, Column] = {"source_text": F.col("content"), "raw_text": F.col("content"), "embedding_text": F.col("content"), "child_order": F.col("chunk_index"), "content_type": F.lit("generic"), "record_type": F.lit("child")}
    return chunks.withColumns({c: F.coalesce(F.col(c), v) if c in chunks.columns else v for c, v in values.items()})


def legacy_records(texts: DataFrame) -> DataFrame:
    """Rows for plain string chunks (document_id, filename, chunk_index, content): ids from document and place."""
    return texts.select("*", F.concat("document_id", F.lit("_chunk_"), "chunk_index").alias("chunk_id"), F.concat("document_id", F.lit("_parent")).alias("parent_id"), F.lit(False).alias("is_structured"))


def shown_text() -> Column:
    return F.coalesce(F.nullif("source_text", F.lit("")), "content")


def migrated(rows: DataFrame, columns: dict[str, str]) -> DataFrame:
    """rows with columns that later versions added, as nulls."""
    return rows.withColumns({c: F.lit(None).cast(t) for c, t in columns.items() if c not in rows.columns})


class Store:
    """Folders {table}/generation=N that one commit added, and {table}-removed/generation=N with the keys it removed.

    A key (a file name or a document id) hides the rows of all generations before its own, so a commit writes
    what is new and never the rest of the store; `compact` rewrites a table without what is hidden.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(f"{self.root}/manifests"))

    def _number(self) -> int:
        names = [x.getPath().getName() for x in self._fs.listStatus(self._path(f"{self.root}/manifests"))]
        return max((int(n.split(".")[0]) for n in names if n.endswith(".json") and not n.startswith((".", "_"))), default=0)

    def manifest(self) -> dict:
        """tables: generations that added to, and removed from, each table; embedding: provider, model and dimension."""
        number = self._number()
        if not number:
            return {"tables": {}, "embedding": None, "generation": 0}
        text = self.spark.read.text(f"{self.root}/manifests/{number:08d}.json", wholetext=True).first()[0]
        return json.loads(text)

    def _folder(self, name: str, number: int) -> str:
        return f"{self.root}/{name}/generation={number:08d}"

    def _read(self, name: str, numbers: list[int]) -> DataFrame:
        folders = [self._folder(name, n) for n in numbers]
        return self.spark.read.option("basePath", f"{self.root}/{name}").option("mergeSchema", "true").parquet(*folders).withColumnRenamed("generation", GENERATION)

    def _at(self, name: str, held: dict | None) -> DataFrame | None:
        if not held or not held["added"]:
            return None
        rows = self._read(name, held["added"])
        if held["removed"]:
            keys = self._read(f"{name}-removed", held["removed"])
            for key in KEYS:
                until = keys.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("__key")).agg(F.max(GENERATION).alias("__until"))
                rows = rows.join(until, rows[key] == until["__key"], "left").where(F.col("__until").isNull() | (F.col("__until") <= F.col(GENERATION))).drop("__key", "__until")
        rows = rows.drop(GENERATION)
        return migrated(rows, dict(c.split(" ") for c in DOCUMENTS.split(", "))) if name == "documents" else rows

    def table(self, name: str) -> DataFrame | None:
        """The rows that count now; columns that later versions added are null in earlier rows."""
        return self._at(name, self.manifest()["tables"].get(name))

    def check_embedding(self, provider: str, model: str, dimension: int) -> None:
        have = self.manifest()["embedding"]
        mine = {"provider": provider, "model": model, "dimension": dimension}
        if have and have != mine:
            raise EmbeddingMismatch(f"the store holds {have}, not {mine}")

    def write(self, tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
        """Write rows for the next generation, unseen until `commit` names them; the rows as written."""
        number = self.manifest()["generation"] + 1
        for name, rows in tables.items():
            rows.write.mode("overwrite").parquet(self._folder(name, number))
        return {name: self.spark.read.parquet(self._folder(name, number)) for name in tables}

    def commit(self, added: list[str], removed: dict[str, DataFrame] | None = None, embedding: dict | None = None, instead: bool = False) -> int:
        """Make the next generation the one that readers see: tables of `added` were written, keys of `removed` go.

        removed: for a table, rows (filename) or (document_id). instead: the added rows are all of their tables.
        """
        now = self.manifest()
        number = now["generation"] + 1
        tables = {n: {"added": list(t["added"]), "removed": list(t["removed"])} for n, t in now["tables"].items()}
        for name, keys in (removed or {}).items():
            whole = [F.col(k).cast("string").alias(k) if k in keys.columns else F.lit(None).cast("string").alias(k) for k in KEYS]
            keys.select(*whole).distinct().write.mode("overwrite").parquet(self._folder(f"{name}-removed", number))
            tables.setdefault(name, {"added": [], "removed": []})["removed"].append(number)
        for name in added:
            held = tables.setdefault(name, {"added": [], "removed": []})
            if instead:
                held["added"], held["removed"] = [], []
            held["added"].append(number)
        text = json.dumps({"generation": number, "tables": tables, "embedding": embedding or now["embedding"]})
        draft, final = self._path(f"{self.root}/manifests/.{number:08d}.draft"), self._path(f"{self.root}/manifests/{number:08d}.json")
        out = self._fs.create(draft, True)
        out.write(bytearray(text, "utf-8"))
        out.close()
        if self._fs.exists(final) or not self._fs.rename(draft, final):
            raise RuntimeError(f"generation {number} was committed by another writer")
        return number

    def put_documents(self, rows: DataFrame, gone: DataFrame | None = None) -> int:
        """Status rows take the place of those with their document_id; those of `gone` (document_id) go."""
        written = self.write({"documents": rows})["documents"].select("document_id")
        return self.commit(["documents"], {"documents": written if gone is None else written.unionByName(gone.select("document_id"))})

    def add(self, chunks: DataFrame, parents: DataFrame, embedding: dict | None = None) -> int:
        """Replace the files of `chunks` (which hold their vectors already) and their parents; without rows, nothing.

        The plan of `chunks` runs once: what was written is counted.
        """
        if embedding:
            self.check_embedding(**embedding)
        written = self.write({"chunks": chunks, "parents": parents})
        number = written["chunks"].count()
        if not number and written["parents"].isEmpty():
            return 0
        names = written["chunks"].select("filename").unionByName(written["parents"].select("filename")).where("filename IS NOT NULL").distinct()
        self.commit(list(written), {"chunks": names, "parents": names}, embedding)
        return number

    def delete_document(self, document_id: str) -> int:
        """Rows of chunks that went."""
        chunks = self.table("chunks")
        if chunks is None:
            return 0
        gone = chunks.where(F.col("document_id") == document_id).count()
        key = self.spark.createDataFrame([(document_id,)], "document_id string")
        self.commit([], {n: key for n in TABLES if n in self.manifest()["tables"]})
        return gone

    def compact(self) -> int:
        """Rewrite all tables without hidden rows, as one generation. Folders of earlier ones stay for their readers."""
        held = {n: t for n in TABLES if (t := self.table(n)) is not None}
        self.write(held)
        return self.commit(list(held), instead=True)
