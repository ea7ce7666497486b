"""What the service offers, as methods that return DataFrames; errors carry the status an endpoint would answer with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioquery.config import DEFAULTS, Settings
from folioquery.operators import search, store
from folioquery.operators.embed import EmbeddingProvider, HashingProvider, embedded, worker_model
from folioquery.plans import chat
from folioquery.sources.documents import ModelError, valid_file_type
from folioquery.streaming import ingest


class ServiceError(Exception):
    """An error with the status of its answer: 400 bad request, 404 not found, 503 model unavailable."""

    def __init__(self, status: int, message: str):
        super().__init__(message)
        self.status = status


class Engine:
    def __init__(self, spark: SparkSession, root: str, make: Callable[[], EmbeddingProvider] = HashingProvider, model: Callable[[str], str] = chat.extractive, settings: Settings = DEFAULTS, extract: ingest.Extract | None = None):
        """extract: reads the pages of PDF files; without it, uploads of PDF files are kept as failed."""
        self.spark, self.store, self.make, self.model, self.settings, self.extract = spark, store.Store(spark, root), make, model, settings, extract

    def health(self) -> dict:
        return {"status": "ok", "generation": self.store.manifest()["generation"]}

    def upload(self, path: str) -> DataFrame:
        """Take in the files at a path; the records of all documents after it. A file that fails is kept with its error."""
        for name in [r[0] for r in self.spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1)).collect()]:
            if not valid_file_type(name):
                raise ServiceError(400, f"{name}: only PDF and text files can be read")
        try:
            ingest.ingest_files(self.spark, self.store, path, self.extract, make=self.make, settings=self.settings)
        except store.EmbeddingMismatch as error:
            raise ServiceError(400, str(error)) from error
        return self.documents()

    def documents(self) -> DataFrame:
        rows = self.store.table("documents")
        return store.listed(rows if rows is not None else self.spark.createDataFrame([], store.DOCUMENTS))

    def document(self, document_id: str) -> DataFrame:
        found = self.documents().where(F.col("document_id") == document_id)
        if found.isEmpty():
            raise ServiceError(404, f"no document {document_id}")
        return found

    def delete(self, document_id: str) -> int:
        self.document(document_id)
        return self.store.delete_document(document_id)

    def _queries(self, asked: list[str], document_id: str | None = None) -> DataFrame:
        if not asked or any(not q.strip() for q in asked):
            raise ServiceError(400, "a query must not be empty")
        rows = self.spark.createDataFrame(list(enumerate(asked)), "query_id long, query string").withColumn("query_vector", embedded(F.col("query"), self.make))
        return rows.withColumn("document_id", F.lit(document_id)) if document_id else rows

    def _tables(self) -> tuple[DataFrame, DataFrame]:
        chunks, parents = self.store.table("chunks"), self.store.table("parents")
        if chunks is None or parents is None:
            raise ServiceError(404, "nothing has been uploaded")
        index = F.col("child_order").alias("chunk_index")
        return chunks.select("*", F.col("source_text").alias("text"), index), parents.select("parent_id", F.col("source_text").alias("text"))

    def search(self, queries: list[str], top_k: int | None = None, document_id: str | None = None) -> DataFrame:
        """Primary chunks of each query, best first."""
        chunks, parents = self._tables()
        found = search.retrieve(chunks, parents, self._queries(queries, document_id), self.settings, top_k)
        return found.where("relation = 'primary'").join(chunks.drop("embedding"), "chunk_id").orderBy("query_id", "rank")

    def chat(self, questions: list[str]) -> dict[str, DataFrame]:
        """answers, contexts, citations and evaluation; all documents are searched, and no history is sent."""
        chunks, parents = self._tables()
        make = self.make
        embed = (lambda texts: worker_model(make).embed(texts)) if self.settings.include_eval_data else None
        try:
            return chat.chat(chunks, parents, self._queries(questions), self.model, embed, self.settings)
        except ModelError as error:
            raise ServiceError(503, str(error)) from error
