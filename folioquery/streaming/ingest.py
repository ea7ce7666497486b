"""Ingestion, as one batch or as a stream of files: read, clean, chunk, embed, store, and keep the status."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioquery.config import DEFAULTS, Settings
from folioquery.functions.text import clause_key
from folioquery.operators import chunking, parsing, store
from folioquery.operators.embed import EmbeddingProvider, HashingProvider, embedded
from folioquery.sources import documents

NO_CHUNKS = "No searchable chunks produced from document"
Extract = Callable[[bytes], list[dict]]


def status_rows(files: DataFrame, status: str) -> DataFrame:
    names = files.select("document_id", "filename", "source_sha256").distinct()
    columns = {"status": F.lit(status), "error": F.lit(None).cast("string"), "uploaded_at": F.current_timestamp(), "needs_reingestion": F.lit(False), "schema_version": F.lit(2), "extraction_method": F.lit(None).cast("string"), "parser_version": F.lit("legal-structured-v1"), "chunk_count": F.lit(0).cast("long"), "title": F.lit(None).cast("string"), "version": F.lit(None).cast("string")}
    return names.withColumns(columns).select(*[c.split(" ")[0] for c in store.DOCUMENTS.split(", ")])


def ingest_documents(target: store.Store, read: DataFrame, make: Callable[[], EmbeddingProvider] = HashingProvider, settings: Settings = DEFAULTS) -> int:
    """Store the chunks of documents.parsed(); earlier uploads of a file go once its new one is complete.

    What fails is kept with each document: a file that cannot be read, one without searchable chunks, or all of them
    if embedding or storing fails. Rows that were there before a failure stay.
    """
    model = make()
    facts = {"provider": model.name, "model": model.model, "dimension": model.dimension}
    target.check_embedding(**facts)
    read = read.persist()
    records = None
    try:
        target.put_documents(status_rows(read, "processing"))
        found = documents.pages_of_documents(read)
        kept = parsing.parsed_blocks(found).persist()
        about = parsing.document_facts(found, kept)
        records = chunking.chunk_documents(parsing.chunking_blocks(kept, about), settings).persist()
        counts = chunking.children(records).groupBy("document_id").agg(F.count("*").alias("chunk_count"))
        searchable = records.join(counts.select("document_id"), "document_id", "left_semi")
        chunks = chunking.children(searchable).withColumns({"chunk_id": F.col("child_id"), "clause_key": clause_key(F.col("clause_path"))})
        chunks = chunks.withColumn("embedding", embedded(F.coalesce(F.nullif("embedding_text", F.lit("")), "source_text"), make, settings.embedding_batch_size))
        number = target.add(chunks, chunking.stored_parents(searchable), facts)
        news = read.select("document_id", "error", "extraction_method").join(counts, "document_id", "left").join(about, "document_id", "left")
        error = F.coalesce("error", F.when(F.col("chunk_count").isNull(), NO_CHUNKS))
        news = news.select("document_id", F.when(error.isNull(), "completed").otherwise("failed").alias("status"), error.alias("error"), "chunk_count", "extraction_method", "title", "version")
        held = target.table("documents")
        mine = held.join(read.select("document_id"), "document_id", "left_semi")
        done = store.updated(mine, news)
        current = done.where("status = 'completed'").select("filename", F.col("document_id").alias("__id"))
        target.put_documents(done, held.join(current, "filename").where("document_id <> __id").select("document_id"))
        kept.unpersist()
        return number
    except Exception as error:
        failed = read.select("document_id").distinct().withColumns({"status": F.lit("failed"), "error": F.lit(str(error)[:500])})
        held = target.table("documents")
        target.put_documents(store.updated(held.join(read.select("document_id"), "document_id", "left_semi"), failed))
        raise
    finally:
        read.unpersist()
        if records is not None:
            records.unpersist()


def ingest_files(spark: SparkSession, target: store.Store, path: str, extract: Extract | None = None, **options) -> int:
    return ingest_documents(target, documents.parsed(documents.files(spark, path), extract), **options)


def ingest_stream(spark: SparkSession, target: store.Store, path: str, checkpoint: str, extract: Extract | None = None, **options):
    """New files of a folder, in batches until there are no more; the stream remembers what it has read.

    A batch that runs again replaces its files by themselves, so the result is the same.
    """
    found = spark.readStream.format("binaryFile").schema(documents.BINARY).load(path)

    def take(batch: DataFrame, _: int) -> None:
        name = F.element_at(F.split("path", "/"), -1)
        files = batch.select(name.alias("filename"), F.lower(F.element_at(F.split(name, r"\."), -1)).alias("suffix"), F.sha2("content", 256).alias("source_sha256"), "modificationTime", "content")
        latest = files.groupBy("filename").agg(F.max_by(F.struct("suffix", "source_sha256", "content"), "modificationTime").alias("f")).select("filename", "f.*")
        if not latest.isEmpty():
            ingest_documents(target, documents.parsed(latest, extract), **options)

    return found.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
