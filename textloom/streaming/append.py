"""Streaming append: new documents to chunks, numbered and published once per batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..config import ChunkSettings, CodecSettings
from ..functions import codec
from ..functions.embedders import Embedder, WordHashEmbedder, embed_texts
from ..operators.chunking import chunk_documents, number_chunks
from ..schema import CHUNKS
from ..sources.store import Store


def next_ids(store: Store) -> tuple[int, int]:
    """(next chunk id, next frame): one past the largest that the store has."""
    if "chunks" not in store.tables():
        return 0, 0
    row = store.read().agg(F.coalesce(F.max("id"), F.lit(-1)) + 1, F.coalesce(F.max("frame"), F.lit(-1)) + 1).first()
    return row[0], row[1]


def to_chunks(docs: DataFrame, store: Store, settings: ChunkSettings, source: str = "incremental_update") -> DataFrame:
    """The chunks of docs (doc_id, text), numbered on from the store's."""
    first, frame = next_ids(store)
    made = number_chunks(chunk_documents(docs, settings), start=first)
    return made.select(
        F.col("id").cast("bigint").alias("id"), "text", F.lit(source).alias("source"), F.lit(None).cast("int").alias("page"), "offset", "length", (F.col("id") - first + frame).cast("int").alias("frame")
    )


def memory_tables(rows: DataFrame, embedder: Embedder, settings: CodecSettings = CodecSettings()) -> dict[str, DataFrame]:
    """The chunks with their vectors and the frames with their payloads, of rows as to_chunks() gives them."""
    names = [c.split()[0] for c in CHUNKS.split(", ")]
    payload = rows.select("frame", F.col("id").alias("chunk_id"), codec.encode(F.col("text"), settings).alias("p"))
    return {"chunks": embed_texts(rows, embedder).select(*names), "frames": payload.select("frame", "chunk_id", "p.payload", "p.compressed", "p.encoded_size")}


def append_stream(stream: DataFrame, store: Store, checkpoint: str, settings: ChunkSettings = ChunkSettings(), *, once: bool = True, embedder: Embedder | None = None, payloads: CodecSettings = CodecSettings()) -> StreamingQuery:
    """Appends a stream of (doc_id, text) to the store, as chunks with vectors and frames with payloads, like any others.

    A batch that is replayed after a failure is published once. The embedder
    must be that of the store's other chunks.
    """
    model = embedder or WordHashEmbedder()

    def publish(docs: DataFrame, batch: int) -> None:
        rows = to_chunks(docs, store, settings)
        store.write(memory_tables(rows, model, payloads), append=True, batch=f"{checkpoint}#{batch}")

    writer = stream.writeStream.foreachBatch(publish).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def stream_counts(spark: SparkSession, path: str, schema, out: str, checkpoint: str, *, key: str, time_col: str, late: str = "1 day") -> DataFrame:
    """Rows per key of a folder of Parquet files read as a stream, each file once, into a Parquet folder."""
    events = spark.readStream.schema(schema).parquet(path).withColumn(time_col, F.col(time_col).cast("timestamp")).withWatermark(time_col, late)

    def add(batch: DataFrame, number: int) -> None:
        batch.groupBy(key).agg(F.count("*").alias("n")).write.mode("overwrite").parquet(f"{out}/batch={number}")

    events.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out).groupBy(key).agg(F.sum("n").alias("n"))
