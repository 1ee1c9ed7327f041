"""Statistics of a memory, as one-row tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes that a chunk's record takes besides its text, for the memory estimate.
RECORD_BYTES = 200


def db_stats(chunks: DataFrame) -> DataFrame:
    """chunk_count, and frame_count: the largest frame plus 1, or 0."""
    return chunks.agg(F.count("*").alias("chunk_count"), F.coalesce(F.max("frame").cast("long") + 1, F.lit(0)).alias("frame_count"))


def encoder_stats(chunks: DataFrame) -> DataFrame:
    return chunks.agg(F.count("*").alias("total_chunks"), F.count("frame").alias("total_frames"))


def index_stats(chunks: DataFrame, dimension: int, record_bytes: int = RECORD_BYTES) -> DataFrame:
    """Chunks, distinct frames, chunks a frame (0 without), average importance, and an estimate of memory."""
    n, frames = F.count("*"), F.count_distinct("frame")
    memory = n * dimension * 4 + F.coalesce(F.sum(F.octet_length("text")), F.lit(0)) + n * record_bytes + (frames + n) * 16
    return chunks.agg(
        n.alias("total_chunks"),
        frames.alias("total_frames"),
        F.when(frames == 0, F.lit(0.0)).otherwise(F.try_divide(n.cast("double"), frames)).alias("avg_chunks_per_frame"),
        F.coalesce(F.avg("importance"), F.lit(0.0)).alias("avg_importance"),
        memory.cast("long").alias("memory_bytes"),
    )


def time_range(chunks: DataFrame) -> DataFrame:
    return chunks.agg(F.min("created_at").alias("first_created"), F.max("created_at").alias("last_created"))


def top_tags(chunks: DataFrame, k: int = 10) -> DataFrame:
    """tag, n of the k most frequent tags; ties by tag."""
    return chunks.select(F.explode("tags").alias("tag")).groupBy("tag").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "tag").limit(k)


def cache_stats(texts: DataFrame, dimension: int, text_col: str = "text") -> DataFrame:
    """Entries, text bytes in all and on average, estimated MB of an embedding cache."""
    size = F.coalesce(F.sum(F.octet_length(text_col)), F.lit(0))
    n = F.count("*")
    return texts.agg(n.alias("entries"), size.cast("long").alias("text_bytes"), F.coalesce(F.avg(F.octet_length(text_col)), F.lit(0.0)).alias("avg_text_bytes"), ((size + n * dimension * 4) / 1048576.0).alias("mb"))


def processing_stats(results: DataFrame, ok_col: str = "ok") -> DataFrame:
    return results.agg(F.count("*").alias("total"), F.count_if(F.col(ok_col)).alias("succeeded"), F.count_if(~F.coalesce(F.col(ok_col), F.lit(False))).alias("failed"))


def average_bytes(results: DataFrame, text_col: str = "text") -> DataFrame:
    return results.agg(F.avg(F.octet_length(text_col)).alias("avg_bytes"))
