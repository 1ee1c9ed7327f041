"""Point lookups and filters on chunk tables (id, text, frame, ...)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def chunk_by_id(chunks: DataFrame, chunk_id: int) -> DataFrame:
    return chunks.where(F.col("id") == chunk_id)


def chunks_by_frame(chunks: DataFrame, frame: int) -> DataFrame:
    return chunks.where(F.col("frame") == frame).orderBy("id")


def chunks_by_frames(chunks: DataFrame, frames: Sequence[int]) -> DataFrame:
    """frame and its chunks' ids in order, for every frame asked for; empty where it has none."""
    asked = chunks.sparkSession.createDataFrame([(f,) for f in dict.fromkeys(frames)], "frame int")
    held = chunks.where(F.col("frame").isin(*frames)).groupBy(F.col("frame").alias("_f")).agg(F.array_sort(F.collect_list("id")).alias("ids"))
    return asked.join(held, F.col("frame") == F.col("_f"), "left").select("frame", F.coalesce("ids", F.array().cast("array<bigint>")).alias("ids"))


def frames_of(chunks: DataFrame) -> DataFrame:
    return chunks.where("frame is not null").select("frame").distinct().orderBy("frame")


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def like(text: Column, pattern: str) -> Column:
    """text LIKE %pattern% where only A-Z and a-z are alike; % and _ in pattern stand for anything."""
    return F.translate(text, _UPPER, _LOWER).like("%" + pattern.translate(str.maketrans(_UPPER, _LOWER)).replace("\\", "\\\\") + "%")


def like_search(chunks: DataFrame, pattern: str, limit: int) -> DataFrame:
    return chunks.where(like(F.col("text"), pattern)).orderBy("id").limit(limit)


def with_embedding(chunks: DataFrame) -> DataFrame:
    return chunks.where("embedding is not null")


def tagged_any(tags: Column, wanted: Sequence[str]) -> Column:
    """Has one of the tags; no tag asked for: none has."""
    return F.coalesce(F.arrays_overlap(tags, F.array(*map(F.lit, wanted))), F.lit(False)) if wanted else F.lit(False)


def tagged_all(tags: Column, wanted: Sequence[str]) -> Column:
    """Has all of the tags; no tag asked for: all have."""
    return F.coalesce(F.size(F.array_except(F.array(*map(F.lit, wanted)), tags)) == 0, F.lit(False)) if wanted else F.lit(True)


def important(score: Column, least: float) -> Column:
    return score >= least
