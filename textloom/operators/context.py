"""What stands around a chunk: by id, by frame, by place within frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import ContextSettings


def id_window(chunks: DataFrame, targets: DataFrame, window: int) -> DataFrame:
    """target, id of the chunks from target - window div 2 to target + window div 2; nothing for targets that aren't there.

    The ids around each target are listed and joined by equality.
    """
    half = window // 2
    wanted = targets.select(F.col("target"), F.explode(F.sequence(F.greatest(F.lit(0), F.col("target") - half), F.col("target") + half)).alias("_id"))
    there = chunks.select(F.col("id").alias("_t"))
    wanted = wanted.join(there, F.col("target") == F.col("_t"), "left_semi")
    return wanted.join(chunks, F.col("_id") == F.col("id")).drop("_id")


def frame_window(chunks: DataFrame, targets: DataFrame, window: int) -> DataFrame:
    """target and the chunks of the frames up to window before and after the target's."""
    home = targets.join(chunks.select(F.col("id").alias("_t"), F.col("frame").alias("_home")), F.col("target") == F.col("_t")).select("target", "_home")
    frames = home.select("target", F.explode(F.sequence(F.greatest(F.lit(0), F.col("_home") - window), F.col("_home") + window)).alias("_frame"))
    return frames.join(chunks, F.col("_frame") == F.col("frame")).drop("_frame")


def enhanced_window(chunks: DataFrame, targets: DataFrame, settings: ContextSettings = ContextSettings()) -> DataFrame:
    """target and its context, by frame and id.

    Chunks from before places ahead of the target to after behind it, within
    its frame; with adjacent_frames also the last before chunks of the frame
    ahead and the first after ones of the frame behind. min_importance holds
    after that; max_total counts frame ahead, own, behind. Ranks are made per
    frame, then only the targets' frames are joined.
    """
    asc, desc = Window.partitionBy("frame").orderBy("id"), Window.partitionBy("frame").orderBy(F.desc("id"))
    placed = chunks.withColumn("_pos", F.row_number().over(asc)).withColumn("_rev", F.row_number().over(desc))
    home = targets.join(placed.select(F.col("id").alias("_t"), F.col("frame").alias("_home"), F.col("_pos").alias("_at")), F.col("target") == F.col("_t")).select("target", "_home", "_at")
    sides = F.array(F.lit(-1), F.lit(0), F.lit(1)) if settings.adjacent_frames else F.array(F.lit(0))
    near = home.select("*", F.explode(sides).alias("_side")).withColumn("_frame", F.col("_home") + F.col("_side"))
    joined = near.join(placed, F.col("_frame") == F.col("frame"))
    own = (F.col("_side") == 0) & F.col("_pos").between(F.col("_at") - settings.before, F.col("_at") + settings.after)
    ahead = (F.col("_side") == -1) & (F.col("_rev") <= settings.before)
    behind = (F.col("_side") == 1) & (F.col("_pos") <= settings.after)
    picked = joined.where(own | ahead | behind)
    if settings.min_importance is not None:
        picked = picked.where(F.col("importance") >= settings.min_importance)
    order = Window.partitionBy("target").orderBy("_side", "id")
    picked = picked.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= settings.max_total)
    return picked.drop("_home", "_at", "_side", "_frame", "_pos", "_rev", "_n")
