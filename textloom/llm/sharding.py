"""Sharding: rendezvous hashing of stable record keys over weighted shards."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, salted_slots

#: Rows of one (shard, salt) cell, about; the number of salts follows the row count.
CELL_ROWS = 250_000
LEAST_SALTS = 16


def unit_hash(*parts: Column) -> Column:
    """A double in (0, 1) from the MD5 of the parts, the same on every engine: 52 bits and a half step."""
    digest = F.md5(F.concat_ws(":", *[p.cast("string") for p in parts]))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def rendezvous(key: Column, weights: list[float]) -> Column:
    """The shard of key: that of the largest weight / -ln(hash of key and shard).

    A score depends on the key and one shard only, so one more shard takes
    records only into itself, and a share of them that follows its weight. Ties
    go to the higher shard. Shards of weight 0 get nothing.
    """
    live = [(n, w) for n, w in enumerate(weights) if w > 0]
    if not live:
        raise ValueError("a shard of positive weight is needed")
    scores = [F.struct((F.lit(float(w)) / -F.ln(unit_hash(F.coalesce(key.cast("string"), F.lit("")), F.lit(n)))).alias("score"), F.lit(n).alias("shard")) for n, w in live]
    return (F.greatest(*scores) if len(scores) > 1 else scores[0])["shard"]


def shard(docs: DataFrame, weights: list[float], *, id_col: str = "doc_id", text_col: str = "text", grown_weight: float = 1.0) -> DataFrame:
    """Per row of docs: id, size, text_crc32, law ``key``, shard, slot, grown_shard.

    size is the text's UTF-8 bytes plus 1 (null and empty: 1; their CRC-32 is
    0), slot numbers a shard's rows gaplessly from 0, grown_shard is the shard
    once one of grown_weight is added. Repeated rows go to one shard and get a
    slot each; null ids share the key ''. Other columns of docs are ignored.
    """
    key, text = F.col(id_col), F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        id_col,
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"),
        rendezvous(key, weights).alias("shard"),
        rendezvous(key, [*weights, grown_weight]).alias("grown_shard"),
    )
    with Scratch(docs.sparkSession) as scratch:
        salts = max(LEAST_SALTS, math.ceil(docs.count() / (CELL_ROWS * len(weights))))
        salt = F.floor(unit_hash(F.coalesce(key.cast("string"), F.lit("")), F.lit("slot")) * salts)
        placed = salted_slots(scratch, rows, "shard", [id_col, "size", "text_crc32"], salt, "slot")
        return scratch.keep(placed.select(id_col, "size", "text_crc32", "law", "shard", "slot", "grown_shard"))


def write_shards(docs: DataFrame, path: str, weights: list[float], *, id_col: str = "doc_id", files: int = 1) -> None:
    """Write docs as Parquet, one folder ``shard=n`` a shard, each in ``files`` files dealt by the key's hash."""
    part = F.floor(unit_hash(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit("file")) * files)
    out = docs.withColumn("shard", rendezvous(F.col(id_col), weights)).withColumn("_file", part)
    out.repartition(len(weights) * files, "shard", "_file").drop("_file").write.partitionBy("shard").parquet(path)
