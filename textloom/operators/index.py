"""Changes to the chunk index: additions, importance, metadata."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..errors import SearchError


def add_chunks(chunks: DataFrame, new: DataFrame) -> DataFrame:
    """chunks and new ones, numbered on from the largest id by new's column ord; importance 0.5 where null.

    new: ord (dense from 0), text, frame, and optionally importance and tags.
    """
    top = chunks.agg(F.coalesce(F.max("id"), F.lit(-1)).alias("_top"))
    filled = new
    for name, value in (("importance", F.lit(None).cast("double")), ("tags", F.array().cast("array<string>"))):
        if name not in filled.columns:
            filled = filled.withColumn(name, value)
    numbered = filled.join(F.broadcast(top)).select((F.col("_top") + 1 + F.col("ord")).alias("id"), "text", "frame", F.octet_length("text").alias("length"), F.coalesce("importance", F.lit(0.5)).alias("importance"), "tags")
    return chunks.select(*numbered.columns).unionByName(numbered)


def split_valid(new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid, rejected): rows whose importance is null or from 0 to 1, and the others."""
    bad = F.coalesce(~F.col("importance").between(0.0, 1.0) | F.isnan("importance"), F.lit(False))
    return new.where(~bad), new.where(bad)


def set_importance(chunks: DataFrame, updates: DataFrame, *, order_col: str | None = None) -> DataFrame:
    """chunks with updates' (id, importance); unknown ids add nothing, one value out of range fails the whole.

    Of several updates of an id that of the largest order_col counts, the
    larger value on a tie or where no order is given.
    """
    if not updates.where(~F.col("importance").between(0.0, 1.0) | F.isnan("importance")).isEmpty():
        raise SearchError("importance must lie from 0 to 1")
    new = updates.groupBy(F.col("id").alias("_id")).agg(F.max_by("importance", F.struct(*([order_col] if order_col else []), "importance")).alias("_importance"))
    return chunks.join(new, F.col("id") == F.col("_id"), "left").withColumn("importance", F.coalesce("_importance", "importance")).drop("_id", "_importance")


def set_metadata(chunks: DataFrame, chunk_id: int, metadata: dict[str, str]) -> DataFrame:
    """chunks with one row's metadata map replaced and updated_at set; a missing id is an error."""
    if chunks.where(F.col("id") == chunk_id).isEmpty():
        raise SearchError(f"no chunk {chunk_id}")
    here = F.col("id") == chunk_id
    made = F.map_from_entries(F.array(*[F.struct(F.lit(k), F.lit(v)) for k, v in metadata.items()])) if metadata else F.create_map().cast("map<string,string>")
    return chunks.withColumn("metadata", F.when(here, made).otherwise(F.col("metadata"))).withColumn("updated_at", F.when(here, F.current_timestamp()).otherwise(F.col("updated_at")))


def merge_metadata(chunks: DataFrame, updates: DataFrame) -> DataFrame:
    """chunks with the maps of updates (id, metadata map) merged into theirs, an update's value in place of an older one.

    Of several updates of an id each key takes its largest value; unknown ids
    add nothing; updated_at is set where anything was merged.
    """
    flat = updates.select(F.col("id").alias("_id"), F.explode("metadata").alias("_k", "_v")).groupBy("_id", "_k").agg(F.max("_v").alias("_v"))
    new = flat.groupBy("_id").agg(F.map_from_entries(F.collect_list(F.struct("_k", "_v"))).alias("_new"))
    old = F.coalesce("metadata", F.create_map().cast("map<string,string>"))
    kept = F.map_filter(old, lambda k, _: ~F.map_contains_key("_new", k))
    joined = chunks.join(new, F.col("id") == F.col("_id"), "left")
    there = F.col("_new").isNotNull()
    merged = joined.withColumns({"metadata": F.when(there, F.map_concat(kept, "_new")).otherwise(F.col("metadata")), "updated_at": F.when(there, F.current_timestamp()).otherwise(F.col("updated_at"))})
    return merged.drop("_id", "_new")


def add_validated(chunks: DataFrame, new: DataFrame, dimension: int | None = None, *, vec_col: str = "embedding") -> tuple[DataFrame, DataFrame]:
    """(chunks with the valid new rows, the rejected ones with column reason).

    new: ord, text, frame, and optionally importance, tags and a vector. A row
    is rejected for a null or blank text, an importance out of range, or a
    vector of another dimension; the others are numbered on densely.
    """
    reason = F.when(F.coalesce(F.trim("text"), F.lit("")) == "", F.lit("no text"))
    if "importance" in new.columns:
        reason = reason.when(~F.col("importance").between(0.0, 1.0) | F.isnan("importance"), F.lit("importance out of range"))
    if dimension is not None and vec_col in new.columns:
        reason = reason.when(F.size(vec_col) != dimension, F.lit("vector of another dimension"))
    judged = new.withColumn("reason", reason)
    good = judged.where("reason is null").drop("reason")
    span = 65_536
    cells = good.groupBy(F.expr(f"ord div {span}").alias("_cell")).agg(F.count("*").alias("_n"))
    before = cells.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    placed = good.withColumn("_c", F.expr(f"ord div {span}")).join(before, F.col("_c") == F.col("_cell"))
    dense = placed.withColumn("ord", F.col("_before") + F.row_number().over(Window.partitionBy("_c").orderBy("ord", "text")) - 1).drop("_c", "_cell", "_before")
    return add_chunks(chunks, dense), judged.where("reason is not null")


def rich_value(value) -> str:
    """A metadata value as JSON for a VARIANT column; times and references are tagged objects."""
    import datetime
    import json

    def plain(x):
        if isinstance(x, datetime.datetime):
            return {"$ts": x.astimezone(datetime.timezone.utc).isoformat()}
        return x

    return json.dumps(value, default=plain)
