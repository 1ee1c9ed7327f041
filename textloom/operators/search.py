"""Vector search: exact top k, many queries at a time, and what is built on them."""

from __future__ import annotations

import itertools
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import Metric, SearchSettings
from ..errors import SearchError
from ..functions import vector as V
from ..session import ship
from .lookup import tagged_any

#: Query vectors of a batch that are broadcast; larger batches are searched in blocks of so many.
QUERY_BLOCK = 10_000
#: Query vectors held against a batch of rows at a time.
TILE = 512


def _queried(rows: DataFrame, query: Sequence[float], id_col: str, vec_col: str) -> DataFrame:
    if not query:
        raise SearchError("an empty query vector")
    return rows.where(F.col(vec_col).isNotNull() & V.nonzero(F.col(vec_col))).withColumnRenamed(id_col, "id") if id_col != "id" else rows.where(F.col(vec_col).isNotNull() & V.nonzero(F.col(vec_col)))


def top_k(rows: DataFrame, query: Sequence[float], k: int, metric: Metric = Metric.COSINE, *, id_col: str = "vec_id", vec_col: str = "embedding", digits: int | None = None) -> DataFrame:
    """id and distance of the k nearest, nearest first, ties by id. Null, zero and NaN vectors are left out.

    digits: distances are rounded so before they are ranked. Vectors of another
    dimension are an error. Each partition keeps k rows; the driver merges them.
    """
    d = _rounded(V.distance_to(F.col(vec_col), query, metric), digits)
    scored = _queried(rows, query, id_col, vec_col).select("id", d.alias("distance"))
    # NaN sorts last, so it is left out of the few rows that remain and the distance is worked out once a row.
    return scored.orderBy("distance", "id").limit(k).where(~F.isnan("distance"))


def _rounded(d: Column, digits: int | None) -> Column:
    return F.round(d, digits) + 0.0 if digits is not None else d


def similar(rows: DataFrame, query: Sequence[float], settings: SearchSettings, k: int, *, id_col: str = "vec_id", vec_col: str = "embedding", digits: int | None = None) -> DataFrame:
    """id and score (cosine) of the k most alike, at min_score or above; candidate_factor as in SearchSettings."""
    rows = rows.where(F.col(vec_col).isNotNull())
    if settings.candidate_factor is not None:
        rows = rows.orderBy(id_col).limit(settings.candidate_factor * k)
    score = V.cosine_to(F.col(vec_col), query)
    score = F.round(score, digits) + 0.0 if digits is not None else score
    scored = rows.select(F.col(id_col).alias("id"), score.alias("score")).where(~F.isnan("score") & (F.col("score") >= settings.min_score))
    return scored.orderBy(F.desc("score"), "id").limit(min(k, settings.max_results))


def _distances(x: np.ndarray, q: np.ndarray, metric: Metric) -> np.ndarray:
    """The distances of all rows of x to all rows of q."""
    if metric is Metric.DOT:
        return -(x @ q.T)
    if metric is Metric.COSINE:
        size = np.sqrt((x * x).sum(axis=1))[:, None] * np.sqrt((q * q).sum(axis=1))
        return 1.0 - np.where(size == 0, 0.0, x @ q.T / np.where(size == 0, 1.0, size))
    if metric is Metric.L2:
        return np.stack([np.sqrt(((x - v) ** 2).sum(axis=1)) for v in q], axis=1)
    return np.stack([np.abs(x - v).sum(axis=1) for v in q], axis=1)


def _nearest(rows: DataFrame, queries: list, k: int, metric: Metric, slack: float, kind: str) -> DataFrame:
    """number (of the query), id, distance of the k nearest rows of each batch, and of those within slack of the last."""
    vectors = rows.sparkSession.sparkContext.broadcast(np.array(queries, np.float64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = vectors.value
        for batch in batches:
            held = batch.column(1)
            sizes = np.diff(held.offsets.to_numpy())
            if (sizes != q.shape[1]).any():
                raise SearchError("vectors of unequal dimension")
            flat = held.values.to_numpy(zero_copy_only=False)[held.offsets[0].as_py() : held.offsets[-1].as_py()] if len(held) else np.zeros(0)
            x = flat.astype(np.float64).reshape(-1, q.shape[1])
            for low in range(0, len(q) if len(x) else 0, TILE):
                d = _distances(x, q[low : low + TILE], metric)
                d = np.where(np.isnan(d), np.inf, d)
                last = np.partition(d, k - 1, axis=0)[k - 1] if len(d) > k else np.full(d.shape[1], np.inf)
                row, number = np.nonzero((d <= last + slack) & (d < np.inf))
                yield pa.RecordBatch.from_arrays([pa.array((number + low).astype(np.int32)), batch.column(0).take(pa.array(row)), pa.array(d[row, number])], names=["number", "id", "distance"])

    return rows.mapInArrow(run, f"number int, id {kind}, distance double")


def knn(rows: DataFrame, queries: DataFrame, k: int, metric: Metric = Metric.COSINE, *, id_col: str = "vec_id", vec_col: str = "embedding", query_id: str = "query_id", digits: int | None = None) -> DataFrame:
    """query_id, id, distance, rank of the k nearest rows of each query; ties by id.

    Queries are read in blocks of QUERY_BLOCK, each a broadcast of known size,
    against all rows, by matrix products over Arrow batches; each batch gives k
    rows a query, ranks keep k a query and partition before the exchange. The
    queries' columns are query_id and vec_col. Null, zero and NaN vectors are
    left out; vectors of another dimension are an error.
    """
    spark = rows.sparkSession
    ship(spark)
    live = rows.where(F.col(vec_col).isNotNull() & V.nonzero(F.col(vec_col))).select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>"))
    kind, of = (df.schema[c].dataType.simpleString() for df, c in ((rows, id_col), (queries, query_id)))
    slack = 10.0**-digits if digits is not None else 0.0
    stream = queries.where(F.col(vec_col).isNotNull()).select(F.col(query_id).alias("query_id"), F.col(vec_col).cast("array<double>").alias("q")).toLocalIterator()
    out = None
    while block := list(itertools.islice(stream, QUERY_BLOCK)):
        near = _nearest(live, [r["q"] for r in block], k, metric, slack, kind)
        names = spark.createDataFrame([(n, r["query_id"]) for n, r in enumerate(block)], f"number int, query_id {of}")
        scored = near.join(F.broadcast(names), "number").select("query_id", "id", _rounded(F.col("distance"), digits).alias("distance"))
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "id"))
        best = scored.withColumn("rank", rank).where(F.col("rank") <= k)
        out = best if out is None else out.union(best)
    if out is None:
        out = spark.createDataFrame([], f"query_id {of}, id {kind}, distance double, rank int")
    return out


def enhanced(rows: DataFrame, query: Sequence[float], k: int, *, tags: Sequence[str] = (), min_importance: float | None = None, filter_first: bool = True, vec_col: str = "embedding", digits: int | None = None) -> DataFrame:
    """id, distance and score (1 - distance) under tag and importance filters.

    filter_first: the k nearest of what passes the filters; else what passes of
    the k nearest. rows: id, vec_col, tags, importance.
    """
    d = _rounded(V.distance_to(F.col(vec_col), query), digits)
    scored = rows.where(F.col(vec_col).isNotNull() & V.nonzero(F.col(vec_col))).select("id", "tags", "importance", d.alias("distance"))
    passes = F.lit(True)
    if tags:
        passes = passes & tagged_any(F.col("tags"), tags)
    if min_importance is not None:
        passes = passes & (F.col("importance") >= min_importance)
    ranked = scored.where(passes).orderBy("distance", "id").limit(k) if filter_first else scored.orderBy("distance", "id").limit(k).where(passes)
    return ranked.select("id", "distance", (1.0 - F.col("distance")).alias("score"))


def index_stats(rows: DataFrame, *, vec_col: str = "embedding", id_col: str = "vec_id") -> DataFrame:
    """One row: vectors, dimension, zero vectors, largest id."""
    return rows.agg(F.count("*").alias("vectors"), F.max(F.size(vec_col)).cast("long").alias("dimension"), F.count_if(~V.nonzero(F.col(vec_col))).alias("zero_vectors"), F.max(id_col).alias("largest_id"))


def settings_stats(rows: DataFrame, settings: SearchSettings = SearchSettings(), *, vec_col: str = "embedding", metadata: DataFrame | None = None) -> DataFrame:
    """One row: size, dimension, distance_metric, metadata_count, and the keys of a graph index, which there is none of."""
    n = 0 if metadata is None else metadata.count()
    return rows.agg(F.count("*").alias("size"), F.coalesce(F.max(F.size(vec_col)), F.lit(0)).cast("long").alias("dimension")).select(
        "size", "dimension", F.lit(settings.metric.value).alias("distance_metric"), F.lit(n).cast("long").alias("metadata_count"), F.lit(False).alias("has_hnsw"), F.lit(False).alias("hnsw_built"), F.lit(0).cast("long").alias("hnsw_points")
    )


def vector_by_id(rows: DataFrame, vec_id: int, *, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """The vector of an id; no row for one that isn't there."""
    return rows.where(F.col(id_col) == vec_id).select(F.col(id_col).alias("id"), vec_col)


def with_records(found: DataFrame, records: DataFrame, *, id_col: str = "id") -> DataFrame:
    """Search results (id and scores) with their whole records; results without one keep nulls."""
    named = records.withColumnRenamed(id_col, "_rid")
    return found.join(named, found["id"] == named["_rid"], "left").drop("_rid")


def missing(texts: DataFrame, cache: DataFrame, *, text_col: str = "text") -> DataFrame:
    """The distinct texts that a cache of embeddings lacks; null texts need none."""
    wanted = texts.select(text_col).where(F.col(text_col).isNotNull()).distinct()
    return wanted.join(cache.select(text_col), text_col, "left_anti")


def upsert(rows: DataFrame, new: DataFrame, *, id_col: str = "vec_id", vec_col: str = "embedding", order_col: str | None = None) -> DataFrame:
    """rows with new's in place of those of the same id, one row an id.

    Of new rows that share an id the one of the largest order_col stays, or
    where none is given the largest by the hash of all columns, so that the
    result doesn't depend on partitions. Vectors of another dimension than the
    others' are an error.
    """
    if vec_col in rows.columns and vec_col in new.columns:
        sizes = rows.select(F.size(vec_col).alias("n")).union(new.select(F.size(vec_col))).where("n >= 0").distinct().limit(2).collect()
        if len(sizes) > 1:
            raise SearchError("vectors of unequal dimension")
    order = F.struct(*([F.col(order_col)] if order_col else []), F.xxhash64(*[F.col(c) for c in new.columns]))
    last = new.groupBy(id_col).agg(F.max_by(F.struct(*new.columns), order).alias("_last")).select("_last.*").select(*rows.columns)
    return rows.join(last.select(id_col), id_col, "left_anti").select(*rows.columns).unionByName(last)


def lsh_top_k(rows: DataFrame, query: Sequence[float], k: int, *, id_col: str = "vec_id", vec_col: str = "embedding", bucket: float = 0.5, tables: int = 8, seed: int = 7) -> DataFrame:
    """An approximate top k by random projections of the normalised vectors; opt-in, may miss rows."""
    from pyspark.ml.feature import BucketedRandomProjectionLSH
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.linalg import Vectors

    size = sum(x * x for x in query) ** 0.5 or 1.0
    vectors = rows.select(F.col(id_col).alias("id"), array_to_vector(V.normalise(F.col(vec_col)).cast("array<double>")).alias("v"))
    model = BucketedRandomProjectionLSH(inputCol="v", outputCol="h", bucketLength=bucket, numHashTables=tables, seed=seed).fit(vectors)
    found = model.approxNearestNeighbors(vectors, Vectors.dense([x / size for x in query]), k)
    return found.select("id", (F.col("distCol") * F.col("distCol") / 2.0).alias("distance"))
