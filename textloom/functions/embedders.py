"""Embedders: hashed ones made of built-in functions, and a plug for models."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import EmbeddingError
from ..session import ship
from .tokens import word_ids
from .expr import let
from .vector import normalise

DIMENSION = 384


class Embedder(Protocol):
    """Turns a text column into a vector column."""

    dimension: int

    def column(self, text: Column) -> Column: ...


class WordHashEmbedder:
    """Each word adds ten values taken from its hash to ten dimensions that follow from its place.

    Deterministic, and without any meaning: for tests, offline use and as a
    place holder for a model.
    """

    def __init__(self, dimension: int = DIMENSION, unit: bool = True):
        self.dimension, self.unit = dimension, unit

    def column(self, text: Column) -> Column:
        words = F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")
        value = lambda h, k: F.pmod(F.call_function("shiftrightunsigned", h, F.lit(6 * k)), F.lit(64)) / 64.0 - 0.5
        values = F.flatten(F.transform(words, lambda w: let(F.xxhash64(w), lambda h: F.array(*[value(h, k) for k in range(10)]))))
        # Word i's values stand at 10 i to 10 i + 9; those at d, d + dimension, ... belong to dimension d.
        at = lambda v, d: F.filter(F.sequence(d, F.greatest(d, F.size(v) - 1), F.lit(self.dimension)), lambda p: p < F.size(v))
        total = lambda v, d: F.aggregate(at(v, d), F.lit(0.0), lambda a, p: a + F.get(v, p))
        summed = let(values, lambda v: F.transform(F.sequence(F.lit(0), F.lit(self.dimension - 1)), lambda d: total(v, d)))
        return let(summed, lambda v: normalise(v) if self.unit else v).cast("array<float>")


class ModelEmbedder:
    """A model behind an Arrow function: load() gives a callable from texts to vectors, once per worker."""

    def __init__(self, load: Callable[[], Callable[[list[str]], list[list[float]]]], dimension: int):
        self.load, self.dimension = load, dimension

    def column(self, text: Column) -> Column:
        load = self.load

        @F.pandas_udf("array<float>")
        def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            model = load()
            for texts in batches:
                yield pd.Series([list(map(float, v)) for v in model(texts.fillna("").tolist())])

        return embed(text)


def token_hash(text: Column, dimension: int = DIMENSION, max_length: int = 384) -> Column:
    """Five hashes of each token spread over 20 dimensions each, weaker with the token's place; of length 1."""
    ship(SparkSession.active())

    @F.pandas_udf("array<float>")
    def run(ids: pd.Series) -> pd.Series:
        return ids.map(lambda x: spread(np.asarray(x, np.uint64), dimension).tolist(), na_action="ignore")

    return run(word_ids(text, max_length))


def spread(ids: np.ndarray, dimension: int) -> np.ndarray:
    """The vector of token_hash() for token ids."""
    place = np.arange(len(ids), dtype=np.uint64)[:, None, None]
    j = np.arange(20, dtype=np.uint64)
    h = ids[:, None, None] + np.arange(5, dtype=np.uint64)[None, :, None] * np.uint64(1000) + np.uint64(1)
    for shift, factor in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53)):
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
    d = (h + j * np.uint64(19) + place * np.uint64(17)) % np.uint64(dimension)
    v = (((h >> (j * np.uint64(3))) & np.uint64(7)) / 8.0 - 0.5) / np.sqrt(place + 1.0)
    out = np.bincount(d.ravel().astype(np.int64), v.ravel(), dimension)
    size = np.sqrt((out * out).sum())
    return out / size if size else out


def embed_texts(rows: DataFrame, embedder: Embedder, text_col: str = "text", out_col: str = "embedding") -> DataFrame:
    """rows with a vector; each distinct text is embedded once. Null texts get null."""
    ship(rows.sparkSession)
    if out_col in rows.columns:
        rows = rows.drop(out_col)
    if text_col not in rows.columns:
        raise EmbeddingError(f"no column {text_col}")
    texts = rows.select(F.col(text_col).alias("_t")).where("_t is not null").distinct().withColumn(out_col, embedder.column(F.col("_t")))
    return rows.join(texts, F.col(text_col) == F.col("_t"), "left").drop("_t")
