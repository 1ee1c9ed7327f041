"""MinHash near-dedup: one-permutation hashing, banded buckets, star-shaped candidate edges, exact links."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch
from .graph import components
from .shingles import OnePermutation, WordHash, shingle_set

BINS, BANDS = 128, 32
SHINGLE = 5  # words
PERCENT = 75


def _sets(batch: pa.RecordBatch, known: WordHash) -> Iterator[np.ndarray]:
    for text in batch.column(1).to_pylist():
        yield shingle_set(known.of(text.lower().split()), SHINGLE)


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("_text"))


def signatures(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, fp1 and fp2 (128 bits that name the set) and the bands' keys of each row."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, hashing = WordHash(), OnePermutation(BINS, BANDS)
        for batch in batches:
            n, marks, keys, ends = [], [], [], [0]
            for s in _sets(batch, known):
                n.append(len(s))
                marks.append(np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), np.int64))
                if len(s):
                    keys.append(hashing.keys(hashing.signature(s)))
                ends.append(ends[-1] + (BANDS if len(s) else 0))
            marks = np.array(marks, np.int64).reshape(-1, 2)
            bands = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(keys) if keys else np.zeros(0, np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(marks[:, 0]), pa.array(marks[:, 1]), bands], names=["doc_id", "n_shingles", "fp1", "fp2", "bands"])

    return _texts(docs, id_col, text_col).mapInArrow(run, f"doc_id {kind}, n_shingles bigint, fp1 bigint, fp2 bigint, bands array<bigint>")


def full_sets(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the whole shingle set of each row."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHash()
        for batch in batches:
            sets = list(_sets(batch, known))
            ends = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
            flat = np.concatenate(sets).view(np.int64) if sets else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], names=["doc_id", "set"])

    return _texts(docs, id_col, text_col).mapInArrow(run, f"doc_id {kind}, set array<bigint>")


def _linked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose whole sets are alike enough."""
    left = pairs.join(sets.select(F.col("doc_id").alias("b"), F.col("set").alias("_sb")), "b")
    both = left.join(sets.select(F.col("doc_id").alias("a"), F.col("set").alias("_sa")), "a")
    common = both.select("a", "b", F.size(F.array_intersect("_sa", "_sb")).alias("_c"), (F.size("_sa") + F.size("_sb")).alias("_t"))
    return common.where(100 * F.col("_c") >= PERCENT * (F.col("_t") - F.col("_c"))).select("a", "b")


def _rare_pairs(open_docs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) of different components that can be alike enough, by their rarest shingles.

    open_docs: rep, n, component. Each set is put in order from the rarest
    shingle on. Two sets that are alike enough share a shingle among the first
    n - ceil(0.75 n) + 1 of both, and behind the first that they share enough
    others must follow in both. The filter is exact; near copies that have
    grown apart begin with shingles of their own and so meet nothing, however
    many they are.
    """
    tokens = open_docs.join(sets, F.col("rep") == F.col("doc_id")).select("rep", "n", "component", F.explode("set").alias("token"))
    common = tokens.groupBy(F.col("token").alias("_token")).agg(F.count("*").alias("df")).where("df > 1")
    ordered = tokens.join(common, F.col("token") == F.col("_token")).groupBy("rep").agg(F.first("n").alias("n"), F.first("component").alias("component"), F.array_sort(F.collect_set(F.struct("df", "token"))).alias("s"))
    alone = F.col("n") - F.size("s")  # shingles that no other set has come first
    first = F.expr(f"n - ({PERCENT} * n + 99) div 100 + 1") - alone
    posted = ordered.where(100 * F.size("s") >= PERCENT * F.col("n")).select("rep", "n", "component", alone.alias("_alone"), F.posexplode(F.slice("s", F.lit(1), F.greatest(first, F.lit(0)).cast("int"))).alias("_at", "_x"))
    posted = posted.select("rep", "n", "component", F.col("_x.token").alias("token"), (F.col("_alone") + F.col("_at")).alias("at"))
    x, y = posted.alias("x"), posted.alias("y")
    behind = F.least(F.col("x.n") - F.col("x.at"), F.col("y.n") - F.col("y.at"))
    fits = (100 + PERCENT) * behind >= PERCENT * (F.col("x.n") + F.col("y.n"))
    sizes = 100 * F.least("x.n", "y.n") >= PERCENT * F.greatest("x.n", "y.n")
    met = x.join(y, (F.col("x.token") == F.col("y.token")) & (F.col("x.component") < F.col("y.component")) & sizes & fits)
    return met.select(F.least("x.rep", "y.rep").alias("a"), F.greatest("x.rep", "y.rep").alias("b")).distinct()


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: id, n_shingles, component_id, kept.

    Sets are those of 5-word shingles of the text with A-Z in lower case; sets
    whose intersection is 75 percent of their union or more are linked, and
    component_id is the smallest id reachable. Null and blank texts have empty
    sets and are alone. Rows with a null id are alone too, with a null
    component, and kept. Rows that repeat an id are taken as one document and
    each give a row. Other columns of docs are ignored.

    Texts with equal sets are one class from the first step on, however many.
    A bucket of classes makes a star around the member that meets most others,
    so a bucket of n gives n - 1 edges, and each class is held against its most
    central neighbour. Where a bucket still holds several components, all pairs
    of its members between components that can be alike, by an exact filter,
    are held against each other, so that no link of a bucket is lost; what is
    in one component already needs no further pair.
    """
    spark = docs.sparkSession
    with Scratch(spark) as scratch:
        rows = scratch.cut(signatures(docs, id_col=id_col, text_col=text_col), "signatures")
        named = rows.where("n_shingles > 0 and doc_id is not null")
        classes = scratch.cut(named.groupBy("fp1", "fp2").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands")), "classes")
        buckets = classes.select("rep", F.col("n").cast("int").alias("n"), F.explode("bands").alias("band"))
        met = buckets.groupBy(F.col("band").alias("_band")).agg(F.count("*").alias("size")).where("size > 1")
        shared = scratch.cut(buckets.join(met, F.col("band") == F.col("_band")).drop("_band"), "shared")
        weight = shared.groupBy(F.col("rep").alias("_rep")).agg(F.sum("size").alias("weight"))
        weighed = scratch.cut(shared.join(weight, F.col("rep") == F.col("_rep")).select("band", "rep", F.struct((-F.col("weight")).alias("w"), F.col("rep").alias("c")).alias("rank")), "weighed")
        centres = weighed.groupBy(F.col("band").alias("_band")).agg(F.min("rank").alias("centre"))
        spokes = weighed.join(centres, F.col("band") == F.col("_band")).where("centre.c <> rep").groupBy("rep").agg(F.min("centre").alias("centre"))
        ids = shared.select(F.col("rep").alias("_id")).distinct()
        sets = scratch.cut(full_sets(docs.join(ids.hint("shuffle_hash"), docs[id_col] == ids["_id"], "left_semi"), id_col=id_col, text_col=text_col), "sets")
        stars = spokes.select(F.least("rep", "centre.c").alias("a"), F.greatest("rep", "centre.c").alias("b")).distinct()
        links = scratch.cut(_linked(stars, sets), "links")
        joined = scratch.cut(components(scratch, links), "components")
        placed = shared.join(joined, shared["rep"] == joined["node"], "left").select("band", "rep", "n", F.coalesce("component", "rep").alias("component"))
        mixed = placed.groupBy(F.col("band").alias("_band")).agg(F.min("component").alias("_lo"), F.max("component").alias("_hi")).where("_lo < _hi").select("_band")
        open_docs = scratch.cut(placed.join(mixed, F.col("band") == F.col("_band")).select("rep", "n", "component").distinct(), "open")
        pairs = scratch.cut(_rare_pairs(open_docs, sets), "pairs")
        more = scratch.cut(_linked(pairs, sets), "more")
        whole = components(scratch, links.union(more))
        found = classes.join(whole, classes["rep"] == whole["node"], "left").select(F.col("fp1").alias("_f1"), F.col("fp2").alias("_f2"), F.coalesce("component", "rep").alias("_component"))
        out = rows.drop("bands").join(found, (F.col("fp1") == F.col("_f1")) & (F.col("fp2") == F.col("_f2")) & F.col("doc_id").isNotNull(), "left")
        component = F.coalesce("_component", "doc_id")
        return scratch.keep(out.select(F.col("doc_id").alias(id_col), "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept")))
