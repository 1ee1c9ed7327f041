"""Substring dedup: prefix-partitioned suffix trees over the suffixes that can repeat, by their words."""

from __future__ import annotations

import hashlib
import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, least_of_group
from .shingles import WordHash, mix

WINDOW = 50  # words; fixed value
PREFIX = 8  # words of the prefixes by which suffixes are first split
CHUNK_WORDS = 200_000
#: Suffixes of one tree, about: what one task holds in memory at a time.
TREE_SUFFIXES = 200_000
#: A prefix that more suffixes begin with is prolonged to whole windows.
HOT_SUFFIXES = 100_000
_LEFT, _RIGHT = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F)


def _join(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return mix(left * _LEFT + right * _RIGHT)


def window_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """A hash of each window of size words, by doubling."""
    width, now = 1, hashes
    while width * 2 <= size:
        now = _join(now[:-width] if width < len(now) else now[:0], now[width:])
        width *= 2
    rest = size - width
    return _join(now[: max(0, len(now) - rest)], now[rest:]) if rest else now


def sliding_least(values: np.ndarray, size: int) -> np.ndarray:
    """The least of each size consecutive values."""
    width, now = 1, values
    while width * 2 <= size:
        now = np.minimum(now[: max(0, len(now) - width)], now[width:])
        width *= 2
    rest = size - width
    return np.minimum(now[: max(0, len(now) - rest)], now[rest:]) if rest else now


def _chunks(texts: list[bytes], known: WordHash) -> Iterator[tuple[list[int], list[list[bytes]], np.ndarray, np.ndarray]]:
    """(rows, their words, starts, word hashes) of as many texts at a time as have about CHUNK_WORDS words."""
    rows, split, room = [], [], 0
    for row, text in enumerate([*texts, None]):
        if text is not None:
            rows.append(row)
            split.append(text.split())
            room += len(split[-1])
        if rows and (text is None or room >= CHUNK_WORDS):
            starts = np.concatenate([[0], np.cumsum([len(w) for w in split])])
            yield rows, split, starts, known.of(list(itertools.chain.from_iterable(split)))
            rows, split, room = [], [], 0


def outline(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, content, n_words, sha256 of its words, two longs naming them, and the prefixes of its windows with how many have each."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHash()
        for batch in batches:
            n, shas, marks, prefixes, sizes, ends = [], [], [], [], [], [0]
            for _, split, starts, hashes in _chunks(batch.column(2).to_pylist(), known):
                least = sliding_least(window_hashes(hashes, PREFIX), WINDOW - PREFIX + 1) if len(hashes) >= WINDOW else hashes[:0]
                for k, ws in enumerate(split):
                    own, size = np.unique(least[starts[k] : starts[k + 1] - WINDOW + 1] if len(ws) >= WINDOW else hashes[:0], return_counts=True)
                    digest = hashlib.sha256(b" ".join(ws))
                    n.append(len(ws))
                    shas.append(digest.hexdigest())
                    marks.append(np.frombuffer(digest.digest()[:16], np.int64))
                    prefixes.append(own.view(np.int64))
                    sizes.append(size)
                    ends.append(ends[-1] + len(own))
            marks = np.array(marks, np.int64).reshape(-1, 2)
            flat = pa.array(np.concatenate(prefixes) if prefixes else np.zeros(0, np.int64))
            many = pa.array((np.concatenate(sizes) if sizes else np.zeros(0, np.int64)).astype(np.int32))
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([flat, many], names=["prefix", "n"]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(shas, pa.string()), pa.array(marks[:, 0]), pa.array(marks[:, 1]), lists], names=["doc_id", "content", "n_words", "sha", "fp1", "fp2", "prefixes"])

    return docs.mapInArrow(run, f"doc_id {kind}, content bigint, n_words bigint, sha string, fp1 bigint, fp2 bigint, prefixes array<struct<prefix:bigint,n:int>>")


def _prefix_runs(docs: DataFrame, schema: str, emit) -> DataFrame:
    """emit(start of the run, its windows, the document's words) for each run of windows with one of the wanted prefixes.

    docs: doc_id, content, _text, _prefixes. emit gives a row's values after
    doc_id, content, prefix and start.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHash()
        for batch in batches:
            wanted = batch.column(3).to_pylist()
            keys, made = [], []
            for rows, split, starts, hashes in _chunks(batch.column(2).to_pylist(), known):
                if len(hashes) < WINDOW:
                    continue
                least = sliding_least(window_hashes(hashes, PREFIX), WINDOW - PREFIX + 1).view(np.int64)
                for k, row in enumerate(rows):
                    if len(split[k]) < WINDOW:
                        continue
                    own = least[starts[k] : starts[k + 1] - WINDOW + 1]
                    edges = np.concatenate([[0], np.flatnonzero(own[1:] != own[:-1]) + 1, [len(own)]])
                    heads = own[edges[:-1]]
                    for r in np.flatnonzero(np.isin(heads, np.array(wanted[row], np.int64))).tolist():
                        keys.append(row)
                        made.append((int(heads[r]), int(edges[r]), *emit(int(edges[r]), int(edges[r + 1] - edges[r]), split[k])))
                if len(made) >= 2000:
                    yield from _table(batch, keys, made, fields)
                    keys, made = [], []
            yield from _table(batch, keys, made, fields)

    fields = schema.split(", ")
    return docs.mapInArrow(run, f"doc_id {kind}, content bigint, prefix bigint, start bigint, {schema}")


_KINDS = {"int": pa.int32(), "binary": pa.binary(), "array<binary>": pa.list_(pa.binary())}


def _table(batch: pa.RecordBatch, keys: list[int], made: list[tuple], fields: list[str]) -> Iterator[pa.RecordBatch]:
    columns = list(zip(*made, strict=True)) or [[]] * (2 + len(fields))
    kinds = [pa.int64(), pa.int64(), *[_KINDS[f.split()[1]] for f in fields]]
    arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
    yield pa.RecordBatch.from_arrays([*[batch.column(k).take(pa.array(keys, pa.int64())) for k in (0, 1)], *arrays], names=["doc_id", "content", "prefix", "start", *[f.split()[0] for f in fields]])


def suffixes(docs: DataFrame) -> DataFrame:
    """doc_id, content, prefix, start, n, words: the words of each run of n windows with one of the wanted prefixes.

    Its windows are n suffixes, cut at the depth that matters.
    """
    return _prefix_runs(docs, "n int, words binary", lambda at, n, ws: (n, b" ".join(ws[at : at + n + WINDOW - 1])))


def prolonged(docs: DataFrame) -> DataFrame:
    """doc_id, content, prefix, start, windows: the 128-bit digests of the words of each of a run's windows."""

    def digests(at: int, n: int, ws: list[bytes]) -> tuple[list[bytes]]:
        return ([xxhash.xxh3_128_digest(b" ".join(ws[k : k + WINDOW])) for k in range(at, at + n)],)

    return _prefix_runs(docs, "windows array<binary>", digests)


def _runs(doc: np.ndarray, content: np.ndarray, place: np.ndarray) -> pa.Table:
    """doc_id, content, start, stop of the words under windows at these places, overlapping ones merged."""
    order = np.lexsort((place, content, doc))
    doc, content, place = doc[order], content[order], place[order]
    new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (content[1:] != content[:-1]) | (place[1:] > place[:-1] + WINDOW)])[: len(doc)]
    at = np.flatnonzero(new)
    last = np.concatenate([at[1:], [len(doc)]])[: len(at)] - 1
    return pa.table({"doc_id": pa.array(doc[at], pa.int64()), "content": pa.array(content[at], pa.int64()), "start": pa.array(place[at], pa.int64()), "stop": pa.array(place[last] + WINDOW, pa.int64())})


def suffix_ranks(ids: np.ndarray, depth: int) -> np.ndarray:
    """The rank of each suffix among all by its first depth words, equal ones with equal ranks; ids by their words' order.

    By doubling: the ranks of two halves, one behind the other, give those of
    the whole. Places less than depth from the end are left out.
    """
    width, now = 1, ids.astype(np.int64)
    while width < depth:
        step = min(width, depth - width)
        pairs = now[:-step] * np.int64(len(ids) + 1) + now[step:]
        now = np.unique(pairs, return_inverse=True)[1].astype(np.int64)
        width += step
    return now


def subtree(group: pa.Table) -> pa.Table:
    """Covered runs of the suffixes of one group of prefixes.

    The suffixes are sorted by their words, down to WINDOW of them, which gives
    the tree's leaves in order; those of equal rank hang under one internal
    node of that depth, which is a maximal repeat's node or lies above one. The
    node's smallest document keeps the words, all others give them up.
    """
    if not group.num_rows:
        return _runs(*[np.zeros(0, np.int64)] * 3)
    split = [x.split(b" ") for x in group.column("words").to_pylist()]
    sizes = group.column("n").to_numpy().astype(np.int64)
    flat = list(itertools.chain.from_iterable(split))
    order = {w: k for k, w in enumerate(sorted(set(flat)))}
    ids = np.fromiter(map(order.__getitem__, flat), np.int64, len(flat))
    del flat, order
    ranks = suffix_ranks(ids, WINDOW)
    inside = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    bases = np.cumsum([0, *map(len, split[:-1])])
    doc, content = (np.repeat(group.column(c).to_numpy(), sizes) for c in ("doc_id", "content"))
    place = np.repeat(group.column("start").to_numpy(), sizes) + inside
    node = ranks[np.repeat(bases, sizes) + inside]
    leaves = np.lexsort((doc, node))
    doc, content, place, node = doc[leaves], content[leaves], place[leaves], node[leaves]
    new = np.concatenate([[True], node[1:] != node[:-1]])
    first = doc[np.flatnonzero(new)][np.cumsum(new) - 1]
    again = doc > first
    return _runs(doc[again], content[again], place[again])


def cut_out(rows: DataFrame) -> DataFrame:
    """Of rows doc_id, content, _text, _spans (arrays of start, stop): doc_id, content, n_removed, kept_sha256, kept_text."""
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            removed, shas, texts = [], [], []
            for text, spans in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                ws = text.split()
                stay = bytearray(b"\x01") * len(ws)
                for s in spans:
                    stay[s["start"] : s["stop"]] = bytes(s["stop"] - s["start"])
                kept = b" ".join(itertools.compress(ws, stay))
                removed.append(len(ws) - sum(stay))
                shas.append(hashlib.sha256(kept).hexdigest())
                texts.append(kept)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(removed, pa.int64()), pa.array(shas, pa.string()), pa.array(texts, pa.binary()).cast(pa.string())], names=["doc_id", "content", "n_removed", "kept_sha256", "kept_text"])

    return rows.mapInArrow(run, f"doc_id {kind}, content bigint, n_removed bigint, kept_sha256 string, kept_text string")


def repeated_spans(docs: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(outline with column rep, spans by doc_id and content) of rows doc_id, content, _text; see remove_repeats()."""
    rows = scratch.cut(outline(docs), "outline")
    known = scratch.cut(least_of_group(rows, ["fp1", "fp2"], F.col("doc_id"), F.col("doc_id"), "rep").drop("fp1", "fp2"), "known")
    held = known.where("doc_id = rep").select("doc_id", "content", F.explode("prefixes").alias("x")).select("doc_id", "content", "x.prefix", "x.n")
    counted = held.groupBy(F.col("prefix").alias("_prefix")).agg(F.min("doc_id").alias("_lo"), F.max("doc_id").alias("_hi"), F.sum("n").alias("_n")).where("_lo < _hi")
    counted = scratch.cut(counted.select("_prefix", "_n", (F.col("_n") > HOT_SUFFIXES).alias("_hot")), "prefixes")
    wanted = scratch.cut(held.join(counted, F.col("prefix") == F.col("_prefix")).groupBy(F.col("doc_id").alias("_doc"), F.col("content").alias("_of"), "_hot").agg(F.collect_set("prefix").alias("_prefixes")), "wanted")

    def texts(hot: bool) -> DataFrame:
        some = wanted.where(F.col("_hot") == hot).drop("_hot")
        return docs.join(some.hint("shuffle_hash"), (F.col("doc_id") == F.col("_doc")) & (F.col("content") == F.col("_of"))).select("doc_id", "content", "_text", "_prefixes")

    cold, hot = (counted.agg(*[F.sum(F.when(F.col("_hot") == h, F.col("_n"))).alias(f"n{h}") for h in (False, True)]).first())
    trees = max(1, math.ceil((cold or 0) / TREE_SUFFIXES))
    small = suffixes(texts(False)).withColumn("_tree", F.pmod(F.xxhash64("prefix"), F.lit(trees)))
    spans = small.select("_tree", F.col("doc_id").cast("bigint").alias("doc_id"), "content", "start", "n", "words").groupBy("_tree").applyInArrow(subtree, "doc_id bigint, content bigint, start bigint, stop bigint")
    if hot:
        # Under a hot prefix the suffixes are split by the whole window: the least document of each is found in cells.
        wide = prolonged(texts(True)).select("doc_id", "content", F.posexplode("windows").alias("_k", "window"), "start")
        wide = scratch.cut(wide.select("doc_id", "content", "window", (F.col("start") + F.col("_k")).alias("place")), "windows")
        again = least_of_group(wide, ["window"], F.col("doc_id"), F.col("doc_id"), "_first").where("doc_id > _first")
        spans = spans.union(again.select(F.col("doc_id").cast("bigint"), "content", F.col("place").alias("start"), (F.col("place") + WINDOW).alias("stop")))
    by_doc = spans.groupBy(F.col("doc_id").alias("_doc"), F.col("content").alias("_of")).agg(F.array_sort(F.collect_set(F.struct("start", "stop"))).alias("_spans"))
    return known, scratch.cut(by_doc, "spans")


def remove_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """Per row of docs: id, n_words, n_removed, kept_sha256 (and kept_text if asked for).

    A word goes if a window of 50 words over it also starts in a document of a
    smaller id; windows are judged on the input. Ids must be integers. Null and
    blank texts have no words; texts under 50 words stay. Rows that repeat an
    id each give a row by their own text, and take no words from each other;
    rows with a null id neither lose nor take words. Other columns of docs are ignored.

    Suffixes are split by variable-length prefixes. Every window of 50 words
    has one prefix: the least hash among its 8-word runs, so equal windows
    share it, and it decides nothing but where a suffix goes. Prefixes of one
    document only have no internal node and are dropped before any suffix is
    made. The others' suffixes go, as runs of words, to trees of about
    TREE_SUFFIXES, each built in one task by sorting them by their words; a
    prefix of more than HOT_SUFFIXES suffixes is prolonged to the whole window,
    named by 128 bits, and its nodes are found by counting, in cells. Exact
    copies of a document's words are settled by 128 bits of their SHA-256
    beforehand.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    source = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("content"), text.cast("binary").alias("_text"))
    with Scratch(docs.sparkSession) as scratch:
        known, spans = repeated_spans(source, scratch)
        texts = source.join(spans.hint("shuffle_hash"), (F.col("doc_id") == F.col("_doc")) & (F.col("content") == F.col("_of"))).select("doc_id", "content", "_text", "_spans")
        made = cut_out(texts)
        made = scratch.cut((made if with_text else made.drop("kept_text")).dropDuplicates(["doc_id", "content"]).withColumnsRenamed({"doc_id": "_doc", "content": "_of"}), "made")
        joined = known.drop("prefixes").join(made, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("content") == F.col("_of")), "left")
        copy = F.coalesce((F.col("doc_id") > F.col("rep")) & (F.col("n_words") >= WINDOW), F.lit(False))
        out = [
            F.col("doc_id").alias(id_col),
            "n_words",
            F.when(copy, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0).cast("bigint"))).alias("n_removed"),
            F.when(copy, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
        ]
        if not with_text:
            return scratch.keep(joined.select(*out))
        own = source.select(F.col("doc_id").alias("_id"), F.col("content").alias("_own_of"), F.array_join(F.filter(F.split(F.translate(F.col("_text").cast("string"), "\t\n\x0b\x0c\r", "     "), " "), lambda x: x != ""), " ").alias("_own")).dropDuplicates(["_id", "_own_of"])
        joined = joined.join(own, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("content") == F.col("_own_of")), "left")
        return scratch.keep(joined.select(*out, F.when(copy, F.lit("")).otherwise(F.coalesce("kept_text", "_own")).alias("kept_text")))
