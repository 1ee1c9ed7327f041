"""Best-fit packing: length patterns fitted to the histogram by non-negative least squares."""

from __future__ import annotations

import base64
import functools
import math
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship
from .common import Scratch, salted_slots

PIECES = "doc_id {0}, piece int, start bigint, length bigint, ids_crc32 bigint"
CELL_ROWS = 250_000
LEAST_SALTS = 16
#: A plan of more rows than this is joined without a broadcast hint.
BROADCAST_ROWS = 200_000
#: Up to here both libraries sort characters into the same classes; a test holds them against each other.
PLAIN = re.compile(r"[^\x00-ɏ‐-‧]")


class Encoder:
    """Ids by a tokenizers file: for texts of common characters by the same merges in a quicker library.

    ranks is the path of the file's vocabulary as ranks, or None. Texts with a
    special string, other characters, or a very long run without white space
    go through the tokenizers file itself.
    """

    def __init__(self, path: str, ranks: str | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(path)
        self.special = [t.content for t in self.slow.get_added_tokens_decoder().values()]
        self.quick = None
        if ranks:
            import public_tokenizers
            import tiktoken

            with open(ranks, "rb") as lines:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            self.quick = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})
        self.long_run = re.compile(r"\S{2000}|\s{2000}")

    def __call__(self, text: str) -> np.ndarray:
        if self.quick and not PLAIN.search(text) and not any(s in text for s in self.special) and not self.long_run.search(text):
            return self.quick.encode_to_numpy(text, disallowed_special=())
        return np.asarray(self.slow.encode(text, add_special_tokens=False).ids, dtype=np.uint32)


@functools.lru_cache(maxsize=2)
def encoder(path: str, ranks: str | None) -> Encoder:
    return Encoder(path, ranks)


def cuts(total: int, size: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: the first takes what full pieces leave over."""
    first = total % size or size
    return [(0, first), *[(at, size) for at in range(first, total, size)]]


def pieces(docs: DataFrame, tokenizer: str, *, ranks: str | None = None, size: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of each piece of at most size tokens, and the ids if asked for."""
    ship(docs.sparkSession)
    schema = PIECES.format(docs.schema[id_col].dataType.simpleString()) + ", ids array<int>" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer, ranks)
        for batch in batches:
            keys, out, ids_out = [], [], []
            for row, text in enumerate(batch.column(1).to_pylist()):
                ids = np.append(encode(text), end_id).astype("<u4")
                for k, (start, length) in enumerate(cuts(len(ids), size)):
                    part = ids[start : start + length]
                    keys.append(row)
                    out.append((k, start, length, zlib.crc32(part.tobytes())))
                    if with_ids:
                        ids_out.append(part.astype(np.int32))
            columns = np.array(out, dtype=np.int64).reshape(-1, 4).T
            arrays = [batch.column(0).take(pa.array(keys, pa.int64())), pa.array(columns[0].astype(np.int32)), *map(pa.array, columns[1:])]
            if with_ids:
                arrays.append(pa.array(ids_out, pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids])

    return docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text")).mapInArrow(run, schema)


def patterns(present: np.ndarray, size: int) -> np.ndarray:
    """All patterns of one to three present lengths that fill size exactly, as rows of lengths; 0: no document."""
    there = np.zeros(size + 1, bool)
    there[present] = True
    a, b = np.meshgrid(present, np.append(present, 0), indexing="ij")
    c = size - a - b
    fits = (b <= a) & (c >= 0) & (c <= b)
    fits[fits] = (c[fits] == 0) | there[c[fits]]
    return np.stack([a[fits], b[fits], c[fits]], axis=1)


def fit(counts: np.ndarray, rows: np.ndarray, rounds: int = 40) -> tuple[np.ndarray, np.ndarray]:
    """(columns used, repeats): non-negative least squares of counts by the patterns in rows.

    The active-set method, taking in per round the patterns of steepest descent
    with no length in common, and solving on the active set by conjugate
    gradients: each pattern has three entries, so nothing dense is made. The
    work depends on the number of lengths, not of documents.
    """
    target = counts.astype(float)
    target[0] = 0
    active, x = np.zeros(0, np.int64), np.zeros(0)

    def times(cols: np.ndarray, v: np.ndarray) -> np.ndarray:
        out = np.bincount(rows[cols].ravel(), np.repeat(v, rows.shape[1]), len(target))
        out[0] = 0
        return out

    def solve(cols: np.ndarray, start: np.ndarray) -> np.ndarray:
        z, r = start.copy(), target - times(cols, start)
        s = r[rows[cols]].sum(1)
        p, gamma = s.copy(), float(s @ s)
        for _ in range(150):
            if gamma < 1e-9 * max(1.0, float(target @ target)):
                break
            q = times(cols, p)
            alpha = gamma / max(float(q @ q), 1e-12)
            z, r = z + alpha * p, r - alpha * q
            s = r[rows[cols]].sum(1)
            gamma, old = float(s @ s), gamma
            p = s + gamma / old * p
        return z

    for _ in range(rounds):
        slope = (target - times(active, x))[rows].sum(1)
        slope[active] = 0
        best = np.argsort(-slope, kind="stable")[:8000]
        used, picks = set(), []
        for k in best[slope[best] > 0.5]:
            lengths = set(rows[k].tolist()) - {0}
            if not lengths & used:
                used |= lengths
                picks.append(k)
        if not picks:
            break
        active, x = np.append(active, picks), np.append(x, np.zeros(len(picks)))
        while True:
            z = solve(active, x)
            if (z > 1e-9).all() or not len(z):
                x = z
                break
            down = z <= 1e-9
            step = min(1.0, float((x[down] / np.maximum(x[down] - z[down], 1e-12)).min()))
            x = x + step * (z - x)
            stay = x > 1e-9
            stay &= ~(down & (x <= np.maximum(1e-9, x[down].min())))
            active, x = active[stay], x[stay]
    return active, x


def best_fit(counts: np.ndarray, size: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Best-fit decreasing on a histogram: (repeats, [(length, how many), ...]) until counts are used up."""
    left, out = counts.copy(), []
    left[0] = 0
    while left.any():
        room, parts, now = size, [], left.copy()
        while room and len(there := np.flatnonzero(now[: room + 1])):
            length = int(there[-1])
            n = min(room // length, int(now[length]))
            parts.append((length, n))
            now[length], room = 0, room - n * length
        repeats = min(int(left[length]) // n for length, n in parts)
        for length, n in parts:
            left[length] -= repeats * n
        out.append((repeats, parts))
    return out


def plan(counts: np.ndarray, size: int) -> list[tuple[int, int, int, int, int, int]]:
    """Rows (length, first slot, last slot + 1, how many a sequence, first sequence, offset) that place every piece."""
    left, made = counts.astype(np.int64), []
    present = np.flatnonzero(left)
    rows = patterns(present[present > 0], size)
    if len(rows):
        columns, repeats = fit(left, rows)
        for k in np.argsort(-repeats, kind="stable"):
            lengths, many = np.unique(rows[columns[k]][rows[columns[k]] > 0], return_counts=True)
            n = min(int(repeats[k] + 1e-6), int((left[lengths] // many).min()))
            if n > 0:
                left[lengths] -= n * many
                made.append((n, list(zip(lengths.tolist(), many.tolist(), strict=True))[::-1]))
    made += best_fit(left, size)
    taken, first, out = {}, 0, []
    for repeats, parts in made:
        offset = 0
        for length, n in parts:
            low = taken.get(length, 0)
            taken[length] = low + repeats * n
            out.append((length, low, taken[length], n, first, offset))
            offset += length * n
        first += repeats
    return out


def pack(docs: DataFrame, tokenizer: str, *, ranks: str | None = None, size: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A document is its text's ids and end_id (null and empty texts: end_id
    alone). Longer ones than size are cut into pieces of size, the first of
    which may be shorter. Pieces fill sequences by patterns; each sequence's
    offsets are gapless from 0. Repeated rows are packed as often as they
    occur, null ids like any other; other columns of docs are ignored.

    Texts are read and encoded once. The driver gets the histogram of lengths
    (size rows at most) and returns a plan whose rows depend on the number of
    lengths, not of documents; the pieces find their row by length and rank.
    """
    spark = docs.sparkSession
    with Scratch(spark) as scratch:
        rows = scratch.cut(pieces(docs, tokenizer, ranks=ranks, size=size, end_id=end_id, id_col=id_col, text_col=text_col), "pieces")
        counts = np.zeros(size + 1, np.int64)
        for length, n in rows.groupBy("length").count().collect():
            counts[length] = n
        salts = max(LEAST_SALTS, math.ceil(int(counts.max()) / CELL_ROWS))
        salt = F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts))
        slots = salted_slots(scratch, rows, "length", ["doc_id", "piece", "ids_crc32"], salt, "_slot")
        made = plan(counts, size)
        table = spark.createDataFrame(made, "_length bigint, _low bigint, _high bigint, _many bigint, _first bigint, _offset bigint")
        table = F.broadcast(table) if len(made) <= BROADCAST_ROWS else table
        here = F.col("_slot") - F.col("_low")
        placed = slots.join(table, (F.col("length") == F.col("_length")) & (F.col("_slot") >= F.col("_low")) & (F.col("_slot") < F.col("_high")))
        sequence = F.col("_first") + F.expr("(_slot - _low) div _many")
        offset = F.col("_offset") + (here % F.col("_many")) * F.col("length")
        return scratch.keep(placed.select("doc_id", "piece", "start", "length", "ids_crc32", sequence.alias("sequence_id"), offset.alias("offset")))


def sequences(docs: DataFrame, placed: DataFrame, tokenizer: str, **options) -> DataFrame:
    """sequence_id and its token ids: the pieces that pack() placed, encoded again and put in order."""
    ids = pieces(docs, tokenizer, with_ids=True, **options).select("doc_id", "piece", "ids_crc32", "ids").distinct()
    joined = placed.join(ids, ["doc_id", "piece", "ids_crc32"])
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return joined.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda x: x["ids"])).alias("ids"))
