"""Token counts: batch encoding in Arrow functions that return lengths only."""

from __future__ import annotations

import functools
import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship

BATCH_BYTES = 4 << 20
PIECE_BYTES = 1 << 20
CACHED_WORDS = 400_000
CACHED_BYTES = 64
_SPACE = re.compile(rb"[\t-\r ]")


@functools.lru_cache(maxsize=2)
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def pieces(text: bytes, size: int = PIECE_BYTES) -> Iterator[bytes]:
    """text in pieces of about size bytes, each cut at a white-space character.

    The tokenizer drops white space and no token crosses it, so the pieces'
    counts add up to the text's. A word longer than size stays whole.
    """
    start = 0
    while len(text) - start > size:
        found = _SPACE.search(text, start + size)
        if not found:
            break
        yield text[start : found.start()]
        start = found.end()
    yield text[start:] if start else text


class WordCounts:
    """Tokens of each word, encoded in batches the first time a worker meets it.

    The store is bounded by CACHED_WORDS and is emptied when full; long words
    are encoded each time.
    """

    def __init__(self, path: str):
        self.path, self.known = path, {}

    def _encode(self, new: list[bytes]) -> list[int]:
        sizes, at, room = [], 0, 0
        tokenizer = _tokenizer(self.path)
        for k, word in enumerate([*new, b""]):
            room += len(word)
            if room > BATCH_BYTES or k == len(new):
                batch = [w.decode("utf-8", "replace") for w in new[at : k + 1]]
                sizes += [len(e) for e in tokenizer.encode_batch(batch, add_special_tokens=False)]
                at, room = k + 1, 0
        return sizes

    def __call__(self, texts: list[bytes]) -> list[int]:
        split = [t.split() for t in texts]
        new = set().union(*split).difference(self.known)
        if len(self.known) + len(new) > CACHED_WORDS:
            self.known.clear()
            new = set().union(*split)
        order = list(new)
        here = dict(zip(order, self._encode(order), strict=True))
        self.known.update(x for x in here.items() if len(x[0]) <= CACHED_BYTES)
        here = {w: n for w, n in here.items() if len(w) > CACHED_BYTES}
        look = self.known.__getitem__ if not here else lambda w: self.known[w] if w in self.known else here[w]
        return [sum(map(look, ws)) for ws in split]


def _balanced(texts: list[bytes]) -> Iterator[tuple[list[int], list[bytes]]]:
    """(row, piece) lists of about PIECE_BYTES each, whatever the rows' lengths."""
    rows, batch, room = [], [], 0
    for row, text in enumerate(texts):
        for piece in pieces(text):
            rows.append(row)
            batch.append(piece)
            room += len(piece)
            if room >= PIECE_BYTES:
                yield rows, batch
                rows, batch, room = [], [], 0
    if batch:
        yield rows, batch


def count_tokens(docs: DataFrame, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text", max_tokens: int = 2048) -> DataFrame:
    """Per row of docs: id, n_bytes, n_tokens and over_limit (n_tokens > max_tokens).

    tokenizer is the path of a tokenizers file whose pre-tokenizer drops white
    space (as word_bpe_49k.json); counts are those of the whole text without
    added special tokens. Null and empty texts count 0; rows that repeat or
    have a null id each give their row; other columns of docs are ignored.
    """
    ship(docs.sparkSession)
    schema = f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, n_bytes bigint, n_tokens bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = WordCounts(tokenizer)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            total = [0] * len(texts)
            for rows, part in _balanced(texts):
                for row, n in zip(rows, counts(part), strict=True):
                    total[row] += n
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(len, texts), pa.int64()), pa.array(total, pa.int64())], names=[id_col, "n_bytes", "n_tokens"])

    texts = docs.select(id_col, F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("_text"))
    return texts.mapInArrow(run, schema).withColumn("over_limit", F.col("n_tokens") > max_tokens)
