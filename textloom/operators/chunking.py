"""Chunking: one row a document to one row a chunk, inside the plan."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import ChunkSettings, Strategy
from ..errors import ConfigError
from ..functions.text import clean
from ..session import ship

CHUNK = "array<struct<text:string,offset:int,length:int>>"


def _bytes(x: Column) -> Column:
    return F.octet_length(x)


def character_chunks(text: Column, s: ChunkSettings) -> Column:
    """Windows of size characters, each overlap before the last one's end; short ones only at the text's end."""
    step = s.size - s.overlap if s.overlap < s.size else s.size
    n = F.length(text)
    whole = F.array(F.struct(text.alias("text"), F.lit(0).alias("offset"), _bytes(text).alias("length")))
    piece = lambda at: F.substring(text, at + 1, F.lit(s.size))
    made = F.transform(F.sequence(F.lit(0), n - 1, F.lit(step)), lambda at: F.struct(piece(at).alias("text"), at.alias("offset"), _bytes(piece(at)).alias("length")))
    kept = F.filter(made, lambda c: (F.length(c["text"]) >= s.min_size) | (c["offset"] + s.size >= n))
    return F.when(n <= s.size, whole).otherwise(kept).cast(CHUNK)


def _pack(pieces: Column, s: ChunkSettings, joiner: str) -> Column:
    """Pieces joined while they fit into size; what stays under min_size is dropped."""
    none = F.array().cast("array<struct<text:string,offset:int>>")
    start = F.struct(none.alias("done"), F.lit("").alias("cur"), F.lit(0).alias("co"), F.lit(0).alias("so"))
    emit = lambda a: F.when(_bytes(a["cur"]) >= s.min_size, F.array(F.struct(a["cur"].alias("text"), a["co"].alias("offset")))).otherwise(none)

    def step(a: Column, x: Column) -> Column:
        full = (a["cur"] != "") & (_bytes(a["cur"]) + len(joiner) + _bytes(x) > s.size)
        grown = F.when(a["cur"] == "", x).otherwise(F.concat(a["cur"], F.lit(joiner), x))
        return F.struct(F.when(full, F.concat(a["done"], emit(a))).otherwise(a["done"]).alias("done"), F.when(full, x).otherwise(grown).alias("cur"), F.when(full, a["so"]).otherwise(a["co"]).alias("co"), (a["so"] + _bytes(x) + len(joiner)).alias("so"))

    last = lambda a: F.when((a["cur"] != "") & (_bytes(a["cur"]) >= s.min_size), F.concat(a["done"], F.array(F.struct(a["cur"].alias("text"), a["co"].alias("offset"))))).otherwise(a["done"])
    packed = F.aggregate(pieces, start, step, last)
    return F.transform(packed, lambda c: F.struct(c["text"].alias("text"), c["offset"].alias("offset"), _bytes(c["text"]).alias("length"))).cast(CHUNK)


def sentence_chunks(text: Column, s: ChunkSettings) -> Column:
    """Sentences packed greedily; the signs between them go, as do chunks under min_size."""
    parts = F.filter(F.transform(F.split(text, r"[.!?]+(?U)\s+"), lambda x: F.trim(x)), lambda x: x != "")
    return _pack(parts, s, " ")


def paragraph_chunks(text: Column, s: ChunkSettings) -> Column:
    """Paragraphs packed greedily. Cleaned text has none left: it is one."""
    parts = F.filter(F.transform(F.split(text, r"\n(?U)\s*\n"), lambda x: F.trim(x)), lambda x: x != "")
    return _pack(parts, s, "\n\n")


def fold_words(text: str, s: ChunkSettings) -> list[tuple[str, int, int]]:
    """(text, offset, length) of the chunks of words packed greedily; see token_chunks()."""
    again, done, cur, size, begin, seen = s.overlap // 10, [], [], 0, 0, 0
    for word in text.split(" "):
        if not word:
            continue
        n = len(word) if word.isascii() else len(word.encode())
        if cur and size + 1 + n > s.size:
            if size >= s.min_size:
                done.append((" ".join(cur), begin, size))
            tail = cur[-again:] if again else []
            size = len(" ".join(tail).encode())
            begin, cur = max(0, seen - size), tail
        size += n + (1 if cur else 0)
        cur.append(word)
        seen += n + 1
    if cur and size >= s.min_size:
        done.append((" ".join(cur), begin, seen - begin))
    return done


def token_chunks(text: Column, s: ChunkSettings) -> Column:
    """Words packed greedily; a new chunk begins with the last overlap div 10 words of the one before.

    The last chunk's length is what is left from its offset, by the running
    count. An Arrow function: as a fold of expressions it copies the chunk with
    every word.
    """
    ship(SparkSession.active())

    @F.pandas_udf(CHUNK)
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [{"text": a, "offset": b, "length": c} for a, b, c in fold_words(t, s)], na_action="ignore")

    return run(text)


_MAKERS = {Strategy.CHARACTER: character_chunks, Strategy.SENTENCE: sentence_chunks, Strategy.PARAGRAPH: paragraph_chunks, Strategy.TOKEN: token_chunks}


def chunk_documents(docs: DataFrame, settings: ChunkSettings = ChunkSettings(), *, text_col: str = "text", raw: bool = False, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep, chunk_no (from 0), text, offset, length of each chunk. raw: split before white space is collapsed.

    Null texts have no chunks. The fold runs in the scan's own stage, without
    an exchange.
    """
    if settings.strategy not in _MAKERS:
        raise ConfigError(f"unknown strategy {settings.strategy}")
    text = F.trim(F.col(text_col)) if raw else clean(F.col(text_col))
    rows = docs.select(*keep, text.alias("_clean"))
    made = rows.select(*keep, F.posexplode(_MAKERS[settings.strategy](F.col("_clean"), settings)).alias("chunk_no", "c"))
    return made.select(*keep, "chunk_no", F.col("c.text").alias("text"), F.col("c.offset").alias("offset"), F.col("c.length").alias("length"))


def number_chunks(chunks: DataFrame, order: str = "doc_id", start: int = 0, span: int = 4096) -> DataFrame:
    """chunks with id: dense from start, by document, then chunk_no. Documents have integer ids.

    Only a row a document passes the running sums: counts are summed within
    ranges of span ids first, then over the ranges, and a chunk's id is its
    document's base plus chunk_no.
    """
    counts = chunks.groupBy(F.col(order).alias("_doc")).agg(F.count("*").alias("_n")).withColumn("_range", F.expr(f"_doc div {span}"))
    within = Window.partitionBy("_range").orderBy("_doc").rowsBetween(Window.unboundedPreceding, -1)
    inside = counts.withColumn("_in", F.coalesce(F.sum("_n").over(within), F.lit(0)))
    over = Window.orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    sums = counts.groupBy(F.col("_range").alias("_r")).agg(F.sum("_n").alias("_total"))
    bases = sums.withColumn("_before", F.coalesce(F.sum("_total").over(over), F.lit(0)))
    based = inside.join(bases, F.col("_range") == F.col("_r")).select("_doc", (F.col("_in") + F.col("_before") + start).alias("_base"))
    return chunks.join(based, chunks[order] == based["_doc"]).withColumn("id", F.col("_base") + F.col("chunk_no")).drop("_doc", "_base")
