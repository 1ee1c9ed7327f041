"""Readers: text, markdown, PDF, conversations."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import PdfError, TextError
from ..functions.text import file_extension, strip_markdown
from ..session import ship

#: Takes a PDF's bytes, yields (page from 1, text).
PdfExtractor = Callable[[bytes], Iterator[tuple[int, str]]]


def read_texts(spark: SparkSession, *paths: str) -> DataFrame:
    """source, text of whole files."""
    return spark.read.text(list(paths), wholetext=True).select(F.col("_metadata.file_path").alias("source"), F.col("value").alias("text"))


def read_markdown(spark: SparkSession, *paths: str, multiline: bool = False) -> DataFrame:
    """text of whole files without markdown signs; the source is null."""
    return read_texts(spark, *paths).select(F.lit(None).cast("string").alias("source"), strip_markdown(F.col("text"), multiline).alias("text"))


def read_binary(spark: SparkSession, *paths: str) -> DataFrame:
    """source, content and is_pdf: whether the first bytes are %PDF."""
    files = spark.read.format("binaryFile").load(list(paths))
    return files.select(F.col("path").alias("source"), "content", (F.substring("content", 1, 4) == F.lit(b"%PDF")).alias("is_pdf"))


def read_pdf(spark: SparkSession, *paths: str, extractor: PdfExtractor | None = None) -> DataFrame:
    """source, page, text of each page with text. The extractor is a plug-in: none comes with the library."""
    if extractor is None:
        raise PdfError("reading PDF text needs an extractor")
    import pandas as pd

    ship(spark)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(s, page, text) for s, content in zip(batch["source"], batch["content"], strict=True) for page, text in extractor(bytes(content)) if text.strip()]
            yield pd.DataFrame(rows, columns=["source", "page", "text"])

    return read_binary(spark, *paths).where("is_pdf").select("source", "content").mapInPandas(run, "source string, page int, text string")


def pdf_title(pages: DataFrame) -> DataFrame:
    """source, page_count and title: the first of the first page's first three lines of 11 to 199 bytes."""
    lines = F.transform(F.slice(F.split("text", "\n"), 1, 3), lambda x: F.trim(x))
    good = F.filter(lines, lambda x: (F.octet_length(x) > 10) & (F.octet_length(x) < 200))
    first = F.min_by(F.get(good, F.lit(0)), "page")
    return pages.groupBy("source").agg(F.max("page").alias("page_count"), first.alias("title"))


def read_by_suffix(spark: SparkSession, *paths: str, extractor: PdfExtractor | None = None) -> DataFrame:
    """source, page, text: PDF through the extractor, everything else as plain text."""
    files = spark.read.format("binaryFile").load(list(paths)).select(F.col("path").alias("source"), "content")
    texts = files.where(~F.coalesce(file_extension(F.col("source")) == "pdf", F.lit(False)))
    out = texts.select("source", F.lit(None).cast("int").alias("page"), F.decode("content", "UTF-8").alias("text"))
    if extractor is not None and any(p.lower().endswith(".pdf") for p in paths):
        out = out.unionByName(read_pdf(spark, *[p for p in paths if p.lower().endswith(".pdf")], extractor=extractor))
    return out


def read_conversations(spark: SparkSession, *paths: str) -> DataFrame:
    """human, assistant of the objects of JSON arrays where both are strings."""
    raw = spark.read.text(list(paths), wholetext=True)
    parsed = raw.select(F.try_parse_json("value").alias("v"))
    if not parsed.where("v is null or schema_of_variant(v) not like 'ARRAY%'").isEmpty():
        raise TextError("a conversation file must hold a JSON array")
    items = parsed.lateralJoin(spark.tvf.variant_explode(F.col("v").outer())).select(F.col("value").alias("x"))
    text = lambda key: F.when(F.schema_of_variant(F.try_variant_get("x", f"$.{key}", "variant")) == "STRING", F.try_variant_get("x", f"$.{key}", "string"))
    return items.select(text("human").alias("human"), text("assistant").alias("assistant")).where("human is not null and assistant is not null")


def read_sqlite(spark: SparkSession, path: str) -> DataFrame:
    """The chunks table of a SQLite memory; embeddings are little-endian floats, odd trailing bytes are left off.

    Reads on the driver, in batches: meant for bringing over small memories.
    """
    import sqlite3
    from itertools import islice

    import numpy as np

    from ..schema import CHUNKS

    out = spark.createDataFrame([], CHUNKS)
    with sqlite3.connect(path) as db:
        cursor = db.execute("SELECT id, text, source, page, offset, length, frame, embedding FROM chunks ORDER BY id")
        while rows := list(islice(cursor, 50_000)):
            vector = lambda b: None if b is None else np.frombuffer(b[: len(b) // 4 * 4], "<f4").tolist()
            out = out.union(spark.createDataFrame([(*r[:7], vector(r[7])) for r in rows], CHUNKS))
    return out
