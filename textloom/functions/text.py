"""Cleaning and small scalar functions on text columns."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

WHITE = r"(?U)\s+"

# The markdown patterns and what replaces them, in order. Anchors hold for the whole text.
MARKDOWN = (
    (r"```[\s\S]*?```", " "),
    (r"`[^`]*`", " "),
    (r"^#{1,6}\s+", ""),
    (r"\[([^\]]*)\]\([^\)]*\)", "$1"),
    (r"!\[[^\]]*\]\([^\)]*\)", " "),
    (r"\*\*([^\*]*)\*\*", "$1"),
    (r"\*([^\*]*)\*", "$1"),
    (r"__([^_]*)__", "$1"),
    (r"_([^_]*)_", "$1"),
    (r"^---+\z", " "),
    (r"^\*\*\*+\z", " "),
    (r"<[^>]*>", " "),
)


def collapse(text: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, WHITE, " "))


def clean(text: Column) -> Column:
    """Lines trimmed, blank ones dropped, all joined by one space: in effect collapse()."""
    return collapse(text)


def prepare(text: Column, lowercase: bool = False, normalise=None) -> Column:
    """The text as an embedder takes it; normalise is a column function for Unicode normal forms."""
    text = normalise(text) if normalise else text
    return collapse(F.lower(text) if lowercase else text)


@F.pandas_udf(StringType())
def nfc(text: pd.Series) -> pd.Series:
    """Unicode normal form C, for which Spark has no function."""
    import unicodedata

    return text.map(lambda x: unicodedata.normalize("NFC", x), na_action="ignore")


def strip_markdown(text: Column, multiline: bool = False) -> Column:
    """The text without markdown signs. multiline: headings and rules on any line, not only where the text begins."""
    for pattern, put in MARKDOWN:
        if multiline and pattern[0] == "^":
            pattern = "(?m)" + pattern.replace(r"\z", "$")
        text = F.regexp_replace(text, pattern, put)
    return collapse(text)


def strip_tags(html: Column) -> Column:
    """Markup out, white space collapsed."""
    return collapse(F.regexp_replace(html, "<[^>]*>", " "))


def byte_length(text: Column) -> Column:
    return F.octet_length(text).cast("long")


def preview(text: Column, n: int) -> Column:
    """The first n characters and an ellipsis where there are more."""
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit("..."))).otherwise(text)


def decodable(text: Column) -> Column:
    """1 to 99,999 bytes of ASCII, letters, digits and white space of any script."""
    return F.octet_length(text).between(1, 99_999) & ~text.rlike(r"[^\x00-\x7F\p{IsAlphabetic}\p{N}\p{IsWhite_Space}]")


def file_extension(path: Column) -> Column:
    """The last suffix in lower case; null without one."""
    return F.lower(F.nullif(F.regexp_extract(path, r"[^/.]\.([^./]+)$", 1), F.lit("")))


def is_document(path: Column) -> Column:
    return F.coalesce(file_extension(path).isin("pdf", "txt", "md", "markdown"), F.lit(False))


def is_video(path: Column) -> Column:
    return F.coalesce(file_extension(path).isin("mp4", "avi", "mov", "mkv", "webm"), F.lit(False))


def human_size(n: Column, largest: str = "TB") -> Column:
    """Bytes as B, KB, MB, GB or TB in steps of 1024 up to largest, with one decimal but for bytes; ties round to even, null gives null."""
    units = ("KB", "MB", "GB", "TB")
    last = units.index(largest) + 1
    # format_string would round ties up, by the shortest decimal form of the number.
    shown = lambda k: F.concat(F.call_function("format_number", n / float(1 << 10 * k), F.lit("0.0")), F.lit(f" {units[k - 1]}"))
    out = shown(last)
    for k in range(last - 1, 0, -1):
        out = F.when(n < (1 << 10 * (k + 1)), shown(k)).otherwise(out)
    return F.when(n < 1024, F.format_string("%d B", n)).otherwise(out)


def progress(done: Column, total: Column) -> Column:
    return F.when(total == 0, F.lit(0.0)).otherwise(F.try_divide(100.0 * done, total))


def best_chunk_size(length: Column, target: Column) -> Column:
    """length over target, from 256 to 4096; 1024 where target is 0."""
    return F.when(target == 0, F.lit(1024)).otherwise(F.greatest(F.lit(256), F.least(F.lit(4096), F.floor(F.try_divide(length, target))))).cast("long")


def safe_name(name: Column) -> Column:
    """name without characters that file systems refuse."""
    return F.trim(F.regexp_replace(name, r'[/\\:*?"<>|\p{Cc}]', "_"))


def epoch_seconds() -> Column:
    return F.unix_timestamp().cast("string")
