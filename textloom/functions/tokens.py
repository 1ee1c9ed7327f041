"""Token arrays: padding, truncation, and a tokenizer that needs no files."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The start and end ids, and the range of hashed word ids.
START, END, FIRST, RANGE = 101, 102, 1000, 30000


def pad(ids: Column, length: int, truncate: bool = True) -> Column:
    """ids filled up with 0 to length; longer ones are cut if asked to."""
    filled = F.concat(ids, F.array_repeat(F.lit(0), F.greatest(F.lit(0), F.lit(length) - F.size(ids))))
    return F.slice(filled, 1, length) if truncate else filled


def word_ids(text: Column, max_length: int = 384) -> Column:
    """Start id, a hashed id for each of the first max_length - 2 words, end id."""
    words = F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")
    hashed = F.transform(F.slice(words, 1, max(0, max_length - 2)), lambda w: (F.pmod(F.xxhash64(w), F.lit(RANGE)) + FIRST).cast("int"))
    return F.concat(F.array(F.lit(START)), hashed, F.array(F.lit(END)))


def tokenise(text: Column, max_length: int = 384, truncate: bool = True) -> Column:
    """struct(input_ids, attention_mask, token_type_ids, original_length in bytes), padded to max_length."""
    ids = word_ids(text, max_length)
    ones = F.transform(ids, lambda _: F.lit(1))
    zeros = F.transform(ids, lambda _: F.lit(0))
    return F.struct(pad(ids, max_length, truncate).alias("input_ids"), pad(ones, max_length, truncate).alias("attention_mask"), pad(zeros, max_length, truncate).alias("token_type_ids"), F.octet_length(text).alias("original_length"))
