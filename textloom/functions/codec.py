"""Payloads: text, gzipped where that is shorter; and the capacity of code symbols."""

from __future__ import annotations

import base64
import gzip

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..config import CodecSettings
from ..errors import CodecError
from ..session import ship

PREFIX = "GZ:"


def encode_text(text: str, settings: CodecSettings = CodecSettings()) -> tuple[str, bool]:
    """(payload, compressed). A plain text that begins like a compressed payload is compressed whatever its size."""
    raw = text.encode()
    clash = text.startswith(PREFIX)
    if not clash and (not settings.compress or len(raw) < settings.threshold):
        return text, False
    packed = PREFIX + base64.b64encode(gzip.compress(raw, settings.level, mtime=0)).decode()
    return (packed, True) if clash or len(packed) < len(raw) else (text, False)


def decode_text(payload: str) -> str:
    if not payload.startswith(PREFIX):
        return payload
    try:
        return gzip.decompress(base64.b64decode(payload[len(PREFIX) :], validate=True)).decode()
    except (ValueError, OSError, EOFError) as error:
        raise CodecError(f"not a payload: {error}") from error


def encode(text: Column, settings: CodecSettings = CodecSettings()) -> Column:
    """struct(payload, compressed, encoded_size in bytes) of each text; nulls stay null."""

    ship(SparkSession.active())

    @F.pandas_udf("payload string, compressed boolean, encoded_size int")
    def run(texts: pd.Series) -> pd.DataFrame:
        made = [(None, None, None) if t is None else (*(x := encode_text(t, settings)), len(x[0].encode())) for t in texts]
        return pd.DataFrame(made, columns=["payload", "compressed", "encoded_size"]).astype({"encoded_size": "Int32"})

    return run(text)


@F.pandas_udf(StringType())
def _decoded(payload: pd.Series) -> pd.Series:
    return payload.map(decode_text, na_action="ignore")


def decode(payload: Column | str) -> Column:
    """The text of each payload."""
    ship(SparkSession.active())
    return _decoded(payload)


# Capacities of versions 1, 10, 20 and 40 at levels L, M, Q and H, and the slope of the others.
CAPACITY = {1: (25, 20, 16, 10), 10: (174, 136, 100, 74), 20: (370, 290, 216, 158), 40: (852, 666, 496, 364)}
SLOPE = (20, 15, 12, 8)
LEVELS = ("L", "M", "Q", "H")


def max_capacity(version: Column, level: Column) -> Column:
    """Characters that a symbol of this version and level holds: from the table, or slope times version up to 1000."""
    out = F.lit(None).cast("long")
    for k, name in enumerate(LEVELS):
        value = F.least(F.lit(1000), version * SLOPE[k])
        for v, row in CAPACITY.items():
            value = F.when(version == v, F.lit(row[k])).otherwise(value)
        out = F.when(level == name, value.cast("long")).otherwise(out)
    return out


def smallest_version(n_bytes: Column, level: Column) -> Column:
    """The smallest version from 1 to 40 that holds n_bytes; 0 if none does."""
    fits = F.filter(F.sequence(F.lit(1), F.lit(40)), lambda v: max_capacity(v, level) >= n_bytes)
    return F.coalesce(F.array_min(fits), F.lit(0)).cast("int")
