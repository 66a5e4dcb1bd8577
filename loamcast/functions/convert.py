"""Values to what a Parquet column holds, as column expressions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F, types as T
from pyspark.sql.functions import pandas_udf

_UUID = "^[0-9a-fA-F]{8}-?[0-9a-fA-F]{4}-?[0-9a-fA-F]{4}-?[0-9a-fA-F]{4}-?[0-9a-fA-F]{12}$"


def epoch_days(ts: Column) -> Column:
    """Whole UTC days since 1970, rounded down before it too."""
    return F.unix_date(ts.cast("date"))


def epoch_micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def epoch_millis(ts: Column) -> Column:
    return F.unix_millis(ts.cast("timestamp"))


def epoch_nanos(ts: Column) -> Column:
    return epoch_micros(ts) * 1000


def scaled_decimal(value: Column, scale: int) -> Column:
    """value * 10^scale as a long; halves go up."""
    return F.floor(value * F.lit(float(10**scale)) + 0.5).cast("long")


def uint32_bits(value: Column) -> Column:
    """0..2^32-1 as a signed 32-bit integer with the same bits; anything else is an error."""
    ok = (value >= 0) & (value <= 4294967295)
    checked = F.when(value.isNull() | ok, value).otherwise(F.raise_error(F.concat(F.lit("not an unsigned 32-bit integer: "), value.cast("string"))))
    return F.when(checked > 2147483647, checked - 4294967296).otherwise(checked).cast("int")


def uuid_bytes(text: Column) -> Column:
    """16 bytes of a UUID with or without dashes in either case; anything else is an error."""
    bad = F.raise_error(F.concat(F.lit("not a UUID: "), text)).cast("binary")
    return F.when(text.isNull() | text.rlike(_UUID), F.unhex(F.replace(text, F.lit("-"), F.lit("")))).otherwise(bad)


def uuid_text(raw: Column) -> Column:
    """Canonical lower-case form of 16 bytes."""
    h = F.lower(F.hex(raw))
    return F.concat_ws("-", *(F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))))


def utf8(text: Column) -> Column:
    return F.encode(text, "UTF-8")


@pandas_udf(T.BinaryType())
def half_bytes(v: pd.Series) -> pd.Series:
    """IEEE half-precision bytes, little-endian, rounded half to even."""
    with np.errstate(over="ignore"):
        raw = v.astype("float64").to_numpy().astype("<f2")
    return pd.Series([None if n else x.tobytes() for x, n in zip(raw, v.isna(), strict=True)])


@pandas_udf(T.BinaryType())
def twos_complement(v: pd.Series) -> pd.Series:
    """Least big-endian two's-complement bytes of whole numbers; one zero byte for zero."""

    def one(x):
        if x is None or x != x:
            return None
        n = int(x)
        return n.to_bytes(((n + (n < 0)).bit_length() + 8) // 8, "big", signed=True)

    return v.map(one)
