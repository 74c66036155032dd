"""Identifiers."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def _column(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def det_id(prefix: str, *parts: Column | str) -> Column:
    """`prefix:` and the first 16 hex digits of sha256 over the prefix and the parts, with zero bytes between; null parts count as empty."""
    joined = F.concat_ws("\0", F.lit(prefix), *(F.coalesce(_column(p).cast("string"), F.lit("")) for p in parts))
    return F.concat(F.lit(f"{prefix}:"), F.substring(F.sha2(joined.cast("binary"), 256), 1, 16))


def body_hash(body: Column | str) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(_column(body).cast("binary"), 256))


@F.pandas_udf(StringType())
def fnv1a64(values: pd.Series) -> pd.Series:
    """64-bit FNV-1a as 16 hex digits; wrapping products are an overflow in ANSI SQL, so this is an Arrow batch function."""

    def one(text: str | None) -> str | None:
        if text is None:
            return None
        h = 0xCBF29CE484222325
        for b in text.encode():
            h = (h ^ b) * 0x100000001B3 & 0xFFFFFFFFFFFFFFFF
        return f"{h:016x}"

    return values.map(one)


def decoded(body: Column | str) -> Column:
    """The bytes as text; what is no UTF-8 becomes U+FFFD."""
    return F.expr("make_valid_utf8(cast({} as string))".format(body)) if isinstance(body, str) else F.make_valid_utf8(body.cast("string"))
