"""Blind indexes: equality search over values that the table holds only as keyed hashes."""

from __future__ import annotations

import hashlib
import hmac

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_BLOCK = 64


def _pads(key: bytes) -> tuple[bytes, bytes]:
    key = (hashlib.sha256(key).digest() if len(key) > _BLOCK else key).ljust(_BLOCK, b"\0")
    return bytes(b ^ 0x36 for b in key), bytes(b ^ 0x5C for b in key)


def blind_hex(key: bytes, value: str) -> str:
    """HMAC-SHA256 of value, cut to 16 bytes, in hex."""
    return hmac.new(key, value.encode(), hashlib.sha256).hexdigest()[:32]


def blind_index(key: bytes, value: Column) -> Column:
    """The same for a column, with built-in functions only; null stays null."""
    inner, outer = (F.unhex(F.lit(p.hex())) for p in _pads(key))
    return F.substring(F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, F.encode(value, "UTF-8")), 256))), 256), 1, 32)


def blind_equals(df: DataFrame, column: str, key: bytes, value: str) -> DataFrame:
    """Rows of df whose blind index is that of value; the comparison is pushed to the scan."""
    return df.filter(F.col(column) == F.lit(blind_hex(key, value)))


def blind_sql(key: bytes, value: str) -> str:
    """blind_index as DuckDB SQL, for comparison."""
    inner, outer = (p.hex() for p in _pads(key))
    return f"substr(sha256(unhex('{outer}') || unhex(sha256(unhex('{inner}') || encode({value})))), 1, 32)"


def ieee_divide(x: Column, y: Column) -> Column:
    """Division of doubles with infinities and NaN where Spark gives null."""
    inf, nan = F.lit(float("inf")), F.lit(float("nan"))
    return F.when((y != 0) | y.isNull() | x.isNull(), x / y).when((x == 0) | F.isnan(x), nan).when(x > 0, inf).otherwise(-inf)
