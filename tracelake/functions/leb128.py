"""LEB128 numbers: seven bits a byte, least significant first, signed or unsigned."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from tracelake.errors import DataError

MAX_BYTES = 10  # of a 64-bit number


def encode(x: int, signed: bool = True) -> bytes:
    if not signed and x < 0:
        raise DataError(f"{x} is negative")
    out = bytearray()
    while True:
        low, x = x & 0x7F, x >> 7
        if x == 0 and (not signed or not low & 0x40) or signed and x == -1 and low & 0x40:
            return bytes([*out, low])
        out.append(low | 0x80)


def decode(data: bytes, at: int = 0, signed: bool = True, bits: int = 64) -> tuple[int, int]:
    """The number at ``at`` and the place after it.  A sequence without an end, one that is too
    long and one whose number exceeds ``bits`` are data errors."""
    x = shift = 0
    for k in range(at, min(len(data), at + MAX_BYTES)):
        x |= (data[k] & 0x7F) << shift
        shift += 7
        if not data[k] & 0x80:
            if signed and data[k] & 0x40:
                x -= 1 << shift
            lo, hi = (-(1 << bits - 1), (1 << bits - 1) - 1) if signed else (0, (1 << bits) - 1)
            if not lo <= x <= hi:
                raise DataError(f"LEB128 number exceeds {bits} bits")
            return x, k + 1
    raise DataError("LEB128 number has no end")


def leb128(x: Column, signed: bool = True) -> Column:
    """LEB128 bytes of a long column; null for null.  Unsigned: negative numbers are data errors."""

    @F.pandas_udf("binary")
    def run(numbers: pd.Series) -> pd.Series:
        return pd.Series([None if pd.isna(v) else encode(int(v), signed) for v in numbers], dtype=object)

    return run(x)


def unleb128(x: Column, signed: bool = True) -> Column:
    """The number at the start of a binary column; null for null."""

    @F.pandas_udf("long")
    def run(raw: pd.Series) -> pd.Series:
        return pd.Series([None if v is None else decode(v, signed=signed, bits=64 if signed else 63)[0] for v in raw], dtype="Int64")

    return run(x)
