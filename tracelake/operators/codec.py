"""Coding epochs of a signal, as vectorised functions.

An epoch is coded on its own, so the work is one row an epoch and spreads over all tasks; a row
holds sensors x epoch length words.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.errors import DataError, LimitError
from tracelake.functions import codec
from tracelake.operators.signal import epoch_matrices, rows_to_long

#: Value types by name: numpy type and the Spark type that holds its words.
TYPES = {"int16": ("i2", "smallint"), "int32": ("i4", "int"), "int64": ("i8", "bigint"), "uint16": ("u2", "int"), "uint32": ("u4", "bigint"), "uint64": ("u8", "decimal(20,0)")}


#: Epochs, and about how many bytes of them, that a task holds in Python at once.
BATCH_EPOCHS, BATCH_BYTES = 64, 4 << 20


def small_batches() -> None:
    """Send few epochs at a time to Python: one is many values, which Arrow, numpy and the results
    each hold."""
    spark = SparkSession.getActiveSession()
    if spark is None:
        return
    for name, most in (("maxRecordsPerBatch", BATCH_EPOCHS), ("maxBytesPerBatch", BATCH_BYTES)):
        name = f"spark.sql.execution.arrow.{name}"
        now = int(spark.conf.get(name).removesuffix("b"))
        if now <= 0 or now > most:
            spark.conf.set(name, str(most))


def _words(v: Column) -> Column:
    """Unsigned 64-bit numbers (decimals) as signed words of the same bits."""
    most = F.lit(str((1 << 64) - 1)).cast("decimal(20,0)")
    signed = F.when(v > (1 << 63) - 1, v - most - 1).otherwise(v).cast("bigint")
    return F.when(v.between(0, most), signed).otherwise(F.raise_error(F.lit("values beyond u8")).cast("bigint"))


def _numbers(word: Column) -> Column:
    """The inverse of :func:`_words`."""
    number = word.cast("decimal(20,0)")
    return F.when(word < 0, number + F.lit(str(1 << 64)).cast("decimal(20,0)")).otherwise(number).cast("decimal(20,0)")


def _each(matrix: Column, f) -> Column:
    return F.transform(matrix, lambda row: F.transform(row, f))


def _matrix(rows, dtype: str, fold: bool = False) -> np.ndarray:
    if rows is None or not len(rows):
        return np.zeros((0, 0), dtype)
    x = np.stack([np.asarray(r) for r in rows])
    if dtype == "u8":
        return x.view("u8")
    info = np.iinfo(dtype)
    if not fold and x.size and (x.min() < info.min or x.max() > info.max):
        raise LimitError(f"values beyond {dtype}")
    return x.astype(dtype)


def _transposed(x: np.ndarray, major: str) -> np.ndarray:
    return x.T if major == "column" and x.size else x


def _block(rows, dtype: str, form: codec.Layout, order: list[int] | None, major: str, fold: bool) -> bytes:
    x = np.ascontiguousarray(_transposed(_matrix(rows, dtype, fold), major))
    folded = None
    if fold and x.size:
        folded = np.array([r[0] for r in rows] if major == "row" else rows[0]) != x[:, 0]
    return codec.encode_matrix(x, form, order, folded)


def encoded(rows: Column, kind: str = "int32", layout: str = "compatible", order: list[int] | None = None, major: str = "row", fold: bool = False) -> Column:
    """Bytes of a matrix column (array<array>).  ``major``: its rows are sensors (row) or time
    points (column).  Null for null; no bytes for an empty matrix.  Values beyond the words of
    ``kind`` raise an error, or are folded into them (modulo 2^width) with ``fold``."""
    dtype, form = TYPES[kind][0], codec.LAYOUTS[layout]

    @F.pandas_udf("binary")
    def encode(matrices: pd.Series) -> pd.Series:
        return pd.Series([None if m is None else _block(m, dtype, form, order, major, fold) for m in matrices], dtype=object)

    small_batches()
    return encode(_each(rows, _words) if kind == "uint64" else rows)


def decoded(data: Column, length: Column, sensors: int, kind: str = "int32", layout: str = "compatible", order: list[int] | None = None, major: str = "row", or_null: bool = False) -> Column:
    """The matrix of a block with ``length`` samples.  Malformed blocks raise an error, or give null
    with ``or_null``."""
    (dtype, spark_type), form = TYPES[kind], codec.LAYOUTS[layout]
    word_type = "bigint" if kind == "uint64" else spark_type

    @F.pandas_udf(f"array<array<{word_type}>>")
    def decode(blocks: pd.Series, lengths: pd.Series) -> pd.Series:
        out = []
        for b, n in zip(blocks, lengths, strict=True):
            if b is None:
                out.append(None)
                continue
            try:
                x = _transposed(codec.decode_matrix(b, sensors, int(n), dtype, form, order), major)
            except DataError:
                if not or_null:
                    raise
                out.append(None)
                continue
            out.append([r.astype({"u2": "i4", "u4": "i8", "u8": "i8"}.get(dtype, dtype)) for r in x])
        return pd.Series(out, dtype=object)

    small_batches()
    return _each(decode(data, length), _numbers) if kind == "uint64" else decode(data, length)


def encode_epochs(signal: DataFrame, length: int, keys: tuple[str, ...] = (), layout: str = "compatible", kind: str = "int32", fold: bool = False) -> DataFrame:
    """(epoch, length, data) of a signal table."""
    return epoch_matrices(signal, length, keys).withColumn("data", encoded(F.col("rows"), kind, layout, fold=fold)).drop("rows")


def decode_epochs(epochs: DataFrame, sensors: int, epoch_length: int, layout: str = "compatible", kind: str = "int32", order: list[int] | None = None) -> DataFrame:
    """The signal table of (epoch, length, data)."""
    rows = epochs.select("epoch", decoded(F.col("data"), F.col("length"), sensors, kind, layout, order).alias("m"))
    return rows_to_long(rows, "m").withColumn("sample", F.col("sample") + F.col("epoch") * epoch_length).select("sensor", "sample", "epoch", "value")
