"""Rules for electrodes, headers and ranges, as boolean columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake.functions import text
from tracelake.operators import signal


def _fits(s: Column, n: int) -> Column:
    return (F.octet_length(s) <= n) & ~F.contains(s, F.lit(" ")) & ~F.contains(s, F.lit("\0"))


def optional_label(s: Column, n: int) -> Column:
    """At most n bytes, without blanks and NULs; null is empty."""
    return _fits(F.coalesce(s, F.lit("")), n)


def mandatory_label(s: Column, n: int) -> Column:
    return optional_label(s, n) & (F.coalesce(s, F.lit("")) != "")


def valid_label(s: Column) -> Column:
    return mandatory_label(s, text.LABEL_BYTES) & ~F.coalesce(F.substring(s, 1, 1), F.lit("")).isin("[", ";")


def finite(x: Column) -> Column:
    return F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))


def valid_electrode() -> Column:
    """Over columns label, unit, reference, status, type, iscale, rscale."""
    c = F.col
    return (
        valid_label(c("label"))
        & mandatory_label(c("unit"), text.UNIT_BYTES)
        & optional_label(c("reference"), text.REFERENCE_BYTES)
        & optional_label(c("status"), text.STATUS_BYTES)
        & optional_label(c("type"), text.TYPE_BYTES)
        & finite(c("iscale"))
        & finite(c("rscale"))
    )


def valid_header(headers: DataFrame, electrodes: DataFrame) -> DataFrame:
    """``headers`` with ``valid``: rate, epoch length, samples, at least one electrode, all valid,
    and a row order of as many rows.  One recording."""
    told = electrodes.agg(F.count(F.lit(1)).alias("_n"), F.coalesce(F.bool_and(valid_electrode()), F.lit(False)).alias("_ok"))
    rules = finite(F.col("sampling_frequency")) & (F.col("sampling_frequency") > 0) & (F.col("epoch_length") >= 1) & (F.col("sample_count") >= 1)
    both = headers.join(F.broadcast(told), F.lit(True))
    return both.withColumn("valid", rules & F.col("_ok") & (F.col("_n") == F.col("channels")) & valid_order(F.col("row_order")) & (F.size("row_order") == F.col("channels"))).drop("_n", "_ok")


def valid_order(order: Column) -> Column:
    """A permutation of 0..n-1."""
    return F.coalesce(F.array_sort(order.cast("array<int>")) == F.when(F.size(order) > 0, F.sequence(F.lit(0), F.size(order) - 1)), F.lit(False))


def increasing_ranges(ranges: DataFrame, keys: tuple[str, ...] = (), bucket: int = signal.BUCKET) -> DataFrame:
    """``ranges`` (epoch, fpos, size) with ``valid``: not empty, and after the one before."""
    before = F.coalesce(F.col("_before"), F.lit(-1))
    return signal.beside(ranges, "fpos", -1, "_before", bucket, keys).withColumn("valid", (F.col("size") > 0) & (F.col("fpos") > before)).drop("_before")


def same_series(a: Column, b: Column, tolerance: float = 1e-6) -> Column:
    """Rates that count as equal."""
    return F.abs(a - b) <= tolerance


def chunk_kind(ident: Column, label: Column) -> Column:
    """What a chunk of a container is; averages, deviations and wavelets are known but not read."""
    return (
        F.when(ident.isin("RIFF", "RF64"), "root")
        .when(ident == "LIST", F.when(label == "rawf", "average").when(label == "stdd", "deviation").when(label == "tfd ", "wavelet").when(label == "raw3", "raw3").otherwise("list"))
        .when(ident.isin("eeph", "info", "ep  ", "chan", "data"), F.trim(ident))
        .when(ident == "evt ", "triggers")
        .when(ident.isin("xevt", "xseg", "xsen", "xtrg"), "satellite")
        .otherwise("user")
    )


def encoding_fits(n: Column, nexc: Column, size: Column) -> Column:
    """Rule of row headers: 2 <= n <= nexc <= word size."""
    return (n >= 2) & (n <= nexc) & (nexc <= size)


def has_rows(df: DataFrame) -> bool:
    return not df.isEmpty()
