"""Differences of a signal and their exact inverses, as window functions.

Input: sensor, sample, epoch, value (and key columns).  Differences start anew in every epoch and
keep its first value.  Words wrap at their width: sums run in 64 bits and are folded back.

The windows by (sensor, epoch) and by (epoch, sample) both hold in a partitioning by epoch, so
:func:`by_epoch` once is the only shuffle, whatever is chained after it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

COPY, TIME, TIME2, CHAN = range(4)


def by_epoch(signal: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    return signal.repartition(*keys, "epoch")


def wrap(x: Column, width: int = 32) -> Column:
    """Fold a 64-bit number into a signed word of ``width`` bits."""
    if width == 64:
        return x
    low = x.bitwiseAND(F.lit((1 << width) - 1))
    return F.when(low >= 1 << (width - 1), low - (1 << width)).otherwise(low)


def _series(keys: tuple[str, ...]):
    return Window.partitionBy(*keys, "sensor", "epoch").orderBy("sample")


def _across(keys: tuple[str, ...]):
    return Window.partitionBy(*keys, "epoch", "sample").orderBy("sensor")


def _first(keys: tuple[str, ...]) -> Column:
    return F.lag("value", 1).over(_series(keys)).isNull()


def time(signal: DataFrame, keys: tuple[str, ...] = (), width: int = 32, out: str = "residual") -> DataFrame:
    """x[i] - x[i-1]."""
    x = F.col("value").cast("long")
    before = F.lag("value", 1).over(_series(keys)).cast("long")
    return signal.withColumn(out, wrap(F.coalesce(x - before, x), width))


def time2(signal: DataFrame, keys: tuple[str, ...] = (), width: int = 32, out: str = "residual") -> DataFrame:
    """Differences of differences; the first difference stays."""
    w, x = _series(keys), F.col("value").cast("long")
    a, b = F.lag("value", 1).over(w).cast("long"), F.lag("value", 2).over(w).cast("long")
    return signal.withColumn(out, wrap(F.when(a.isNull(), x).when(b.isNull(), x - a).otherwise(x - 2 * a + b), width))


def chan(signal: DataFrame, keys: tuple[str, ...] = (), width: int = 32, out: str = "residual") -> DataFrame:
    """Difference against the difference of the row before (zeros for the first row)."""
    marked = time(signal, keys, width, "_d").withColumn("_first", _first(keys))
    above = F.coalesce(F.lag("_d", 1).over(_across(keys)), F.lit(0))
    return marked.withColumn(out, F.when(F.col("_first"), F.col("value").cast("long")).otherwise(wrap(F.col("_d") - above, width))).drop("_d", "_first")


def _sums(keys: tuple[str, ...]):
    return _series(keys).rowsBetween(Window.unboundedPreceding, 0)


def restore_time(residuals: DataFrame, keys: tuple[str, ...] = (), width: int = 32, residual: str = "residual") -> DataFrame:
    """``value`` from differences."""
    return residuals.withColumn("value", wrap(F.sum(residual).over(_sums(keys)), width))


def restore_time2(residuals: DataFrame, keys: tuple[str, ...] = (), width: int = 32, residual: str = "residual") -> DataFrame:
    w = _series(keys)
    first = F.lag(residual, 1).over(w).isNull()
    marked = residuals.withColumn("_first", first).withColumn("_r", F.when(first, 0).otherwise(F.col(residual)))
    steps = marked.withColumn("_d", F.sum("_r").over(_sums(keys)) + F.when(F.col("_first"), F.col(residual)).otherwise(0))
    return steps.withColumn("value", wrap(F.sum(F.col("_d").cast("long")).over(_sums(keys)), width)).drop("_r", "_d", "_first")


def restore_chan(residuals: DataFrame, keys: tuple[str, ...] = (), width: int = 32, residual: str = "residual") -> DataFrame:
    """All rows coded against the row before."""
    return restore_mixed(residuals.withColumn("method", F.lit(CHAN)), keys, width, residual).drop("method")


def restore_mixed(residuals: DataFrame, keys: tuple[str, ...] = (), width: int = 32, residual: str = "residual") -> DataFrame:
    """``value`` from residuals whose rows have methods of their own (``method`` by sensor and epoch).

    Each row's offset from its first value is a single or double running sum.  A row coded against
    the row before adds its offset to that row's, so offsets are summed over each run of such rows,
    up from the last row that is not.
    """
    w, sums, up = _series(keys), _sums(keys), _across(keys)
    marked = residuals.withColumn("_first", F.lag(residual, 1).over(w).isNull()).withColumn("_master", F.first(residual).over(w).cast("long"))
    marked = marked.withColumn("_r", F.when(F.col("_first"), 0).otherwise(F.col(residual)).cast("long"))
    marked = marked.withColumn("_s", F.sum("_r").over(sums))
    marked = marked.withColumn("_ss", F.sum(F.when(F.col("method") == TIME2, F.col("_s")).otherwise(0)).over(sums))
    offset = F.when(F.col("_first"), 0).when(F.col("method") == COPY, F.col(residual) - F.col("_master")).when(F.col("method") == TIME2, F.col("_ss")).otherwise(F.col("_s"))
    marked = marked.withColumn("_y", wrap(offset.cast("long"), width))
    run = marked.withColumn("_run", F.sum(F.when(F.col("method") == CHAN, 0).otherwise(1)).over(up.rowsBetween(Window.unboundedPreceding, 0)))
    over_run = Window.partitionBy(*keys, "epoch", "sample", "_run").orderBy("sensor").rowsBetween(Window.unboundedPreceding, 0)
    out = run.withColumn("value", wrap(F.col("_master") + F.sum("_y").over(over_run), width))
    return out.drop("_first", "_master", "_r", "_s", "_ss", "_y", "_run")
