"""Slices and shapes of a signal table (sensor, sample, value, and key columns if it holds several
recordings).

Nothing here gathers a recording in one task: ranges are filters, the dense forms have one row a
time point or an epoch.  Tables by sensor (scales, order) have at most 32768 rows, the bound of the
container, and are broadcast for that reason.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracelake.errors import DataError, LimitError

MAX_SENSORS = 1 << 15
MAX_INT64 = (1 << 63) - 1
#: Epochs that one window takes; between windows only sums and first offsets go on.
BUCKET = 1 << 16


def sample_numbers(df: DataFrame, group: str, time: str, tie: str, bucket: str = "hour", name: str = "sample") -> DataFrame:
    """Number the rows of each group from 0 by (time, tie).

    A window over a whole group would sort it in one task.  Rows are numbered inside buckets of
    time instead, and each bucket starts where the counts of those before it end; only the counts
    (one row a group and bucket) are summed up in order.
    """
    at = F.date_trunc(bucket, F.col(time))
    counts = df.groupBy(group, at.alias("_bucket")).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(group, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    own = Window.partitionBy(group, "_bucket").orderBy(time, tie)
    numbered = df.withColumn("_bucket", at).withColumn("_row", F.row_number().over(own) - 1)
    return numbered.join(starts, [group, "_bucket"]).withColumn(name, (F.col("_start") + F.col("_row")).cast("long")).drop("_bucket", "_start", "_row")


def slice_samples(signal: DataFrame, first: int, amount: int, total: int | None = None) -> DataFrame:
    """Samples first .. first+amount-1 of all sensors; nothing at all if any of them isn't there.

    ``total``: samples of the recording, if known (from its header); else they are counted.
    """
    if first < 0 or amount < 1:
        return signal.limit(0)
    part = signal.where(F.col("sample").between(first, first + amount - 1))
    if total is not None:
        return part if first + amount <= total else signal.limit(0)
    there = signal.agg(F.max("sample").alias("_last")).where(F.col("_last") >= first + amount - 1)
    return part.join(F.broadcast(there.select(F.lit(True).alias("_there"))), F.col("_there") == F.lit(True)).drop("_there")


def with_epochs(signal: DataFrame, length: int) -> DataFrame:
    """``epoch`` and ``offset`` of each sample; the last epoch may be shorter."""
    if length < 1:
        raise LimitError(f"epoch length {length}")
    return signal.withColumn("epoch", F.expr(f"sample div {length}")).withColumn("offset", F.col("sample") % length)


def one_epoch(signal: DataFrame, i: int, length: int, total: int) -> DataFrame:
    """Samples of epoch i, as a range filter; an epoch that isn't there is a data error."""
    if not 0 <= i < -(-total // length):
        raise DataError(f"no epoch {i}")
    return signal.where(F.col("sample").between(i * length, min(total, (i + 1) * length) - 1))


def epoch_table(spark: SparkSession, total: int, length: int) -> DataFrame:
    """(epoch, first_sample, length) of a recording."""
    first = F.col("id") * length
    return spark.range(0, -(-total // length)).select(F.col("id").alias("epoch"), first.alias("first_sample"), F.least(F.lit(length), F.lit(total) - first).cast("long").alias("length"))


def running_offsets(sizes: DataFrame, size: str, bucket: int = BUCKET, order: str = "epoch", name: str = "offset", keys: tuple[str, ...] = ()) -> DataFrame:
    """``name``: where each row starts if all lie one after the other by ``order`` (whole numbers).
    ``keys`` tell recordings apart.

    Rows are summed up inside buckets of ``bucket`` orders, and each bucket starts where the sums of
    those before it end; only the sums (one row a bucket) are taken in order.
    """
    by = [*keys, "_bucket"]
    cut_up = sizes.withColumn("_bucket", F.floor(F.col(order) / bucket).cast("long"))
    sums = cut_up.groupBy(*by).agg(F.sum(size).alias("_sum"))
    starts = sums.select(*by, (F.sum("_sum").over(Window.partitionBy(*keys).orderBy("_bucket")) - F.col("_sum")).alias("_start"))
    own = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    inside = cut_up.withColumn("_upto", F.sum(size).over(own))
    return inside.join(starts, by).withColumn(name, F.col("_start") + F.col("_upto") - F.col(size)).drop("_bucket", "_start", "_upto").select(*sizes.columns, name)


def beside(df: DataFrame, value: str, step: int, name: str, bucket: int = BUCKET, keys: tuple[str, ...] = (), order: str = "epoch") -> DataFrame:
    """``name``: ``value`` of the row before (``step`` -1) or after (1) by ``order``; null if there is none.

    Windows are taken bucket by bucket; only one value of each bucket goes to its neighbour.
    """
    by = [*keys, "_bucket"]
    cut_up = df.withColumn("_bucket", F.floor(F.col(order) / bucket).cast("long"))
    edge = (F.min_by if step > 0 else F.max_by)(value, order)
    edges = cut_up.groupBy(*by).agg(edge.alias("_edge"))
    shift = F.lead if step > 0 else F.lag
    others = edges.select(*by, shift("_edge", 1).over(Window.partitionBy(*keys).orderBy("_bucket")).alias("_other"))
    near = shift(value, 1).over(Window.partitionBy(*by).orderBy(order))
    return cut_up.join(others, by).withColumn(name, F.coalesce(near, F.col("_other"))).select(*df.columns, name)


def offsets_to_ranges(offsets: DataFrame, size: int, first: int = 0, keys: tuple[str, ...] = (), bucket: int = BUCKET) -> DataFrame:
    """(epoch, offset) to (epoch, fpos, size), the last one up to the end of the data; rows whose
    size is not positive are data errors, and so marked in ``valid``.  ``keys`` tell recordings apart."""
    span = F.coalesce(F.col("_after"), F.lit(size)) - F.col("offset")
    return beside(offsets, "offset", 1, "_after", bucket, keys).select(*keys, "epoch", (F.col("offset") + first).alias("fpos"), span.alias("size"), (span > 0).alias("valid"))


def column_major(signal: DataFrame, sensors: int, value: str = "value", keys: tuple[str, ...] = ()) -> DataFrame:
    """One row a sample, with a column a sensor: c0, c1, ..."""
    if not 0 < sensors <= MAX_SENSORS:
        raise LimitError(f"{sensors} sensors")
    wide = signal.groupBy(*keys, "sample").pivot("sensor", list(range(sensors))).agg(F.first(value))
    return wide.select(*keys, "sample", *[F.col(f"`{k}`").alias(f"c{k}") for k in range(sensors)])


def long_form(wide: DataFrame, sensors: int, keys: tuple[str, ...] = (), value: str = "value") -> DataFrame:
    """The inverse of :func:`column_major`."""
    parts = F.array(*[F.struct(F.lit(k).alias("sensor"), F.col(f"c{k}").alias(value)) for k in range(sensors)])
    return wide.select(*keys, "sample", F.inline(parts))


def rows_to_long(rows: DataFrame, column: str, first: int = 0, value: str = "value", order: str = "row") -> DataFrame:
    """A matrix column, array<array>, to (sensor, sample, value).  ``order``: rows are sensors
    (row major) or time points (column major)."""
    outer, inner = ("sensor", "sample") if order == "row" else ("sample", "sensor")
    keys = [c for c in rows.columns if c != column]
    by = rows.select(*keys, F.posexplode(column).alias(outer, "_row")).select(*keys, outer, F.posexplode("_row").alias(inner, value))
    return by.withColumn("sample", (F.col("sample") + first).cast("long"))


def flat_to_long(rows: DataFrame, column: str, sensors: int, order: str = "row", value: str = "value") -> DataFrame:
    """A flat array of all samples, in either order, to (sensor, sample, value).  A length that
    the sensors don't divide is an error."""
    n = F.size(column)
    whole = F.assert_true(n % sensors == 0, F.lit(f"length is no multiple of {sensors}"))
    length = F.expr(f"size({column}) div {sensors}")
    by = rows.where(whole.isNull()).select(length.alias("_length"), F.posexplode(column).alias("_at", value))
    at, run = F.col("_at"), F.col("_length")
    sensor, sample = (F.expr("_at div _length"), at % run) if order == "row" else (at % sensors, F.expr(f"_at div {sensors}"))
    return by.select(sensor.cast("int").alias("sensor"), sample.cast("long").alias("sample"), value)


def epoch_matrices(signal: DataFrame, length: int, keys: tuple[str, ...] = ()) -> DataFrame:
    """One row an epoch: epoch, length (samples), rows (array by sensor of arrays by sample)."""
    cell = F.struct("sensor", "offset", "value")
    cells = with_epochs(signal, length).groupBy(*keys, "epoch").agg(F.array_sort(F.collect_list(cell)).alias("cells"), (F.max("offset") + 1).alias("length"), (F.max("sensor") + 1).alias("_n"))
    row = lambda s: F.transform(F.slice(F.col("cells"), s * F.col("length").cast("int") + 1, F.col("length").cast("int")), lambda c: c["value"])
    full = F.size("cells") == F.col("_n") * F.col("length")
    rows = F.transform(F.sequence(F.lit(0), F.col("_n") - 1), row)
    return cells.select(*keys, "epoch", F.col("length").cast("long").alias("length"), F.when(full, rows).otherwise(F.raise_error(F.lit("samples are missing or repeated"))).alias("rows"))


def order_table(spark: SparkSession, order: list[int]) -> DataFrame:
    """(storage_row, sensor) of a row order."""
    if len(order) > MAX_SENSORS or sorted(order) != list(range(len(order))):
        raise LimitError("row order is no permutation")
    return spark.createDataFrame(list(enumerate(order)), "storage_row int, sensor int")


def to_client_order(stored: DataFrame, order: DataFrame) -> DataFrame:
    """Rows by ``storage_row`` to rows by ``sensor``."""
    return stored.join(F.broadcast(order), "storage_row").drop("storage_row")


def to_storage_order(signal: DataFrame, order: DataFrame) -> DataFrame:
    return signal.join(F.broadcast(order), "sensor").drop("sensor")


def scales(electrodes: DataFrame) -> DataFrame:
    """(sensor, read_scale, write_scale): values are stored as integers of iscale * rscale."""
    s = F.col("iscale") * F.col("rscale")
    return electrodes.select("sensor", s.alias("read_scale"), (1 / s).alias("write_scale"))


def scale_read(signal: DataFrame, electrodes: DataFrame, value: str = "value") -> DataFrame:
    """Integers to physical values."""
    return signal.join(F.broadcast(scales(electrodes)), "sensor").withColumn(value, F.col(value) * F.col("read_scale")).drop("read_scale", "write_scale")


def scale_write(signal: DataFrame, electrodes: DataFrame, value: str = "value", kind: str = "int") -> DataFrame:
    """Physical values to integers: times the reciprocal, halves away from zero.  Values that
    don't fit raise an error."""
    scaled = F.round(F.col(value) * F.col("write_scale")).cast(kind)
    return signal.join(F.broadcast(scales(electrodes)), "sensor").withColumn(value, scaled).drop("read_scale", "write_scale")


def submatrix(signal: DataFrame, amount: int, first: int, to: int = 0) -> DataFrame:
    """Samples first .. first+amount-1, renumbered from ``to``."""
    if amount < 0 or first < 0 or to < 0:
        raise LimitError("negative window")
    part = signal.where((F.col("sample") >= first) & (F.col("sample") < first + amount))
    return part.withColumn("sample", F.col("sample") - first + to)


def area(height: Column, length: Column) -> Column:
    """Values of a matrix; beyond 64 bits that raises an error."""
    return height.cast("long") * length.cast("long")


def natural_order(spark: SparkSession, sensors: int) -> DataFrame:
    return spark.range(sensors).select(F.col("id").cast("int").alias("sensor"))


def running_total(epochs: DataFrame, length: str = "length", keys: tuple[str, ...] = (), bucket: int = BUCKET) -> DataFrame:
    """Samples up to the end of each epoch (one row an epoch; ``keys`` tell recordings apart)."""
    return running_offsets(epochs, length, bucket, name="sample_count", keys=keys).withColumn("sample_count", F.col("sample_count") + F.col(length))
