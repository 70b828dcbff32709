"""The signal that the queries work on, made from the ``events`` table.

A sensor is an event type (in order of name), a sample the row number by time, a value the event's
value times 256, rounded.  Operators on single sensors work on all samples (``every``); those on
matrices need sensors of one length, so for them all are cut to the shortest one (``dense``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracelake.operators import cost, signal

EPOCH = 512


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_type, sensor, sample, value (physical), ts, event_id."""
    events = table(spark, sf_dir, "events").select("event_id", "ts", "event_type", "value")
    names = events.select("event_type").distinct()  # a handful of sensors
    sensors = names.withColumn("sensor", (F.dense_rank().over(Window.orderBy("event_type")) - 1).cast("int"))
    numbered = signal.sample_numbers(events, "event_type", "ts", "event_id")
    return numbered.join(F.broadcast(sensors), "event_type")


def every(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sensor, sample, value (integers), of all events."""
    return sparse(spark, sf_dir).select("sensor", "sample", F.round(F.col("value") * 256).cast("long").alias("value"))


def dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sensor, sample, value (integers), without gaps in the matrix."""
    rows = every(spark, sf_dir)
    counts = table(spark, sf_dir, "events").groupBy("event_type").count()
    shortest = counts.agg(F.min("count").alias("_n"))
    return rows.join(F.broadcast(shortest), F.col("sample") < F.col("_n")).drop("_n")


def physical(spark: SparkSession, sf_dir: str, signal_of=dense) -> DataFrame:
    return signal_of(spark, sf_dir).withColumn("value", F.col("value") / 256.0)


def epochs(spark: SparkSession, sf_dir: str, signal_of=dense) -> DataFrame:
    return signal.with_epochs(signal_of(spark, sf_dir), EPOCH)


def smooth(spark: SparkSession, sf_dir: str, signal_of=dense) -> DataFrame:
    """A signal that makes all methods win somewhere: sensors 0 a ramp, 1 a parabola, 2 the same
    with small noise, 3 extremes in turn, 4 noise."""
    base = signal_of(spark, sf_dir)
    noise = F.col("value")
    at = F.col("sample")
    value = (
        F.when(F.col("sensor") == 0, at * 7)
        .when(F.col("sensor") == 1, at * at)
        .when(F.col("sensor") == 2, at * at + F.pmod(noise, F.lit(3)))
        .when(F.col("sensor") == 3, F.when(at % 2 == 0, F.lit(-(1 << 31))).otherwise(F.lit((1 << 31) - 1)))
        .otherwise(noise)
    )
    return signal.with_epochs(base.withColumn("value", value.cast("long")), EPOCH)


def residuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cost.residual_table(smooth(spark, sf_dir))


DENSE_SQL = """
sparse as (
  select cast(dense_rank() over (order by event_type) - 1 as integer) as sensor,
         row_number() over (partition by event_type order by ts, event_id) - 1 as sample,
         cast(round(value * 256) as bigint) as value, value as raw, event_type, ts, event_id
  from events),
dense as (
  select sensor, sample, value from sparse
  where sample < (select min(n) from (select count(*) as n from events group by event_type)))
"""


def epochs_sql(source: str) -> str:
    """CTE ``epochs``: sensor, sample, value, epoch, offset of ``dense``, or of ``sparse``: all samples."""
    return f"""{DENSE_SQL}, epochs as (select sensor, sample, value, sample // {EPOCH} as epoch, sample % {EPOCH} as "offset" from {source})"""


def smooth_sql(source: str) -> str:
    """CTE ``smooth``, of ``dense`` or ``sparse``."""
    return f"""{DENSE_SQL}, smooth as (
  select sensor, sample, sample // {EPOCH} as epoch, cast(case sensor
    when 0 then sample * 7 when 1 then sample * sample when 2 then sample * sample + ((value % 3) + 3) % 3
    when 3 then case when sample % 2 = 0 then -2147483648 else 2147483647 end else value end as bigint) as value
  from {source})"""


EPOCHS_SQL, SMOOTH_SQL = epochs_sql("dense"), smooth_sql("dense")


def wrapped(x: str) -> str:
    """A number folded into 32 bits."""
    return f"(case when (({x}) & 4294967295) >= 2147483648 then (({x}) & 4294967295) - 4294967296 else (({x}) & 4294967295) end)"


def deltas_sql(source: str) -> str:
    """CTE ``deltas``: sensor, sample, epoch, value, first, t, t2, c."""
    w = "partition by sensor, epoch order by sample"
    return f"""
lagged as (select *, lag(value, 1) over ({w}) as a, lag(value, 2) over ({w}) as b from {source}),
timed as (select *, a is null as first, {wrapped("case when a is null then value else value - a end")} as t,
  {wrapped("case when a is null then value when b is null then value - a else value - 2 * a + b end")} as t2 from lagged),
deltas as (select *, case when first then value else {wrapped("t - coalesce(lag(t) over (partition by epoch, sample order by sensor), 0)")} end as c from timed)"""


WIDTH = "greatest(2, case when (case when {0} < 0 then -{0} - 1 else {0} end) = 0 then 1 else length(bin(case when {0} < 0 then -{0} - 1 else {0} end)) + 1 end)"


def residuals_sql() -> str:
    """CTE ``residuals``: sensor, epoch, sample, first, method, residual, width, marker."""
    return f"""{SMOOTH_SQL}, {deltas_sql("smooth")},
long as (select sensor, epoch, sample, first, 1 as method, t as residual from deltas union all
  select sensor, epoch, sample, first, 2, t2 from deltas union all select sensor, epoch, sample, first, 3, c from deltas),
widths as (select *, {WIDTH.format("residual")} as width from long),
residuals as (select *, case when residual = -(cast(1 as bigint) << (width - 1)) then 1 else 0 end as marker from widths)"""


def costs_sql() -> str:
    """CTE ``costs``: sensor, epoch, method, n, nexc, samples, bits."""
    return f"""{residuals_sql()},
blocks as (select sensor, epoch, method, count(*) as samples, max(case when not first then width end) as nexc, max(case when first then width end) as master from residuals group by 1, 2, 3),
sized as (select *, case when greatest(nexc, master) <= 16 then 16 else 32 end as size from blocks where nexc is not null),
tried as (select *, unnest(range(2, nexc + 1)) as n from sized),
odd as (select t.sensor, t.epoch, t.method, t.n, sum(case when not r.first and (r.width > t.n or r.width = t.n and r.marker = 1) then 1 else 0 end) as odd
  from tried t join residuals r using (sensor, epoch, method) group by 1, 2, 3, 4),
costs as (select t.sensor, t.epoch, t.method, cast(t.n as integer) as n, t.nexc, t.samples, t.size,
  case when t.size = 16 then 28 else 48 end + t.n * (t.samples - 1) + case when t.n = t.nexc then 0 else t.nexc * o.odd end as bits
  from tried t join odd o using (sensor, epoch, method, n))"""
