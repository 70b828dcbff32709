"""Registered queries, one an operator, with the same in SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.functions import dates, leb128, text
from tracelake.operators import codec, cost, delta, events, signal, validate
from tracelake.plans import stand_in as s
from tracelake.plans.stand_in import DENSE_SQL, EPOCH, EPOCHS_SQL, SMOOTH_SQL, costs_sql, deltas_sql, epochs_sql, residuals_sql, smooth_sql
from tracelake.sources import archive

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

FIRST, AMOUNT = 100, 250
SENSORS = 5
ORDER = [3, 0, 4, 1, 2]
ORDER_SQL = "(values (0, 3), (1, 0), (2, 4), (3, 1), (4, 2)) o(storage_row, sensor)"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def electrodes(spark: SparkSession) -> DataFrame:
    rows = [(k, f"ch{k}", "ref", "uV", 1.0, 1 / 256 if k != 2 else 1 / 512) for k in range(SENSORS)]
    return spark.createDataFrame(rows, "sensor int, label string, reference string, unit string, iscale double, rscale double")


SCALE_SQL = "(values (0, 1 / 256), (1, 1 / 256), (2, 1 / 512), (3, 1 / 256), (4, 1 / 256)) e(sensor, scale)"
RANGE = f"sample between {FIRST} and {FIRST + AMOUNT - 1} and (select max(sample) from dense) >= {FIRST + AMOUNT - 1}"


# Ranges and shapes


@query(f"with {DENSE_SQL} select sensor, sample, value from dense where {RANGE}")
def signal_range_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signal.slice_samples(s.dense(spark, sf_dir), FIRST, AMOUNT)


@query(f"with {DENSE_SQL} select sensor, sample, value * scale as value from dense join {SCALE_SQL} using (sensor) where {RANGE}")
def signal_range_scaled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signal.scale_read(signal.slice_samples(s.dense(spark, sf_dir), FIRST, AMOUNT), electrodes(spark)).select("sensor", "sample", "value")


@query(f"with {DENSE_SQL} select sensor, sample, value from dense where false")
def signal_range_oob_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signal.slice_samples(s.dense(spark, sf_dir), 1, 1 << 40)


def _pivot_sql(value: str, source: str) -> str:
    return ", ".join(f"max(case when sensor = {k} then {value} end) as c{k}" for k in range(SENSORS)) + f" from {source}"


@query(f"with {DENSE_SQL} select sample, {_pivot_sql('value', 'dense')} where {RANGE} group by sample")
def signal_column_major(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signal.column_major(signal.slice_samples(s.dense(spark, sf_dir), FIRST, AMOUNT), SENSORS)


@query(f"with {DENSE_SQL}, scaled as (select sensor, sample, value * scale as value from dense join {SCALE_SQL} using (sensor)) select sample, {_pivot_sql('value', 'scaled')} where {RANGE} group by sample")
def signal_column_major_scaled(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = signal.slice_samples(s.dense(spark, sf_dir), FIRST, AMOUNT)
    return signal.column_major(signal.scale_read(part, electrodes(spark)), SENSORS)


@query(f"with {DENSE_SQL}, scaled as (select sensor, sample, cast(value * scale as float) as value from dense join {SCALE_SQL} using (sensor)) select sample, {_pivot_sql('value', 'scaled')} where {RANGE} group by sample")
def signal_v4_float(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = signal.slice_samples(s.dense(spark, sf_dir), FIRST, AMOUNT)
    return signal.column_major(signal.scale_read(part, electrodes(spark)).withColumn("value", F.col("value").cast("float")), SENSORS)


@query(f"with {EPOCHS_SQL} select sensor, sample, value from epochs where epoch = 1")
def epoch_row_major(spark: SparkSession, sf_dir: str) -> DataFrame:
    return s.epochs(spark, sf_dir).where("epoch = 1").select("sensor", "sample", "value")


@query(f"with {EPOCHS_SQL} select sample, {_pivot_sql('value', 'epochs')} where epoch = 1 group by sample")
def epoch_column_major(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signal.column_major(s.epochs(spark, sf_dir).where("epoch = 1"), SENSORS)


@query(f"with {EPOCHS_SQL} select epoch, min(sample) as first_sample, count(distinct sample) as length from epochs group by epoch")
def epoch_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    total = s.table(spark, sf_dir, "events").groupBy("event_type").count().agg(F.min("count")).first()[0]
    return signal.epoch_table(spark, total, EPOCH)


_OFFSETS = "select cast(o_orderkey as bigint) as epoch, sum(cast(floor(o_totalprice) as bigint) + 1) over (order by o_orderkey) - cast(floor(o_totalprice) as bigint) - 1 as \"offset\" from orders"


@query(f"""with o as ({_OFFSETS}), e as (select sum(cast(floor(o_totalprice) as bigint) + 1) as total from orders)
  select epoch, cast("offset" + 10 as bigint) as fpos, cast(coalesce(lead("offset") over (order by epoch), total) - "offset" as bigint) as size, true as valid from o, e""")
def epoch_offsets_to_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index of all orders, whose data end with the last one."""
    sizes = s.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("epoch"), (F.floor("o_totalprice").cast("long") + 1).alias("size"))
    end = sizes.agg(F.sum("size")).first()[0] or 0
    return signal.offsets_to_ranges(signal.running_offsets(sizes, "size").select("epoch", "offset"), end, 10)


@query(f"with {DENSE_SQL} select storage_row, sample, value from sparse join {ORDER_SQL} using (sensor)")
def row_order_permute(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signal.to_storage_order(s.every(spark, sf_dir), signal.order_table(spark, ORDER)).select("storage_row", "sample", "value")


@query(f"with {DENSE_SQL}, stored as (select storage_row, sample, value from sparse join {ORDER_SQL} using (sensor)) select sensor, sample, value from stored join {ORDER_SQL} using (storage_row)")
def row_order_restore(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = signal.order_table(spark, ORDER)
    return signal.to_client_order(signal.to_storage_order(s.every(spark, sf_dir), order), order).select("sensor", "sample", "value")


@query("select o_orderkey, list_sort([o_orderkey % 3, o_custkey % 3, (o_orderkey + o_custkey) % 3]) = [0, 1, 2] as valid from orders")
def row_order_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    order = F.array(*[(x % 3).cast("int") for x in (k, c, k + c)])
    return s.table(spark, sf_dir, "orders").select("o_orderkey", validate.valid_order(order).alias("valid"))


@query(f"with {DENSE_SQL} select sensor, sample - 300 + 7 as sample, value from dense where sample >= 300 and sample < 400")
def submatrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signal.submatrix(s.dense(spark, sf_dir), 100, 300, 7)


@query(f"with {DENSE_SQL} select sensor, sample, value from dense where {RANGE}")
def transpose_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = signal.slice_samples(s.dense(spark, sf_dir), FIRST, AMOUNT)
    return signal.long_form(signal.column_major(part, SENSORS), SENSORS).select("sensor", "sample", "value")


@query(f"with {DENSE_SQL} select sensor, sample, cast(round(value / 256.0 * (1 / scale)) as integer) as value from sparse join {SCALE_SQL} using (sensor)")
def scale_write(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signal.scale_write(s.physical(spark, sf_dir, s.every), electrodes(spark)).select("sensor", "sample", "value")


@query(f"with {DENSE_SQL} select sensor, sample, value * scale as value from sparse join {SCALE_SQL} using (sensor)")
def scale_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signal.scale_read(s.every(spark, sf_dir), electrodes(spark)).select("sensor", "sample", "value")


@query(f"with {epochs_sql('sparse')} select sensor, epoch, \"offset\", value from epochs")
def rechunk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return s.epochs(spark, sf_dir, s.every).select("sensor", "epoch", "offset", "value")


@query(f"with {EPOCHS_SQL}, e as (select epoch, count(distinct sample) as length from epochs group by epoch) select epoch, length, cast(sum(length) over (order by epoch) as bigint) as sample_count from e")
def running_sample_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    lengths = s.epochs(spark, sf_dir).groupBy("epoch").agg(F.count_distinct("sample").alias("length"))
    return signal.running_total(lengths)


@query(f"with {DENSE_SQL} select epoch, count(*) as cells, cast(sum(value * (sensor + 1)) as bigint) as weighted from (select *, sample // {EPOCH} as epoch from dense) group by epoch")
def epoch_matrix_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = signal.epoch_matrices(s.dense(spark, sf_dir), EPOCH)
    rows = m.select("epoch", F.posexplode("rows").alias("sensor", "row"))
    total = F.aggregate("row", F.lit(0).cast("long"), lambda acc, v: acc + v)
    return rows.groupBy("epoch").agg(F.sum(F.size("row")).cast("long").alias("cells"), F.sum(total * (F.col("sensor") + 1)).alias("weighted"))


# Differences and their inverses: in time of all samples, across sensors of the matrix

_SIG_ALL = f"with {smooth_sql('sparse')}, {deltas_sql('smooth')} select sensor, sample, epoch"
_SIG = f"with {SMOOTH_SQL}, {deltas_sql('smooth')} select sensor, sample, epoch"


@query(f"{_SIG_ALL}, t as residual from deltas")
def delta_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    return delta.time(delta.by_epoch(s.smooth(spark, sf_dir, s.every))).select("sensor", "sample", "epoch", "residual")


@query(f"{_SIG_ALL}, t2 as residual from deltas")
def delta_time2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return delta.time2(delta.by_epoch(s.smooth(spark, sf_dir, s.every))).select("sensor", "sample", "epoch", "residual")


@query(f"{_SIG}, c as residual from deltas")
def delta_chan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return delta.chan(delta.by_epoch(s.smooth(spark, sf_dir))).select("sensor", "sample", "epoch", "residual")


_SMOOTH_ALL = f"with {smooth_sql('sparse')} select sensor, sample, epoch, value from smooth"
_SMOOTH = f"with {SMOOTH_SQL} select sensor, sample, epoch, value from smooth"
_KEPT = ("sensor", "sample", "epoch", "value")
#: Bits of the words that are restored: those of ``smooth``, which outgrows 32 bits from 46,341 samples a sensor on.
WIDTH = 64


@query(_SMOOTH_ALL)
def restore_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    return delta.restore_time(delta.time(delta.by_epoch(s.smooth(spark, sf_dir, s.every)), width=WIDTH).drop("value"), width=WIDTH).select(*_KEPT)


@query(_SMOOTH_ALL)
def restore_time2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return delta.restore_time2(delta.time2(delta.by_epoch(s.smooth(spark, sf_dir, s.every)), width=WIDTH).drop("value"), width=WIDTH).select(*_KEPT)


@query(_SMOOTH)
def restore_chan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return delta.restore_chan(delta.chan(delta.by_epoch(s.smooth(spark, sf_dir)), width=WIDTH).drop("value"), width=WIDTH).select(*_KEPT)


@query(_SMOOTH)
def restore_mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = delta.by_epoch(s.smooth(spark, sf_dir))
    all_three = delta.chan(delta.time2(delta.time(base, width=WIDTH, out="r1"), width=WIDTH, out="r2"), width=WIDTH, out="r3")
    method = F.pmod(F.col("sensor") + F.col("epoch"), F.lit(4)).cast("int")
    picked = F.when(F.col("method") == 0, F.col("value")).when(F.col("method") == 1, F.col("r1")).when(F.col("method") == 2, F.col("r2")).otherwise(F.col("r3"))
    coded = all_three.withColumn("method", method).withColumn("residual", picked.cast("long")).drop("value", "r1", "r2", "r3")
    return delta.restore_mixed(coded, width=WIDTH).select(*_KEPT)


# Sizes


@query(f"with {residuals_sql()} select sensor, epoch, sample, method, residual, cast(width as integer) as width from residuals")
def bit_width(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = s.residuals(spark, sf_dir)
    return r.select("sensor", "epoch", "sample", "method", "residual", cost.bit_width(F.col("residual")).alias("width"))


@query(f"with {DENSE_SQL} select sensor, sample, case when (value & 4095) >= 2048 then (value & 4095) - 4096 else (value & 4095) end as value from sparse")
def sign_extend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return s.every(spark, sf_dir).withColumn("value", cost.restore_sign(F.col("value"), 12))


@query(f"with {residuals_sql()} select sensor, epoch, method, cast(width as integer) as width, count(*) as n, cast(sum(marker) as bigint) as markers from residuals where not first group by 1, 2, 3, 4")
def width_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cost.width_histogram(s.residuals(spark, sf_dir))


@query(f"with {costs_sql()} select sensor, epoch, method, n, cast(bits as bigint) as bits from costs")
def cost_per_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cost.cost_per_n(s.residuals(spark, sf_dir)).select("sensor", "epoch", "method", "n", "bits")


_BEST = "best as (select sensor, epoch, method, min({'bits': bits, 'n': n}) as b, min(nexc) as nexc, min(samples) as samples from costs group by 1, 2, 3)"


@query(f"with {costs_sql()}, {_BEST} select sensor, epoch, method, b.n as n, cast(nexc as integer) as nexc, cast(b.bits as bigint) as bits, cast(ceil(b.bits / 8.0) as bigint) as bytes from best")
def best_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cost.best_n(s.residuals(spark, sf_dir)).drop("samples")


_METHOD = f"""{costs_sql()}, {_BEST},
every as (select sensor, epoch, method, cast(ceil(b.bits / 8.0) as bigint) as bytes from best union all
  select sensor, epoch, 0, 1 + 4 * count(*) from smooth group by 1, 2),
chosen as (select sensor, epoch, min({{'bytes': bytes, 'method': method}}) as m from every group by 1, 2)"""


@query(f"with {_METHOD} select sensor, epoch, m.method as method, m.bytes as bytes from chosen")
def best_method(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cost.best_method(s.residuals(spark, sf_dir))


@query("select l_orderkey, l_linenumber, case when greatest(l_quantity, l_linenumber) <= 16 then 16 when greatest(l_quantity, l_linenumber) <= 64 then 32 end as size from lineitem")
def min_word_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = s.table(spark, sf_dir, "lineitem")
    narrow = F.least(F.col("l_quantity").cast("int"), F.lit(32))
    return li.select("l_orderkey", "l_linenumber", cost.word_size(narrow, F.col("l_linenumber")).alias("size"))


@query(f"with {EPOCHS_SQL} select epoch, count(distinct sample) * 4 + 1 as bytes from epochs group by epoch")
def block_upper_bound(spark: SparkSession, sf_dir: str) -> DataFrame:
    return s.epochs(spark, sf_dir).groupBy("epoch").agg(F.count_distinct("sample").alias("n")).select("epoch", cost.block_bound(F.col("n")).alias("bytes"))


@query(f"with {residuals_sql()} select sensor, epoch, sample, method, width > 8 or (width = 8 and marker = 1) as exception from residuals")
def exception_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = s.residuals(spark, sf_dir)
    return r.select("sensor", "epoch", "sample", "method", cost.is_exception(F.col("residual"), F.lit(8)).alias("exception"))


# Codec: what comes back must be what went in


@query(f"with {SMOOTH_SQL} select sensor, sample, epoch, cast(value as integer) as value from smooth")
def codec_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of 32 bits: values beyond them come back folded."""
    x = s.smooth(spark, sf_dir).select("sensor", "sample", "value")
    return codec.decode_epochs(codec.encode_epochs(x, EPOCH, fold=True), SENSORS, EPOCH)


@query(f"with {SMOOTH_SQL} select sensor, sample, epoch, value from smooth")
def codec_roundtrip_extended(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = s.smooth(spark, sf_dir).select("sensor", "sample", "value")
    return codec.decode_epochs(codec.encode_epochs(x, EPOCH, layout="extended", kind="int64"), SENSORS, EPOCH, "extended", "int64")


@query(f"with {_METHOD} select epoch, cast(sum(m.bytes) as bigint) as bytes from chosen group by epoch")
def codec_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = s.smooth(spark, sf_dir).select("sensor", "sample", "value")
    return codec.encode_epochs(x, EPOCH, fold=True).select("epoch", F.length("data").cast("long").alias("bytes"))


@query("select o_orderkey, cast(round(o_totalprice * 100) as bigint) - 10000000 as number from orders")
def leb128_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = F.round(F.col("o_totalprice") * 100).cast("long") - 10_000_000
    return s.table(spark, sf_dir, "orders").select("o_orderkey", leb128.unleb128(leb128.leb128(number)).alias("number"))


# Events, triggers, texts


@query(f"with {DENSE_SQL} select sample, left(event_type, 8) as code from sparse where event_type = 'error'")
def trigger_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return s.sparse(spark, sf_dir).where("event_type = 'error'").select("sample", text.trigger_code(F.col("event_type")).alias("code"))


@query("select p_partkey, left(split_part(p_name, chr(0), 1), 8) as code from part")
def trigger_code_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    return s.table(spark, sf_dir, "part").select("p_partkey", text.trigger_code(F.col("p_name")).alias("code"))


_LABEL_RULE = "strlen({0}) <= {1} and not contains({0}, ' ') and not contains({0}, chr(0))"


@query(f"""select o_orderkey, {_LABEL_RULE.format("o_orderstatus", 10)} and o_orderstatus != '' and left(o_orderstatus, 1) not in ('[', ';')
  and {_LABEL_RULE.format("o_orderpriority", 10)} and o_orderpriority != '' and isfinite(o_totalprice) as valid from orders""")
def electrode_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same rules over names that are units and names that are not."""
    as_electrodes = s.table(spark, sf_dir, "orders").select(
        "o_orderkey", F.col("o_orderstatus").alias("label"), F.col("o_orderpriority").alias("unit"), F.lit("").alias("reference"), F.lit("").alias("status"), F.lit("").alias("type"),
        F.col("o_totalprice").alias("iscale"), F.lit(1.0).alias("rscale"),
    )
    return as_electrodes.select("o_orderkey", validate.valid_electrode().alias("valid"))


@query("""select event_id, floor((epoch_us(ts) + 2209161600000000) / 1000000) / 86400.0 as day, (epoch_us(ts) % 1000000) / 1e6 as part from events""")
def dcdate_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return s.table(spark, sf_dir, "events").select("event_id", dates.day_number(F.col("ts")).alias("day"), dates.second_part(F.col("ts")).alias("part"))


@query("select event_id, epoch_us(ts) as us from events")
def dcdate_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = s.table(spark, sf_dir, "events").select("event_id", dates.day_number(F.col("ts")).alias("day"), dates.second_part(F.col("ts")).alias("part"))
    return e.select("event_id", F.unix_micros(dates.timestamp_of(F.col("day"), F.col("part"))).alias("us"))


@query("""select o_orderkey, (1 + l % 13) between 1 and 12 and (1 + o_orderkey % 31) <= (case when 1 + l % 13 > 12 then 0 else day(last_day(make_date(2023, cast(least(1 + l % 13, 12) as integer), 1))) end) as valid
  from (select o_orderkey, o_custkey as l from orders)""")
def civil_time_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = s.table(spark, sf_dir, "orders")
    month, day = (1 + F.col("o_custkey") % 13).cast("int"), (1 + F.col("o_orderkey") % 31).cast("int")
    return o.select("o_orderkey", dates.valid_civil_time(F.lit(2023), month, day, F.lit(0), F.lit(0), F.lit(0)).alias("valid"))


@query("select n_nationkey, rpad(left(n_name, 4), 4, ' ') as label from nation")
def label_pad(spark: SparkSession, sf_dir: str) -> DataFrame:
    return s.table(spark, sf_dir, "nation").select("n_nationkey", text.label4(F.col("n_name")).alias("label"))


def _as_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` in the shape of an archive: views are impedances, purchases videos, clicks epochs."""
    e = s.table(spark, sf_dir, "events").select(F.col("event_id").alias("ordinal"), F.col("ts").alias("stamp"), "event_type", "value")
    kind = F.pmod(F.col("ordinal"), F.lit(4))
    part = lambda k: e.where(kind == k)
    impedances = events.stored_impedances(part(0).withColumn("values", F.array((F.round("value") * 1000).cast("float"))))
    videos = events.stored_videos(
        part(1).select("*", F.lit(1.5).alias("duration"), F.col("ordinal").cast("int").alias("trigger_code"), F.col("event_type").alias("condition_label"), F.lit("d").alias("description"), F.lit("f").alias("video_file"))
    )
    epochs = events.stored_epochs(part(2).select("*", F.col("value").alias("duration"), F.lit(0.5).alias("offset"), F.lit(archive.NO_CODE).alias("trigger_code"), F.lit("").alias("condition_label")))
    markers = part(3).select(
        "ordinal", F.lit("marker").alias("class"), F.lit(archive.MARKER_NAME).alias("name"), F.lit(1).alias("type"), F.lit(0.0).alias("duration"), F.lit(0.0).alias("duration_offset"), "stamp",
        F.array().cast("array<struct<name:string,unit:string,type:string,is_array:boolean,data:array<string>>>").alias("descriptors"), F.lit("").alias("description"),
    )
    return impedances.unionByName(videos).unionByName(epochs).unionByName(markers)


_KIND_SQL = "case event_id % 4 when 0 then 'impedance' when 1 then 'video' when 2 then 'epoch' else 'marker' end"


@query(f"select {_KIND_SQL} as kind, count(*) as n from events group by 1")
def event_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.counts(_as_events(spark, sf_dir))


@query(f"select event_id as ordinal, {_KIND_SQL} as kind from events")
def event_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.classified(_as_events(spark, sf_dir)).select("ordinal", "kind")


@query("select event_id as ordinal, cast(round(value) * 1000 as float) as ohm from events where event_id % 4 = 0")
def impedance_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.impedances(_as_events(spark, sf_dir)).select("ordinal", F.col("values")[0].alias("ohm"))


@query("select event_id as ordinal, cast(1.5 as double) as duration, cast(event_id as integer) as trigger_code, event_type as condition_label, 'd' as description, 'f' as video_file from events where event_id % 4 = 1")
def video_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.videos(_as_events(spark, sf_dir)).drop("stamp")


@query("select event_id as ordinal, value as duration, cast(0.5 as double) as \"offset\", cast(-2147483648 as integer) as trigger_code, '' as condition_label from events where event_id % 4 = 2")
def epoch_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.epoch_events(_as_events(spark, sf_dir)).drop("stamp")


@query("select c_custkey, case when c_nationkey % 3 = 0 then 'male' when c_nationkey % 3 = 1 then 'female' else 'unknown' end as sex, case c_nationkey % 4 when 0 then 'left' when 1 then 'right' when 2 then 'mixed' else 'unknown' end as hand from customer")
def sex_hand_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = s.table(spark, sf_dir, "customer")
    k = F.col("c_nationkey")
    sex = F.when(k % 3 == 0, "male").when(k % 3 == 1, "female").otherwise("?")
    hand = F.when(k % 4 == 0, "left").when(k % 4 == 1, "right").when(k % 4 == 2, "mixed").otherwise("?")
    return c.select("c_custkey", text.sex_of(text.sex_char(sex)).alias("sex"), text.hand_of(text.hand_char(hand)).alias("hand"))


# The flagship: residuals of the dense signal by block


@query(f"with {epochs_sql('sparse')}, {deltas_sql('epochs')} select sensor, epoch, count(*) as n, min(t) as smallest, max(t) as largest, cast(sum(t) as bigint) as total from deltas group by 1, 2")
def residual_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = delta.time(delta.by_epoch(s.epochs(spark, sf_dir, s.every)))
    return r.groupBy("sensor", "epoch").agg(F.count(F.lit(1)).alias("n"), F.min("residual").alias("smallest"), F.max("residual").alias("largest"), F.sum("residual").alias("total"))
