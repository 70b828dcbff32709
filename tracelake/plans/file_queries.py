"""Registered queries that write recordings and event archives and read them back."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from datetime import datetime
from functools import cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake import api
from tracelake.functions import dates, leb128, text
from tracelake.operators import codec
from tracelake.plans import queries as q
from tracelake.plans import stand_in as s
from tracelake.plans.queries import AMOUNT, FIRST, RANGE, SENSORS, query
from tracelake.plans.stand_in import DENSE_SQL, EPOCH, EPOCHS_SQL, SMOOTH_SQL
from tracelake.sources import container
from tracelake.sources.files import plain_path

START = datetime(2024, 1, 31, 12, 34, 56, 500000)
INFO = {"hospital": "H", "subject_name": "Né Ä", "subject_sex": "female", "subject_handedness": "left", "subject_dob": datetime(1980, 2, 29, 1, 2, 3), "comment": "two words"}


@cache
def _own_folder() -> str:
    folder = tempfile.mkdtemp(prefix="recordings")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


def target(spark: SparkSession) -> str:
    """A new file name in the folder that driver and executors share (``spark.checkpoint.dir``); a
    local session without one gets a folder of its own."""
    import os

    sc = spark.sparkContext
    shared = sc.getConf().get("spark.checkpoint.dir")
    if not shared and sc.master.split("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    folder = f"{plain_path(shared)}/recordings" if shared else _own_folder()
    os.makedirs(folder, exist_ok=True)
    return f"{folder}/{uuid.uuid4().hex}.cnt"


def series(epoch: int = EPOCH) -> api.TimeSeries:
    return api.TimeSeries(256.0, [api.electrode(f"ch{k}", "ref", rscale=1 / 512 if k == 2 else None) for k in range(SENSORS)], epoch, START)


def recorded(spark: SparkSession, signal: DataFrame, kind: str = "RIFF", fold: bool = False, **more) -> api.Recording:
    path = target(spark)
    x = signal if fold else signal.withColumn("value", F.col("value").cast("int"))
    api.write_recording(x, path, series(), kind=kind, fold=fold, **more)
    return api.Recording(spark, path)


def nations(spark: SparkSession, sf_dir: str) -> list[tuple[int, str]]:
    rows = s.table(spark, sf_dir, "nation").orderBy("n_nationkey").collect()  # 25 by definition of the table
    return [(7 * r["n_nationkey"], r["n_name"]) for r in rows]


_EPOCHS = f"with {EPOCHS_SQL} select sensor, sample, epoch, cast(value as integer) as value from epochs"


# Signals


@query(_EPOCHS)
def file_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Container written by tasks, read by ranges of epochs."""
    return recorded(spark, s.dense(spark, sf_dir)).signal()


@query(_EPOCHS)
def file_signal_rf64(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recorded(spark, s.dense(spark, sf_dir), "RF64").signal()


@query(f"with {SMOOTH_SQL} select sensor, sample, epoch, cast(value as integer) as value from smooth where epoch <= 2 and sensor <= 3")
def file_signal_pushed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filters on epoch and sensor reach the reader."""
    return recorded(spark, s.smooth(spark, sf_dir), fold=True).signal().where("epoch <= 2 and sensor <= 3")


@query(f"with {DENSE_SQL} select sensor, sample, cast(value as integer) as value from dense where {RANGE}")
def file_range_int32(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recorded(spark, s.dense(spark, sf_dir)).samples_int32(FIRST, AMOUNT).select("sensor", "sample", "value")


@query(f"with {DENSE_SQL} select sensor, sample, value * scale as value from dense join {q.SCALE_SQL} using (sensor) where {RANGE}")
def file_range_scaled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recorded(spark, s.dense(spark, sf_dir)).samples(FIRST, AMOUNT).select("sensor", "sample", "value")


@query(f"with {DENSE_SQL} select sample, {q._pivot_sql('cast(value as integer)', 'dense')} where {RANGE} group by sample")
def file_column_major(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recorded(spark, s.dense(spark, sf_dir)).column_major_int32(FIRST, AMOUNT)


@query(f"with {DENSE_SQL} select sensor, cast(sample - {FIRST} as integer) as place, cast(value as integer) as value from dense where {RANGE}")
def file_row_major(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = recorded(spark, s.dense(spark, sf_dir)).row_major_int32(FIRST, AMOUNT)
    return rows.select("sensor", F.posexplode("samples").alias("place", "value"))


@query(f"with {EPOCHS_SQL} select sample, {q._pivot_sql('cast(value as integer)', 'epochs')} where epoch = 0 group by sample")
def file_epoch_column_major(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recorded(spark, s.dense(spark, sf_dir)).epoch_column_major_int32(0)


@query(f"with {EPOCHS_SQL} select sensor, \"offset\", cast(value as integer) as value from epochs where epoch = 0")
def file_epoch_row_major(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = recorded(spark, s.dense(spark, sf_dir)).epoch_row_major_int32(0)
    return rows.select("sensor", F.posexplode("samples").alias("offset", "value")).withColumn("offset", F.col("offset").cast("long"))


@query(f"with {q._METHOD}, n as (select epoch, count(distinct sample) as length from smooth group by epoch) select epoch, n.length as length, cast(sum(m.bytes) as bigint) as bytes from chosen join n using (epoch) group by epoch, n.length")
def file_epochs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coded epochs as they lie in the container: lengths, and bytes as predicted."""
    return recorded(spark, s.smooth(spark, sf_dir), fold=True).table("epochs").select("epoch", "length", F.length("data").cast("long").alias("bytes"))


@query(_EPOCHS)
def file_epochs_copied(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coded epochs of one container, written to another one as they are."""
    first, path = recorded(spark, s.dense(spark, sf_dir)), target(spark)
    api.write_epochs(first.table("epochs"), path, first.param, kind="RF64")
    return api.Recording(spark, path).signal()


@query(f"with {DENSE_SQL} select sensor, sample, value / 256.0 as value from dense")
def file_write_scaled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Physical values written and read back: exact, as they are whole numbers of the scale."""
    path = target(spark)
    api.write_recording(s.physical(spark, sf_dir), path, series(), scaled=True)
    r = api.Recording(spark, path)
    return r.samples(0, r.sample_count).select("sensor", "sample", "value")


# Header


@query(f"""with {EPOCHS_SQL} select 'RF64' as kind, 4 as version_major, 2 as version_minor, 256.0::double as sampling_frequency, {EPOCH}::bigint as epoch_length, max(sample) + 1 as sample_count,
  count(distinct epoch) as epochs, 5 as channels, 'first line' || chr(10) || 'second' || chr(10) as history, 'H' as hospital, 'Né Ä' as subject_name, 'female' as subject_sex, 'left' as subject_handedness,
  'two words' as comment, epoch_us(timestamp '2024-01-31 12:34:56.5') as start_us, epoch_us(timestamp '1980-02-29 01:02:03') as birth_us from epochs""")
def file_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    info = {k: dates.micros_of(v) if isinstance(v, datetime) else v for k, v in INFO.items()}
    h = recorded(spark, s.dense(spark, sf_dir), "RF64", info=info, history="first line\nsecond").header()
    plain = ("kind", "version_major", "version_minor", "sampling_frequency", "epoch_length", "sample_count", "epochs", "channels", "history", "hospital", "subject_name", "subject_sex", "subject_handedness", "comment")
    return h.select(*plain, F.unix_micros("start_time").alias("start_us"), F.unix_micros("subject_dob").alias("birth_us"))


@query("select cast(k as integer) as sensor, 'ch' || k as label, 'ref' as reference, 'uV' as unit, '' as status, '' as type, 1.0::double as iscale, case when k = 2 then 1 / 512 else 1 / 256 end as rscale from range(5) t(k)")
def file_electrodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recorded(spark, s.dense(spark, sf_dir)).electrodes()


@query("select n_nationkey as ordinal, 7 * n_nationkey as sample, left(n_name, 8) as code from nation")
def file_triggers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes keep eight bytes; order and repeats stay."""
    r = recorded(spark, s.dense(spark, sf_dir), triggers=nations(spark, sf_dir))
    return r.triggers().withColumn("ordinal", F.col("ordinal").cast("int")).withColumn("sample", F.col("sample").cast("int"))


@query(f"""with {EPOCHS_SQL}, n as (select count(distinct epoch) as n from epochs)
  select * from (values ('RIFF', 'CNT ', '/CNT ', null), ('eeph', '', '/CNT /eeph', null), ('info', '', '/CNT /info', null), ('LIST', 'raw3', '/CNT /raw3', null), ('chan', '', '/CNT /raw3/chan', 10),
    ('data', '', '/CNT /raw3/data', null), ('evt ', '', '/CNT /evt ', 300)) t(id, label, path, size)
  union all select 'ep  ', '', '/CNT /raw3/ep  ', 4 * (n + 1) from n""")
def file_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tree of chunks, with the sizes that follow from the counts."""
    r = recorded(spark, s.dense(spark, sf_dir), triggers=nations(spark, sf_dir))
    known = F.col("id").isin("chan", "ep  ", "evt ")
    return r.table("chunks").select("id", "label", "path", F.when(known, F.col("size")).alias("size"))


@query("select 'usr ' as label, cast(strlen(string_agg(n_name, chr(10) order by n_nationkey)) as bigint) as size, string_agg(n_name, chr(10) order by n_nationkey) as content from nation")
def file_embedded(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = f"{target(spark)}.txt"
    with open(name, "w", encoding="utf-8") as f:
        f.write("\n".join(x for _, x in nations(spark, sf_dir)))
    r = recorded(spark, s.dense(spark, sf_dir), embed=[("usr", name)])
    return r.table("embedded").select("label", "size", F.decode("content", "UTF-8").alias("content"))


# Writers and part files

#: Samples of the arrays that queries append on the driver: made, not read from a table.
APPENDED = 1300
_APPENDED = f"with x as (select k as sensor, i as sample, (i * 31 + k * 7) % 997 - 400 as value from range(5) a(k), range({APPENDED}) b(i))"


def appended(spark: SparkSession, close: bool = True, **more) -> api.Recording:
    """Arrays in all layouts, small pieces first, then what is left."""
    i, k = np.arange(APPENDED)[None], np.arange(SENSORS)[:, None]
    x = ((i * 31 + k * 7) % 997 - 400).astype(np.int32)
    scale = np.array([e["iscale"] * e["rscale"] for e in series().electrodes])[:, None]
    w = api.RecordingWriter(spark, target(spark))
    w.param(series())
    w.row_major_int32(x[:, :3])
    w.column_major_int32(x[:, 3:200].T)
    w.row_major(x[:, 200:700] * scale)
    w.column_major((x[:, 700:1000] * scale).T)
    w.column_major_float32((x[:, 1000:] * scale).T)
    w.trigger(3, "Frequent")
    w.info(**more)
    if close:
        w.close()
        return api.Recording(spark, w.path)
    w.flush()
    return api.Recording(spark, w.path, layout="parts")


@query(f"{_APPENDED} select cast(sensor as integer) as sensor, sample, sample // {EPOCH} as epoch, cast(value as integer) as value from x")
def writer_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    return appended(spark).signal()


@query(f"{_APPENDED} select cast(sensor as integer) as sensor, sample, sample // {EPOCH} as epoch, cast(value as integer) as value from x where sample < {APPENDED // EPOCH * EPOCH}")
def writer_flushed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a writer that never closed leaves: all whole epochs, in part files."""
    return appended(spark, close=False).signal()


@query(f"select 'RIFF' as kind, {APPENDED // EPOCH * EPOCH}::bigint as sample_count, {APPENDED // EPOCH}::bigint as epochs, 5 as channels, 'N' as subject_name, 'Frequent' as code")
def writer_flushed_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = appended(spark, close=False, subject_name="N")
    return r.header().select("kind", "sample_count", "epochs", "channels", "subject_name", F.lit(r.triggers().first()["code"]).alias("code"))


@query(_EPOCHS)
def parts_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coded epochs streamed into part files, and read from there."""
    path, h = target(spark), api.header_of(series())
    w = container.PartWriter(path, h)
    for r in codec.encode_epochs(s.dense(spark, sf_dir), EPOCH).orderBy("epoch").toLocalIterator():
        w.append(bytes(r["data"]), r["length"])
    w.flush()
    w.close()
    return api.Recording(spark, path, layout="parts").signal()


# Event archives


def archived(spark: SparkSession, sf_dir: str) -> api.Recording:
    path = target(spark)
    api.write_event_table(q._as_events(spark, sf_dir), path.removesuffix("cnt") + "evt")
    return api.Recording(spark, path)


_KIND = q._KIND_SQL


@query(f"select event_id as ordinal, {_KIND} as kind, cast(event_id + 1 as integer) as visible_id, epoch_us(ts) as us from events")
def archive_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archived(spark, sf_dir).events().select("ordinal", "kind", "visible_id", F.unix_micros("stamp").alias("us"))


@query("select event_id as ordinal, epoch_us(ts) as us, cast(round(value) * 1000 as float) as ohm from events where event_id % 4 = 0")
def archive_impedances(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archived(spark, sf_dir).impedances().select("ordinal", F.unix_micros("stamp").alias("us"), F.col("values")[0].alias("ohm"))


@query("select event_id as ordinal, 1.5::double as duration, cast(event_id as integer) as trigger_code, event_type as condition_label, 'd' as description, 'f' as video_file from events where event_id % 4 = 1")
def archive_videos(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archived(spark, sf_dir).videos().drop("stamp")


@query("select event_id as ordinal, value as duration, 0.5::double as \"offset\", cast(-2147483648 as integer) as trigger_code, '' as condition_label from events where event_id % 4 = 2")
def archive_epochs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archived(spark, sf_dir).epoch_events().drop("stamp")


@query(f"select {_KIND} as kind, count(*) as n from events group by 1")
def archive_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archived(spark, sf_dir).event_counts()


@query("select case n_nationkey % 3 when 0 then 'impedance' when 1 then 'video' else 'epoch' end as kind, epoch_us(timestamp '2024-01-31 12:34:56.5') + n_nationkey * 1000000 as us from nation")
def archive_journal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of an archive that was not closed, from its journal."""
    path = target(spark)
    w = api.EventWriter(path.removesuffix("cnt") + "evt")
    for k in range(len(nations(spark, sf_dir))):
        at = dates.datetime_of(dates.micros_of(START) + k * 1_000_000)
        (w.impedance(at, [5000.0]), ) if k % 3 == 0 else w.video(at, 1.0) if k % 3 == 1 else w.epoch(at, 2.0)
    return api.Recording(spark, path, layout="parts").events().select("kind", F.unix_micros("stamp").alias("us"))


# Typed codecs, numbers, times


def _typed(spark: SparkSession, sf_dir: str, kind: str, value) -> DataFrame:
    x = s.dense(spark, sf_dir).select("sensor", "sample", value.cast(codec.TYPES[kind][1]).alias("value"))
    back = codec.decode_epochs(codec.encode_epochs(x, EPOCH, layout="extended", kind=kind), SENSORS, EPOCH, "extended", kind)
    return back.select("sensor", "sample", F.col("value").cast("decimal(20,0)").cast("string").alias("value"))


def _typed_sql(value: str) -> str:
    return f"with {DENSE_SQL} select sensor, sample, cast(cast({value} as hugeint) as varchar) as value from dense"


@query(_typed_sql("value % 32768"))
def codec_int16(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _typed(spark, sf_dir, "int16", F.col("value") % 32768)


@query(_typed_sql("(value * 7) & 65535"))
def codec_uint16(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _typed(spark, sf_dir, "uint16", (F.col("value") * 7).bitwiseAND(65535))


@query(_typed_sql("(value * 65537) & 4294967295"))
def codec_uint32(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _typed(spark, sf_dir, "uint32", (F.col("value") * 65537).bitwiseAND(F.lit((1 << 32) - 1)))


@query(_typed_sql("18446744073709551615::hugeint - abs(value)"))
def codec_uint64(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _typed(spark, sf_dir, "uint64", F.lit("18446744073709551615").cast("decimal(20,0)") - F.abs("value"))


@query(f"with {EPOCHS_SQL} select epoch, epoch % 2 = 0 as readable from epochs group by epoch")
def codec_null_if_malformed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of odd epochs are cut; decoding gives null instead of an error."""
    x = codec.encode_epochs(s.dense(spark, sf_dir), EPOCH)
    raw = F.when(F.col("epoch") % 2 == 0, F.col("data")).otherwise(F.substring("data", 1, 3))
    m = codec.decoded(raw, F.col("length"), SENSORS, or_null=True)
    return x.select("epoch", m.isNotNull().alias("readable"))


@query(f"with {EPOCHS_SQL} select sensor, sample, epoch, value from epochs")
def codec_row_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows coded in another order, and restored."""
    m = codec.epoch_matrices(s.dense(spark, sf_dir), EPOCH)
    coded = m.select("epoch", "length", codec.encoded(F.col("rows"), order=q.ORDER).alias("data"))
    return codec.decode_epochs(coded, SENSORS, EPOCH, order=q.ORDER).withColumn("value", F.col("value").cast("long"))


@query("select o_orderkey, cast(round(o_totalprice * 100) as bigint) as number, case when round(o_totalprice * 100) < 2097152 then 3 when round(o_totalprice * 100) < 268435456 then 4 else 5 end as bytes from orders")
def leb128_unsigned(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = s.table(spark, sf_dir, "orders").select("o_orderkey", leb128.leb128(F.round(F.col("o_totalprice") * 100).cast("long"), signed=False).alias("raw"))
    return o.select("o_orderkey", leb128.unleb128(F.col("raw"), signed=False).alias("number"), F.octet_length("raw").alias("bytes"))


@query("select event_id, strftime(ts, '%Y-%m-%d %H:%M:%S:') || lpad(cast(epoch_us(ts) % 1000000 * 1000 as varchar), 12, '0') as told from events")
def time_as_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return s.table(spark, sf_dir, "events").select("event_id", dates.as_text(F.col("ts")).alias("told"))


@query("select event_id, cast(year(ts) as integer) as year, cast(month(ts) as integer) as month, cast(day(ts) as integer) as day, cast(hour(ts) as integer) as hour, cast(minute(ts) as integer) as minute, cast(second(ts) as integer) as second, epoch_us(ts) - epoch_us(ts) % 1000000 as us from events")
def civil_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ("year", "month", "day", "hour", "minute", "second")
    e = s.table(spark, sf_dir, "events").select("event_id", dates.civil_of(F.col("ts")).alias("c")).select("event_id", "c.*")
    return e.withColumn("us", F.unix_micros(dates.timestamp_of_civil(*[F.col(k) for k in names])))


@query("select p_partkey, try_cast(p_partkey * 13 as smallint) as small, try_cast(p_size - 25 as tinyint) as tiny from part")
def narrowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = s.table(spark, sf_dir, "part")
    return p.select("p_partkey", text.narrowed(F.col("p_partkey") * 13, "smallint").alias("small"), text.narrowed(F.col("p_size") - 25, "tinyint").alias("tiny"))


@query("""select p_partkey, case p_partkey % 4 when 0 then 'éé12345'[:6] when 1 then 'aééé' || 'é'[:0] when 2 then 'ab' else '日本' end as code,
  case p_partkey % 4 when 0 then 'éé' when 1 then 'aé ' when 2 then 'ab  ' else '日 ' end as label from part""")
def byte_cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes keep eight bytes, labels four; no character is cut in two."""
    k = F.col("p_partkey") % 4
    code = F.when(k == 0, "éé12345").when(k == 1, "aéééé").when(k == 2, "ab\0cd").otherwise("日本語")
    label = F.when(k == 0, "ééé").when(k == 1, "aéé").when(k == 2, "ab").otherwise("日本")
    return s.table(spark, sf_dir, "part").select("p_partkey", text.trigger_code(code).alias("code"), text.label4(label).alias("label"))
