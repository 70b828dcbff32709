"""Events: classes, and the public kinds from and to their stored form.

Input is the table of the ``evt`` source; descriptors are arrays of (name, unit, type, is_array,
data).  All of it is expressions on a row, but for counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelake.sources import archive

KINDS = ("impedance", "video", "marker", "epoch", "artefact", "spike", "seizure", "sleep", "rpeak")


def _first(name: str) -> Column:
    """First descriptor of that name, or null."""
    return F.get(F.filter("descriptors", lambda d: d["name"] == name), 0)


def _scalar(d: Column, kind: str) -> Column:
    return F.when((d["type"] == kind) & ~d["is_array"] & (F.size(d["data"]) == 1), d["data"][0])


#: Column types of a descriptor's value, by its type.
VALUE_TYPES = {"i1": "tinyint", "i2": "smallint", "i4": "int", "u1": "smallint", "u2": "int", "u4": "bigint", "r4": "float", "r8": "double", "bstr": "string", "bool": "boolean"}


def holds(d: Column, kind: str, array: bool = False) -> Column:
    """True if a descriptor's value has that type; false for null."""
    return F.coalesce((d["type"] == kind) & (d["is_array"] == array), F.lit(False))


def value_as(d: Column, kind: str, array: bool = False) -> Column:
    """A descriptor's value as that type; null if it has another one."""
    own = VALUE_TYPES[kind]
    typed = (lambda x: x.cast("int").cast(own)) if kind == "bool" else (lambda x: x.cast(own))
    if array:
        return F.when(holds(d, kind, True), F.transform(d["data"], typed))
    return F.when(holds(d, kind) & (F.size(d["data"]) == 1), typed(F.get(d["data"], 0)))


def is_impedance() -> Column:
    d = _first(archive.IMPEDANCE)
    return (F.col("class") == "marker") & F.coalesce((d["type"] == "r4") & d["is_array"], F.lit(False))


def is_video() -> Column:
    return (F.col("class") == "marker") & ~is_impedance() & F.exists("descriptors", lambda d: d["name"] == archive.VIDEO_TYPE)


def classified(events: DataFrame) -> DataFrame:
    """``kind``: impedance, video, or the class."""
    return events.withColumn("kind", F.when(is_impedance(), "impedance").when(is_video(), "video").otherwise(F.col("class")))


def ohm(kilo: Column) -> Column:
    """kOhm to Ohm, in 32-bit numbers."""
    return F.transform(kilo, lambda v: (v.cast("float") * F.lit(1000).cast("float")).cast("float"))


def kilo_ohm(values: Column) -> Column:
    return F.transform(values, lambda v: (v.cast("float") / F.lit(1000).cast("float")).cast("float"))


def impedances(events: DataFrame) -> DataFrame:
    """ordinal, stamp, values (Ohm)."""
    return events.where(is_impedance()).select("ordinal", "stamp", ohm(_first(archive.IMPEDANCE)["data"].cast("array<float>")).alias("values"))


def _code() -> Column:
    return F.coalesce(_scalar(_first(archive.EVENT_CODE), "i4").cast("int"), F.lit(archive.NO_CODE))


def _condition() -> Column:
    return F.coalesce(_scalar(_first(archive.CONDITION), "bstr"), F.lit(""))


def videos(events: DataFrame) -> DataFrame:
    """ordinal, stamp, duration, trigger_code, condition_label, description, video_file."""
    return events.where(is_video()).select(
        "ordinal", "stamp", "duration", _code().alias("trigger_code"), _condition().alias("condition_label"), "description",
        F.coalesce(_scalar(_first(archive.VIDEO_FILE), "bstr"), F.lit("")).alias("video_file"),
    )


def epoch_events(events: DataFrame) -> DataFrame:
    """ordinal, stamp, duration, offset, trigger_code, condition_label."""
    return events.where("class = 'epoch'").select("ordinal", "stamp", "duration", F.col("duration_offset").alias("offset"), _code().alias("trigger_code"), _condition().alias("condition_label"))


def event_at(table: DataFrame, i: int) -> DataFrame:
    """The i-th event of a public kind, from 0, in the order of the archive; empty if there is none."""
    return table.orderBy("ordinal").offset(i).limit(1) if i >= 0 else table.limit(0)


def counts(events: DataFrame) -> DataFrame:
    """Events of each kind."""
    return classified(events).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


def numbered(events: DataFrame) -> DataFrame:
    """``visible_id`` from 1 in the order of ``ordinal`` (an archive, which is one file)."""
    return events.withColumn("visible_id", F.row_number().over(Window.orderBy("ordinal")))


def _descriptor(name: str, kind: str, data: Column, unit: str = "", array: bool = False) -> Column:
    return F.struct(F.lit(name).alias("name"), F.lit(unit).alias("unit"), F.lit(kind).alias("type"), F.lit(array).alias("is_array"), data.alias("data"))


def _labels() -> list[Column]:
    text = F.coalesce(F.col("condition_label"), F.lit(""))
    code = F.coalesce(F.col("trigger_code"), F.lit(archive.NO_CODE))
    return [
        F.when(text != "", _descriptor(archive.CONDITION, "bstr", F.array(text))),
        F.when(code != archive.NO_CODE, _descriptor(archive.EVENT_CODE, "i4", F.array(code.cast("string")))),
    ]


def stored_impedances(table: DataFrame) -> DataFrame:
    """Impedances (stamp, values in Ohm) as stored markers."""
    data = F.transform(kilo_ohm(F.col("values")), lambda v: F.format_string("%.6f", v))
    return _stored(table, "marker", F.array(_descriptor(archive.IMPEDANCE, "r4", data, "kOhm", True)), F.lit(0.0), F.lit(0.0), F.lit(archive.IMPEDANCE))


def stored_videos(table: DataFrame) -> DataFrame:
    file = F.coalesce(F.col("video_file"), F.lit(""))
    parts = [*_labels(), _descriptor(archive.VIDEO_TYPE, "i2", F.array(F.lit("0"))), F.when(file != "", _descriptor(archive.VIDEO_FILE, "bstr", F.array(file)))]
    return _stored(table, "marker", F.array_compact(F.array(*parts)), F.col("duration"), F.lit(0.0), F.col("description"))


def stored_epochs(table: DataFrame) -> DataFrame:
    return _stored(table, "epoch", F.array_compact(F.array(*_labels())), F.col("duration"), F.col("offset"), F.lit(None).cast("string"))


def _stored(table: DataFrame, kind: str, descriptors: Column, duration: Column, offset: Column, description: Column) -> DataFrame:
    marker = kind == "marker"
    return table.select(
        "ordinal", F.lit(kind).alias("class"), F.lit(archive.MARKER_NAME if marker else archive.EPOCH_NAME).alias("name"), F.lit(archive.MARKER_TYPE if marker else archive.EPOCH_TYPE).alias("type"),
        duration.alias("duration"), offset.alias("duration_offset"), "stamp", descriptors.alias("descriptors"), description.alias("description"),
    )
