from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tracelake.errors import DataError, LimitError
from tracelake.functions import dates, leb128, text
from tracelake.operators import events, validate
from tracelake.sources import container


@pytest.mark.parametrize(
    "when,day",
    [(datetime(1899, 12, 30), 0), (datetime(1899, 12, 29), -1), (datetime(1899, 12, 29, 6), -0.75), (datetime(1900, 1, 1, 6), 2.25), (datetime(2020, 12, 29), 44194)],
)
def test_day_numbers(when, day):
    us = dates.micros_of(when)
    assert dates.from_micros(us) == (day, 0.0)
    assert dates.to_micros(day, 0.0) == us


def test_odd_dates():
    for date, fraction in ((1.0, -0.5), (1e200, 0.0), (0.0, 1e200), (float("nan"), 0.0)):
        with pytest.raises(LimitError):
            dates.to_micros(date, fraction)
    us = dates.to_micros(-159.3, 0.265)
    assert dates.to_micros(*dates.from_micros(us)) == us
    assert dates.to_micros(1.0, 1.5) == dates.to_micros(1.0, 0.0) + 1_500_000


def test_date_columns(spark):
    rows = [(datetime(1899, 12, 29, 6, 0, 0, 250000),), (datetime(2020, 1, 2, 3, 4, 5, 678901),), (None,)]
    df = spark.createDataFrame(rows, "t timestamp").select("t", dates.day_number(F.col("t")).alias("d"), dates.second_part(F.col("t")).alias("p"))
    got = df.select("t", dates.timestamp_of(F.col("d"), F.col("p")).alias("back"), "d", "p").collect()
    assert all(r["t"] == r["back"] for r in got)
    assert got[0]["d"] == -0.75 and got[0]["p"] == 0.25
    bad = spark.createDataFrame([(1.0, -0.5), (1e200, 0.0)], "d double, p double")
    assert all(r[0] is None for r in bad.select(dates.timestamp_of(F.col("d"), F.col("p"))).collect())


def test_civil_time(spark):
    rows = [(2024, 2, 29, True), (2023, 2, 29, False), (2023, 13, 1, False), (2023, 4, 31, False), (None, 1, 1, False)]
    df = spark.createDataFrame(rows, "y int, m int, d int, ok boolean")
    got = df.select("ok", dates.valid_civil_time(F.col("y"), F.col("m"), F.col("d"), F.lit(1), F.lit(2), F.lit(3)).alias("v")).collect()
    assert all(r["ok"] == r["v"] for r in got)


def test_text_columns(spark):
    df = spark.createDataFrame([("ab", "code12345", "µV"), ("abcdef", "a\0b", "uV"), (None, None, None)], "l string, c string, u string")
    got = df.select(text.label4(F.col("l")), text.trigger_code(F.col("c")), text.plain_unit(F.col("u"))).collect()
    assert [tuple(r) for r in got] == [("ab  ", "code1234", "uV"), ("abcd", "a", "uV"), (None, None, None)]
    line = spark.createDataFrame([("Cz 1 0.5 uV REF:A1 STAT:ok TYPE:EEG",)], "s string")
    assert line.select(text.electrode_field(F.col("s"), "STAT:")).first()[0] == "ok"


def test_leb128_columns(spark):
    df = spark.createDataFrame([(-5,), (300,), (None,)], "x long")
    assert [r[0] for r in df.select(leb128.unleb128(leb128.leb128(F.col("x")))).collect()] == [-5, 300, None]


def test_electrode_rules(spark):
    rows = [("Cz", "uV", "", 1.0, True), ("", "uV", "", 1.0, False), ("C z", "uV", "", 1.0, False), ("[C", "uV", "", 1.0, False), (";C", "uV", "", 1.0, False), ("C\0", "uV", "", 1.0, False), ("12345678901", "uV", "", 1.0, False), ("Cz", "", "", 1.0, False), ("Cz", "uV", "1234567890", 1.0, False), ("Cz", "uV", None, float("nan"), False), ("Cz", "uV", None, 1.0, True)]
    df = spark.createDataFrame(rows, "label string, unit string, reference string, iscale double, ok boolean").withColumns({"status": F.lit(""), "type": F.lit(""), "rscale": F.lit(1.0)})
    assert all(r["ok"] == r["v"] for r in df.select("ok", validate.valid_electrode().alias("v")).collect())


def test_header_rules(spark):
    e = spark.createDataFrame([(0, "a", "", "uV", "", "", 1.0, 1.0)], "sensor int, label string, reference string, unit string, status string, type string, iscale double, rscale double")
    h = spark.createDataFrame([(100.0, 8, 9, 1, [0]), (0.0, 8, 9, 1, [0]), (100.0, 8, 9, 2, [0]), (100.0, 8, 9, 1, [1])], "sampling_frequency double, epoch_length long, sample_count long, channels int, row_order array<int>")
    assert [r["valid"] for r in validate.valid_header(h, e).collect()] == [True, False, False, False]
    assert [r["valid"] for r in validate.valid_header(h, e.limit(0)).collect()] == [False] * 4


def test_chunk_kinds(spark):
    df = spark.createDataFrame([("RIFF", "CNT "), ("LIST", "raw3"), ("LIST", "stdd"), ("eeph", ""), ("evt ", ""), ("xevt", ""), ("usr ", "")], "id string, label string")
    assert [r[0] for r in df.select(validate.chunk_kind(F.col("id"), F.col("label"))).collect()] == ["root", "raw3", "deviation", "eeph", "triggers", "satellite", "user"]


def test_variants(spark):
    rows = [("i2", False, ["-3"]), ("u4", False, ["4294967295"]), ("r4", True, ["0.5", "2.0"]), ("r8", False, ["0.25"]), ("bool", False, ["1"]), ("bstr", False, ["é"]), ("empty", False, []), (None, None, None)]
    df = spark.createDataFrame([(k, r) for k, r in enumerate(rows)], "k int, d struct<type:string,is_array:boolean,data:array<string>>")
    d = F.col("d")
    wanted = [(t, False) for t in ("i2", "u4", "r8", "bool", "bstr")] + [("r4", True)]
    got = df.select(*[events.value_as(d, t, a).alias(t) for t, a in wanted], *[events.holds(d, t, a).alias(f"is_{t}") for t, a in wanted]).orderBy("k").collect()
    for t, v, at in (("i2", -3, 0), ("u4", 4294967295, 1), ("r4", [0.5, 2.0], 2), ("r8", 0.25, 3), ("bool", True, 4), ("bstr", "é", 5)):
        assert [r[t] for r in got] == [v if k == at else None for k in range(8)]
        assert [r[f"is_{t}"] for r in got] == [k == at for k in range(8)]


def test_event_by_index(spark):
    df = spark.createDataFrame([(5, "b"), (2, "a"), (9, "c")], "ordinal long, x string")
    assert [[r["x"] for r in events.event_at(df, i).collect()] for i in (-1, 0, 2, 3)] == [[], ["a"], ["c"], []]


def test_electrode_text():
    e = {"label": "Cz", "reference": "A1", "unit": "uV", "status": "ok", "type": "EEG", "iscale": 1.0, "rscale": 1 / 256}
    assert text.parse_electrodes([text.electrode_text(e)])[0] == e
    assert text.parse_electrodes(["; note", "A 1 2 uV ref", "[Next]"], old=True)[0]["reference"] == "ref"
    with pytest.raises(DataError):
        text.parse_electrodes(["A 1 uV"])


def test_info_and_header_text():
    birth = dates.micros_of(datetime(1990, 2, 3, 4, 5, 6))
    info = {"subject_name": "N", "subject_sex": "female", "subject_handedness": "mixed", "subject_dob": birth, "comment": "c"}
    start = dates.micros_of(datetime(2001, 2, 3, 4, 5, 6, 700000))
    day, part, found, there = container.parse_info(container.info_text(start, info))
    assert there and dates.to_micros(day, part) == start and found == info
    h = container.Header(sampling_frequency=255.9949866127, sample_count=7, electrodes=[{"label": "a", "unit": "uV", "iscale": 1.0, "rscale": 1.0}], history="x")
    said = container.parse_header_text(container.header_text(h))
    assert said["sampling_frequency"] == 255.9949866127 and said["sample_count"] == 7 and said["version"] == (4, 2) and said["history"] == "x\n"
    assert container.parse_birth("nothing") == 0  # 1970 stands for what is no time


def test_ranges_by_recording(spark):
    from tracelake.operators import signal

    df = spark.createDataFrame([("a", 0, 0), ("a", 1, 5), ("b", 0, 0), ("b", 1, 3), ("b", 2, 3)], "recording string, epoch long, offset long")
    got = signal.offsets_to_ranges(df, 9, 100, ("recording",)).orderBy("recording", "epoch").collect()
    assert [(r["fpos"], r["size"], r["valid"]) for r in got] == [(100, 5, True), (105, 4, True), (100, 3, True), (103, 0, False), (103, 6, True)]
    ranges = spark.createDataFrame([(0, 10, 5), (1, 15, 0), (2, 12, 3), (3, 20, 1)], "epoch long, fpos long, size long")
    assert [r["valid"] for r in validate.increasing_ranges(ranges).orderBy("epoch").collect()] == [True, False, False, True]
    for bucket in (1, 2):
        assert [r["valid"] for r in validate.increasing_ranges(ranges, bucket=bucket).orderBy("epoch").collect()] == [True, False, False, True]
    lengths = spark.createDataFrame([("a", 0, 4), ("a", 1, 2), ("b", 0, 1)], "recording string, epoch long, length long")
    assert [r["sample_count"] for r in signal.running_total(lengths, keys=("recording",)).orderBy("recording", "epoch").collect()] == [4, 6, 1]


def test_shapes(spark):
    from tracelake.errors import LimitError
    from tracelake.operators import signal

    rows = spark.createDataFrame([([[0, 1, 2], [3, 4, 5]],)], "m array<array<int>>")
    want = {(0, 0, 0), (0, 1, 1), (0, 2, 2), (1, 0, 3), (1, 1, 4), (1, 2, 5)}
    assert {(r["sensor"], r["sample"], r["value"]) for r in signal.rows_to_long(rows, "m").collect()} == want
    flat = spark.createDataFrame([([0, 3, 1, 4, 2, 5],)], "x array<int>")
    assert {(r["sensor"], r["sample"], r["value"]) for r in signal.flat_to_long(flat, "x", 2, "column").collect()} == want
    flat = spark.createDataFrame([([0, 1, 2, 3, 4, 5],)], "x array<int>")
    assert {(r["sensor"], r["sample"], r["value"]) for r in signal.flat_to_long(flat, "x", 2).collect()} == want
    with pytest.raises(Exception, match="multiple of 4"):
        signal.flat_to_long(flat, "x", 4).collect()
    for bad in ([0, 0, 1], [1, 2], [-1, 0]):
        with pytest.raises(LimitError):
            signal.order_table(spark, bad)
    long = signal.rows_to_long(rows, "m")
    with pytest.raises(Exception, match="missing or repeated"):
        signal.epoch_matrices(long.where("value != 4"), 3).collect()
    assert signal.epoch_matrices(long, 2).orderBy("epoch").collect()[1]["rows"] == [[2], [5]]
    assert signal.natural_order(spark, 3).count() == 3
