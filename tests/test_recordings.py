import io
import struct
from datetime import datetime

import numpy as np
import pytest

from tracelake import api
from tracelake.errors import BugError, DataError, LimitError
from tracelake.functions import codec
from tracelake.sources import archive, container
from tracelake.streaming.append import EpochStream

X = np.array([range(11, 17), range(21, 27), range(31, 37), range(41, 47)], dtype=float)


def series(n=4, epoch=6):
    return api.TimeSeries(1024.0, [api.electrode(str(i), "ref") for i in range(1, n + 1)], epoch, datetime(2020, 1, 2, 3, 4, 5, 678901))


@pytest.fixture(params=["RIFF", "RF64"])
def recording(request, spark, tmp_path):
    path = f"{tmp_path}/a.cnt"
    (tmp_path / "u.txt").write_text("odd")
    w = api.RecordingWriter(spark, path, request.param)
    w.param(series())
    w.info(subject_name="N", subject_sex="female")
    w.history("notes")
    w.column_major(X.T[:2])
    w.row_major(X[:, 2:4])
    w.row_major(X[:, 4:])
    w.triggers([(0, "Rare"), (3, "Frequent"), (5, "End"), (0, "Rare")])
    w.embed("usr", f"{tmp_path}/u.txt")
    w.events.impedance(datetime(2020, 1, 1), [1000.0, 2500.0])
    w.events.video(datetime(2020, 1, 1, 1), 2.5, 7, "cond", "desc", "f.avi")
    w.events.epoch(datetime(2020, 1, 1, 2), 1.0, -0.5, 3, "é")
    w.close()
    return api.Recording(spark, path)


def test_round_trip(recording, tmp_path):
    r = recording
    assert (r.sample_count, r.epoch_count, r.history, r.file_version) == (6, 1, "notes\n", (4, 2))
    assert r.param == series() and r.info["subject_name"] == "N"
    assert [tuple(x)[1:] for x in r.column_major(0, 6).collect()] == [tuple(c) for c in X.T]
    assert [x["samples"] for x in r.row_major(1, 3).collect()] == X[:, 1:4].tolist()
    assert [tuple(x)[1:] for x in r.triggers().orderBy("ordinal").collect()] == [(0, "Rare"), (3, "Frequent"), (5, "End"), (0, "Rare")]
    assert r.impedances().first()["values"] == [1000.0, 2500.0]
    assert tuple(r.videos().first())[2:] == (2.5, 7, "cond", "desc", "f.avi")
    assert tuple(r.epoch_events().first())[2:] == (1.0, -0.5, 3, "é")
    assert {x["kind"]: x["n"] for x in r.event_counts().collect()} == {"impedance": 1, "video": 1, "epoch": 1}
    r.extract_embedded("usr", f"{tmp_path}/o.txt")
    assert (tmp_path / "o.txt").read_text() == "odd"
    with pytest.raises(LimitError):
        r.extract_embedded("none", f"{tmp_path}/p.txt")


def test_ranges_are_all_or_nothing(recording):
    for first, amount in ((-1, 2), (6, 1), (5, 2), (0, 0), (0, 7)):
        assert recording.samples_int32(first, amount).count() == 0
    with pytest.raises(DataError):
        recording.epoch_row_major(1)
    assert recording.epoch_column_major_int32(0).count() == 6
    assert bytes(recording.epoch_compressed(0).first()["data"]).hex() == "22a0b009000032215000003221f000003222900000"


def test_legacy(spark, tmp_path):
    w = api.LegacyWriter(spark, f"{tmp_path}/l.cnt", 256, [("a", "r", "uV"), ("b",)])
    w.add_samples([1.0, 2.0, 3.0, 4.0])
    w.close()
    r = api.LegacyReader(spark, f"{tmp_path}/l.cnt")
    assert (r.get_channel_count(), r.get_channel(0), r.get_sample_frequency(), r.get_sample_count(), r.get_trigger_count()) == (2, ("a", "uV", "r"), 256, 2, 0)
    assert r.get_samples(0, 2) == [1.0, 2.0, 3.0, 4.0]


def test_filters_choose_epochs(spark, tmp_path):
    path = f"{tmp_path}/b.cnt"
    df = spark.range(0, 3000).selectExpr("cast(id % 3 as int) as sensor", "id div 3 as sample", "cast(id * 31 % 997 as int) as value")
    api.write_recording(df, path, series(3, 64))
    r = api.Recording(spark, path)
    assert (r.sample_count, r.epoch_count) == (1000, 16)
    assert r.signal().select("sensor", "sample", "value").exceptAll(df).count() == 0
    got = r.signal().where("sample between 100 and 140 and sensor <= 1")
    assert got.count() == 82
    assert {x[0] for x in got.select("epoch").distinct().collect()} == {1, 2}


def test_phases(spark, tmp_path):
    path = tmp_path / "c.cnt"
    api.RecordingWriter(spark, str(path)).close()
    w = api.RecordingWriter(spark, str(path))
    with pytest.raises(BugError):
        w.row_major([1.0])
    w.param(series(1))
    with pytest.raises(BugError):
        w.param(series(1))
    with pytest.raises(LimitError):
        w.embed("eeph", "x")
    w.close()
    assert not path.exists()
    with pytest.raises(BugError):
        w.trigger(0, "x")
    w = api.RecordingWriter(spark, str(path))
    w.param(series(2))
    with pytest.raises(LimitError):
        w.column_major_int32([1, 2, 3])
    w.column_major_int32([1, 2])
    w.close()
    assert api.Recording(spark, str(path)).sample_count == 1
    with pytest.raises(LimitError):
        api.TimeSeries(0.0, [api.electrode("a")]).check()


def header(n=2, samples=5, epoch=4):
    return container.Header(sampling_frequency=10.0, epoch_length=epoch, sample_count=samples, electrodes=[api.electrode(str(k)) for k in range(n)], order=list(range(n)), start=0)


def epochs():
    x = np.arange(10, dtype="i4").reshape(2, 5)
    return x, [codec.encode_matrix(x[:, :4]), codec.encode_matrix(x[:, 4:])]


def test_part_files(spark, tmp_path):
    x, coded = epochs()
    path = f"{tmp_path}/d.cnt"
    h = header()
    h.triggers = [(1, "t")]
    container.write_parts(path, h, coded)
    r = api.Recording(spark, path, layout="parts")
    assert r.sample_count == 5 and r.triggers().count() == 1
    assert [tuple(v)[1:] for v in r.column_major_int32(0, 5).collect()] == [tuple(c) for c in x.T.tolist()]
    with open(container.part_path(path, "sample_count"), "ab") as f:
        f.write(b"\1\2\3")  # an odd tail is left out
    assert container.read_parts(path).sample_count == 5
    import os

    os.remove(container.part_path(path, "history"))
    with pytest.raises(DataError):
        container.read_parts(path)


def test_malformed_containers():
    _, coded = epochs()
    raw = container.container_bytes(header(), coded)
    assert container.parse_header(io.BytesIO(raw)).epochs == 2
    for bad in (b"", b"XXXX" + raw[4:], raw[:30], raw.replace(b"raw3", b"rawf"), raw.replace(b"chan", b"chxn")):
        with pytest.raises(DataError):
            container.parse_header(io.BytesIO(bad))
    with pytest.raises(DataError):
        container.epoch_ranges([0, 5, 5], 0, 10)
    with pytest.raises(DataError):
        container.epoch_ranges([0, 10], 0, 10)
    with pytest.raises(DataError):
        container.parse_ep(struct.pack("<I", 4), "RIFF")


@pytest.mark.parametrize("version", [0, 10, 30, 33, 35, 78, 103, 104, 174])
def test_archives(version):
    own = [
        archive.impedance(1_000_000, [5000.0, 1.5]),
        archive.video(2_000_000, 1.0, 3, "c", "d", "v"),
        archive.epoch_event(3_000_000, 2.0, 0.5, None, "e"),
        {"class": "artefact", "stamp": 0, "channel_active": "a", "channel_reference": "b", "descriptors": []},
        {"class": "spike", "stamp": 0, "amplitude_peak": 2.5, "sign": 1, "group": 2, "top_date": 4_000_000, "descriptors": []},
        {"class": "seizure", "stamp": 0, "descriptors": []},
        {"class": "sleep", "stamp": 0, "base_level": 1, "epoch_color": -5, "descriptors": []},
        {"class": "rpeak", "stamp": 0, "amplitude_peak": 1.0, "name": "x" * 300, "descriptors": []},
    ]
    lib = archive.read_archive(io.BytesIO(archive.archive_bytes(archive.Library(version, "lib", archive.numbered(own)))))
    assert (lib.version, lib.name, len(lib.events)) == (version, "lib", len(own))
    assert [e["visible_id"] for e in lib.events] == list(range(1, 9))
    assert lib.events[4]["top_date"] == 4_000_000 and lib.events[6]["epoch_color"] == -5 and lib.events[7]["name"] == "x" * 300
    if version >= 19:
        assert [archive.kind_of(e) for e in lib.events[:3]] == ["impedance", "video", "epoch"]


def test_malformed_archives():
    raw = archive.archive_bytes(archive.Library(events=[archive.epoch_event(0)]))
    for bad in (raw[:10], raw[:-1], raw.replace(b"dcEpochEvent_c", b"dcEpochEvenX_c"), raw.replace(b"dcEventsLibrary_c", b"dcEventsLibrarX_c")):
        with pytest.raises(DataError):
            archive.read_archive(io.BytesIO(bad))
    with pytest.raises(BugError):
        archive.archive_bytes(archive.Library(version=12, events=[archive.epoch_event(0)]))
    assert archive.read_events("/nowhere/none.evt").events == []


def test_stream(spark, tmp_path):
    src = spark.range(0, 1000).selectExpr("cast(id % 2 as int) as sensor", "id div 2 as sample", "cast(id * 37 % 101 as int) as value")
    for k in range(5):
        src.where(f"sample div 110 = {k}").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    s = EpochStream(spark, f"{tmp_path}/out", 2, 64)
    read = lambda: spark.readStream.schema(src.schema).option("maxFilesPerTrigger", 2).parquet(f"{tmp_path}/in")
    s.start(read()).awaitTermination()
    s.start(read()).awaitTermination()  # nothing new: nothing changes
    assert s.committed() == 7
    last = spark.createDataFrame(s.staged().where("batch = 2").select("sensor", "sample", "value").collect())
    s.append(last, 2)  # a batch that runs again replaces itself
    assert s.committed() == 7
    s.finish(f"{tmp_path}/s.cnt", series(2, 64))
    r = api.Recording(spark, f"{tmp_path}/s.cnt")
    got = r.signal().select("sensor", "sample", "value")
    assert r.sample_count == 500 and got.exceptAll(src).count() == 0 and src.exceptAll(got).count() == 0


def test_stream_reads_open_batches_only(spark, tmp_path):
    src = [(s, k, s * 1000 + k * 7) for k in range(40) for s in range(2)]
    s = EpochStream(spark, f"{tmp_path}/out", 2, 4)
    send = lambda rows, k: s.append(spark.createDataFrame(rows, "sensor int, sample long, value int"), k)
    told = lambda: (s._last_commit().first, s._last_commit().since)
    late = src[8:10]  # of epoch 1
    send(src[:8], 0)
    assert told() == (1, 1)
    send(src[10:30], 1)  # epochs 1 (open), 2, and half of 3
    assert told() == (1, 1) and s.committed() == 1 and s.epochs().count() == 2
    send([], 2)
    assert told() == (1, 1)
    send(late + src[10:14], 3)  # repeated samples count once
    send(late + src[10:14], 3)
    assert told() == (3, 1) and s.epochs().count() == 3
    send(src[30:76], 4)
    assert told() == (9, 4) and s._numbers("staged", "batch=") == [1, 2, 3, 4] and s._numbers("log", "") == [3, 4]
    with pytest.raises(DataError):
        send(late, 3)
    send(src[76:78], 5)
    assert s._numbers("staged", "batch=") == [4, 5]
    s.finish(f"{tmp_path}/s.cnt", series(2, 4))
    got = {tuple(x) for x in api.Recording(spark, f"{tmp_path}/s.cnt").signal().select("sensor", "sample", "value").collect()}
    assert got == set(src[:78])


def test_event_journal(spark, tmp_path):
    path = f"{tmp_path}/j.evt"
    w = api.EventWriter(path)
    w.impedances([{"stamp": datetime(2020, 1, 1), "values": [5.0]}])
    w.videos([{"stamp": datetime(2020, 1, 2), "trigger_code": 4}])
    w.epochs([{"stamp": datetime(2020, 1, 3), "duration": 2.0}])
    r = api.Recording(spark, f"{tmp_path}/j.cnt", layout="parts")
    assert (r.impedances().count(), r.videos().count(), r.epoch_events().count()) == (1, 1, 1)
    assert archive.read_events(path).events == []
    with open(archive.journal_path(path), "ab") as f:
        f.write(archive.event_bytes(archive.epoch_event(0))[:-3])  # cut off
    assert len(archive.read_journal(path).events) == 3
    w.close()
    assert len(archive.read_events(path).events) == 3 and archive.read_journal(path).events == []
    with pytest.raises(BugError):
        w.impedance(datetime(2020, 1, 1), [])
    api.EventWriter(f"{tmp_path}/k.evt").close()
    assert not (tmp_path / "k.evt").exists()


def test_writer_that_dies_leaves_whole_epochs(spark, tmp_path):
    path = f"{tmp_path}/w.cnt"
    x = (np.arange(4 * 20).reshape(4, 20) * 37 % 101).astype(np.int32)
    w = api.RecordingWriter(spark, path)
    w.param(series())
    for k in range(0, 20, 5):
        w.row_major_int32(x[:, k : k + 5])
        assert w.written(0, k + 5).tolist() == x[:, : k + 5].tolist()
    assert w.written(7, 9).tolist() == x[:, 7:16].tolist() and w.written(18, 3).shape[1] == 0
    w.trigger(2, "t")
    w.info(subject_name="N")
    w.flush()
    del w  # no close
    r = api.Recording(spark, path, layout="parts")
    assert (r.sample_count, r.epoch_count, r.info["subject_name"], r.triggers().count()) == (18, 3, "N", 1)
    assert [list(c)[1:] for c in r.column_major_int32(0, 18).collect()] == x[:, :18].T.tolist()
    assert r.signal().where("epoch > 7").count() == 0
    with open(container.part_path(path, "ep"), "rb") as f:
        assert len(f.read()) == container.PART_HEADER + 4 * 4


def test_closed_writer_removes_its_parts(spark, tmp_path):
    path = f"{tmp_path}/w.cnt"
    w = api.RecordingWriter(spark, path)
    w.param(series(2, 4))
    w.column_major_int32(np.arange(12).reshape(6, 2))
    w.close()
    assert [p.name for p in tmp_path.iterdir()] == ["w.cnt"]
    assert api.Recording(spark, path).sample_count == 6


def test_dates_of_birth():
    day = 86_400_000_000
    assert container.parse_birth("") == container.parse_birth("x") == container.parse_birth("0 0 0 31 1 80") == 0
    assert container.parse_birth("60 0 0 2 0 70") == day + 60_000_000
    assert container.parse_birth("5 4") == 245_000_000
    assert container.parse_birth("0 0 0 2 0 70 5 1 0") == day

