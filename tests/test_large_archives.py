"""Archives that many tasks read: parts are guessed at and must join to what one pass gives."""

import io
import os

import pytest

from tracelake import api
from tracelake.errors import DataError
from tracelake.sources import archive, formats


def events(n):
    kinds = (
        lambda k: archive.impedance(k * 1000, [5000.0, 1.5]),
        lambda k: archive.video(k * 1000, 1.0, k, "c", "d" * (k % 300), "v"),
        lambda k: archive.epoch_event(k * 1000, 2.0, 0.5, None, "é"),
        lambda k: {"class": "spike", "stamp": k, "amplitude_peak": 2.5, "descriptors": []},
    )
    return archive.numbered([kinds[k % 4](k) for k in range(n)])


def archive_file(tmp_path, own, between=b"", tail=b"", more=0):
    """An archive with ``between`` (objects without a class) before each event, and ``tail`` after all."""
    path = f"{tmp_path}/a.evt"
    n = len(own) * (1 + len(between) // 4)
    with open(path, "wb") as f:
        f.write(archive.archive_head(104, "lib", n + more) + b"".join(between + archive.event_bytes(e) for e in own) + tail)
    return path


def rows(spark, path):
    got = api.Recording(spark, path.replace(".evt", ".cnt")).events()
    return got.rdd.getNumPartitions(), [tuple(r) for r in got.orderBy("ordinal").collect()]


@pytest.mark.parametrize("case", ["plain", "objects without a class", "bytes after the last", "events inside texts", "longer than a part"])
def test_parts_join_to_the_whole(case, spark, tmp_path, monkeypatch):
    own = events(300)
    extra = {}
    if case == "objects without a class":
        extra = {"between": b"\0" * 8}
    elif case == "bytes after the last":
        extra = {"tail": b"\xff" * 9000 + archive.event_bytes(own[0]) * 20}
    elif case == "events inside texts":
        own = archive.numbered([{**e, "description": (archive.CLASS_STARTS[0] * 9).decode("latin-1")} if e["class"] == "marker" else e for e in own])
    elif case == "longer than a part":
        own = archive.numbered([*own[:50], {**own[1], "description": "x" * 20_000}, *own[50:]])
    path = archive_file(tmp_path, own, **extra)
    _, want = rows(spark, path)
    assert [r[0] for r in want] == list(range(len(own))) and [r[3] for r in want] == list(range(1, len(own) + 1))
    monkeypatch.setattr(formats, "PART_BYTES", 4096)
    partitions, got = rows(spark, path)
    assert got == want and partitions > 3


def test_wrong_guesses_are_passed_over(tmp_path):
    """A raw block of events as a text: its inner events look right, but start nowhere."""
    own = events(40)
    inner = b"".join(archive.event_bytes(e) for e in own[:8])
    marker = {**own[3], "class": "marker", "description": "DESCRIPTION"}
    coded = archive.event_bytes(marker).replace(b"\x0bDESCRIPTION", b"\xff" + len(inner).to_bytes(2, "little") + inner)
    raw = archive.archive_head(104, "", 41) + b"".join(archive.event_bytes(e) for e in own[:20]) + coded + b"".join(archive.event_bytes(e) for e in own[20:])
    path = f"{tmp_path}/b.evt"
    with open(path, "wb") as f:
        f.write(raw)
    whole = archive.read_archive(io.BytesIO(raw)).events
    assert len(whole) == 41
    with open(path, "rb") as f:
        d = archive.Decoder(f)
        count, start = archive.read_head(d)[1], d.tell()
    for step in (200, 500, 1000):
        guesses = [(lo + step, archive.guessed_span(path, 104, lo, lo + step)) for lo in range(start, len(raw), step)]
        spans = archive.joined(path, 104, start, count, guesses)
        assert sum(s.objects for s in spans) == 41 and spans[0].at == start and spans[-1].end == len(raw)
        assert all(a.end == b.at and a.first + a.events == b.first for a, b in zip(spans, spans[1:], strict=False))
        with open(path, "rb") as f:
            assert [e for s in spans for e in archive.objects(archive.Decoder(f, s.at), s.objects)] == whole


def test_missing_objects_are_an_error(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(formats, "PART_BYTES", 4096)
    path = archive_file(tmp_path, events(300), more=1)
    with pytest.raises(DataError):
        api.Recording(spark, path.replace(".evt", ".cnt")).events()


def test_blocks_do_not_matter(monkeypatch):
    own = events(50)
    raw = archive.archive_bytes(archive.Library(events=own))
    want = archive.read_archive(io.BytesIO(raw)).events
    for block in (1, 7, 64, 1000):
        monkeypatch.setattr(archive, "BLOCK", block)
        assert archive.read_archive(io.BytesIO(raw)).events == want
        d = archive.Decoder(io.BytesIO(raw))
        assert archive._walk(d, 1 << 62, archive.read_head(d)[1]) == (50, 50) and d.tell() == len(raw)


def test_one_event_at_a_time(tmp_path):
    """Events before a broken one come out, and few of them are held."""
    path = archive_file(tmp_path, events(5), tail=b"\1\2\3\4", more=1)
    got = archive.iter_events(path)
    assert [next(got)["visible_id"] for _ in range(5)] == [1, 2, 3, 4, 5]
    with pytest.raises(DataError):
        next(got)


def test_table_is_written_by_tasks(spark, tmp_path):
    df = spark.range(0, 3000, 1, 7).selectExpr(
        "2999 - id as ordinal", "'marker' as class", "'n' as name", "1 as type", "1.5D as duration", "0D as duration_offset", "timestamp_millis(id) as stamp",
        "if(id % 3 = 0, array(named_struct('name', 'Condition', 'unit', '', 'type', 'bstr', 'is_array', false, 'data', array(string(id)))), array()) as descriptors", "string(id) as description",
    )
    api.write_event_table(df, f"{tmp_path}/t.evt")
    assert os.listdir(tmp_path) == ["t.evt"]
    got = archive.read_events(f"{tmp_path}/t.evt").events
    assert [(e["visible_id"], e["description"], e["stamp"]) for e in got] == [(k + 1, str(2999 - k), (2999 - k) * 1000) for k in range(3000)]
    assert [[d["data"] for d in e["descriptors"]] for e in got[:3]] == [[] if (2999 - k) % 3 else [[str(2999 - k)]] for k in range(3)]
    api.write_event_table(df.limit(0), f"{tmp_path}/u.evt")
    assert os.listdir(tmp_path) == ["t.evt"]
