"""Recordings as objects: everything a reader or a writer of recordings offers, on DataFrames."""

from __future__ import annotations

import json
import math
import os
import shutil
import uuid
from dataclasses import asdict, dataclass
from datetime import datetime
from functools import cached_property
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake import schema
from tracelake.errors import BugError, DataError, LimitError
from tracelake.functions import codec, dates, text
from tracelake.logs import log, logged, message, set_logger  # noqa: F401 - part of the interface
from tracelake.operators import codec as codecs
from tracelake.operators import events as event_ops
from tracelake.operators import signal as signals
from tracelake.sources import archive, container
from tracelake.sources.files import open_file, plain_path
from tracelake.sources.formats import archive_spans, register


def electrode(label: str, reference: str = "", unit: str = text.DEFAULT_UNIT, iscale: float = text.DEFAULT_ISCALE, rscale: float | None = None, status: str = "", type: str = "") -> dict:  # noqa: A002
    """An electrode; scales default to 1 and, for uV, 1/256."""
    rscale = text.default_rscale(unit) if rscale is None else rscale
    return {"label": label, "reference": reference, "unit": unit, "status": status, "type": type, "iscale": iscale, "rscale": rscale}


def check_electrode(e: dict) -> dict:
    """Limit error for texts the container can't keep and for infinite scales."""
    for key, n, needed in (("label", text.LABEL_BYTES, True), ("unit", text.UNIT_BYTES, True), ("reference", text.REFERENCE_BYTES, False), ("status", text.STATUS_BYTES, False), ("type", text.TYPE_BYTES, False)):
        s = e.get(key) or ""
        if needed and not s or len(s.encode()) > n or " " in s or "\0" in s:
            raise LimitError(f"{key} {s!r}")
    if e["label"][0] in "[;" or not (math.isfinite(e["iscale"]) and math.isfinite(e["rscale"])):
        raise LimitError(f"electrode {e}")
    return e


@dataclass
class TimeSeries:
    """What is set before data: start (UTC), rate, electrodes, epoch length."""

    sampling_frequency: float
    electrodes: list[dict]
    epoch_length: int = container.DEFAULT_EPOCH
    start_time: datetime = datetime(1899, 12, 30)

    def check(self) -> TimeSeries:
        if self.epoch_length < 1 or not self.electrodes or not (math.isfinite(self.sampling_frequency) and self.sampling_frequency > 0):
            raise LimitError("epoch length, rate or electrodes")
        if len(self.electrodes) > signals.MAX_SENSORS:
            raise LimitError(f"{len(self.electrodes)} electrodes")
        for e in self.electrodes:
            check_electrode(e)
        dates.to_micros(*dates.from_micros(dates.micros_of(self.start_time)))
        return self

    def __eq__(self, other) -> bool:
        a, b = asdict(self), asdict(other)
        same = abs(a.pop("sampling_frequency") - b.pop("sampling_frequency")) <= container.FREQUENCY_TOLERANCE
        return same and a == b


class Recording:
    """A recording on disk, packed (``layout='riff'``) or in part files (``layout='parts'``).

    Ranges are all-or-nothing: one that is not wholly there is logged and empty.  An epoch that is
    not there is a data error.
    """

    def __init__(self, spark: SparkSession, path: str, layout: str = "riff"):
        self.spark, self.path, self.layout = register(spark), path, layout

    @cached_property
    def _header(self) -> container.Header:
        return container.load(plain_path(self.path), self.layout)[0]

    def table(self, name: str) -> DataFrame:
        return self.spark.read.format("cnt").option("table", name).option("layout", self.layout).load(self.path)

    # Header
    @property
    def kind(self) -> str:
        return self._header.kind

    @property
    def file_version(self) -> tuple[int, int]:
        return self._header.version

    @property
    def sample_count(self) -> int:
        return self._header.sample_count

    @property
    def epoch_count(self) -> int:
        return self._header.epochs

    @property
    def history(self) -> str:
        return self._header.history

    @property
    def info(self) -> dict:
        return self._header.info

    @property
    def param(self) -> TimeSeries:
        h = self._header
        return TimeSeries(h.sampling_frequency, h.electrodes, h.epoch_length, dates.datetime_of(h.start))

    def header(self) -> DataFrame:
        return self.table("header")

    def electrodes(self) -> DataFrame:
        return self.table("electrodes")

    def triggers(self) -> DataFrame:
        return self.table("triggers")

    # Samples
    def signal(self) -> DataFrame:
        return self.table("signal")

    def samples_int32(self, first: int, amount: int) -> DataFrame:
        """Long form of a range, as stored integers."""
        if first < 0 or amount < 1 or first + amount > self.sample_count:
            log.error("samples %s + %s of %s", first, amount, self.sample_count)
        return signals.slice_samples(self.signal(), first, amount, self.sample_count)

    def samples(self, first: int, amount: int) -> DataFrame:
        """Long form of a range, in physical units."""
        return signals.scale_read(self.samples_int32(first, amount), self.electrodes())

    def _by_row(self, df: DataFrame) -> DataFrame:
        cells = df.groupBy("sensor").agg(F.array_sort(F.collect_list(F.struct("sample", "value"))).alias("cells"))
        return cells.select("sensor", F.transform("cells", lambda c: c["value"]).alias("samples")).orderBy("sensor")

    def row_major_int32(self, first: int, amount: int) -> DataFrame:
        """One row a sensor, with an array of the range."""
        return self._by_row(self.samples_int32(first, amount))

    def row_major(self, first: int, amount: int) -> DataFrame:
        return self._by_row(self.samples(first, amount))

    def _by_column(self, df: DataFrame) -> DataFrame:
        return signals.column_major(df, len(self._header.electrodes)).orderBy("sample")

    def column_major_int32(self, first: int, amount: int) -> DataFrame:
        """One row a time point, with a column a sensor."""
        return self._by_column(self.samples_int32(first, amount))

    def column_major(self, first: int, amount: int) -> DataFrame:
        return self._by_column(self.samples(first, amount))

    def column_major_float32(self, first: int, amount: int) -> DataFrame:
        """Column major, as 32-bit floats."""
        wide = self.column_major(first, amount)
        return wide.select("sample", *[F.col(c).cast("float").alias(c) for c in wide.columns if c != "sample"])

    def _epoch(self, i: int) -> tuple[int, int]:
        if not 0 <= i < self.epoch_count:
            raise DataError(f"no epoch {i}")
        return i * self._header.epoch_length, self._header.epoch_samples(i)

    def epoch_row_major_int32(self, i: int) -> DataFrame:
        return self.row_major_int32(*self._epoch(i))

    def epoch_row_major(self, i: int) -> DataFrame:
        return self.row_major(*self._epoch(i))

    def epoch_column_major_int32(self, i: int) -> DataFrame:
        return self.column_major_int32(*self._epoch(i))

    def epoch_column_major(self, i: int) -> DataFrame:
        return self.column_major(*self._epoch(i))

    def epoch_compressed(self, i: int) -> DataFrame:
        self._epoch(i)
        return self.table("epochs").where(F.col("epoch") == i)

    # Events
    def events(self) -> DataFrame:
        path = archive.archive_path(self.path)
        spans = archive_spans(self.spark, path) if self.layout == "riff" else None
        reader = self.spark.read.format("evt").option("layout", self.layout)
        return (reader if spans is None else reader.option("spans", spans)).load(path)

    def impedances(self) -> DataFrame:
        return event_ops.impedances(self.events())

    def videos(self) -> DataFrame:
        return event_ops.videos(self.events())

    def epoch_events(self) -> DataFrame:
        return event_ops.epoch_events(self.events())

    def event_counts(self) -> DataFrame:
        return event_ops.counts(self.events())

    # Other files inside
    def embedded(self) -> DataFrame:
        return self.table("embedded").select("label", "size")

    def extract_embedded(self, label: str, to: str) -> None:
        found = next((e for e in self._header.embedded if e[0] == container.clamp_label(label)), None)
        if found is None:
            raise LimitError(f"no embedded file {label!r}")
        with open_file(self.path) as f, open(plain_path(to), "wb") as out:
            f.seek(found[1])
            left = found[2]
            while left:
                block = f.read(min(left, 1 << 20))
                if not block:
                    raise DataError("embedded file ends early")
                out.write(block)
                left -= len(block)


def header_of(series: TimeSeries, kind: str = "RIFF") -> container.Header:
    if kind not in container.KINDS:
        raise LimitError(f"unknown kind {kind}")
    return container.Header(
        kind=kind, start=dates.micros_of(series.start_time), sampling_frequency=series.sampling_frequency, epoch_length=series.epoch_length, electrodes=series.electrodes, order=list(range(len(series.electrodes)))
    )


def write_epochs(epochs: DataFrame, path: str, series: TimeSeries, kind: str = "RIFF", info: dict | None = None, history: str = "", triggers: list[tuple[int, str]] = (), embed: list[tuple[str, str]] = ()) -> None:
    """Write encoded epochs (epoch, length, data) as a recording.  Tasks write, the driver joins
    their files; without epochs there is no file."""
    register(epochs.sparkSession)
    h = header_of(series.check(), kind)
    h.info, h.history, h.triggers = info or {}, history, list(triggers)
    ready = epochs.select("epoch", F.col("length").cast("long").alias("length"), "data")
    ready.write.format("cnt_epochs").option("header", json.dumps(asdict(h))).option("embed", json.dumps(list(embed))).mode("append").save(path)


def write_recording(signal: DataFrame, path: str, series: TimeSeries, scaled: bool = False, fold: bool = False, **more) -> None:
    """Write a signal table (sensor, sample, value); ``scaled``: values are physical.  Values beyond
    32 bits are an error, or folded into 32 bits with ``fold``."""
    if scaled:
        table = signal.sparkSession.createDataFrame([(k, e["iscale"], e["rscale"]) for k, e in enumerate(series.electrodes)], "sensor int, iscale double, rscale double")
        signal = signals.scale_write(signal, table)
    write_epochs(codecs.encode_epochs(signal, series.epoch_length, fold=fold), path, series, **more)


def write_archive(events: list[dict], path: str, version: int = archive.DEFAULT_VERSION) -> None:
    """Write an event archive; without events there is no file."""
    if not events:
        return
    raw = archive.archive_bytes(archive.Library(version=version, events=archive.numbered(events)))
    unfinished = f"{plain_path(path)}.unfinished"
    with open(unfinished, "wb") as f:
        f.write(raw)
    os.replace(unfinished, plain_path(path))


def _cut(values: list, lengths: pa.Array) -> list[list]:
    """A flat list as lists of these lengths; null counts as none."""
    at = iter(values)
    return [list(islice(at, n or 0)) for n in lengths.to_pylist()]


def _descriptors(column: pa.ListArray) -> list[list[dict]]:
    """Descriptors of each event.  They are flattened before they become Python objects, which is
    much faster than a scalar for each level."""
    flat = column.flatten()
    columns = dict(zip([flat.type.field(i).name for i in range(flat.type.num_fields)], flat.flatten(), strict=True))
    data = _cut(columns["data"].flatten().to_pylist(), columns["data"].value_lengths())
    names, units, types, arrays = (columns[k].to_pylist() for k in ("name", "unit", "type", "is_array"))
    found = [{"name": n, "unit": u, "type": t, "is_array": a, "data": d} for n, u, t, a, d in zip(names, units, types, arrays, data, strict=True)]
    return _cut(found, column.value_lengths())


def write_event_table(events: DataFrame, path: str, version: int = archive.DEFAULT_VERSION) -> None:
    """Write a table of events (see :mod:`tracelake.operators.events`; ``ordinal`` gives the order,
    from 0 and without gaps) as an archive.  Tasks write ranges of events to a staging folder beside
    the target, which all executors must share, and the driver joins their files; without events
    there is no file."""
    fields = ("class", "name", "type", "duration", "duration_offset", "description")
    target = plain_path(path)
    staging = f"{target}_staging_{uuid.uuid4().hex}"

    def written(batches):
        os.makedirs(staging, exist_ok=True)
        name = f"{staging}/{uuid.uuid4().hex}"  # a rerun task has a file of its own
        first, n = None, 0
        with open(name, "wb") as f:
            for t in batches:
                for at in range(0, t.num_rows, 1024):  # a slice at a time is held as Python objects
                    part = t.slice(at, 1024)
                    out = []
                    for ordinal, us, found, *values in zip(part["ordinal"].to_pylist(), part["us"].to_pylist(), _descriptors(part["descriptors"]), *[part[c].to_pylist() for c in fields], strict=True):
                        e = {k: v for k, v in zip(fields, values, strict=True) if v is not None}
                        out.append(archive.event_bytes({**e, "descriptors": found, "stamp": us, "visible_id": ordinal + 1}, version))
                        first = ordinal if first is None else first
                    f.write(b"".join(out))
                    n += len(out)
        yield pa.RecordBatch.from_pydict({"first": pa.array([first], pa.int64()), "n": [n], "file": [name]})

    rows = events.select("ordinal", F.unix_micros(F.col("stamp").cast("timestamp")).alias("us"), "descriptors", *fields)
    # a number of ranges is given, as Spark would else merge them by their bytes, which coding makes many times more of
    ranges = int(events.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    in_order = rows.repartitionByRange(ranges, "ordinal").sortWithinPartitions("ordinal")
    unfinished = f"{target}.unfinished"
    try:
        parts = sorted((r["first"], r["n"], r["file"]) for r in in_order.mapInArrow(written, "first long, n long, file string").collect() if r["n"])
        if not parts:
            return
        with open(unfinished, "wb") as f:
            f.write(archive.archive_head(version, "", sum(n for _, n, _ in parts)))
            for _, _, name in parts:
                with open(name, "rb") as part:
                    shutil.copyfileobj(part, f, 1 << 20)
        os.replace(unfinished, target)
    finally:
        shutil.rmtree(staging, ignore_errors=True)


class EventWriter:
    """Collects events for an archive; :meth:`close` writes it.

    Each event also goes to a journal beside the archive, which a crash leaves and a close removes.
    """

    def __init__(self, path: str):
        self.path, self.events, self.closed = path, [], False
        self.journal = archive.journal_path(plain_path(path))

    def _add(self, e: dict) -> None:
        if self.closed:
            raise BugError("writer is closed")
        if len(self.events) + 1 >= 1 << 32:
            raise LimitError("too many events")
        raw = archive.event_bytes(e)
        with open(self.journal, "ab" if self.events else "wb") as f:
            f.write(raw if self.events else archive.JOURNAL_HEADER + raw)
        self.events.append(e)

    def impedance(self, stamp: datetime, values: list[float]) -> None:
        self._add(archive.impedance(dates.micros_of(stamp), values))

    def video(self, stamp: datetime, duration: float = 0.0, trigger_code: int | None = None, condition_label: str = "", description: str = "", video_file: str = "") -> None:
        self._add(archive.video(dates.micros_of(stamp), duration, trigger_code, condition_label, description, video_file))

    def epoch(self, stamp: datetime, duration: float = 0.0, offset: float = 0.0, trigger_code: int | None = None, condition_label: str = "") -> None:
        self._add(archive.epoch_event(dates.micros_of(stamp), duration, offset, trigger_code, condition_label))

    def impedances(self, xs: list[dict]) -> None:
        for x in xs:
            self.impedance(**x)

    def videos(self, xs: list[dict]) -> None:
        for x in xs:
            self.video(**x)

    def epochs(self, xs: list[dict]) -> None:
        for x in xs:
            self.epoch(**x)

    def close(self) -> None:
        if not self.closed:
            self.closed = True
            write_archive(self.events, self.path)
            if self.events:
                os.remove(self.journal)


class RecordingWriter:
    """Builds a recording: set up, append samples in any layout, close.

    Setup takes series, info, history and embedded files; the first samples end it.  Samples are
    numpy arrays (small pieces) or signal tables numbered from 0.  Arrays go to part files beside
    the target an epoch at a time, so the driver holds less than one epoch, and a crash leaves what
    was flushed.  Closing puts the parts together and writes the event archive; a writer without
    samples leaves no file.
    """

    def __init__(self, spark: SparkSession, path: str, kind: str = "RIFF"):
        self.spark, self.path, self.kind, self.phase = register(spark), path, kind, "setup"
        self.series: TimeSeries | None = None
        self._info: dict = {}
        self._history = ""
        self._embedded: list[tuple[str, str]] = []
        self._triggers: list[tuple[int, str]] = []
        self._pieces: list[DataFrame] = []
        self._parts: container.PartWriter | None = None
        self._tail = np.zeros((0, 0), np.int32)  # samples after the last whole epoch
        self.sample_count = 0
        self.events = EventWriter(archive.archive_path(path))

    def _in(self, *phases: str) -> None:
        if self.phase not in phases:
            raise BugError(f"not possible while {self.phase}")

    def param(self, series: TimeSeries) -> None:
        self._in("setup")
        if self.series is not None:
            raise BugError("one segment only")
        self.series = series.check()

    def info(self, **fields) -> None:
        """Fields of the info part; ``subject_dob`` is a datetime."""
        self._in("setup", "writing")
        unknown = set(fields) - set(text.INFO_KEYS.values())
        if unknown:
            raise LimitError(f"unknown fields {sorted(unknown)}")
        self._info |= {k: dates.micros_of(v) if isinstance(v, datetime) else v for k, v in fields.items()}

    def history(self, notes: str) -> None:
        self._in("setup", "writing")
        self._history = notes

    def embed(self, label: str, file: str) -> None:
        self._in("setup", "writing")
        clamped = container.clamp_label(label)
        if clamped in container.RESERVED or clamped in [k for k, _ in self._embedded]:
            raise LimitError(f"reserved or repeated label {label!r}")
        self._embedded.append((clamped, file))

    def trigger(self, sample: int, code: str) -> None:
        self._in("setup", "writing")
        self._triggers.append((int(sample), code))

    def triggers(self, xs: list[tuple[int, str]]) -> None:
        for sample, code in xs:
            self.trigger(sample, code)

    def _append(self, x: np.ndarray) -> None:
        """``x`` [sensor, sample] of int32: whole epochs go to the part files at once."""
        self._in("setup", "writing")
        if self.series is None:
            raise BugError("no time series")
        if self._pieces:
            raise BugError("arrays can't follow tables")
        n = self.series.epoch_length
        if x.ndim != 2 or x.shape[0] != len(self.series.electrodes):
            raise LimitError(f"{x.shape} for {len(self.series.electrodes)} electrodes")
        if self._parts is None:
            self._parts = container.PartWriter(plain_path(self.path), self._described())
            self._tail = x[:, :0]
        self.phase = "writing"
        self.sample_count += x.shape[1]
        self._tail = np.concatenate([self._tail, x], axis=1)
        whole = self._tail.shape[1] // n * n
        for at in range(0, whole, n):
            self._parts.append(codec.encode_matrix(np.ascontiguousarray(self._tail[:, at : at + n])), n)
        self._tail = self._tail[:, whole:]

    def _described(self) -> container.Header:
        """Header as set so far; the one of the part files, once there are any."""
        h = self._parts.h if self._parts is not None else header_of(self.series, self.kind)
        h.info, h.history, h.triggers = self._info, self._history, list(self._triggers)
        return h

    def flush(self) -> None:
        """Make durable what was appended: ``Recording(path, layout="parts")`` reads it, up to the
        last whole epoch, also after a crash."""
        self._in("setup", "writing")
        if self._parts is not None:
            self._described()
            self._parts.flush()

    def _shaped(self, x, order: str) -> np.ndarray:
        if self.series is None:
            raise BugError("no time series")
        x, n = np.asarray(x), len(self.series.electrodes)
        if x.ndim == 1:
            if x.size % n:
                raise LimitError(f"{x.size} values for {n} electrodes")
            x = x.reshape((n, -1) if order == "row" else (-1, n))
        return x if order == "row" else x.T

    def _integers(self, x: np.ndarray) -> np.ndarray:
        factor = np.array([1 / (e["iscale"] * e["rscale"]) for e in self.series.electrodes])[:, None]
        y = x * factor
        y = np.sign(y) * np.floor(np.abs(y) + 0.5)
        if y.size and not (np.abs(y) < 1 << 31).all():
            raise LimitError("values beyond 32 bits")
        return y.astype(np.int32)

    def row_major_int32(self, x) -> None:
        self._append(self._shaped(x, "row").astype(np.int32))

    def column_major_int32(self, x) -> None:
        self._append(self._shaped(x, "column").astype(np.int32))

    def row_major(self, x) -> None:
        self._append(self._integers(self._shaped(x, "row").astype(float)))

    def column_major(self, x) -> None:
        self._append(self._integers(self._shaped(x, "column").astype(float)))

    def column_major_float32(self, x) -> None:
        """Column major, 32-bit floats."""
        self.column_major(np.asarray(x, dtype=np.float32))

    def signal(self, df: DataFrame, scaled: bool = False) -> None:
        """A signal table of its own samples 0, 1, ...; it follows what was appended before."""
        self._in("setup", "writing")
        if self.series is None or self._parts is not None or self._pieces:
            raise BugError("one signal table, after the time series and without arrays")
        self.phase = "writing"
        if scaled:
            table = self.spark.createDataFrame([(k, e["iscale"], e["rscale"]) for k, e in enumerate(self.series.electrodes)], "sensor int, iscale double, rscale double")
            df = signals.scale_write(df, table)
        self._pieces.append(df)

    def committed(self) -> int:
        """Samples in whole epochs so far."""
        return 0 if self.series is None else self.sample_count // self.series.epoch_length * self.series.epoch_length

    def written(self, first: int, amount: int) -> np.ndarray:
        """Read back appended arrays: int32 [sensor, sample]; empty if the range isn't there."""
        sensors = len(self.series.electrodes) if self.series else 0
        if self._parts is None or first < 0 or amount < 1 or first + amount > self.sample_count:
            return np.zeros((sensors, 0), np.int32)
        n, whole = self.series.epoch_length, self.committed()
        parts = [codec.decode_matrix(self._parts.epoch(i), sensors, n) for i in range(first // n, min(-(-(first + amount) // n), whole // n))]
        start = min(first // n * n, whole)
        return np.concatenate([*parts, self._tail], axis=1)[:, first - start : first - start + amount]

    def close(self) -> None:
        if self.phase == "closed":
            return
        self.phase = "closed"
        self.events.close()
        if self._pieces:
            write_recording(self._pieces[0], self.path, self.series, kind=self.kind, info=self._info, history=self._history, triggers=self._triggers, embed=self._embedded)
        elif self._parts is not None and not self.sample_count:
            self._parts.remove()
        elif self._parts is not None:
            if self._tail.shape[1]:
                self._parts.append(codec.encode_matrix(np.ascontiguousarray(self._tail)), self._tail.shape[1])
            self._described()
            self._parts.finish(self._embedded)

    def __enter__(self) -> RecordingWriter:
        return self

    def __exit__(self, kind, *_) -> None:
        if kind is None:
            self.close()


def header_table(spark: SparkSession, path: str) -> DataFrame:
    return register(spark).read.format("cnt").option("table", "header").load(path)


def read_binary(spark: SparkSession, pattern: str) -> DataFrame:
    """Chunks of many containers, read through Spark's ``binaryFile`` source, for stores that only
    Spark can open: file, and the columns of the chunks table."""

    def walk(batches):
        import io

        import pandas as pd

        for pdf in batches:
            rows = [(p, *asdict(c).values()) for p, raw in zip(pdf["path"], pdf["content"], strict=True) for c in container.chunks(io.BytesIO(raw))[1]]
            yield pd.DataFrame(rows, columns=["file", "id", "label", "path", "fpos", "payload", "size"])

    files = spark.read.format("binaryFile").load(pattern).select("path", "content")
    return files.mapInPandas(walk, f"file string, {schema.CHUNK}")


class LegacyReader:
    """The small reader of old: channels as (label, unit, reference), samples as floats."""

    def __init__(self, spark: SparkSession, path: str):
        self.recording = Recording(spark, path)

    def get_channel_count(self) -> int:
        return len(self.recording.param.electrodes)

    def get_channel(self, i: int) -> tuple[str, str, str]:
        e = self.recording.param.electrodes[i]
        return e["label"], e["unit"], e["reference"]

    def get_sample_frequency(self) -> int:
        return int(self.recording.param.sampling_frequency)

    def get_sample_count(self) -> int:
        return self.recording.sample_count

    def get_samples(self, first: int, last: int) -> list[float]:
        """Column major, samples first .. last-1."""
        rows = self.recording.column_major_float32(first, last - first).collect()
        return [v for r in rows for v in r[1:]]

    def get_trigger_count(self) -> int:
        return len(self.recording._header.triggers)

    def get_trigger(self, i: int) -> tuple[str, int]:
        sample, code = self.recording._header.triggers[i]
        return code, sample


class LegacyWriter:
    def __init__(self, spark: SparkSession, path: str, rate: float, channels: list[tuple], rf64: int = 0):
        self.writer = RecordingWriter(spark, path, "RF64" if rf64 else "RIFF")
        self.writer.param(TimeSeries(float(rate), [electrode(c[0], c[1] if len(c) > 1 else "", c[2] if len(c) > 2 else text.DEFAULT_UNIT) for c in channels]))

    def add_samples(self, values: list[float]) -> None:
        self.writer.column_major_float32(values)

    def close(self) -> None:
        self.writer.close()
