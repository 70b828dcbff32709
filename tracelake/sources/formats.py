"""Spark data sources: ``cnt`` (recordings), ``evt`` (event archives), and the sink ``cnt_epochs``.

``spark.read.format("cnt").option("table", ...).load(path)``; tables: signal (default), epochs,
header, electrodes, triggers, chunks, embedded.  ``layout=parts`` reads the part files that a writer
leaves which did not finish.  Filters on ``epoch`` and ``sample`` choose the epochs to be read, and a
filter on ``sensor`` how many rows of each are decoded; a partition is a range of epochs.

Filter pushdown into Python sources is off by default in Spark: :func:`register` turns it on.
"""

from __future__ import annotations

import json
import os
import re
import uuid
from collections.abc import Iterator
from dataclasses import asdict, astuple, dataclass, replace
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    DataSourceWriter,
    EqualTo,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    LessThan,
    LessThanOrEqual,
    WriterCommitMessage,
)

from tracelake import schema
from tracelake.errors import DataError, LimitError
from tracelake.functions import codec, dates
from tracelake.sources import archive, container
from tracelake.sources.files import exists, open_file, plain_path

#: Samples of all sensors that a partition decodes.
PARTITION_VALUES = 8_000_000


@dataclass
class Epochs(InputPartition):
    """Epochs ``first`` to ``last`` (exclusive), with their places in the file ``data`` and what of the
    header decoding needs: tasks don't read the header again."""

    first: int
    last: int
    data: str
    header: container.Header

    def __init__(self, first: int, last: int, data: str, header: container.Header):
        super().__init__((first, last))
        self.first, self.last, self.data = first, last, data
        self.header = replace(header, ranges=header.ranges[first:last], electrodes=[{}] * len(header.electrodes), info={}, history="", triggers=[], embedded=[])


class RecordingSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "cnt"

    def schema(self) -> str:
        table = self.options.get("table", "signal")
        if table not in schema.TABLES:
            raise LimitError(f"no table {table}; there are {', '.join(schema.TABLES)}")
        return schema.TABLES[table]

    def reader(self, schema) -> DataSourceReader:
        return RecordingReader(self.options)


class RecordingReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.layout = plain_path(options["path"]), options.get("layout", "riff")
        self.table = options.get("table", "signal")
        self.per_partition = int(options.get("epochsPerPartition", 0))
        self.bounds = {"epoch": [0, 1 << 62], "sample": [0, 1 << 62], "sensor": [0, 1 << 62]}

    def pushFilters(self, filters):
        """Notes bounds on epoch, sample and sensor; Spark applies all filters to the rows again."""
        for f in filters:
            name = f.attribute[0] if getattr(f, "attribute", None) and len(f.attribute) == 1 else None
            b = self.bounds.get(name)
            if b is not None:
                if isinstance(f, EqualTo):
                    b[:] = [max(b[0], f.value), min(b[1], f.value)]
                elif isinstance(f, In) and f.value:
                    b[:] = [max(b[0], min(f.value)), min(b[1], max(f.value))]
                elif isinstance(f, GreaterThanOrEqual | GreaterThan):
                    b[0] = max(b[0], f.value + isinstance(f, GreaterThan))
                elif isinstance(f, LessThanOrEqual | LessThan):
                    b[1] = min(b[1], f.value - isinstance(f, LessThan))
            yield f

    def partitions(self) -> list[InputPartition]:
        if self.table not in ("signal", "epochs"):
            return [InputPartition(0)]
        h, data = container.load(self.path, self.layout)
        first = max(self.bounds["epoch"][0], self.bounds["sample"][0] // h.epoch_length)
        last = min(self.bounds["epoch"][1], self.bounds["sample"][1] // h.epoch_length, h.epochs - 1) + 1
        step = self.per_partition or max(1, PARTITION_VALUES // max(1, h.epoch_length * len(h.electrodes)))
        return [Epochs(i, min(i + step, last), data, h) for i in range(first, last, step)]

    def read(self, partition) -> Iterator[pa.RecordBatch]:
        if self.table == "chunks":
            with open_file(self.path) as f:
                rows = [asdict(c) for c in container.chunks(f)[1]]
            yield from _batch(rows, "id label path fpos payload size")
            return
        if self.table in ("signal", "epochs"):
            yield from self.epochs(partition)
            return
        h, _ = container.load(self.path, self.layout)
        if self.table == "header":
            yield header_row(h)
        elif self.table == "electrodes":
            yield from _batch([{"sensor": k, **e} for k, e in enumerate(h.electrodes)], "sensor label reference unit status type iscale rscale", {"sensor": pa.int32()})
        elif self.table == "triggers":
            yield from _batch([{"ordinal": k, "sample": s, "code": c} for k, (s, c) in enumerate(h.triggers)], "ordinal sample code")
        elif self.table == "embedded":
            with open_file(self.path) as f:
                for label, place, size in h.embedded:
                    yield from _batch([{"label": label, "size": size, "content": container._at(f, place, size)}], "label size content")

    def epochs(self, partition: Epochs | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # no epoch is wanted
            return
        h = partition.header
        with open_file(partition.data) as f:
            for i, place in enumerate(h.ranges, partition.first):
                raw = container._at(f, *place)
                if self.table == "epochs":
                    yield pa.RecordBatch.from_pydict({"epoch": [i], "length": [h.epoch_samples(i)], "data": pa.array([raw], pa.binary())})
                else:
                    yield self.decoded(h, i, raw)

    def decoded(self, h: container.Header, i: int, raw: bytes) -> pa.RecordBatch:
        n, length = len(h.electrodes), h.epoch_samples(i)
        lo, hi = self.bounds["sensor"]
        wanted = [s for s in range(n) if lo <= s <= hi]
        place = {s: k for k, s in enumerate(h.order)}
        needed = max((place[s] + 1 for s in wanted), default=0)
        x = codec.decode_matrix(raw, n, length, order=h.order, needed=None if needed == n else needed)[wanted]
        samples = np.arange(i * h.epoch_length, i * h.epoch_length + length)
        return pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(np.array(wanted, np.int32), length)), pa.array(np.tile(samples, len(wanted))), pa.array(np.full(len(wanted) * length, i)), pa.array(x.ravel())],
            ["sensor", "sample", "epoch", "value"],
        )


def _batch(rows: list[dict], names: str, types: dict | None = None) -> Iterator[pa.RecordBatch]:
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], (types or {}).get(n)) for n in names.split()], names.split())


def header_row(h: container.Header) -> tuple:
    info = dict(h.info)
    birth = info.get("subject_dob")
    texts = "hospital test_name test_serial physician technician machine_make machine_model machine_sn subject_name subject_id subject_address subject_phone".split()
    return (
        h.kind, h.version[0], h.version[1], dates.datetime_of(h.start), h.sampling_frequency, h.epoch_length, h.sample_count, h.epochs, len(h.electrodes), [int(k) for k in h.order], h.history,
        *[info.get(k, "") for k in texts], info.get("subject_sex", "unknown"), info.get("subject_handedness", "unknown"), dates.datetime_of(birth) if birth is not None else None, info.get("comment", ""),
    )


class ArchiveSource(DataSource):
    """Events of an archive, one row each; a file that is not there has none.  ``layout=parts``
    reads the journal of an archive that was not finished.

    An archive has no index, so one task reads it, unless ``spans`` (JSON, from
    :func:`archive_spans`) tells where in it objects start: then each span is a partition."""

    @classmethod
    def name(cls) -> str:
        return "evt"

    def schema(self) -> str:
        return schema.EVENT

    def reader(self, schema) -> DataSourceReader:
        return ArchiveReader(self.options)


@dataclass
class Objects(InputPartition):
    span: archive.Span
    version: int

    def __init__(self, span: archive.Span, version: int):
        super().__init__(span.at)
        self.span, self.version = span, version


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = plain_path(options["path"])
        self.load = archive.iter_journal if options.get("layout") == "parts" else archive.iter_events
        self.version, self.spans = json.loads(options.get("spans", "[0, []]"))

    def partitions(self) -> list[InputPartition]:
        return [Objects(archive.Span(*s), self.version) for s in self.spans] or [InputPartition(0)]

    def read(self, partition) -> Iterator[pa.RecordBatch]:
        if isinstance(partition, Objects):
            yield from _event_batches(self.of(partition.span, partition.version), partition.span.first)
        else:
            yield from _event_batches(self.load(self.path), 0)

    def of(self, s: archive.Span, version: int) -> Iterator[dict]:
        with open_file(self.path) as f:
            d = archive.Decoder(f, s.at, version)
            yield from archive.objects(d, s.objects)
            if d.tell() != s.end:
                raise DataError(f"archive changed while it was read: {self.path}")


#: Events of a batch, and columns of the table that are fields of an event.
BATCH_EVENTS = 2048
_FIELDS = {
    "class": pa.string(), "visible_id": pa.int32(), "name": pa.string(), "user_visible_name": pa.string(), "type": pa.int32(), "state": pa.int32(), "original": pa.int32(), "duration": pa.float64(),
    "duration_offset": pa.float64(), "channel_active": pa.string(), "channel_reference": pa.string(), "description": pa.string(), "amplitude_peak": pa.float32(), "show_amplitude": pa.int32(), "show_duration": pa.int32(),
}
_EVENT_COLUMNS = [c.split()[0] for c in re.sub("<.*>", "", schema.EVENT).split(",")]


def _lists(lists: list[list], values) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum([len(x) for x in lists]))), pa.int32()), values)


def _event_batches(events: Iterator[dict], ordinal: int) -> Iterator[pa.RecordBatch]:
    while rows := list(islice(events, BATCH_EVENTS)):
        found = [e["descriptors"] for e in rows]
        flat = [d for ds in found for d in ds]
        data = [d["data"] for d in flat]
        parts = {
            "name": pa.array([d["name"] for d in flat], pa.string()), "unit": pa.array([d["unit"] for d in flat], pa.string()), "type": pa.array([d["type"] for d in flat], pa.string()),
            "is_array": pa.array([d["is_array"] for d in flat], pa.bool_()), "data": _lists(data, pa.array([x for xs in data for x in xs], pa.string())),
        }
        columns = {k: pa.array([e.get(k) for e in rows], kind) for k, kind in _FIELDS.items()} | {
            "ordinal": pa.array(np.arange(ordinal, ordinal + len(rows))),
            "kind": pa.array([archive.kind_of(e) for e in rows], pa.string()),
            "stamp": pa.array([e["stamp"] for e in rows], pa.timestamp("us", "UTC")),
            "descriptors": _lists(found, pa.StructArray.from_arrays(list(parts.values()), list(parts))),
        }
        yield pa.RecordBatch.from_arrays([columns[c] for c in _EVENT_COLUMNS], _EVENT_COLUMNS)
        ordinal += len(rows)


#: Bytes of an archive that a task reads.
PART_BYTES = 4 << 20


def archive_spans(spark: SparkSession, path: str) -> str | None:
    """Where objects start in an archive, for the option ``spans``; None if one task can read it.

    Tasks look for events in parts of equal size and pass what follows; the driver only puts their
    findings together, and goes over what they couldn't tell."""
    path = plain_path(path)
    if not exists(path):
        return None
    with open_file(path) as f:
        d = archive.Decoder(f)
        if d.size <= PART_BYTES:
            return None
        count = archive.read_head(d)[1]
        start, size, version = d.tell(), d.size, d.version
    parts = -(-(size - start) // PART_BYTES)

    def look(batches):
        for t in batches:
            found = [(lo, hi, archive.guessed_span(path, version, lo, hi)) for lo, hi in zip(t["lo"].to_pylist(), t["hi"].to_pylist(), strict=True)]
            rows = [{"lo": lo, "hi": hi} | ({k: getattr(s, k) for k in ("at", "end", "objects", "events")} if s else {}) for lo, hi, s in found]
            yield pa.RecordBatch.from_pylist(rows, pa.schema([(k, pa.int64()) for k in ("lo", "hi", "at", "end", "objects", "events")]))

    table = spark.range(0, parts, 1, parts).selectExpr(f"{start} + id * {PART_BYTES} as lo", f"least({size}, {start} + (id + 1) * {PART_BYTES}) as hi")
    rows = sorted(table.mapInArrow(look, "lo long, hi long, at long, end long, objects long, events long").collect(), key=lambda r: r["lo"])
    guesses = [(r["hi"], None if r["at"] is None else archive.Span(r["at"], r["end"], r["objects"], r["events"])) for r in rows]
    return json.dumps([version, [astuple(s) for s in archive.joined(path, version, start, count, guesses)]])


@dataclass
class Written(WriterCommitMessage):
    file: str
    epochs: list[tuple[int, int, int]]  # epoch, samples, bytes


class EpochSink(DataSource):
    """Writes encoded epochs (epoch, length, data) as one container.

    Tasks write their epochs to a staging folder beside the target, which all executors must share;
    the commit puts them together in epoch order and removes the folder, an abort only removes it.
    Options: ``header`` (JSON of :class:`container.Header`), ``embed`` (JSON list of label, file).
    """

    @classmethod
    def name(cls) -> str:
        return "cnt_epochs"

    def schema(self) -> str:
        return schema.EPOCHS

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return EpochWriter(self.options)


class EpochWriter(DataSourceWriter):
    def __init__(self, options: dict):
        self.path = plain_path(options["path"])
        self.header = json.loads(options["header"])
        self.embed = json.loads(options.get("embed", "[]"))
        self.staging = f"{self.path}_staging_{uuid.uuid4().hex}"

    def write(self, rows) -> Written:
        os.makedirs(self.staging, exist_ok=True)
        name = f"{self.staging}/{uuid.uuid4().hex}"  # a rerun task has a file of its own
        done = []
        with open(name, "wb") as f:
            for epoch, length, data in rows:  # in any order: the commit puts them in theirs
                f.write(data)
                done.append((epoch, length, len(data)))
        return Written(name, done)

    def commit(self, messages) -> None:
        import io
        import shutil

        parts = [m for m in messages if m is not None and m.epochs]
        placed = []
        for m in parts:
            at = 0
            for epoch, length, size in m.epochs:
                placed.append((epoch, length, size, m.file, at))
                at += size
        placed.sort()
        try:
            if not placed:
                return  # nothing was recorded: no file
            if [p[0] for p in placed] != list(range(len(placed))):
                raise LimitError("epochs are missing or repeated")
            h = container.Header(**self.header)
            if any(p[1] != h.epoch_length for p in placed[:-1]) or placed[-1][1] > h.epoch_length:
                raise LimitError("only the last epoch may be short")
            h.sample_count = sum(p[1] for p in placed)
            h.triggers = [tuple(t) for t in h.triggers]

            def streams():
                for _, _, size, file, at in placed:
                    with open(file, "rb") as f:
                        f.seek(at)
                        yield io.BytesIO(f.read(size))

            unfinished = f"{self.path}.unfinished"
            with open(unfinished, "wb") as f:
                container.write_container(f, h, [p[2] for p in placed], streams(), [tuple(e) for e in self.embed], self.path)
            os.replace(unfinished, self.path)
        finally:
            shutil.rmtree(self.staging, ignore_errors=True)

    def abort(self, messages) -> None:
        import shutil

        shutil.rmtree(self.staging, ignore_errors=True)


def register(spark: SparkSession) -> SparkSession:
    """Make the formats known to a session, and let filters reach them."""
    for source in (RecordingSource, ArchiveSource, EpochSink):
        spark.dataSource.register(source)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark
