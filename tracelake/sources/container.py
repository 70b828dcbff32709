"""The recording container: a tree of chunks, and its crash-safe form of ten part files.

A chunk is a four-byte id, a size (4 bytes in RIFF files, 8 in RF64 files), for root and LIST chunks
a four-byte label, the payload, and a byte if the payload is odd.  Everything is little endian.
"""

from __future__ import annotations

import io
import logging
import os
import re
import struct
from dataclasses import dataclass, field
from typing import BinaryIO

import numpy as np

from tracelake.errors import BugError, DataError, LimitError
from tracelake.functions import dates, leb128, text
from tracelake.sources.files import exists, open_file, sibling

log = logging.getLogger(__name__)

#: Root ids by kind, with the formats of sizes and of trigger samples.
KINDS = {"RIFF": ("<I", "<i"), "RF64": ("<Q", "<Q")}
#: Ids that embedded files can't have.
RESERVED = ("eeph", "info", "evt ", "raw3", "rawf", "stdd", "tfh ", "tfd ", "refh", "imp ", "nsh ", "vish", "egih", "egig", "egiz", "binh", "xevt", "xseg", "xsen", "xtrg")
#: Files beside the recording that are added to it, by extension.
SATELLITES = {"evt": "xevt", "seg": "xseg", "sen": "xsen", "trg": "xtrg"}
#: Part files of a recording under construction: tag, suffix, label.
PARTS = {
    "data": (0, "_raw3_data.bin", "raw3"),
    "ep": (1, "_raw3_ep.bin", "raw3"),
    "chan": (2, "_raw3_chan.bin", "raw3"),
    "sample_count": (3, "_raw3_sample_count.bin", "eeph"),
    "electrodes": (4, "_electrodes.bin", "eeph"),
    "sampling_frequency": (5, "_sampling_frequency.bin", "eeph"),
    "triggers": (6, "_triggers.bin", "evt "),
    "info": (7, "_info.bin", "info"),
    "cnt_type": (8, "_type.bin", "cntt"),
    "history": (9, "_history.bin", "eeph"),
}
PART_MAGIC, PART_HEADER = b"ctkp\x01", 10
FILE_VERSION = (4, 2)
DEFAULT_EPOCH = 1024
FREQUENCY_TOLERANCE = 1e-6


@dataclass
class Header:
    """What a recording says of itself."""

    kind: str = "RIFF"
    version: tuple[int, int] = FILE_VERSION
    start: int = 0  # microseconds since 1970
    sampling_frequency: float = 0.0
    epoch_length: int = DEFAULT_EPOCH
    sample_count: int = 0
    electrodes: list[dict] = field(default_factory=list)
    order: list[int] = field(default_factory=list)
    info: dict = field(default_factory=dict)
    history: str = ""
    triggers: list[tuple[int, str]] = field(default_factory=list)
    #: By epoch: place in the file and bytes.
    ranges: list[tuple[int, int]] = field(default_factory=list)
    #: Embedded files: id, place, bytes.
    embedded: list[tuple[str, int, int]] = field(default_factory=list)

    @property
    def epochs(self) -> int:
        return len(self.ranges)

    def epoch_samples(self, i: int) -> int:
        """Samples of an epoch: the last one may be shorter."""
        return max(0, min(self.epoch_length, self.sample_count - i * self.epoch_length))


@dataclass(frozen=True)
class Chunk:
    id: str
    label: str
    path: str
    fpos: int
    payload: int
    size: int


def _exact(f: BinaryIO, n: int) -> bytes:
    out = f.read(n)
    if len(out) != n:
        raise DataError("file ends early")
    return out


def _at(f: BinaryIO, place: int, n: int) -> bytes:
    f.seek(place)
    return _exact(f, n)


def chunks(f: BinaryIO) -> tuple[str, list[Chunk]]:
    """Kind of the file, and its chunks, each list before what it holds.  A truncated tail is
    logged and ends the list."""
    kind = _at(f, 0, 4).decode("latin-1")
    if kind not in KINDS:
        raise DataError(f"unknown file type {kind!r}")
    size_format = KINDS[kind][0]
    head = 4 + struct.calcsize(size_format)
    out: list[Chunk] = []

    def read(place: int, above: str) -> Chunk | None:
        f.seek(place)
        raw = f.read(head)
        if len(raw) < head:
            return None
        name, size = raw[:4].decode("latin-1"), struct.unpack(size_format, raw[4:])[0]
        label = f.read(4).decode("latin-1") if name in (kind, "LIST") else ""
        if name in (kind, "LIST") and len(label) < 4:
            return None
        return Chunk(name, label, f"{above}/{label or name}", place, place + head, size)

    def children(parent: Chunk) -> None:
        at, last = parent.payload + 4, parent.payload + parent.size + parent.size % 2
        while at < last:
            c = read(at, parent.path)
            if c is None:
                log.warning("chunks of %s end before it does", parent.path)
                break
            out.append(c)
            if c.id == "LIST":
                children(c)
            at = c.payload + c.size + c.size % 2

    root = read(0, "")
    if root is None:
        raise DataError("file ends in its root chunk")
    out.append(root)
    children(root)
    return kind, out


def epoch_ranges(offsets: list[int], first: int, size: int) -> list[tuple[int, int]]:
    """Place and bytes of each epoch, from increasing offsets into the data."""
    if size < 1 or not offsets:
        raise BugError("no offsets or no data")
    ends = [*offsets[1:], size]
    if any(b <= a for a, b in zip(offsets, ends, strict=True)) or offsets[-1] >= size:
        raise DataError("epoch offsets don't increase or exceed the data")
    return [(first + a, b - a) for a, b in zip(offsets, ends, strict=True)]


def parse_ep(raw: bytes, kind: str) -> tuple[int, list[int]]:
    """Epoch length and offsets."""
    n = struct.calcsize(KINDS[kind][0])
    if len(raw) // n < 2:
        raise DataError("no epochs")
    numbers = np.frombuffer(raw[: len(raw) // n * n], dtype="<u4" if n == 4 else "<u8").astype(np.int64).tolist()
    return numbers[0], numbers[1:]


def parse_triggers(raw: bytes, kind: str) -> list[tuple[int, str]]:
    """(sample, code) records; a code ends at a NUL."""
    form = KINDS[kind][1]
    n = struct.calcsize(form)
    step = n + text.CODE_BYTES
    return [(struct.unpack_from(form, raw, at)[0], raw[at + n : at + step].split(b"\0")[0].decode("utf-8", "replace")) for at in range(0, len(raw) // step * step, step)]


def pack_triggers(triggers: list[tuple[int, str]], kind: str) -> bytes:
    try:
        return b"".join(struct.pack(KINDS[kind][1], s) + code.encode()[: text.CODE_BYTES].ljust(text.CODE_BYTES, b"\0") for s, code in triggers)
    except struct.error as e:
        raise LimitError(f"trigger sample does not fit: {e}") from None


def parse_header_text(raw: str) -> dict:
    """Sections of the header text."""
    rows = text.lines(raw, text.HEADER_LINE)
    out: dict = {"version": (0, 0), "electrodes": [], "history": "", "sample_count": 0, "sampling_frequency": 0.0, "channels": 0}
    i = 0
    while i < len(rows):
        line, i = rows[i], i + 1
        value = rows[i] if i < len(rows) else ""
        if "[Samples]" in line:
            out["sample_count"], i = text.whole_number(value), i + 1
        elif "[Sampling Rate]" in line:
            out["sampling_frequency"], i = text.number(value), i + 1
        elif "[Channels]" in line:
            out["channels"], i = text.whole_number(value), i + 1
        elif "[File Version]" in line:
            major, dot, minor = value.partition(".")
            if dot and major.strip().isdigit() and minor.strip().isdigit():
                out["version"] = (int(major), int(minor))
            i += 1
        elif "[Basic Channel Data]" in line:
            out["electrodes"] = text.parse_electrodes(rows[i:], out["version"][0] < 4)
            while i < len(rows) and not rows[i].startswith("["):
                i += 1
        elif "[History]" in line:
            kept = []
            while i < len(rows) and rows[i] != "EOH":
                kept.append(rows[i])
                i += 1
            out["history"] = "".join(x + "\n" for x in kept)
            i += 1
    return out


def header_text(h: Header) -> str:
    return "".join(
        [
            f"[File Version]\n{FILE_VERSION[0]}.{FILE_VERSION[1]}\n",
            f"[Sampling Rate]\n{text.general(h.sampling_frequency, 13)}\n",
            f"[Samples]\n{h.sample_count}\n",
            f"[Channels]\n{len(h.electrodes)}\n",
            "[Basic Channel Data]\n",
            *[text.electrode_text(e) + "\n" for e in h.electrodes],
            f"[History]\n{h.history}\nEOH\n",
        ]
    )


def parse_birth(line: str) -> int:
    """Microseconds since 1970 of "sec min hour day month-1 year-1900 ...".  Fields that are missing
    are those of 1970-01-01 00:00:00, which also stands for what is no time of the calendar."""
    fields = [0, 0, 0, 1, 0, 70]
    for k, x in enumerate(line.split()[:6]):
        whole = re.match(r"[+-]?[0-9]+", x)
        fields[k] = int(whole[0]) if whole else 0
        if not whole or whole[0] != x:
            log.warning("date of birth %r is incomplete", line)
            break
    sec, minute, hour, day, month, year = fields
    try:
        return dates.micros_of_civil(year + 1900, month + 1, day, hour, minute, sec)
    except LimitError:
        log.warning("date of birth %r is none", line)
        return 0


def parse_info(raw: str) -> tuple[float, float, dict, bool]:
    """Start (day number, part of a second), the info fields, and whether the start was there."""
    rows = text.lines(raw, text.INFO_LINE)
    start, fraction, found, ascii_start = 0.0, 0.0, {}, False
    i = 0
    while i < len(rows):
        line, i = rows[i], i + 1
        value = rows[i] if i < len(rows) else ""
        if "[StartDate]" in line:
            start, ascii_start, i = text.number(value), True, i + 1
        elif "[StartFraction]" in line:
            fraction, i = text.number(value), i + 1
        else:
            key = next((k for k in text.INFO_KEYS if f"[{k}]" in line), None)
            if key:
                name, i = text.INFO_KEYS[key], i + 1
                if name == "subject_sex":
                    value = {"M": "male", "F": "female"}.get(value[:1].upper(), "unknown")
                elif name == "subject_handedness":
                    value = {"L": "left", "R": "right", "M": "mixed"}.get(value[:1].upper(), "unknown")
                elif name == "subject_dob":
                    value = parse_birth(value)
                found[name] = value
    return start, fraction, found, ascii_start


def info_text(start: int, info: dict) -> str:
    day, part = dates.from_micros(start)
    out = [f"[StartDate]\n{text.general(day, 21)}\n", f"[StartFraction]\n{text.general(part, 21)}\n"]
    for key, name in text.INFO_KEYS.items():
        value = info.get(name)
        if name == "subject_sex":
            value = {"male": "M", "female": "F"}.get(value or "")
        elif name == "subject_handedness":
            value = {"left": "L", "right": "R", "mixed": "M"}.get(value or "")
        elif name == "subject_dob" and value:
            t = dates.datetime_of(value).timetuple()
            value = f"{t.tm_sec} {t.tm_min} {t.tm_hour} {t.tm_mday} {t.tm_mon - 1} {t.tm_year - 1900} {(t.tm_wday + 1) % 7} {t.tm_yday - 1} 0"
        if value:
            out.append(f"[{key}]\n{text.cut_bytes(str(value), text.INFO_BYTES)}\n")
    return "".join(out)


def _info(raw: bytes, version: tuple[int, int]) -> tuple[int, dict]:
    if not raw:
        return dates.to_micros(0, 0), {}
    start, fraction, info, there = parse_info(raw.decode("utf-8", "replace"))
    if not there and version == (0, 0):
        if len(raw) < 16:
            raise DataError("info has no start")
        start, fraction = struct.unpack_from("<dd", raw)
    return dates.to_micros(start, fraction), info


def check(h: Header) -> Header:
    """Header rules: samples, rate, electrodes, order, epochs."""
    if h.sample_count < 1 or h.epoch_length < 1 or not h.sampling_frequency > 0 or not h.electrodes:
        raise DataError("recording without samples, epoch length, rate or electrodes")
    if len(h.electrodes) > 1 << 15 or sorted(h.order) != list(range(len(h.electrodes))):
        raise DataError("row order is no permutation of the electrodes")
    if -(-h.sample_count // h.epoch_length) > h.epochs:
        raise DataError("fewer epochs than samples need")
    return h


def read_header(path: str) -> Header:
    """Header of a packed container."""
    with open_file(path) as f:
        return parse_header(f)


def parse_header(f: BinaryIO) -> Header:
    kind, tree = chunks(f)
    if tree[0].label.rstrip() != "CNT":
        raise DataError(f"root label {tree[0].label!r}")
    by_path = {c.path.removeprefix(tree[0].path): c for c in tree}
    for name in ("rawf", "stdd", "tfd "):
        if any(c.label == name for c in tree):
            raise DataError(f"{name.strip()} recordings (averages, deviations, wavelets) are not supported")
    need = {"/eeph", "/raw3/ep  ", "/raw3/chan", "/raw3/data"} - set(by_path)
    if need:
        raise DataError(f"chunks missing: {', '.join(sorted(need))}")
    load = lambda name: _at(f, by_path[name].payload, by_path[name].size) if name in by_path else b""
    said = parse_header_text(load("/eeph").decode("utf-8", "replace"))
    h = Header(kind=kind, version=said["version"], sampling_frequency=said["sampling_frequency"], sample_count=said["sample_count"], electrodes=said["electrodes"], history=said["history"])
    h.start, h.info = _info(load("/info"), h.version)
    h.epoch_length, offsets = parse_ep(load("/raw3/ep  "), kind)
    data = by_path["/raw3/data"]
    h.ranges = epoch_ranges(offsets, data.payload, data.size)
    order = load("/raw3/chan")
    h.order = np.frombuffer(order[: len(order) // 2 * 2], dtype="<i2").tolist()
    if said["channels"] != len(h.electrodes):
        raise DataError("channels and electrodes differ in number")
    h.triggers = parse_triggers(load("/evt "), kind)
    known = {"eeph", "info", "evt ", "LIST"}
    h.embedded = [(c.id, c.payload, c.size) for c in tree[1:] if c.path.count("/") == 2 and c.id not in known]
    return check(h)


def part_path(path: str, part: str) -> str:
    return f"{path}_flat{PARTS[part][1]}"


def part_header(part: str) -> bytes:
    tag, _, label = PARTS[part]
    return PART_MAGIC + bytes([tag]) + label.encode()


def _part(path: str, part: str) -> bytes:
    name = part_path(path, part)
    if not exists(name):
        raise DataError(f"part file missing: {name}")
    with open_file(name) as f:
        raw = f.read()
    if raw[:5] != PART_MAGIC or raw[5:PART_HEADER] != part_header(part)[5:]:
        raise DataError(f"not a {part} part file: {name}")
    return raw[PART_HEADER:]


def pack_electrodes(electrodes: list[dict]) -> bytes:
    out = [leb128.encode(len(electrodes))]
    for e in electrodes:
        for key in ("label", "reference", "unit", "status", "type"):
            raw = (e.get(key) or "").encode()
            out += [leb128.encode(len(raw)), raw]
        out.append(struct.pack("<dd", e["iscale"], e["rscale"]))
    return b"".join(out)


def parse_binary_electrodes(raw: bytes) -> list[dict]:
    count, at = leb128.decode(raw)
    if count < 0:
        raise DataError("negative number of electrodes")
    out = []
    for _ in range(count):
        e = {}
        for key in ("label", "reference", "unit", "status", "type"):
            n, at = leb128.decode(raw, at)
            if n < 0 or at + n > len(raw):
                raise DataError("electrode text exceeds its file")
            e[key], at = raw[at : at + n].decode("utf-8", "replace"), at + n
        if at + 16 > len(raw):
            raise DataError("electrode scales exceed their file")
        e["iscale"], e["rscale"] = struct.unpack_from("<dd", raw, at)
        at += 16
        out.append(e)
    return out


def read_parts(path: str) -> Header:
    """Header of a recording in part files; epochs lie in the data part."""
    kind = _part(path, "cnt_type").decode("latin-1")
    if kind not in KINDS:
        raise DataError(f"unknown file type {kind!r}")
    counts = _part(path, "sample_count")
    if len(counts) < 8:
        raise DataError("no sample count")
    if len(counts) % 8:
        log.warning("odd tail of the sample counts left out")
    h = Header(kind=kind, sample_count=struct.unpack_from("<q", counts, len(counts) // 8 * 8 - 8)[0])
    h.electrodes = parse_binary_electrodes(_part(path, "electrodes"))
    h.sampling_frequency = struct.unpack("<d", _part(path, "sampling_frequency")[:8])[0]
    h.start, h.info = _info(_part(path, "info"), FILE_VERSION)
    h.history = _part(path, "history").decode("utf-8", "replace")
    h.epoch_length, offsets = parse_ep(_part(path, "ep"), kind)
    h.ranges = epoch_ranges(offsets, PART_HEADER, len(_part(path, "data")))
    h.order = np.frombuffer(_part(path, "chan"), dtype="<i2").tolist()
    h.triggers = parse_triggers(_part(path, "triggers"), kind)
    return check(h)


def load(path: str, layout: str = "riff") -> tuple[Header, str]:
    """Header, and the file that holds the epochs."""
    if layout == "parts":
        return read_parts(path), part_path(path, "data")
    return read_header(path), path


class ChunkWriter:
    """Writes chunks to a binary stream; sizes are filled in afterwards."""

    def __init__(self, f: BinaryIO, kind: str):
        self.f, self.size_format = f, KINDS[kind][0]
        self.open: list[int] = []

    def begin(self, name: str, label: str = "") -> None:
        self.open.append(self.f.tell())
        self.f.write(name.encode("latin-1").ljust(4)[:4] + struct.pack(self.size_format, 0) + (label.encode("latin-1").ljust(4)[:4] if label else b""))

    def end(self) -> None:
        start, now = self.open.pop(), self.f.tell()
        size = now - start - 4 - struct.calcsize(self.size_format)
        self.f.seek(start + 4)
        try:
            self.f.write(struct.pack(self.size_format, size))
        except struct.error:
            raise LimitError("chunk too large for this kind of file") from None
        self.f.seek(now)
        if size % 2:
            self.f.write(b"\0")

    def chunk(self, name: str, content: bytes) -> None:
        self.begin(name)
        self.f.write(content)
        self.end()

    def copy(self, name: str, sources: list[BinaryIO]) -> None:
        self.begin(name)
        for source in sources:
            while block := source.read(1 << 20):
                self.f.write(block)
        self.end()


def clamp_label(label: str) -> str:
    return label[:4].ljust(4)


def write_container(f: BinaryIO, h: Header, epoch_bytes: list[int], data: list[BinaryIO], embedded: list[tuple[str, str]] = (), satellites_of: str | None = None) -> None:
    """A container from its header, the size of each encoded epoch, and streams that hold the
    epochs in order.  ``embedded``: (label, file).  Files beside ``satellites_of`` are added."""
    if not epoch_bytes:
        raise DataError("recording without epochs")
    labels = [clamp_label(k) for k, _ in embedded]
    if set(labels) & set(RESERVED) or len(set(labels)) < len(labels):
        raise LimitError(f"reserved or repeated label among {labels}")
    w = ChunkWriter(f, h.kind)
    w.begin(h.kind, "CNT ")
    w.chunk("eeph", header_text(h).encode())
    w.chunk("info", info_text(h.start, h.info).encode())
    w.begin("LIST", "raw3")
    offsets = np.concatenate(([h.epoch_length], np.cumsum([0, *epoch_bytes[:-1]])))
    width = "<u4" if h.kind == "RIFF" else "<u8"
    if int(offsets.max()) >= 1 << (8 * np.dtype(width).itemsize):
        raise LimitError("data too large for this kind of file")
    w.chunk("ep  ", offsets.astype(width).tobytes())
    w.chunk("chan", np.arange(len(h.electrodes), dtype="<i2").tobytes())
    w.copy("data", data)
    w.end()
    if h.triggers:
        w.chunk("evt ", pack_triggers(h.triggers, h.kind))
    for label, name in embedded:
        with open_file(name) as source:
            w.copy(clamp_label(label), [source])
    for extension, label in SATELLITES.items() if satellites_of else ():
        name = sibling(satellites_of, extension)
        if exists(name):
            with open_file(name) as source:
                w.copy(label, [source])
    w.end()


def container_bytes(h: Header, epochs: list[bytes], embedded: list[tuple[str, str]] = ()) -> bytes:
    out = io.BytesIO()
    write_container(out, h, [len(e) for e in epochs], [io.BytesIO(b"".join(epochs))], embedded)
    return out.getvalue()


class PartWriter:
    """The ten part files of a recording under construction, an epoch at a time.

    Of each epoch the data go first, then its place, then the number of samples so far, so what a
    crash leaves can be read up to the last whole epoch.  :meth:`flush` makes all of it durable.
    """

    def __init__(self, path: str, h: Header):
        self.path, self.h, self.at, self.samples = path, h, 0, 0
        self.offsets: list[int] = []
        self.width = KINDS[h.kind][0]
        self.files: dict[str, BinaryIO] = {}
        for part in ("data", "ep", "sample_count"):
            self.files[part] = open(part_path(path, part), "wb")  # noqa: SIM115
            self.files[part].write(part_header(part))
        self.files["ep"].write(struct.pack(self.width, h.epoch_length))
        self.replace("chan", np.arange(len(h.electrodes), dtype="<i2").tobytes())
        self.replace("electrodes", pack_electrodes(h.electrodes))
        self.replace("sampling_frequency", struct.pack("<d", h.sampling_frequency))
        self.replace("cnt_type", h.kind.encode())
        self.describe()

    def replace(self, part: str, raw: bytes) -> None:
        name = part_path(self.path, part)
        with open(f"{name}.new", "wb") as f:
            f.write(part_header(part) + raw)
        os.replace(f"{name}.new", name)

    def describe(self) -> None:
        """Write info, history and triggers as the header has them now."""
        self.replace("triggers", pack_triggers(self.h.triggers, self.h.kind))
        self.replace("info", info_text(self.h.start, self.h.info).encode())
        self.replace("history", self.h.history.encode())

    def append(self, raw: bytes, samples: int) -> None:
        if self.samples % self.h.epoch_length:
            raise BugError("only the last epoch may be short")
        try:
            place = struct.pack(self.width, self.at)
        except struct.error:
            raise LimitError("data too large for this kind of file") from None
        self.files["data"].write(raw)
        self.files["ep"].write(place)
        self.samples += samples
        self.files["sample_count"].write(struct.pack("<q", self.samples))
        self.offsets.append(self.at)
        self.at += len(raw)

    def epoch(self, i: int) -> bytes:
        """Bytes of an epoch that was appended."""
        self.files["data"].flush()
        end = self.offsets[i + 1] if i + 1 < len(self.offsets) else self.at
        with open(part_path(self.path, "data"), "rb") as f:
            return _at(f, PART_HEADER + self.offsets[i], end - self.offsets[i])

    def flush(self) -> None:
        self.describe()
        for part in ("data", "ep", "sample_count"):
            self.files[part].flush()
            os.fsync(self.files[part].fileno())

    def close(self) -> None:
        for f in self.files.values():
            f.close()

    def remove(self) -> None:
        self.close()
        for part in PARTS:
            if os.path.exists(part_path(self.path, part)):
                os.remove(part_path(self.path, part))

    def finish(self, embedded: list[tuple[str, str]] = ()) -> None:
        """Copy the parts into a container at ``path``, and remove them."""
        self.close()
        self.h.sample_count = self.samples
        unfinished = f"{self.path}.unfinished"
        with open(unfinished, "wb") as f, open(part_path(self.path, "data"), "rb") as data:
            data.seek(PART_HEADER)
            write_container(f, self.h, np.diff([*self.offsets, self.at]).tolist(), [data], embedded, self.path)
        os.replace(unfinished, self.path)
        self.remove()


def write_parts(path: str, h: Header, epochs: list[bytes]) -> None:
    """The ten part files of a recording under construction."""
    w = PartWriter(path, h)
    for i, raw in enumerate(epochs):
        w.append(raw, min(h.epoch_length, h.sample_count - i * h.epoch_length))
    w.close()
