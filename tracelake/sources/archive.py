"""The event archive beside a recording: a list of typed objects.

An event is what all have (id, name, type, duration, stamp, descriptors, ...) and what its class
adds; which fields there are depends on the archive's version.  Both are tables below, read by one
decoder and written by one encoder.  Descriptor values are tagged scalars or arrays; they are kept
as (type, is_array, list of strings).
"""

from __future__ import annotations

import logging
import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field, replace
from functools import cache, lru_cache
from itertools import islice
from typing import BinaryIO

import numpy as np

from tracelake.errors import BugError, DataError, LimitError
from tracelake.functions import dates
from tracelake.sources.files import exists, open_file, sibling

log = logging.getLogger(__name__)

#: Variant tags and how numbers of a type are stored.
EMPTY, NULL, BSTR, BOOL, VARIANT = 0x0, 0x1, 0x8, 0xB, 0xC
ARRAY, BYREF = 0x2000, 0x4000
NUMBERS = {0x2: "<h", 0x3: "<i", 0x4: "<f", 0x5: "<d", 0x10: "<b", 0x11: "<B", 0x12: "<H", 0x13: "<I", BOOL: "<?"}
TYPE_NAMES = {EMPTY: "empty", NULL: "null", 0x2: "i2", 0x3: "i4", 0x4: "r4", 0x5: "r8", BSTR: "bstr", BOOL: "bool", 0x10: "i1", 0x11: "u1", 0x12: "u2", 0x13: "u4"}
TAGS = {v: k for k, v in TYPE_NAMES.items()}
#: Class names by kind.
LIBRARY = "class dcEventsLibrary_c"
CLASSES = {
    "marker": "class dcEventMarker_c",
    "epoch": "class dcEpochEvent_c",
    "artefact": "class dcArtefactEvent_c",
    "spike": "class dcSpikeEvent_c",
    "seizure": "class dcSeizureEvent_c",
    "sleep": "class dcSleepEvent_c",
    "rpeak": "class dcRPeakEvent_c",
}
KIND_OF = {v: k for k, v in CLASSES.items()}
DEFAULT_VERSION = 104
NO_CLASS, NAMED_CLASS, UNICODE = 0, -1, 0xFFFE
#: Descriptors and names of the public events.
IMPEDANCE, EVENT_CODE, CONDITION, VIDEO_TYPE, VIDEO_FILE = "Impedance", "EventCode", "Condition", "VideoMarkerType", "VideoFileName"
MARKER_TYPE, EPOCH_TYPE, MARKER_NAME, EPOCH_NAME = 1, 4, "Event Marker", "Epoch Event"
NO_CODE = -(1 << 31)

ALWAYS = (0, 1 << 31)
#: What every event has: (field, kind of value, versions from and before).
COMMON = (
    ("visible_id", "<i", ALWAYS),
    ("guid", "guid", ALWAYS),
    ("", "no class", ALWAYS),
    ("name", "text", ALWAYS),
    ("user_visible_name", "text", (78, ALWAYS[1])),
    ("type", "<i", ALWAYS),
    ("state", "<i", ALWAYS),
    ("original", "<b", ALWAYS),
    ("duration", "<d", ALWAYS),
    ("duration_offset", "<d", ALWAYS),
    ("stamp", "date", ALWAYS),
    ("descriptors", "descriptors", (19, ALWAYS[1])),
)
_CHANNEL = (("channel_active", "text", ALWAYS), ("channel_reference", "text", ALWAYS))
#: What a class adds.
OWN = {
    "marker": (*_CHANNEL, ("description", "text", ALWAYS), ("show_amplitude", "<b", (35, 104)), ("show_amplitude", "<i", (104, ALWAYS[1])), ("show_duration", "<b", (35, ALWAYS[1]))),
    "epoch": (("", "<i", (0, 33)),),
    "artefact": (*_CHANNEL, ("description", "text", (174, ALWAYS[1]))),
    "spike": (*_CHANNEL, ("amplitude_peak", "<f", ALWAYS), ("sign", "<h", ALWAYS), ("group", "<h", ALWAYS), ("top_date", "date", ALWAYS)),
    "seizure": _CHANNEL,
    "sleep": tuple((k, "<h", ALWAYS) for k in ("base_level", "threshold", "min_duration", "max_value", "epoch_length")) + (("epoch_color", "<i", ALWAYS),),
    "rpeak": (*_CHANNEL, ("amplitude_peak", "<f", ALWAYS)),
}
#: Versions whose events can't be told.
UNSUPPORTED = range(11, 19)


@dataclass
class Library:
    """Events of an archive, in order; each a dict of fields with its class under ``class``."""

    version: int = DEFAULT_VERSION
    name: str = ""
    events: list[dict] = field(default_factory=list)


class Ended(DataError):
    """The archive is over before what was to be read."""


#: How values that are no single number lie in a run of values of fixed size.
_FIXED = {"guid": "16s", "date": "dd", "no class": "i"}


@cache
def _runs(kind: str, version: int) -> tuple[tuple[str, struct.Struct | None, tuple], ...]:
    """What an event of that class holds: texts, descriptors, and runs of values of fixed size
    (name and form of each), which are unpacked at once."""
    out, run = [], []

    def close():
        if run:
            out.append(("fixed", struct.Struct("<" + "".join(_FIXED.get(form) or form[1:] for _, form in run)), tuple(run)))
            run.clear()

    for name, form, (first, before) in (*COMMON, *OWN[kind]):
        if first <= version < before:
            if form in ("text", "descriptors"):
                close()
                out.append((form, None, (name,)))
            else:
                run.append((name, form))
    close()
    return tuple(out)


_SCALARS = {tag: struct.Struct(form) for tag, form in NUMBERS.items()}
_FORMS = {form: struct.Struct(form) for form in ("<B", "<h", "<i", "<H", "<I", "<Q")}
#: Class name as it stands before an object, in an archive and in a search for the next event.
CLASS_STARTS = tuple(struct.pack("<iB", NAMED_CLASS, len(name)) + name.encode() for name in CLASSES.values())
_KIND_AT = dict(zip(CLASS_STARTS, CLASSES, strict=True))
#: Bytes that are read at once.
BLOCK = 1 << 20


class Decoder:
    """Reads the values of an archive one after the other, a block of the file at a time; ``at`` is
    the place in the block ``buf``, which starts at ``base``."""

    def __init__(self, f: BinaryIO, at: int = 0, version: int = DEFAULT_VERSION):
        self.f, self.version = f, version
        self.size = f.seek(0, 2)
        self.buf, self.base, self.at = b"", at, 0

    def tell(self) -> int:
        return self.base + self.at

    def take(self, n: int) -> int:
        """Place of the next ``n`` bytes in ``buf``; they count as read."""
        i = self.at
        if i + n > len(self.buf):
            start = self.base + i
            if n < 0 or start + n > self.size:
                raise Ended("archive ends early")
            self.f.seek(start)
            self.buf, self.base, i = self.f.read(max(n, BLOCK)), start, 0
            if len(self.buf) < n:
                raise Ended("archive ends early")
        self.at = i + n
        return i

    def jump(self, n: int) -> None:
        """Leave out ``n`` bytes, which need not be in the block."""
        if n < 0 or self.base + self.at + n > self.size:
            raise Ended("archive ends early")
        self.at += n
        if self.at > len(self.buf):
            self.buf, self.base, self.at = b"", self.base + self.at, 0

    def raw(self, n: int) -> bytes:
        i = self.take(n)
        return self.buf[i : i + n]

    def value(self, form: str):
        f = _FORMS[form]
        i = self.take(f.size)
        return f.unpack_from(self.buf, i)[0]

    def length(self) -> tuple[int, bool]:
        """Bytes of a text, and whether it is wide."""
        i = self.take(1)
        n = self.buf[i]
        if n != 0xFF:
            return n, False
        n, wide = self.value("<H"), False
        if n == UNICODE:
            wide, n = True, self.value("<B")
            if n != 0xFF:
                return 2 * n, True
            n = self.value("<H")
        if n == 0xFFFF:
            n = self.value("<I")
            if n == 0xFFFFFFFF:
                n = self.value("<Q")
        return (2 * n if wide else n), wide

    def text(self) -> str:
        i, buf = self.at, self.buf
        if i < len(buf) and (n := buf[i]) != 0xFF and (end := i + 1 + n) <= len(buf):  # most texts
            self.at = end
            return buf[i + 1 : end].decode("utf-8", "replace")
        n, wide = self.length()
        i = self.take(n)
        return str(self.buf[i : i + n], "utf-16-le" if wide else "utf-8", "replace")

    def skip_text(self) -> None:
        i, buf = self.at, self.buf
        if i < len(buf) and (n := buf[i]) != 0xFF and (end := i + 1 + n) <= len(buf):
            self.at = end
        else:
            self.jump(self.length()[0])

    def _wide_bytes(self) -> int:
        n = self.value("<i")
        if n < 0 or n % 2:
            raise DataError(f"wide text of {n} bytes")
        return n

    def bstr(self) -> str:
        return self.raw(self._wide_bytes()).decode("utf-16-le", "surrogatepass")

    def class_name(self, before: str | None = None) -> str | None:
        """Class name of the next object, None for an object without one."""
        tag = self.value("<i")
        if tag == NO_CLASS:
            return None
        if tag != NAMED_CLASS:
            raise DataError(f"class tag {tag}")
        return self.text()

    def kind(self) -> str | None:
        """Class of the next event, None for an object without one."""
        i, buf = self.at, self.buf
        if i + 5 <= len(buf) and (kind := _KIND_AT.get(buf[i : i + 5 + buf[i + 4]])):  # most objects
            self.at = i + 5 + buf[i + 4]
            return kind
        name = self.class_name()
        if name is not None and name not in KIND_OF:
            raise DataError(f"unknown event class {name!r}")
        return None if name is None else KIND_OF[name]

    def scalar(self, tag: int) -> list[str]:
        if tag in (EMPTY, NULL):
            return []
        if tag == BSTR:
            return [self.bstr()]
        f = _SCALARS[tag]
        i = self.take(f.size)
        x = f.unpack_from(self.buf, i)[0]
        return [f"{x:.6f}" if isinstance(x, float) else str(int(x))]

    def skip_scalar(self, tag: int, times: int = 1) -> None:
        if tag == BSTR:
            for _ in range(times):
                self.jump(self._wide_bytes())
        elif tag not in (EMPTY, NULL):
            self.jump(_SCALARS[tag].size * times)

    def variant_tag(self) -> tuple[int, bool]:
        """Tag of a value, and whether it is an array."""
        tag = self.value("<h")
        if tag in TYPE_NAMES:
            return tag, False
        if not tag & (ARRAY | BYREF):
            raise DataError(f"variant tag {tag}")
        tag = self.value("<h")
        if tag not in TYPE_NAMES:
            raise DataError(f"array of variant tag {tag}")
        self.skip_scalar(tag)  # a sample element
        if tag in (EMPTY, NULL):
            raise DataError("array without element type")
        return tag, True

    def variant(self) -> dict:
        tag, array = self.variant_tag()
        return {"type": TYPE_NAMES[tag], "is_array": array, "data": [x for _ in range(self.value("<I") if array else 1) for x in self.scalar(tag)]}

    def _count(self) -> int:
        n = self.value("<i")
        if n < 0:
            raise DataError("negative number of descriptors")
        return n

    def descriptors(self) -> list[dict]:
        out = []
        for _ in range(self._count()):
            name, value = self.text(), self.variant()
            out.append({"name": name, "unit": self.text(), **value})
        return out

    def _supported(self) -> None:
        if self.version in UNSUPPORTED:
            raise LimitError(f"archives of version {self.version} are not supported")

    def event(self, kind: str) -> dict:
        self._supported()
        out = {"class": kind}
        for form, run, names in _runs(kind, self.version):
            if form == "text":
                out[names[0]] = self.text()
            elif form == "descriptors":
                out[names[0]] = self.descriptors()
            else:
                i = self.take(run.size)
                values = iter(run.unpack_from(self.buf, i))
                for name, kind_of_value in names:
                    x = next(values)
                    if kind_of_value == "date":
                        x = dates.to_micros(x, next(values))
                    elif kind_of_value == "guid":
                        x = x.hex()
                    elif kind_of_value == "no class" and x != NO_CLASS:
                        raise DataError("unexpected class")
                    if name:
                        out[name] = x
        out.setdefault("descriptors", [])
        return out

    def skip(self, kind: str) -> None:
        """Go to the end of an event, looking only at what its size depends on."""
        self._supported()
        for form, run, _ in _runs(kind, self.version):
            if form == "text":
                self.skip_text()
            elif form == "fixed":
                self.jump(run.size)
            else:
                for _ in range(self._count()):
                    self.skip_text()
                    tag, array = self.variant_tag()
                    self.skip_scalar(tag, self.value("<I") if array else 1)
                    self.skip_text()


def read_head(d: Decoder) -> tuple[str, int]:
    """Name of an archive and how many objects follow; ``d`` takes its version."""
    for _ in range(3):
        d.value("<I")  # times of creation, change and access
    d.version = d.value("<i")
    d.value("<i"), d.value("<i")  # compression, encryption
    name = d.class_name()
    if name is None:
        return "", 0
    if name != LIBRARY:
        raise DataError(f"class {name!r} is no event library")
    return d.text(), d.value("<I")


def objects(d: Decoder, count: int) -> Iterator[dict]:
    """Events among the next ``count`` objects."""
    for _ in range(count):
        kind = d.kind()
        if kind is not None:
            yield d.event(kind)


def read_archive(f: BinaryIO) -> Library:
    d = Decoder(f)
    name, count = read_head(d)
    return Library(d.version, name, list(objects(d, count)))


def iter_events(path: str) -> Iterator[dict]:
    """Events of a file, one after the other; none if there is no file."""
    if exists(path):
        with open_file(path) as f:
            d = Decoder(f)
            yield from objects(d, read_head(d)[1])


def read_events(path: str) -> Library:
    """Archive of a file; an empty library if there is none."""
    if not exists(path):
        return Library()
    with open_file(path) as f:
        return read_archive(f)


@dataclass(frozen=True)
class Span:
    """Objects that lie together in an archive: from byte ``at`` up to ``end``, ``objects`` of them,
    of which ``events`` have a class; ``first`` is the place of the first one among all events."""

    at: int
    end: int
    objects: int
    events: int
    first: int = 0


def _walk(d: Decoder, stop: int, most: int) -> tuple[int, int]:
    """Pass objects that start before ``stop``, ``most`` at most; how many they are, and how many of
    them events."""
    n = events = 0
    while n < most and d.tell() < stop:
        kind = d.kind()
        if kind is not None:
            d.skip(kind)
            events += 1
        n += 1
    return n, events


def _starts(f: BinaryIO, lo: int, hi: int) -> Iterator[int]:
    """Places in [lo, hi) that look like the start of an event."""
    overlap = max(map(len, CLASS_STARTS)) - 1
    for at in range(lo, hi, BLOCK):
        end = min(hi, at + BLOCK)
        f.seek(at)
        raw = f.read(end - at + overlap)
        yield from (at + m.start() for m in _ANY_START.finditer(raw) if at + m.start() < end)


_ANY_START = re.compile(b"(?=" + b"|".join(re.escape(x) for x in CLASS_STARTS) + b")")
#: Places that are tried as the first event of a part.
TRIES = 16


def guessed_span(path: str, version: int, lo: int, hi: int) -> Span | None:
    """Objects of a part of an archive, from the first place in it that looks like an event and from
    which objects follow each other up to ``hi``; None if there is none.  It is only a guess: a text
    may hold what looks like an event.  :func:`joined` tells."""
    with open_file(path) as f:
        for at in islice(_starts(f, lo, hi), TRIES):
            d = Decoder(f, at, version)
            try:
                n, events = _walk(d, hi, 1 << 62)
            except DataError:
                continue
            return Span(at, d.tell(), n, events)
    return None


def joined(path: str, version: int, start: int, count: int, guesses: list[tuple[int, Span | None]]) -> list[Span]:
    """The ``count`` objects from ``start`` on, cut where the guesses for the parts (each with where
    its part ends) prove right: a guess is right if it starts where the objects before it end.  Parts
    without one that is are passed over here, object by object."""
    out: list[Span] = []
    at, left, first = start, count, 0
    with open_file(path) as f:
        d = Decoder(f, start, version)

        def add(s: Span) -> None:
            nonlocal at, left, first
            if s.objects:
                out.append(replace(s, first=first))
            at, left, first = s.end, left - s.objects, first + s.events

        def pass_to(stop: int) -> None:
            d.jump(at - d.tell())
            n, events = _walk(d, stop, left)
            add(Span(at, d.tell(), n, events))

        for hi, guess in guesses:
            if guess is not None and at < guess.at and left:
                pass_to(guess.at)
            if guess is not None and at == guess.at and guess.objects <= left:
                add(guess)
            elif at < hi and left:
                pass_to(hi)
        if left:
            pass_to(1 << 62)
    return out


def journal_path(path: str) -> str:
    """Where the events of an archive under construction are."""
    return f"{path}_archive.bin"


JOURNAL_HEADER = b"ctkp\x01\x0asevt"


def event_bytes(e: dict, version: int = DEFAULT_VERSION) -> bytes:
    w = Encoder(version)
    w.event(e)
    return bytes(w.out)


def iter_journal(path: str) -> Iterator[dict]:
    """Events of an archive that was not finished; none if there is no journal.  An event that was
    cut off by a crash is logged and left out."""
    if not exists(journal_path(path)):
        return
    with open_file(journal_path(path)) as f:
        if f.read(len(JOURNAL_HEADER)) != JOURNAL_HEADER:
            raise DataError(f"no event journal: {journal_path(path)}")
        d = Decoder(f, len(JOURNAL_HEADER))
        while d.tell() < d.size:
            try:
                kind = d.kind()
                e = None if kind is None else d.event(kind)
            except DataError as x:
                if not isinstance(x, Ended) and d.tell() < d.size:
                    raise
                log.warning("journal %s ends in an event: %s", path, x)
                return
            if e is not None:
                yield e


def read_journal(path: str) -> Library:
    return Library(events=list(iter_journal(path)))


@lru_cache(4096)
def _short_text(s: str) -> bytes:
    raw = s.encode()
    return struct.pack("<B", len(raw)) + raw if len(raw) < 0xFF else struct.pack("<BH", 0xFF, len(raw)) + raw


class Encoder:
    def __init__(self, version: int):
        self.out, self.version = bytearray(), version

    def value(self, form: str, x) -> None:
        try:
            self.out += struct.pack(form, x)
        except struct.error as e:
            raise LimitError(f"{x!r} does not fit: {e}") from None

    def text(self, s: str) -> None:
        if len(s) < 0x40:  # of which many are the same
            self.out += _short_text(s)
            return
        raw = s.encode()
        n = len(raw)
        if n < 0xFF:
            self.value("<B", n)
        else:
            self.value("<B", 0xFF)
            if n < UNICODE:
                self.value("<H", n)
            else:
                self.value("<H", 0xFFFF)
                if n < 0xFFFFFFFF:
                    self.value("<I", n)
                else:
                    self.value("<I", 0xFFFFFFFF)
                    self.value("<Q", n)
        self.out += raw

    def class_name(self, name: str) -> None:
        self.value("<i", NAMED_CLASS)
        self.text(name)

    def scalar(self, tag: int, x: str) -> None:
        if tag == BSTR:
            raw = x.encode("utf-16-le", "surrogatepass")
            self.value("<i", len(raw))
            self.out += raw
        elif tag in NUMBERS:
            form = NUMBERS[tag]
            self.value(form, float(x) if form in ("<f", "<d") else bool(int(x)) if form == "<?" else int(x))

    def variant(self, v: dict) -> None:
        tag = TAGS[v["type"]]
        if not v["is_array"]:
            if len(v["data"]) != 1 and tag not in (EMPTY, NULL):
                raise BugError("a scalar has one value")
            self.value("<h", tag)
            self.scalar(tag, v["data"][0] if v["data"] else "")
            return
        self.value("<h", ARRAY | VARIANT)
        self.value("<h", tag)
        self.scalar(tag, "" if tag == BSTR else "0")
        self.value("<I", len(v["data"]))
        for x in v["data"]:
            self.scalar(tag, x)

    def words(self, form: str, name: str, x) -> tuple:
        """A value as it lies in a run of values of fixed size."""
        if form == "guid":
            return (bytes.fromhex(x or "00" * 16),)
        if form == "date":
            return dates.from_micros(x or 0)
        if form == "no class":
            return (NO_CLASS,)
        if name == "show_amplitude" and form == "<b":
            return (int((x or 0) > 0),)
        return (x or 0 if name else 0,)

    def fixed(self, run: struct.Struct, values: list) -> None:
        try:
            self.out += run.pack(*values)
        except struct.error as e:
            raise LimitError(f"one of {values!r} does not fit: {e}") from None

    def descriptors(self, ds: list[dict]) -> None:
        self.value("<i", len(ds))
        for d in ds:
            self.text(d["name"])
            self.variant(d)
            self.text(d.get("unit") or "")

    def event(self, e: dict) -> None:
        if self.version in UNSUPPORTED:
            raise BugError(f"archives of version {self.version} are not supported")
        self.class_name(CLASSES[e["class"]])
        for form, run, names in _runs(e["class"], self.version):
            if form == "text":
                self.text(e.get(names[0]) or "")
            elif form == "descriptors":
                self.descriptors(e.get(names[0]) or [])
            else:
                self.fixed(run, [x for name, kind in names for x in self.words(kind, name, e.get(name))])


def archive_head(version: int, name: str, count: int) -> bytes:
    """What stands before the events of an archive."""
    if count >= 1 << 32:
        raise LimitError("too many events")
    w = Encoder(version)
    for _ in range(3):
        w.value("<I", 0)
    for x in (version, 0, 0):
        w.value("<i", x)
    w.class_name(LIBRARY)
    w.text(name)
    w.value("<I", count)
    return bytes(w.out)


def archive_bytes(lib: Library) -> bytes:
    """Bytes of an archive; ``events`` are written in their order."""
    return archive_head(lib.version, lib.name, len(lib.events)) + b"".join(event_bytes(e, lib.version) for e in lib.events)


def _value(kind: str, *data, array: bool = False) -> dict:
    return {"type": kind, "is_array": array, "data": [str(x) for x in data]}


def _first(e: dict, name: str, kind: str, array: bool = False) -> list[str] | None:
    d = next((d for d in e["descriptors"] if d["name"] == name), None)
    return d["data"] if d and d["type"] == kind and d["is_array"] == array and (array or len(d["data"]) == 1) else None


def is_impedance(e: dict) -> bool:
    return e["class"] == "marker" and _first(e, IMPEDANCE, "r4", array=True) is not None


def is_video(e: dict) -> bool:
    return e["class"] == "marker" and not is_impedance(e) and any(d["name"] == VIDEO_TYPE for d in e["descriptors"])


def kind_of(e: dict) -> str:
    return "impedance" if is_impedance(e) else "video" if is_video(e) else e["class"]


def impedance(stamp: int, ohm: list[float]) -> dict:
    """A marker with impedances, which are stored in kOhm as 32-bit numbers."""
    kilo = np.asarray(ohm, dtype=np.float32) / np.float32(1000)
    return _marker(stamp, [{"name": IMPEDANCE, "unit": "kOhm", **_value("r4", *[f"{x:.6f}" for x in kilo], array=True)}], 0.0, IMPEDANCE)


def _marker(stamp: int, descriptors: list[dict], duration: float, description: str) -> dict:
    return {"class": "marker", "name": MARKER_NAME, "type": MARKER_TYPE, "stamp": stamp, "duration": duration, "descriptors": descriptors, "description": description}


def _labels(condition: str, code: int | None) -> list[dict]:
    out = [{"name": CONDITION, "unit": "", **_value("bstr", condition)}] if condition else []
    return out + ([{"name": EVENT_CODE, "unit": "", **_value("i4", code)}] if code is not None and code != NO_CODE else [])


def video(stamp: int, duration: float = 0.0, code: int | None = None, condition: str = "", description: str = "", video_file: str = "") -> dict:
    more = [{"name": VIDEO_TYPE, "unit": "", **_value("i2", 0)}]
    if video_file:
        more.append({"name": VIDEO_FILE, "unit": "", **_value("bstr", video_file)})
    return _marker(stamp, _labels(condition, code) + more, duration, description)


def epoch_event(stamp: int, duration: float = 0.0, offset: float = 0.0, code: int | None = None, condition: str = "") -> dict:
    return {"class": "epoch", "name": EPOCH_NAME, "type": EPOCH_TYPE, "stamp": stamp, "duration": duration, "duration_offset": offset, "descriptors": _labels(condition, code)}


def numbered(events: list[dict]) -> list[dict]:
    """Events with visible ids from 1."""
    return [{**e, "visible_id": i} for i, e in enumerate(events, 1)]


def archive_path(recording: str) -> str:
    return sibling(recording, "evt")
