"""Labels, codes and the text parts of recordings."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracelake.errors import DataError

#: Longest texts that the container keeps, in bytes.
CODE_BYTES = 8
LABEL_BYTES, UNIT_BYTES, REFERENCE_BYTES, STATUS_BYTES, TYPE_BYTES = 10, 10, 9, 9, 9
INFO_BYTES = 512
#: Keys of the info text, and the fields they fill.
INFO_KEYS = {
    "Hospital": "hospital",
    "TestName": "test_name",
    "TestSerial": "test_serial",
    "Physician": "physician",
    "Technician": "technician",
    "MachineMake": "machine_make",
    "MachineModel": "machine_model",
    "MachineSN": "machine_sn",
    "SubjectName": "subject_name",
    "SubjectID": "subject_id",
    "SubjectAddress": "subject_address",
    "SubjectPhone": "subject_phone",
    "SubjectSex": "subject_sex",
    "SubjectDateOfBirth": "subject_dob",
    "SubjectHandedness": "subject_handedness",
    "Comment": "comment",
}
INFO_LINE, HEADER_LINE, ELECTRODE_LINE = 255, 2047, 127
#: Electrode scales where none is given.
DEFAULT_UNIT, DEFAULT_ISCALE = "uV", 1.0


def default_rscale(unit: str) -> float:
    return 1 / 256 if unit == DEFAULT_UNIT else 1.0


def general(x: float, digits: int) -> str:
    """A number with that many significant digits, as header texts have it."""
    return f"{x:.{digits}g}"


def number(text: str) -> float:
    """The number at the start of a text; data error for none and for infinite ones."""
    m = re.match(r"\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?", text)
    if not m or not math.isfinite(float(m[0])):
        raise DataError(f"no finite number in {text!r}")
    return float(m[0])


def whole_number(text: str) -> int:
    m = re.match(r"\s*[+-]?\d+", text)
    if not m:
        raise DataError(f"no whole number in {text!r}")
    return int(m[0])


def lines(text: str, longest: int) -> list[str]:
    """Lines of a text; longer ones go on as the next line.  A longer line's character at the
    border is taken for its end."""
    out = []
    at = 0
    while at < len(text):
        end = text.find("\n", at)
        stop = min(end if end >= 0 else len(text), at + longest, len(text))
        out.append(text[at:stop])
        at = stop + 1
    return out


def cut_bytes(s: str, n: int) -> str:
    return s.encode()[:n].decode("utf-8", "ignore")


def electrode_text(e: dict) -> str:
    """A line of the channel table."""
    out = [cut_bytes(e["label"], LABEL_BYTES), general(e["iscale"], 11), general(e["rscale"], 11), cut_bytes(e["unit"], UNIT_BYTES)]
    for key, mark, n in (("reference", "REF:", REFERENCE_BYTES), ("status", "STAT:", STATUS_BYTES), ("type", "TYPE:", TYPE_BYTES)):
        if e.get(key):
            out.append(mark + cut_bytes(e[key], n))
    return " ".join(out)


def parse_electrodes(rows: list[str], old: bool = False) -> list[dict]:
    """Electrodes of a channel table, up to an empty line or a section.  ``old``: a lone fifth
    column without a mark is the reference."""
    out = []
    for line in rows:
        if not line or line[0] == "[":
            break
        if line[0] == ";":
            continue
        f = line.split()
        try:
            label, iscale, rscale, unit = f[0], float(f[1]), float(f[2]), f[3]
        except (IndexError, ValueError):
            raise DataError(f"no label, scales and unit in {line!r}") from None
        more = f[4:7]
        e = {"label": cut_bytes(label, LABEL_BYTES), "unit": cut_bytes(unit, UNIT_BYTES), "iscale": iscale, "rscale": rscale}
        for key, mark in (("reference", "REF:"), ("status", "STAT:"), ("type", "TYPE:")):
            e[key] = cut_bytes(next((x[len(mark) :] for x in more if x.startswith(mark)), ""), STATUS_BYTES)
        if old and not e["reference"] and len(more) == 1:
            e["reference"] = cut_bytes(more[0], REFERENCE_BYTES)
        out.append(e)
    return out


# Columns


def first_bytes(s: Column, n: int) -> Column:
    """The first ``n`` bytes of a text, without a character that they cut."""
    raw = F.substring(F.encode(s, "UTF-8"), 1, n)
    ends = [F.substring(raw, 1, F.octet_length(raw) - k) for k in range(4)]
    return F.coalesce(*[F.try_validate_utf8(x.cast("string")) for x in ends])


def label4(s: Column) -> Column:
    """Four-byte label: cut, or filled with blanks."""
    own = first_bytes(s, 4)
    return F.concat(own, F.repeat(F.lit(" "), 4 - F.octet_length(own)))


def trigger_code(s: Column) -> Column:
    """What a trigger keeps of a code: eight bytes, up to a NUL."""
    return F.substring_index(first_bytes(s, CODE_BYTES), "\0", 1)


def sex_char(s: Column) -> Column:
    """Stored letter of a sex; empty for unknown."""
    return F.when(F.lower(s) == "male", "M").when(F.lower(s) == "female", "F").otherwise("")


def sex_of(c: Column) -> Column:
    return F.when(F.upper(c) == "M", "male").when(F.upper(c) == "F", "female").otherwise("unknown")


def hand_char(s: Column) -> Column:
    return F.when(F.lower(s) == "left", "L").when(F.lower(s) == "right", "R").when(F.lower(s) == "mixed", "M").otherwise("")


def hand_of(c: Column) -> Column:
    return F.when(F.upper(c) == "L", "left").when(F.upper(c) == "R", "right").when(F.upper(c) == "M", "mixed").otherwise("unknown")


def plain_unit(s: Column) -> Column:
    """A unit that begins with a micro sign begins with u."""
    return F.regexp_replace(s, "^µ", "u")


def plain_unit_bytes(raw: Column) -> Column:
    """Unit of an old file, from its bytes: a leading B5, the micro sign of one-byte code pages, is u."""
    rest = F.substring(raw, 2, F.octet_length(raw))
    return F.when(F.hex(F.substring(raw, 1, 1)) == "B5", F.concat(F.lit("u"), F.decode(rest, "UTF-8"))).otherwise(F.decode(raw, "UTF-8"))


def electrode_field(line: Column, mark: str) -> Column:
    """Value of an optional field such as REF: in a line of the channel table; empty if none."""
    return first_bytes(F.regexp_extract(line, rf"\s{mark}(\S+)", 1), STATUS_BYTES)


def narrowed(x: Column, kind: str) -> Column:
    """A number as a narrower type; null where it doesn't fit."""
    return x.try_cast(kind)
