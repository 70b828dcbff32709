"""The catalogue of the registered licence scan: complete texts, notices and SPDX identifiers.

Texts lie in ``licence_texts``, named by identifier.  Each counts with and without its title, and
with and without what stands behind its terms.  Notices are the usual sentences around each name
of a licence.  Not here, for want of a copy: the legal codes of CC BY, BY-SA, BY-NC, BY-ND and
their mixtures, AGPL, EPL, EUPL, BSL; their notices and identifiers are.
"""

from __future__ import annotations

import re
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from tracelake.llm.licences import KNOWN

TEXTS = Path(__file__).resolve().parent / "licence_texts"

_TITLES = {"MIT": ("MIT License", "The MIT License", "The MIT License (MIT)"), "ISC": ("ISC License", "The ISC License", "ISC License (ISC)")}
_TITLED = re.compile(r"\s*(?:.*\b(?:licen[cs]e|universal|legal code|version)\b.*\n(?:[ \t]*[=-]+[ \t]*\n|[ \t]*version.*\n|[ \t]*https?:.*\n|[ \t]*\n)*)+", re.I)
_END = re.compile(r"END OF TERMS AND CONDITIONS")

#: Names of licences as notices have them, without "License" at the end.
NAMES = {
    "Apache-2.0": ("Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0", "Apache-2.0", "Apache Software License 2.0"),
    "MIT": ("MIT", "Expat", "MIT/Expat"),
    "ISC": ("ISC",),
    "0BSD": ("0BSD", "BSD Zero Clause", "Zero-Clause BSD"),
    "BSD-2-Clause": ("BSD 2-Clause", "2-Clause BSD", "Simplified BSD", "BSD-2-Clause"),
    "BSD-3-Clause": ("BSD 3-Clause", "3-Clause BSD", "New BSD", "Modified BSD", "Revised BSD", "BSD-3-Clause"),
    "Zlib": ("zlib",),
    "Unlicense": ("Unlicense",),
    "BSL-1.0": ("Boost Software License, Version 1.0", "Boost Software License 1.0", "BSL-1.0"),
    "MPL-1.1": ("Mozilla Public License, Version 1.1", "Mozilla Public License 1.1", "MPL 1.1"),
    "MPL-2.0": ("Mozilla Public License, Version 2.0", "Mozilla Public License, v. 2.0", "Mozilla Public License 2.0", "MPL 2.0"),
    "EPL-2.0": ("Eclipse Public License, Version 2.0", "Eclipse Public License 2.0", "Eclipse Public License v2.0", "EPL 2.0"),
    "EUPL-1.2": ("European Union Public Licence 1.2", "EUPL 1.2"),
    "Artistic-1.0-Perl": ("Artistic License 1.0",),
    "Artistic-2.0": ("Artistic License 2.0",),
    "CC0-1.0": ("CC0 1.0", "CC0 1.0 Universal", "Creative Commons CC0 1.0 Universal", "Creative Commons Zero v1.0 Universal"),
}
for _id, _name, _short, _versions in (
    ("GPL", "GNU General Public License", "GPL", ("1.0", "2.0", "3.0")),
    ("LGPL", "GNU Lesser General Public License", "LGPL", ("2.1", "3.0")),
    ("LGPL", "GNU Library General Public License", "LGPL", ("2.0",)),
    ("AGPL", "GNU Affero General Public License", "AGPL", ("3.0",)),
    ("GFDL", "GNU Free Documentation License", "GFDL", ("1.2", "1.3")),
):
    for _v in _versions:
        _numbers = [_v, _v.removesuffix(".0")] if _v.endswith(".0") else [_v]
        _own = [x for n in _numbers for x in (f"{_name}, version {n}", f"{_name} v{n}", f"{_name} {n}", f"{_short} v{n}", f"{_short}v{n}", f"{_short} {n}", f"GNU {_short}v{n}")]
        NAMES[f"{_id}-{_v}"] = tuple(_own)
        NAMES[f"{_id}-{_v}-or-later"] = tuple(f"{x}{later}" for x in _own if not (len(_numbers) > 1 and x.endswith(_v)) and "v" in x for later in (" or later", ", or (at your option) any later version"))
_CC = {"BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-NC": "Attribution-NonCommercial", "BY-ND": "Attribution-NoDerivatives", "BY-NC-SA": "Attribution-NonCommercial-ShareAlike", "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives"}
for _id, _name in _CC.items():
    for _v, _place in (("4.0", "International"), ("3.0", "Unported"), ("2.5", "Generic"), ("2.0", "Generic"), ("1.0", "Generic")):
        _full = {_name, _name.replace("ShareAlike", "Share Alike"), _name.replace("NoDerivatives", "NoDerivs")}
        NAMES[f"CC-{_id}-{_v}"] = (f"CC {_id} {_v}", f"Creative Commons {_id} {_v}", *sorted(f"Creative Commons {x} {_v}{p}" for x in _full for p in ("", f" {_place}")))

_LEADS = (
    "Licensed under", "Released under", "Distributed under", "Available under", "Distributed under the terms of",
    *(f"This {thing} is licensed under" for thing in ("work", "project", "software", "program", "document")),
    "This software is released under", "This project is released under", "License:", "",
)
#: Names that are words of their own too: they aren't a notice by themselves.
_BARE = frozenset({"MIT", "ISC", "Expat", "zlib"})


def notices(license_id: str) -> set[str]:
    """The usual sentences that name a licence, and its SPDX line."""
    out = set()
    for name in NAMES[license_id]:
        forms = [name] if "licen" in name.lower() else [name, f"{name} License"]
        for form in forms:
            for lead in _LEADS:
                if not lead:
                    out |= {form} - _BARE
                    continue
                out.add(f"{lead} {form}")
                if not lead.endswith(":"):
                    out.add(f"{lead} the {form}")
                    if "Creative" in form and lead.endswith("licensed under"):
                        out.add(f"{lead} a {form}")
    return out


def spdx(license_id: str) -> set[str]:
    told = {license_id}
    if re.match(r"A?L?GPL|GFDL", license_id) and not license_id.endswith("-or-later"):
        told.add(f"{license_id}-only")
    return {f"SPDX-License-Identifier: {x}" for x in told}


def texts(license_id: str, text: str) -> set[str]:
    """A complete text, with and without title, and with and without what follows its terms."""
    whole = {text}
    end = _END.search(text)
    if end:
        whole |= {text[: end.end()], text[: end.start()]}
    for x in [*whole]:
        title = _TITLED.match(x)
        if title and title.end() < len(x) // 2:
            whole.add(x[title.end() :])
    return whole


def rows() -> list[tuple[str, str]]:
    """(license_id, text); first those of ``KNOWN``."""
    out = dict.fromkeys(KNOWN)
    for license_id, text in KNOWN:
        if license_id in _TITLES and len(text) > 300:
            out |= dict.fromkeys((license_id, f"{title}\n\n{text}") for title in _TITLES[license_id])
    for path in sorted(TEXTS.glob("*.txt")):
        out |= dict.fromkeys((path.stem, x) for x in sorted(texts(path.stem, path.read_text("utf-8"))))
    for license_id in NAMES:
        out |= dict.fromkeys((license_id, x) for x in sorted(notices(license_id) | spdx(license_id)))
    # signs are blanks to the scan: sentences that differ only in them are one
    return [*{(k, re.sub(r"[^\w\n]+", " ", t.lower()) if len(t) < 200 else t): (k, t) for k, t in reversed(out)}.values()][::-1]


def table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(rows(), "license_id string, text string")
