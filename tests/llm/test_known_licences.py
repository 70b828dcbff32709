from tracelake.llm import known_licences, licences
from tracelake.llm.queries import QUERIES


def test_catalogue(spark):
    text = lambda name: (known_licences.TEXTS / f"{name}.txt").read_text("utf-8")
    mit = next(t for k, t in licences.KNOWN if k == "MIT" and len(t) > 500)
    rows = [
        (1, "Some words.\nLicensed under CC BY-NC 4.0.\nMore words."), (2, "MIT License\n\nCopyright (c) 2021 Somebody\n\n" + mit), (3, text("GPL-3.0")), (4, text("Apache-2.0").split("END OF TERMS")[0]),
        (5, text("BSD-3-Clause").replace("<year>, <owner>", "2001, Me")), (6, text("MPL-2.0").split("=\n", 1)[1]), (7, text("LGPL-2.1")), (8, "# SPDX-License-Identifier: LGPL-2.1-or-later"), (9, "A page about the MIT"),
        (10, "This work is licensed under the GNU General Public License, version 3."), (11, "ISC License\n\n" + next(t for k, t in licences.KNOWN if k == "ISC")),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {}
    for r in licences.scan(df, known_licences.table(spark)).collect():
        if r["license_id"]:
            got.setdefault(r["doc_id"], set()).add(r["license_id"])
    assert got == {1: {"CC-BY-NC-4.0"}, 2: {"MIT"}, 3: {"GPL-3.0"}, 4: {"Apache-2.0"}, 5: {"BSD-3-Clause"}, 6: {"MPL-2.0"}, 7: {"LGPL-2.1"}, 8: {"LGPL-2.1-or-later"}, 10: {"GPL-3.0"}, 11: {"ISC"}}
    assert len(known_licences.rows()) <= licences.BROADCAST_LICENCES


def test_query_finds_every_licence_line(spark):
    sf = "/root/testdata/sf0.01"
    lines = {r["doc_id"] for r in spark.read.parquet(f"{sf}/documents.parquet").where("lower(text) like '%licen%'").collect()}
    found = {r["doc_id"] for r in QUERIES["op9_licences"](spark, sf).where("license_id is not null").collect()}
    assert lines and lines <= found
