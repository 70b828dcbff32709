from tracelake.llm import licences

MIT = next(t for k, t in licences.KNOWN if k == "MIT" and len(t) > 500)


def test_renderings(spark):
    wrapped = "Copyright (c) 2020 Somebody <me@example.com>\nAll rights reserved.\n\n" + MIT.replace(". ", ".\n\n * ").replace("sublicense", "sub-license").upper()
    rows = [
        (1, wrapped), (2, MIT + " And more."), (3, "text\n  Released under the M.I.T. License!\nReleased under the MIT Licence."), (4, None), (5, ""), (6, "© 2001 me"),
        (None, "SPDX-License-Identifier: MIT"), (1, wrapped), (7, "Copyright notice and this permission notice"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as digest", "'x' as license_id", "0 as line_no")
    got = licences.scan(df).collect()
    whole = [(r["doc_id"], r["license_id"]) for r in got if r["line_no"] == 0]
    assert sorted(whole, key=str) == sorted([(1, "MIT"), (1, "MIT"), (2, None), (3, None), (4, None), (5, None), (6, None), (7, None), (None, "MIT")], key=str)
    assert [(r["line_no"], r["license_id"]) for r in got if r["doc_id"] == 3 and r["line_no"]] == [(3, "MIT")]
    assert licences.scan(df.limit(0)).count() == 0


def test_own_catalogue(spark):
    known = spark.createDataFrame([("B", "Some terms."), ("A", "SOME  terms"), ("C", None), (None, "x"), ("E", "!!")], "license_id string, text string")
    df = spark.createDataFrame([(1, "some terms"), (2, "other"), (3, "...")], "doc_id long, text string")
    got = {r["doc_id"]: r["license_id"] for r in licences.scan(df, known).collect() if r["line_no"] == 0}
    assert got == {1: "A", 2: None, 3: None}


def test_no_python_in_the_plan(spark):
    df = spark.createDataFrame([(1, "x")], "doc_id long, text string")
    plan = licences.scan(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan


def test_spellings_are_whole_words(spark):
    pairs = [("While state is kept", "whileate is kept", False), ("Licence licence, LICENCES", "license license licenses", True), ("sub-licence the organisation's", "sublicense the organization s", True), ("programmed", "programd", False), ("Copyright Holders (whilst)", "copyright owners while", True)]
    rows = [(k, a, b) for k, (a, b, _) in enumerate(pairs)]
    df = spark.createDataFrame(rows, "k int, a string, b string").select("k", licences.digest("a").alias("a"), licences.digest("b").alias("b"))
    for r in df.collect():
        assert (r["a"] == r["b"]) == pairs[r["k"]][2], pairs[r["k"]]
        assert r["a"] == licences.plain_digest(pairs[r["k"]][0])


def test_digests_in_python_and_spark(spark):
    from tracelake.llm import known_licences

    table = known_licences.table(spark)
    got = {(r["license_id"], r["text"]): r["d"] for r in table.select("*", licences.digest("text").alias("d")).collect()}
    assert len(got) > 1000 and all(licences.plain_digest(t) == d for (_, t), d in got.items())
