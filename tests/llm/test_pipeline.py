import zlib

import corpus_pipeline
from tests.llm.test_decontaminate import brute as contaminated
from tests.llm.test_jaccard import brute as components
from tests.llm.test_packing import check as packed
from tests.llm.test_secrets import brute as secret_spans
from tracelake.llm.common import cut

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality", "near_duplicates", "decontamination", "secrets", "packing"]
    columns = docs.columns

    good = cut(stages["quality"](spark, docs, SF))
    assert good.columns == columns
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = {r["doc_id"] for r in good.collect()}
    clean = [k for k, q in labels.items() if q == 1]
    assert sum(k in kept for k in clean) / len(clean) > 0.95

    one = cut(stages["near_duplicates"](spark, good, SF))
    assert one.columns == columns
    want = {i for i, _, root in components([(r["doc_id"], r["text"]) for r in good.collect()], 5, 80) if i == root}
    assert {r["doc_id"] for r in one.collect()} == want

    pure = cut(stages["decontamination"](spark, one, SF))
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    before = {r["doc_id"]: r for r in one.collect()}
    after = {r["doc_id"]: r for r in pure.collect()}
    for k, r in before.items():
        n, hit, _ = contaminated(r["text"], items)
        if not hit:
            assert after[k] == r
        elif k in after:
            assert contaminated(after[k]["text"], items)[1] == 0
            assert after[k]["n_chars"] == len(after[k]["text"])
        else:
            assert hit > decontamination_limit() * n

    safe = cut(stages["secrets"](spark, pure, SF))
    for r in safe.collect():
        old = after[r["doc_id"]]
        assert not secret_spans(r["text"])
        if not secret_spans(old["text"]) and "[redacted]" not in r["text"]:
            assert r == old

    rows = stages["packing"](spark, safe, SF).collect()
    packed(rows, [(r["doc_id"], r["text"]) for r in safe.collect()])


def decontamination_limit():
    from tracelake.llm.decontaminate import DROP_COVERAGE

    return DROP_COVERAGE


def test_run_is_the_stages(spark):
    got = corpus_pipeline.run(spark, SF)
    assert got.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    assert got.count() > 0 and corpus_pipeline.ORACLE_SQL is None


def test_odd_rows(spark):
    rows = [(1, None, "en", 0, 9), (2, "", "en", 0, 9), (None, "some text here", "en", 14, 9), (3, "some text here", None, 14, 9), (3, "some text here", None, 14, 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, n_chars long, score int")
    for name, stage in corpus_pipeline.STAGES[1:4]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        assert out.count() == (4 if name == "near_duplicates" else 5)
        assert stage(spark, docs.limit(0), SF).count() == 0
    assert corpus_pipeline.STAGES[0][1](spark, docs, SF).columns == docs.columns
    assert corpus_pipeline.STAGES[4][1](spark, docs, SF).count() == 5
    assert zlib.crc32(b"3") % 4 >= 0
