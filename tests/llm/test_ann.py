import numpy as np

from tracelake.llm import ann
from tracelake.llm.queries import QUERIES


def brute(ids, x, query, k=10):
    ok = [i for i in range(len(ids)) if ids[i] != ids[query]]
    d = np.sqrt(((x[ok] - x[query]) ** 2).sum(axis=1))
    order = sorted(zip(d.tolist(), (ids[i] for i in ok), strict=True))[:k]
    return [(v, s) for s, v in order]


def by_query(rows):
    out = {}
    for r in rows:
        out.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    return {q: [(v, s) for _, v, s in sorted(own)] for q, own in out.items()}


def test_recall(spark):
    for sf in ("/root/testdata/sf0.001", "/root/testdata/sf0.1"):
        rows = spark.read.parquet(f"{sf}/embeddings.parquet").orderBy("vec_id").collect()
        ids, x = [r["vec_id"] for r in rows], np.array([r["embedding"] for r in rows], dtype=np.float64)
        got = by_query(QUERIES["op7_nearest"](spark, sf).collect())
        found = []
        for q in [i for i in ids if i % 100 == 0]:
            want = brute(ids, x, ids.index(q))
            found.append(len({v for v, _ in want} & {v for v, _ in got[q]}) / 10)
            for v, s in got[q]:
                assert abs(s - np.sqrt(((x[ids.index(v)] - x[ids.index(q)]) ** 2).sum())) < 1e-12
        assert np.mean(found) >= 0.9


def test_large_forest_on_clusters(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(40, 16)) * 10
    x = (centres[rng.integers(0, 40, 4000)] + rng.normal(size=(4000, 16))).astype(np.float32).astype(np.float64)
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = by_query(ann.nearest(df, lambda v: v % 200 == 0, leaf_target=64).collect())
    found = [len({v for v, _ in brute(list(range(4000)), x, q)} & {v for v, _ in got[q]}) / 10 for q in range(0, 4000, 200)]
    assert np.mean(found) >= 0.9


def test_copies_ties_and_bad_vectors(spark, monkeypatch):
    monkeypatch.setattr(ann, "LEAF_ROWS", 7)
    same = [1.0, 2.0, 3.0]
    rows = [(k, same) for k in range(0, 400)] + [(1000 + k, [1.0, 2.0, 3.0 + k / 10]) for k in range(1, 30)]
    rows += [(5000, None), (5100, [0.0, 0.0, 0.0]), (5200, [float("nan"), 1.0, 1.0]), (5300, [1.0, float("inf"), 1.0]), (5400, [1.0, None, 1.0]), (5500, []), (5600, [1.0, 2.0]), (None, same), (3, same)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumnRenamed("embedding", "vector")
    got = by_query(ann.nearest(df, lambda v: v % 100 == 0, vector="vector", leaf_target=16).collect())
    assert set(got) == {0, 100, 200, 300}
    assert got[0] == [(k, 0.0) for k in range(1, 11)]
    assert got[300] == [(k, 0.0) for k in range(10)]


def test_few_and_none(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 1.0])], "vec_id long, embedding array<double>")
    got = by_query(ann.nearest(df, lambda v: v == 0).collect())
    assert got == {0: [(2, 1.0), (1, 2**0.5)]}
    assert ann.nearest(df.limit(0), lambda v: v == 0).count() == 0


def test_every_query_is_filled(spark):
    for sf in ("/root/testdata/sf0.001", "/root/testdata/sf0.1"):
        ids = [r["vec_id"] for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id").collect()]
        got = by_query(QUERIES["op7_nearest"](spark, sf).collect())
        assert {q: len(own) for q, own in got.items()} == {q: 10 for q in ids if q % 100 == 0}


def test_nearest_of_the_reached(spark, monkeypatch):
    """With few leaves reached the result is the ten nearest rows in them."""
    kept = []
    monkeypatch.setattr(ann.Forest, "calibrate", lambda self, k, recall: (kept.append(self), setattr(self, "share", 0.2)))
    x = np.random.default_rng(4).normal(size=(900, 12))
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = by_query(ann.nearest(df, lambda v: v % 50 == 0, leaf_target=64).collect())
    own = kept[0].leaves(x)
    for q in range(0, 900, 50):
        reached = kept[0].reached(kept[0].project(x[q : q + 1])[0], 0.2 * len(x))
        there = sorted({i for t, leaf in reached for i in np.flatnonzero(own[:, t] == leaf)} - {q})
        d = np.sqrt(((x[there] - x[q]) ** 2).sum(axis=1))
        assert len(there) >= 10 and [v for v, _ in got[q]] == [there[j] for j in np.lexsort((there, d))[:10]]


def test_exact_and_lengths(spark):
    rng = np.random.default_rng(8)
    x, y = rng.normal(size=(300, 6)), rng.normal(size=(40, 3))
    rows = [(k, v.tolist()) for k, v in enumerate(x)] + [(1000 + k, v.tolist()) for k, v in enumerate(y)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = by_query(ann.nearest(df, lambda v: v % 100 == 0, exact=True).collect())
    assert set(got) == {0, 100, 200, 1000}
    for q in (0, 100, 200):
        assert [v for v, _ in got[q]] == [v for v, _ in brute(list(range(300)), x, q)]
    assert [v for v, _ in got[1000]] == [v for v, _ in brute(list(range(1000, 1040)), y, 0)]


def test_clusters_need_a_small_share(monkeypatch):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(40, 16)) * 10
    x = centres[rng.integers(0, 40, 4000)] + rng.normal(size=(4000, 16))
    forest = ann.Forest(x, ann.TREES, 6)
    forest.calibrate(10, ann.RECALL)
    assert forest.share <= 0.2
