import random
import re
from collections import Counter

import numpy as np
import pytest

from tracelake.llm import jaccard
from tracelake.llm.components import components
from tracelake.llm.queries import QUERIES


def brute(rows, n, percent):
    sets = []
    for i, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets.append((i, {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())))
    up = {i: i for i, _ in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    where = {}
    for k, (i, own) in enumerate(sets):
        met = Counter(j for g in own for j in where.get(g, ()))
        for j, common in met.items():
            if 100 * common >= percent * (len(own) + len(sets[j][1]) - common):
                a, b = sorted((root(i), root(sets[j][0])))
                up[b] = a
        for g in own:
            where.setdefault(g, []).append(k)
    return sorted((i, len(s), root(i)) for i, s in sets)


def families(seed, count=45):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(2000)]
    passage = [rng.choice(vocab) for _ in range(40)]
    rows = []
    for _ in range(count):
        base = [rng.choice(vocab) for _ in range(rng.choice([1, 2, 3, 5, 9, 10, 11, 15, 30, 80, 250]))]
        for _ in range(rng.choice([1, 2, 5, 20])):
            w = list(base)
            for _ in range(rng.randint(0, max(1, len(w) // 20))):
                k = rng.randrange(len(w))
                w[k : k + rng.randint(0, 1)] = [rng.choice(vocab)]
            if rng.random() < 0.2:
                w += passage
            rows.append((len(rows), " ".join(w)))
    return rows + [(len(rows), None), (len(rows) + 1, ""), (len(rows) + 2, " \n")]


@pytest.mark.parametrize("n,percent,small", [(3, 90, False), (5, 80, True), (2, 50, True)])
def test_against_brute_force(spark, monkeypatch, n, percent, small):
    rows = families(n)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    monkeypatch.setattr(jaccard, "BAND_SAMPLE", 2)
    monkeypatch.setattr(jaccard, "HOT_BANDS", 10**9)
    more = {"tile_rows": 4, "tile_grams": 300, "hot_band": 3} if small else {}
    got = jaccard.near_duplicates(df, n=n, percent=percent, **more)
    assert sorted(tuple(r) for r in got.collect()) == brute(rows, n, percent)


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(tuple(r) for r in QUERIES["op10_jaccard"](spark, sf).collect()) == brute(rows, 3, 90)


def test_linked_sets_share_a_band():
    rng = np.random.default_rng(1)
    for _ in range(400):
        percent = int(rng.choice([50, 80, 90]))
        a = np.unique(rng.integers(0, 1 << 63, rng.integers(1, 120)).astype(np.uint64))
        gone = int(rng.integers(0, max(1, len(a) // 4) + 1))
        b = np.unique(np.concatenate((a[gone:], rng.integers(0, 1 << 63, rng.integers(0, max(1, len(a) // 5) + 1)).astype(np.uint64))))
        common = len(np.intersect1d(a, b))
        if len(b) and not np.array_equal(a, b) and 100 * common >= percent * (len(a) + len(b) - common):
            assert set(jaccard.bands(a, percent)) & set(jaccard.bands(b, percent))


def test_overlaps():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 300, rng.integers(1, 60)).astype(np.uint64)) for _ in range(40)]
    want = np.array([[len(np.intersect1d(x, y)) for y in sets] for x in sets])
    for few in (0, 3, 24, 100):
        assert np.array_equal(jaccard.overlaps(sets, few_rows=few, columns=7), want)
        assert np.array_equal(jaccard.overlaps(sets[:15], sets[15:], few_rows=few), want[:15, 15:])


def test_shingles():
    assert len(jaccard.shingles("A b\tc a B c", 3)) == 3  # "a b c" twice
    assert len(jaccard.shingles("one two", 3)) == 1 and len(jaccard.shingles("one", 3)) == 1
    assert np.array_equal(jaccard.shingles("Äb C d", 3), jaccard.shingles("  Äb\x0bc\rd\n", 3))
    assert len(jaccard.shingles("x" * 500 + " y z", 3)) == 1
    assert not len(jaccard.shingles(None, 3)) and not len(jaccard.shingles(" \x0c", 3))


def test_edges(spark):
    text = "a b c d e f g h i j k l m n o p"
    rows = [(7, text, 1), (3, text, 1), (3, text, 1), (None, text, 1), (9, None, 1), (8, "x", 1), (5, "x", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, c int")
    got = sorted((tuple(r) for r in jaccard.near_duplicates(df).collect()), key=str)
    assert got == sorted([(7, 12, 3), (3, 12, 3), (3, 12, 3), (None, 12, None), (9, 0, 9), (8, 1, 5), (5, 1, 5)], key=str)
    kept = jaccard.deduplicate(df)
    assert kept.columns == df.columns
    assert sorted((tuple(r)[0] for r in kept.collect()), key=str) == sorted([3, None, 9, 5], key=str)
    assert jaccard.near_duplicates(df.limit(0)).count() == 0 and jaccard.deduplicate(df.limit(0)).count() == 0


def test_components(spark):
    rng = random.Random(5)
    edges = [(k, k + 1) for k in range(200)] + [(1000, 1000 + k) for k in range(100)] + [(rng.randrange(2000, 2300), rng.randrange(2000, 2300)) for _ in range(150)] + [(5, 5)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = sorted((root(a), root(b)))
        up[b] = a
    assert got == {x: root(x) for x in up if root(x) != x}
