import random

import numpy as np

from tests.llm.test_jaccard import brute, families
from tracelake.llm import jaccard


def test_linked_sets_share_fine_bands():
    rng = np.random.default_rng(4)
    seen = 0
    for _ in range(600):
        percent = int(rng.choice([50, 80, 90]))
        a = np.unique(rng.integers(0, 1 << 63, rng.integers(1, 150)).astype(np.uint64))
        gone = int(rng.integers(0, max(1, len(a) // 4) + 1))
        b = np.unique(np.concatenate((a[gone:], rng.integers(0, 1 << 63, rng.integers(0, max(1, len(a) // 5) + 1)).astype(np.uint64))))
        common = len(np.intersect1d(a, b))
        if len(b) and not np.array_equal(a, b) and 100 * common >= percent * (len(a) + len(b) - common):
            of_b = {k: (spare, set(x.tolist())) for k, spare, x in jaccard.fine_bands(b, percent)}
            shared = [(len(of_b[k][1] & set(x.tolist())), spare) for k, spare, x in jaccard.fine_bands(a, percent) if k in of_b]
            assert any(n >= 1 + spare for n, spare in shared)
            seen += 1
    assert seen > 50


def chain(count):
    """Texts that each have half of their words in common with the next one: none link."""
    rng = random.Random(3)
    parts = [[f"v{rng.randrange(10**6)}" for _ in range(30)] for _ in range(count + 1)]
    return [(k, " ".join(parts[k] + parts[k + 1])) for k in range(count)]


def test_chance_ties_go(spark):
    rows = chain(60) + [(100, " ".join(f"u{k}" for k in range(80))), (101, " ".join(f"u{k}" for k in range(1, 80)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    of = {i: jaccard._class_of(jaccard.shingles(x)) for i, x in rows}
    wide = spark.createDataFrame([(i, *of[i], i) for i, _ in rows], "c long, h1 long, h2 long, rep long")
    for pair_rows in (1, 16):
        got = {tuple(r) for r in jaccard._fine_ties(docs, wide, 5, 80, pair_rows).collect()}
        assert (101, 100) in got
    assert got == {(101, 100)}


def test_passes_lose_no_link(spark):
    rows = families(7)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = jaccard.near_duplicates(df.unionByName(df), n=3, percent=80, tile_rows=4, tile_grams=300, pass_grams=1)
    assert sorted({tuple(r) for r in got.collect()}) == brute(rows, 3, 80)
