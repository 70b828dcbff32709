import zlib

import numpy as np

from tracelake.llm import quality
from tracelake.llm.queries import QUERIES


def test_batches_don_t_matter(monkeypatch):
    rng = np.random.default_rng(0)
    model = quality.SubwordModel(rng.normal(size=quality.BUCKETS).astype(np.float32), 0.3)
    texts = ["", None, "a", "ab", "a b", "a a a b", "één twee drie vier " * 9, "x\0y z", " ", "12 34 56", "a b c a b c"] * 3
    one = [model.scores([x])[0] for x in texts]
    assert np.allclose(model.scores(texts), one, atol=1e-12)
    monkeypatch.setattr(quality, "BATCH", 1)
    assert np.allclose(model.scores(texts), one, atol=1e-12)
    assert model.scores([]).shape == (0,)


def test_structure_counts():
    s = quality.Batch(["a a b a a b", "x y z", "q"]).structure
    assert s.tolist() == [[2, 3, 1, 3], [0, 2, 0, 1], [0, 0, 0, 0]]


def test_rows_and_totals_agree():
    rng = np.random.default_rng(1)
    table = rng.normal(size=quality.BUCKETS).astype(np.float32)
    texts = ["some words, and some more words", "kurz", "a b"]
    sums = quality.Batch(texts).totals(table)
    z = (sums[:, ::2] / np.maximum(1, sums[:, 1::2])).sum(axis=1)
    for k, x in enumerate(texts):
        at, by = quality.weighted(x)
        assert abs(float(table[at] @ by) - z[k]) < 1e-4


def plain_score(model, text):
    """The score by its definition, one n-gram after the other."""
    m = (1 << 32) - 1

    def mix(x):
        x = x * 0x9E3779B1 & m
        x ^= x >> 15
        return x * 0x85EBCA77 & m

    value = lambda x, kind: float(model.table[max(4, mix((x + kind) & m) >> (32 - quality.BITS))])
    text = (text or "").replace("\0", " ")
    folded = [48 if c.isdigit() and c.isascii() else 32 if c in " \t\n\x0b\x0c\r" else ord(c) for c in text]
    letters = [mix(c) for c in folded]
    chars = [value(a + 3 * b + 9 * c, 101) for a, b, c in zip(letters, letters[1:], letters[2:])]
    chars += [value(a + 3 * b + 9 * c + 27 * d, 102) for a, b, c, d in zip(letters, letters[1:], letters[2:], letters[3:])]
    words, now = [], None
    for c, x in zip(folded, letters):
        if c == 32:
            now = None
            continue
        if now is None:
            words.append(0)
            now = 0
        words[-1] = (words[-1] + mix((x + now * 0x27D4EB2F) & m)) & m
        now += 1
    said = [value(w, 201) for w in words] + [value(a * 5 + b, 202) for a, b in zip(words, words[1:])]
    threes = list(zip(words, words[1:], words[2:]))
    order = [0 if a == b else 1 for a, b in zip(words, words[1:])] + [3 if t not in threes[:k] else 2 for k, t in enumerate(threes)]
    z = model.bias + sum(sum(x) / max(1, len(x)) for x in (chars, said, [float(model.table[k]) for k in order]))
    return 1 / (1 + np.exp(-z))


def test_scores_are_those_of_the_plain_definition():
    rng = np.random.default_rng(3)
    model = quality.SubwordModel(rng.normal(size=quality.BUCKETS).astype(np.float32), -0.2)
    texts = ["", None, "a", "ab cd", "one two two two one two", "é\t12 34\n é x\0y", "the cat and the cat and the dog " * 5]
    assert np.allclose(model.scores(texts), [plain_score(model, x) for x in texts], atol=1e-6)


def test_fit_weighs_long_texts_as_the_score_does(monkeypatch):
    rng = np.random.default_rng(4)
    model = quality.SubwordModel(rng.normal(size=quality.BUCKETS).astype(np.float32), 0.1)
    text = " ".join(f"w{k % 7}" for k in range(60))
    monkeypatch.setattr(quality, "SLICE", 50)
    at, by = quality.weighted(text)
    assert abs(1 / (1 + np.exp(-0.1 - float(model.table[at] @ by))) - model.scores([text])[0]) < 1e-5


def test_edges(spark):
    rows = [(1, "good words here", 5.0), (2, None, 5.0), (3, "", 5.0), (None, "x", 5.0), (1, "good words here", 5.0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, score double")
    none = spark.createDataFrame([], "doc_id long, quality int")
    model = quality.fit_quality(df, none)
    got = quality.score_quality(df, model).collect()
    assert {round(r["score"], 6) for r in got} == {0.5} and {r["predicted"] for r in got} == {0}
    labels = spark.createDataFrame([(1, 1), (1, 1), (1, 0), (2, None), (None, 1), (9, 0)], "doc_id long, quality int")
    model = quality.fit_quality(df, labels)
    got = quality.score_quality(df, model).collect()
    assert got[0]["score"] == got[4]["score"] > 0.5 and all(0 <= r["score"] <= 1 for r in got)
    assert quality.score_quality(df.limit(0), model).count() == 0


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    got = {r["doc_id"]: r for r in QUERIES["op6_quality"](spark, sf).collect()}
    labels = spark.read.parquet(f"{sf}/labels.parquet").collect()
    held = [r for r in labels if zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2]
    assert all(got[r["doc_id"]]["held_out"] for r in held)
    right = [got[r["doc_id"]]["predicted"] == r["quality"] for r in held]
    clean = [got[r["doc_id"]]["predicted"] for r in held if r["quality"] == 1]
    assert np.mean(right) > 0.98 and np.mean(clean) > 0.99
