import zlib

import numpy as np
import pytest

from tracelake.llm import langid
from tracelake.llm.queries import QUERIES


def brute_counts(text, order):
    words = "".join(c if c.isalpha() else " " for c in text.lower()).split()
    out = {}
    for w in words:
        p = f" {w} "
        for n in range(1, order + 1):
            for i in range(len(p) - n + 1):
                g = p[i : i + n]
                if g != " ":
                    out[g] = out.get(g, 0) + 1
    return out


def spelt(key, order):
    chars = []
    while key:
        chars.append(key & ((1 << 21) - 1))
        key >>= 21
    return chars[::-1]


@pytest.mark.parametrize("text", ["", "a", "Hello, World! hello", "É l'été 1999 ça", "x" * 50, "123 ---", "ab ab\nab"])
def test_counts(text):
    keys, counts = langid.ngram_counts(text)
    brute = brute_counts(text, 3)
    assert int(counts.sum()) == sum(brute.values()) and len(keys) == len(brute)
    assert sorted(counts.tolist()) == sorted(brute.values())


def test_long_texts_in_slices(monkeypatch):
    text = "The quick brown fox, jumps over the lazy dog. " * 40
    whole = langid.ngram_counts(text)
    monkeypatch.setattr(langid, "SLICE", 97)
    part = langid.ngram_counts(text)
    assert np.array_equal(whole[0], part[0]) and np.array_equal(whole[1], part[1])


def test_out_of_place():
    model = langid.RankClassifier({"a": [1, 2, 3], "b": [3, 2, 1]}, size=3)
    assert model.langs == ["a", "b"]
    profiles = {"x": langid.ranked(*langid.ngram_counts("aaa bbb aaa"), 400).tolist(), "y": langid.ranked(*langid.ngram_counts("zzz yyy zzz"), 400).tolist()}
    model = langid.RankClassifier(profiles)
    assert model.predict("aaa")[0] == "x" and model.predict("zzz yyy")[0] == "y"
    assert model.predict(None) == ("und", 0.0) and model.predict("12 !") == ("und", 0.0)
    assert 0 <= model.predict("aaa zzz")[1] <= 1
    assert langid.RankClassifier({}).predict("abc") == ("und", 0.0)
    assert langid.RankClassifier({"x": profiles["x"]}).predict("aaa") == ("x", 1.0)


def test_edge_rows(spark):
    rows = [(1, "aaa bbb", "x", 9), (2, "zzz yyy", "y", 9), (3, None, "x", 9), (None, "", None, 9), (1, "aaa bbb", "x", 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score int")
    profiles = langid.fit_profiles(df)
    got = langid.identify(df, profiles).collect()
    assert [r["lang_pred"] for r in got] == ["x", "y", "und", "und", "x"]
    assert all(isinstance(r["score"], float) for r in got)
    assert langid.fit_profiles(df.limit(0)) == {}
    assert langid.identify(df.limit(0), profiles).count() == 0


def test_held_out_accuracy(spark):
    got = QUERIES["op1_language_id"](spark, "/root/testdata/sf0.01")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    rows = got.join(docs, "doc_id").collect()
    assert len(rows) == 1000
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert sum(r["lang_pred"] == r["lang"] for r in held) / len(held) > 0.97
