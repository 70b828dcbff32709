import hashlib
import random
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from tracelake.llm import decontaminate as D
from tracelake.llm.queries import QUERIES

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(document, items, window=10):
    doc, hit, found = words(document), set(), set()
    for name, text in items:
        ws = words(text)
        if not ws:
            continue
        n = min(window, len(ws))
        own = {tuple(ws[i : i + n]) for i in range(len(ws) - n + 1)}
        for i in range(len(doc) - n + 1):
            if tuple(doc[i : i + n]) in own:
                hit.update(range(i, i + n))
                found.add(str(name))
    return len(doc), len(hit), sorted(found)


def matched(document, items, window=10):
    m = D.ItemMatcher([(str(k), D.words(t)) for k, t in items if D.words(t)], window)
    spans, found, _ = m.hits(D.words(document))
    return len(D.words(document)), sum(b - a for a, b in spans), sorted({m.items[k] for k in found})


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abc"), max_size=12), max_size=5), st.lists(st.sampled_from("abcd"), max_size=40), st.integers(1, 5))
def test_against_brute_force(items, document, window):
    named = [(k, " ".join(x)) for k, x in enumerate(items)]
    text = " ".join(document)
    assert matched(text, named, window) == brute(text, named, window)


def test_words():
    for text in ("It's ÄÖ x²  9", "", "A\x85B\xa0c d", "[a]`b`{c}~d\x7fe"):
        assert [w.decode() for w in D.words(text)] == words(text)
    assert D.words(None) == []


def test_shards_and_edges(spark):
    items = spark.createDataFrame([(1, "one two three four five six seven eight nine ten eleven"), (2, "short item"), (2, "short item"), (3, None), (4, "!!"), (None, "one two three")], "item_id long, text string")
    doc = "x One, two three four five six seven eight nine ten y short item z"
    rows = [(1, doc, "e"), (2, None, "e"), (3, "", "e"), (4, "short", "e"), (None, doc, "e"), (1, doc, "e")]
    df = spark.createDataFrame(rows, "doc_id long, text string, items string")
    for shard in (500_000, 3):
        got = D.contamination(df, items, shard_words=shard).collect()
        assert [(r["n_words"], r["n_hit"], r["items"]) for r in got] == [(15, 12, ["1", "2"]), (0, 0, []), (0, 0, []), (1, 0, []), (15, 12, ["1", "2"]), (15, 12, ["1", "2"])]
    assert D.contamination(df, items.limit(0)).where("n_hit > 0").count() == 0
    assert D.contamination(df.limit(0), items).count() == 0
    cleaned = D.contamination(df, items, remove=True, drop_coverage=0.9).collect()
    assert [r["text"] for r in cleaned] == ["x y z", None, "", "short", "x y z", "x y z"]
    assert D.contamination(df, items, remove=True, drop_coverage=0.5).count() == 3  # the others are little else


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    hits = 0
    for r in QUERIES["op2_decontamination"](spark, sf).collect():
        n, hit, found = brute(docs[r["doc_id"]], items)
        assert (r["n_words"], r["n_hit"], r["n_items"], r["contaminated"]) == (n, hit, len(found), hit > 0)
        assert r["items_sha256"] == hashlib.sha256(",".join(found).encode()).hexdigest()
        hits += hit > 0
    assert hits


def test_longer_random():
    rng = random.Random(4)
    vocab = [f"w{i}" for i in range(30)]
    items = [(k, " ".join(rng.choice(vocab) for _ in range(rng.choice([3, 9, 10, 11, 40])))) for k in range(20)]
    doc = []
    for _ in range(60):
        ws = words(items[rng.randrange(20)][1])
        a = rng.randrange(len(ws))
        doc += ws[a : a + rng.randint(1, 20)] + [rng.choice(vocab)]
    assert matched(" ".join(doc), items) == brute(" ".join(doc), items)
