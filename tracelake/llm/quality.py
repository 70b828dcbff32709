"""Supervised subword embeddings for document quality.

A document is the average of learned vectors of its hashed n-grams: characters (orders 3 and 4),
words (1 and 2) and word structure (whether a word repeats the one before, and whether a 3-word
stretch came before in the same document).  The three kinds are averaged on their own and added, a
linear layer and a softmax follow.  Vectors and layer are trained together by stochastic gradient
descent in numpy, on a bounded sample of labelled rows.

To score, vectors and layer collapse to one number a bucket (the difference of both classes'
logits), which is what executors get: 2^18 floats, whatever the size of the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.llm.common import each, tidy

BITS = 18
BUCKETS = 1 << BITS
DIM = 8
EPOCHS = 4
RATE = 0.3
#: The fit reads at most this many labelled documents (those with the smallest hash of the id).
FIT_DOCS = 4000
THRESHOLD = 0.7
#: Longer texts are read in slices of this many characters; n-grams don't cross them.
SLICE = 1 << 20
#: Characters of the texts that are read together.
BATCH = 1 << 18

_M1, _M2 = np.uint32(0x9E3779B1), np.uint32(0x85EBCA77)
_STRUCTURE = 4  # the first buckets: word repeats, does not, 3-word stretch was seen, was not


def _mix(x: np.ndarray) -> np.ndarray:
    x = x * _M1
    x ^= x >> np.uint32(15)
    x *= _M2
    return x


def _bucket(x: np.ndarray, kind: int) -> np.ndarray:
    x = _mix(x + np.uint32(kind))
    x >>= np.uint32(32 - BITS)
    return np.maximum(x, np.uint32(_STRUCTURE))


class Batch:
    """N-grams of several texts (or slices): for each kind, arrays of (bucket, whether it counts)
    with the text's first place in ``edges``; and counts of the structure buckets."""

    def __init__(self, texts: list[str]):
        n = len(texts)
        a = np.frombuffer(("\0" + "\0".join(x.replace("\0", " ") for x in texts) + "\0").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        real = a != 0
        first = np.flatnonzero(~real)[:-1]  # each text begins after its mark
        space = (a == 32) | ((a >= 9) & (a <= 13))
        b = np.where((a >= 48) & (a <= 57), np.uint32(48), a)
        b[space] = 32
        mixed = _mix(b)
        three = mixed[:-2] + mixed[1:-1] * np.uint32(3) + mixed[2:] * np.uint32(9)
        in_three = real[:-2] & real[1:-1] & real[2:]
        four = three[:-1] + mixed[3:] * np.uint32(27)
        self.grams = [[(_bucket(three, 101), in_three, first), (_bucket(four, 102), in_three[:-1] & real[3:], first)]]
        inside = real & ~space
        starts = np.flatnonzero(inside[1:] & ~inside[:-1]) + 1
        self.structure = np.zeros((n, _STRUCTURE), np.int64)
        if not len(starts):
            return
        at = np.arange(len(a), dtype=np.uint32)
        at[starts[0] :] -= np.repeat(starts, np.diff(np.append(starts, len(a)))).astype(np.uint32)
        spelt = _mix(mixed + at * np.uint32(0x27D4EB2F))
        spelt[~inside] = 0
        word = np.add.reduceat(spelt, starts, dtype=np.uint32)
        owner = np.searchsorted(first, starts) - 1
        edges = np.searchsorted(owner, np.arange(n))
        same = owner[1:] == owner[:-1]
        self.grams.append([(_bucket(word, 201), np.ones(len(word), bool), edges), (_bucket(word[:-1] * np.uint32(5) + word[1:], 202), same, edges)])
        again = same & (word[1:] == word[:-1])
        self.structure[:, 0] = np.bincount(owner[1:][again], minlength=n)
        self.structure[:, 1] = np.bincount(owner[1:][same], minlength=n) - self.structure[:, 0]
        in_row = owner[2:] == owner[:-2]
        key = word[:-2] * np.uint32(25) + word[1:-1] * np.uint32(5) + word[2:]
        key = np.sort((owner[2:][in_row].astype(np.uint64) << np.uint64(32)) | _mix(key[in_row]))
        new = key[np.concatenate(([True], key[1:] != key[:-1]))] if len(key) else key
        self.structure[:, 3] = np.bincount((new >> np.uint64(32)).astype(np.int64), minlength=n)
        self.structure[:, 2] = np.bincount(owner[2:][in_row], minlength=n) - self.structure[:, 3]

    def totals(self, table: np.ndarray) -> np.ndarray:
        """By text: sum of the table's numbers and count, for each of the three kinds."""
        n = len(self.structure)
        out = np.zeros((n, 6))
        for k, grams in enumerate(self.grams):
            for bucket, ok, edges in grams:
                if len(bucket):
                    full = np.flatnonzero(edges < np.append(edges[1:], len(bucket)))
                    full = full[edges[full] < len(bucket)]
                    values = table[bucket]
                    values[~ok] = 0
                    out[full, 2 * k] += np.add.reduceat(values, edges[full], dtype=np.float64)
                    out[full, 2 * k + 1] += np.add.reduceat(ok, edges[full], dtype=np.int64)
        out[:, 4] = self.structure @ table[:_STRUCTURE].astype(np.float64)
        out[:, 5] = self.structure.sum(axis=1)
        return out

    def rows(self, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """Buckets of one text with their counts, for each kind."""
        out = []
        for grams in self.grams:
            own = []
            for bucket, ok, edges in grams:
                a, b = edges[k], edges[k + 1] if k + 1 < len(edges) else len(bucket)
                own.append(bucket[a:b][ok[a:b]])
            out.append(np.unique(np.concatenate(own), return_counts=True))
        out += [(np.empty(0, np.int64), np.empty(0, np.int64))] * (2 - len(out))
        own = self.structure[k]
        return [*out, (np.flatnonzero(own), own[own > 0])]


def weighted(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of a text with their weights, 1 in all for each kind: counts of all slices, as they
    are added up for the score."""
    slices = [Batch([x]).rows(0) for _, x in _slices([text])]
    at, by = [np.empty(0, np.int64)], [np.empty(0)]
    for kind in zip(*slices, strict=True):
        u, place = np.unique(np.concatenate([a for a, _ in kind]), return_inverse=True)
        c = np.bincount(place, np.concatenate([n for _, n in kind]), len(u))
        at.append(u)
        by.append(c / max(1, c.sum()))
    return np.concatenate(at).astype(np.int32), np.concatenate(by).astype(np.float32)


def _slices(texts: list[str | None]) -> list[tuple[int, str]]:
    return [(k, x[i : i + SLICE]) for k, x in enumerate(x or "" for x in texts) for i in range(0, len(x), SLICE)]


def _batches(parts: list[tuple[int, str]]) -> list[list[tuple[int, str]]]:
    out: list[list[tuple[int, str]]] = []
    size = BATCH
    for p in parts:
        if size + len(p[1]) > BATCH:
            out.append([])
            size = 0
        out[-1].append(p)
        size += len(p[1])
    return out


class SubwordModel:
    """What a fit leaves: one logit a bucket, and the bias."""

    def __init__(self, table: np.ndarray, bias: float):
        self.table, self.bias = table, bias

    def scores(self, texts: list[str | None]) -> np.ndarray:
        sums = np.zeros((len(texts), 6))
        for own in _batches(_slices(texts)):
            np.add.at(sums, [k for k, _ in own], Batch([x for _, x in own]).totals(self.table))
        z = self.bias + (sums[:, ::2] / np.maximum(1, sums[:, 1::2])).sum(axis=1)
        return 1 / (1 + np.exp(-np.clip(z, -60, 60)))

    @staticmethod
    def fit(texts: list[str | None], labels: list[int], dim: int = DIM, epochs: int = EPOCHS, rate: float = RATE, seed: int = 1) -> SubwordModel:
        """Adagrad steps, one document each.  Without rows of both labels the score is constant."""
        n = len(labels)
        share = (sum(labels) + 1) / (n + 2)
        if len(set(labels)) < 2:
            return SubwordModel(np.zeros(BUCKETS, np.float32), float(np.log(share / (1 - share))))
        rng = np.random.default_rng(seed)
        docs = [weighted(x) for x in texts]
        vectors = rng.uniform(-1 / dim, 1 / dim, (BUCKETS, dim)).astype(np.float32)
        squares = np.full(BUCKETS, 1e-6, np.float32)
        layer = rng.uniform(-0.5, 0.5, (dim, 2)).astype(np.float32)
        layer_squares = np.full((dim, 2), 1e-2, np.float32)
        bias = np.array([0.0, np.log(share / (1 - share))], np.float32)
        for epoch in range(epochs):
            step = rate * (1 - epoch / epochs)
            for k in rng.permutation(n):
                at, by = docs[k]
                own = vectors[at]
                h = by @ own
                z = h @ layer + bias
                p = np.exp(z - z.max())
                p /= p.sum()
                p[labels[k]] -= 1
                back = layer @ p
                grad = np.outer(h, p)
                layer_squares += grad * grad
                layer -= step * grad / np.sqrt(layer_squares)
                bias -= 0.1 * step * p
                squares[at] += by * by * float(back @ back) / dim
                vectors[at] = own - step * (by / np.sqrt(squares[at]))[:, None] * back
        return SubwordModel((vectors @ (layer[:, 1] - layer[:, 0])).astype(np.float32), float(bias[1] - bias[0]))


def fit_quality(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "quality", fit_docs: int = FIT_DOCS) -> SubwordModel:
    """Train on a bounded sample: the ``fit_docs`` labelled ids with the smallest hash.  An id with
    several labels counts as 1 if most of them are 1; null ids and labels are left out, as are ids
    without a document; of documents with the same id all are read, up to the bound."""
    ids = labels.select(F.col(key).alias("key"), F.col(label).alias("label")).where("key is not null and label is not null")
    ids = ids.groupBy("key").agg((F.avg("label") > 0.5).cast("int").alias("label"))
    ids = ids.orderBy(F.xxhash64("key", F.lit(23)), "key").limit(fit_docs).collect()
    if not ids:
        return SubwordModel.fit([], [])
    spark = docs.sparkSession
    by_id = spark.createDataFrame([(r["key"], r["label"]) for r in ids], "key long, label int")
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).join(F.broadcast(by_id), "key").select("label", "text").limit(fit_docs).collect()
    model = SubwordModel.fit([r["text"] for r in rows], [r["label"] for r in rows])
    del rows, ids
    tidy()
    return model


def score_quality(df: DataFrame, model: SubwordModel, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``df`` with ``score`` (0 to 1) and ``predicted`` (1 if the score reaches ``threshold``).

    Null and empty texts get the score of a document without n-grams; repeated rows get equal
    scores; columns of those names are replaced.
    """
    sent = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        return each(lambda texts: pd.Series(sent.value.scores(texts.tolist()), dtype="float64"), batches)

    return df.withColumn("score", scored(F.col(text))).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
