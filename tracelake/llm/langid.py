"""Language identification by rank-order n-gram profiles.

Each language has a profile: its ``profile_size`` most frequent character n-grams (orders 1 to
``max_order``, words padded with one blank), most frequent first.  A document is ranked the same
way and goes to the language with the smallest out-of-place distance: the sum over the
document's n-grams of the difference between both ranks, ``profile_size`` where the language
does not have the n-gram.

Distribution: counting is a map over whole documents followed by a sum per (language, n-gram),
with each task's counts combined before the shuffle; classification is a map with the profiles
(languages x profile_size rows) broadcast.  Neither groups by a data key such as the source.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracelake.llm.common import each, fresh, least_hashes

#: N-grams kept for a language and for a document.
PROFILE_SIZE = 400
MAX_ORDER = 3
#: The fit reads at most about this many documents a language (a hash of the id picks them).
FIT_DOCS = 8000
#: More distinct languages than this is an error, as all profiles are broadcast.
MAX_LANGUAGES = 2000
#: Longer texts are counted in slices of this many characters, and the counts are added.
SLICE = 1 << 18

_BITS = 21
_letters: np.ndarray | None = None


def _letter_table() -> np.ndarray:
    global _letters
    if _letters is None:
        table = np.zeros(0x110000, dtype=bool)
        table[[c for c in range(0x20000) if chr(c).isalpha()]] = True
        table[0x20000:0x32000] = [chr(c).isalpha() for c in range(0x20000, 0x32000)]
        _letters = table
    return _letters


def _codes(text: str) -> np.ndarray:
    """Lower-cased letters as code points; every run of anything else as one 0; 0 at both ends."""
    a = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
    a[~_letter_table()[a]] = 0
    a = np.concatenate(([0], a, [0]))
    return a[np.concatenate(([True], (a[1:] != 0) | (a[:-1] != 0)))]


def _counted(codes: np.ndarray, max_order: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-gram keys in order, and their counts.  A key holds one code point in 21 bits."""
    grams = [codes[codes != 0]]
    key = marked = np.maximum(codes, 1)  # a blank is 1 in keys, so that " a" is not "a"
    for n in range(2, max_order + 1):
        key = (key[:-1] << _BITS) | marked[n - 1 :]
        # blanks only at the ends: words don't run into each other
        ok = np.ones(len(key), dtype=bool)
        for k in range(1, n - 1):
            ok &= codes[k : k + len(key)] != 0
        grams.append(key[ok])
    keys = np.sort(np.concatenate(grams))
    if not len(keys):
        return keys, keys
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[first], np.diff(np.append(first, len(keys)))


def ngram_counts(text: str | None, max_order: int = MAX_ORDER) -> tuple[np.ndarray, np.ndarray]:
    """Counts of a whole text.  Null and letterless texts have none."""
    if not text:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    if len(text) <= SLICE:
        return _counted(_codes(text), max_order)
    codes = _codes(text)
    parts = [_counted(codes[i : i + SLICE + max_order - 1], max_order) for i in range(0, len(codes), SLICE)]
    if len(parts) > 1:  # an n-gram that lies in the overlap of two slices wholly counts once
        tails = [_counted(codes[i : i + max_order - 1], max_order) for i in range(SLICE, len(codes), SLICE)]
        parts += [(k, -c) for k, c in tails]
    keys, at = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    counts = np.zeros(len(keys), np.int64)
    np.add.at(counts, at, np.concatenate([c for _, c in parts]))
    return keys[counts > 0], counts[counts > 0]


def ranked(keys: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    """The most frequent keys first; ties to the smaller key."""
    if len(keys) > size:
        least = np.partition(counts, len(counts) - size)[len(counts) - size]
        keep = counts >= least
        keys, counts = keys[keep], counts[keep]
    return keys[np.lexsort((keys, -counts))][:size]


def fit_profiles(
    labelled: DataFrame,
    text: str = "text",
    lang: str = "lang",
    key: str = "doc_id",
    size: int = PROFILE_SIZE,
    max_order: int = MAX_ORDER,
    fit_docs: int = FIT_DOCS,
) -> dict[str, list[int]]:
    """Profiles by language, from a bounded sample of rows: the rows of a language whose hash of
    ``key`` lies below a threshold that lets about ``fit_docs`` of them through (all, if it has
    fewer).  Rows with null language or text add nothing; without rows the result is empty."""
    labelled = labelled.select(F.col(lang).alias("lang"), F.col(text).alias("text"), F.col(key).alias("key")).where("lang is not null")
    sizes = labelled.groupBy("lang").count().limit(MAX_LANGUAGES + 1).collect()
    if len(sizes) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    if not sizes:
        return {}
    below = F.create_map(*[F.lit(x) for r in sizes for x in (r["lang"], least_hashes(r["count"], fit_docs))])
    sample = labelled.where(F.xxhash64(F.coalesce(F.col("key").cast("string"), F.lit("")), F.lit(11)) <= below[F.col("lang")]).select("lang", "text")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}

        def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
            keys, at = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
            return keys, np.bincount(at, np.concatenate([c for _, c in parts])).astype(np.int64)

        for pdf in batches:
            for own, rows in pdf.groupby("lang")["text"]:
                parts = held.setdefault(own, [])
                for x in rows:
                    parts.append(ngram_counts(x, max_order))
                    if len(parts) > 256:
                        parts[:] = [merged(parts)]
        for own, parts in held.items():
            keys, counts = merged(parts)
            if len(keys):
                yield pd.DataFrame({"lang": own, "gram": keys, "n": counts})

    totals = sample.mapInPandas(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    top = totals.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= size).collect()
    profiles: dict[str, list[int]] = {}
    for r in sorted(top, key=lambda r: (r["lang"], r["rank"])):
        profiles.setdefault(r["lang"], []).append(r["gram"])
    return profiles


class RankClassifier:
    """Profiles as one matrix: a row for each n-gram of any profile, a column for each language."""

    def __init__(self, profiles: dict[str, list[int]], size: int = PROFILE_SIZE, max_order: int = MAX_ORDER):
        self.langs, self.size, self.max_order = sorted(profiles), size, max_order
        self.keys = np.unique(np.concatenate([np.asarray(profiles[x], dtype=np.int64) for x in self.langs])) if self.langs else np.empty(0, np.int64)
        self.ranks = np.full((len(self.keys) + 1, len(self.langs)), -1, dtype=np.int32)
        for j, x in enumerate(self.langs):
            self.ranks[np.searchsorted(self.keys, profiles[x]), j] = np.arange(len(profiles[x]))

    def predict(self, text: str | None) -> tuple[str, float]:
        """Language and score.  The score is 1 - best / (best + second best distance) stretched
        to 0..1: 0 for a tie, 1 where only the best fits.  Ties go to the first language by
        name.  ``und`` with score 0 if there are no letters or no profiles."""
        keys, counts = ngram_counts(text, self.max_order)
        if not len(keys) or not self.langs:
            return "und", 0.0
        own = ranked(keys, counts, self.size)
        at = np.searchsorted(self.keys, own)
        at[at == len(self.keys)] = 0
        rows = self.ranks[np.where(self.keys[at] == own, at, len(self.keys))]
        place = np.arange(len(own), dtype=np.int32)[:, None]
        out = np.where(rows < 0, self.size, np.abs(rows - place)).sum(axis=0)
        best = int(out.argmin())
        if len(out) == 1:
            return self.langs[best], 1.0
        rest = float(np.partition(out, 1)[1])
        return self.langs[best], 0.0 if rest == 0 else 1.0 - float(out[best]) / rest


def identify(df: DataFrame, profiles: dict[str, list[int]], text: str = "text", size: int = PROFILE_SIZE, max_order: int = MAX_ORDER) -> DataFrame:
    """``df`` with ``lang_pred`` and ``score`` added (columns of those names are replaced).

    Null, empty and letterless texts get ``und`` and score 0; repeated rows get equal results;
    an empty table gives an empty one.
    """
    model = df.sparkSession.sparkContext.broadcast(RankClassifier(profiles, size, max_order))

    @F.pandas_udf("lang_pred string, score double")
    def predicted(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        return each(lambda texts: pd.DataFrame([model.value.predict(x) for x in texts], columns=["lang_pred", "score"]), batches)

    found = fresh("_langid_found", df)
    return df.withColumn(found, predicted(F.col(text))).withColumns({"lang_pred": F.col(f"{found}.lang_pred"), "score": F.col(f"{found}.score")}).drop(found)
