"""Benchmark decontamination with a generalised suffix automaton.

The automaton holds the word sequences of all test items (no path leads from one item into the
next).  A document's words run through it; at each word it knows the length of the longest
stretch of any item that ends there.  A *window* is ``window`` consecutive words of an item, or a
whole item that is shorter.  A word inside an occurrence of a window is hit.

Items grow slowly and documents fast, so the automaton is what is broadcast: items are dealt
into shards of at most ``shard_words`` words, one automaton each, and the documents run through
one shard after the other.  A shard's size has that bound whatever the size of the benchmark.

Speed: a stretch of two or more words can only match where each neighbouring pair of words occurs
in an item, so runs of such pairs are found with numpy first and only those walk the automaton.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake.llm.common import cut, each, fresh

WINDOW = 10
SHARD_WORDS = 500_000
#: Spans are removed if they are at least this long or the document's share of hit words is over
#: the second figure; a document over the third one goes as a whole.
SPAN_WORDS = 5
COVERAGE = 0.05
DROP_COVERAGE = 0.8

_FOLD = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words(text: str | None) -> list[bytes]:
    """Words of a text: A-Z lower-cased, then runs of a-z, 0-9 and anything beyond ASCII."""
    return text.encode("utf-8", "surrogatepass").translate(_FOLD).split() if text else []


class SuffixAutomaton:
    """Over sequences of integers; ``add`` starts at the root each time."""

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length, self.owners = [-1], [0], [set()]

    def _state(self, length: int, moves: dict[int, int], link: int) -> int:
        self.next.append(moves)
        self.length.append(length)
        self.link.append(link)
        self.owners.append(set())
        return len(self.next) - 1

    def _split(self, p: int, q: int, c: int) -> int:
        twin = self._state(self.length[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = twin
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = twin
            p = self.link[p]
        return twin

    def add(self, sequence: list[int], owner: int) -> None:
        last = 0
        for c in sequence:
            if c in self.next[last]:
                q = self.next[last][c]
                last = q if self.length[q] == self.length[last] + 1 else self._split(last, q, c)
            else:
                new, p = self._state(self.length[last] + 1, {}, 0), last
                while p >= 0 and c not in self.next[p]:
                    self.next[p][c] = new
                    p = self.link[p]
                if p >= 0:
                    q = self.next[p][c]
                    self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, q, c)
                last = new
            self.owners[last].add(owner)


class ItemMatcher:
    """The automaton of some items, ready to be broadcast."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int = WINDOW):
        self.window, self.items = window, [name for name, _ in items]
        self.vocab: dict[bytes, int] = {}
        coded = [[self.vocab.setdefault(w, len(self.vocab)) for w in ws] for _, ws in items]
        auto = SuffixAutomaton()
        for k, seq in enumerate(coded):
            auto.add(seq, k)
        self.next, self.link, self.length = auto.next, auto.link, auto.length
        # Owners of a state are those of all states that link to it: every item it occurs in.
        owners = auto.owners
        for v in sorted(range(1, len(self.next)), key=lambda v: -self.length[v]):
            if self.link[v] > 0:
                owners[self.link[v]] |= owners[v]
        short: dict[int, list[tuple[int, int]]] = {}
        for k, seq in enumerate(coded):
            if 0 < len(seq) < window:
                v = 0
                for c in seq:
                    v = self.next[v][c]
                short.setdefault(v, []).append((len(seq), k))
        #: By state: ((length, items), ...) for each window that is a suffix of the state's
        #: longest string, longest first.
        self.ends: list[tuple[tuple[int, tuple[int, ...]], ...]] = [()] * len(self.next)
        for v in sorted(range(1, len(self.next)), key=lambda v: self.length[v]):
            p = self.link[v]
            own: dict[int, tuple[int, ...]] = {}
            if self.length[p] < window <= self.length[v]:
                own[window] = tuple(sorted(owners[v]))
            for n, k in short.get(v, []):
                own[n] = (*own.get(n, ()), k)
            self.ends[v] = (*sorted(own.items(), reverse=True), *self.ends[p])
        lengths = [min(window, len(seq)) for seq in coded if seq]
        self.least = min(lengths, default=0)
        self.width = len(self.vocab)
        self.pairs = np.unique(np.array([a * self.width + b for seq in coded for a, b in zip(seq, seq[1:], strict=False)], dtype=np.int64))

    def hits(self, document: list[bytes]) -> tuple[list[tuple[int, int]], set[int], list[int]]:
        """Merged spans [start, end) of hit words, items with occurring windows, and the longest
        match that ends in each span."""
        if not self.least or len(document) < self.least:
            return [], set(), []
        get = self.vocab.get
        ids = np.fromiter((get(w, -1) for w in document), dtype=np.int64, count=len(document))
        known = ids >= 0
        if not known.any():
            return [], set(), []
        joined = np.zeros(len(ids), dtype=bool)  # with the word before
        if len(ids) > 1 and len(self.pairs):
            both = np.flatnonzero(known[1:] & known[:-1])
            if len(both):
                keys = ids[both] * self.width + ids[both + 1]
                at = np.searchsorted(self.pairs, keys)
                at[at == len(self.pairs)] = 0
                joined[both[self.pairs[at] == keys] + 1] = True
        starts = np.flatnonzero(known & ~joined)
        stops = np.flatnonzero(known & ~np.append(joined[1:], False)) + 1
        enough = stops - starts >= self.least
        spans: list[list[int]] = []
        longest: list[int] = []
        found: set[int] = set()
        for a, b in zip(starts[enough].tolist(), stops[enough].tolist(), strict=True):
            v, n = 0, 0
            for i, c in enumerate(ids[a:b].tolist(), a + 1):
                while v and c not in self.next[v]:
                    v = self.link[v]
                    n = self.length[v]
                if c in self.next[v]:
                    v, n = self.next[v][c], n + 1
                first = True
                for size, items in self.ends[v]:
                    if size > n:
                        continue
                    found.update(items)
                    if first:
                        first = False
                        start = i - size
                        while spans and spans[-1][0] >= start:
                            spans.pop()
                            longest.pop()
                        if spans and spans[-1][1] >= start:
                            spans[-1][1] = i
                            longest[-1] = max(longest[-1], n)
                        else:
                            spans.append([start, i])
                            longest.append(n)
        return [(a, b) for a, b in spans], found, longest


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def shards(benchmark: DataFrame, item: str = "item_id", text: str = "text", window: int = WINDOW, shard_words: int = SHARD_WORDS) -> Iterator[ItemMatcher]:
    """Matchers over all items, each of at most ``shard_words`` words (or one longer item).
    Items come one partition at a time; null and wordless texts and null ids are left out."""
    held: list[tuple[str, list[bytes]]] = []
    size = 0
    for r in benchmark.select(F.col(item).cast("string").alias("i"), F.col(text).alias("t")).where("i is not null and t is not null").toLocalIterator():
        ws = words(r["t"])
        if ws:
            if held and size + len(ws) > shard_words:
                yield ItemMatcher(held, window)
                held, size = [], 0
            held.append((r["i"], ws))
            size += len(ws)
    if held:
        yield ItemMatcher(held, window)


def cleaned(text: str, spans: list[tuple[int, int]], n_words: int, n_hit: int, span_words: int, coverage: float) -> str:
    """The text without hit spans of ``span_words`` words or more, or without any if its share of
    hit words exceeds ``coverage``; what is around a removed span is joined by one blank."""
    gone = [(a, b) for a, b in spans if b - a >= span_words or n_hit > coverage * n_words]
    if not gone:
        return text
    at = [m.span() for m in _WORD.finditer(text)]
    parts, left = [], 0
    for a, b in gone:
        part = text[left : at[a][0]].rstrip()
        parts.append(part.lstrip() if left else part)
        left = at[b - 1][1]
    parts.append(text[left:].lstrip())
    return " ".join(p for p in parts if p)


_FOUND = "n_words long, n_hit long, longest long, spans array<struct<start:long,end:long>>, items array<string>, cleaned string"


def contamination(
    df: DataFrame, benchmark: DataFrame, text: str = "text", window: int = WINDOW, shard_words: int = SHARD_WORDS, remove: bool = False, span_words: int = SPAN_WORDS, coverage: float = COVERAGE, drop_coverage: float = DROP_COVERAGE
) -> DataFrame:
    """``df`` with n_words, n_hit, spans (array of word ranges), longest (longest item stretch
    that ends in a hit span) and items (item ids, sorted as strings); columns of those names are
    replaced.

    With ``remove``, hit spans are taken out of the texts: a span goes if it has ``span_words`` words
    or more, or if the document's share of hit words exceeds ``coverage``; documents whose share
    exceeds ``drop_coverage`` go as a whole.  Other documents keep their text byte for byte.

    Null and empty texts have no words.  Items with equal text all count, repeated rows get equal
    results, very long texts are read whole.  An empty benchmark hits nothing, an empty table gives
    an empty one.

    Each pass over the documents broadcasts one shard; with more shards what was found so far is
    written and goes into the next pass, so no worker holds more than one.
    """
    at = fresh("_contamination", df)
    found = df.withColumn(at, F.lit(None).cast(f"struct<{_FOUND}>"))
    matchers = shards(benchmark, text=text if text in benchmark.columns else "text", window=window, shard_words=shard_words)
    m, last = next(matchers, None), False
    while not last:
        after = next(matchers, None)
        last = after is None
        sent = df.sparkSession.sparkContext.broadcast(m)
        found = found.withColumn(at, _matched(sent, (span_words, coverage) if remove and last else None)(F.col(text), F.col(at)))
        if not last:
            found = cut(found)
        m = after
    found = found.withColumns({k: F.col(f"{at}.{k}") for k in ("n_words", "n_hit", "longest", "spans", "items")})
    if remove:
        kept = found.where((F.col("n_hit") == 0) | (F.col("n_hit") <= F.col("n_words") * F.lit(drop_coverage)))
        found = kept.withColumn(text, F.coalesce(F.col(f"{at}.cleaned"), F.col(text)))
    return found.drop(at)


def _matched(sent: Broadcast, removal: tuple[int, float] | None) -> Callable[..., Column]:
    def of_batch(batch: tuple[pd.Series, pd.DataFrame]) -> pd.DataFrame:
        rows, m = [], sent.value
        texts, before = batch
        for x, old_spans, old_items, old_longest in zip(texts, before["spans"], before["items"], before["longest"], strict=True):
            ws = words(x)
            spans, which, most = m.hits(ws) if m is not None else ([], set(), [])
            items = {m.items[k] for k in which}
            if old_spans is not None and len(old_spans):
                spans = merged([*spans, *((s["start"], s["end"]) for s in old_spans)])
                items.update(old_items)
                most = [*most, int(old_longest)]
            n_hit = sum(b - a for a, b in spans)
            rest = cleaned(x, spans, len(ws), n_hit, *removal) if spans and removal else None
            rows.append((len(ws), n_hit, max(most, default=0), [{"start": a, "end": b} for a, b in spans], sorted(items), rest))
        return pd.DataFrame(rows, columns=["n_words", "n_hit", "longest", "spans", "items", "cleaned"])

    @F.pandas_udf(_FOUND)
    def found(batches: Iterator[tuple[pd.Series, pd.DataFrame]]) -> Iterator[pd.DataFrame]:
        return each(of_batch, batches)

    return found.asNondeterministic()  # else a filter on what it finds runs it twice


def digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(items).encode()).hexdigest()


def remove_spans(df: DataFrame, text: str = "text", span_words: int = SPAN_WORDS, coverage: float = COVERAGE, drop_coverage: float = DROP_COVERAGE) -> DataFrame:
    """Take hit spans out of the texts of a frame made by :func:`contamination`.

    A span goes if it has ``span_words`` words or more, or if the document's share of hit words
    exceeds ``coverage``; documents whose share exceeds ``drop_coverage`` go as a whole.  The text
    around a removed span is joined by one blank.  Other documents keep their text byte for byte.
    """

    @F.pandas_udf("string")
    def cleaned(texts: pd.Series, spans: pd.Series, n_words: pd.Series, n_hit: pd.Series) -> pd.Series:
        out = []
        for x, own, n, h in zip(texts, spans, n_words, n_hit, strict=True):
            gone = [(s["start"], s["end"]) for s in own if s["end"] - s["start"] >= span_words or h > coverage * n]
            if gone:
                at = [m.span() for m in _WORD.finditer(x)]
                parts, left = [], 0
                for a, b in gone:
                    part = x[left : at[a][0]].rstrip()
                    parts.append(part.lstrip() if left else part)
                    left = at[b - 1][1]
                parts.append(x[left:].lstrip())
                x = " ".join(p for p in parts if p)
            out.append(x)
        return pd.Series(out, dtype=object)

    kept = df.where((F.col("n_hit") == 0) | (F.col("n_hit") <= F.col("n_words") * F.lit(drop_coverage)))
    return kept.withColumn(text, F.when(F.col("n_hit") > 0, cleaned(text, "spans", "n_words", "n_hit")).otherwise(F.col(text)))
