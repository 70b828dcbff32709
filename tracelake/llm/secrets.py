"""Secret scanning: fixed patterns and a linear-chain conditional random field.

The patterns find what has a known form.  The field (CRF) finds the rest: it tags tokens O
(outside), B (first of a secret) or I (inside one) from their shape, the tokens and signs around
them and features of the whole file, and is decoded by Viterbi.  Every token of a text is one of
the chain.  The score of a token is a sum of what its shape, its two tokens before, the one after
and the signs on either side are worth, so each distinct token and run of signs is looked at once
and the rest is table look-ups.  A bound from the weights tells which tokens are O in the best
tagging whatever stands around them; those cut the chain, and only the rest is decoded.  The result
is that of decoding the whole chain.

The field is trained here on a bounded sample of the documents, by gradient ascent on the
likelihood.  What it learns as secret are pattern matches and secrets of many other shapes planted
in the sampled texts; what it learns as harmless are planted look-alikes, numbers and ordinary words
of these texts.  No I follows an O: that move is worth minus infinity.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.llm.common import each, fresh, least_hashes, tidy

KINDS = ("assign", "access", "hex", "crf")
#: Documents the fit reads, about; each gives at most FIT_EACH chains of a sort, of FIT_LONGEST
#: tokens at most.
FIT_DOCS = 1_500
FIT_EACH = 2
FIT_LONGEST = 64
#: Tokens on either side that the fit reads with a secret or a look-alike.
FIT_BESIDE = 3
#: A span is reported if the best tagging is this much likelier than the best without it (log odds).
MARGIN = 2.0
#: Characters of texts that are tagged together, and characters of tokens remembered by a worker.
CHUNK = 400_000
REMEMBERED = 8_000_000

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]+")
_HEX_CLASS = bytes(104 if chr(c) in "0123456789abcdef" else 32 for c in range(256))
_SPLIT = re.compile(r"([\w+/-]+=*)")
_DIGIT = re.compile(r"[0-9]")
_KEYS = ("password", "passwd", "secret", "token", "apikey", "api_key")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Matches of the fixed patterns, by start and then kind."""
    found = []
    low = text.lower()
    if any(k in low for k in _KEYS):
        found += [("assign", *m.span()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [("access", *m.span()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    if b"h" * 24 in text.encode("utf-8", "surrogatepass").translate(_HEX_CLASS):
        found += [("hex", *m.span()) for m in _HEX.finditer(text) if m.end() - m.start() >= 24]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


def value_spans(text: str, base: list[tuple[str, int, int]]) -> list[tuple[int, int]]:
    """What is secret in pattern matches: of an assignment, what is assigned."""
    return sorted((_ASSIGN.match(text, a, b).start(2) if kind == "assign" else a, b) for kind, a, b in base)


def parts_of(text: str, edges: Sequence[int] = ()) -> list[str]:
    """Signs and tokens of a text in turn, signs first and last; tokens are cut at ``edges``."""
    parts = _SPLIT.split(text)
    if not edges:
        return parts
    out, a = [parts[0]], len(parts[0])
    for k in range(1, len(parts), 2):
        b = a + len(parts[k])
        for x in edges[bisect_right(edges, a) : bisect_right(edges, b - 1)]:
            out += [text[a:x], ""]
            a = x
        out += [text[a:b], parts[k + 1]]
        a = b + len(parts[k + 1])
    return out


def places(parts: list[str]) -> list[tuple[int, int]]:
    """Start and end of each token."""
    ends = np.cumsum([len(x) for x in parts])
    return list(zip(ends[0:-1:2].tolist(), ends[1::2].tolist(), strict=True))


def edges_of(values: list[tuple[int, int]]) -> list[int]:
    return sorted({x for v in values for x in v})


def touched(spans: list[tuple[int, int]], others: list[tuple[int, int]]) -> list[bool]:
    """Which of ``spans`` (in order) overlap one of ``others``."""
    out = [False] * len(spans)
    starts = [a for a, _ in spans]
    for s, e in others:
        k = max(0, bisect_right(starts, s) - 1)
        while k < len(spans) and spans[k][0] < e:
            out[k] = out[k] or spans[k][1] > s
            k += 1
    return out


def _bucket(x: float, *steps: float) -> int:
    return sum(x >= s for s in steps)


def file_features(text: str) -> list[str]:
    n = max(1, len(text))
    return [
        f"file:len{_bucket(len(text), 200, 1000, 5000, 20000)}",
        f"file:eq{_bucket(text.count('=') / n, 0.0005, 0.005, 0.02)}",
        f"file:nl{_bucket(text.count(chr(10)) / n, 0.002, 0.01, 0.03)}",
    ]


#: Classes of characters.
_DIGITS, _UPPERS, _LOWERS, _SIGNS = range(4)
_CLASSES = np.array([_DIGITS if chr(c).isdigit() else _UPPERS if chr(c).isupper() else _LOWERS if chr(c).isalpha() else _SIGNS for c in range(128)])
_HEXES = np.array([chr(c) in "0123456789abcdefABCDEF" for c in range(128)])
_GROUPS = np.array([chr(c) in "-/_" for c in range(128)])
#: What is told of a token's shape, and of its kind as a neighbour.
SHAPE = ("kind", "len", "digits", "upper", "lower", "entropy", "turns", "turned", "hex", "groups", "start", "equals")
KIND = ("kind", "equals")


def shapes(toks: Sequence[str]) -> np.ndarray:
    """A row of codes, in the order of SHAPE, for each token; tokens aren't empty."""
    n = np.array([len(x) for x in toks], np.int64)
    chars = np.frombuffer("".join(toks).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    owner, start = np.repeat(np.arange(len(toks)), n), np.cumsum(n) - n
    ascii_ = chars < 128
    plain = np.where(ascii_, chars, 0)
    cls = _CLASSES[plain]
    if not ascii_.all():
        others, at = np.unique(chars[~ascii_], return_inverse=True)
        cls[~ascii_] = np.array([_DIGITS if chr(c).isdigit() else _UPPERS if chr(c).isupper() else _LOWERS if chr(c).isalpha() else _SIGNS for c in others.tolist()])[at]
    have = np.bincount(owner * 4 + cls, minlength=4 * len(toks)).reshape(-1, 4)
    share = have / n[:, None]
    key = np.sort((owner << 21) | chars)
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    times = np.diff(np.append(first, len(key)))
    entropy = np.log2(n) - np.bincount(key[first] >> 21, times * np.log2(times), len(toks)) / n
    place = np.arange(len(chars)) - start[owner]
    turned = np.bincount(owner[1:][(cls[1:] != cls[:-1]) & (place[1:] >= 2)], minlength=len(toks))
    of = lambda mask: np.bincount(owner[mask], minlength=len(toks))
    steps = lambda x, *at: np.searchsorted(at, x, side="right")
    equals = of(ascii_ & (chars == 61)) > 0
    letters = have[:, _UPPERS] + have[:, _LOWERS] == n
    kind = np.select(
        [letters & (have[:, _UPPERS] == 0), letters & (have[:, _UPPERS] == 1) & (cls[start] == _UPPERS), letters, have[:, _DIGITS] == n, have[:, _DIGITS] > 0], [0, 1, 2, 3, 4], 5
    )
    heads = np.zeros(len(toks), np.int64)
    for k in range(4):
        heads = heads * 5 + np.where(n > k, cls[np.minimum(start + k, len(chars) - 1)], 4)
    return np.stack(
        [
            kind,
            steps(n, 4, 6, 8, 12, 16, 20, 24, 32, 40, 41, 64),
            steps(share[:, _DIGITS], 0.01, 0.1, 0.3, 0.5, 0.7, 0.9, 1.0),
            steps(share[:, _UPPERS], 0.01, 0.2, 0.5, 0.9),
            steps(share[:, _LOWERS], 0.01, 0.2, 0.5, 0.9),
            steps(entropy + 1e-9, 2.5, 3.0, 3.5, 4.0, 4.5),
            steps(turned / n, 0.05, 0.2, 0.35, 0.5),
            steps(turned, 1, 2, 4, 8) * 4 + steps(n, 6, 12, 24),
            (of(ascii_ & _HEXES[plain]) == n).astype(np.int64),
            np.minimum(4, of(ascii_ & _GROUPS[plain])),
            heads,
            equals.astype(np.int64),
        ],
        axis=1,
    )


SIDES = ("prev", "prev2", "next")


def near_word(tok: str) -> str:
    return tok.lower().rstrip("=")


def signs(side: str, gap: str) -> list[str]:
    """Of what stands between two tokens; ``side`` tells which of them is looked at."""
    plain = re.sub(r"\s+", " ", gap.replace("\n", "|")).replace("'", '"').replace(" ", "_")
    return [f"{side}:{plain}", f"{side}end:{(plain[-1:] if side == 'left' else plain[:1]) or '-'}"]


def features(parts: list[str], first: int, last: int, of_file: list[str]) -> list[list[str]]:
    """Of tokens first to last: their shapes, their neighbours, their file."""
    low, high = max(0, first - 2), min(len(parts) // 2, last + 2)
    codes = {k: row for k, row in zip(range(low, high), shapes(parts[2 * low + 1 : 2 * high : 2]).tolist(), strict=True)}
    out = []
    for k in range(first, last + 1):
        row = ["bias", *(f"{name}:{c}" for name, c in zip(SHAPE, codes[k], strict=True))]
        for side, i in zip(SIDES, (k - 1, k - 2, k + 1), strict=True):
            if i in codes:
                row += [f"{side}:{near_word(parts[2 * i + 1])}", *(f"{side}{name}:{codes[i][SHAPE.index(name)]}" for name in KIND)]
            else:
                row.append(f"{side}:")
        out.append(row + signs("left", parts[2 * k]) + signs("right", parts[2 * k + 2]) + of_file)
    return out


class Crf:
    """Tags O, B, I: weights[feature, tag], moves[tag, tag]; chains start and end next to an O."""

    def __init__(self, names: list[str], weights: np.ndarray, moves: np.ndarray):
        self.index, self.weights, self.moves = {x: k for k, x in enumerate(names)}, weights, moves
        self._forget()
        # A run of tokens that aren't O stands between two O in the best tagging and is worth no less
        # than all O there.  Its moves are worth at most ``ends`` and, for each token, ``step``.
        m = moves
        self.step = float(m[1:, 1:].max() - m[0, 0])
        self.ends = float(m[0, 1:].max() + m[1:, 0].max() - 2 * m[0, 0]) - self.step
        finite = m[np.isfinite(m)]
        self.spread = 4 * float(finite.max() - finite.min()) + abs(self.ends)

    def __getstate__(self) -> tuple:
        return list(self.index), self.weights, self.moves

    def __setstate__(self, state: tuple) -> None:
        self.__init__(*state)

    def _sum(self, names: list[str]) -> np.ndarray:
        return self.weights[[self.index[f] for f in names if f in self.index]].sum(axis=0)

    def _forget(self) -> None:
        """Tokens and signs met so far: their numbers, and rows of what they are worth (a token: by
        itself and to the ones beside it; number 0 is none)."""
        row = lambda name: self.weights[self.index[name]] if name in self.index else np.zeros(3)
        self.of_code = [np.array([row(f"{name}:{c}") for c in range(625)]) for name in SHAPE]
        self.of_kind = [np.array([[row(f"{side}{name}:{c}") for side in SIDES] for c in range(6)]) for name in KIND]
        words = sorted({f.split(":", 1)[1] for f in self.index if f.split(":", 1)[0] in SIDES} - {""})
        self.words = {x: k + 1 for k, x in enumerate(words)}
        self.of_word = np.array([np.zeros((3, 3)), *([row(f"{side}:{x}") for side in SIDES] for x in words)])
        self.token_number, self.gap_number, self.held = {"": 0}, {}, 0
        self.of_token = np.zeros((1024, 4, 3))
        self.of_token[0, 1:] = [row(f"{side}:") for side in SIDES]
        self.of_gap = np.zeros((0, 2, 3))

    def _meet(self, toks: list[str], gaps: list[str]) -> None:
        new = [x for x in set(toks) if x not in self.token_number]
        if new:
            codes = shapes(new)
            rows = np.zeros((len(new), 4, 3))
            rows[:, 0] = self._sum(["bias"]) + sum(table[codes[:, k]] for k, table in enumerate(self.of_code))
            rows[:, 1:] = self.of_word[[self.words.get(near_word(x), 0) for x in new]] + sum(table[codes[:, SHAPE.index(name)]] for name, table in zip(KIND, self.of_kind, strict=True))
            first = len(self.token_number)
            while len(self.of_token) < first + len(new):
                self.of_token = np.concatenate([self.of_token, np.zeros_like(self.of_token)])
            self.of_token[first : first + len(new)] = rows
            self.token_number.update(zip(new, range(first, first + len(new)), strict=True))
            self.held += sum(map(len, new)) + 60 * len(new)
        some = [x for x in set(gaps) if x not in self.gap_number]
        if some:
            rows = np.array([[self._sum(signs("left", x)), self._sum(signs("right", x))] for x in some])
            self.gap_number.update(zip(some, range(len(self.gap_number), len(self.gap_number) + len(some)), strict=True))
            self.of_gap = np.concatenate([self.of_gap, rows])
            self.held += sum(map(len, some)) + 60 * len(some)

    def emissions(self, rows: list[list[str]]) -> np.ndarray:
        return np.array([self._sum(r) for r in rows])

    def emitted(self, texts: list[list[str]], files: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Emissions of all tokens of some texts, given as parts, two empty rows before each text
        and after the last; and where each text's tokens start."""
        if self.held > REMEMBERED:
            self._forget()
        toks, left, right, starts = ["", ""], ["", ""], ["", ""], []
        for parts in texts:
            starts.append(len(toks))
            toks += parts[1::2]
            left += parts[0:-1:2]
            right += parts[2::2]
            toks += ("", "")
            left += ("", "")
            right += ("", "")
        self._meet(toks, left + right)
        t = np.fromiter(map(self.token_number.__getitem__, toks), np.int64, len(toks))
        left = np.fromiter(map(self.gap_number.__getitem__, left), np.int64, len(toks))
        right = np.fromiter(map(self.gap_number.__getitem__, right), np.int64, len(toks))
        starts = np.array(starts)
        by_token, by_gap = self.of_token, self.of_gap
        e = by_token[t, 0] + by_gap[left, 0] + by_gap[right, 1]
        e[1:] += by_token[t[:-1], 1]
        e[2:] += by_token[t[:-2], 2]
        e[:-1] += by_token[t[1:], 3]
        e += np.repeat(np.array([np.zeros(3), *files]), np.diff(np.concatenate(([0], starts, [len(t)]))), axis=0)
        e[t == 0] = (0.0, -1e4, -1e4)
        return e, starts

    def open_runs(self, e: np.ndarray, known: np.ndarray) -> list[tuple[int, int]]:
        """Runs (from, to) of tokens that may be other than O in the best tagging; all others are
        O there for certain.  ``known``: tokens that aren't O."""
        gain = e[:, 1:].max(axis=1) - e[:, 0] + self.step
        # O for the tokens next to a known one may change its tag and the moves on both sides
        gain[known] = np.abs(e[known, 1] - e[known, 2]) + self.spread
        sums = np.concatenate([[0.0], np.cumsum(gain)])  # the largest sum of neighbours that holds a token
        best = np.maximum.accumulate(sums[:0:-1])[::-1] - np.minimum.accumulate(sums[:-1])
        open_ = (best + self.ends >= -1e-5) & (e[:, 1] > -1e4)
        at = np.flatnonzero(np.diff(np.concatenate(([False], open_, [False])).astype(np.int8)))
        return list(zip(at[0::2].tolist(), at[1::2].tolist(), strict=True))

    def best(self, e: np.ndarray) -> tuple[list[int], float]:
        """Best tags of a chain, and their score."""
        score, back = self.moves[0] + e[0], []
        for x in e[1:]:
            table = score[:, None] + self.moves
            back.append(table.argmax(axis=0))
            score = table.max(axis=0) + x
        score = score + self.moves[:, 0]
        tag = int(score.argmax())
        tags = [tag]
        for b in reversed(back):
            tag = int(b[tag])
            tags.append(tag)
        return tags[::-1], float(score.max())

    def spans(self, e: np.ndarray, known: np.ndarray, gone: np.ndarray, margin: float) -> list[tuple[int, int]]:
        """Tagged runs (first, last) without ``gone`` tokens, each ``margin`` likelier than O there."""
        e = e.copy()
        e[known, 0] = -np.inf
        tags, score = self.best(e)
        out: list[list[int]] = []
        for k, t in enumerate(tags):
            if t and not gone[k]:
                if t == 2 and out and out[-1][1] == k - 1:
                    out[-1][1] = k
                else:
                    out.append([k, k])
        kept = []
        for a, b in out:
            plain = e.copy()
            plain[a : b + 1, 1:] = -np.inf
            if b + 1 < len(e) and known[b + 1]:
                plain[b + 1, 1:] = plain[b + 1, 1:].max()  # a known secret may begin there
            if score - self.best(plain)[1] >= margin:
                kept.append((a, b))
        return kept

    @staticmethod
    def fit(chains: list[tuple[list[list[str]], list[int]]], epochs: int = 12, batch: int = 64, rate: float = 0.3, decay: float = 1e-3, seed: int = 5) -> Crf:
        """Stochastic gradient ascent on the log likelihood (forward-backward), Adagrad steps on
        batches of chains of about the same length."""
        seen = Counter(f for rows, _ in chains for r in rows for f in set(r))
        names = sorted(f for f, n in seen.items() if n >= 3)
        index = {x: k for k, x in enumerate(names)}
        w, m = np.zeros((len(names) + 1, 3)), np.zeros((3, 3))  # the last row stays 0
        m[0, 2] = -np.inf  # no I without a B
        gw, gm = np.full(w.shape, 1e-2), np.full(m.shape, 1e-2)
        widest = max(len(r) for rows, _ in chains for r in rows)
        order = sorted(range(len(chains)), key=lambda k: len(chains[k][1]))
        batches = []
        for at in range(0, len(order), batch):
            own = [chains[k] for k in order[at : at + batch]]
            longest = max(len(tags) for _, tags in own)
            f = np.full((len(own), longest, widest), len(names), np.int32)
            y = np.zeros((len(own), longest), np.int64)
            for i, (rows, tags) in enumerate(own):
                y[i, : len(tags)] = tags
                for j, r in enumerate(rows):
                    known = [index[x] for x in r if x in index]
                    f[i, j, : len(known)] = known
            batches.append((f, y, np.array([len(tags) for _, tags in own])))
        rng = np.random.default_rng(seed)
        with np.errstate(all="ignore"):
            for _ in range(epochs):
                for k in rng.permutation(len(batches)):
                    f, y, n = batches[k]
                    count, longest, _ = f.shape
                    here = np.arange(longest)[None] < n[:, None]
                    rows = np.arange(count)
                    e = w[f].sum(axis=2)
                    a, b = np.empty((count, longest, 3)), np.empty((count, longest, 3))
                    a[:, 0] = m[0] + e[:, 0]
                    for i in range(1, longest):
                        a[:, i] = np.logaddexp.reduce(a[:, i - 1, :, None] + m, axis=1) + e[:, i]
                    b[:] = m[:, 0]
                    for i in range(longest - 2, -1, -1):
                        after = np.logaddexp.reduce(m[None] + (e[:, i + 1] + b[:, i + 1])[:, None], axis=2)
                        b[:, i] = np.where((i < n - 1)[:, None], after, m[:, 0])
                    z = np.logaddexp.reduce(a[rows, n - 1] + m[:, 0], axis=1)
                    p = np.exp(a + b - z[:, None, None]) * here[:, :, None]
                    step = np.zeros((3, 3))
                    step[0] -= p[:, 0].sum(axis=0)
                    np.add.at(step[0], y[:, 0], 1)
                    step[:, 0] -= p[rows, n - 1].sum(axis=0)
                    np.add.at(step[:, 0], y[rows, n - 1], 1)
                    if longest > 1:
                        both = here[:, 1:, None, None]
                        pair = np.exp(a[:, :-1, :, None] + m + (e[:, 1:] + b[:, 1:])[:, :, None] - z[:, None, None, None])
                        step -= np.where(both, pair, 0).sum(axis=(0, 1))
                        np.add.at(step, (y[:, :-1][here[:, 1:]], y[:, 1:][here[:, 1:]]), 1)
                    step[0, 2] = 0
                    step /= count
                    gm += step * step
                    m += rate * step / np.sqrt(gm)
                    d = -p
                    d[here, y[here]] += 1
                    d /= count
                    flat = f[here].ravel()
                    each = np.repeat(d[here], f.shape[2], axis=0)
                    g = np.stack([np.bincount(flat, each[:, t], len(w)) for t in range(3)], axis=1)
                    g[-1] = 0
                    g -= decay * w * (np.abs(g) > 0)
                    gw += g * g
                    w += rate * g / np.sqrt(gw)
        return Crf(names, w[:-1], m)


_LOWER = "abcdefghijklmnopqrstuvwxyz"
_UPPER = _LOWER.upper()
_ALNUM = _LOWER + _UPPER + "0123456789"
_NAMES = ("password", "passwd", "passphrase", "pass", "pwd", "secret", "token", "key", "credential", "credentials", "login", "auth", "bearer", "access key", "api key", "private key", "signing key", "client secret", "pin")


def planted_secret(rng: np.random.Generator) -> tuple[str, int, int]:
    """A phrase with an invented secret, and where that is in it."""
    some = lambda letters, n: "".join(letters[i] for i in rng.integers(0, len(letters), n))
    pick = lambda xs: xs[rng.integers(len(xs))]
    sort = rng.integers(8)
    if sort == 0:
        s = some(_ALNUM, rng.integers(16, 65))
    elif sort == 1:
        s = some(_ALNUM + "+/", 4 * rng.integers(5, 16)) + pick(("", "=", "=="))
    elif sort == 2:
        s = pick(("gk_", "xb-", "sk_live_", "pat-", "key_", "SG_")) + some(_ALNUM, rng.integers(20, 41))
    elif sort == 3:
        s = "-".join(some("0123456789ABCDEF", n) for n in (8, 4, 4, 12))
    elif sort == 4:
        s = ".".join("ey" + some(_ALNUM + "_-", rng.integers(15, 40)) for _ in range(3))
    elif sort == 5:
        s = some(_UPPER + "234567", rng.integers(16, 33))
    elif sort == 6:
        s = some(_LOWER + _UPPER, rng.integers(6, 15))
    else:
        s = some(_ALNUM, rng.integers(3, 8)) + pick("!$#%&*@^") + some(_ALNUM, rng.integers(3, 8))
    name, q = pick(_NAMES), pick(('"', "'", "`", "", ""))
    forms = [f"{name} is {q}", f"{name} {q}", f"{name} -> {q}", f"my {name} was {q}", f"the {name} {q}", f"{name}\n{q}", f"export {name.upper().replace(' ', '_')}_X={q}", f"use {q}", f"Bearer {q}", f"user / {q}", f"admin:{q}"]
    alone = sort < 6  # the others need a word that tells
    before = pick(forms if alone else forms[:7])
    if alone and rng.random() < 0.2:
        before = q
    return before + s + q, len(before), len(before) + len(s)


def planted_harmless(rng: np.random.Generator, word: Callable[[], str]) -> str:
    """A phrase that looks like one with a secret but holds none."""
    some = lambda letters, n: "".join(letters[i] for i in rng.integers(0, len(letters), n))
    pick = lambda xs: xs[rng.integers(len(xs))]
    name, digits = pick(_NAMES), "0123456789"
    sort = rng.integers(9)
    if sort == 0:
        return f"the {name} {pick(('is', 'was', 'for', 'of', 'and', 'must be'))} {word()} {word()}"
    if sort == 1:
        return f"{name} {word()} {word()}"
    if sort == 2:
        return f"{some(digits, 4)}-{some(digits, 2)}-{some(digits, 2)} {some(digits, 2)}:{some(digits, 2)}"
    if sort == 3:
        return some(digits, rng.integers(5, 20))
    if sort == 4:
        return "".join(word().capitalize() for _ in range(rng.integers(2, 5)))
    if sort == 5:
        return pick("_-/").join(word().lower() for _ in range(rng.integers(2, 7)))
    if sort == 6:
        return f"{word().lower()}{some(digits, rng.integers(1, 4))}@{word().lower()}.{pick(('com', 'org', 'net'))}"
    if sort == 7:
        return f"https://www.{word().lower()}.org/{word().lower()}/{some(digits, rng.integers(1, 7))}?{word().lower()}={some(digits, 2)}"
    return f'{pick(("v", "V", "No. ", "ISBN ", "+"))}{some(digits, rng.integers(1, 4))}{pick(".- ")}{some(digits, rng.integers(1, 5))}{pick(".- ")}{some(digits, rng.integers(1, 6))}'


def chains_of(text: str, seed: int, each: int = FIT_EACH) -> Iterator[tuple[list[list[str]], list[int]]]:
    """What the fit learns from a text: at most ``each`` pattern matches, numbers and codes,
    ordinary words, planted secrets and planted look-alikes, with the tokens beside them."""
    rng = np.random.default_rng(seed)
    of_file = file_features(text)

    def chain(parts: list[str], values: list[tuple[int, int]], first: int, last: int) -> tuple[list[list[str]], list[int]]:
        toks = places(parts)
        inside = lambda k: any(a <= toks[k][0] and toks[k][1] <= b for a, b in values)
        first, last = max(0, first - FIT_BESIDE), min(len(toks) - 1, last + FIT_BESIDE)
        while first > 0 and inside(first - 1):
            first -= 1
        while last + 1 < len(toks) and inside(last + 1):
            last += 1
        last = min(last, first + FIT_LONGEST - 1)
        tags = [0 if not inside(k) else 2 if k > first and any(a <= toks[k - 1][0] and toks[k][1] <= b for a, b in values) else 1 for k in range(first, last + 1)]
        return features(parts, first, last, of_file), tags

    values = value_spans(text, base_spans(text))
    parts = parts_of(text, edges_of(values))
    toks = places(parts)
    if not toks:
        return
    starts = [a for a, _ in toks]
    for a, b in [values[i] for i in rng.permutation(len(values))[:each]]:
        yield chain(parts, values, bisect_right(starts, a) - 1, max(0, bisect_right(starts, b - 1) - 1))
    codes = [k for k in range(len(toks)) if _DIGIT.search(parts[2 * k + 1])]
    for k in [codes[i] for i in rng.permutation(len(codes))[:each]] + rng.integers(0, len(toks), each).tolist():
        yield chain(parts, values, k, k)
    words = [x for x in parts[1::2] if x.isalpha()] or ["x"]
    for k in range(2 * each):
        at = toks[rng.integers(len(toks))][1]
        before, after = text[max(0, at - 200) : at] + " ", " " + text[at : at + 200]
        if k % 2:
            phrase, a, b = planted_secret(rng)
            own = [(len(before) + a, len(before) + b)]
        else:
            phrase, own = planted_harmless(rng, lambda: words[rng.integers(len(words))]), []
        joined = before + phrase + after
        marked = sorted(own + [v for v in value_spans(joined, base_spans(joined)) if not any(v[0] < y and x < v[1] for x, y in own)])
        near_by = parts_of(joined, edges_of(marked))
        there = places(near_by)
        inside = [i for i, (x, y) in enumerate(there) if x < len(before) + len(phrase) and y > len(before)]
        if inside:
            yield chain(near_by, marked, inside[0], inside[-1])


def fit_crf(df: DataFrame, text: str = "text", key: str = "doc_id", fit_docs: int = FIT_DOCS) -> Crf | None:
    """Train on a bounded sample of about ``fit_docs`` documents, those with the smallest hashes of
    ``key``; of texts, null and empty ones teach nothing.  None if there is no token in the sample.
    Repeated rows teach the same again."""
    docs = df.select(F.col(text).alias("text"), F.col(key).alias("key"))
    count = docs.count()
    order = F.xxhash64(F.coalesce(F.col("key").cast("string"), F.lit("")), F.lit(17))
    sample = docs.where(order <= F.lit(least_hashes(count, fit_docs))) if count > fit_docs else docs

    def taken(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(h, i, [" ".join(r) for r in own], tags) for h, x in zip(pdf["h"], pdf["text"], strict=True) for i, (own, tags) in enumerate(chains_of(x or "", abs(int(h))))]
            if rows:
                yield pd.DataFrame(rows, columns=["h", "i", "rows", "tags"])

    # a few texts, dealt out: however the table is stored, all tasks share the work
    dealt = sample.select(F.xxhash64(order, "text").alias("h"), "text").repartition(min(64, df.sparkSession.sparkContext.defaultParallelism), "h")
    found = dealt.mapInPandas(taken, "h long, i int, rows array<string>, tags array<int>")
    rows = sorted(found.collect(), key=lambda r: (r["h"], r["i"]), reverse=True)
    if not rows:
        return None
    # The driver holds each name once, and a row or what became of it
    names: dict[str, str] = {}
    chains = []
    while rows:
        r = rows.pop()
        chains.append(([[names.setdefault(f, f) for f in x.split(" ")] for x in r["rows"]], list(r["tags"])))
    try:
        return Crf.fit(chains)
    finally:
        del chains, names
        tidy()


def spans_of(texts: list[str], crf: Crf | None, margin: float = MARGIN) -> list[list[tuple[str, int, int]]]:
    """All spans of each text: pattern matches, and tagged tokens that touch none of them.  Tokens in
    pattern matches are secret to the field, those beside them may be so too."""
    out = [base_spans(x) for x in texts]
    if crf is None or not texts:
        return out
    values = [value_spans(x, base) if base else [] for x, base in zip(texts, out, strict=True)]
    parts = [parts_of(x, edges_of(v)) for x, v in zip(texts, values, strict=True)]
    e, starts = crf.emitted(parts, [crf._sum(file_features(x)) for x in texts])
    known, gone = np.zeros(len(e), bool), np.zeros(len(e), bool)
    for own, v, base, at in zip(parts, values, out, starts.tolist(), strict=True):
        if base and len(own) > 1:
            toks = places(own)
            known[at : at + len(toks)] = touched(toks, v)
            gone[at : at + len(toks)] = touched(toks, [(a, b) for _, a, b in base])
    toks, last = [], -1
    more: dict[int, list[tuple[str, int, int]]] = {}
    for first, end in crf.open_runs(e, known):
        if gone[first:end].all():
            continue
        for a, b in crf.spans(e[first:end], known[first:end], gone[first:end], margin):
            i = int(np.searchsorted(starts, first, side="right")) - 1
            if i != last:
                toks, last = places(parts[i]), i
            at = first - int(starts[i])
            more.setdefault(i, []).append(("crf", toks[at + a][0], toks[at + b][1]))
    for i, own in more.items():
        out[i] = sorted(out[i] + own, key=lambda s: (s[1], KINDS.index(s[0])))
    return out


def marked(text: str, spans: list[tuple[str, int, int]], mark: str) -> str:
    """``mark`` in place of every span, overlapping ones as one."""
    parts, left = [], 0
    for _, a, b in spans:
        if a >= left:
            parts += [text[left:a], mark]
        left = max(left, b)
    return "".join(parts) + text[left:]


def find_secrets(df: DataFrame, crf: Crf | None, text: str = "text", margin: float = MARGIN, mark: str | None = None) -> DataFrame:
    """``df`` with ``secrets``, an array of (kind, start, end): code points, end exclusive, by
    start and then kind.  Null and empty texts have none, repeated rows have the same, an empty table
    gives an empty one, very long texts are tagged whole; a column of that name is replaced.

    With ``mark`` it is put in place of every span in the text (then places are those before);
    texts without secrets stay byte for byte.
    """
    model, at = df.sparkSession.sparkContext.broadcast(crf), fresh("_secrets", df)

    def of_batch(texts: pd.Series) -> pd.DataFrame:
        out, held, size = [], [], 0
        for x in texts:
            held.append(x or "")
            size += len(held[-1])
            if size > CHUNK:
                out += spans_of(held, model.value, margin)
                held, size = [], 0
        out += spans_of(held, model.value, margin)
        cleaned = [marked(x, own, mark) if own and mark is not None else None for x, own in zip(texts, out, strict=True)]
        rows = [[{"kind": k, "start": a, "end": b} for k, a, b in own] for own in out]
        return pd.DataFrame({"secrets": pd.Series(rows, dtype=object), "cleaned": pd.Series(cleaned, dtype=object)})

    @F.pandas_udf("secrets array<struct<kind:string,start:long,end:long>>, cleaned string")
    def found(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        return each(of_batch, batches)

    both = df.withColumn(at, found.asNondeterministic()(F.col(text)))  # else a filter on it runs it twice
    both = both.withColumn("secrets", F.col(f"{at}.secrets"))
    if mark is not None:
        both = both.withColumn(text, F.coalesce(F.col(f"{at}.cleaned"), F.col(text)))
    return both.drop(at)


def redact(df: DataFrame, crf: Crf | None, text: str = "text", margin: float = MARGIN, mark: str = "[redacted]") -> DataFrame:
    """:func:`find_secrets` with the mark in place of what it finds."""
    return find_secrets(df, crf, text, margin, mark)


def digest(spans: list[tuple[str, int, int]]) -> str:
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()
