"""Best-fit packing of tokenised documents into sequences of a fixed capacity.

Hierarchical residual packing.  Documents are tokenised once, in a map; what travels from there
on is one small row a piece, never text or ids.  Pieces shorter than a sequence are dealt by a hash
of their row into groups of about ``group_items``; each group is packed by best-fit decreasing.
Nearly full bins are final.  The emptiest underfull bins of each group go on as single items to
the next round, where ``fan_in`` groups meet in one, and so on to a single group.  A group hands on
``carry`` bins at most; that bounds every task of every round, and the others are final as they
are, so no piece is lost.  (After best fit any two bins of a group exceed a sequence together, so
what later rounds can still join is the few emptiest of each group.)
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from itertools import islice
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.llm.common import cut, tidy

CAPACITY = 2048
GROUP_ITEMS = 16384
FAN_IN = 8
CARRY = 32
#: A bin with at most this many free places counts as nearly full.
TOLERANCE = 8
#: Encoded words a worker holds; beyond that the half met last, the rarer one, is forgotten.
CACHE_WORDS = 600_000
#: Words it keeps from one partition to the next.
KEPT_WORDS = 150_000

# Characters whose normal form, lower case and class are the same everywhere; texts with others
# go through the tokenizer as a whole.
_PLAIN = re.compile(r"[\t\n\r\x20-\x7e¡-±´-¸º»¿-įı-ňŊ-ž]*")
_LETTERS = "a-zªµºß-öø-ÿĀ-ž"
_PIECES = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[0-9]|[^\s{_LETTERS}0-9]+")
#: The steps before byte-pair merges for which ``_PIECES`` stands.
_KNOWN_STEPS = (
    {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
)


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in byte-level vocabularies: itself if it can be seen,
    else the next letter from U+0100 on."""
    seen = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in seen]
    return {b: chr(b) if b in seen else chr(256 + hidden.index(b)) for b in range(256)}


class WordTokenizer:
    """Ids of whole texts.

    Most tokenizers encode texts as they are.  If this one's steps are the known ones (lower case,
    white space dropped, letters apart from digits and signs), stretches between white space are
    encoded on their own, each once, and then looked up: texts repeat their words.  Texts for which
    that might differ from encoding the whole (unusual characters, special tokens) are encoded
    whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        steps = json.loads(Path(path).read_text())
        self.by_word = (steps.get("normalizer"), steps.get("pre_tokenizer")) == _KNOWN_STEPS and self.tok.get_vocab_size() <= 1 << 16
        self.marks = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.letters = _byte_letters()
        self.model = self.tok.model
        self.cache: dict[bytes, bytes] = {}

    def encode(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        if self.by_word and _PLAIN.fullmatch(text) and not any(m in text for m in self.marks):
            words = text.lower().encode().split()
            try:
                ids = b"".join(map(self.cache.__getitem__, words))
            except KeyError:
                ids = self._with_new(words)
            return np.frombuffer(ids, dtype="<u2").astype("<u4").tobytes()
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def forget(self, kept: int) -> None:
        """Keep the words met first, which are the common ones."""
        if len(self.cache) > kept:
            self.cache = dict(islice(self.cache.items(), kept))

    def _with_new(self, words: list[bytes]) -> bytes:
        if len(self.cache) > CACHE_WORDS:
            self.forget(CACHE_WORDS // 2)
        cache = self.cache
        for w in words:
            if w not in cache:
                cache[w] = b"".join([cache.get(p) or self._piece(p) for p in (x.encode() for x in _PIECES.findall(w.decode()))])
        return b"".join(map(cache.__getitem__, words))

    def _piece(self, piece: bytes) -> bytes:
        ids = [t.id for t in self.model.tokenize(piece.decode("latin-1").translate(self.letters))]
        return np.array(ids, dtype="<u2").tobytes()


_tokenizers: dict[str, WordTokenizer] = {}


def tokenizer(path: str) -> WordTokenizer:
    if path not in _tokenizers:
        _tokenizers[path] = WordTokenizer(path)
    return _tokenizers[path]


def pieces(df: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = 0, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a piece: doc_id, piece, start, length, ids_crc32, and uid, a number of its own.

    A document is its ids and then ``end_id``; null text is empty.  Documents longer than
    ``capacity`` are cut into pieces of that length and a shorter last one.
    """

    def cut_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tok = tokenizer(path)
        uid = TaskContext.get().partitionId() << 40
        end = np.array([end_id], dtype="<u4").tobytes()
        step = 4 * capacity
        for pdf in batches:
            rows = []
            for doc, x in zip(pdf["doc_id"], pdf["text"], strict=True):
                ids = tok.encode(x or "") + end
                for k, a in enumerate(range(0, len(ids), step)):
                    own = ids[a : a + step]
                    rows.append((doc, k, a // 4, len(own) // 4, zlib.crc32(own), uid))
                    uid += 1
            yield pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32", "uid"]).astype({"doc_id": pdf["doc_id"].dtype})
        tok.forget(KEPT_WORDS)
        tidy()

    kind = dict(df.dtypes)[key]
    own = df.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    return own.mapInPandas(cut_up, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, uid long")


def best_fit(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best-fit decreasing: for each item its bin and its offset there, and each bin's fill."""
    bins, offsets = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
    fills: list[int] = []
    free: list[list[int]] = [[] for _ in range(capacity + 1)]  # open bins by what is left in them
    mask = 0
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        fit = mask >> size
        if fit:
            left = size + (fit & -fit).bit_length() - 1
            b = free[left].pop()
            if not free[left]:
                mask ^= 1 << left
        else:
            b, left = len(fills), capacity
            fills.append(0)
        bins[i], offsets[i] = b, fills[b]
        fills[b] += size
        left -= size
        if left:
            if not free[left]:
                mask |= 1 << left
            free[left].append(b)
    return bins, offsets, np.array(fills, np.int64)


def _carried(fills: np.ndarray, capacity: int, tolerance: int, carry: int) -> np.ndarray:
    out = np.zeros(len(fills), dtype=bool)
    out[np.argsort(fills, kind="stable")[:carry]] = True
    return out & (capacity - fills > tolerance)


def pack(
    df: DataFrame,
    path: str,
    capacity: int = CAPACITY,
    end_id: int = 0,
    key: str = "doc_id",
    text: str = "text",
    group_items: int = GROUP_ITEMS,
    fan_in: int = FAN_IN,
    carry: int = CARRY,
    tolerance: int = TOLERANCE,
) -> DataFrame:
    """Pack all documents; one row a piece: doc_id, piece, start, length, ids_crc32, sequence_id,
    offset.  Repeated rows are documents of their own (even with equal ids); null ids stay null;
    an empty table gives an empty result.  The result is the same however often a task is rerun.
    """
    cut_up = cut(pieces(df, path, capacity, end_id, key, text))
    kind = dict(cut_up.dtypes)["doc_id"]
    whole = cut_up.where(F.col("length") == capacity).select("doc_id", "piece", "start", "length", "ids_crc32", F.col("uid").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    partial = cut_up.where(F.col("length") < capacity)
    groups = max(1, -(-partial.count() // group_items))

    def packed(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "uid"], ascending=[False, True], ignore_index=True)
        bins, offsets, fills = best_fit(pdf["length"].to_numpy(), capacity)
        first = np.full(len(fills), -1, np.int64)
        lead = np.flatnonzero(offsets == 0)
        first[bins[lead]] = pdf["uid"].to_numpy()[lead]
        return pdf.assign(bin=first[bins], offset=offsets, fill=fills[bins], carried=_carried(fills, capacity, tolerance, carry)[bins] & (offsets == 0))

    group = F.pmod(F.xxhash64("uid"), F.lit(groups))
    local = partial.withColumn("grp", group).groupBy("grp").applyInPandas(
        packed, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, uid long, grp long, bin long, offset long, fill long, carried boolean"
    )
    out = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    if groups == 1:
        return whole.unionByName(local.select(*out[:5], F.col("bin").alias("sequence_id"), "offset"))
    local = cut(local)

    def joined(pdf: pd.DataFrame) -> pd.DataFrame:
        """Rows of a leaf bin: the bin it lies in now (root) and its offset there (base)."""
        pdf = pdf.sort_values(["root", "base"], ignore_index=True)
        heads = pdf[pdf["base"] == 0].sort_values(["fill", "root"], ascending=[False, True], ignore_index=True)
        bins, offsets, fills = best_fit(heads["fill"].to_numpy(), capacity)
        first = np.full(len(fills), -1, np.int64)
        lead = np.flatnonzero(offsets == 0)
        first[bins[lead]] = heads["root"].to_numpy()[lead]
        at = np.searchsorted(np.sort(heads["root"].to_numpy()), pdf["root"].to_numpy())
        at = np.argsort(heads["root"].to_numpy())[at]
        return pdf.assign(root=first[bins[at]], base=pdf["base"].to_numpy() + offsets[at], fill=fills[bins[at]], carried=_carried(fills, capacity, tolerance, carry)[bins[at]])

    moved = local.where("carried").select("grp", F.col("bin").alias("leaf"), F.col("bin").alias("root"), F.lit(0).cast("long").alias("base"), "fill", "carried")
    settled = None
    while groups > 1:
        groups = -(-groups // fan_in)
        moved = cut(moved.withColumn("grp", F.floor(F.col("grp") / fan_in).cast("long")).groupBy("grp").applyInPandas(joined, moved.schema))
        done = moved if groups == 1 else moved.where("not carried")
        settled = done if settled is None else settled.unionByName(done)
        moved = moved.where("carried")
    final = local.join(settled.select(F.col("leaf").alias("bin"), "root", "base"), "bin", "left")
    return whole.unionByName(final.select(*out[:5], F.coalesce("root", "bin").alias("sequence_id"), (F.col("offset") + F.coalesce("base", F.lit(0))).alias("offset")))
