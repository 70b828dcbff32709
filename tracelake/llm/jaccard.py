"""N-gram Jaccard join by a blocked sparse matrix product.

Documents are rows of an incidence matrix whose columns are n-grams (64-bit hashes of ``n`` words).
The product of the matrix with its transpose holds the overlap of every two documents.  It is never
formed as a whole: bounds that follow from the sizes say which blocks can hold a link.

1. Equal rows (copies) are one row, a class.
2. If two sets of at most s n-grams link, they differ in at most d(s) n-grams.  Split the n-gram
   space into d(s) + 1 + spare ranges: the two sets agree wholly in 1 + spare of them.  A *band* is
   a hash of what a set has in a range.  Bands are put in one order, the telling ones last (those
   with many n-grams that are not common in the corpus), and each set drops its first ``spare``:
   of the bands that two linked sets agree in, the last one in that order is dropped by neither.
   So linked classes share a band, and classes that only share a common passage hardly ever do.
   Bands are made for the size class of the set, and for the next one if a larger partner may be
   there.
3. Components of "shares a band" (each class tied to the smallest of its band, no pairs) are the
   blocks.  Those larger than a tile are split first: chance ties chain ever more classes as a table
   grows.  There bands are finer and counted, each set drops its most frequent ones, and classes that
   only meet in rare bands are tied if they share as many as linked sets must.  What is still large
   is cut into tiles by size class and hash, and only tiles whose sizes may link meet, in as many
   passes as keep what a pass shuffles in proportion to the sets.
4. In a block the overlap counts are accumulated by products of slices of columns; pairs below the
   size-derived bound go.  A block reports its links' spanning forest, at most one link a class.

All links are found (no sampling, no cap); a link is judged by its exact counts.  Classes are told
apart by two 64-bit hashes of the set: among m distinct texts two are taken as equal by chance with
probability below m^2 / 2^129.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracelake.llm.common import cut, fresh, release, tidy
from tracelake.llm.components import components

SHINGLE = 5
#: Two sets link if PERCENT of their union is common.
PERCENT = 80
#: Classes and n-grams of a tile.
TILE_ROWS = 2048
TILE_GRAMS = 1_500_000
#: Common n-grams: those in HOT_SETS sets of a slice of HOT_SLICE n-grams of a task at least; the
#: HOT_MOST most frequent of them are broadcast.  They only order the bands; any list is correct.
HOT_SETS = 4
HOT_SLICE = 1_000_000
HOT_MOST = 50_000
#: Rows of a band up to which one task sorts them, at least; bands with more are at most about
#: HOT_BANDS, found in one row of BAND_SAMPLE and summed up with partial results.
HOT_BAND = 1 << 18
HOT_BANDS = 100_000
BAND_SAMPLE = 64
#: Sets of a band up to which its pairs are counted.
PAIR_ROWS = 16
#: N-grams that one pass sends to blocks, at least; or PASS_SHARE times those of all sets in blocks.
PASS_GRAMS = 1 << 25
PASS_SHARE = 2
#: Columns multiplied at a time; those of fewer rows are counted pair by pair.
COLUMNS = 2048
FEW_ROWS = 24
#: Pairs counted at a time.
PAIRS = 1_000_000

_FOLD = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_U = np.uint64
_M1, _M2 = _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _M1
    x = (x ^ (x >> _U(27))) * _M2
    return x ^ (x >> _U(31))


@cache
def _letters() -> np.ndarray:
    """A random number for each byte at each of 64 places in a word."""
    return _mix(np.arange(1, 64 * 256 + 1, dtype=np.uint64) * _U(0x9E3779B97F4A7C15))


def shingles(text: str | None, n: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of a text's word n-grams; one for a text of fewer words; none for
    null and wordless texts."""
    if not text:
        return np.empty(0, np.uint64)
    a = np.frombuffer(text.encode("utf-8", "surrogatepass").translate(_FOLD), dtype=np.uint8)
    inside = (a != 32) & ((a < 9) | (a > 13))
    starts = np.flatnonzero(inside & ~np.concatenate(([False], inside[:-1])))
    if not len(starts):
        return np.empty(0, np.uint64)
    a, inside = a[starts[0] :], inside[starts[0] :]
    starts = starts - starts[0]
    at = np.arange(len(a)) - np.repeat(starts, np.diff(np.append(starts, len(a))))
    spelt = _letters()[((at & 63) << 8) | a]
    if at.max() >= 64:
        spelt = spelt * ((at >> 6).astype(np.uint64) * _U(2) + _U(1))
    spelt[~inside] = 0
    word = _mix(np.add.reduceat(spelt, starts))
    n = min(n, len(word))
    gram = np.full(len(word) - n + 1, _U(n))
    for k in range(n):
        gram = _mix(gram * _U(0x9E3779B97F4A7C15) + word[k : len(word) - n + 1 + k])
    return np.unique(gram)


@cache
def _size_classes(percent: int) -> list[int]:
    """First size of each class; a link's smaller set is in the class of the larger or the one before."""
    out = [1]
    while out[-1] < 1 << 40:
        out.append(max(out[-1] + 1, out[-1] * 3 // 2, -(-out[-1] * 100 // percent)))
    return out


def _ranges(k: int, percent: int) -> tuple[int, int]:
    """For links whose larger set is in class k: number of ranges, and how many of those that agree
    are spare.  |A - B| + |B - A| <= (100 - percent) / (100 + percent) * (|A| + |B|)."""
    most = _size_classes(percent)[k + 1] - 1
    d = 2 * most * (100 - percent) // (100 + percent)
    spare = 2 + d * 35 // 100 if d else 0
    return (d + 1 + spare if d else 0), spare


@cache
def _bounds(m: int) -> np.ndarray:
    return np.array([i * (1 << 64) // m for i in range(1, m)], dtype=np.uint64)


def bands(grams: np.ndarray, percent: int = PERCENT, hot: np.ndarray | None = None) -> np.ndarray:
    """Bands of a set: two sets that link share one, unless they are equal.  ``hot``: common
    n-grams, sorted."""
    n, out = len(grams), []
    classes = _size_classes(percent)
    own = int(np.searchsorted(classes, n, side="right")) - 1
    total = np.concatenate(([_U(0)], np.cumsum(_mix(grams + _U(0x51ED270B)))))
    rare = np.ones(n, dtype=np.int64)
    if hot is not None and len(hot):
        at = np.searchsorted(hot, grams)
        at[at == len(hot)] = 0
        rare[hot[at] == grams] = 0
    told = np.concatenate(([0], np.cumsum(rare)))
    for k in (own, own + 1):
        if k > own and n * 100 < classes[k] * percent:
            continue
        m, spare = _ranges(k, percent)
        if not m:
            continue
        edge = np.concatenate(([0], np.searchsorted(grams, _bounds(m)), [n]))
        band = _mix(_mix(total[edge[1:]] - total[edge[:-1]] + _U(k)) + np.arange(m, dtype=np.uint64))
        order = np.lexsort((band, np.diff(edge), np.diff(told[edge])))
        out.append(band[order[spare:]])
    return np.concatenate(out) if out else np.empty(0, np.uint64)


def fine_bands(grams: np.ndarray, percent: int = PERCENT) -> list[tuple[int, int, np.ndarray]]:
    """(k, spare, bands) for each size class of a larger partner: two sets that link, the larger one
    in class k, share at least 1 + spare of the bands for k, unless they are equal."""
    n, out = len(grams), []
    classes = _size_classes(percent)
    own = int(np.searchsorted(classes, n, side="right")) - 1
    total = np.concatenate(([_U(0)], np.cumsum(_mix(grams + _U(0x51ED270B)))))
    for k in (own, own + 1):
        m, spare = _ranges(k, percent)
        if not m or (k > own and n * 100 < classes[k] * percent):
            continue
        d = m - 1 - spare
        spare = max(spare, d)
        m = d + 1 + spare
        edge = np.concatenate(([0], np.searchsorted(grams, _bounds(m)), [n]))
        out.append((k, spare, _mix(_mix(total[edge[1:]] - total[edge[:-1]] + _U(k) + _U(0x632BE59B)) + np.arange(m, dtype=np.uint64))))
    return out


def hot_grams(docs: DataFrame, n: int) -> np.ndarray:
    """Common n-grams of a table (doc_id, text), sorted; a bounded number of them."""

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[np.ndarray] = []
        size = 0

        def flush() -> pd.DataFrame:
            grams = np.concatenate(held)
            held.clear()
            grams.sort()
            first = np.flatnonzero(np.concatenate(([True], grams[1:] != grams[:-1])))
            times = np.diff(np.append(first, len(grams)))
            some = times >= HOT_SETS
            return pd.DataFrame({"gram": grams[first[some]].view(np.int64), "times": times[some]})

        for pdf in batches:
            for x in pdf["text"]:
                held.append(shingles(x, n))
                size += len(held[-1])
                if size >= HOT_SLICE:
                    yield flush()
                    size = 0
        if held:
            yield flush()
        tidy()

    found = cut(docs.select("text").mapInPandas(counted, "gram long, times long").groupBy("gram").agg(F.sum("times").alias("times")))
    # The most frequent ones, by steps of an eighth of a power of two: what comes here is bounded
    level = F.floor(F.log2("times") * 8).cast("int")
    steps = sorted(((r["level"], r["count"]) for r in found.groupBy(level.alias("level")).count().collect()), reverse=True)
    least, most = None, 0
    for step, count in steps:
        most += count
        if most > HOT_MOST:
            break
        least = step
    rows = found.where(level >= least).select("gram").collect() if least is not None else []
    release(found)
    return np.sort(np.array([r["gram"] for r in rows], dtype=np.int64).view(np.uint64))


def _class_of(grams: np.ndarray) -> tuple[int, int]:
    """Two hashes of a set."""
    sums = np.array([np.add.reduce(_mix(grams + _U(0x2545F491))), np.add.reduce(_mix(grams ^ _U(0x94D049BB133111EB)))], dtype=np.uint64)
    one, two = _mix(sums + _U(len(grams))).view(np.int64).tolist()
    return one, two


def _forest(links: np.ndarray) -> list[tuple[int, int]]:
    """Edges of a spanning forest of a symmetric boolean matrix."""
    todo, out = np.ones(len(links), dtype=bool), []
    for start in range(len(links)):
        if todo[start]:
            todo[start] = False
            reach = [start]
            while reach:
                new = links[reach].any(axis=0) & todo
                reach = np.flatnonzero(new).tolist()
                todo[reach] = False
                out += [(start, x) for x in reach]
    return out


def overlaps(left: list[np.ndarray], right: list[np.ndarray] | None = None, columns: int = COLUMNS, few_rows: int = FEW_ROWS) -> np.ndarray:
    """Counts of common n-grams, of every two sets (of either list): a sparse product.

    Columns that only one set has are left out.  Those of a few rows add one to each pair of their
    rows; the others, of which there are few, are multiplied a slice of columns at a time.
    """
    sets = left + (right or [])
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    grams = np.concatenate(sets)
    order = np.argsort(grams, kind="stable")
    grams, owner = grams[order], owner[order]
    first = np.flatnonzero(np.concatenate(([True], grams[1:] != grams[:-1]))) if len(grams) else np.empty(0, np.int64)
    times = np.diff(np.append(first, len(grams)))
    a = len(left)
    b = len(right) if right else a
    out = np.zeros(a * b, dtype=np.int32)
    for n in range(2, few_rows + 1):
        starts = first[times == n]
        step = max(1, PAIRS // (n * n))
        for at in range(0, len(starts), step):
            rows = owner[starts[at : at + step, None] + np.arange(n)]
            i, j = np.repeat(rows, n, axis=1).ravel(), np.tile(rows, n).ravel()
            if right:
                met = (i < a) & (j >= a)
                i, j = i[met], j[met] - a
            np.add.at(out, i * b + j, 1)
    if right is None:
        out[:: a + 1] = [len(s) for s in sets]
    out = out.reshape(a, b)
    many = np.flatnonzero(times > few_rows)
    for at in range(0, len(many), columns):
        own = many[at : at + columns]
        place = np.repeat(np.arange(len(own)), times[own])
        entry = np.repeat(first[own], times[own]) + np.arange(len(place)) - np.repeat(np.cumsum(times[own]) - times[own], times[own])
        part = np.zeros((len(sets), len(own)), dtype=np.float32)
        part[owner[entry], place] = 1
        product = part[:a] @ (part[a:] if right else part).T
        if right is None:
            np.fill_diagonal(product, 0)
        out += product.astype(np.int32)
    return out


def _linked(count: np.ndarray, left: np.ndarray, right: np.ndarray, percent: int) -> np.ndarray:
    out = np.empty(count.shape, dtype=bool)
    for at in range(0, len(count), 256):
        out[at : at + 256] = (100 + percent) * count[at : at + 256].astype(np.int64) >= percent * (left[at : at + 256, None] + right[None])
    return out


def block_links(pdf: pd.DataFrame, percent: int = PERCENT) -> pd.DataFrame:
    """Spanning links (u, v) of a block: rows c, comp, tile, grams (bytes)."""
    pdf = pdf.drop_duplicates(["c", "tile"])
    out: list[tuple[int, int]] = []
    for _, own in pdf.groupby("comp", sort=False):
        if len(own) < 2:
            continue
        sets = [np.frombuffer(x, dtype="<u8") for x in own["grams"]]
        ids = own["c"].to_numpy()
        tiles = own["tile"].to_numpy()
        sizes = np.array([len(s) for s in sets])
        first = tiles == tiles.min()
        if first.all():
            links = _linked(overlaps(sets), sizes, sizes, percent)
        else:
            left, right = np.flatnonzero(first), np.flatnonzero(~first)
            links = np.zeros((len(sets), len(sets)), dtype=bool)
            found = _linked(overlaps([sets[i] for i in left], [sets[i] for i in right]), sizes[left], sizes[right], percent)
            links[np.ix_(left, right)] = found
            links[np.ix_(right, left)] = found.T
        out += [(ids[a], ids[b]) for a, b in _forest(links)]
    return pd.DataFrame(out, columns=["u", "v"], dtype="int64")


def _ties(sets: DataFrame, hot_band: int) -> DataFrame:
    """Pairs (u, v): each ``g`` of a band with the smallest g of that band.

    One shuffle of all bands, except those with a great many rows: a sample tells them, and they are
    summed up before the shuffle.  Where the sample errs the result is the same.
    """
    banded = sets.select("g", F.explode("bands").alias("band"))
    total = sets.agg(F.sum(F.size("bands"))).first()[0] or 0
    many = max(hot_band, total // HOT_BANDS)
    tied = lambda df: df.where("g != least").select(F.col("g").alias("u"), F.col("least").alias("v")).distinct()
    by_band = lambda df: tied(df.withColumn("least", F.min("g").over(Window.partitionBy("band"))))
    if total < many:
        return by_band(banded)
    sample = sets.where(F.pmod(F.xxhash64("doc_id", F.lit(29)), F.lit(BAND_SAMPLE)) == 0).select(F.explode("bands").alias("band"))
    hot = cut(sample.groupBy("band").count().where(F.col("count") >= max(1, many // (2 * BAND_SAMPLE))).select("band"))
    apart = banded.join(F.broadcast(hot), "band")
    least = apart.groupBy("band").agg(F.min("g").alias("least"))
    return by_band(banded.join(F.broadcast(hot), "band", "left_anti")).unionByName(tied(apart.join(F.broadcast(least), "band")))


def _fine_ties(docs: DataFrame, wide: DataFrame, n: int, percent: int, pair_rows: int = PAIR_ROWS) -> DataFrame:
    """Pairs (u, v) that tie all classes of ``wide`` (c, h1, h2, rep) which link.

    Two sets that link share 1 + spare bands at least.  In an order that all sets have in common, the
    most frequent first, each drops its first spare / 2: 1 + spare - spare / 2 shared ones stay.  If
    one of them is in more than ``pair_rows`` sets, both are tied to that band's smallest class; if
    none is, the pair is counted that often among the pairs of the others.
    """

    def banded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for c, h1, h2, x in zip(pdf["c"], pdf["h1"], pdf["h2"], pdf["text"], strict=True):
                own = shingles(x, n)
                if len(own) and _class_of(own) == (h1, h2):
                    rows += [(c, k, spare, b.view(np.int64)) for k, spare, b in fine_bands(own, percent)]
            yield pd.DataFrame(rows, columns=["c", "k", "spare", "bands"])
        tidy()

    texts = docs.join(wide.select("c", "h1", "h2", "rep"), docs["doc_id"] == wide["rep"]).select("c", "h1", "h2", "text")
    sets = cut(texts.mapInPandas(banded, "c long, k int, spare int, bands array<long>").distinct())
    rows = sets.select("c", "k", "spare", F.explode("bands").alias("band"))
    # counts and least ones are written before they are joined back, so Spark can split the joins
    counts = cut(rows.groupBy("band").agg(F.count(F.lit(1)).alias("f")).where("f > 1"))
    met = cut(rows.join(counts, "band"))
    release(sets, counts)
    order = Window.partitionBy("c", "k").orderBy(F.desc("f"), "band")
    gone = F.floor(F.col("spare") / 2)
    kept = cut(met.withColumn("at", F.row_number().over(order)).where(F.col("at") > gone).select("c", "k", "spare", "band", "f"))
    release(met)
    apart = kept.where(F.col("f") > pair_rows)
    least = cut(apart.groupBy("band").agg(F.min("c").alias("least")))
    stars = apart.join(least, "band").select(F.col("c").alias("u"), F.col("least").alias("v")).where("u != v").distinct()
    few = kept.where(F.col("f") <= pair_rows).groupBy("band", "k", "spare").agg(F.collect_list("c").alias("own")).where(F.size("own") > 1)
    pairs = few.select("k", "spare", F.explode("own").alias("u"), "own").select("k", "spare", "u", F.explode("own").alias("v")).where("u > v")
    often = pairs.groupBy("u", "v", "k", "spare").count().where(F.col("count") >= 1 + F.col("spare") - gone)
    ties = cut(stars.unionByName(often.select("u", "v")))
    release(kept, least)
    return ties


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", n: int = SHINGLE, percent: int = PERCENT, tile_rows: int = TILE_ROWS, tile_grams: int = TILE_GRAMS, hot_band: int = HOT_BAND, pass_grams: int = PASS_GRAMS) -> DataFrame:
    """One row a row of ``df``: doc_id, n_shingles, component_id (smallest id reachable by links).

    Null and wordless texts have 0 n-grams and link with nothing (component_id is their own id).
    Copies, and repeated rows, link.  Rows with null ids link with nothing and have a null
    component.  Very long texts are read whole.  An empty table gives an empty result.
    """
    docs = df.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    hot = df.sparkSession.sparkContext.broadcast(hot_grams(docs, n))

    def signed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            sets = [shingles(x, n) for x in pdf["text"]]
            real = [len(s) > 0 and not pd.isna(k) for k, s in zip(pdf["doc_id"], sets, strict=True)]
            hashes = [_class_of(s) if ok else (None, None) for s, ok in zip(sets, real, strict=True)]
            yield pd.DataFrame(
                {
                    "doc_id": pdf["doc_id"].astype("Int64"),
                    "n_shingles": [len(s) for s in sets],
                    "h1": pd.array([h for h, _ in hashes], dtype="Int64"),
                    "h2": pd.array([h for _, h in hashes], dtype="Int64"),
                    "bands": [bands(s, percent, hot.value).view(np.int64) if ok else np.empty(0, np.int64) for s, ok in zip(sets, real, strict=True)],
                }
            )
        tidy()

    banded = cut(docs.mapInPandas(signed, "doc_id long, n_shingles long, h1 long, h2 long, bands array<long>"))
    rows = cut(banded.drop("bands"))  # the bands go as soon as they have been met
    with_set = rows.where("h1 is not null")
    found = with_set.groupBy("h1", "h2").agg(F.min("doc_id").alias("rep"), F.max("n_shingles").alias("n"))
    classes = cut(found.withColumn("c", F.monotonically_increasing_id()))  # written, so the numbers stay

    # Ties to the smallest first hash of a band.  Two classes with one first hash are only tied by it
    tied = components(_ties(banded.where("h1 is not null").select("doc_id", F.col("h1").alias("g"), "bands"), hot_band))
    release(banded)
    roots = tied.select(F.col("root").alias("h1"), F.col("root").alias("comp")).distinct()
    members = cut(classes.join(tied.select(F.col("node").alias("h1"), F.col("root").alias("comp")).unionByName(roots), "h1"))
    large = cut(members.groupBy("comp").agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("grams")).where((F.col("rows") > tile_rows) | (F.col("grams") > tile_grams)).select("comp"))
    if not large.isEmpty():
        wide = members.join(large, "comp", "left_semi")
        split = components(_fine_ties(docs, wide, n, percent))
        roots = split.select(F.col("root").alias("c"), F.col("root").alias("comp")).distinct()
        finer = split.select(F.col("node").alias("c"), F.col("root").alias("comp")).unionByName(roots)
        members = cut(members.join(large, "comp", "left_anti").unionByName(wide.drop("comp").join(finer, "c").select(*members.columns)))

    # Blocks
    sizes = F.array(*[F.lit(x) for x in _size_classes(percent)[:64]])
    level = F.size(F.filter(sizes, lambda s: s <= F.col("n")))
    members = members.withColumn("level", level)
    per_level = members.groupBy("comp", "level").agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("grams"))
    tiles = F.greatest(F.ceil(F.col("rows") / tile_rows), F.ceil(F.col("grams") / tile_grams))
    per_comp = per_level.groupBy("comp").agg(
        F.sum("rows").alias("rows"), F.sum("grams").alias("grams"), F.map_from_entries(F.collect_list(F.struct("level", tiles.cast("int")))).alias("tiles")
    )
    small = (F.col("rows") <= tile_rows) & (F.col("grams") <= tile_grams)
    per_comp = per_comp.withColumn("tiles", F.when(~small, F.col("tiles")))
    total = members.agg(F.sum("n")).first()[0] or 0
    shared = max(1, -(-2 * total // tile_grams))
    at = lambda k: F.coalesce(F.element_at("tiles", k), F.lit(0))
    own = F.pmod(F.xxhash64("c"), at(F.col("level"))).cast("int")
    upto = lambda n: F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    name = lambda k, a, k2, b: F.concat_ws("|", F.col("comp").cast("string"), k.cast("string"), a.cast("string"), k2.cast("string"), b.cast("string"))
    lev = F.col("level")
    meets = F.concat(
        F.transform(upto(at(lev)), lambda j: name(lev, F.least(j, own), lev, F.greatest(j, own))),
        F.transform(upto(at(lev - 1)), lambda j: name(lev - 1, j, lev, own)),
        F.transform(upto(at(lev + 1)), lambda j: name(lev, own, lev + 1, j)),
    )
    block = F.when(F.col("tiles").isNull(), F.array(F.concat(F.lit("s"), F.pmod(F.xxhash64("comp"), F.lit(shared)).cast("string")))).otherwise(meets)
    tile = F.when(F.col("tiles").isNull(), "").otherwise(F.concat_ws("|", F.format_string("%03d", lev), own.cast("string")))
    placed = members.join(per_comp.select("comp", "tiles"), "comp").select("c", "h1", "h2", "comp", "rep", block.alias("blocks"), tile.alias("tile"), "n")
    sent = placed.agg(F.sum(F.col("n") * F.size("blocks"))).first()[0] or 0
    passes = -(-sent // max(pass_grams, PASS_SHARE * total))

    def gathered(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            sets = [shingles(x, n) for x in pdf["text"]]
            same = [len(s) > 0 and _class_of(s) == h for s, h in zip(sets, zip(pdf["h1"], pdf["h2"], strict=True), strict=True)]
            yield pdf.assign(grams=[s.astype("<u8").tobytes() for s in sets])[same][["c", "comp", "tile", "blocks", "grams"]]
        tidy()

    texts = docs.join(placed, docs["doc_id"] == placed["rep"])
    sets = texts.select("c", "h1", "h2", "comp", "tile", "blocks", "text").mapInPandas(gathered, "c long, comp long, tile string, blocks array<string>, grams binary")
    if passes > 1:
        sets = cut(sets)

    def met(k: int) -> DataFrame:
        here = F.filter("blocks", lambda b: F.pmod(F.xxhash64(b), F.lit(passes)) == k) if passes > 1 else F.col("blocks")
        in_blocks = sets.select("c", "comp", "tile", "grams", F.explode(here).alias("block"))
        return in_blocks.groupBy("block").applyInPandas(lambda pdf: block_links(pdf, percent), "u long, v long")

    links = met(0) if passes <= 1 else cut(met(0))
    for k in range(1, passes):
        links = links.unionByName(cut(met(k)))
    if passes > 1:
        release(sets)
    joined = components(links)

    rooted = classes.join(joined.withColumnRenamed("node", "c"), "c", "left").select("h1", "h2", "rep", F.coalesce("root", "c").alias("root"))
    least_id = rooted.groupBy("root").agg(F.min("rep").alias("component_id"))
    of_set = rooted.join(least_id, "root").select("h1", "h2", "component_id")
    return rows.select("doc_id", "n_shingles", "h1", "h2").join(of_set, ["h1", "h2"], "left").select("doc_id", "n_shingles", F.when(F.col("h1").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def deduplicate(df: DataFrame, key: str = "doc_id", text: str = "text", n: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """``df`` with one document of each component, the one with the smallest id.

    Rows of one id are one document; of a kept id the row with the smallest text hash stays.
    Rows with null ids all stay.  Documents without words stay, as they link with nothing.
    """
    kept = near_duplicates(df, key, text, n, percent).where("doc_id = component_id").select(F.col("doc_id").alias(key)).distinct()
    once, row = Window.partitionBy(key).orderBy(F.xxhash64(text), F.xxhash64(*df.columns)), fresh("_row", df)
    rows = df.where(F.col(key).isNotNull()).join(kept, key, "left_semi").withColumn(row, F.row_number().over(once)).where(F.col(row) == 1).drop(row)
    return rows.select(*df.columns).unionByName(df.where(F.col(key).isNull()))
