"""Near-duplicate documents by ProbMinHash, banding and exact verification.

A document is the multiset of its five-word shingles.  Each shingle is the source of a Poisson process with its count
as rate; arrivals fall into a uniformly drawn register, and a register keeps the shingle of its first arrival.  Two
documents agree in a register with probability equal to their probability Jaccard similarity

    J(a, b) = sum over shared d of 1 / sum over e of max(a_e / a_d, b_e / b_d)

(for multisets without repeats the plain Jaccard similarity).  A shingle's process ends as soon as its next arrival is
later than every register of the document.

Documents with the same words are collapsed first.  Bands of registers give buckets; in each bucket every member is
compared with one member, the hub, drawn by hash, so a bucket of n texts makes n - 1 pairs, and a text of a large group
meets different hubs in different buckets.  The same is done in finer buckets of several bands.  Links give classes.

Buckets that then still hold several classes are searched further, without pairs of all their members.  Let h be any text,
the hub, and m the least number of distinct shingles among the members.  Similar texts x and y share t / (1 + t) of their
sizes together, and y has m shingles or more.  If x shares fewer with h than that comes to, as most texts do that aren't
similar to h, then x and y share a shingle that h doesn't have.  So each member is compared with the text of most links,
and named by its shingles outside it; members of several classes with a name in common form a smaller group, which is
treated in the same way, until no group holds two classes, or its pairs are few enough to be counted at once: those of
two blocks of a group meet in one task, as a product of matrices (see ``may_be_similar``), and only the pairs whose shared
shingles allow a link leave it.  By the prefix filter only the first shingles of a text, rare ones before frequent ones and with a
fifth of its weight before them, need to be such names.  Where the argument fails (by the marks of ``names``), shingles
that are shared with h are names too.
Every candidate is verified on whole texts; classes are connected components of links.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialise, narrow, number_rows, read_table, release
from .components import connected_components

#: Words of a shingle, least similarity of a link, bands and registers of a band: at 0.8 a link is missed by all bands with probability 5e-8.
SHINGLE, THRESHOLD, BANDS, ROWS = 5, 0.8, 32, 4
WORD = re.compile(r"\w+")
MEMO_WORDS = 500_000
#: Pairs of different classes a member, up to which those of a group are compared at once, instead of all with a hub; the
#: number doubles from step to step, up to the second one.
DIRECT_PAIRS, MOST_DIRECT_PAIRS = 8, 64
#: Pairs beside all hubs for each text beside one in the first step, up to which they are counted at once, without further steps.
LAST_PAIRS = 4096
#: Texts of a block of a group: the first number until there are so many blocks, then the last one; and its shingles.
BLOCK, BLOCKS, MOST_BLOCK, BLOCK_SHINGLES = 128, 16, 1024, 400_000
#: Shingles that more texts of two blocks have are counted by a product of matrices, of so many columns at a time; others pair by pair.
RARE, COLUMNS = 8, 4096
#: Guards comparisons of sums of weights; a larger one only adds candidates.
EPS = 1e-9

_U = np.uint64
_GOLDEN, _M1, _M2 = _U(0x9E3779B97F4A7C15), _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB)  # splitmix64


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _M1
    x = (x ^ (x >> _U(27))) * _M2
    return x ^ (x >> _U(31))


class WordIds(dict):
    """Memo from a word to 64 bits."""

    def __missing__(self, word: str) -> int:
        if len(self) >= MEMO_WORDS:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def shingles(texts: list[str | None], ids: WordIds, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[str], np.ndarray]:
    """Distinct shingles of each text: (text, hash, count) in order of text and hash, content digests, word counts.

    A text of fewer than k words is one shingle; one without words has none, and its digest is that of the text itself.
    """
    words, sizes, digests = [], np.zeros(len(texts), np.int64), []
    for i, text in enumerate(texts):
        own = WORD.findall((text or "").lower())
        sizes[i] = len(own)
        digests.append(xxhash.xxh3_128_hexdigest(" ".join(own) if own else "\0" + (text or "")))
        words += map(ids.__getitem__, own)
    w = np.array(words, dtype=np.uint64)
    starts = np.cumsum(sizes) - sizes
    doc = np.repeat(np.arange(len(texts)), sizes)
    with np.errstate(over="ignore"):
        h = np.zeros(len(w), np.uint64)
        left = (starts + sizes)[doc] - np.arange(len(w))  # words from here to the end of the text
        for j in range(k):
            take = np.minimum(np.arange(len(w)) + j, max(len(w) - 1, 0))
            h = np.where(left > j, mix(h * _GOLDEN + w[take] + _U(j + 1)), h)
    keep = (left >= k) | ((sizes < k)[doc] & (left == sizes[doc]))
    doc, h = doc[keep], h[keep]
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])
    at = np.flatnonzero(new)
    return doc[at], h[at], np.diff(np.append(at, len(h))), digests, sizes


def signatures(n_docs: int, doc: np.ndarray, h: np.ndarray, weight: np.ndarray, m: int) -> np.ndarray:
    """ProbMinHash: the shingle of the first arrival in each of m registers, for each document; 0 where it has none."""
    first, ids = np.full(n_docs * m, np.inf), np.zeros(n_docs * m, np.uint64)
    t, rate, j = np.zeros(len(h)), weight.astype(float), 0
    local, back = doc, np.arange(n_docs)  # numbers of the documents that still have arrivals to come
    with np.errstate(over="ignore"):
        while len(h):
            j += 1
            r = mix(h + _GOLDEN * _U(j))
            t = t - np.log(((r >> _U(11)).astype(float) + 0.5) * 2.0**-53) / rate
            cell = back[local] * m + (mix(r ^ _M1) % _U(m)).astype(np.int64)
            np.minimum.at(first, cell, t)
            won = first[cell] == t
            ids[cell[won]] = h[won]
            latest = first.reshape(n_docs, m)[back].max(axis=1)
            alive = t < latest[local]
            h, t, rate, local = h[alive], t[alive], rate[alive], local[alive]
            if len(h):
                used, local = np.unique(local, return_inverse=True)
                back = back[used]
    return ids.reshape(n_docs, m)


def similarity(a: dict[int, int], b: dict[int, int]) -> float:
    """Probability Jaccard of two count tables, exactly."""
    if not a and not b:
        return 0.0
    shared = a.keys() & b.keys()
    if not shared:
        return 0.0
    if len(shared) == len(a) == len(b) and a == b:
        return 1.0
    if max(a.values()) == 1 == max(b.values()):
        return len(shared) / (len(a) + len(b) - len(shared))
    keys = list(a.keys() | b.keys())
    x, y = np.array([a.get(k, 0) for k in keys], float), np.array([b.get(k, 0) for k in keys], float)
    ratio = np.divide(x, y, out=np.full(len(x), np.inf), where=y > 0)
    order = np.argsort(ratio, kind="stable")
    x, y, ratio = x[order], y[order], ratio[order]
    below = np.concatenate(([0.0], np.cumsum(y)))  # sum of b over elements with a smaller ratio
    above = np.concatenate((np.cumsum(x[::-1])[::-1], [0.0]))  # sum of a from here on
    both = np.flatnonzero((x > 0) & (y > 0))
    at = np.searchsorted(ratio, ratio[both], "left")
    return float((1.0 / (above[at] / x[both] + below[at] / y[both])).sum())


def sketch(rows: DataFrame, bands: int = BANDS, width: int = ROWS) -> DataFrame:
    """rows (row, text): row, digest of the words, n (distinct shingles) and a 64-bit key for each band (none for a text without words)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = WordIds()
        salt = np.arange(1, bands + 1, dtype=np.uint64) * _M2
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                doc, h, count, digests, sizes = shingles(batch.column("text").to_pylist(), ids)
                sig = signatures(batch.num_rows, doc, h, count, bands * width).reshape(batch.num_rows, bands, width)
                with np.errstate(over="ignore"):
                    key = np.broadcast_to(salt, (batch.num_rows, bands)).copy()
                    for j in range(width):
                        key = mix(key * _GOLDEN + sig[:, :, j])
                keys = [k if n else [] for k, n in zip(key.view(np.int64), sizes, strict=True)]
                n = np.bincount(doc, minlength=batch.num_rows)
                yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(digests, pa.string()), pa.array(n, pa.int64()), pa.array(keys, pa.list_(pa.int64()))], ["row", "digest", "n", "keys"])

    return rows.mapInArrow(run, "row long, digest string, n long, keys array<long>")


def with_texts(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """pairs (a, b and others), texts (rep, text): adds the texts, ta and tb."""
    left = texts.select(F.col("rep").alias("a"), F.col("text").alias("ta"))
    right = texts.select(F.col("rep").alias("b"), F.col("text").alias("tb"))
    return pairs.hint("merge").join(left, "a").hint("merge").join(right, "b").select(*pairs.columns, "ta", "tb")


def _tables(batch: pa.RecordBatch, ids: WordIds) -> Iterator[tuple]:
    """Shingles, counts and table of both texts of every pair of a batch."""
    ta, tb = batch.column("ta").to_pylist(), batch.column("tb").to_pylist()
    distinct = list({*ta, *tb})
    doc, h, count, _, _ = shingles(distinct, ids)
    bounds = np.searchsorted(doc, np.arange(len(distinct) + 1))
    own = {}
    for i, text in enumerate(distinct):
        x, y = bounds[i], bounds[i + 1]
        own[text] = (h[x:y], count[x:y], dict(zip(h[x:y].tolist(), count[x:y].tolist(), strict=True)))
    return zip((own[t] for t in ta), (own[t] for t in tb), strict=True)


def verify(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """pairs (a, b), texts (rep, text): adds sim, computed from the whole texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = WordIds()
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                sims = [similarity(x[2], y[2]) for x, y in _tables(batch, ids)]
                yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(sims, pa.float64())], ["a", "b", "sim"])

    return with_texts(pairs, texts).mapInArrow(run, "a long, b long, sim double")


def names(x: tuple, hub: tuple, threshold: float, least: int) -> tuple[float, np.ndarray, np.ndarray, np.ndarray, float, int, int, bool, bool, bool, bool]:
    """A text beside a hub: similarity; its shingles as names, their shares of its weight, whether the hub has them; how
    much weight may stand before the first name that it shares with a similar text; how many names it has outside the
    hub, and how many of them a similar text has at least, if neither has repeats; then four marks.

    ``least`` is the least number of distinct shingles of the texts it may be similar to.  Names in the hub are left out
    where less than ``threshold`` of the weight lies in it: such a text shares another name with every similar one.  The
    marks: whether it isn't similar to the hub although it has that weight in it; whether it has repeats and that weight;
    whether the first holds and it shares so much with the hub that a similar text need not share more; and whether it
    has repeats.  Only the first with the second, or the third, let names in the hub count.
    """
    (h, count, table), (other, _, hub_table) = x, hub
    sim, n = similarity(table, hub_table), len(h)
    share = count / count.sum()
    inside = np.isin(h, other, assume_unique=True)
    near = bool(share[inside].sum() >= threshold - EPS)
    apart, multi = near and sim < threshold, bool(count.max() > 1)
    needed = threshold / (1 + threshold) * (n + max(threshold * n, least))  # shared shingles of similar texts without repeats
    use = slice(None) if near else ~inside
    allowed = 1 - threshold if multi else 1 - needed / n
    return sim, h[use], share[use], inside[use], allowed, int(n - inside.sum()), max(0, math.ceil(needed - inside.sum() - EPS)), apart, near and multi, apart and bool(inside.sum() >= needed - EPS), multi


def beside_hubs(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """pairs (a: a text, b: its hub, least: see ``names``): rep, hub, sim, names (hashed with the hub), allowed weight, numbers of
    names that the text has and needs in common outside the hub, and marks m1 to m4."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = WordIds()
        name = pa.struct([("key", pa.int64()), ("w", pa.float64()), ("inside", pa.bool_())])
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                found, keys, sizes = [], [], []
                for (x, hub), b, least in zip(_tables(batch, ids), batch.column("b").to_numpy(zero_copy_only=False), batch.column("least").to_pylist(), strict=True):
                    sim, own, share, inside, *rest = names(x, hub, threshold, least)
                    with np.errstate(over="ignore"):
                        salt = mix(np.array([b], np.int64).view(np.uint64) * _GOLDEN + _M1)
                        keys.append((mix(own ^ salt).view(np.int64), share, inside))
                    found.append((sim, *rest))
                    sizes.append(len(own))
                flat = [pa.array(np.concatenate(c), t.type) for c, t in zip(zip(*keys, strict=True), name, strict=True)]
                offsets = pa.array(np.append(0, np.cumsum(sizes)), pa.int32())
                listed = pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays(flat, fields=list(name)))
                kinds = [pa.float64(), pa.float64(), pa.int64(), pa.int64(), *[pa.bool_()] * 4]
                columns = [pa.array(c, t) for c, t in zip(zip(*found, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), listed, *columns], ["rep", "hub", "names", "sim", "allowed", "has", "needs", "m1", "m2", "m3", "m4"])

    schema = "rep long, hub long, names array<struct<key:long,w:double,inside:boolean>>, sim double, allowed double, has long, needs long, m1 boolean, m2 boolean, m3 boolean, m4 boolean"
    return with_texts(pairs, texts).mapInArrow(run, schema)


def _shared(n: int, split: int, row: np.ndarray, key: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Sums of the weights of the keys that two of n rows share, for the rows before ``split`` with those after it; with a
    split of 0 for all rows, above the diagonal.  A row has a key once, and a key one weight."""
    first, after = (split, n - split) if split else (n, n)
    out = np.zeros(first * after, np.float32)
    order = np.lexsort((row, key))
    row, key, weight = row[order], key[order], weight[order].astype(np.float32)
    starts = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, int)
    sizes = np.diff(np.append(starts, len(key)))
    df, column = np.repeat(sizes, sizes), np.repeat(np.cumsum(sizes > RARE) - 1, sizes)
    rare, common = (df > 1) & (df <= RARE), df > RARE
    r, k, w = row[rare], key[rare], weight[rare]
    for step in range(1, min(RARE, len(r))):
        met = (k[step:] == k[:-step]) & ((r[:-step] < split) & (r[step:] >= split) if split else True)
        out += np.bincount(r[:-step][met] * after + r[step:][met] - split, w[step:][met], len(out)).astype(np.float32)
    out, r, c, w = out.reshape(first, after), row[common], column[common], weight[common]
    for at in range(0, int(c[-1]) + 1 if len(c) else 0, COLUMNS):
        own = slice(*np.searchsorted(c, (at, at + COLUMNS)))
        table, ones = (np.zeros((n, int(c[own][-1]) - at + 1), np.float32) for _ in range(2))
        table[r[own], c[own] - at], ones[r[own], c[own] - at] = w[own], 1
        out += table[:first] @ ones[split:].T
    return out if split else np.triu(out, 1)


def may_be_similar(split: int, sizes: np.ndarray, h: np.ndarray, count: np.ndarray, threshold: float) -> np.ndarray:
    """Which rows before ``split`` may be similar to which after it (0: all rows, above the diagonal); a row's shingles and
    their counts lie one after another in h and count, ``sizes`` a row.

    With I the sum of the lesser counts of shared shingles, E that of those with equal counts and U that of the greater
    counts of all, a shingle of equal counts k adds k / U to the similarity, and another one no more than its lesser count
    by the lesser of both texts' sums.  So E / U + (I - E) / least sum is no less than the similarity, and without repeats equal to it.
    """
    n, row = len(sizes), np.repeat(np.arange(len(sizes)), sizes)
    total = np.bincount(row, count, n).astype(np.float32)
    left, right = total[: split or n, None], total[None, split:]
    if (count == 1).all():
        both = equal = _shared(n, split, row, h, count)
    else:
        nth = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)  # a shingle's first, second, ... occurrence
        with np.errstate(over="ignore"):
            each, same = mix(np.repeat(h, count) + _GOLDEN * nth.astype(np.uint64)), mix(h + _GOLDEN * count.astype(np.uint64))
        both, equal = _shared(n, split, np.repeat(row, count), each, np.ones(len(nth))), _shared(n, split, row, same, count)
    return (both > 0) & (equal / (left + right - both) + (both - equal) / np.minimum(left, right) >= threshold - 1e-5)


def _sets(texts: DataFrame) -> DataFrame:
    """texts (rep, text): rep, its distinct shingles and their counts (empty without repeats) as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = WordIds()
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                doc, h, count, _, _ = shingles(batch.column("text").to_pylist(), ids)
                bounds = np.searchsorted(doc, np.arange(batch.num_rows + 1))
                own = [(h[x:y].tobytes(), b"" if (count[x:y] == 1).all() else count[x:y].astype(np.int32).tobytes()) for x, y in zip(bounds, bounds[1:], strict=False)]
                yield pa.RecordBatch.from_arrays([batch.column("rep"), *[pa.array(c, pa.binary()) for c in zip(*own, strict=True)]], ["rep", "h", "counts"])

    return texts.select("rep", "text").mapInArrow(run, "rep long, h binary, counts binary")


def _joined_keys(n: int, bands: int) -> F.Column:
    """Keys of n neighbouring bands together."""
    return F.transform(F.sequence(F.lit(0), F.lit(bands - n), F.lit(n)), lambda i: F.xxhash64(F.lit(n), i, *[F.get("keys", i + j) for j in range(n)]))


def _hubs(band: DataFrame, label: str) -> DataFrame:
    """band (rep, n, key): adds the hub of each key that several texts have, drawn by hash; other keys go."""
    hubs = band.groupBy(F.col("key").alias("k")).agg(F.min(F.struct(F.xxhash64("rep", "key").alias("h"), "rep")).alias("least"), F.count("*").alias("c")).where("c > 1")
    hubs = materialise(hubs.select("k", F.col("least.rep").alias("hub")), label + "-hubs", small=True)
    return materialise(band.join(hubs, F.col("key") == F.col("k")).select("key", "rep", "n", "hub"), label)


def _classed(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """Adds c, the class of rep; classes has a row only for texts with links."""
    return rows.join(classes.select(F.col("node").alias("cn"), "component"), F.col("rep") == F.col("cn"), "left").withColumn("c", F.coalesce("component", "rep")).drop("cn", "component")


def _central_hubs(members: DataFrame) -> DataFrame:
    """members (key, rep, n, place): distinct (rep, n, place, hub), where all members of a key have one hub of no later place.

    A key's hub is the first in place among those of the keys that its members are in, so that the many keys of one
    family of texts have few hubs.
    """
    first = narrow(members.groupBy(F.col("key").alias("k")).agg(F.min("place").alias("h")))
    best = narrow(narrow(members.join(first, F.col("key") == F.col("k"))).groupBy(F.col("rep").alias("r")).agg(F.min("h").alias("h")))
    hubs = materialise(narrow(members.join(best, F.col("rep") == F.col("r"))).groupBy(F.col("key").alias("k")).agg(F.min("h").alias("h")), "near-hubs", small=True)
    return narrow(members.join(hubs, F.col("key") == F.col("k"))).select("rep", "n", "place", F.col("h.rep").alias("hub")).where("rep != hub").distinct()


def _ties(found: DataFrame, classes: DataFrame, before: DataFrame | None) -> DataFrame:
    """(old, new): classes that links tie to a hub's class take the least name around the hub; with those of ``before``.

    This isn't all that the links say, but enough to see most groups as one class.
    """
    ends = found.select(F.col("src").alias("rep"), F.col("dst").alias("hub")).unionByName(found.select(F.col("dst").alias("rep"), F.col("dst").alias("hub")))
    tied = _classed(ends, classes)
    if before is not None:
        tied = tied.join(before, F.col("c") == F.col("old"), "left").select("hub", F.coalesce("new", "c").alias("c"))
    tied = narrow(tied.select("hub", "c").distinct())
    least = narrow(tied.groupBy(F.col("hub").alias("lh")).agg(F.min("c").alias("m")))
    own = narrow(narrow(tied.join(least, F.col("hub") == F.col("lh"))).groupBy(F.col("c").alias("old")).agg(F.min("m").alias("new")))
    if before is not None:
        after = before.select(F.col("old").alias("o"), F.col("new").alias("n")).join(own, F.col("n") == F.col("old"), "left").select(F.col("o").alias("old"), F.coalesce("new", "n").alias("new"))
        own = own.join(before.select(F.col("old").alias("bo")), F.col("old") == F.col("bo"), "left_anti").unionByName(after)
    return materialise(own.where("old != new"), "near-ties", small=True)


def _viable(first: DataFrame) -> DataFrame:
    """first (key, rep, c, has, needs and others): the texts beside which a key has one of another class that needs no more
    names in common than the text has.

    A key's two least needs, of different classes, tell that for all of its texts, so no class is joined with others.
    """
    least = first.groupBy(F.col("key").alias("k"), F.col("c").alias("kc")).agg(F.min("needs").alias("least"))
    two = least.withColumn("nth", F.row_number().over(W.partitionBy("k").orderBy("least", "kc"))).where("nth <= 2")
    ends = narrow(two.groupBy("k").agg(F.min(F.struct("least", "kc")).alias("low"), F.max(F.struct("least", "kc")).alias("next")).where("low.kc != next.kc"))
    other = F.when(F.col("c") == F.col("low.kc"), F.col("next.least")).otherwise(F.col("low.least"))
    return narrow(first.join(ends, F.col("key") == F.col("k"))).where(other <= F.col("has")).select(*first.columns)


def _may_link(n: F.Column, has: F.Column, needs: F.Column, n2: F.Column, has2: F.Column, needs2: F.Column, exact: F.Column, threshold: float) -> F.Column:
    """Whether two texts beside a hub, with n shingles and ``has`` of them outside it, can be similar.

    Texts without repeats (``exact``) share at least t / (1 + t) of their sizes together: no more than the smaller one has,
    and of these no more lie in the hub than either has there.
    """
    shared = threshold / (1 + threshold) * (n + n2) - EPS
    return (has2 >= needs) & (has >= needs2) & (~exact | (shared <= F.least(n, n2)) & (shared <= F.least(has, has2) + F.least(n - has, n2 - has2)))


def _next_pairs(pairs: DataFrame, beside: DataFrame, classes: DataFrame, ties: DataFrame, threshold: float, step: int) -> tuple[DataFrame, DataFrame]:
    """For the groups of two or more classes: (rep, hub), the members of one with many pairs of them and its text of most
    links; and (a, b), the pairs of different classes of one with few."""
    marks = narrow(beside.groupBy(F.col("hub").alias("mh")).agg(((F.max("m1") & F.max("m2")) | F.max("m3")).alias("loose"), F.max("m4").alias("repeats")))
    rows = _classed(beside, classes).join(ties, F.col("c") == F.col("old"), "left").join(marks, F.col("hub") == F.col("mh"))
    use = F.when(F.col("loose"), F.col("names")).otherwise(F.filter("names", lambda x: ~x["inside"])).alias("names")
    allowed = F.when(F.col("repeats"), 1 - threshold).otherwise(F.col("allowed")).alias("allowed")
    rows = materialise(rows.select("rep", "hub", F.coalesce("new", "c").alias("c"), use, allowed, "m1", "has", F.when(F.col("repeats"), 0).otherwise(F.col("needs")).alias("needs"), (~F.col("repeats")).alias("exact")), "near-names", small=True)
    keep = ("rep", "hub", "c", "allowed", "m1", "has", "needs", "exact")
    each = rows.select(*keep, F.explode("names").alias("x")).select(*keep, "x.*")
    # Names of one class alone belong to no pair that is looked for, nor do names in the hub without a text that isn't
    # similar to it; so they may stand first, and the others follow by frequency.
    mixed = narrow(each.groupBy(F.col("key").alias("k")).agg(F.min("c").alias("c0"), F.max("c").alias("c1"), F.count("*").alias("df"), F.max(~F.col("inside") | F.col("m1")).alias("use")).where("c0 != c1 and use").select("k", "df"))
    live = materialise(each.join(mixed, F.col("key") == F.col("k")).drop("k", "m1"), "near-live", small=True)
    mass = rows.select(F.col("rep").alias("r"), F.col("hub").alias("rh"), F.aggregate("names", F.lit(0.0), lambda a, x: a + x["w"]).alias("mass"))
    own = W.partitionBy("rep", "hub")
    before = F.coalesce(F.sum("w").over(own.orderBy("inside", "df", "key").rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    first = narrow(live.withColumn("before", before).withColumn("live", F.sum("w").over(own))).join(mass, (F.col("rep") == F.col("r")) & (F.col("hub") == F.col("rh")))
    first = materialise(first.where(F.col("mass") - F.col("live") + F.col("before") <= F.col("allowed") + EPS).select("key", "rep", "c", "has", "needs", "exact"), "near-first", small=True)
    first = _viable(first)
    first = materialise(first.join(narrow(pairs.select(F.col("rep").alias("pr"), "n", "place").distinct()), F.col("rep") == F.col("pr")).drop("pr"), "near-viable", small=True)
    # By key and class first, so that a key with very many members makes few rows.
    counted = narrow(first.groupBy(F.col("key").alias("k"), "c").agg(F.count("*").alias("m"), F.min("place").alias("h")))
    groups = narrow(counted.groupBy("k").agg(F.count("*").alias("classes"), F.sum("m").alias("size"), F.sum(F.col("m") * F.col("m")).alias("same"), F.max(F.struct("m", "c")).alias("top"), F.min("h").alias("h")).where("classes > 1"))
    few = F.col("size") * F.col("size") - F.col("same") <= 2 * min(DIRECT_PAIRS << step, MOST_DIRECT_PAIRS) * F.col("size")
    placed = materialise(first.join(groups.select("k", few.alias("few"), F.col("top.c").alias("main"), F.col("h.rep").alias("hub")), F.col("key") == F.col("k")).drop("k"), "near-groups", small=True)
    pairs = materialise(placed.where(~F.col("few") & (F.col("rep") != F.col("hub"))).select("rep", "n", "place", "hub").distinct(), "near-pairs", small=True)
    small = placed.where("few").select("key", "rep", "n", "c", "has", "needs", "exact", "main")
    other = small.where("c != main").select(F.col("key").alias("k"), F.col("rep").alias("b"), F.col("n").alias("bn"), F.col("c").alias("bc"), F.col("has").alias("bhas"), F.col("needs").alias("bneeds"))
    may = _may_link(*[F.col(c) for c in ("n", "has", "needs", "bn", "bhas", "bneeds", "exact")], threshold)
    direct = narrow(small.join(other, (F.col("key") == F.col("k")) & (F.col("c") != F.col("bc")) & may)).select(F.greatest("rep", "b").alias("a"), F.least("rep", "b").alias("b")).distinct()
    direct = materialise(direct, "near-direct", small=True)
    release(rows, live, first, placed)
    return pairs, direct


def _all_pairs(pairs: DataFrame, classes: DataFrame, ties: DataFrame | None, texts: DataFrame, threshold: float) -> DataFrame:
    """(a, b): all pairs of different classes beside a hub, the hub among them, that may be similar by all of their shingles.

    A group is dealt into blocks, and two blocks at a time are compared in one task, which gives only such pairs.
    """
    rows = pairs.select("rep", "hub", "n").unionByName(pairs.select(F.col("hub").alias("rep"), "hub", F.lit(0).cast("long").alias("n")).distinct())
    rows = _classed(rows, classes)
    if ties is not None:
        rows = rows.join(ties, F.col("c") == F.col("old"), "left").withColumn("c", F.coalesce("new", "c")).drop("old", "new")
    rows = materialise(rows, "near-last", small=True)
    m, shingles_ = F.count("*"), F.sum("n")
    blocks = F.greatest(F.lit(1), F.least(F.ceil(m / BLOCK), F.lit(BLOCKS)), F.ceil(m / MOST_BLOCK), F.ceil(shingles_ / BLOCK_SHINGLES)).cast("int")
    groups = narrow(rows.groupBy(F.col("hub").alias("gh")).agg(blocks.alias("blocks"), F.min("c").alias("c0"), F.max("c").alias("c1")).where("c0 != c1").select("gh", "blocks"))
    block = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")
    each = narrow(rows.join(groups, F.col("hub") == F.col("gh"))).select("rep", "hub", "c", block.alias("block"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    each = materialise(each.select("rep", "hub", "c", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j")), "near-blocks", small=True)
    sets = materialise(_sets(texts.join(each.select("rep").distinct().hint("merge"), "rep", "left_semi")), "near-sets")

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("block")
        rep, c, block = (table.column(x).to_numpy() for x in ("rep", "c", "block"))
        h, counts = table.column("h").to_pylist(), table.column("counts").to_pylist()
        sizes = np.array([len(x) // 8 for x in h])
        count = np.concatenate([np.frombuffer(x, np.int32).astype(np.int64) if x else np.ones(k, np.int64) for x, k in zip(counts, sizes, strict=True)])
        split = int(np.searchsorted(block, block[-1]))
        if split == 0 and table.column("i")[0].as_py() != table.column("j")[0].as_py() or (c == c[0]).all():
            a = b = np.zeros(0, np.int64)  # one of the two blocks has no texts
        else:
            a, b = np.nonzero(may_be_similar(split, sizes, np.frombuffer(b"".join(h), np.uint64), count, threshold))
            b = b + split
            a, b = rep[a[c[a] != c[b]]], rep[b[c[a] != c[b]]]
        return pa.table({"a": pa.array(np.maximum(a, b), pa.int64()), "b": pa.array(np.minimum(a, b), pa.int64())})

    found = each.hint("merge").join(sets, "rep").groupBy("hub", "i", "j").applyInArrow(run, "a long, b long")
    out = materialise(found.distinct(), "near-direct", small=True)
    release(rows, each, sets)
    return out


def _left(pairs: DataFrame) -> tuple[int, int]:
    """Texts beside hubs, and pairs of them beside the same one."""
    m = F.col("m")
    return pairs.groupBy("hub").agg(F.count("*").alias("m")).agg(F.coalesce(F.sum(m), F.lit(0)), F.coalesce(F.sum((m * (m - 1)) / 2), F.lit(0))).first()


def _more_links(members: DataFrame, links: DataFrame, classes: DataFrame, texts: DataFrame, threshold: float) -> DataFrame | None:
    """Links (src, dst) between different classes that meet in a bucket; classes are (node, component).

    links are those so far, and pairs of one class that met in a bucket.  The place of a text is by their number, most first.  A group's hub has a place before all its other
    members, and a group of names outside it hasn't got it; so places of hubs rise from step to step, and the search ends.
    """
    placed = _classed(members, classes)
    mixed = narrow(placed.groupBy(F.col("key").alias("k")).agg(F.min("c").alias("c0"), F.max("c").alias("c1")).where("c0 != c1").select("k"))
    degree = narrow(links.select(F.explode(F.array("src", "dst")).alias("e")).groupBy("e").agg(F.count("*").alias("d")))
    mixed = narrow(placed.join(mixed, F.col("key") == F.col("k"))).join(degree, F.col("rep") == F.col("e"), "left")
    mixed = materialise(mixed.select("key", "rep", "n", F.struct((-F.coalesce("d", F.lit(0))).alias("d"), "rep").alias("place")), "near-mixed")
    pairs = materialise(_central_hubs(mixed), "near-pairs", small=True)
    release(mixed)
    links, direct, ties = [], [], None
    texts_left, pairs_left = first = _left(pairs)
    while texts_left:
        if pairs_left <= LAST_PAIRS * first[0]:
            direct.append(_all_pairs(pairs, classes, ties, texts, threshold))
            release(pairs)
            break
        least = narrow(pairs.groupBy("hub").agg(F.min("n").alias("least")))
        beside = materialise(beside_hubs(pairs.join(least, "hub").select(F.col("rep").alias("a"), F.col("hub").alias("b"), "least"), texts, threshold), "near-beside")
        links.append(materialise(beside.where(F.col("sim") >= threshold).select(F.col("rep").alias("src"), F.col("hub").alias("dst")), "near-found", small=True))
        ties = _ties(links[-1], classes, ties)
        after, small = _next_pairs(pairs, beside, classes, ties, threshold, len(direct))
        direct.append(small)
        release(pairs, beside)
        pairs = after
        texts_left, pairs_left = _left(pairs)
    if not direct:
        return None
    last = reduce(DataFrame.unionByName, direct).distinct()
    if links:
        # The links found beside hubs tie many classes together; of the pairs left over only those of different ones can add any.
        known = reduce(DataFrame.unionByName, links)
        ties = known.unionByName(classes.select(F.col("node").alias("src"), F.col("component").alias("dst")))
        last = _between(last, materialise(connected_components(ties, 2), "near-classes", small=True))
    last = verify(last, texts).where(F.col("sim") >= threshold).select(F.col("a").alias("src"), F.col("b").alias("dst"))
    return known.unionByName(last) if links else last


def _with_classes(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """pairs (a, b): adds same, whether both are known to be of one class."""
    first = _classed(pairs.select(F.col("a").alias("rep"), "b"), classes).select(F.col("rep").alias("a"), F.col("c").alias("ca"), F.col("b").alias("rep"))
    return _classed(first, classes).select("a", F.col("rep").alias("b"), (F.col("c") == F.col("ca")).alias("same"))


def _between(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs of different classes, written."""
    return materialise(_with_classes(pairs, classes).where("not same").drop("same"), "near-others", small=True)


def _bucket_pairs(band: DataFrame) -> DataFrame:
    """(a, b) of every member of a bucket and its hub, the greater row first."""
    return band.where("rep != hub").select(F.greatest("rep", "hub").alias("a"), F.least("rep", "hub").alias("b"))


def near_classes(rows: DataFrame, threshold: float = THRESHOLD, bands: int = BANDS, width: int = ROWS) -> DataFrame:
    """rows (row: a unique long, text): row, class_row (the least row of its class) and digest (of its words)."""
    rows = rows.select("row", F.col("text").cast("string").alias("text"))
    marks = materialise(sketch(rows, bands, width), "near-marks")
    reps = materialise(marks.groupBy("digest").agg(F.min("row").alias("rep")), "near-reps")
    # Each text once: the marks of its least row.
    own = materialise(marks.join(reps.select("rep"), F.col("row") == F.col("rep")).select("rep", "n", "keys"), "near-own")
    members = _hubs(own.select("rep", "n", F.explode("keys").alias("key")), "near-members")
    # Finer buckets of two and of four bands together: in a large group of loosely similar texts a hub drawn from one of
    # them is mostly a true neighbour, so that few classes are left to be tied together in other ways.
    fine = own.join(members.select("rep").distinct().hint("merge"), "rep", "left_semi")
    near = _hubs(fine.select("rep", "n", F.explode(F.concat(*[_joined_keys(k, bands) for k in (2, 4) if k <= bands], F.array().cast("array<bigint>"))).alias("key")), "near-fine")

    # Texts only of documents that share a bucket.
    texts = rows.withColumnRenamed("row", "rep").join(members.select("rep").distinct().hint("merge"), "rep", "left_semi")
    texts = materialise(texts, "near-texts")
    # Finer buckets first: their pairs are mostly links, and give most classes.  Of the other buckets' pairs only those of
    # different classes are left to be looked at; a pair in one class can't change it.
    first = _bucket_pairs(near).select("a", "b").distinct()
    links = materialise(verify(first, texts).where(F.col("sim") >= threshold).select(F.col("a").alias("src"), F.col("b").alias("dst")), "near-links")
    # Two rounds name most classes; the full answer follows when all links are known.
    classes = materialise(connected_components(links, 2), "near-classes", small=True)
    other = materialise(_with_classes(_bucket_pairs(members).distinct(), classes), "near-others", small=True)
    found = verify(other.where("not same").drop("same"), texts).where(F.col("sim") >= threshold).select(F.col("a").alias("src"), F.col("b").alias("dst"))
    links = materialise(links.unionByName(found), "near-links")
    beside = links.unionByName(other.where("same").select(F.col("a").alias("src"), F.col("b").alias("dst")))
    classes = materialise(connected_components(links.unionByName(classes.select(F.col("node").alias("src"), F.col("component").alias("dst"))), 2), "near-classes", small=True)
    release(own, near)
    more = _more_links(members, beside, classes, texts, threshold)
    known = links if more is None else links.unionByName(materialise(more, "near-more", small=True))
    classes = materialise(connected_components(known.unionByName(classes.select(F.col("node").alias("src"), F.col("component").alias("dst")))), "near-classes", small=True)
    release(members, texts, links, other)

    named = reps.join(classes, F.col("rep") == F.col("node"), "left").select(F.col("digest").alias("d"), F.coalesce("component", "rep").alias("class_row"))
    named = materialise(named, "near-named")
    release(reps, classes)
    return marks.join(named, F.col("digest") == F.col("d")).select("row", "class_row", "digest")


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, bands: int = BANDS, width: int = ROWS) -> DataFrame:
    """Classes of near duplicates: one row a document with doc_id, class_id and digest (of its words).

    class_id is the least doc_id of the class.  Two texts are linked if their probability Jaccard similarity on
    five-word shingles is ``threshold`` or more; equal word sequences are one text.  Defined cases: texts without
    words (null counts as empty) are linked only to equal texts; a text of fewer than five words is one shingle; rows
    with a null doc_id are compared like others, and class_id is null only where all rows of a class have none; rows with
    repeated doc_ids are compared row by row, and so may have different classes; very long texts are compared whole; an
    empty table gives no rows; other columns, whatever their names, are ignored.
    """
    docs = number_rows(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "row", nulls_last=True)
    found = near_classes(docs.select("row", "text"), threshold, bands, width)
    if not hasattr(docs, "_curvora_path"):  # doc_id is the key, and the row
        return found.select(F.col("row").alias("doc_id"), F.col("class_row").alias("class_id"), "digest")
    found = materialise(found, "near-found", small=True)
    ids = docs.select(F.col("row").alias("r"), "doc_id")
    least = found.join(ids, F.col("class_row") == F.col("r")).select(F.col("row").alias("cr"), "digest", F.col("doc_id").alias("class_id"))
    return least.join(ids, F.col("cr") == F.col("r")).select("doc_id", "class_id", "digest")


def op2_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents")).select("doc_id", "class_id")
