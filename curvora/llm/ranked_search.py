"""Ranked lexical search by best-first intervals of documents.

The index holds, for each document, its length and its counts of the queries' terms; it is written once, and the corpus
statistics (documents, terms, documents of each term) are sums over it.  Tasks then read it in segments of a bounded
number of postings.  In a segment every term has a posting list in order of documents, with the impact of each posting
and a sparse table of range maxima: the place of the largest impact among 2^j postings from each place on, so that two
look-ups give the maximum of any range.

A search opens the interval of all documents.  The sum of each term's range maximum bounds the score of every document
in an interval.  The intervals of highest bound are taken first, several at a time; each is split at the document of its
largest single impact, which is scored exactly, and leaves two intervals with bounds of their own.  Intervals whose
bound is below the k-th best score so far are dropped, as no document in them can be among the k best.  A task carries
that score from segment to segment; the tasks' k best of each query are ranked together at the end.

Scores are 64-bit integers, so that the order is the same on every machine.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialise, read_table
from .decontaminate import _blocks as query_blocks
from .decontaminate import words_of

#: Postings of a segment; intervals that one step of a search splits; bytes of queries that one scan answers.
SEGMENT_POSTINGS, STEP, QUERY_BYTES = 500_000, 48, 4 << 20
#: Documents returned for a query.
BEST = 10


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


class Ranking:
    """The k best (score, doc_id) so far: higher scores first, then lower doc_ids, null ones last."""

    def __init__(self, k: int):
        self.k, self.heap = k, []

    def add(self, score: int, doc_id: int | None) -> None:
        entry = (score, math.inf * -1 if doc_id is None else -doc_id)
        if len(self.heap) < self.k:
            heapq.heappush(self.heap, entry)
        elif entry > self.heap[0]:
            heapq.heapreplace(self.heap, entry)

    @property
    def least(self) -> int:
        """Scores below this are not among the best."""
        return self.heap[0][0] if len(self.heap) == self.k else 1

    def rows(self) -> Iterator[tuple[int, int | None]]:
        for score, doc in self.heap:
            yield score, None if doc == -math.inf else -doc


class Segment:
    """Posting lists of some documents.  Documents with equal counts and lengths have equal scores for every query and
    stand in the lists as one entry, with their doc_ids."""

    def __init__(self, owners: list[list[int | None]], lengths: np.ndarray, terms: np.ndarray, entries: np.ndarray, tf: np.ndarray, weights: np.ndarray, n_docs: int, n_terms: int):
        """owners and lengths by entry; terms, entries and tf by posting."""
        self.owners, self.size = owners, len(owners)
        key = terms.astype(np.int64) * self.size + entries
        order = np.argsort(key, kind="stable")
        self.key, terms, tf = key[order], terms[order], tf[order].astype(np.int64)
        m = 25 + 75 * lengths[entries[order]].astype(np.int64) * n_docs // max(n_terms, 1)
        self.impact = weights[terms] * (1_000_000_000 * tf // (1000 * tf + 8 * m))
        self.starts = np.searchsorted(terms, np.arange(len(weights) + 1))
        # Sparse tables of all lists end to end; a look-up stays in its list's range.
        n, longest = len(terms), int(np.diff(self.starts).max(initial=1))
        self.log = np.zeros(longest + 1, np.int64)
        for at in range(2, longest + 1):
            self.log[at] = self.log[at >> 1] + 1
        levels = [np.arange(n, dtype=np.int32)]
        for j in range(1, int(self.log[longest]) + 1):
            before, half = levels[-1], 1 << (j - 1)
            x, y = before[: n - half], before[half:]
            levels.append(np.append(np.where(self.impact[x] >= self.impact[y], x, y), before[n - half :]))
        self.table, self.width = np.concatenate(levels), n

    def maxima(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place and impact of the largest posting in each range [low, high); impact 0 where it is empty."""
        n = high - low
        full = n > 0
        level = self.log[n]
        row = level * self.width
        x = self.table[np.where(full, row + low, 0)]
        y = self.table[np.where(full, row + high - (1 << level), 0)]
        place = np.where(self.impact[x] >= self.impact[y], x, y)
        return place, np.where(full, self.impact[place], 0)

    def search(self, terms: np.ndarray, times: np.ndarray, best: Ranking) -> int:
        """Adds to the best documents of one query; returns how many documents were scored."""
        some = self.starts[terms + 1] > self.starts[terms]
        terms, times = terms[some], times[some]
        if not len(terms):
            return 0
        low, high = self.starts[terms][None, :], self.starts[terms + 1][None, :]
        place, top = self.maxima(low, high)
        top = top * times
        bound, scored, base = top.sum(1), 0, terms * self.size
        while len(bound):
            if len(bound) > STEP:
                now = np.argpartition(-bound, STEP)
                now, rest = now[:STEP], now[STEP:]
            else:
                now, rest = np.arange(len(bound)), np.zeros(0, np.int64)
            rows = np.arange(len(now))
            entry = self.key[place[now, top[now].argmax(1)]] % self.size  # the documents of the largest single impact
            at = np.searchsorted(self.key, base + entry[:, None])
            own_low, own_high = low[now], high[now]
            there = at < own_high
            there[there] = self.key[at[there]] == (base + entry[:, None])[there]
            score = np.where(there, self.impact[np.minimum(at, self.width - 1)] * times, 0).sum(1)
            scored += len(now)
            for i in rows[score >= best.least]:
                for doc_id in self.owners[entry[i]]:
                    best.add(int(score[i]), doc_id)
            new_low, new_high = np.concatenate([own_low, at + there]), np.concatenate([at, own_high])
            new_place, new_top = self.maxima(new_low, new_high)
            new_top = new_top * times
            new_bound = new_top.sum(1)
            keep, rest = new_bound >= best.least, rest[bound[rest] >= best.least]
            low, high, place, top = (np.concatenate([x[rest], y[keep]]) for x, y in ((low, new_low), (high, new_high), (place, new_place), (top, new_top)))
            bound = np.concatenate([bound[rest], new_bound[keep]])
        return scored


def index_terms(docs: DataFrame, terms: dict[bytes, int]) -> DataFrame:
    """doc_id, n (all terms of the whole text with repeats), and the counts of the given terms: terms, tf (arrays)."""
    sent = docs.sparkSession.sparkContext.broadcast(terms)
    names = ["doc_id", "n", "terms", "tf"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        for whole in batches:
            for start in range(0, whole.num_rows, 512):
                batch = whole.slice(start, 512)
                n, own, tf = [], [], []
                for text in batch.column("text"):
                    words = words_of(text.as_py())
                    counts = sorted((known[w], c) for w, c in Counter(words).items() if w in known)
                    n.append(len(words))
                    own.append([t for t, _ in counts])
                    tf.append([c for _, c in counts])
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(own, pa.list_(pa.int32())), pa.array(tf, pa.list_(pa.int64()))], names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, n long, terms array<int>, tf array<long>")


def segments(batches: Iterator[pa.RecordBatch], postings: int, *fixed) -> Iterator[Segment]:
    entry_of: dict[tuple[int, bytes, bytes], int] = {}
    owners, lengths, terms, tf, size = [], [], [], [], 0

    def made() -> Segment:
        own = np.repeat(np.arange(len(terms)), [len(t) for t in terms])
        return Segment(owners, np.array(lengths, np.int64), np.concatenate(terms), own, np.concatenate(tf), *fixed)

    for batch in batches:
        for doc_id, n, t, c in zip(batch.column("doc_id").to_pylist(), batch.column("n").to_pylist(), batch.column("terms"), batch.column("tf"), strict=True):
            t, c = (x.values.to_numpy(zero_copy_only=False) for x in (t, c))
            if not len(t):
                continue
            key = (n, t.tobytes(), c.tobytes())
            if key in entry_of:
                owners[entry_of[key]].append(doc_id)
                continue
            entry_of[key] = len(owners)
            owners.append([doc_id])
            lengths.append(n)
            terms.append(t)
            tf.append(c)
            size += len(t)
            if size >= postings:
                yield made()
                entry_of, owners, lengths, terms, tf, size = {}, [], [], [], [], 0
    if owners:
        yield made()


def _search(docs: DataFrame, items: list[tuple[int, str | None]], k: int, postings: int) -> DataFrame:
    spark = docs.sparkSession
    counted = [Counter(words_of(text)) for _, text in items]
    known = {w: i for i, w in enumerate(sorted(set().union(*counted)))}
    index = materialise(index_terms(docs, known), "postings")
    n_docs, n_terms = index.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = dict(index.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*")).collect())  # as many rows as the queries have terms
    weights = np.array([weight(n_docs, df.get(i, 0)) for i in range(len(known))], np.int64)
    queries = [(np.array(sorted(known[w] for w in c), np.int64), {known[w]: n for w, n in c.items()}) for c in counted]
    queries = [(t, np.array([n[i] for i in t.tolist()], np.int64)) for t, n in queries]
    sent = spark.sparkContext.broadcast((weights, queries))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, queries = sent.value
        best = [Ranking(k) for _ in queries]
        for segment in segments(batches, postings, weights, n_docs, n_terms):
            for (terms, times), own in zip(queries, best, strict=True):
                segment.search(terms, times, own)
        rows = [(q, doc, score) for q, own in enumerate(best) for score, doc in own.rows()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(3)], ["query", "doc_id", "score"])

    found = index.select("doc_id", "n", "terms", "tf").mapInArrow(run, "query long, doc_id long, score long")
    order = W.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    names = spark.createDataFrame([(q, i) for q, (i, _) in enumerate(items)], "query long, item_id long")
    return ranked.join(F.broadcast(names), "query").select("item_id", "rank", "doc_id", "score")


def ranked_search(docs: DataFrame, queries: DataFrame, k: int = BEST, query_bytes: int = QUERY_BYTES, postings: int = SEGMENT_POSTINGS) -> DataFrame:
    """The k documents of highest score for each query (item_id, text), over the whole texts of all documents.

    Returns item_id, rank (from 1), doc_id, score.  Queries are answered in blocks of a bounded size, each by a scan.
    Defined cases: null texts and texts without terms are no documents and match nothing; a query without terms, or
    whose terms no document has, gives no rows; only scores above 0 count; equal scores go by doc_id, null ones last;
    rows of one doc_id are documents of their own; equal rows of queries are one query, and rows of one item_id with
    other texts are ranked each by itself; empty tables give no rows; other columns are ignored.
    """
    parts = [_search(docs, block, k, postings) for block in query_blocks(queries, query_bytes)]
    if not parts:
        return docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_FOLD = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ORACLE = rf"""
with d as (select doc_id, regexp_extract_all({_FOLD}, '{_TERM}') ws from documents),
q as (select item_id, t, count(*) times from (select item_id, unnest(regexp_extract_all({_FOLD}, '{_TERM}')) t from benchmark) group by item_id, t),
s as (select count(*) n_docs, cast(sum(len(ws)) as bigint) n_terms from d where len(ws) > 0),
p as (select doc_id, t, count(*) tf, any_value(n) n from (select doc_id, len(ws) n, unnest(ws) t from d) where t in (select t from q) group by doc_id, t),
w as (select t, cast(floor(1000 * ln((2 * n_docs + 2) / (2 * df + 1))) as bigint) w from (select t, count(*) df from p group by t), s),
scored as (
  select item_id, doc_id, cast(sum(times * w.w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * n_docs) // n_terms)))) as bigint) score
  from q join p using (t) join w using (t), s group by item_id, doc_id)
select item_id, cast(rank as int) rank, doc_id, score
from (select *, row_number() over (partition by item_id order by score desc, doc_id) rank from scored where score > 0) where rank <= 10
"""
