"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

The patterns are the windows of the benchmark: ten consecutive words of an item, or all words of a shorter one.  For
all patterns of one length the searcher keeps a shift table on blocks of two words: how far the end of the window
may move without passing a position where a pattern could end.  Where the shift is 0 the block is the suffix of some
patterns; those in its bucket are compared with the text directly.  Most steps over a clean text move by nine words.

The benchmark is the query set.  It is read in blocks of at most ``BLOCK_BYTES`` of text, each broadcast by itself;
a document's hits from all blocks are joined by an aggregation on its row, so no size of benchmark is refused.
"""

from __future__ import annotations

import string
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, read_table

#: Words of a window; bytes of benchmark text that one broadcast searcher is built from.
WINDOW, BLOCK_BYTES = 10, 8 << 20
#: A-Z become a-z; every other byte outside 0-9, a-z and 128-255 separates words.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

Words = list[bytes]


def words_of(text: str | None) -> Words:
    return (text or "").encode("utf-8").translate(FOLD).split()


class Searcher:
    """All patterns of one length in words."""

    def __init__(self, length: int, patterns: dict[tuple[bytes, ...], list[int]]):
        self.length, self.block = length, min(2, length)
        self.far = length - self.block + 1
        self.shift: dict[tuple[bytes, ...], int] = {}
        self.bucket: dict[tuple[bytes, ...], dict[tuple[bytes, ...], list[int]]] = defaultdict(dict)
        for pattern, items in patterns.items():
            for end in range(self.block, length + 1):
                key = pattern[end - self.block : end]
                self.shift[key] = min(self.shift.get(key, self.far), length - end)
            self.bucket[pattern[length - self.block :]][pattern] = items

    def search(self, words: Words) -> Iterator[tuple[int, list[int]]]:
        """(start, items) of every occurrence."""
        end, n, length, block, far, shift = self.length, len(words), self.length, self.block, self.far, self.shift.get
        while end <= n:
            key = tuple(words[end - block : end])
            step = shift(key, far)
            if step:
                end += step
                continue
            if items := self.bucket[key].get(tuple(words[end - length : end])):  # the direct comparison
                yield end - length, items
            end += 1


def searchers(items: list[tuple[int, str | None]], window: int = WINDOW) -> list[Searcher]:
    by_length: dict[int, dict[tuple[bytes, ...], list[int]]] = defaultdict(dict)
    for item_id, text in items:
        words = tuple(words_of(text))
        size = min(window, len(words))
        for at in range(len(words) - size + 1) if size else ():
            ids = by_length[size].setdefault(words[at : at + size], [])
            if not ids or ids[-1] != item_id:
                ids.append(item_id)
    return [Searcher(size, patterns) for size, patterns in sorted(by_length.items())]


def _blocks(benchmark: DataFrame, block_bytes: int) -> Iterator[list[tuple[int, str | None]]]:
    """The items, a bounded number of bytes at a time."""
    out, size = [], 0
    for row in benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).distinct().toLocalIterator():
        out.append((row[0], row[1]))
        size += len((row[1] or "").encode("utf-8")) + 64
        if size >= block_bytes:
            yield out
            out, size = [], 0
    if out:
        yield out


SCHEMA = "doc_id long, n_words long, hits array<struct<start:int,end:int>>, items array<long>"


def _scan(docs: DataFrame, items: list[tuple[int, str | None]], window: int) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast(items)
    arrow = pa.schema([("__row", pa.int64()), ("doc_id", pa.int64()), ("n_words", pa.int64()), ("hits", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), ("items", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = searchers(sent.value, window)
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                n_words, hits, ids = [], [], []
                for text in batch.column("text"):
                    words, spans, items = words_of(text.as_py()), [], set()
                    for s in found:
                        for start, own in s.search(words):
                            items.update(own)
                            spans.append((start, start + s.length))
                    n_words.append(len(words))
                    hits.append([{"start": a, "end": b} for a, b in merged(spans)])
                    ids.append(sorted(i for i in items if i is not None))
                yield pa.RecordBatch.from_arrays([batch.column("__row"), batch.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(hits, arrow.field("hits").type), pa.array(ids, arrow.field("items").type)], schema=arrow)

    return docs.mapInArrow(run, "__row long, " + SCHEMA)


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Union of intervals, as disjoint ones in order."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Find every occurrence of a benchmark window in every whole document.

    Returns doc_id, n_words, hits (disjoint word intervals), items (ids with an occurring window, ascending).
    Defined cases: null texts and texts without words have no windows and no hits; items of fewer than ``window``
    words are one window; repeated items count once; an item with a null id marks words but is not listed; null and
    repeated doc_ids give a row for each row; an empty benchmark hits nothing; other columns are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    blocks = _blocks(benchmark, block_bytes)
    first, second = next(blocks, []), next(blocks, None)
    if second is None:
        return _scan(docs.withColumn("__row", F.lit(0).cast("long")), first, window).drop("__row")
    docs = materialise(docs.withColumn("__row", F.monotonically_increasing_id()), "decontaminate")  # ids must not change between scans
    parts = [_scan(docs, b, window) for b in (first, second)]
    parts += [_scan(docs, b, window) for b in blocks]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    rows = rows.groupBy("__row").agg(F.first("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"), F.collect_list("hits").alias("h"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))

    def union(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hits = [[{"start": a, "end": b} for a, b in merged([(x["start"], x["end"]) for y in lists for x in y])] for lists in batch.column("h").to_pylist()]
            kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_words"), pa.array(hits, kind), batch.column("items")], ["doc_id", "n_words", "hits", "items"])

    return rows.select("doc_id", "n_words", "h", "items").mapInArrow(union, SCHEMA)


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda s, x: s + x["end"] - x["start"])
    # array_join over the sorted strings: the items column is short (ids of one document's hits)
    ids = F.array_sort(F.transform("items", lambda x: x.cast("string")))
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


_UPPER, _LOWER = string.ascii_uppercase, string.ascii_lowercase
ORACLE = rf"""
with w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') ws from documents),
b as (
  select item_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') ws from benchmark),
pat as (
  select distinct item_id, least(10, len(ws)) m, ws[i:i + least(10, len(ws)) - 1] p
  from (select item_id, ws, unnest(range(1, len(ws) - least(10, len(ws)) + 2)) i from b where len(ws) > 0)),
sizes as (select distinct m from pat),
win as (
  select doc_id, i, m, ws[i:i + m - 1] p
  from (select doc_id, ws, m, unnest(range(1, len(ws) - m + 2)) i from w, sizes where len(ws) >= m)),
occ as (select win.doc_id, win.i, win.m, pat.item_id from win join pat on win.m = pat.m and win.p = pat.p),
hit as (select doc_id, count(*) n_hit from (select distinct doc_id, unnest(range(i, i + m)) x from occ) group by doc_id),
it as (select doc_id, count(*) n_items, string_agg(s, ',' order by s) ids from (select distinct doc_id, cast(item_id as varchar) s from occ) group by doc_id)
select w.doc_id, cast(len(ws) as bigint) n_words, cast(coalesce(n_hit, 0) as bigint) n_hit, cast(coalesce(n_items, 0) as bigint) n_items,
  sha256(coalesce(ids, '')) items_sha256, coalesce(n_hit, 0) > 0 contaminated
from w left join hit using (doc_id) left join it using (doc_id)
"""
