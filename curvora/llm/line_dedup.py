"""Repeated line runs by a suffix array over line ids, built by distributed prefix doubling.

Line ids are ranks of distinct lines.  Doubling level k ranks the runs of 2^k lines that start at each position: a run's
key is the pair of the ranks of its halves, distinct keys are counted, range-partitioned and sorted, and their place in
that order is the new rank, so positions in order of rank are the suffix array sorted to depth 2^k.  Positions of one rank
are an interval of it with a longest common prefix of 2^k lines or more.  A run that occurs once can be part of no longer
repeated run, so its position leaves the table; it shrinks from level to level, and only keys seen twice are ever joined.

A run is deleted where an equal run stands earlier (in order of doc_id and line) and has ``min_words`` words or more.
Every such maximal run is the union of its minimal stretches of ``min_words`` words, read forwards from each of its lines
and backwards from its last one; a stretch of l lines is named by the ranks of its first and last 2^k lines, 2^k <= l.
Doubling ends when 2^(k+1) exceeds the longest stretch.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import fresh, is_empty, materialise, number_rows, read_table, release

#: Words that a repeated run has at least.
MIN_WORDS = 50


def _ranks(rows: DataFrame, a: str, b: str, label: str) -> DataFrame:
    """(ka, kb, rank) of the keys that at least two rows have; the rank follows the order of the keys."""
    keys = rows.groupBy(a, b).agg(F.count("*").alias("n")).where("n > 1").select(F.col(a).alias("ka"), F.col(b).alias("kb"))
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return materialise(keys.repartitionByRange(n, "ka", "kb").sortWithinPartitions("ka", "kb").withColumn("rank", F.monotonically_increasing_id()), label)


def _named(rows: DataFrame, a: str, b: str, ranks: DataFrame) -> DataFrame:
    return rows.join(ranks, (rows[a] == ranks["ka"]) & (rows[b] == ranks["kb"]))


def lines_of(docs: DataFrame) -> DataFrame:
    """One row a line, split at line feeds: row, pos, h1 and h2 (128 bits of the line), words."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    lines = docs.select(F.col("__row").alias("row"), F.posexplode(F.split(text, "\n", -1)).alias("pos", "line"))
    words = F.size(F.filter(F.split(F.col("line"), r"\s+"), lambda x: x != ""))
    return lines.select("row", "pos", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2"), words.alias("words"))


def _stretches(lines: DataFrame, min_words: int) -> DataFrame:
    """Minimal stretches of min_words words among consecutive repeated lines: (row, a, n) from line a on, n lines."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, starts, sizes = [], [], []
            for row, found in zip(batch.column("row").to_pylist(), batch.column("found").to_pylist(), strict=True):
                found = sorted((x["pos"], x["words"]) for x in found)
                i = 0
                while i < len(found):
                    j = i + 1
                    while j < len(found) and found[j][0] == found[j - 1][0] + 1:
                        j += 1
                    own: set[tuple[int, int]] = set()
                    end, total = i, 0
                    for start in range(i, j):  # forwards
                        while end < j and total < min_words:
                            total += found[end][1]
                            end += 1
                        if total < min_words:
                            break
                        own.add((found[start][0], end - start))
                        total -= found[start][1]
                    start, total = j - 1, 0
                    for last in range(j - 1, i - 1, -1):  # backwards
                        while start >= i and total < min_words:
                            total += found[start][1]
                            start -= 1
                        if total < min_words:
                            break
                        own.add((found[start + 1][0], last - start))
                        total -= found[last][1]
                    rows += [row] * len(own)
                    starts += [a for a, _ in own]
                    sizes += [n for _, n in own]
                    i = j
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(starts, pa.int32()), pa.array(sizes, pa.int32())], ["row", "a", "n"])

    grouped = lines.groupBy("row").agg(F.collect_list(F.struct("pos", "words")).alias("found"))
    return grouped.mapInArrow(run, "row long, a int, n int")


def repeated_runs(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """Line intervals to delete: (row, a, n), where row is __row of ``docs``, a unique long in order of precedence."""
    lines = materialise(lines_of(docs), "line-lines")
    ids = _ranks(lines, "h1", "h2", "line-ids")
    level = materialise(_named(lines, "h1", "h2", ids).select("row", "pos", "words", F.col("rank").alias("r")), "line-level0")
    release(ids, lines)
    stretches = materialise(_stretches(level, min_words), "line-stretches")
    longest = stretches.agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]

    # k of a stretch of n lines: the largest with 2^k <= n
    waiting = stretches.withColumn("k", F.length(F.bin("n")) - 1).withColumn("step", F.expr("shiftleft(1, k)"))
    found, k = None, 0
    level = level.drop("words")
    while (1 << k) <= longest and not is_empty(level):
        own = waiting.where(F.col("k") == k)
        first = level.select(F.col("row").alias("r1"), F.col("pos").alias("p1"), F.col("r").alias("ra"))
        last = level.select(F.col("row").alias("r2"), F.col("pos").alias("p2"), F.col("r").alias("rb"))
        if k:
            named = own.join(first, (F.col("row") == F.col("r1")) & (F.col("a") == F.col("p1")))
            named = named.join(last, (F.col("row") == F.col("r2")) & (F.col("a") + F.col("n") - F.col("step") == F.col("p2"))).select("row", "a", "n", "ra", "rb")
        else:
            named = own.join(first, (F.col("row") == F.col("r1")) & (F.col("a") == F.col("p1"))).select("row", "a", "n", "ra", F.lit(0).cast("long").alias("rb"))
        named = materialise(named, "line-named")
        # the first occurrence of each interval stays
        earliest = named.groupBy("n", "ra", "rb").agg(F.min(F.struct("row", "a")).alias("first"), F.count("*").alias("c")).where("c > 1")
        earliest = materialise(earliest.select(F.col("n").alias("en"), F.col("ra").alias("ea"), F.col("rb").alias("eb"), "first"), "line-first")
        later = named.join(earliest, (F.col("n") == F.col("en")) & (F.col("ra") == F.col("ea")) & (F.col("rb") == F.col("eb")))
        later = later.where(F.struct("row", "a") > F.col("first")).select("row", "a", "n")
        found = later if found is None else found.unionByName(later)
        k += 1
        if (1 << k) > longest:
            break
        half = 1 << (k - 1)
        w = W.partitionBy("row").orderBy("pos")
        pairs = level.withColumn("p2", F.lead("pos", half).over(w)).withColumn("r2", F.lead("r", half).over(w)).where(F.col("p2") == F.col("pos") + half).select("row", "pos", "r", "r2")
        pairs = materialise(pairs, "line-pairs")
        ranks = _ranks(pairs, "r", "r2", "line-ranks")
        after = materialise(_named(pairs, "r", "r2", ranks).select("row", "pos", F.col("rank").alias("r")), f"line-level{k}")
        release(level, pairs, ranks)
        level = after
    return found if found is not None else stretches.limit(0)


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS, columns: tuple[str, str, str] = ("kept_text", "n_lines", "n_deleted")) -> DataFrame:
    """Delete later copies of maximal repeated line runs; adds ``columns``: the kept text, lines and deleted lines of a row.

    Later means later in order of doc_id, then of the row (rows of one doc_id are ordered by a hash of their texts), then
    of the line.  A run is deleted if it has ``min_words`` words or more, so short common lines stay.  Defined cases: a
    null text has no lines and its kept text is null; an empty text is one empty line; a document all of whose lines are
    deleted keeps an empty text; rows with a null doc_id come first; repeated rows are copies like any other; very long
    texts are read whole; an empty table gives no rows; other columns are kept, but for any named like one of ``columns``.
    """
    kept_columns = [c for c in docs.columns if c.lower() not in {x.lower() for x in columns}]
    row, joined_row, spans_name, cut_name = fresh([*docs.columns, *columns], "__row", "__r", "__spans", "__cut")
    numbered = number_rows(docs.select(*kept_columns), row)
    runs = repeated_runs(numbered.where(F.col("text").isNotNull()).select(F.col(row).alias("__row"), "text"), min_words)
    spans = materialise(runs.groupBy("row").agg(F.collect_set(F.struct("a", "n")).alias(spans_name)).select(F.col("row").alias(joined_row), spans_name), "line-spans")

    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, spans in batches:
            out = []
            for text, own in zip(texts, spans, strict=True):
                if text is None:
                    out.append((None, 0, 0))
                    continue
                lines, gone = text.split("\n"), set()
                for x in own if own is not None else ():
                    gone.update(range(x["a"], x["a"] + x["n"]))
                out.append(("\n".join(x for i, x in enumerate(lines) if i not in gone) if gone else text, len(lines), len(gone)))
            yield pd.DataFrame(out, columns=["kept_text", "n_lines", "n_deleted"])

    run.__annotations__ = {"batches": Iterator[tuple[pd.Series, pd.Series]], "return": Iterator[pd.DataFrame]}
    cut = F.pandas_udf(run, "kept_text string, n_lines long, n_deleted long")
    # A merge join at every size: the spans grow with the corpus, so they are never broadcast.
    joined = numbered.join(spans.hint("merge"), numbered[row] == spans[joined_row], "left")
    found = [F.col(f"{cut_name}.{own}").alias(name) for own, name in zip(("kept_text", "n_lines", "n_deleted"), columns, strict=True)]
    return joined.withColumn(cut_name, cut(F.col("text").cast("string"), spans_name)).select(*kept_columns, *found)


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", F.col("kept_text").alias("text"), "n_lines", "n_deleted")
