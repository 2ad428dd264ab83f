"""Ranked search against scoring every document, with the defined odd cases."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np

from curvora.llm.ranked_search import Ranking, ranked_search, segments

SCHEMA = "doc_id long, text string, score string, rank int, query long"


def table(spark, rows):
    return spark.createDataFrame([(i, t, "s", 1, 2) for i, t in rows], SCHEMA)


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plainly(docs, items, k):
    counts = [(i, Counter(words(t)), len(words(t))) for i, t in docs]
    n_docs, total = sum(n > 0 for _, _, n in counts), sum(n for _, _, n in counts)
    df = Counter(w for _, c, _ in counts for w in c)
    out = []
    for item, text in dict.fromkeys(items):
        scored = []
        for i, c, n in counts:
            m = 25 + 75 * n * n_docs // max(total, 1)
            score = sum(q * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * (1_000_000_000 * c[w] // (1000 * c[w] + 8 * m)) for w, q in Counter(words(text)).items() if c[w])
            if score > 0:
                scored.append((-score, i is None, i, score))
        out += [(item, r, i, s) for r, (_, _, i, s) in enumerate(sorted(scored, key=lambda x: x[:2] + (x[2] or 0,))[:k], 1)]
    return sorted(out, key=str)


def result(frame):
    assert frame.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted(map(tuple, frame.collect()), key=str)


def corpus(seed, n):
    rnd = random.Random(seed)
    vocab = ["".join(rnd.choice("abcdeé日1") for _ in range(rnd.randrange(1, 5))) for _ in range(80)]
    text = lambda: " ".join(rnd.choice(vocab[: rnd.choice([5, 20, 80])]) for _ in range(rnd.randrange(1, 60)))
    docs = [(i, text()) for i in range(n)]
    docs += [(n + i, docs[i % 3][1]) for i in range(40)]  # large groups of copies: ties
    return docs, [(i, text()) for i in range(12)]


def test_best_documents_at_any_size_of_segments(spark):
    docs, items = corpus(1, 300)
    queries = table(spark, items).withColumnRenamed("doc_id", "item_id")
    want = plainly(docs, items, 10)
    for postings in (40, 500_000):
        assert result(ranked_search(table(spark, docs).repartition(3), queries, postings=postings)) == want
    assert result(ranked_search(table(spark, docs), queries, k=3, query_bytes=300)) == plainly(docs, items, 3)  # several blocks of queries


def test_odd_rows(spark):
    docs = [(None, "Alpha beta"), (1, None), (2, ""), (3, " .,;"), (4, "alpha beta"), (4, "ALPHA beta"), (5, "alpha " * 5000), (6, "Über alpha"), (7, "über")]
    items = [(0, "alpha, BETA beta"), (1, None), (2, "..."), (3, "nothing of it"), (4, "Über"), (0, "alpha, BETA beta"), (0, "über"), (None, "beta")]
    queries = table(spark, items).withColumnRenamed("doc_id", "item_id")
    assert result(ranked_search(table(spark, docs), queries)) == plainly(docs, items, 10)
    assert result(ranked_search(table(spark, []), queries)) == []
    assert result(ranked_search(table(spark, docs), table(spark, []).withColumnRenamed("doc_id", "item_id"))) == []


def test_most_documents_are_never_scored():
    import pyarrow as pa

    rnd = random.Random(4)
    rows = [sorted({t: rnd.randrange(1, 4) for t in rnd.sample(range(50), 8)}.items()) for _ in range(3000)]
    for i in range(10):
        rows[i * 300] = [(t, 9) for t in range(20)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(3000)), pa.array([40 + i % 60 for i in range(3000)]), pa.array([[t for t, _ in r] for r in rows], pa.list_(pa.int32())), pa.array([[c for _, c in r] for r in rows], pa.list_(pa.int64()))], ["doc_id", "n", "terms", "tf"])
    (segment,) = segments(iter([batch]), 10**9, np.full(50, 2000, np.int64), 3000, 200_000)
    best = Ranking(10)
    scored = segment.search(np.arange(20), np.ones(20, np.int64), best)
    assert sorted(d for _, d in best.rows()) == [i * 300 for i in range(10)] and scored < 600
