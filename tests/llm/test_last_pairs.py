"""The last pairs of the search for near duplicates: none that may be similar is left out, and few steps are made."""

from __future__ import annotations

import random

from pyspark.sql import functions as F
from test_graph_operators import brute_classes, docs, loose_family

from curvora.llm import minhash


def test_pairs_that_can_be_similar_pass_the_sizes(spark):
    rnd = random.Random(8)
    sets = []
    for _ in range(40):
        base = rnd.sample(range(300), rnd.randrange(8, 60))
        sets += [set(base[: rnd.randrange(5, len(base) + 1)]) | set(rnd.sample(range(300), rnd.randrange(4))) for _ in range(4)]
    hub = set(range(0, 300, 2))
    rows = [(i, j, len(x), len(x - hub), len(y), len(y - hub), len(x & y) / len(x | y)) for i, x in enumerate(sets) for j, y in enumerate(sets) if i < j]
    may = minhash._may_link(F.col("n"), F.col("has"), F.lit(0), F.col("n2"), F.col("has2"), F.lit(0), F.lit(True), 0.8)
    out = spark.createDataFrame(rows, "i long, j long, n long, has long, n2 long, has2 long, sim double").withColumn("may", may).collect()
    similar = [r for r in out if r.sim >= 0.8]
    assert len(similar) > 15 and all(r.may for r in similar)
    assert sum(not r.may for r in out) > len(out) / 2


def test_few_pairs_are_compared_without_further_steps(spark, monkeypatch):
    texts = loose_family(random.Random(11), 50) + loose_family(random.Random(12), 30, repeats=20)
    steps = []
    later, last = minhash._next_pairs, minhash._all_pairs
    monkeypatch.setattr(minhash, "_next_pairs", lambda *a: steps.append("next") or later(*a))
    monkeypatch.setattr(minhash, "_all_pairs", lambda *a: steps.append("last") or last(*a))
    classes = lambda: minhash.near_duplicates(docs(spark, texts)).toPandas().set_index("doc_id")["class_id"].to_dict()
    want = dict(enumerate(brute_classes(texts)))
    monkeypatch.setattr(minhash, "LAST_PAIRS", 100)
    assert classes() == want and steps == ["last"]
    steps.clear()
    monkeypatch.setattr(minhash, "LAST_PAIRS", -1)
    assert classes() == want and set(steps) == {"next"}
