"""Pairs of a large group are counted block by block: none that is similar is left out, and no steps are made."""

from __future__ import annotations

import random

import numpy as np
import pytest
from test_graph_operators import brute_classes, docs, loose_family

from curvora.llm import minhash


@pytest.mark.parametrize("repeats", [False, True])
def test_shared_shingles_bound_the_similarity(monkeypatch, repeats):
    rnd = random.Random(5)
    monkeypatch.setattr(minhash, "COLUMNS", 3)
    passed = similar = all_pairs = 0
    for trial in range(60):
        monkeypatch.setattr(minhash, "RARE", (2, 8, 100)[trial % 3])
        base, tables = {x: rnd.choice([1, 1, 2, 5]) if repeats else 1 for x in rnd.sample(range(100), rnd.randrange(5, 60))}, []
        for _ in range(rnd.randrange(2, 30)):
            own = {x: n + (repeats and rnd.random() < 0.02) for x, n in base.items() if rnd.random() < 0.92}
            tables.append(own | {rnd.randrange(100, 300): 1 for _ in range(rnd.randrange(1, 3))})
        split = rnd.randrange(len(tables))
        h = np.concatenate([minhash.mix(np.array(sorted(t), np.uint64) + np.uint64(9)) for t in tables])
        count = np.concatenate([np.array([t[k] for k in sorted(t)]) for t in tables])
        may = minhash.may_be_similar(split, np.array([len(t) for t in tables]), h, count, 0.8)
        for i in range(split or len(tables)):
            for j in range(split or i + 1, len(tables)):
                sim = minhash.similarity(tables[i], tables[j])
                assert may[i, j - split] or sim < 0.8
                passed, similar, all_pairs = passed + may[i, j - split], similar + (sim >= 0.8), all_pairs + 1
    assert 20 < similar <= passed < all_pairs * 3 / 4 and (repeats or passed == similar)


def test_a_large_loose_group_takes_no_steps(spark, monkeypatch):
    def step(*_):
        raise AssertionError("a step was made")

    texts = loose_family(random.Random(11), 150) + loose_family(random.Random(12), 60, repeats=20)
    monkeypatch.setattr(minhash, "_next_pairs", step)
    monkeypatch.setattr(minhash, "BLOCK", 16)
    out = minhash.near_duplicates(docs(spark, texts)).toPandas().set_index("doc_id")["class_id"].to_dict()
    assert out == dict(enumerate(brute_classes(texts)))
