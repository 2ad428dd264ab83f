"""Which texts of a name may still be linked to one of another class."""

from __future__ import annotations

import random

from curvora.llm import minhash

SCHEMA = "key long, rep long, c long, has long, needs long"


def test_only_the_needs_of_other_classes_keep_a_text(spark):
    # Class 2 isn't the one of most texts: its own need of 1 must not keep its text where all others need 5.
    rows = [(1, 10, 1, 9, 5), (1, 11, 1, 9, 5), (1, 20, 2, 3, 1), (2, 30, 3, 4, 0)]
    rnd = random.Random(3)
    rows += [(10 + rnd.randrange(40), 100 + i, rnd.randrange(5), rnd.randrange(8), rnd.randrange(8)) for i in range(300)]
    kept = {(r.key, r.rep, r.c) for r in minhash._viable(spark.createDataFrame(rows, SCHEMA)).collect()}
    want = {(k, r, c) for k, r, c, has, _ in rows if any(k == k2 and c != c2 and needs <= has for k2, _, c2, _, needs in rows)}
    assert kept == want and 50 < len(kept) < 300 and (1, 20, 2) not in kept


def test_classes_of_a_name_are_not_joined_with_each_other(spark):
    # A hot name has a row for each of its texts, before and after; its classes make two rows, however many they are.
    plan = minhash._viable(spark.createDataFrame([(1, i, i, 2, 1) for i in range(50)], SCHEMA))
    assert plan.count() == 50
    assert plan._jdf.queryExecution().analyzed().toString().count("Join ") == 1
