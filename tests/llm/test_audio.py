"""Audio search against brute force over all pairs and offsets."""

from __future__ import annotations

import random

import numpy as np

from curvora.llm import audio

SCHEMA = "vec_id long, embedding array<float>, rec_id string, key int"


def brute(prints, asked):
    """(query, recording) whose best offset has few enough bit errors."""
    out = set()
    for q in asked:
        for r, p in prints.items():
            if r == q or not len(p) or not len(prints[q]):
                continue
            tries = [audio.bit_errors(prints[q], p, o) for o in range(-len(prints[q]) + audio.MIN_OVERLAP, len(p) - audio.MIN_OVERLAP + 1)]
            if any(e <= audio.MAX_BER and n >= audio.MIN_OVERLAP for e, n in tries):
                out.add((q, r))
    return out


def test_recall_of_the_search_and_odd_rows(spark):
    rnd = random.Random(5)
    vectors = [[rnd.uniform(-0.6, 0.6) for _ in range(64)] for _ in range(120)]
    rows = [(i, v, "x", i) for i, v in enumerate(vectors)]
    rows += [(200 + i, vectors[i], "x", i) for i in range(30)]  # copies
    rows += [(300 + i, [x if rnd.random() > 0.05 else x + 0.06 for x in vectors[i]], "x", i) for i in range(0, 40)]  # near copies
    rows += [(400, [], "x", 1), (401, None, "x", 1), (402, vectors[0][:3], "x", 1), (None, vectors[0], "x", 1), (None, None, "x", 1), (7, vectors[8], "x", 1), (404, [float("nan")] * 64, "x", 1)]
    recordings = audio.recordings_of(spark.createDataFrame(rows, SCHEMA), excerpts=True)
    prints = {r.rec_id: np.array(r.print, np.int32).view(np.uint32) for r in audio.fingerprints(recordings).collect() if r.rec_id not in (None, 14)}
    out = audio.search(recordings, audio.F.col("rec_id") % 20 == 0).toPandas()
    members, matches = out[out["kind"] == "member"], out[out["kind"] == "match"]
    assert len(members) == recordings.count()
    rep = dict(zip(members["rec_id"], members["query_id"], strict=True))
    assert rep[400] == 0 and rep[402] == 2  # copies of recordings 0 and 2
    classes = {}
    for r, c in rep.items():
        classes.setdefault(c, []).append(r)
    found = set()
    for q in (r for r in prints if r % 20 == 0):
        own = rep[q]
        for c in {own, *matches[matches["query_id"] == own]["rec_id"], *matches[matches["rec_id"] == own]["query_id"]}:
            found |= {(q, r) for r in classes[c] if r != q and r in prints and len(prints[r])}
    expect = brute(prints, [r for r in prints if r % 20 == 0])
    assert len(expect) > 25
    assert len(found & expect) >= 0.9 * len(expect)
    assert (matches["ber"] <= audio.MAX_BER).all() and (matches["overlap"] >= audio.MIN_OVERLAP).all()
    # every excerpt of a query is found at the place it was cut from
    for v in range(0, 120, 10):
        at = matches[(matches["query_id"] == 2 * v) & (matches["rec_id"] == 2 * v + 1)]
        assert at["offset"].tolist() == [-(8 + v % 16)]


def test_the_search_finds_all_that_its_rule_finds_without_an_index(spark):
    rnd = random.Random(6)
    common = [rnd.uniform(-0.6, 0.6) for _ in range(40)]  # a passage that all recordings have, here or there
    vectors = []
    for _ in range(60):
        at = rnd.randrange(25)
        vectors.append([rnd.uniform(-0.6, 0.6) for _ in range(at)] + common + [rnd.uniform(-0.6, 0.6) for _ in range(24 - at)])
    recordings = audio.recordings_of(spark.createDataFrame([(i, v, "x", i) for i, v in enumerate(vectors)], SCHEMA))
    table = audio.fingerprints(recordings)
    prints = {r.rec_id: np.array(r.print, np.int32).view(np.uint32) for r in table.collect()}
    want = {}
    for q in range(0, 60, 4):
        for r in range(60):
            a, b = prints[q], prints[r]
            votes = {}
            for i in range(len(a) - audio.GAP):
                for j in np.flatnonzero((b[: -audio.GAP] == a[i]) & (b[audio.GAP :] == a[i + audio.GAP])):
                    votes[int(j) - i] = votes.get(int(j) - i, 0) + 1
            offset = max(votes, key=lambda o: (votes[o], -abs(o), -o), default=None)
            if q != r and offset is not None and votes[offset] >= audio.MIN_VOTES:
                ber, n = audio.bit_errors(a, b, offset)
                if ber <= 0.5 and n >= audio.MIN_OVERLAP:
                    want[q, r] = (offset, votes[offset])
    found = audio.align(table.where("rec_id % 4 = 0"), table, max_ber=0.5)
    assert {(r.query_id, r.rec_id): (r.offset, r.votes) for r in found.collect()} == want and len(want) > 700


def test_search_of_nothing(spark):
    assert audio.search(audio.recordings_of(spark.createDataFrame([], SCHEMA), excerpts=True), audio.F.col("rec_id") % 20 == 0).count() == 0
