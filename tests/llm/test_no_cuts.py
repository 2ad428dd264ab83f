"""Nothing is cut off: lexicons of any size, links of any length, whole words of contexts, ranks beyond one bucket."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter

from pyspark.sql import functions as F

from curvora.llm import pii, sharding, toxicity
from curvora.llm.decontaminate import contamination
from curvora.llm.url_filter import absolute


def test_a_lexicon_keeps_all_its_terms():
    words = [f"w{i:04d}x" for i in range(2500)]
    kept = toxicity._lexicon(dict.fromkeys(words, 40), {}, 400, 400)
    assert len(kept) == 2500


def test_a_long_link_is_resolved_whole(spark):
    for path in ("a/" * 600_000 + "end", "b" * 1_200_000, "../" + "c" * 1_200_000 + "/./d"):
        row = spark.createDataFrame([(path, "http://h.com/x/y?q#f")], "link string, base string").select(absolute(F.col("link"), F.col("base")).alias("u")).first()
        assert row.u == "http://h.com/" + (path.removeprefix("../").replace("/./", "/") if "." in path else "x/" + path)


def test_contexts_are_made_of_whole_words():
    one, two = "a" * 60 + "x", "b" * 60 + "y"
    texts = [f"zz {two} {one}: 12345 {one}z.", f"zz {two} {'c' + one[1:]}: 12345 {one}q.", f"{one}: 12345"]
    found = [pii._contexts(t, t.index("12345"), t.index("12345") + 5) for t in texts]
    assert found[0] == [f"L {one} :", f"B {one} : _ {one}z", f"LL {two}  {one} :"]
    assert not set(found[0]) & set(found[1]) and found[2] == [f"L {one} :", f"B {one} : _ "]
    assert pii._contexts("first line ends\nkey= 77", 21, 23) == ["L key =", "B key = _ "]
    assert pii._contexts("77", 0, 2) == []


def test_contexts_of_a_long_line_take_linear_time():
    import time

    text = "k=1," * 100_000
    began = time.perf_counter()
    for at in range(2, len(text), 40):
        pii._contexts(text, at, at + 1)
    assert time.perf_counter() - began < 5


def plain_shards(rows, n_shards, seed=17):
    """Ranks by sorting whole sources, positions by sorting all rows."""
    key = lambda i: int(hashlib.md5(f"{seed}:{'null' if i is None else i}".encode()).hexdigest()[:12], 16)
    own = [(key(i), i, zlib.crc32((t or "").encode()), len((t or "").encode()) + 1, s) for i, t, s in rows]
    ranked = []
    for source in {r[4] for r in own}:
        mine = sorted((r for r in own if r[4] == source), key=lambda r: r[:4])
        ranked += [((k + 0.5) / len(mine), source, *r[:4]) for k, r in enumerate(mine)]
    out = {}
    for at, r in enumerate(sorted(ranked)):
        shard = ((at + 1) * n_shards - 1) // len(rows)
        out[r[3]] = (shard, at - shard * len(rows) // n_shards)
    return out


def test_ranks_go_on_from_bucket_to_bucket(spark, monkeypatch):
    monkeypatch.setattr(sharding, "BUCKET_ROWS", 16)
    rnd = random.Random(3)
    rows = [(i, f"text {i % 70}", "hot" if rnd.random() < 0.6 else f"s{i % 5}") for i in range(700)]
    out = sharding.interleave(spark.createDataFrame(rows, "doc_id long, text string, source string"), 7).collect()
    assert {r.doc_id: (r.shard, r.slot) for r in out} == plain_shards(rows, 7)


def test_hits_of_several_blocks_are_merged(spark):
    words = [f"w{i}" for i in range(60)]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, None), (1, " ".join(words[:12])), (None, "none of it")], "doc_id long, text string")
    items = spark.createDataFrame([(k, " ".join(words[5 * k : 5 * k + 12])) for k in range(8)], "item_id long, text string")
    whole, parts = (contamination(docs, items, block_bytes=b).select("doc_id", "n_words", F.to_json("hits"), "items").collect() for b in (1 << 20, 80))
    assert Counter(map(str, whole)) == Counter(map(str, parts)) and len(whole) == 4
