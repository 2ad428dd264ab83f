"""Token counts by prefix against the sentencepiece library on every prefix; alignments against loops over all pairs."""

from __future__ import annotations

import hashlib
import random
from collections import Counter as PairCounts

import numpy as np
import pytest

from curvora.llm.alignment import Csr, aligner, alignment, linked_counts, tokenizer_files
from curvora.llm.token_counts import Counter, model_file, op13_token_counts, token_counts, tokens_before, truncated, window_starts

SCHEMA = "doc_id long, text string, counts string, n_bytes int, n_tokens string"
ODD = [
    None, "", " ", "  ", "\n\t", " a", "a" * 3000, "▁x ▁", "<s>hi</s><unk><0x0A>", "日本語テキスト", "naïve ÿ́e", "²..  ²", "x\x00y\x1c", "𝔘𝔫𝔦 emoji 😀👍🏽",
    "   lead    and trail   ", "12345 67,890.12", "अनुच्छेद कि", "ﬁ½ Ⅷ", "word " * 3000, "same", "same",
]


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=model_file())


def table(spark, texts, ids=None):
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, "k", 1, "x") for i, t in zip(ids, texts, strict=True)], SCHEMA)


def test_every_prefix_counts_as_the_library_counts_it(library):
    rnd, own = random.Random(5), Counter(model_file())
    texts = [t for t in ODD if len(t or "") < 100] + ["".join(rnd.choice("abcdethin .,;-_()éß'\"12\n 日▁") for _ in range(rnd.randrange(1, 60))) for _ in range(300)]
    for text, counts in zip(texts, own.count_many(texts), strict=True):
        assert counts.tolist() == [len(library.encode((text or "")[:i])) for i in range(len(text or "") + 1)], text


def test_documents_and_odd_rows(spark, library):
    out = sorted(token_counts(table(spark, ODD, [None, *[7] * (len(ODD) - 1)]), model_file()).collect(), key=str)
    want = sorted((None if i == 0 else 7, len((t or "").encode()), len(library.encode(t or ""))) for i, t in enumerate(ODD) if i)
    assert sorted((r.doc_id, r.n_bytes, r.n_tokens) for r in out if r.doc_id is not None) == want
    assert all(len(r.counts) >= 1 and r.counts[-1] == r.n_tokens for r in out)
    assert [(r.n_bytes, r.n_tokens, r.counts) for r in out if r.doc_id is None] == [(0, 0, [0])]
    empty = token_counts(table(spark, []), model_file())
    assert empty.columns == ["doc_id", "n_bytes", "n_tokens", "counts"] and empty.count() == 0


def test_questions_without_encoding_again(spark, library):
    rnd = random.Random(6)
    texts = ["".join(rnd.choice(["the ", "un", "happi", "ness ", "日", "12", "  "]) for _ in range(30)) for _ in range(20)] + ["", "😀"]
    limit = 7
    stored = token_counts(table(spark, texts), model_file())
    rows = {r.doc_id: r for r in stored.select("doc_id", "counts", tokens_before(5).alias("five"), truncated(limit).alias("cut"), truncated(0).alias("none"), window_starts(limit).alias("starts")).collect()}
    for i, text in enumerate(texts):
        count = [len(library.encode(text[:k])) for k in range(len(text) + 1)]
        assert rows[i].five == (count[5] if len(text) >= 5 else None)
        assert rows[i].cut == max(k for k, c in enumerate(count) if c <= limit)
        assert rows[i].none == 0
        assert rows[i].starts == [max(k for k, c in enumerate(count) if c <= j * limit) for j in range(max(0, (count[-1] - 1) // limit) + 1)]


def test_the_query_over_its_table(spark, sf, library):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    out = op13_token_counts(spark, sf).collect()
    assert len(out) == len(texts)
    assert {r.doc_id: tuple(r)[1:] for r in out} == {i: (len(t.encode()), n := len(library.encode(t)), n > 4096) for i, t in texts.items()}


ALIGNED = [t for t in ODD if len(t or "") < 1000] + ["a" * 300, "0x00ff12ab34 " * 5, "The quick brown fox", " lead", "\x00\x01", "word,\n next  one", "x y \x1c z"]


def plainly_aligned(text):
    """Tokens, groups and links of one text by loops over all pairs of tokens."""
    own = aligner(*tokenizer_files())
    raw = b" " + (text or "").encode()
    a, b = own.a.encode(" " + (text or ""), add_special_tokens=False).ids, own.b.encode(text or "")
    if not text or b"".join(own.a_bytes[i] for i in a) != raw or b"".join(own.b_bytes[i] for i in b) != raw:
        return [], [], [], [], {}, {}
    spans = []
    for ids, names in ((a, own.a_bytes), (b, own.b_bytes)):
        at, out = 0, []
        for i in ids:
            out.append((at, at + len(names[i])))
            at += len(names[i])
        spans.append(out)
    cuts = sorted({e for _, e in spans[0]} & {e for _, e in spans[1]})
    a_group, b_group = ([sum(c <= s for c in cuts) for s, _ in side] for side in spans)
    links, overlap = PairCounts(), {}
    for i, (s, e) in enumerate(spans[0]):
        for j, (t, u) in enumerate(spans[1]):
            links[a[i], b[j]] += a_group[i] == b_group[j]
            if min(e, u) > max(s, t):
                overlap[i, j] = min(e, u) - max(s, t)
    return a, b, a_group, b_group, +links, overlap


def test_sparse_products_equal_dense_ones():
    rnd = np.random.default_rng(2)
    for _ in range(20):
        x, y = (rnd.integers(0, 3, (rnd.integers(1, 8), 5)) for _ in range(2))
        a, b = (Csr.summed(*np.nonzero(m), m[np.nonzero(m)], *m.shape) for m in (x, y))
        out, dense = a.times(b.transposed()), np.zeros((len(x), len(y)), int)
        dense[out.rows(), out.indices] = out.values
        assert (dense == x @ y.T).all() and (np.diff(out.rows() * 10 + out.indices) > 0).all()


def test_tokens_groups_and_overlaps_of_each_text(spark):
    rows = {r.doc_id: r for r in alignment(table(spark, ALIGNED), *tokenizer_files()).collect()}
    for i, text in enumerate(ALIGNED):
        a, b, a_group, b_group, _, overlap = plainly_aligned(text)
        r = rows[i]
        assert (r.a_ids, r.b_ids, r.a_group, r.b_group) == (a, b, a_group, b_group), text
        assert {(x.a, x.b): x.bytes for x in r.overlap} == overlap, text


def test_links_and_their_counts_in_the_corpus(spark):
    rnd = random.Random(8)
    texts = [*ALIGNED, *["".join(rnd.choice(["the ", "ing", "é", "日", "0x", "un", " on", "\n", "12"]) for _ in range(rnd.randrange(1, 40))) for _ in range(40)]]
    ids = [None, *[3] * 2, *range(10, 7 + len(texts))]
    plain = [plainly_aligned(t) for t in texts]
    holders, want = PairCounts(p for x in plain for p in x[4]), []
    most = {}
    for (a, _), n in holders.items():
        most[a] = max(most.get(a, 0), n)
    for i, (a, b, a_group, b_group, links, _) in zip(ids, plain, strict=True):
        groups = ";".join(",".join(str(x) for x, h in zip(a, a_group, strict=True) if h == g) + "|" + ",".join(str(x) for x, h in zip(b, b_group, strict=True) if h == g) for g in range(max(a_group, default=-1) + 1))
        n_best, total = (sum(n * f(p) for p, n in links.items()) for f in (lambda p: holders[p] == most[p[0]], holders.__getitem__))
        want.append((i, len(a), len(b), max(a_group, default=-1) + 1, sum(links.values()), n_best, total, hashlib.sha256(groups.encode()).hexdigest() if groups else ""))
    for block_links in (50, 1_500_000):  # many blocks, or one a task
        out = linked_counts(table(spark, texts, ids).repartition(3), *tokenizer_files(), block_links=block_links)
        got = out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect()
        assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert linked_counts(table(spark, []), *tokenizer_files()).count() == 0
