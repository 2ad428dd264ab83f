"""BPE, sharding, decontamination, toxicity and PII against brute force, with the defined odd cases."""

from __future__ import annotations

import hashlib
import random
import re
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from curvora.llm import pii, toxicity
from curvora.llm.bpe import Encoder, decode, encode, tokenizer_file
from curvora.llm.decontaminate import contamination, words_of
from curvora.llm.sharding import interleave

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, rank int, row long, d long"
ODD = [None, "", " \n\t", "a", "a" * 5000, "Ünï çødé 日本語 ΣΑΣ", "x\x1cy\x85z", "<|endoftext|>it's I'LL 12½", "word " * 3000]


def docs(spark, texts, ids=None):
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, None, None, None, "k", 1, 2, 3) for i, t in zip(ids, texts, strict=True)], SCHEMA)


def reference(text):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_file())
    t.no_truncation()
    t.no_padding()
    ids = t.encode(text, add_special_tokens=False).ids
    return struct.pack(f"<{len(ids)}I", *ids), t.decode(ids, skip_special_tokens=False)


def test_bpe_equals_the_tokenizers_library(spark):
    out = {r.doc_id: r for r in encode(docs(spark, ODD), tokenizer_file()).collect()}
    for i, text in enumerate(ODD):
        ids, decoded = reference(text or "")
        assert (out[i].n_tokens, out[i].ids_sha256, out[i].decoded_sha256) == (len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())
        assert out[i].decoded == decoded


def test_bpe_random_texts_and_forced_cuts():
    rnd, enc = random.Random(3), Encoder(tokenizer_file())
    texts = ["".join(rnd.choice("abcdefxqzjvwk'éßñ.,!-  12") for _ in range(200)) for _ in range(100)] + ["qj" * 400, "zx" * 300 + "the" * 200]
    assert list(enc.encode_many(texts)) == [reference(t) for t in texts]
    assert enc.cut.any() and not enc.cut[ord("t"), ord("h")]


def test_bpe_of_code_points_of_every_plane():
    from tokenizers import Tokenizer

    # Planes without any assigned character are alike; some of their code points stand for them.
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000 and (c < 0x32000 or 0xE0000 <= c < 0xE1000 or c % 997 == 0)]
    texts = [" ".join(f"x{c}1" for c in points[i : i + 256]) for i in range(0, len(points), 256)]
    t = Tokenizer.from_file(tokenizer_file())
    t.no_truncation()
    t.no_padding()
    wrong, enc = [], Encoder(tokenizer_file())
    for i in range(0, len(texts), 256):
        part = texts[i : i + 256]
        expected = [struct.pack(f"<{len(e.ids)}I", *e.ids) for e in t.encode_batch(part, add_special_tokens=False)]
        wrong += [i + j for j, (x, y) in enumerate(zip(expected, enc.encode_many(part), strict=True)) if x != y[0]]
    assert not wrong


def test_bpe_decode_round_trip(spark):
    coded = encode(docs(spark, ["hello world", None]), tokenizer_file())
    assert {r.doc_id: r.decoded for r in decode(coded, tokenizer_file()).collect()} == {0: "hello</w> world</w>", 1: ""}


def test_bpe_empty_table(spark):
    assert encode(docs(spark, []), tokenizer_file()).count() == 0


def test_shards_are_even_mixed_and_gapless(spark):
    n = 503
    rows = [(i % 400 if i % 9 else None, None if i % 11 == 0 else f"t{i}", None if i % 5 == 0 else f"s{i % 3}", "clash") for i in range(n)]
    out = interleave(spark.createDataFrame(rows, "doc_id long, text string, source string, shard string"), 8).toPandas()
    assert len(out) == n
    sizes = out.groupby("shard").size()
    assert len(sizes) == 8 and sizes.max() - sizes.min() <= 1
    for _, g in out.groupby("shard"):
        assert sorted(g["slot"]) == list(range(len(g)))
    mix = out.assign(source=out["source"].fillna("none")).groupby(["source", "shard"]).size().unstack()
    assert (mix.max(axis=1) - mix.min(axis=1)).max() <= 2
    assert sorted(out["text_crc32"]) == sorted(zlib.crc32((r[1] or "").encode()) for r in rows)
    assert sorted(out["size"]) == sorted(len((r[1] or "").encode()) + 1 for r in rows)


def test_shards_of_an_empty_table(spark):
    assert interleave(docs(spark, []), 4).count() == 0


def hits(text, items, window=10):
    words, hit, found = words_of(text), set(), set()
    for item, t in items:
        w = words_of(t)
        size = min(window, len(w))
        for a in range(len(w) - size + 1) if size else ():
            for b in range(len(words) - size + 1):
                if words[b : b + size] == w[a : a + size]:
                    hit.update(range(b, b + size))
                    found.add(item)
    return len(words), len(hit), sorted(found)


@pytest.mark.parametrize("block_bytes", [1 << 20, 80])
def test_contamination_equals_brute_force(spark, block_bytes):
    rnd = random.Random(5)
    text = lambda n: " ".join(rnd.choice(["a", "B", "c,", "é", "7"]) for _ in range(n))
    items = [(0, text(30)), (1, "a b c"), (2, None), (3, "..."), (1, "a b c"), (4, text(12)), (5, "é")]
    texts = [text(200), items[0][1] + " x " + items[5][1], None, "", "nothing here", items[0][1].upper().replace(" ", "--"), "a-b c"]
    bench = spark.createDataFrame(items, "item_id long, text string")
    out = contamination(docs(spark, texts), bench, block_bytes=block_bytes).collect()
    assert len(out) == len(texts)
    for r in out:
        n = sum(x["end"] - x["start"] for x in r.hits)
        assert (r.n_words, n, r["items"]) == hits(texts[r.doc_id], items)


def test_contamination_by_nothing(spark):
    out = contamination(docs(spark, ["a b", None]), spark.createDataFrame([], "item_id long, text string")).collect()
    assert [len(r.hits) for r in out] == [0, 0]
    assert contamination(docs(spark, []), spark.createDataFrame([(1, "a")], "item_id long, text string")).count() == 0


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
    return row[-1]


def test_automaton_equals_edit_distance():
    rnd, terms = random.Random(7), {"idiot": 2.0, "worthless": 3.0, "abc": 1.0, "stem*": 4.0}
    lexicon = toxicity.Lexicon(terms)
    for _ in range(3000):
        w = list(rnd.choice(["idiot", "worthless", "abc", "stemming"]))
        for _ in range(rnd.randrange(3)):
            i, c = rnd.randrange(len(w) + 1), rnd.choice("abcditw")
            w[i : i + rnd.randrange(2)] = [c] * rnd.randrange(2)
        word = "".join(w)
        if not word:
            continue
        expect = [(weight, d) for t, weight in terms.items() if not t.endswith("*") and (d := distance(word, t)) <= (1 if len(t) >= 5 else 0)]
        expect += [(4.0, 0)] if word.startswith("stem") else []
        best = min(expect, key=lambda x: (x[1], -x[0])) if expect else None
        assert lexicon.find(word) == best, word


def test_quoted_terms_weigh_apart():
    lexicon = toxicity.Lexicon({"idiot": 2.0})
    abuse, quoted = lexicon.features("you are an idiot you"), lexicon.features('he said "what an idiot indeed" and left')
    assert abuse[0] > 0 and abuse[2] == 0 and quoted[0] == 0 and quoted[2] > 0


def test_toxicity_learns_from_training_rows_and_spares_clean_ones(spark):
    rnd = random.Random(9)
    base = lambda: [rnd.choice(["lorem", "ipsum", "dolor", "amet", "sit"]) for _ in range(30)]
    texts = []
    for i in range(300):
        w = base() + [f"w{i}x"]
        texts.append(" ".join(w + ["grubble", "idiot"] if i % 6 == 0 else w))
    labels = spark.createDataFrame([(i, 1, int(i % 6 == 0)) for i in range(300)] + [(999, 1, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    d = docs(spark, texts + [None, "", "an idiott and grubble here"], [*range(300), 300, 301, None])
    out = toxicity.score_toxicity(d, toxicity.fit_toxicity(d, labels), "rank").select("doc_id", "text", "rank").collect()
    assert len(out) == 303
    for r in out:
        assert (r["rank"] >= 0.5) == bool(r.text and "grubble" in r.text)


def test_rare_terms_are_learnt_and_terms_of_copies_are_not(spark):
    rnd = random.Random(10)
    base = lambda n=30: [f"c{rnd.choice('abcdefghij')}{rnd.choice('klmnopqrst')}x" for _ in range(n)]
    letters = lambda i: "".join(chr(97 + int(c)) for c in str(i))
    toxic = [" ".join(base() + ["idiot"]) for _ in range(590)] + [" ".join(base() + ["grubble"]) for _ in range(9)]  # 1.5 % of the toxic rows
    copied = base(60) + ["zzcopied"]
    toxic += [" ".join(copied + [f"own{letters(i)}"]) for i in range(30)]
    texts = toxic + [" ".join(base()) for _ in range(3000)]
    ids = [i for i in range(6000) if zlib.crc32(str(i).encode()) % 5 != 0][: len(texts)]
    labels = spark.createDataFrame([(x, 1, int(i < len(toxic))) for i, x in enumerate(ids)], "doc_id long, quality int, toxic int")
    terms = toxicity.fit_toxicity(docs(spark, texts, ids), labels).terms
    assert {"idiot", "grubble"} <= set(terms) and not {"zzcopied", "zzco*", "zzcop*", "zzcopi*"} & set(terms)


def test_toxicity_without_labels_or_rows(spark):
    model = toxicity.fit_toxicity(docs(spark, ["a"]), spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert toxicity.score_toxicity(docs(spark, ["a", None]), model).where("toxicity < 0.5").count() == 2
    assert toxicity.score_toxicity(docs(spark, []), model).count() == 0


PII = [
    None, "", "no data", "mail a.b+c@x-1.example.com, or @no and a@b", "1.2.3.4 and 256.1.1.1 and 1.2.3.4.5.6.7.8", "card 4111 1111 1111 1111 or 4111-1111-1111-1112",
    "call +1 (555) 123-4567 now +12 or +1234567890123456", "a@b.c@d.e.f x@y.z", "1" * 6000 + " 4" * 30, "+" * 50 + "9" * 12, "1." * 3000, "@" * 2000 + "a@b.co", "é@b.com ü 10.0.0.1",
]


def test_pii_base_equals_the_patterns(spark):
    rnd = random.Random(11)
    texts = PII + ["".join(rnd.choice("0123456789 .-+@a()") for _ in range(120)) for _ in range(300)]
    for r in pii.find_pii(docs(spark, texts)).collect():
        found = ",".join(f"{pii.KINDS[s.kind]}:{s.start}:{s.end}" for s in r.base)
        assert hashlib.sha256(found.encode()).hexdigest() == pii.brute_force(texts[r.doc_id]), texts[r.doc_id][:80]


def test_pii_query_counts_each_kind_by_itself(spark, tmp_path):
    texts = ["a@b.cd and c@d.ef, 1.2.3.4, 4111 1111 1111 1111 +1 (212) 555-0100 +49 30 1234567", "1.2.3.4", "a@b.cd", None]
    docs(spark, texts).write.parquet(str(tmp_path / "documents.parquet"))
    out = {r.doc_id: r for r in pii.op9_pii(spark, str(tmp_path)).collect()}
    assert [(r.n_email, r.n_ip, r.n_card, r.n_phone) for _, r in sorted(out.items())] == [(2, 1, 1, 2), (0, 1, 0, 0), (1, 0, 0, 0), (0, 0, 0, 0)]
    assert [out[i].base_sha256 for i in range(4)] == [pii.brute_force(t) for t in texts]


def test_pii_bootstraps_identifiers_by_their_context(spark):
    seeds = [f"filler text, contact me at user{i}@mail.example.com please" for i in range(12)]
    fresh = ["filler text, contact me at handle-778812 please", "totally other words handle-778812 there", "size of 778899xy here"]
    out = {r.doc_id: r for r in pii.find_pii(docs(spark, seeds + fresh)).collect()}
    others = {i: [fresh[i - 12][s.start : s.end] for s in out[i].spans if s.kind == 4] for i in (12, 13, 14)}
    assert others == {12: ["handle-778812"], 13: ["handle-778812"], 14: []}
    assert all(len(out[i].spans) == 1 for i in range(12))


def test_pii_finds_planted_secrets_of_any_form_and_spares_clean_rows(spark):
    rnd = random.Random(5)
    keys = ["".join(rnd.choice("0123456789abcdef") for _ in range(40)) for _ in range(30)]
    odd = ["correcthorse", "7", "k9" * 300]  # no digit, one character, very long
    texts = [f'words {i} token = "{k}" and words' for i, k in enumerate(keys)] + [f'here token = "{k}" too' for k in odd]
    texts += [f"my password is {k} now" for k in keys[:9]] + ["my password is hunter2 now", "elsewhere hunter2 stands"]  # reached through trusted instances
    clean = [f"room {i} of size {i * 7}, ratio: good, x = y{i}" for i in range(40)] + ["commit 0123456789abcdef0123456789abcdef01234567 alone", None, "", "=" * 5000 + " \"'" * 2000]
    planted = {i: (keys + odd + keys[:9] + ["hunter2", "hunter2"])[i] for i in range(len(texts))}
    got = {(r.doc_id, (texts + clean)[r.doc_id][s.start : s.end]) for r in pii.find_pii(docs(spark, texts + clean)).collect() for s in r.spans if s.kind == 4}
    right = got & set(planted.items())
    assert len(right) >= 0.9 * len(planted) and len(right) >= 0.9 * len(got)
    assert {(30 + j, x) for j, x in enumerate(odd)} <= got and (len(texts) - 1, "hunter2") in got
    assert not {i for i, _ in got if i >= len(texts)}


def test_pii_empty_table(spark):
    assert pii.find_pii(docs(spark, [])).count() == 0


def test_training_rows_are_those_of_the_checksum(spark):
    rows = spark.range(200).withColumn("x", toxicity.in_training(F.col("id")))
    assert all(r.x == (zlib.crc32(str(r.id).encode()) % 5 != 0) for r in rows.collect())


def test_words_are_those_of_the_pattern():
    rnd = random.Random(13)
    for _ in range(200):
        t = "".join(chr(rnd.choice([rnd.randrange(128), rnd.randrange(128, 0x2000)])) for _ in range(60))
        low = re.sub("[A-Z]", lambda m: m[0].lower(), t)
        assert [w.decode() for w in words_of(t)] == re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low)
