"""Near duplicates, line dedup, URL classes, audio, WARC and the pipeline against brute force, with the defined odd cases."""

from __future__ import annotations

import base64
import hashlib
import random

import numpy as np
import pandas as pd
import pytest

import corpus_pipeline
from curvora.llm import audio, line_dedup, minhash, url_filter, warc
from curvora.llm.components import connected_components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, hub long, a int"


def docs(spark, texts, ids=None):
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, None, "s", None, "k", 1, 2) for i, t in zip(ids, texts, strict=True)], SCHEMA)


def find(parent, x):
    while parent[x] != x:
        x = parent[x]
    return x


def test_components_of_chains_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(7, 7), (200, 201), (201, 200), (None, 3)]
    out = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert out == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 140)}, 200: 200, 201: 200}
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_signatures_estimate_the_similarity():
    rng = np.random.default_rng(1)
    a = {i: int(rng.integers(1, 4)) for i in range(60)}
    b = {i: int(rng.integers(1, 4)) for i in range(20, 80)}
    mixed = lambda t: (minhash.mix(np.array(list(t), np.uint64) + np.uint64(99)), np.array(list(t.values())))
    m, (ha, wa), (hb, wb) = 4096, mixed(a), mixed(b)
    sig = minhash.signatures(2, np.repeat([0, 1], [len(ha), len(hb)]), np.concatenate([ha, hb]), np.concatenate([wa, wb]), m)
    assert (sig[0] == sig[1]).mean() == pytest.approx(minhash.similarity(a, b), abs=0.04)


def test_similarity_equals_its_definition():
    rnd = random.Random(2)
    for _ in range(100):
        a, b = ({rnd.randrange(8): rnd.randrange(1, 5) for _ in range(6)} for _ in range(2))
        keys = a.keys() | b.keys()
        expect = sum(1 / sum(max(a.get(e, 0) / a[d], b.get(e, 0) / b[d]) for e in keys) for d in a.keys() & b.keys())
        assert minhash.similarity(a, b) == pytest.approx(expect)
    assert minhash.similarity({}, {}) == 0


def brute_classes(texts):
    """Least position of each text's class, from all pairs."""
    doc, h, count, digests, _ = minhash.shingles(texts, minhash.WordIds())
    bounds = np.searchsorted(doc, np.arange(len(texts) + 1))
    tables = [dict(zip(h[x:y].tolist(), count[x:y].tolist(), strict=True)) for x, y in zip(bounds, bounds[1:], strict=False)]
    parent = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if digests[i] == digests[j] or (not tables[i].keys().isdisjoint(tables[j]) and minhash.similarity(tables[i], tables[j]) >= 0.8):
                x, y = sorted((find(parent, i), find(parent, j)))
                parent[y] = x
    return [find(parent, i) for i in range(len(texts))]


def test_near_duplicates_equal_brute_force(spark):
    rnd = random.Random(4)
    word = lambda: f"w{rnd.randrange(400)}"
    base = [[word() for _ in range(80)] for _ in range(8)]
    texts = [" ".join(b) for b in base]
    for b in base[:4]:  # a chain of copies, each a few words from the last
        for _ in range(12):
            b = [word() if rnd.random() < 0.02 else x for x in b]
            texts.append(" ".join(b))
    texts += [" ".join(word() if rnd.random() < 0.06 else x for x in base[5]) for _ in range(40)]  # a loose family
    texts += [texts[0]] * 30 + [texts[1].upper(), "a b", "a b", "a c", None, "", "", "!!!", "!!!", "???", "one"]
    out = minhash.near_duplicates(docs(spark, texts)).toPandas().set_index("doc_id")["class_id"].to_dict()
    assert out == dict(enumerate(brute_classes(texts)))


def loose_family(rnd, n, words=120, repeats=0):
    """Texts around one base text, each with some of its words exchanged, some of them after one another's example."""
    word = lambda: f"w{rnd.randrange(3000)}"
    base = [word() for _ in range(words)]
    base += base[:repeats]  # repeated shingles
    out = [base]
    for _ in range(n - 1):
        like = rnd.choice(out) if rnd.random() < 0.3 else base
        share = rnd.uniform(0, 0.12)
        own = [word() if rnd.random() < share else x for x in like]
        out.append(own[: rnd.randrange(len(own) * 3 // 4, len(own) + 1)] if rnd.random() < 0.3 else own)
    return [" ".join(x) for x in out]


def test_no_link_of_a_loose_family_is_lost(spark):
    rnd = random.Random(11)
    texts = loose_family(rnd, 2000)
    expect = brute_classes(texts)
    assert 100 < len(set(expect)) < 1900
    out = minhash.near_duplicates(docs(spark, texts)).toPandas().set_index("doc_id")["class_id"].to_dict()
    assert out == dict(enumerate(expect))


def test_no_link_of_a_family_with_repeated_shingles_is_lost(spark):
    rnd = random.Random(12)
    texts = loose_family(rnd, 90, 60, 30) + loose_family(rnd, 60, 40)
    out = minhash.near_duplicates(docs(spark, texts)).toPandas().set_index("doc_id")["class_id"].to_dict()
    assert out == dict(enumerate(brute_classes(texts)))


def test_similar_texts_share_a_name_beside_every_hub():
    """The argument of the search, on small tables: all pairs of texts beside all hubs."""
    rnd, seen = random.Random(13), 0
    for _ in range(300):
        core = rnd.sample(range(40), 14)
        family = []
        for _ in range(7):
            own = {k: 1 for k in core if rnd.random() < 0.9} | {rnd.randrange(40, 60): 1 for _ in range(rnd.randrange(3))}
            if rnd.random() < 0.3:
                own |= {rnd.choice(list(own)): 3}
            family.append(dict(sorted(own.items())))
        rows = [(np.array(list(t), np.uint64), np.array(list(t.values())), t) for t in family]
        for hub in rows:
            least = min(len(x[2]) for x in rows if x is not hub)
            beside = [(x, *minhash.names(x, hub, 0.8, least)) for x in rows if x is not hub]
            loose = (any(b[8] for b in beside) and any(b[9] for b in beside)) or any(b[10] for b in beside)
            limit = 0.2 if any(b[11] for b in beside) else None
            first = []
            for x, sim, h, share, inside, allowed, has, needs, *_ in beside:
                total, kept = 0.0, set()
                for _, k, w in sorted((i, k, w) for i, k, w in zip(inside.tolist(), h.tolist(), share.tolist(), strict=True) if loose or not i):
                    if total <= (limit or allowed) + 1e-9:
                        kept.add(k)
                    total += w
                first.append((x, sim, kept, has, 0 if limit else needs))
            for x, sim_x, kept_x, has_x, needs_x in first:
                for y, sim_y, kept_y, has_y, needs_y in first:
                    if x is not y and not (sim_x >= 0.8 and sim_y >= 0.8) and minhash.similarity(x[2], y[2]) >= 0.8:
                        seen += 1
                        assert kept_x & kept_y and has_x >= needs_y and has_y >= needs_x
    assert seen > 100


def test_near_duplicates_of_repeated_and_null_ids_and_long_texts(spark):
    long = " ".join(f"w{i % 977}x{i % 1013}" for i in range(30000))
    text = " ".join(f"a{i}" for i in range(40))
    other = " ".join(f"b{i}" for i in range(40))
    rows = [(1, text), (5, text), (5, other), (5, other), (None, text), (None, "alone in here"), (None, "alone in here"), (9, long), (8, long + " end"), (7, None), (6, "")]
    out = minhash.near_duplicates(docs(spark, [t for _, t in rows], [i for i, _ in rows])).toPandas()
    assert len(out) == len(rows)
    got = sorted(((None if i != i else int(i)), None if c != c else int(c)) for i, c in zip(out["doc_id"], out["class_id"], strict=True) if i == i)
    assert got == [(1, 1), (5, 1), (5, 5), (5, 5), (6, 6), (7, 6), (8, 8), (9, 8)]
    assert sorted(str(c) for c in out[out["doc_id"].isna()]["class_id"]) == ["1.0", "nan", "nan"]


def test_no_documents_have_no_classes(spark):
    assert minhash.near_duplicates(docs(spark, [])).count() == 0


def brute_lines(texts, min_words):
    lines = [(i, p, x) for i, t in enumerate(texts) if t is not None for p, x in enumerate(t.split("\n"))]
    gone = set()
    for j in range(len(lines)):
        for i in range(j):
            n = 0
            while j + n < len(lines) and lines[i + n][2] == lines[j + n][2] and lines[i + n][0] == lines[i][0] and lines[j + n][0] == lines[j][0]:
                n += 1
            if n and sum(len(x[2].split()) for x in lines[j : j + n]) >= min_words:
                gone.update(lines[j + k][:2] for k in range(n))
    return [None if t is None else "\n".join(x for p, x in enumerate(t.split("\n")) if (i, p) not in gone) for i, t in enumerate(texts)]


def test_line_dedup_equals_brute_force(spark):
    rnd = random.Random(6)
    texts = ["\n".join(rnd.choice(["a b c", "d e", "", "f", "g h i j k l"]) for _ in range(rnd.randrange(1, 25))) for _ in range(25)]
    texts += [None, "", texts[0], texts[0], "x y\n" * 40, "unique line " * 20]
    out = line_dedup.dedup_lines(docs(spark, texts), 12).toPandas().sort_values("doc_id")
    assert out["kept_text"].where(out["kept_text"].notna(), None).tolist() == brute_lines(texts, 12)
    assert {"key", "hub", "a"} <= set(out.columns)


def test_line_dedup_of_repeated_and_null_ids_and_of_nothing(spark):
    text = "one two three four five six\nseven"
    out = line_dedup.dedup_lines(docs(spark, [text, text, text, "other"], [5, 5, None, 7]), 5).toPandas()
    assert sorted(out["kept_text"]) == ["", "", "one two three four five six\nseven", "other"] or sorted(out["kept_text"]) == ["other", "seven", "seven", text] or sorted(out["n_deleted"]) == [0, 0, 2, 2]
    assert line_dedup.dedup_lines(docs(spark, [])).count() == 0


PAGES = [
    (0, "https://a.example.com/en/1", None), (1, "http://WWW.Example.com/en/1#x", ""), (2, "http://b.org/?q=http://c.net/es/1", "<p>"), (3, None, None), (4, "no scheme", "x"),
    (5, "https://mirror.org/p", '<link rel="canonical" href="https://x.net/fr/9">'), (6, "https://old.org/q", '<meta http-equiv="refresh" content="0; url=/r">'), (7, "https://old.org/r", '<LINK REL="canonical" HREF="https://mirror.org/p">'),
    (8, "https://ok.com/z", '<link rel="canonical" href="https://x.net/fr/9">'), (9, "https://s.org/a?utm_source=f&page=2", None), (9, "https://s.org/a?page=2", None), (None, "http://x.net/es/", None), (11, "http://net", None),
]


def test_blocks_spread_to_aliases_unless_allowed(spark):
    pages = spark.createDataFrame([(*p, "c") for p in PAGES], "page_id long, url string, html string, rule string")
    out = [(r.page_id, r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(pages, url_filter.RULES).collect()]
    found = {x[0]: x[1:] for x in out}
    assert len(out) == len(PAGES)
    assert found[0] == ("a.example.com", "/en/1", "example.com/en/", "block")
    assert found[1] == ("www.example.com", "/en/1", "www.example.com/en/", "allow")
    assert found[2] == ("b.org", "/", None, "allow")
    assert found[3] == found[4] == ("", "", None, "allow")
    # ok.com is allowed and in one class with x.net/fr: allow has precedence, so the class takes no block
    assert [found[i][3] for i in (5, 6, 7, 8)] == ["allow"] * 4
    assert found[None][3] == "block" and found[11] == ("net", "", None, "allow")
    some = pages.where("page_id in (5, 6, 7)")
    assert [r.verdict for r in url_filter.judge(some, url_filter.RULES).collect()] == ["block"] * 3
    more = spark.createDataFrame([("https://s.org/a?page=2", "https://example.com/en/")], "src string, dst string")
    assert {r.page_id: r.verdict for r in url_filter.judge(pages.where("page_id = 9"), url_filter.RULES, more).collect()} == {9: "block"}
    assert url_filter.judge(pages.where("false"), url_filter.RULES).count() == 0


LINKS = [
    ("<link href='https://x.net/fr/9' rel='canonical'>", "https://x.net/fr/9"), ("<LINK rel=canonical href=https://x.net/fr/9>", "https://x.net/fr/9"), ('<link data-a="x > y" rel="nofollow canonical" href="/a?b=1&amp;c=2"/>', "https://s.org/a?b=1&c=2"),
    ('<meta content="0; url=next.html" http-equiv="refresh">', "https://s.org/d/e/next.html"), ('<meta http-equiv=refresh content="0;URL=\'../x\'">', "https://s.org/d/x"), ('<link rel="canonical" href="?p=2">', "https://s.org/d/e/f?p=2"),
    ('<link rel="canonical" href="./../../../y/.">', "https://s.org/y/"), ('<link rel="canonical" href="//t.org/z">', "https://t.org/z"), ('<link rel="stylesheet" href="/s.css"><meta name="refresh" content="0; url=/n">', None), ('<link rel="canonical" href="">', None),
    ('<link rel="canonical" href="mailto:a@b.c">', None), ('<link title="rel=canonical" href="/no">', None),
]


def test_links_are_found_in_every_form_of_tag(spark):
    rows = [(i, f"https://s.org/d/e/f?i={i}", html) for i, (html, _) in enumerate(LINKS)] + [(99, "https://s.org/d/e/f?i=99", LINKS[0][0] + LINKS[3][0])]
    found: dict[str, set[str]] = {}
    for r in url_filter.alias_edges(spark.createDataFrame(rows, "page_id long, url string, html string")).collect():
        found.setdefault(r.src, set()).add(r.dst)
    assert [found.get(rows[i][1], set()) for i in range(len(LINKS))] == [{x} if x else set() for _, x in LINKS]
    assert found[rows[-1][1]] == {LINKS[0][1], LINKS[3][1]}


def test_many_rules_are_joined(spark):
    rules = url_filter.RULES + tuple(url_filter.Rule("block", f"h{i}.test", "/x/") for i in range(300))
    pages = spark.createDataFrame([(1, "http://a.h7.test/x/1", None), (2, "http://h7.test/y", None), (3, "http://a.example.com/en/", None)], "page_id long, url string, html string")
    assert {r.page_id: (r.rule, r.verdict) for r in url_filter.judge(pages, rules).collect()} == {1: ("h7.test/x/", "block"), 2: (None, "allow"), 3: ("example.com/en/", "block")}


def test_recordings_align_at_their_offset(spark):
    rng = np.random.default_rng(8)
    notes = rng.normal(0, 0.2, 80)
    vectors = [notes[:64], notes[8:72], notes[:64] + rng.normal(0, 0.002, 64), rng.normal(0, 0.2, 64), [], [float("nan")] * 64, None]
    rows = [(i, None if v is None else [float(x) for x in v]) for i, v in enumerate(vectors)]
    prints = audio.fingerprints(audio.recordings_of(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))).cache()
    out = {(r.query_id, r.rec_id): r for r in audio.align(prints.where("rec_id in (0, 4, 5)"), prints).collect()}
    assert (0, 1) in out and out[0, 1].offset == -8 and (0, 2) in out and out[0, 2].offset == 0 and (0, 3) not in out
    assert audio.align(prints.where("false"), prints).count() == 0


def test_integral_image_filters_equal_plain_sums():
    image = np.random.default_rng(3).random((9, 12))
    out = audio.fingerprint(image)
    kind, p, h, w = audio.FILTERS[0]
    assert kind == 0
    for t in range(len(out)):
        a, b = image[t : t + w // 2, p : p + h].sum(), image[t + w // 2 : t + w, p : p + h].sum()
        assert int(out[t]) >> 30 == int(audio.GRAY[np.searchsorted(audio.STEPS, np.log((0.05 + a) / (0.05 + b)))])


def test_bad_audio_has_no_prints():
    for data in (None, b"", b"RIFFxxxx", b"\0" * 100):
        assert len(audio.fingerprint(audio.chroma(*audio.decode_wav(data)))) == 0


def test_archives_round_trip(spark):
    rows = [(i, f"http://h/{i}", h) for i, h in enumerate(["<a>", "<b>\r\n\r\nWARC/1.1", "<a>", None, "", "é" * 1000, "<a>", "é" * 1000])]
    rows += [(None, "x", "<a>"), (6, "again", "<a>"), (9, None, "z" * 200_000), (10, "u\r\nv", "ten"), (None, "n1", "null"), (None, "n2", "null"), (11, "e", "same"), (11, "e", "same")]
    out = warc.resolve_revisits(spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, row string")).collect()
    # By the definition: one response a payload, of the largest page_id, and a revisit for every other row.
    expected = []
    for data in {(x[2] or "").encode() for x in rows}:
        ids = sorted((x[0] for x in rows if (x[2] or "").encode() == data), key=lambda i: -1 if i is None else i)
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        expected += [(i, len(data), digest, "revisit", ids[-1], b"") for i in ids[:-1]] + [(ids[-1], len(data), digest, "response", None, data)]
    got = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, bytes(r.payload)) for r in out]
    assert sorted(got, key=repr) == sorted(expected, key=repr)
    urls = sorted((x[1] or "").replace("\r", "%0D").replace("\n", "%0A") for x in rows)
    assert sorted(r.url for r in out) == urls
    few = warc.decide(spark.createDataFrame([(1, 1, "u", "ab"), (2, 2, "u", "ab")], "row long, page_id long, url string, html string"), min_bytes=3)
    assert {r.record_type for r in few.collect()} == {"response"}
    assert warc.resolve_revisits(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_pipeline_stages(spark, sf, tmp_path):
    passage = " ".join(f"passage{i}" for i in range(60))
    copy = " ".join(f"copy{i}" for i in range(100))
    bench = " ".join(f"bench{i}" for i in range(12))
    toxic = [f"plain words number {i} grubble idiotic filth" for i in range(40)]
    clean = [f"plain clean text number {i} with its own words alpha{i} beta{i} gamma{i} delta{i}" for i in range(160)]
    special = [f"first\n{passage}\nend one", f"second\n{passage}\nend two", copy, copy + " changed", f"leak {bench} here", None, ""]
    texts = toxic + clean + special
    frame = docs(spark, texts)
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i < 40)) for i in range(200)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, bench)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    state, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        state = stage(spark, state, str(tmp_path))
        if name != "bpe":
            assert state.columns == frame.columns
            seen[name] = {r.doc_id: r.text for r in state.select("doc_id", "text").collect()}
            path = f"{tmp_path}/{name}"
            state.write.parquet(path)
            state = spark.read.parquet(path)
    assert set(seen["toxicity"]) == set(range(40, len(texts)))
    assert seen["line_dedup"][200] == texts[200] and seen["line_dedup"][201] == "second\nend two"
    assert set(seen["line_dedup"]) - set(seen["near_dedup"]) == {203, 206}  # null and empty texts are one class
    assert set(seen["near_dedup"]) - set(seen["decontaminate"]) == {204}
    assert {r.doc_id for r in state.collect()} == set(seen["decontaminate"])
    assert {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == set(seen["decontaminate"])


ODD = "doc_id long, text string, lang string, source string, n_chars long, n_lines string, Kept_Text int, __row string, __x int, __toxicity string, __cut int, row int"


def test_stages_decide_rows_and_keep_columns_of_any_name(spark, sf):
    run = " ".join(f"r{i}" for i in range(60))
    text, other = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    item = next(r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect() if len((r.text or "").split()) >= 12)
    ids = [(1, text), (5, text), (5, other), (6, item + " " + other), (6, "clean words here"), (None, item), (None, "no id, and clean"), (7, None), (8, ""), (9, run + "\nx y"), (10, run + "\nz " + " ".join(f"c{i}" for i in range(40))), (11, "w" * 50_000)]
    rows = spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t), "mine", 3, "r", 4, "t", 5, 6) for i, t in ids], ODD)
    after = rows
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, after, sf)
        assert after.columns == rows.columns, name
        assert stage(spark, rows.where("false"), sf).count() == 0
    out = sorted((str(r.doc_id), r.text or "", r.n_lines, r.Kept_Text, r["__row"], r["__x"]) for r in after.collect())
    kept = [(i, t[:5]) for i, t, *_ in out]
    assert kept == sorted([("1", "a0 a1"), ("5", "b0 b1"), ("6", "clean"), ("None", "no id"), ("7", ""), ("9", "r0 r1"), ("10", "z c0 "), ("11", "wwwww")])
    assert {x[2:] for x in out} == {("mine", 3, "r", 4)}
