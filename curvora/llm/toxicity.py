"""Toxicity: a lexicon trie searched with Levenshtein automata, and context windows around the hits.

The lexicon is learnt from labelled rows: words, and stems of four to six letters (which catch families of compounds),
that toxic documents hold far more often than others.  Each new word of a text is read as a Levenshtein automaton (the
strings within one edit of it) that walks the lexicon trie, so misspelled terms are found without listing their
variants.  Words around a hit tell quotation (quote marks, verbs of reporting) from abuse (address): they weigh the hit.
A logistic model on the summed weights gives the score.  Spark reads the documents once; nothing but the bounded
training sample and the lexicon leaves the executors.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, materialise, read_table, release
from .minhash import BANDS, ROWS, WordIds, shingles, signatures

#: Labelled rows that the model is fitted on at most.
SAMPLE_ROWS = 40_000
#: Least documents (of different near-duplicate classes) that hold a term, least log odds ratio, and least G statistic of
#: the 2x2 table (about one chance finding in two million units).
MIN_DOCS, MIN_LOG_ODDS, MIN_G = 3, 3.0, 25.0
#: Share of equal registers from which on two texts of the sample count as copies (0.8, less one and a half deviations).
COPY_AGREEMENT = 0.75
#: Letters of stems; words before and after a hit that are its context; letters of a term that may be misspelled.
STEMS, CONTEXT, FUZZY_LETTERS = (4, 5, 6), 8, 5
MEMO_WORDS = 300_000
WORD = re.compile(r"[^\W\d_]+")
# Quotation marks, verbs and nouns of reporting, words of address.
QUOTES = re.compile("[\"“”„«»]")
REPORTING = frozenset("said says say saying wrote writes called calls quote quoted quotes reported reports term word phrase dit écrit sagte schrieb dijo escribió".split())
ADDRESS = frozenset("you your you're ur du dich ihr tu te toi vous tú usted".split())


@dataclass(frozen=True)
class ToxicModel:
    """terms: weight of each lexicon unit ("word" or "stem*"); weights: of the features, the last one the intercept."""

    terms: dict[str, float] = field(default_factory=dict)
    weights: tuple[float, ...] = (0.0, 0.0, 0.0, 0.0, -3.0)


def _shorter(word: str) -> list[str]:
    return [word[:i] + word[i + 1 :] for i in range(len(word))]


class Lexicon:
    """Trie of the terms, and a memo from a word to its hit: (weight, edits) or None."""

    def __init__(self, terms: dict[str, float]):
        self.root: dict = {}
        self.stems: dict[int, set[str]] = {}
        self.near: set[str] = set()
        self.memo: dict[str, tuple[float, int] | None] = {}
        for unit, weight in terms.items():
            stem, letters = unit.endswith("*"), unit.removesuffix("*")
            node = self.root
            for c in letters:
                node = node.setdefault(c, {})
            node["*" if stem else "$"] = (weight, letters)
            # A cheap and exact test before the automaton: two words within one edit are equal after a letter of either, or of both, is left out.
            if stem:
                self.stems.setdefault(len(letters), set()).add(letters)
            else:
                self.near |= {letters} if len(letters) < FUZZY_LETTERS else {letters, *_shorter(letters)}

    def find(self, word: str) -> tuple[float, int] | None:
        if word in self.memo:
            return self.memo[word]
        hit = None
        if word in self.near or any(word[:k] in s for k, s in self.stems.items()) or not self.near.isdisjoint(_shorter(word)):
            hit = self.walk(word)
        if len(self.memo) >= MEMO_WORDS:
            self.memo.clear()
        self.memo[word] = hit
        return hit

    def walk(self, word: str) -> tuple[float, int] | None:
        """Intersect the automaton of ``word`` with the trie; the best hit has fewest edits, then most weight."""
        n, best = len(word), None
        stack = [(self.root, {0: 0} | ({1: 1} if n else {}), 0)]  # node, states (letters read: edits), depth
        while stack:
            node, states, depth = stack.pop()
            for c, below in node.items():
                if c in ("$", "*"):
                    weight, letters = below
                    edits = min((e + n - i for i, e in states.items()), default=9) if c == "$" else min((e for i, e in states.items() if i == depth and e == 0), default=9)
                    allowed = 1 if c == "$" and len(letters) >= FUZZY_LETTERS else 0
                    if edits <= allowed and (best is None or (edits, -weight) < (best[1], -best[0])):
                        best = (weight, edits)
                    continue
                after: dict[int, int] = {}
                for i, e in states.items():
                    if i < n and word[i] == c:
                        after[i + 1] = min(e, after.get(i + 1, 9))
                    elif e == 0:
                        after[i + 1] = min(1, after.get(i + 1, 9))  # another letter
                    if e == 0:
                        after[i] = min(1, after.get(i, 9))  # a letter left out of the word
                        if i + 1 < n and word[i + 1] == c:
                            after[i + 2] = min(1, after.get(i + 2, 9))  # a letter too many in the word
                after = {i: e for i, e in after.items() if i <= n}
                if after:
                    stack.append((below, after, depth + 1))
        return best

    def features(self, text: str | None) -> tuple[float, float, float, float]:
        """Logarithms of 1 plus: exact hits outside quotation, misspelled ones, quoted ones, exact hits per 100 words."""
        low = (text or "").lower()
        words = WORD.findall(low)
        if not any([self.find(w) for w in set(words)]):
            return (0.0, 0.0, 0.0, 0.0)
        spans = [m.span() for m in WORD.finditer(low)]
        sums = [0.0, 0.0, 0.0]
        for i, w in enumerate(words):
            if hit := self.find(w):
                near = words[max(0, i - CONTEXT) : i] + words[i + 1 : i + 1 + CONTEXT]
                before = low[spans[max(0, i - CONTEXT)][0] : spans[i][0]]
                after = low[spans[i][1] : spans[min(len(words) - 1, i + CONTEXT)][1]]
                quoted = len(QUOTES.findall(before)) % 2 == 1 and QUOTES.search(after) is not None
                reported = not REPORTING.isdisjoint(near)
                weight = hit[0] * (1.5 if not ADDRESS.isdisjoint(near) else 1.0)
                sums[2 if quoted or (reported and QUOTES.search(before + after)) else 1 if hit[1] else 0] += weight
        return (math.log1p(sums[0]), math.log1p(sums[1]), math.log1p(sums[2]), math.log1p(100 * sums[0] / len(words)))


def units(words: set[str]) -> set[str]:
    return words | {w[:k] + "*" for w in words for k in STEMS if len(w) > k}


def in_training(doc_id: F.Column) -> F.Column:
    """Rows whose labels may be learnt; a null doc_id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 != 0


def _count(texts: DataFrame, only: frozenset[str] | None) -> DataFrame:
    """(unit, n): how many of the texts hold a unit; of all units or of the given ones."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            counts: Counter[str] = Counter()
            for text in frame["text"]:
                own = units(set(WORD.findall((text or "").lower())))
                counts.update(own if only is None else own & only)
            yield pd.DataFrame({"unit": list(counts), "n": list(counts.values())})

    return texts.select("text").distinct().mapInPandas(run, "unit string, n long").groupBy("unit").agg(F.sum("n").alias("n"))


def g_statistic(a: int, b: int, n_a: int, n_b: int) -> float:
    """Log-likelihood ratio statistic of a in n_a against b in n_b."""
    share = (a + b) / (n_a + n_b)
    term = lambda k, n: (k * math.log(k / (n * share)) if k else 0.0) + ((n - k) * math.log((n - k) / (n * (1 - share))) if n > k else 0.0)
    return 2 * (term(a, n_a) + term(b, n_b)) if 0 < share < 1 else 0.0


def _log_odds(a: int, b: int, n_a: int, n_b: int) -> float:
    return math.log((a + 0.5) / (n_a + 1)) - math.log((b + 0.5) / (n_b + 1))


def least_support(n_pos: int, n_neg: int) -> int:
    """Fewest toxic texts with which a unit that no other text holds becomes a term; with fewer, none can."""
    fits = (c for c in range(MIN_DOCS, n_pos + 1) if _log_odds(c, 0, n_pos, n_neg) >= MIN_LOG_ODDS and g_statistic(c, 0, n_pos, n_neg) >= MIN_G)
    return next(fits, n_pos + 1)


def _originals(texts: DataFrame) -> pd.DataFrame:
    """(key, l_toxic): one text of each near-duplicate class of either label; key is the hash of the text.

    The signatures of the sample (a few kilobytes a row) come to the driver.  In every band's buckets each member is
    compared with the one of least key; links give classes.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids = WordIds()
        for whole in frames:
            for at in range(0, len(whole), 256):
                frame = whole.iloc[at : at + 256]
                doc, h, count, _, _ = shingles(frame["text"].tolist(), ids)
                sig = signatures(len(frame), doc, h, count, BANDS * ROWS).astype("<u4")
                yield frame[["key", "l_toxic"]].assign(sig=[x.tobytes() for x in sig])

    own = texts.select("text", "l_toxic").distinct().select(F.xxhash64(F.coalesce("text", F.lit(""))).alias("key"), "text", "l_toxic")
    rows = own.mapInPandas(run, "key long, l_toxic int, sig binary").toPandas().sort_values(["l_toxic", "key"], ignore_index=True)
    label = rows["l_toxic"].to_numpy(np.uint32)[:, None]
    sig = np.frombuffer(b"".join(rows.pop("sig")), "<u4").reshape(len(rows), BANDS * ROWS)
    links = []
    for band in range(BANDS):
        _, bucket = np.unique(np.hstack([label, sig[:, band * ROWS : (band + 1) * ROWS]]), axis=0, return_inverse=True)
        order = np.argsort(bucket.ravel(), kind="stable")
        bucket = bucket.ravel()[order]
        hub = order[np.searchsorted(bucket, bucket)]
        order, hub = order[order != hub], hub[order != hub]
        links.append(np.column_stack([hub, order])[(sig[order] == sig[hub]).mean(axis=1) >= COPY_AGREEMENT])
    parent = list(range(len(rows)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    for x, y in np.unique(np.concatenate(links), axis=0).tolist():
        a, b = sorted((root(x), root(y)))
        parent[b] = a
    return rows[np.array([root(i) == i for i in range(len(rows))], bool)]


def _lexicon(pos: dict[str, int], neg: dict[str, int], n_pos: int, n_neg: int) -> dict[str, float]:
    odds = {u: _log_odds(c, neg.get(u, 0), n_pos, n_neg) for u, c in pos.items()}
    most: dict[str, int] = {}  # of a stem's words
    for w, c in pos.items():
        for k in STEMS if not w.endswith("*") else ():
            most[w[:k]] = max(c, most.get(w[:k], 0))
    kept: dict[str, float] = {}
    for u in sorted((u for u, x in odds.items() if x >= MIN_LOG_ODDS and g_statistic(pos[u], neg.get(u, 0), n_pos, n_neg) >= MIN_G), key=lambda u: (len(u), u)):
        letters = u.removesuffix("*")
        # A stem that tells as much stands for its words; a word known to be toxic isn't widened to its stem.
        if any(kept.get(letters[:k] + "*", -9.0) >= odds[u] - 1.0 for k in STEMS if k < len(letters)):
            continue
        if u.endswith("*") and pos[u] <= 1.2 * most.get(letters, 0):
            continue
        kept[u] = round(odds[u], 6)
    return dict(sorted(kept.items(), key=lambda x: (-pos[x[0]], x[0])))


def _logistic(x: np.ndarray, y: np.ndarray, penalty: float = 0.1) -> tuple[float, ...]:
    """Newton's method with an L2 penalty; every weight but the intercept is kept at 0 or more."""
    x = np.column_stack([x, np.ones(len(x))])
    ridge, w = np.diag([penalty] * (x.shape[1] - 1) + [1e-6]), np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (y - p) - ridge @ w)
        w = w + np.clip(step, -2, 2)
        w[:-1] = np.maximum(w[:-1], 0)
        if np.abs(step).max() < 1e-6:
            break
    return tuple(round(float(v), 6) for v in w)


def fit_toxicity(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> ToxicModel:
    """Learn lexicon and weights from at most ``sample_rows`` labelled training rows (those of least hash).

    Inputs are texts alone.  Without toxic rows or without terms the score is the same for every text.
    """
    own = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("l_id")).agg(F.max(F.col("toxic").cast("int")).alias("l_toxic"))
    sample = own.where(in_training(F.col("l_id"))).orderBy(F.xxhash64("l_id"), "l_id").limit(sample_rows)
    # At most sample_rows pairs of numbers (under 1 MB): that is the bound of this broadcast.
    texts = docs.select(F.col("doc_id").cast("long").alias("t_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(sample), F.col("t_id") == F.col("l_id"))
    texts = materialise(texts.select("text", "l_toxic"), "toxic-sample")
    first = _originals(texts)
    n_pos, n_neg = int((first["l_toxic"] == 1).sum()), int((first["l_toxic"] == 0).sum())
    model = ToxicModel()
    if n_pos and n_neg:
        # Again at most sample_rows pairs of numbers.
        own = F.broadcast(docs.sparkSession.createDataFrame(first.rename(columns={"key": "o_key", "l_toxic": "o_toxic"}), "o_key long, o_toxic int"))
        counted = texts.join(own, (F.xxhash64(F.coalesce("text", F.lit(""))) == F.col("o_key")) & (F.col("l_toxic") == F.col("o_toxic")), "left_semi")
        pos = {r[0]: r[1] for r in _count(counted.where("l_toxic = 1"), None).where(F.col("n") >= least_support(n_pos, n_neg)).toLocalIterator()}
        neg = {r[0]: r[1] for r in _count(counted.where("l_toxic = 0"), frozenset(pos)).toLocalIterator()} if pos else {}
        terms = _lexicon(pos, neg, n_pos, n_neg)
        found = texts.select("l_toxic", _features(terms)("text").alias("x")).toPandas()
        model = ToxicModel(terms, _logistic(np.array(found["x"].tolist(), float).reshape(len(found), 4), found["l_toxic"].to_numpy(float)))
    release(texts)
    return model


def _features(terms: dict[str, float]):
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        lexicon = Lexicon(terms)
        for batch in texts:
            yield pd.Series([lexicon.features(t) for t in batch], dtype=object)

    run.__annotations__ = {"texts": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, "array<double>")


def score_toxicity(docs: DataFrame, model: ToxicModel, column: str = "toxicity") -> DataFrame:
    """Adds the score, 0 to 1, to every row.

    Defined cases: a null text counts as empty; a text without hits has the score of the intercept alone; repeated rows
    and rows with null doc_ids are scored like any other; an empty table gives no rows; other columns are kept, but for
    one named like ``column``.
    """
    (x,) = fresh([*docs.columns, column], "__x")
    rows = docs.withColumn(x, _features(model.terms)(F.col("text").cast("string")))
    z = sum((F.col(x)[i] * w for i, w in enumerate(model.weights[:-1])), F.lit(model.weights[-1]))
    return rows.withColumn(column, 1 / (1 + F.exp(-z))).drop(x)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score_toxicity(docs, fit_toxicity(docs, read_table(spark, sf_dir, "labels")), "score")
    return scored.select("doc_id", (~in_training(F.col("doc_id"))).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
