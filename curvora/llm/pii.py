"""Personal data: exact base patterns, and bootstrapped contextual extraction of further identifiers.

The base finds e-mail addresses, IP addresses, card and phone numbers.  They and key-like tokens (long
mixtures of letters and digits) seed a graph of lexical patterns and instances.  An instance is a token that holds a digit
or follows one of the signs of an assignment or quotation; a pattern is made of the words beside it.  Spark scores the
graph iteratively: a pattern's confidence is the share of its occurrences that stand at trusted instances, an instance's
score is one minus the product of its patterns' doubts; trusted instances raise further patterns, until a round adds
neither.  Occurrences of trusted instances beside patterns of high confidence are added as spans of kind ``other``, and
their occurrences elsewhere if most of them stand beside such patterns (the number 7 may be a password, but mostly isn't);
a key-like token that is never beside such a pattern isn't a span.
"""

from __future__ import annotations

import hashlib
import itertools
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, read_table, release

KINDS = ("email", "ip", "card", "phone")
#: Least distinct trusted instances behind a pattern; least confidence of a pattern and score of an instance.
MIN_SUPPORT, MIN_CONFIDENCE = 5, 0.8
#: Share of a trusted instance's occurrences beside qualified patterns from which its other occurrences are spans too.
MIN_SHARE = 0.5
#: Characters before an instance that are read first for the two words of its patterns; more where these are longer.
NEAR = 48
#: Signs that end a token, and those of them that a token without digits may follow.
BREAKS, OPENERS = "=:\"'<>(),;|", "=:\"'"
#: A key-like token: 32 or more characters with letters and digits among them.
KEY = re.compile(r"(?=[A-Za-z_-]*[0-9])(?=[0-9_-]*[A-Za-z])[A-Za-z0-9_-]{32,}")
# The base patterns.  Look-behinds and possessive repeats only keep a search from starting twice in one run.
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGITS = re.compile("[0-9]+")
#: Where a token may lie: at digits, or after a run of opening signs and blanks.
STARTS = re.compile(r"[0-9]+|[=:\"'][=:\"' ]*")
TAIL = re.compile(r"(\w+)?(\W*)\Z")
#: After an instance: blanks and quotation marks, then the signs and the word beside it.
NEXT = re.compile(r"[ \"']*([^\w\s]*)(\w*)")


def luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(number of the kind, start, end), by kind and start."""
    out: list[tuple[int, int, int]] = []
    at, last = text.find("@"), 0
    while at >= 0:
        start = at
        while start > last and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            out.append((0, start, m.end()))
            last = m.end()
            at = text.find("@", last)
        else:
            at = text.find("@", at + 1)
    if not DIGITS.search(text):
        return out
    out += [(1, *m.span()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append((2, *m.span()))
    if "+" in text:
        out += [(3, *m.span()) for m in PHONE.finditer(text) if 8 <= sum(map(str.isdigit, m[0])) <= 15]
    return out


def _token(text: str, at: int) -> tuple[int, int]:
    """The stretch around a position up to white space or one of BREAKS, without outer punctuation."""
    start = end = at
    while start and not text[start - 1].isspace() and text[start - 1] not in BREAKS:
        start -= 1
    while end < len(text) and not text[end].isspace() and text[end] not in BREAKS:
        end += 1
    while end > start and text[end - 1] in ".!?*#$%&":
        end -= 1
    return start, end


def _head(text: str, start: int) -> tuple[str, re.Match, re.Match]:
    """What stands before an instance in its line, at least two whole words of it, and the last word and the one before."""
    size = NEAR
    while True:
        low = max(0, start - size)
        head = text[low:start].lower()
        cut = head.rfind("\n") + 1
        head = head[cut:]
        last = TAIL.search(head)
        before = TAIL.search(head[: last.start()])
        if cut or not low or before.start() and last.start():
            return head, last, before
        size *= 2


def _contexts(text: str, start: int, end: int) -> list[str]:
    """Left word, two left words, and left with right word, all of them whole; signs between them belong to the pattern,
    blanks don't."""
    head, last, before = _head(text, start)
    signs = "".join(last[2].split())
    if not last[1] and not signs:
        return []
    right = "".join(NEXT.match(text, end).groups()).lower()
    left = f"{last[1] or ''} {signs}"
    out = [f"L {left}", f"B {left} _ {right}"]
    if before[1]:
        out.append(f"LL {before[1]} {''.join(before[2].split())} {left}")
    return out


SPAN = "struct<kind:int,start:int,end:int>"


def scan(docs: DataFrame) -> DataFrame:
    """docs: __row, doc_id, text.  Adds base (spans) and finds (occurrences of instances with their patterns)."""
    span = pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32())])
    find = pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("instance", pa.int64()), ("patterns", pa.list_(pa.int64()))])

    def key(s: str) -> int:
        return xxhash.xxh3_64_intdigest(s) - (1 << 63)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                bases, finds = [], []
                for text in batch.column("text").to_pylist():
                    text = text or ""
                    base = base_spans(text)
                    taken = sorted((a, b) for _, a, b in base)
                    seen, own, i = -1, [(k, a, b) for k, a, b in base], 0
                    for m in STARTS.finditer(text):
                        place = m.start() if m[0][0] not in OPENERS else m.end()
                        if place < seen:
                            continue
                        a, b = _token(text, place)
                        seen = max(b, m.end())
                        while i < len(taken) and taken[i][1] <= a:
                            i += 1
                        rivals = itertools.takewhile(lambda x, end=b: x[0] < end, itertools.islice(taken, i, None))
                        if a < b and all(y <= a for _, y in rivals):
                            own.append((-2 if KEY.fullmatch(text, a, b) else -1, a, b))
                    bases.append([dict(zip(("kind", "start", "end"), x, strict=True)) for x in base])
                    finds.append([{"kind": k, "start": a, "end": b, "instance": key(text[a:b]), "patterns": [key(p) for p in _contexts(text, a, b)]} for k, a, b in own])
                columns = [batch.column("__row"), batch.column("doc_id"), pa.array(bases, pa.list_(span)), pa.array(finds, pa.list_(find))]
                yield pa.RecordBatch.from_arrays(columns, ["__row", "doc_id", "base", "finds"])

    return docs.mapInArrow(run, f"__row long, doc_id long, base array<{SPAN}>, finds array<struct<kind:int,start:int,end:int,instance:long,patterns:array<long>>>")


def bootstrap(finds: DataFrame, min_support: int = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE) -> tuple[DataFrame, DataFrame] | None:
    """finds: seed (boolean), instance, pattern; one row an occurrence.  Returns the trusted instances (instance, score) and
    qualified patterns (gp, confidence), or None.

    Only patterns that enough distinct instances share can ever qualify, so the graph is cut to those first.  Scores never
    fall from round to round, so the rounds end.
    """
    edges = finds.groupBy("instance", "pattern").agg(F.count("*").alias("n"), F.max("seed").alias("seed"))
    edges = materialise(edges, "pii-edges")
    shared = edges.groupBy("pattern").agg(F.count("*").alias("c")).where(F.col("c") >= min_support).select(F.col("pattern").alias("sp"))
    graph = materialise(edges.join(shared, F.col("pattern") == F.col("sp"), "left_semi"), "pii-graph")
    release(edges)
    known, before = None, (0, 0)
    while True:
        scored = graph.withColumn("s", F.col("seed").cast("double"))
        if known is not None:
            scored = graph.join(known.select(F.col("instance").alias("ki"), F.col("score").alias("ks")), F.col("instance") == F.col("ki"), "left")
            scored = scored.withColumn("s", F.greatest(F.col("seed").cast("double"), F.coalesce("ks", F.lit(0.0))))
        good = scored.groupBy("pattern").agg((F.sum(F.col("s") * F.col("n")) / F.sum("n")).alias("confidence"), F.sum(F.when(F.col("s") > 0, 1).otherwise(0)).alias("support"))
        good = materialise(good.where((F.col("support") >= min_support) & (F.col("confidence") >= min_confidence)).select(F.col("pattern").alias("gp"), F.least("confidence", F.lit(0.999)).alias("confidence")), "pii-patterns", small=True)
        patterns = good.count()
        if not patterns:
            return None
        found = graph.join(good, F.col("pattern") == F.col("gp")).groupBy("instance").agg((1 - F.exp(F.sum(F.log(1 - F.col("confidence"))))).alias("score"))
        release(known)
        known = materialise(found.where(F.col("score") >= min_confidence), "pii-instances", small=True)
        now = (patterns, known.count())
        if now == before:
            return known, good
        release(good)
        before = now


def find_pii(docs: DataFrame, min_support: int = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """Spans of personal data in every whole text: doc_id, base and spans (arrays of kind, start, end; code points).

    ``base`` has kinds 0 to 3 (of KINDS); ``spans`` adds discovered ones as kind 4, after them.  Defined cases: a null
    text counts as empty and has no spans; repeated rows and null doc_ids give a row each; equal tokens are one
    instance wherever they stand, whatever their length; very long texts are read whole; an empty table gives no rows;
    other columns are ignored.
    """
    docs = docs.select(F.monotonically_increasing_id().alias("__row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = materialise(scan(docs), "pii-rows")  # written once: the row numbers stay
    finds = rows.select("__row", F.explode("finds").alias("f"))
    edges = finds.select((F.col("f.kind") != -1).alias("seed"), F.col("f.instance").alias("instance"), F.explode("f.patterns").alias("pattern"))
    graph = bootstrap(edges, min_support, min_confidence)
    if graph is None:
        return rows.select("doc_id", "base", F.col("base").alias("spans"))
    known, good = graph
    met = finds.where("f.kind < 0").join(known.select(F.col("instance").alias("ki")), F.col("f.instance") == F.col("ki"), "left_semi")
    met = materialise(met.select("__row", "f.start", "f.end", "f.instance", "f.patterns"), "pii-met", small=True)
    place = ("__row", "start", "end", "instance")
    beside = met.select(*place, F.explode("patterns").alias("p")).join(good, F.col("p") == F.col("gp"), "left_semi").select(*place).distinct()
    beside = materialise(beside, "pii-beside", small=True)
    share = met.groupBy("instance").agg(F.count("*").alias("n")).join(beside.groupBy(F.col("instance").alias("bi")).agg(F.count("*").alias("b")), F.col("instance") == F.col("bi"))
    spread = share.where(F.col("b") >= MIN_SHARE * F.col("n")).select("bi")
    fresh = beside.select(*place).unionByName(met.select(*place).join(spread, F.col("instance") == F.col("bi"), "left_semi"))
    span = F.struct(F.lit(len(KINDS)).alias("kind"), "start", "end")
    fresh = fresh.groupBy(F.col("__row").alias("__r")).agg(F.sort_array(F.collect_set(span)).alias("more"))
    both = rows.join(fresh, rows["__row"] == fresh["__r"], "left")
    return both.select("doc_id", "base", F.when(F.col("more").isNull(), F.col("base")).otherwise(F.concat("base", F.col("more").cast(f"array<{SPAN}>"))).alias("spans"))


def joined(spans: str) -> F.Column:
    names = F.array(*[F.lit(k) for k in (*KINDS, "other")])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_pii(read_table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long")  # noqa: E731  (a second argument would be the element's place)
    counts = [count(k).alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return found.select("doc_id", *counts, F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"))


def brute_force(text: str | None) -> str:
    """The base by its definition, for tests: the digest of one text."""
    text = text or ""
    found = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(p) <= 255 for p in s.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda s: 16 <= len(d := re.sub("[^0-9]", "", s)) <= 19 and luhn(d)),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 8 <= len(re.sub("[^0-9]", "", s)) <= 15),
    ]
    return hashlib.sha256(",".join(f"{k}:{m.start()}:{m.end()}" for k, rx, ok in found for m in re.finditer(rx, text) if ok(m[0])).encode()).hexdigest()
