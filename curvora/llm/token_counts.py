"""Token counts at every prefix, by dynamic programming.

A BPE encoding has one last token, and what stands before that token is the encoding of the shorter text.  So the count
of a prefix is the count of a shorter prefix plus one, and the last token is the only one that can follow the last token
before it: two tokens can stand side by side if the merges of their joined text give these two again.  The programme
goes over a text once and keeps, for every prefix, its last token and its exact count.

Pairs of characters that stand side by side in no piece are certain cuts, where counts simply add up.  A task keeps a
bounded memo of the stretches between cuts, each with the counts at all its prefixes.  Spark partitions the documents;
nothing is shuffled.

The stored counts answer questions about prefixes in SQL functions alone, without encoding again: ``tokens_before``
(count of any prefix), ``truncated`` (longest prefix within a limit), ``window_starts`` (cuts into windows of a limit).
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table

#: Stretches after which a task's memo is emptied; longer ones than MEMO_CHARS are never kept.
MEMO_ENTRIES, MEMO_CHARS = 400_000, 48
#: Texts of one batch; tokens above which a document is over the limit.
BATCH, LIMIT = 256, 4096
# Fixed value of the model's format: the mark for a blank.
BLANK = "▁"
#: Marks, then letters only or no letter at all: no piece goes beyond such a stretch (checked against the model).
STRETCH = regex.compile(rf"{BLANK}*(?:\p{{L}}+|[^\p{{L}}{BLANK}]+)|{BLANK}+")


class Counter:
    """The dynamic programme for one model, with its memo."""

    def __init__(self, path: str):
        import ahocorasick
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        plain = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        self.piece = {i: model.id_to_piece(i) for i in plain}
        self.score = {p: model.get_score(i) for i, p in self.piece.items()}
        if bad := [p for p in self.score if not STRETCH.fullmatch(p)]:
            raise ValueError(f"pieces beyond a stretch: {bad[:5]}")
        self.ending = ahocorasick.Automaton()  # all pieces that end at a place, the longest first
        for i, p in self.piece.items():
            self.ending.add_word(p, (i, len(p)))
        self.ending.make_automaton()
        self.memo: dict[str, bytes] = {}
        self.follows: dict[int, bool] = {}

    def merged(self, text: str) -> list[str]:
        """The encoding of a short text by its merges: the best pair, leftmost first, until none is left."""
        parts, score = list(text), self.score
        ranks = [score.get(a + b) for a, b in zip(parts, parts[1:], strict=False)]
        while known := [r for r in ranks if r is not None]:
            i = ranks.index(max(known))
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            ranks[i : i + 2] = [score.get(parts[i] + parts[i + 1])] if i + 1 < len(parts) else []
            if i:
                ranks[i - 1] = score.get(parts[i - 1] + parts[i])
        return parts

    def can_follow(self, left: int, right: int) -> bool:
        """Whether a piece can stand after another one; after none (0), whether its own merges end in it."""
        if len(self.follows) > MEMO_ENTRIES * 4:
            self.follows.clear()
        a, b = self.piece.get(left, ""), self.piece[right]
        out = self.follows[left << 20 | right] = self.merged(a + b) == ([a, b] if a else [b])
        return out

    def prefixes(self, stretch: str) -> list[int]:
        """The count at every prefix of a stretch, from one character on.  A character without a piece is its bytes."""
        counts, last, follows, done = [0], [0], self.follows, 0
        for at, (token, size) in self.ending.iter(stretch):
            if at < done:  # the last token of this prefix is known
                continue
            while done < at:
                counts.append(counts[done] + len(stretch[done].encode("utf-8")))
                last.append(0)
                done += 1
            start = at + 1 - size
            known = follows.get(last[start] << 20 | token)
            if known or known is None and self.can_follow(last[start], token):
                counts.append(counts[start] + 1)
                last.append(token)
                done += 1
        for c in stretch[done:]:
            counts.append(counts[-1] + len(c.encode("utf-8")))
        return counts[1:]

    def stretches(self, text: str) -> list[str]:
        return STRETCH.findall(BLANK + text.replace(" ", BLANK)) if text else []

    def count_many(self, texts: list[str | None]) -> list[np.ndarray]:
        """For each text the counts at its prefixes of 0, 1, ... characters; the last one is that of the whole text."""
        if len(self.memo) > MEMO_ENTRIES:
            self.memo.clear()
        plans = [self.stretches(t or "") for t in texts]
        memo, brief = self.memo, {}
        for s in set().union(*plans):
            if s not in memo:
                (memo if len(s) <= MEMO_CHARS else brief)[s] = np.array(self.prefixes(s), np.int32).tobytes()
        out = []
        for plan in plans:
            if not plan:
                out.append(np.zeros(1, np.int32))
                continue
            packed = [memo.get(s) or brief[s] for s in plan]
            counts = np.frombuffer(b"".join(packed), np.int32)
            sizes = np.fromiter(map(len, packed), np.int64, len(packed)) // 4
            ends = np.cumsum(sizes)
            before = np.append(0, np.cumsum(counts[ends - 1])[:-1])
            counts = counts + np.repeat(before, sizes).astype(np.int32)
            counts[0] = 0  # the mark that the model puts before a text is no prefix of it
            out.append(counts)
        return out


@functools.cache
def counter(path: str) -> Counter:
    """One a Python worker."""
    return Counter(path)


def token_counts(docs: DataFrame, model_path: str, keep_prefixes: bool = True) -> DataFrame:
    """Count the tokens of every whole text, and of every prefix of it.

    Returns doc_id, n_bytes, n_tokens and, with ``keep_prefixes``, counts (array<int>): element i, from 0, is the count
    of the first i code points.  Counts may fall from one prefix to the next, as a longer text may be one token.
    Defined cases: a null text counts as empty and has the counts [0]; strings of special tokens are plain text; null and
    repeated doc_ids give a row each; other columns are ignored; an empty table gives no rows.
    """
    schema = "doc_id long, n_bytes long, n_tokens long" + ", counts array<int>" * keep_prefixes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(model_path)
        for whole in batches:
            for at in range(0, whole.num_rows, BATCH):
                batch = whole.slice(at, BATCH)
                counts = own.count_many(batch.column("text").to_pylist())
                columns = [batch.column("doc_id"), batch.column("n_bytes"), pa.array([int(c[-1]) for c in counts], pa.int64())]
                names = ["doc_id", "n_bytes", "n_tokens"]
                if keep_prefixes:
                    offsets = np.append(0, np.cumsum([len(c) for c in counts])).astype(np.int32)
                    columns.append(pa.ListArray.from_arrays(offsets, np.concatenate(counts)))
                    names.append("counts")
                yield pa.RecordBatch.from_arrays(columns, names)

    text = F.col("text").cast("string")
    n_bytes = F.coalesce(F.octet_length(text), F.lit(0)).cast("long")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), n_bytes.alias("n_bytes"), text.alias("text")).mapInArrow(run, schema)


def tokens_before(chars: F.Column | int, counts: str = "counts") -> F.Column:
    """The count of the first ``chars`` code points; null where the text is shorter, or the number negative."""
    return F.get(F.col(counts), F.lit(chars) if isinstance(chars, int) else chars)


def truncated(limit: int, counts: str = "counts") -> F.Column:
    """Code points of the longest prefix of at most ``limit`` tokens; 0 where even one character has more."""
    within = F.transform(F.col(counts), lambda c, i: F.when(c <= limit, i).otherwise(0))
    return F.coalesce(F.array_max(within), F.lit(0))


def window_starts(limit: int, counts: str = "counts") -> F.Column:
    """Starts of consecutive windows, each opened where the count of the prefix passes a further multiple of ``limit``.

    By the counts alone: a window holds the tokens of the whole text's encoding between two such places.
    """
    steps = F.sequence(F.lit(0), F.greatest(F.floor((F.element_at(F.col(counts), -1) - 1) / limit).cast("int"), F.lit(0)))
    return F.transform(steps, lambda k: F.array_max(F.transform(F.col(counts), lambda c, i: F.when(c <= k * limit, i).otherwise(0))))


def model_file() -> str:
    """The model that the query uses; operators take any path."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = token_counts(read_table(spark, sf_dir, "documents"), model_file(), keep_prefixes=False)
    return found.withColumn("over_limit", F.col("n_tokens") > LIMIT)
