"""Alignment of two tokenizers over the same bytes, by products of sparse matrices.

A text's bytes are cut by a byte-level BPE (A) and by a sentencepiece model (B).  The incidence matrix of A has a row a
token and a column a byte, that of B likewise; both are built by hand as compressed sparse rows (CSR).  Their product
A x B^T, by Gustavson's row products, has an entry for every pair of overlapping tokens, its value the bytes that they
share.  Neighbouring rows without a common column meet at a byte where a token of either side ends, which cuts the
tokens into groups.  The group incidences (groups x ids, for A and for B) are sparse matrices again, and the product
of one's transpose with the other has an entry for every pair of ids that share a group, its value their occurrences.

In how many documents of the corpus a pair of ids is linked is counted on Spark.  Tasks work in blocks of bounded size:
a block's documents point into the block's own dictionary of pairs, and only dictionaries are shuffled for counting,
which are far smaller than all links.  The counts come back to the block, where a product of the documents' rows with
them gives each document's sums.  No group is larger than a block, and nothing that grows is broadcast.
"""

from __future__ import annotations

import functools
import hashlib
import json
import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import byte_alphabet
from .common import materialise, read_table

#: Characters and texts of one batch; linked pairs of one block; pairs in one row of a dictionary.
BATCH_CHARS, BATCH, BLOCK_LINKS, DICTIONARY_ROW = 1 << 20, 256, 1_000_000, 4096
#: Products that one step of a matrix product expands at once.
EXPANDED = 1 << 22
#: Chunks and tokens after which a task's memo is emptied.
MEMO_CHUNKS, MEMO_TOKENS = 250_000, 2_000_000
#: A blank between two characters that are not white space.
CUT = re.compile(r"(?<=\S) (?=\S)")
#: A pair of ids is one number: A's id times this, plus B's.
SHIFT = 20
# Fixed value of the sentencepiece format: the mark for a blank.
BLANK = "▁"


class Csr:
    """A sparse matrix by rows: columns ``indices[indptr[i]:indptr[i + 1]]`` of row i, ascending, and their values."""

    def __init__(self, indptr: np.ndarray, indices: np.ndarray, values: np.ndarray, width: int):
        self.indptr, self.indices, self.values, self.width = indptr, indices, values, width

    @property
    def height(self) -> int:
        return len(self.indptr) - 1

    @classmethod
    def summed(cls, rows: np.ndarray, columns: np.ndarray, values: np.ndarray, height: int, width: int) -> Csr:
        """From entries in any order; equal places are added."""
        key = rows.astype(np.int64) * width + columns
        if len(key) and (key[1:] < key[:-1]).any():
            order = np.argsort(key, kind="stable")
            key, values = key[order], values[order]
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
        key, values = key[first], np.add.reduceat(values, first) if len(first) else values
        return cls(np.searchsorted(key, np.arange(height + 1, dtype=np.int64) * width), key % width, values, width)

    @classmethod
    def of_spans(cls, ends: np.ndarray, width: int) -> Csr:
        """Incidence of consecutive spans (rows) with the bytes that they cover (columns)."""
        return cls(np.append(0, ends), np.arange(width), np.ones(width, np.int64), width)

    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(self.height), np.diff(self.indptr))

    def transposed(self) -> Csr:
        order = np.argsort(self.indices, kind="stable")
        return Csr(np.searchsorted(self.indices[order], np.arange(self.width + 1)), self.rows()[order], self.values[order], self.height)

    def times(self, other: Csr) -> Csr:
        """Gustavson's product: each row is the sum of the other matrix's rows that its entries name, so many rows at a
        time as expand to a bounded number of products (one row at least)."""
        fan = np.diff(other.indptr)[self.indices]
        reach = np.append(0, np.cumsum(fan))[self.indptr]
        parts, at = [], 0
        while at < self.height:
            to = max(at + 1, int(np.searchsorted(reach, reach[at] + EXPANDED, side="right")) - 1)
            i, j = self.indptr[at], self.indptr[to]
            n = fan[i:j]
            place = np.repeat(other.indptr[self.indices[i:j]] - np.append(0, np.cumsum(n)[:-1]), n) + np.arange(n.sum())
            own = np.repeat(np.repeat(np.arange(to - at), np.diff(self.indptr[at : to + 1])), n)
            parts.append(Csr.summed(own, other.indices[place], np.repeat(self.values[i:j], n) * other.values[place], to - at, other.width))
            at = to
        if not parts:
            return Csr(np.zeros(1, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), other.width)
        sizes = np.append(0, np.cumsum([len(p.indices) for p in parts]))
        indptr = np.concatenate([[0], *[p.indptr[1:] + s for p, s in zip(parts, sizes, strict=False)]])
        return Csr(indptr, np.concatenate([p.indices for p in parts]), np.concatenate([p.values for p in parts]), other.width)


def group_of(overlap: Csr) -> tuple[np.ndarray, np.ndarray]:
    """The group of each row and of each column, from the overlap links: neighbours with a common link stay together."""
    if not overlap.height:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first, last = overlap.indices[overlap.indptr[:-1]], overlap.indices[overlap.indptr[1:] - 1]
    rows = np.append(0, np.cumsum(last[:-1] != first[1:]))
    columns = np.zeros(overlap.width, np.int64)
    columns[overlap.indices] = np.repeat(rows, np.diff(overlap.indptr))
    return rows, columns


class Side:
    """One tokenizer's tokens of known chunks, chunk after chunk: ids, groups in the chunk, and where a chunk starts."""

    def __init__(self):
        self.ids, self.group, self.starts = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(1, np.int64)

    def add(self, ids: np.ndarray, group: np.ndarray, counts: np.ndarray) -> None:
        self.ids, self.group = np.append(self.ids, ids), np.append(self.group, group)
        self.starts = np.append(self.starts, self.starts[-1] + np.cumsum(counts))

    def of(self, chunks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids and groups of the tokens of many chunks, and how many each has."""
        n = np.diff(self.starts)[chunks]
        place = np.repeat(self.starts[chunks] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        return self.ids[place], self.group[place], n


def _flat(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    return np.fromiter(chain.from_iterable(lists), np.int64, sum(map(len, lists))), np.array([*map(len, lists)], np.int64)


class Aligner:
    """Tokens and groups of texts.  A blank between two characters that are not white space is a certain cut of both
    tokenizers; a bounded memo keeps the chunks between such cuts, and new chunks are aligned together."""

    def __init__(self, a_path: str, b_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has one task a core
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        place = {c: b for b, c in enumerate(byte_alphabet())}
        with open(a_path, encoding="utf-8") as f:
            vocab = json.load(f)["model"]["vocab"]
        self.a_bytes = [b""] * self.a.get_vocab_size()
        for token, i in vocab.items():
            self.a_bytes[i] = bytes(place[c] for c in token)
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        piece = self.b.id_to_piece
        self.b_bytes = [bytes([int(piece(i)[3:-1], 16)]) if self.b.is_byte(i) else piece(i).replace(BLANK, " ").encode("utf-8") for i in range(self.b.get_piece_size())]
        self.a_size, self.b_size = (np.array([*map(len, x)], np.int64) for x in (self.a_bytes, self.b_bytes))
        # A token as text with what stands after it: the next of its side, the other side, the next group.
        a, b = len(self.a_bytes), len(self.b_bytes)
        self.names = np.array([*(f"{i}{end}" for end in ",|" for i in range(a)), *(f"{i}{end}" for end in ",;" for i in range(b))], object)
        self.forget()

    def forget(self) -> None:
        self.place: dict[str, int] = {}
        self.bad: set[str] = set()
        self.known_a, self.known_b, self.groups = Side(), Side(), np.zeros(0, np.int64)

    def tokens(self, chunks: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of both sides of blank and chunk; none where the bytes of either side's tokens are others."""
        a = [e.ids for e in self.a.encode_batch_fast([" " + c for c in chunks], add_special_tokens=False)]
        b = self.b.encode(chunks, num_threads=1)
        for i, chunk in enumerate(chunks):
            raw = b" " + chunk.encode("utf-8")
            if b"".join(map(self.a_bytes.__getitem__, a[i])) != raw or b"".join(map(self.b_bytes.__getitem__, b[i])) != raw:
                self.bad.add(chunk)
                a[i], b[i] = [], []
        return a, b

    def learn(self, chunks: list[str]) -> None:
        """Take new chunks into the memo: their groups come from the overlap links of them all."""
        (a, n_a), (b, n_b) = (_flat(x) for x in self.tokens(chunks))
        a_group, b_group = group_of(overlap_links(self.a_size[a], self.b_size[b]))
        last = np.append(a_group, -1)[np.cumsum(n_a) - 1] + 1  # groups before the end of each chunk; bad chunks have none
        last = np.maximum.accumulate(np.where(n_a > 0, last, 0)) if len(last) else last
        first = np.append(0, last[:-1])
        self.known_a.add(a, a_group - np.repeat(first, n_a), n_a)
        self.known_b.add(b, b_group - np.repeat(first, n_b), n_b)
        self.groups = np.append(self.groups, last - first)
        self.place.update(zip(chunks, range(len(self.place), len(self.place) + len(chunks)), strict=True))

    def align(self, texts: list[str | None]) -> Batch:
        if len(self.place) > MEMO_CHUNKS or len(self.known_a.ids) > MEMO_TOKENS:
            self.forget()
        plans = [CUT.split(t) if t else [] for t in texts]
        if new := list(set(chain.from_iterable(plans)).difference(self.place)):
            self.learn(new)
        plans = [[] if self.bad and not self.bad.isdisjoint(p) else p for p in plans]
        return Batch(self, *_flat([[*map(self.place.__getitem__, p)] for p in plans]))


def overlap_links(a_sizes: np.ndarray, b_sizes: np.ndarray) -> Csr:
    """A x B^T for the tokens' lengths in bytes of two divisions of the same bytes."""
    n_bytes = int(a_sizes.sum())
    return Csr.of_spans(np.cumsum(a_sizes), n_bytes).times(Csr.of_spans(np.cumsum(b_sizes), n_bytes).transposed())


class Batch:
    """Tokens and links of a batch of texts; tokens and groups are numbered through the batch."""

    def __init__(self, own: Aligner, chunks: np.ndarray, n_chunks: np.ndarray):
        self.own, self.n_docs = own, len(n_chunks)
        before = np.cumsum(own.groups[chunks]) - own.groups[chunks]
        self.n_groups = int(own.groups[chunks].sum())
        doc = np.repeat(np.arange(self.n_docs), n_chunks)
        self.group_doc = np.repeat(doc, own.groups[chunks])
        self.a_ids, self.a_group, n = own.known_a.of(chunks)
        self.a_group, self.a_doc = self.a_group + np.repeat(before, n), np.repeat(doc, n)
        self.b_ids, self.b_group, n = own.known_b.of(chunks)
        self.b_group, self.b_doc = self.b_group + np.repeat(before, n), np.repeat(doc, n)
        self.n_a, self.n_b, self.groups = (np.bincount(d, minlength=self.n_docs) for d in (self.a_doc, self.b_doc, self.group_doc))

    def overlap(self) -> Csr:
        return overlap_links(self.own.a_size[self.a_ids], self.own.b_size[self.b_ids])

    def linked_ids(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document, pair of ids, its occurrences) of all shared-group links, by document and pair."""
        a_vocab, b_vocab = len(self.own.a_size), len(self.own.b_size)
        key, row = np.unique(self.a_doc * a_vocab + self.a_ids, return_inverse=True)  # a row for each id of each document
        a = Csr.summed(row, self.a_group, np.ones(len(row), np.int64), len(key), self.n_groups)
        b = Csr.summed(self.b_group, self.b_ids, np.ones(len(self.b_ids), np.int64), self.n_groups, b_vocab)
        links = a.times(b)
        of = links.rows()
        return key[of] // a_vocab, (key[of] % a_vocab) << SHIFT | links.indices, links.values

    def group_sizes(self) -> tuple[np.ndarray, np.ndarray]:
        return tuple(np.bincount(g, minlength=self.n_groups) for g in (self.a_group, self.b_group))

    def names(self) -> list[str]:
        """Each document's groups as text."""
        n_a, n_b = self.group_sizes()
        a_last, b_last = (np.append(g[1:] != g[:-1], True) if len(g) else np.zeros(0, bool) for g in (self.a_group, self.b_group))
        a, b = len(self.own.a_size), len(self.own.b_size)
        code = np.zeros(len(self.a_ids) + len(self.b_ids), np.int64)
        code[np.arange(len(self.a_ids)) + (np.cumsum(n_b) - n_b)[self.a_group]] = self.a_ids + a * a_last
        code[np.arange(len(self.b_ids)) + np.cumsum(n_a)[self.b_group]] = 2 * a + self.b_ids + b * b_last
        parts, ends = self.own.names[code].tolist(), np.cumsum(self.n_a + self.n_b).tolist()
        return ["".join(parts[i:j])[:-1] for i, j in zip([0, *ends], ends, strict=False)]

    def per_document(self) -> dict[str, np.ndarray]:
        n_a, n_b = self.group_sizes()
        links = np.zeros(self.n_docs, np.int64)
        np.add.at(links, self.group_doc, n_a * n_b)
        return {"n_a": self.n_a, "n_b": self.n_b, "n_groups": self.groups, "n_links": links}


@functools.cache
def aligner(a_path: str, b_path: str) -> Aligner:
    """One a Python worker."""
    return Aligner(a_path, b_path)


def batches_of(whole: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, list[str | None]]]:
    """Runs of rows of a bounded number of texts and, but for a single longer text, characters."""
    texts = whole.column("text").to_pylist()
    start = chars = 0
    for i, text in enumerate(texts):
        size = len(text or "")
        if i > start and (chars + size > BATCH_CHARS or i - start >= BATCH):
            yield whole.slice(start, i - start), texts[start:i]
            start, chars = i, 0
        chars += size
    if texts:
        yield whole.slice(start), texts[start:]


def _lists(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)), pa.int32()), pa.array(values, kind))


def _docs(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def alignment(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """The tokens of both sides with their groups, and the overlap links, of every whole text.

    Returns doc_id, a_ids, b_ids, a_group, b_group (arrays of int; groups from 0 in each document) and overlap
    (array of (a, b, bytes): places of the two tokens, bytes that they share).  Defined cases as for ``linked_counts``.
    """
    schema = "doc_id long, a_ids array<int>, b_ids array<int>, a_group array<int>, b_group array<int>, overlap array<struct<a: int, b: int, bytes: int>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = aligner(a_path, b_path)
        for whole in batches:
            for batch, texts in batches_of(whole):
                x = own.align(texts)
                links = x.overlap()
                rows, (first_a, first_b, first_group) = links.rows(), (np.cumsum(c) - c for c in (x.n_a, x.n_b, x.groups))
                doc = x.a_doc[rows]
                shared = pa.StructArray.from_arrays([pa.array(v, pa.int32()) for v in (rows - first_a[doc], links.indices - first_b[doc], links.values)], ["a", "b", "bytes"])
                overlap = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(np.bincount(doc, minlength=x.n_docs))), pa.int32()), shared)
                groups = ((x.a_group - first_group[x.a_doc], x.n_a), (x.b_group - first_group[x.b_doc], x.n_b))
                columns = [batch.column("doc_id"), *(_lists(v, n, pa.int32()) for v, n in ((x.a_ids, x.n_a), (x.b_ids, x.n_b), *groups)), overlap]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "a_ids", "b_ids", "a_group", "b_group", "overlap"])

    return _docs(docs).mapInArrow(run, schema)


#: Rows of documents (own: places in the block's dictionary, times: occurrences) and of dictionaries (first: place of
#: the row's first pair, pairs, holders: documents of the block that hold each).
BLOCKS = "block long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, own array<int>, times array<long>, first int, pairs array<long>, holders array<long>"
_ARROW = pa.schema([
    ("block", pa.int64()), ("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()), ("groups_sha256", pa.string()),
    ("own", pa.list_(pa.int32())), ("times", pa.list_(pa.int64())), ("first", pa.int32()), ("pairs", pa.list_(pa.int64())), ("holders", pa.list_(pa.int64())),
])


def _rows(**columns: pa.Array) -> pa.RecordBatch:
    n = len(next(iter(columns.values())))
    return pa.RecordBatch.from_arrays([columns[f.name] if f.name in columns else pa.nulls(n, f.type) for f in _ARROW], schema=_ARROW)


def _block(number: int, parts: list[tuple]) -> Iterator[pa.RecordBatch]:
    """The rows of one block: its documents, then its dictionary."""
    pairs, place, holders = np.unique(np.concatenate([p[3] for p in parts]), return_inverse=True, return_counts=True)
    at = 0
    for ids, counts, hashes, own, times, per in parts:
        n = len(ids)
        yield _rows(
            block=pa.array([number] * n, pa.int64()), doc_id=ids, groups_sha256=pa.array(hashes, pa.string()), own=_lists(place[at : at + len(own)], counts, pa.int32()),
            times=_lists(times, counts, pa.int64()), **{k: pa.array(v, pa.int64()) for k, v in per.items()},
        )
        at += len(own)
    if len(pairs):
        starts = np.arange(0, len(pairs), DICTIONARY_ROW)
        sizes = np.diff(np.append(starts, len(pairs)))
        yield _rows(block=pa.array([number] * len(starts), pa.int64()), first=pa.array(starts, pa.int32()), pairs=_lists(pairs, sizes, pa.int64()), holders=_lists(holders, sizes, pa.int64()))


def _blocks(docs: DataFrame, a_path: str, b_path: str, block_links: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, number, parts, size = aligner(a_path, b_path), TaskContext.get().partitionId() << 32, [], 0
        for whole in batches:
            for batch, texts in batches_of(whole):
                x = own.align(texts)
                doc, pairs, times = x.linked_ids()
                hashes = [hashlib.sha256(s.encode()).hexdigest() if s else "" for s in x.names()]
                parts.append((batch.column("doc_id"), np.bincount(doc, minlength=len(texts)), hashes, pairs, times, x.per_document()))
                size += len(pairs)
                if size >= block_links:
                    yield from _block(number, parts)
                    number, parts, size = number + 1, [], 0
        if parts:
            yield from _block(number, parts)

    return _docs(docs).mapInArrow(run, BLOCKS)


def linked_counts(docs: DataFrame, a_path: str, b_path: str, block_links: int = BLOCK_LINKS) -> DataFrame:
    """Groups and links of every whole text, and how common its links are in the corpus.

    Returns doc_id, n_a, n_b, n_groups, n_links, groups_sha256, n_best (links whose pair of ids is linked in as many
    documents as any pair of its A id) and count_sum (documents of the pair, over links).  Defined cases: null and empty
    texts, and texts whose bytes are not those of both sides' tokens (such as texts with the mark for a blank), have no
    tokens, zeros and an empty groups_sha256; strings of special tokens are plain text; null and repeated doc_ids are a
    row and a holder each; very long texts are a block by themselves; other columns are ignored; no rows for no rows.
    """
    table = materialise(_blocks(docs, a_path, b_path, block_links), "alignment")
    entries = F.posexplode(F.arrays_zip("pairs", "holders"))
    dictionary = table.where("pairs is not null").select("block", "first", entries).select("block", (F.col("first") + F.col("pos")).alias("place"), "col.pairs", "col.holders")
    counts = materialise(dictionary.groupBy("pairs").agg(F.sum("holders").alias("count")), "pair-counts", small=True)
    a_id = F.shiftright("pairs", SHIFT)
    most = counts.groupBy(a_id.alias("a_id")).agg(F.max("count").alias("most"))  # rows: A's ids at most, whatever the corpus
    judged = counts.join(F.broadcast(most), a_id == F.col("a_id")).select(F.col("pairs").alias("pair"), "count", (F.col("count") == F.col("most")).alias("best"))
    answers = dictionary.join(judged.hint("merge"), F.col("pairs") == F.col("pair")).select("block", "place", "count", "best")
    rows = table.where("pairs is null").drop("first", "pairs", "holders").withColumnRenamed("block", "of_block")

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        n = right.num_rows
        count, best = np.zeros(n, np.int64), np.zeros(n, np.int64)
        place = right.column("place").to_numpy()
        count[place], best[place] = right.column("count").to_numpy(), right.column("best").to_numpy()
        own, times = (left.column(c).combine_chunks() for c in ("own", "times"))
        links, flat, doc = np.asarray(own.flatten()), np.asarray(times.flatten()), np.asarray(own.value_parent_indices())
        sums = {"n_best": np.zeros(left.num_rows, np.int64), "count_sum": np.zeros(left.num_rows, np.int64)}
        np.add.at(sums["n_best"], doc, flat * best[links])
        np.add.at(sums["count_sum"], doc, flat * count[links])
        kept = left.drop_columns(["of_block", "own", "times"])
        for name, values in sums.items():
            kept = kept.append_column(name, pa.array(values))
        return kept

    schema = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long"
    return rows.groupBy("of_block").cogroup(answers.groupBy("block")).applyInArrow(finish, schema)


def tokenizer_files() -> tuple[str, str]:
    """The vocabularies that the query uses; operators take any paths."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = linked_counts(read_table(spark, sf_dir, "documents"), *tokenizer_files())
    return found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
