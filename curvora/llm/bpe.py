"""BPE encoding and decoding with forced-boundary splitting.

A merge can join two neighbouring bytes only if the pair stands side by side inside some vocabulary token.  Byte
pairs that occur in no token are therefore certain cuts: no merge ever crosses them, so the fragments between cuts
are encoded independently and their ids are concatenated.  Fragments are short and repeat, so each task keeps a
bounded memo of those it has met, and merges all new fragments of a batch together: in each round the lowest-ranked
pair of every fragment.  Spark partitions the documents and nothing is shuffled.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import json
import struct
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import read_table

#: Entries after which a task's memo is emptied; words longer than MEMO_CHARS are never kept.
MEMO_ENTRIES, MEMO_CHARS = 200_000, 64
# Fixed values of the vocabulary's file format: the suffix of a word's last symbol, its pre-tokenising pattern.
END = "</w>"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
WORDS = regex.compile(PATTERN)
#: Characters that str.split() takes for white space although the pattern's \s does not.
SEPARATORS = regex.compile("[\x1c-\x1f]")


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte: itself if printable in Latin-1, else from U+0100 on."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


@functools.cache
def unassigned() -> np.ndarray:
    """Marks the code points that Python's Unicode tables leave unassigned; other libraries' tables may have them."""
    return np.fromiter((unicodedata.category(chr(c)) == "Cn" for c in range(0x110000)), bool, 0x110000)


@functools.cache
def library_rules() -> tuple:
    """The tokenizers library's normal form with small letters, and its split into words, by its own tables."""
    from tokenizers import Regex, normalizers, pre_tokenizers

    return normalizers.Sequence([normalizers.NFC(), normalizers.Lowercase()]), pre_tokenizers.Split(Regex(PATTERN), "removed", invert=True)


def has_unassigned(text: str) -> bool:
    return not text.isascii() and bool(unassigned()[np.frombuffer(text.encode("utf-32-le"), np.uint32)].any())


#: Fragments of more bytes are merged by a heap, one by one; shorter ones all at once.
LONG = 256
NEVER = np.int32(2**31 - 1)


class Encoder:
    """Memos from a chunk without white space to its packed ids and decoded text; learn() fills them for many chunks."""

    def __init__(self, path: str):
        self.ids: dict[str, bytes] = {}
        self.text: dict[str, str] = {}
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.vocab = vocab = spec["model"]["vocab"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
        alphabet = byte_alphabet()
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.specials = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.token = {i: t for t, i in vocab.items()} | {i: t for t, i in self.special.items()}
        self.plain_id = np.array([vocab[c] for c in alphabet], np.int32)
        self.last_id = np.array([vocab[c + END] for c in alphabet], np.int32)
        # Pairs of bytes that stand side by side in some token: the only ones that a merge can ever join.
        place, joined = {c: b for b, c in enumerate(alphabet)}, np.zeros((256, 256), bool)
        for t in vocab:
            x = [place[c] for c in t.removesuffix(END)]
            joined[x[:-1], x[1:]] = True
        self.cut = ~joined
        # Ranks of pairs of ids in a hash table with linear probing.
        self.merged = np.array([vocab[x + y] for x, y in merges], np.int32)
        self.keys, self.ranks = np.full(1 << 18, -1, np.int64), np.full(1 << 18, NEVER, np.int32)
        self.rank_of = {}
        for rank, (x, y) in enumerate(merges):
            key = (vocab[x] << 20) | vocab[y]
            self.rank_of.setdefault(key, rank)
            slot = self.slot(key)
            while self.keys[slot] not in (-1, key):
                slot = (slot + 1) & 0x3FFFF
            if self.keys[slot] == -1:
                self.keys[slot], self.ranks[slot] = key, rank

    @staticmethod
    def slot(key):
        return ((key * 0x9E3779B1) >> 22) & 0x3FFFF

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = (left.astype(np.int64) << 20) | right
        slot = self.slot(key)
        found = self.keys[slot]
        out = np.where(found == key, self.ranks[slot], NEVER)
        open_ = np.flatnonzero((found != key) & (found != -1))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & 0x3FFFF
            found = self.keys[slot[open_]]
            hit = found == key[open_]
            out[open_[hit]] = self.ranks[slot[open_[hit]]]
            open_ = open_[~hit & (found != -1)]
        return out

    def merge_long(self, ids: list[int]) -> list[int]:
        """Joins the lowest-ranked pair, leftmost first, until none is left: a heap over a linked list."""
        n, rank = len(ids), lambda x, y: self.rank_of.get((x << 20) | y)
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := rank(ids[i], ids[i + 1])) is not None]
        heapq.heapify(heap)
        ids = [*ids]
        while heap:
            r, i, left, right = heapq.heappop(heap)
            j = after[i] if ids[i] == left else -1
            if j < 0 or ids[j] != right:
                continue  # one of the two has been merged since
            ids[i], ids[j] = int(self.merged[r]), -1
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
                if (r := rank(ids[i], ids[k])) is not None:
                    heapq.heappush(heap, (r, i, ids[i], ids[k]))
            if (h := before[i]) >= 0 and (r := rank(ids[h], ids[i])) is not None:
                heapq.heappush(heap, (r, h, ids[h], ids[i]))
        return [x for x in ids if x >= 0]

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words one after another, and how many each word has."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        raw = np.frombuffer(b"".join(words), np.uint8)
        ends = np.cumsum(sizes) - 1
        ids = self.plain_id[raw]
        ids[ends] = self.last_id[raw[ends]]
        word = np.repeat(np.arange(len(words)), sizes)
        new = np.ones(len(raw), bool)  # starts of fragments
        new[1:] = (word[1:] != word[:-1]) | self.cut[raw[:-1], raw[1:]]
        part, at, n = np.cumsum(new) - 1, np.arange(len(raw)), np.diff(np.append(np.flatnonzero(new), len(raw)))
        final, kept = ids, np.ones(len(raw), bool)
        for f in np.flatnonzero(n > LONG):
            i, j = np.searchsorted(part, [f, f + 1])
            out = self.merge_long(ids[i:j].tolist())
            final[i : i + len(out)] = out
            kept[i + len(out) : j] = False
        use = np.flatnonzero((n > 1)[part] & (n <= LONG)[part])
        ids, part, at = ids[use], part[use], at[use]
        rank = np.full(len(ids), NEVER, np.int32)
        same = np.flatnonzero(part[1:] == part[:-1])
        rank[same] = self.rank(ids[same], ids[same + 1])
        while len(ids):
            starts = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
            least = np.minimum.reduceat(rank, starts)
            spans = np.diff(np.append(starts, len(ids)))
            alive = least != NEVER
            if not alive.all():  # no pair of these fragments can be joined any more
                done = np.repeat(~alive, spans)
                final[at[done]] = ids[done]
                go = ~done
                ids, part, at, rank, least, spans = ids[go], part[go], at[go], rank[go], least[alive], spans[alive]
                if not len(ids):
                    break
            hit = np.flatnonzero(rank == np.repeat(least, spans))
            hit = hit[np.append(True, part[hit[1:]] != part[hit[:-1]])]  # the leftmost of each fragment
            ids[hit] = self.merged[rank[hit]]
            kept[at[hit + 1]] = False
            keep = np.ones(len(ids), bool)
            keep[hit + 1] = False
            place = np.cumsum(keep) - 1
            ids, part, at, rank = ids[keep], part[keep], at[keep], rank[keep]
            hit = place[hit]
            for side in (hit, hit - 1):
                side = side[(side >= 0) & (side < len(ids) - 1)]
                inside = part[side] == part[side + 1]
                rank[side[~inside]] = NEVER
                side = side[inside]
                rank[side] = self.rank(ids[side], ids[side + 1])
            if hit[-1] == len(ids) - 1:
                rank[-1] = NEVER
        return final[kept], np.bincount(word[kept], minlength=len(words))

    def learn(self, chunks: list[str]) -> None:
        """Put chunks that the memo lacks into it."""
        words, counts = [], []
        for c in chunks:
            if c.isalpha():
                words.append(c.encode("utf-8"))
                counts.append(1)
            elif c[-1] in ".,!" and c[:-1].isalpha():
                words += (c[:-1].encode("utf-8"), c[-1].encode("utf-8"))
                counts.append(2)
            else:
                found = [w for w, _ in library_rules()[1].pre_tokenize_str(c)] if has_unassigned(c) else WORDS.findall(c)
                words += [w.encode("utf-8") for w in found]
                counts.append(len(found))
        ids, n = self.encode_words(words)
        ends = np.append(0, np.cumsum(n))[np.cumsum(counts)].tolist()
        starts = [0, *ends[:-1]]
        packed, tokens = ids.astype("<u4").tobytes(), list(map(self.token.__getitem__, ids.tolist()))
        self.ids.update(zip(chunks, [packed[4 * a : 4 * b] for a, b in zip(starts, ends, strict=True)], strict=True))
        self.text.update(zip(chunks, [" ".join(tokens[a:b]) for a, b in zip(starts, ends, strict=True)], strict=True))

    def encode_many(self, texts: list[str | None]) -> Iterator[tuple[bytes, str]]:
        """For each text its ids as little-endian 32-bit integers and their decoded text (tokens joined by blanks).

        Strings of special tokens in a text are those tokens, and stay in the decoded text.
        """
        if len(self.ids) > MEMO_ENTRIES:
            self.ids.clear()
            self.text.clear()
        plans: list[list[list[str] | str]] = []
        for text in texts:
            text = text or ""
            pieces = self.specials.split(text) if self.specials and self.specials.search(text) else (text,)
            plans.append([p if p in self.special else self.chunks(p) for p in pieces if p])
        need: set[str] = set()
        for plan in plans:
            for p in plan:
                if isinstance(p, list):
                    need.update(p)
        need.difference_update(self.ids)
        if need:
            self.learn(list(need))
        long, ids_of, text_of = [c for c in need if len(c) > MEMO_CHARS], self.ids.__getitem__, self.text.__getitem__
        for plan in plans:
            ids, decoded = [], []
            for p in plan:
                if isinstance(p, str):
                    ids.append(struct.pack("<I", self.special[p]))
                    decoded.append(p)
                elif p:
                    ids.append(b"".join(map(ids_of, p)))
                    decoded.append(" ".join(map(text_of, p)))
            yield b"".join(ids), " ".join(decoded)
        for c in long:
            del self.ids[c], self.text[c]

    @staticmethod
    def chunks(text: str) -> list[str]:
        if has_unassigned(text):
            text = library_rules()[0].normalize_str(text)
        elif not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()  # capital sigma: the same small letter everywhere
        else:
            text = text.lower()
        return [c for c in regex.split(r"\s+", text) if c] if SEPARATORS.search(text) else text.split()


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One a Python worker."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def encode(docs: DataFrame, tokenizer_path: str, keep_ids: bool = True) -> DataFrame:
    """Encode each whole text and decode the ids again.

    Returns doc_id, n_tokens, ids_sha256, decoded_sha256 and, with ``keep_ids``, ids (array<int>) and decoded.
    Defined cases: a null text counts as empty and has no tokens; a null doc_id and repeated rows give a row each;
    other columns are ignored; an empty table gives no rows.
    """
    fields = [T.StructField("doc_id", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    if keep_ids:
        fields += [T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer_path)
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                n, a, b, kept, texts = [], [], [], [], []
                for ids, decoded in enc.encode_many(batch.column("text").to_pylist()):
                    n.append(len(ids) // 4)
                    a.append(hashlib.sha256(ids).hexdigest())
                    b.append(hashlib.sha256(decoded.encode("utf-8")).hexdigest())
                    if keep_ids:
                        kept.append(struct.unpack(f"<{len(ids) // 4}i", ids))
                        texts.append(decoded)
                columns = [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())]
                if keep_ids:
                    columns += [pa.array(kept, pa.list_(pa.int32())), pa.array(texts, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, [f.name for f in fields])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, T.StructType(fields))


def decode(encoded: DataFrame, tokenizer_path: str) -> DataFrame:
    """Decode an ids column (array<int>) to text; a null array gives an empty text.  Returns doc_id and decoded."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token = encoder(tokenizer_path).token
        for batch in batches:
            texts = [" ".join(token[i] for i in ids.as_py() or ()) for ids in batch.column("ids")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "decoded"])

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(run, "doc_id long, decoded string")


def tokenizer_file() -> str:
    """The vocabulary that the query uses; operators take any path."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(read_table(spark, sf_dir, "documents"), tokenizer_file(), keep_ids=False)
