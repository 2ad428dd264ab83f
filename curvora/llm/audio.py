"""Media columns: chroma fingerprints of audio, and their alignment.

A recording is a binary column of WAV bytes.  Frames of it are folded to twelve pitch classes; an integral image over the
frames by pitch classes gives rectangle sums in four look-ups, sixteen filters compare such sums, and each answer, in two
Gray-coded bits, is packed into one 32-bit integer a frame.  Recordings with equal integers are one class, of which one
representative is compared.  Recordings are aligned by landmarks (every pair of frames a fixed gap apart): the rarest
landmarks of a query vote for a time offset, the fullest bin of a pair's offset histogram is its alignment, and, where it
has two votes or more, the share of differing bits over the overlap accepts or refuses it.

Recall against brute force over all offsets is measured in tests/llm/test_audio.py (0.9 at least).
"""

from __future__ import annotations

import io
import math
import wave
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, read_table

#: Samples of a frame and between frames; frames of the widest filter.
FRAME, HOP, WIDEST = 512, 256, 4
#: Frames between the two of a landmark; largest share of differing bits; least frames of overlap.
GAP, MAX_BER, MIN_OVERLAP = 2, 0.15, 24
#: Votes that an alignment needs.
MIN_VOTES = 2
#: Pitch range of the chroma in Hz; thresholds between the four answers of a filter.
LOW, HIGH, STEPS = 100.0, 2000.0, (-0.25, 0.0, 0.25)
GRAY = np.array([0, 1, 3, 2], np.uint32)
# Rule of the query's recordings: one note of HOP samples a value, QUANTUM of value a semitone, around MIDDLE (MIDI number).
RATE, QUANTUM, MIDDLE = 4000, 0.06, 69
#: Every so many-th row is also heard in an excerpt: its length in notes, its loudness, the share of noise.
EXCERPT_EVERY, EXCERPT_NOTES, GAIN, NOISE = 10, 40, 0.6, 0.01

#: (kind, first pitch class, pitch classes, frames) of each filter, by rule.
FILTERS = [(i % 4, (5 * i) % (13 - h), h, 2 + 2 * (i // 8)) for i in range(16) for h in (4 + 2 * (i % 3),)]


def decode_wav(data: bytes | None) -> tuple[np.ndarray, int]:
    """Samples (mean of channels, -1 to 1) and rate; no samples for null or for what is no 16-bit WAV."""
    try:
        with wave.open(io.BytesIO(data or b"")) as w:
            if w.getsampwidth() != 2:
                return np.zeros(0), 0
            raw = np.frombuffer(w.readframes(w.getnframes()), "<i2").astype(float) / 32768
            return raw.reshape(-1, w.getnchannels()).mean(axis=1), w.getframerate()
    except (wave.Error, EOFError, ValueError):
        return np.zeros(0), 0


_FOLDS: dict[int, np.ndarray] = {}


def _fold(rate: int) -> np.ndarray:
    """Matrix from bins of the spectrum to pitch classes."""
    if rate not in _FOLDS:
        hz = np.fft.rfftfreq(FRAME, 1 / rate)
        use = (hz >= LOW) & (hz <= HIGH)
        m = np.zeros((len(hz), 12))
        m[use, np.rint(12 * np.log2(hz[use] / 440)).astype(int) % 12] = 1
        _FOLDS[rate] = m
    return _FOLDS[rate]


_HANN = np.hanning(FRAME)


def chroma(samples: np.ndarray, rate: int) -> np.ndarray:
    if len(samples) < FRAME or rate <= 0:
        return np.zeros((0, 12))
    frames = np.lib.stride_tricks.sliding_window_view(samples, FRAME)[::HOP] * _HANN
    power = np.abs(np.fft.rfft(frames, axis=1)) ** 2 @ _fold(rate)
    total = power.sum(axis=1, keepdims=True)
    return np.divide(power, total, out=np.zeros_like(power), where=total > 1e-9)


def fingerprint(image: np.ndarray) -> np.ndarray:
    """One packed integer for each frame that has the widest filter's frames after it."""
    n = len(image) - WIDEST + 1
    if n <= 0:
        return np.zeros(0, np.uint32)
    s = np.zeros((len(image) + 1, 13))
    s[1:, 1:] = image.cumsum(0).cumsum(1)  # the integral image
    area = lambda t0, t1, p0, p1: s[t1 : t1 + n, p1] - s[t0 : t0 + n, p1] - s[t1 : t1 + n, p0] + s[t0 : t0 + n, p0]
    out = np.zeros(n, np.uint32)
    for kind, p, h, w in FILTERS:
        whole = area(0, w, p, p + h)
        if kind == 0:  # earlier against later
            a = area(0, w // 2, p, p + h)
        elif kind == 1:  # lower against higher pitch classes
            a = area(0, w, p, p + h // 2)
        elif kind == 2:  # opposite quarters
            a = area(0, w // 2, p, p + h // 2) + area(w // 2, w, p + h // 2, p + h)
        else:  # inner against outer pitch classes
            a = area(0, w, p + h // 4, p + h - h // 4)
        answer = np.log((0.05 + a) / (0.05 + whole - a))
        out = (out << np.uint32(2)) | GRAY[np.searchsorted(STEPS, answer)]
    return out


def fingerprints(recordings: DataFrame) -> DataFrame:
    """recordings (rec_id, audio): adds the packed integers, empty where there is no 16-bit audio of enough length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                prints = [fingerprint(chroma(*decode_wav(x.as_py()))).view(np.int32) for x in batch.column("audio")]
                yield pa.RecordBatch.from_arrays([batch.column("rec_id"), pa.array(prints, pa.list_(pa.int32()))], ["rec_id", "print"])

    return recordings.select(F.col("rec_id").cast("long").alias("rec_id"), "audio").mapInArrow(run, "rec_id long, print array<int>")


def _landmarks(prints: DataFrame) -> DataFrame:
    """(rec_id, key, at) of every landmark."""
    at = F.sequence(F.lit(0), F.size("print") - GAP - 1)
    pairs = F.transform(at, lambda i: F.struct(F.xxhash64(F.get("print", i), F.get("print", i + GAP)).alias("key"), i.alias("at")))
    return prints.where(F.size("print") > GAP).select("rec_id", F.explode(pairs).alias("l")).select("rec_id", "l.key", "l.at")


def bit_errors(a: np.ndarray, b: np.ndarray, offset: int) -> tuple[float, int]:
    """Share of differing bits where frame t of a meets frame t + offset of b, and the frames of overlap."""
    lo, hi = max(0, -offset), min(len(a), len(b) - offset)
    if hi <= lo:
        return 1.0, 0
    return float(np.bitwise_count(a[lo:hi] ^ b[lo + offset : hi + offset]).sum()) / (32 * (hi - lo)), hi - lo


def align(queries: DataFrame, prints: DataFrame, max_ber: float = MAX_BER, min_overlap: int = MIN_OVERLAP, min_votes: int = MIN_VOTES) -> DataFrame:
    """Align every query with the recordings that share landmarks with it.

    Both have rec_id and print.  Returns query_id, rec_id, offset (frames by which the recording lags), votes, overlap, ber.
    Defined cases: recordings without frames match nothing; null ids are left out; a recording isn't aligned with itself;
    equal recordings match at offset 0; of offsets with equal votes the one nearest 0, then the negative one, is taken;
    repeated ids are compared row by row; empty tables give no rows.
    """
    queries, prints = queries.where(F.col("rec_id").isNotNull()), prints.where(F.col("rec_id").isNotNull())
    r = _landmarks(prints)
    q = _landmarks(queries).select(F.col("rec_id").alias("query_id"), F.col("key").alias("q_key"), F.col("at").alias("q_at"))
    votes = q.join(r, (F.col("q_key") == F.col("key")) & (F.col("query_id") != F.col("rec_id")))
    histogram = votes.groupBy("query_id", "rec_id", (F.col("at") - F.col("q_at")).alias("offset")).agg(F.count("*").alias("votes")).where(F.col("votes") >= min_votes)
    best = histogram.groupBy("query_id", "rec_id").agg(F.max(F.struct(F.col("votes"), (-F.abs("offset")).alias("near"), (-F.col("offset")).alias("sign"))).alias("b"))
    best = materialise(best.select("query_id", "rec_id", (-F.col("b.sign")).alias("offset"), F.col("b.votes").alias("votes")), "audio-votes")
    best = best.join(queries.select(F.col("rec_id").alias("qa"), F.col("print").alias("qp")), F.col("query_id") == F.col("qa"))
    best = best.join(prints.select(F.col("rec_id").alias("ra"), F.col("print").alias("rp")), F.col("rec_id") == F.col("ra"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            found = [bit_errors(np.asarray(a, np.int32).view(np.uint32), np.asarray(b, np.int32).view(np.uint32), o) for a, b, o in zip(f["qp"], f["rp"], f["offset"], strict=True)]
            out = f[["query_id", "rec_id", "offset", "votes"]].assign(overlap=[n for _, n in found], ber=[e for e, _ in found])
            yield out[(out["ber"] <= max_ber) & (out["overlap"] >= min_overlap)]

    return best.select("query_id", "rec_id", "offset", "votes", "qp", "rp").mapInPandas(run, "query_id long, rec_id long, offset int, votes long, overlap long, ber double")


def search(recordings: DataFrame, asked: F.Column, **limits) -> DataFrame:
    """Classes of equal recordings, and alignments between representatives, in one table.

    recordings: rec_id and audio; ``asked`` tells which rows are queries.  Rows of kind ``member`` name each recording
    (rec_id) and the representative of its class, the least rec_id of those with equal prints (query_id); rows of kind
    ``match`` align the representative of a class with a query in it (query_id) with the representative of another
    class.  So the matches of a query are the members of its own class and those of all classes that its class matches.
    Defined cases: as for ``align``; a recording without frames is the only member of its class; one with a null rec_id
    has a member row, with a null query_id where all recordings of its class have none; other columns are ignored.
    """
    prints = materialise(fingerprints(recordings), "audio-prints")
    heard = prints.where(F.size("print") > 0)
    reps = materialise(heard.groupBy(F.col("print").alias("p")).agg(F.min("rec_id").alias("rep"), F.max(F.coalesce(asked, F.lit(False))).alias("asked")), "audio-reps")
    member = F.lit("member").alias("kind"), F.lit(0).alias("offset"), F.lit(0).cast("long").alias("votes"), F.size("print").cast("long").alias("overlap"), F.lit(0.0).alias("ber")
    members = heard.join(reps.select("p", "rep"), F.col("print") == F.col("p")).select(F.col("rep").alias("query_id"), "rec_id", *member)
    silent = prints.where(F.size("print") == 0).select(F.col("rec_id").alias("query_id"), "rec_id", *member)
    own = reps.select(F.col("rep").alias("rec_id"), F.col("p").alias("print"), "asked")
    matches = align(own.where("asked").drop("asked"), own.drop("asked"), **limits)
    matches = matches.select("query_id", "rec_id", F.lit("match").alias("kind"), "offset", "votes", "overlap", "ber")
    return members.unionByName(silent).unionByName(matches)


def melody(values: list[float] | None) -> bytes:
    """A recording of a vector: one note a value.  Null and non-finite values are rests."""
    notes = np.array([v if v is not None and math.isfinite(v) else np.nan for v in values or ()], float)
    rest = np.isnan(notes)
    hz = 440 * 2 ** ((MIDDLE - 69 + np.rint(np.clip(np.where(rest, 0, notes) / QUANTUM, -18, 18))) / 12)
    phase = np.cumsum(np.repeat(2 * np.pi * hz / RATE, HOP))
    pcm = (np.sin(phase) * np.repeat(np.where(rest, 0.0, 20000.0), HOP)).astype("<i2")
    with io.BytesIO() as f:
        with wave.open(f, "wb") as w:
            w.setparams((1, 2, RATE, 0, "NONE", ""))
            w.writeframes(pcm.tobytes())
        return f.getvalue()


def excerpt(wav: bytes, seed: int) -> bytes:
    """EXCERPT_NOTES notes of a recording from the (8 + seed mod 16)-th on, softer and with noise that the seed fixes."""
    samples, rate = decode_wav(wav)
    start = HOP * (8 + seed % 16)
    cut = samples[start : start + HOP * EXCERPT_NOTES] * GAIN
    cut = cut + np.random.default_rng(seed).normal(0, NOISE, len(cut))
    with io.BytesIO() as f:
        with wave.open(f, "wb") as w:
            w.setparams((1, 2, rate, 0, "NONE", ""))
            w.writeframes((np.clip(cut, -1, 1) * 32767).astype("<i2").tobytes())
        return f.getvalue()


def recordings_of(embeddings: DataFrame, excerpts: bool = False) -> DataFrame:
    """A media column derived from the rows' vectors: rec_id and audio, the melody of each row under its vec_id.

    With ``excerpts``, as the query has it, the melody of row v is recording 2 v, and where EXCERPT_EVERY divides v, an
    excerpt of it is recording 2 v + 1.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 64):
                batch = whole.slice(at, 64)
                ids, audio = [], []
                for v, x in zip(batch.column("vec_id").to_pylist(), batch.column("embedding"), strict=True):
                    ids.append(2 * v if excerpts and v is not None else v)
                    audio.append(melody(x.as_py()))
                    if excerpts and v is not None and v % EXCERPT_EVERY == 0 and decode_wav(audio[-1])[1]:
                        ids.append(2 * v + 1)
                        audio.append(excerpt(audio[-1], v))
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(audio, pa.binary())], ["rec_id", "audio"])

    return embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").mapInArrow(run, "rec_id long, audio binary")


def op8_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All recordings with an id that 20 divides are queries, against all recordings."""
    return search(recordings_of(read_table(spark, sf_dir, "embeddings"), excerpts=True), F.col("rec_id") % 20 == 0)
