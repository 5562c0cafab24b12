"""Audio columns: chroma fingerprints and their alignment.

A recording (a binary column of 16-bit mono WAV) becomes frames of twelve pitch-class energies. An integral image over these frames gives the sum over any
rectangle in four look-ups, and sixteen rectangle filters, each quantised to two Gray-coded bits, are packed into one 32-bit integer a frame. Recordings are
aligned at the offset with the least share of differing bits, of all offsets at which half of the shorter one meets the other; that share says whether they match.

Every query is compared with every distinct fingerprint, so no match is missed: the differing bits at all offsets follow from one cross-correlation of
32 channels of signs. Queries go out in rounds of bounded size, and each round is one pass over the fingerprints.

Recordings with equal fingerprints are a class and are looked up once. A null, unreadable, silent or too short recording has an empty fingerprint and matches
nothing. Where ids repeat, each row counts; a null id is never a query. Ties go to the lower bit error, then the smaller id.
"""

from __future__ import annotations

import io
import wave
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch

RATE, FRAME, HOP = 4000, 1024, 256
LOWEST, HIGHEST = 55.0, 1760.0
SHORTEST = 2  # integers of a fingerprint that takes part
ROUND = 1 << 24  # bytes of query fingerprints that tasks hold at once
TARGETS = 1024  # fingerprints that a task compares with them at once
CELLS = 1 << 19  # values of a block of spectra
MOST_ERROR = 0.2
QUERY_STRIDE = 50


def _filters() -> list[tuple[int, int, int, int]]:
    """(shape, first pitch class, height, frames) of sixteen filters, by rule: four shapes at four scales."""
    return [(shape, (5 * scale + 3 * shape) % (12 - h + 1), h, w) for scale, (h, w) in enumerate(((12, 4), (6, 8), (4, 6), (3, 16))) for shape in range(4)]


FILTERS = _filters()
WIDEST = max(f[3] for f in FILTERS)
GRAY = np.array([0, 1, 3, 2], dtype=np.uint32)


def to_wav(samples: np.ndarray, rate: int = RATE) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes((np.clip(samples, -1, 1) * 32767).astype("<i2").tobytes())
    return out.getvalue()


def from_wav(data: bytes | None) -> tuple[np.ndarray, int]:
    """Samples and rate; no samples where the bytes are no 16-bit WAV."""
    if not data:
        return np.zeros(0), RATE
    try:
        with wave.open(io.BytesIO(data)) as w:
            if w.getsampwidth() != 2:
                return np.zeros(0), RATE
            x = np.frombuffer(w.readframes(w.getnframes()), dtype="<i2").astype(float) / 32768
            return x.reshape(-1, w.getnchannels()).mean(axis=1) if w.getnchannels() > 1 else x, w.getframerate()
    except (wave.Error, EOFError, ValueError):
        return np.zeros(0), RATE


def melody(values: np.ndarray, note: int = HOP, rate: int = RATE) -> np.ndarray:
    """A recording of a vector: each component is a note of the chromatic scale, its place within the vector's spread the pitch."""
    spread = values.std() or 1.0
    pitch = np.clip(np.round((values - values.mean()) / spread * 5), -14, 14)
    phase = np.cumsum(np.repeat(2 * np.pi * 220 * 2.0 ** (pitch / 12) / rate, note))
    return 0.8 * np.sin(phase)


def chroma(x: np.ndarray, rate: int) -> np.ndarray:
    """Normalised pitch-class energies [frame, 12]."""
    size, hop = int(FRAME * rate / RATE), int(HOP * rate / RATE)
    if len(x) < size:
        return np.zeros((0, 12))
    frames = np.lib.stride_tricks.sliding_window_view(x, size)[::hop] * np.hanning(size)
    power = np.abs(np.fft.rfft(frames, axis=1)) ** 2
    f = np.fft.rfftfreq(size, 1 / rate)
    used = (f >= LOWEST) & (f <= HIGHEST)
    pitch = np.round(12 * np.log2(f[used] / 440)).astype(int) % 12
    out = power[:, used] @ np.eye(12)[pitch]
    return out / np.maximum(np.sqrt((out**2).sum(axis=1, keepdims=True)), 1e-9)


def fingerprint(data: bytes | None) -> np.ndarray:
    """One packed integer for each frame that all filters fit on."""
    x, rate = from_wav(data)
    c = chroma(x, rate)
    if len(c) < WIDEST or not c.any():
        return np.zeros(0, dtype=np.uint32)
    image = np.zeros((len(c) + 1, 13))
    image[1:, 1:] = c.cumsum(axis=0).cumsum(axis=1)
    n = len(c) - WIDEST + 1
    t = np.arange(n)
    area = lambda t0, t1, y0, y1: image[t + t1, y1] - image[t + t0, y1] - image[t + t1, y0] + image[t + t0, y0]
    out = np.zeros(n, dtype=np.uint32)
    for shape, y, h, w in FILTERS:
        whole = area(0, w, y, y + h)
        if shape == 0:  # early against late
            part = area(0, w // 2, y, y + h)
        elif shape == 1:  # low against high
            part = area(0, w, y, y + (h + 1) // 2)
        elif shape == 2:  # the middle in time against the ends
            part = area(w // 4, w // 4 + w // 2, y, y + h)
        else:  # one diagonal against the other
            part = area(0, w // 2, y, y + h // 2) + area(w // 2, w, y + h // 2, y + h)
        level = np.log((1 + part) / (1 + whole - part))
        out = (out << np.uint32(2)) | GRAY[np.searchsorted((-0.25, 0.0, 0.25), level)]
    return out


def fingerprints(recordings: DataFrame) -> DataFrame:
    """id, fingerprint (packed little-endian) for each row of `recordings` (id long, audio binary)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([fingerprint(x).astype("<u4").tobytes() for x in b.column(1).to_pylist()], pa.binary())], names=["id", "fingerprint"])

    return recordings.mapInArrow(run, "id long, fingerprint binary")


def bit_error(a: np.ndarray, b: np.ndarray, offset: int) -> float:
    """Share of differing bits where a[i + offset] meets b[i]; 1 where fewer than half of the shorter one meets."""
    lo, hi = max(0, -offset), min(len(b), len(a) - offset)
    if hi - lo < max(1, min(len(a), len(b)) // 2):
        return 1.0
    return float(np.bitwise_count(a[lo + offset : hi + offset] ^ b[lo:hi]).mean() / 32)


def _spectra(prints: list[np.ndarray], n: int) -> np.ndarray:
    """[frequency, fingerprint, bit]: spectra of the bits as signs, padded to n."""
    x = np.zeros((len(prints), 32, n), dtype=np.float32 if n <= 4096 else np.float64)
    for row, p in zip(x, prints):
        row[:, : len(p)] = (((p[None, :] >> np.arange(32, dtype=np.uint32)[:, None]) & np.uint32(1)).astype(np.int8) * 2 - 1)
    return np.fft.rfft(x, axis=2).transpose(2, 0, 1)


def _by_size(prints: list[np.ndarray]) -> dict[int, list[int]]:
    out: dict[int, list[int]] = {}
    for i, p in enumerate(prints):
        out.setdefault(1 << max(1, (len(p) - 1).bit_length()), []).append(i)
    return out


def best_matches(a: list[np.ndarray], b: list[np.ndarray], most_error: float = MOST_ERROR) -> Iterator[tuple[int, int, int, float]]:
    """(i, j, offset, error) of all pairs of a and b whose least bit error is within `most_error`; ties go to the shorter offset, then the smaller."""
    for size_a, all_a in _by_size(a).items():
        for size_b, all_b in _by_size(b).items():
            n = 2 * max(size_a, size_b)  # at least the sum of any two lengths
            offsets = np.array(sorted(range(1 - size_b, size_a), key=lambda o: (abs(o), o)))
            width = max(1, min(int(np.sqrt(CELLS // n)), 256))
            for s in range(0, len(all_a), width):
                rows = all_a[s : s + width]
                fa = _spectra([a[i] for i in rows], n)
                for t in range(0, len(all_b), width):
                    cols = all_b[t : t + width]
                    agree = np.fft.irfft(fa @ _spectra([b[j] for j in cols], n).conj().transpose(0, 2, 1), n, axis=0)  # equal less differing bits [offset, row, column]
                    la, lb = (np.array([len(x[i]) for i in at]) for x, at in ((a, rows), (b, cols)))
                    lengths = (la[:1, None], lb[None, :1]) if len(set(la)) == len(set(lb)) == 1 else (la[:, None], lb[None, :])
                    o = np.arange(n)
                    o = np.where(o < size_a, o, o - n)[:, None, None]
                    meet = np.minimum(lengths[1], lengths[0] - o) - np.maximum(0, -o)
                    least = np.where(meet >= np.maximum(1, np.minimum(*lengths) // 2), (1 - 2 * most_error) * 32 * meet - 0.5, np.inf).astype(agree.dtype)
                    for i, j in np.argwhere((agree >= least).any(axis=0)).tolist():
                        meet = np.minimum(lb[j], la[i] - offsets) - np.maximum(0, -offsets)
                        ok = meet >= max(1, min(la[i], lb[j]) // 2)
                        error = (32 * meet[ok] - np.rint(agree[offsets[ok], i, j]).astype(np.int64)) // 2 / (32 * meet[ok])
                        k = int(np.argmin(error))
                        if error[k] <= most_error:
                            yield rows[i], cols[j], int(offsets[ok][k]), float(error[k])


def _matches(queries: Broadcast, most_error: float):
    """(key, fingerprint) -> pairs of a query and another fingerprint that match."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = lambda f: np.frombuffer(f, dtype="<u4")
        qk, qf = [k for k, _ in queries.value], [numbers(f) for _, f in queries.value]

        def compare(keys: list[int], prints: list[np.ndarray]) -> pa.RecordBatch:
            rows = [(qk[i], keys[j], o, e) for i, j, o, e in best_matches(qf, prints, most_error) if qk[i] != keys[j]]
            return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.float64()))], names=["a", "b", "offset", "error"])

        keys: list[int] = []
        prints: list[np.ndarray] = []
        for batch in batches:
            keys += batch.column(0).to_pylist()
            prints += [numbers(f) for f in batch.column(1).to_pylist()]
            if len(keys) >= TARGETS:
                yield compare(keys, prints)
                keys, prints = [], []
        if keys:
            yield compare(keys, prints)

    return run


def align(prints: DataFrame, stride: int = QUERY_STRIDE, most_error: float = MOST_ERROR) -> DataFrame:
    """For each row of `prints` (id, fingerprint) whose id is divisible by `stride`: id, n_frames, n_matches (other recordings whose bit error is within `most_error`
    at the best offset), best_id, best_offset, best_error."""
    scratch = Scratch(prints.sparkSession)
    prints = scratch.keep(prints, "fingerprints")
    spark = prints.sparkSession
    query = F.col("id").isNotNull() & (F.col("id") % stride == 0)
    grouped = prints.where(F.length("fingerprint") >= 4 * SHORTEST).groupBy("fingerprint").agg(F.min("id").alias("class"), F.count(F.lit(1)).alias("weight"), F.max(query).alias("asked"))
    classes = scratch.keep(grouped.withColumn("key", F.monotonically_increasing_id()), "classes")
    rounds = -(-(classes.where("asked").agg(F.sum(F.length("fingerprint"))).first()[0] or 0) // ROUND)
    matched = spark.createDataFrame([], "a long, b long, offset long, error double")
    for r in range(rounds):
        asked = classes.where("asked").where(F.pmod(F.xxhash64("key"), F.lit(rounds)) == r).select("key", "fingerprint").collect()
        held = spark.sparkContext.broadcast([(x.key, bytes(x.fingerprint)) for x in asked])  # about ROUND bytes
        matched = matched.unionByName(scratch.keep(classes.select("key", "fingerprint").mapInArrow(_matches(held, most_error), "a long, b long, offset long, error double"), "matched"))
        held.unpersist()
    best = F.min(F.struct("error", F.col("class").isNull().alias("nameless"), F.col("class").alias("b"), "offset")).alias("best")
    found = matched.join(classes.select(F.col("key").alias("b"), "class", "weight"), "b").groupBy("a").agg(F.sum("weight").alias("others"), best)
    asked = prints.where(query).join(classes.select("fingerprint", "key", "class", "weight"), "fingerprint", "left").join(found.withColumnRenamed("a", "key"), "key", "left")
    own = F.coalesce(F.col("weight") - 1, F.lit(0))
    twin = (own > 0) & (F.col("id") != F.col("class"))  # the class's least id, unless that is the query itself
    return asked.select(
        "id", (F.length("fingerprint") / 4).cast("long").alias("n_frames"), (own + F.coalesce("others", F.lit(0))).alias("n_matches"),
        F.when(twin, F.col("class")).otherwise(F.col("best.b")).alias("best_id"),
        F.when(twin, F.lit(0)).otherwise(F.col("best.offset")).cast("long").alias("best_offset"),
        F.when(twin, F.lit(0.0)).otherwise(F.col("best.error")).alias("best_error"),
    )


def recordings_of(vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding) as a media column: id, audio (a WAV of the vector's melody); null or unusable vectors have no audio."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for v in b.column(1).to_pylist():
                x = np.array([np.nan if c is None else c for c in v or [np.nan]], dtype=float)
                out.append(to_wav(melody(x)) if np.isfinite(x).all() else None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], names=["id", "audio"])

    return vectors.select(F.col("vec_id").cast("long"), "embedding").mapInArrow(run, "id long, audio binary")
