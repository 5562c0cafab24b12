"""Removal of repeated byte strings by a depth-limited radix sort of suffixes.

Suffixes are ordered by their first `length` bytes only, in passes that read the most significant digit first, and a group of equal suffixes
at full depth is exactly a set of repeated windows. Digits are strings of bytes, told apart by names (prefix doubling); what decides about bytes is told
apart by two independent names, 96 bits in all. A suffix leaves the sort as soon as its group has one member:

1. Digit one names `core` bytes at sampled suffixes. The sample is chosen by content: of the positions in a window of `length` bytes, those
   whose digit is least. Equal windows therefore hold equal samples at equal places, and a window whose samples are all alone in their groups
   is unique. Most of the corpus leaves here.
2. Digit two names the sampled suffix's whole neighbourhood, which spans every window around the sample. All but the first member of a group
   are repeats in all these windows.
3. What is left (one suffix for each distinct neighbourhood of a shared core) goes to full depth: each window of `length` bytes is
   named, and all but the first of a group are repeats.

Map tasks sort their own suffixes first and send one member of each group, so a passage that a third of the documents share reaches a bucket once for each
task. A core with more than `HOT` neighbourhoods in one task is known to be shared: the task sends a mark for it, and its suffixes go to pass 3.

A document never matches beyond its ends. Null texts are empty; a text shorter than `length` keeps everything. Documents are ordered by doc_id;
where ids repeat or are null, by (doc_id with nulls last, text), each row a document of its own, so that the second of two equal rows is
removed whole. An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, Scratch, buckets, keyed, mix, release, seeds, slices, text_bytes, trim

LENGTH = 100
CORE = 48
HOT = 16
PIECE = 1 << 17  # bytes of a text that are worked on at once
FLUSH = 300_000  # suffixes that a task gathers before it sends them
BYTES = seeds(256, 2)
STEP = seeds(16, 3)
BYTES2 = (seeds(256, 4) >> U64(32)).astype(np.uint32)
STEP2 = (seeds(16, 5) >> U64(31)).astype(np.uint32) | np.uint32(1)

RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
_FIELDS = {"a": np.uint32, "b": np.uint64, "c": np.uint32, "key": np.int64, "at": np.int32}  # packed columns
_PACKED = "bucket int, mark boolean, " + ", ".join(f"{c} binary" for c in _FIELDS)
_PACKED_ARROW = pa.schema([("bucket", pa.int32()), ("mark", pa.bool_()), *((c, pa.binary()) for c in _FIELDS)])
_MARKS = "key long, kind int, start int, stop int"
_MARKS_ARROW = pa.schema([("key", pa.int64()), ("kind", pa.int32()), ("start", pa.int32()), ("stop", pa.int32())])
COVERED, SAMPLE_COVERED, CONTESTED = 0, 1, 2


def _slide(a: np.ndarray, n: int, f) -> np.ndarray:
    """f over n neighbours, by doubling; the result is n - 1 shorter."""
    m = 1
    while 2 * m <= n:
        a = f(a[:-m], a[m:])
        m *= 2
    r = n - m
    return f(a[: len(a) - r], a[r:]) if r else a


class Names:
    """Names of byte strings in some pieces of documents laid end to end.

    pieces: (key, text, lo, hi): positions lo to hi of the text are this piece's own; a margin on both sides gives the context.
    """

    def __init__(self, pieces: list[tuple[int, bytes, int, int]], length: int, core: int) -> None:
        self.length, self.core = length, core
        margin = 3 * length
        parts, keys, offs, sizes, los, his, ends = [], [], [], [], [], [], []
        for key, text, lo, hi in pieces:
            a, z = max(0, lo - margin), min(len(text), hi + margin)
            parts.append(text[a:z])
            for to, v in ((keys, key), (offs, a), (sizes, z - a), (los, lo), (his, hi), (ends, len(text))):
                to.append(v)
        sizes = np.array(sizes, dtype=np.int64)
        self.keys = np.array(keys, dtype=np.int64)
        self.shift = np.array(offs, dtype=np.int64) - (np.cumsum(sizes) - sizes)  # document position = place + shift
        self.piece = np.repeat(np.arange(len(pieces)), sizes)
        x = np.frombuffer(b"".join(parts), dtype=np.uint8)
        self.n = n = len(x)
        x = np.concatenate([x, np.zeros(2 * max(length, 128), dtype=np.uint8)])
        self.names, self.second = self._doubled(BYTES[x], STEP), self._doubled(BYTES2[x], STEP2)
        self.at = np.arange(n) + self.shift[self.piece]
        self.end = np.array(ends, dtype=np.int64)[self.piece]
        self.own = (self.at >= np.array(los, dtype=np.int64)[self.piece]) & (self.at < np.array(his, dtype=np.int64)[self.piece])
        tail = np.cumsum(sizes)[self.piece] - np.arange(n)  # bytes of the piece from here on
        self.whole = (self.at + length <= self.end) & (tail >= length)

    def _doubled(self, h: np.ndarray, step: np.ndarray) -> dict[int, np.ndarray]:
        """Names of the strings of 2^k bytes from each place, for those sizes that are needed."""
        out, m, level = {}, 1, 0
        while 2 * m <= 2 * self.length:
            h = h[:-m] * step[level] + h[m:]
            m, level = 2 * m, level + 1
            if 2 * m > self.core:
                out[m] = h
        return out

    def name(self, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Both names of strings of various sizes: two overlapping powers of two and the size."""
        out, out2 = np.zeros(len(start), dtype=np.uint64), np.zeros(len(start), dtype=np.uint32)
        powers = sorted(self.names)
        for p, q in zip(powers, [*powers[1:], 1 << 62]):
            s = np.flatnonzero((size >= p) & (size < q))
            begin, end = start[s], start[s] + size[s] - p
            out[s] = mix(self.names[p][begin] * STEP[14] + self.names[p][end] + size[s].astype(np.uint64) * STEP[15])
            out2[s] = self.second[p][begin] * STEP2[14] + self.second[p][end]
        return out, out2

    def fixed(self, size: int) -> np.ndarray:
        p = max(x for x in self.names if x <= size)
        h = self.names[p]
        return mix(h[: self.n] * STEP[14] + h[size - p : self.n + size - p])

    def samples(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Places of sampled suffixes, their digit one, and how far windows around them reach to the left and right."""
        w = self.length - self.core + 1
        digit = self.fixed(self.core)
        least = _slide(np.concatenate([digit, np.full(w - 1, 2**64 - 1, dtype=np.uint64)]), w, np.minimum)
        least[~self.whole] = 0
        most = _slide(np.concatenate([np.zeros(w - 1, dtype=np.uint64), least]), w, np.maximum)
        place = np.flatnonzero((digit == most) & self.own & (self.end - self.at >= self.core))
        left = np.minimum(w - 1, self.at[place])
        right = np.minimum(self.length, self.end[place] - self.at[place])
        ok = left + right >= self.length
        return place[ok], digit[place[ok]], left[ok], right[ok]


def _pieces(batches: Iterator[pa.RecordBatch], prepared=None) -> Iterator[list]:
    """Lists of (key, bytes, lo, hi[, what `prepared` makes of the row's marks, once for all its pieces]) that hold about PIECE bytes."""
    out, n = [], 0
    for b in slices(batches, most=2 * PIECE):
        marks = _mark_arrays(b.column(2)) if prepared else [()] * b.num_rows
        for i, (key, text) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist())):
            raw = (text or "").encode("utf-8", "surrogatepass")
            more = (prepared(len(raw), marks[i]),) if prepared else ()
            for lo in range(0, max(1, len(raw)), PIECE):
                hi = min(lo + PIECE, len(raw))
                out.append((key, raw, lo, hi, *more))
                n += hi - lo
                if n >= PIECE:
                    yield out
                    out, n = [], 0
    if out:
        yield out


def _mark_arrays(col: pa.ListArray) -> list[np.ndarray]:
    """(kind, start, stop) rows of each list, without Python objects for single marks."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    values = np.stack([np.asarray(col.values.field(c)).astype(np.int64) for c in ("kind", "start", "stop")], axis=1) if len(col.values) else np.zeros((0, 3), dtype=np.int64)
    edge = np.asarray(col.offsets)
    return [values[a:z] for a, z in zip(edge, edge[1:])]


def _new(*arrays: np.ndarray) -> np.ndarray:
    out = np.ones(len(arrays[0]), dtype=bool)
    if len(out):
        out[1:] = np.logical_or.reduce([a[1:] != a[:-1] for a in arrays])
    return out


def _later(first: np.ndarray, key: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Of sorted rows in groups: those that come after their group's first row (not the same place once more)."""
    lead = np.maximum.accumulate(np.where(first, np.arange(len(first)), 0))
    return (key != key[lead]) | (at != at[lead])


def _deal(n_buckets: int, by: np.ndarray, mark: np.ndarray, *columns: np.ndarray) -> pa.RecordBatch:
    """Rows of packed columns, one for each bucket and kind."""
    bucket = ((by >> U64(32)) * U64(n_buckets) >> U64(32)).astype(np.int64) * 2 + mark
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    cuts = np.flatnonzero(_new(bucket)) if len(bucket) else np.zeros(0, dtype=np.int64)
    stops = np.concatenate([cuts[1:], [len(bucket)]]).astype(np.int64) if len(cuts) else cuts
    packed = [c[order].astype(t) for c, t in zip(columns, _FIELDS.values())]
    blobs = [pa.array([c[s:e].view(np.uint8).reshape(-1, c.itemsize).T.tobytes() for s, e in zip(cuts, stops)], pa.binary()) for c in packed]  # first bytes first: the shuffle's compression finds runs of equal ones
    return pa.RecordBatch.from_arrays([pa.array((bucket[cuts] // 2).astype(np.int32)), pa.array(bucket[cuts] % 2 == 1), *blobs], schema=_PACKED_ARROW)


def _unpack(t: pa.Table) -> tuple[np.ndarray, ...]:
    def column(name: str, kind: type) -> np.ndarray:
        parts = [np.frombuffer(x.as_py(), dtype=np.uint8).reshape(np.dtype(kind).itemsize, -1).T.copy().view(kind).ravel() for x in t.column(name)]
        return np.concatenate(parts) if parts else np.zeros(0, dtype=kind)

    return tuple(column(c, d) for c, d in _FIELDS.items())


def _intervals(key: np.ndarray, start: np.ndarray, stop: np.ndarray, overlap: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Intervals of the same key that overlap by at least `overlap`, joined; at 0 those that touch, too."""
    if not len(key):
        return key, start, stop
    order = np.lexsort((start, key))
    key, start, stop = key[order], start[order].astype(np.int64), stop[order].astype(np.int64)
    rank = np.cumsum(_new(key)) - 1
    base = rank * (1 << 33)
    reach = np.maximum.accumulate(stop + base)
    first = np.ones(len(key), dtype=bool)
    first[1:] = start[1:] + base[1:] > reach[:-1] - overlap
    lead = np.flatnonzero(first)
    last = np.concatenate([lead[1:] - 1, [len(key) - 1]])
    return key[lead], start[lead], reach[last] - base[last]


def _marks(*rows: tuple) -> pa.Table:
    """rows: (kind, key, start, stop) arrays."""
    cols = [np.concatenate([np.broadcast_to(r[i], len(r[1])) for r in rows]) if rows else np.zeros(0) for i in (1, 0, 2, 3)]
    return pa.table([pa.array(c.astype(t)) for c, t in zip(cols, (np.int64, np.int32, np.int32, np.int32))], schema=_MARKS_ARROW)


def _first_pass(n_buckets: int, length: int, core: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def flush() -> Iterator[pa.RecordBatch]:
            if not held:
                return
            digit, name, second, key, at, left, right = (np.concatenate(x) for x in zip(*held))
            held.clear()
            order = np.lexsort((at, key, second, name, digit))
            digit, name, second, key, at, left, right = (x[order] for x in (digit, name, second, key, at, left, right))
            first = _new(digit, name, second)
            # repeats within the task: whole neighbourhoods, told as intervals in the columns key, a (start) and at (stop). Pass 3 leaves out every window
            # inside one, so they are joined only where each window of the union lies in one of them
            late = ~first & _later(first, key, at)
            k, s, e = _intervals(key[late], at[late] - left[late], at[late] + right[late], length - 1)
            digit, name, second, key, at = (x[first] for x in (digit, name, second, key, at))
            group = np.cumsum(_new(digit)) - 1
            hot = np.bincount(group, minlength=1)[group] > HOT if len(group) else np.zeros(0, dtype=bool)
            lead = np.flatnonzero(hot & _new(digit)) if len(group) else np.zeros(0, dtype=np.int64)
            # columns of the rows that are dealt: digits one and two; a hot core's mark is a neighbourhood of its own
            rng = mix(key[lead].astype(np.uint64) * STEP[0] + at[lead].astype(np.uint64) * STEP[1])
            cold = ~hot
            d = np.concatenate([digit[cold], digit[lead]])
            none = np.full(len(lead), -1)
            # sampled digits are the least of their windows, so they are mixed before they name a bucket: small ones would all meet in the first buckets
            yield _deal(n_buckets, mix(d), np.zeros(len(d), dtype=np.int64), d, np.concatenate([name[cold], rng]), *(np.concatenate([x[cold], none.astype(x.dtype)]) for x in (second, key, at)))
            kinds = np.concatenate([np.full(len(k), COVERED), np.full(int(hot.sum()), CONTESTED)]).astype(np.uint64)
            k, s, e = np.concatenate([k, key[hot]]), np.concatenate([s, at[hot]]), np.concatenate([e, at[hot]])
            yield _deal(n_buckets, mix(k.astype(np.uint64)), np.ones(len(k), dtype=np.int64), s, kinds, np.zeros(len(k)), k, e)

        for pieces in _pieces(batches):
            names = Names(pieces, length, core)
            place, digit, left, right = names.samples()
            name, second = names.name(place - left, left + right)
            held.append((digit, name + left.astype(np.uint64) * STEP[13], second, names.keys[names.piece[place]], names.at[place], left, right))
            del names, place, digit, left, right, name, second
            if sum(len(x[0]) for x in held) >= FLUSH:
                yield from flush()
                trim()
        yield from flush()
        trim()

    return run


def _by_bucket(settle):
    """Runs `settle` on each bucket of a partition; a partition holds a few buckets of bounded size, and needs no sort by Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[pa.RecordBatch]] = {}
        for b in batches:
            bucket = np.asarray(b.column(0))
            for k in np.unique(bucket).tolist():
                held.setdefault(k, []).append(b.filter(pa.array(bucket == k)))
        while held:
            yield from settle(pa.Table.from_batches(held.popitem()[1])).to_batches(max_chunksize=50_000)
            trim()

    return run


def _first_groups(t: pa.Table) -> pa.Table:
    told = t.filter(t.column("mark"))
    start, kinds, _, key, stop = _unpack(told)
    out = [(kinds.astype(np.int32), key, start.astype(np.int64), stop)]
    digit, name, second, key, at = _unpack(t.filter(pc.invert(t.column("mark"))))
    order = np.lexsort((at, key, second, name, digit))
    digit, name, second, key, at = (x[order] for x in (digit, name, second, key, at))
    first = _new(digit, name, second)
    late = _later(first, key, at)
    out.append((SAMPLE_COVERED, key[late], at[late], at[late]))
    group = np.cumsum(_new(digit)) - 1
    shared = first & (np.bincount(group, weights=first, minlength=1)[group] >= 2) & (at >= 0) if len(group) else first
    out.append((CONTESTED, key[shared], at[shared], at[shared]))
    return _marks(*out)


def _cover(n: int, m: np.ndarray, length: int, core: int) -> tuple[np.ndarray, np.ndarray]:
    """Covered spans of a text of n bytes and its contested samples, from its marks (kind, start, stop)."""
    start, stop = m[:, 1].copy(), m[:, 2].copy()
    s = m[:, 0] == SAMPLE_COVERED
    start[s] = np.maximum(0, m[s, 1] - (length - core))
    stop[s] = np.minimum(n, m[s, 1] + length)
    c = m[:, 0] != CONTESTED
    return np.stack([start[c], stop[c]], axis=1), m[~c, 1]


def _contest(length: int, core: int):
    """(size of a text, its marks) -> (first, last + 1) of the window starts around contested samples, and of those inside covered spans; both sorted."""

    def run(n: int, m: np.ndarray) -> tuple[np.ndarray, ...]:
        spans, contested = _cover(n, m, length, core)
        zero = lambda a: np.zeros(len(a), dtype=np.int64)
        _, near, near_end = _intervals(zero(contested), np.maximum(0, contested - (length - core)), np.minimum(n, contested + 1))
        _, known, known_end = _intervals(zero(spans), spans[:, 0], spans[:, 1], length - 1)
        return near, near_end, known, np.maximum(known_end - (length - 1), known)

    return run


def _filled(lo: int, hi: int, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Which of lo..hi lie inside intervals whose ends both ascend."""
    s, e = np.searchsorted(last, lo, side="right"), np.searchsorted(first, hi)
    d = np.zeros(hi - lo + 1, dtype=np.int32)
    np.add.at(d, np.maximum(first[s:e], lo) - lo, 1)
    np.add.at(d, np.minimum(last[s:e], hi) - lo, -1)
    return np.cumsum(d[:-1]) > 0


def _last_pass(n_buckets: int, length: int, core: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def flush() -> Iterator[pa.RecordBatch]:
            if not held:
                return
            name, second, key, at = (np.concatenate(x) for x in zip(*held))
            held.clear()
            order = np.lexsort((at, key, second, name))
            name, second, key, at = (x[order] for x in (name, second, key, at))
            first = _new(name, second)
            late = ~first & _later(first, key, at)
            k, s, e = _intervals(key[late], at[late], at[late] + length)
            name, second, key, at = (x[first] for x in (name, second, key, at))
            yield _deal(n_buckets, name, np.zeros(len(name), dtype=np.int64), np.zeros(len(name)), name, second, key, at)
            none = np.zeros(len(k), dtype=np.uint64)
            yield _deal(n_buckets, mix(k.astype(np.uint64)), np.ones(len(k), dtype=np.int64), s, none, none, k, e)

        for pieces in _pieces(batches, _contest(length, core)):
            names = Names([p[:4] for p in pieces], length, core)
            want = np.zeros(names.n, dtype=bool)
            for i, (_, _, lo, hi, (near, near_end, known, known_end)) in enumerate(pieces):
                wanted = _filled(lo, hi, near, near_end) & ~_filled(lo, hi, known, known_end)
                want[np.flatnonzero(wanted) + (lo - names.shift[i])] = True
            place = np.flatnonzero(want & names.whole)
            held.append((*names.name(place, np.full(len(place), length)), names.keys[names.piece[place]], names.at[place]))
            del names, place, want
            if sum(len(x[0]) for x in held) >= FLUSH:
                yield from flush()
                trim()
        yield from flush()
        trim()

    return run


def _last_groups(length: int):
    def run(t: pa.Table) -> pa.Table:
        start, kinds, _, key, stop = _unpack(t.filter(t.column("mark")))
        out = [(kinds.astype(np.int32), key, start.astype(np.int64), stop)]
        _, name, second, key, at = _unpack(t.filter(pc.invert(t.column("mark"))))
        order = np.lexsort((at, key, second, name))
        name, second, key, at = (x[order] for x in (name, second, key, at))
        late = _later(_new(name, second), key, at)
        k, s, e = _intervals(key[late], at[late], at[late].astype(np.int64) + length)
        out.append((COVERED, k, s, e))
        return _marks(*out)

    return run


def repeats(docs: DataFrame, length: int = LENGTH, core: int | None = None, keep: tuple = ()) -> DataFrame:
    """key, doc_id, text and `marks` (kind, start, stop) of each document: the repeated byte intervals of the whole corpus."""
    spark, core = docs.sparkSession, core or max(8, length * CORE // LENGTH)
    scratch = Scratch(spark)
    source = keyed(docs, *keep)
    n = buckets(spark, text_bytes(docs), 12_000_000)
    gather = lambda m: m.groupBy("key").agg(F.collect_list(F.struct("kind", "start", "stop")).alias("marks"))
    one = scratch.keep(source.select("key", "text").mapInArrow(_first_pass(n, length, core), _PACKED).repartition(n, "bucket").mapInArrow(_by_bucket(_first_groups), _MARKS), "first")
    release(spark)
    contested = one.where(F.col("kind") == CONTESTED).select("key").distinct()
    left = source.select("key", "text").join(gather(one.join(contested, "key", "left_semi")), "key").select("key", "text", "marks")
    two = scratch.keep(left.mapInArrow(_last_pass(n, length, core), _PACKED).repartition(n, "bucket").mapInArrow(_by_bucket(_last_groups(length)), _MARKS), "last")
    release(spark)
    return source.join(gather(one.where(F.col("kind") != CONTESTED).unionByName(two)), "key", "left")


def _kept(raw: bytes, marks: np.ndarray, length: int, core: int) -> tuple[bytes, int, int]:
    """What is left of a text, the number of removed bytes and of maximal removed runs."""
    spans, _ = _cover(len(raw), marks, length, core)
    if not len(spans):
        return raw, 0, 0
    _, start, stop = _intervals(np.zeros(len(spans), dtype=np.int64), spans[:, 0], spans[:, 1])
    parts, at = [], 0
    for s, e in zip(start.tolist(), stop.tolist()):
        parts.append(raw[at:s])
        at = e
    parts.append(raw[at:])
    return b"".join(parts), int((stop - start).sum()), len(start)


def digest(docs: DataFrame, length: int = LENGTH, core: int | None = None) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for each row of `docs`."""
    core = core or max(8, length * CORE // LENGTH)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, most=4_000_000):
            rows = []
            for doc, text, marks in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), _mark_arrays(b.column(2))):
                raw = (text or "").encode("utf-8", "surrogatepass")
                kept, removed, spans = _kept(raw, marks, length, core)
                rows.append((doc, len(raw), removed, spans, hashlib.sha256(kept).hexdigest()))
            cols = list(zip(*rows))
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols[:4]), pa.array(cols[4], pa.string())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return repeats(docs, length, core).select("doc_id", "text", "marks").mapInArrow(run, RESULT)


def strip(docs: DataFrame, length: int = LENGTH, core: int | None = None) -> DataFrame:
    """`docs` with `text` less its repeated strings; characters that a cut leaves incomplete go with it. Rows keep their number, null texts stay null."""
    core = core or max(8, length * CORE // LENGTH)
    others = tuple(c for c in docs.columns if c not in ("doc_id", "text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, most=4_000_000):
            texts = [None if t is None else _kept(t.encode("utf-8", "surrogatepass"), m, length, core)[0].decode("utf-8", "ignore") for t, m in zip(b.column("text").to_pylist(), _mark_arrays(b.column("marks")))]
            cols = {c: b.column(c) for c in b.schema.names if c != "marks"} | {"text": pa.array(texts, pa.string())}
            yield pa.RecordBatch.from_pydict(cols)

    names = {f"keep_{i}": c for i, c in enumerate(others)}
    found = repeats(docs, length, core, others).select("doc_id", "text", *names, "marks")
    return found.mapInArrow(run, found.drop("marks").schema).withColumnsRenamed(names).select(docs.columns)
