"""Toxicity by class-conditional Kneser-Ney letter models.

Two models, one per label, give each letter of a word its probability after the word's last letters. The highest order counts its
class's text alone, with absolute discounting; what the discount frees is spread by lower orders whose continuation counts are shared by
both classes, so a rare expression that one class has never shown falls back on what both know. The n-grams of all labelled rows of the
first part of the training fold are counted, whatever their number and length. A text's evidence is the difference of the
log-likelihoods, normalised by its length: over the whole text, and over the words that stand out. A logistic curve fitted on a
second part of the training fold turns the evidence into a score.

A null or empty text, or one without a letter, has no evidence and gets the score of none. Without labelled rows of both classes every
score is 0. Repeated rows and ties are answered alike; other columns are ignored. A null doc_id keeps its row and is not held out.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, Scratch, code_points, fold, fold_of, mix, seeds, slices, trim_driver

SAMPLE_ROWS = 1500  # labelled rows of each class for the curve; the models count every row
HELD_GRAMS = 1_000_000  # n-grams that a task adds up before it sends them
ORDER = 6  # letters of an n-gram
DISCOUNT = 0.75
STANDS_OUT = 2.5  # a word's evidence in nats from which it counts as an expression
THRESHOLD = 0.7
PRIOR = 0.25  # the curve's weight of the toxic class: rejecting an ordinary text costs more
CONSTANTS = seeds(ORDER + 1, 8)

RESULT = "doc_id long, held_out boolean, score double, predicted int"
_COUNTS = "hi long, lo long, ordinary long, toxic long"
_EVIDENCE = "toxic int, h long, doc_id long, evidence array<double>"


def letters() -> np.ndarray:
    """Lower-case letter of each code point; 0 where it is none."""
    out = np.zeros(0x110000, dtype=np.uint32)
    for i in range(0x110000):
        c = chr(i)
        if c.isalpha():
            out[i] = ord(c.lower()[0])
    return out


class Grams:
    """n-gram keys of all letters of some texts, a word's end counted as one more letter."""

    def __init__(self, lut: np.ndarray, texts: list[str]) -> None:
        points, self.starts = code_points(texts)
        x = lut[points]
        before = np.concatenate([[0], x[:-1]])
        self.at = np.flatnonzero((x != 0) | (before != 0))
        first = (x != 0) & (before == 0)
        begin = np.maximum.accumulate(np.where(first, np.arange(len(x)), 0))
        self.depth = (np.arange(len(x)) - begin)[self.at]  # letters of the word before this one
        self.word = np.cumsum(first)[self.at] - 1
        self.words = int(first.sum())
        self.word_at = np.flatnonzero(first)
        self.x = x.astype(np.uint64)

    def packed(self) -> tuple[np.ndarray, np.ndarray]:
        """The longest n-grams themselves: three letters of 21 bits in each of two integers, the last letter lowest."""
        out = [np.zeros(len(self.at), dtype=np.uint64) for _ in range(2)]
        for j in range(ORDER):
            back = self.x[np.maximum(self.at - j, 0)]
            back[self.depth < j] = 1  # before the word
            out[j // 3] |= back << U64(21 * (j % 3))
        return out[1].view(np.int64), out[0].view(np.int64)

    def order(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Keys of each letter with the k letters before it, and of these k alone."""
        h = self.x[self.at] * CONSTANTS[0] + U64(1)
        c = np.zeros(len(self.at), dtype=np.uint64)
        for j in range(1, k + 1):
            back = self.x[np.maximum(self.at - j, 0)]
            back[self.depth < j] = 1  # before the word
            c += back * CONSTANTS[j]
        return mix(h + c + U64(k)), mix(c + U64(k))


class Table:
    """Values by 64-bit keys, sorted, with a table of starts by the leading bits."""

    BITS = 18

    def __init__(self, keys: np.ndarray, values: np.ndarray) -> None:
        order = np.argsort(keys)
        self.keys, self.values = keys[order], values[order].astype(np.float32)
        lead = (self.keys >> U64(64 - self.BITS)).astype(np.int64)
        self.starts = np.searchsorted(lead, np.arange(2**self.BITS + 1)).astype(np.int32)
        self.most = int(np.diff(self.starts).max(initial=0))

    def get(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The value of each key and whether there is one; 0 where there is none."""
        value, found = np.zeros(len(keys), dtype=np.float32), np.zeros(len(keys), dtype=bool)
        if not len(self.keys):
            return value, found
        lead = (keys >> U64(64 - self.BITS)).astype(np.int64)
        at, end = self.starts[lead], self.starts[lead + 1]
        todo = np.flatnonzero(at < end)
        for _ in range(self.most):
            hit = self.keys[at[todo]] == keys[todo]
            found[todo[hit]] = True
            value[todo[hit]] = self.values[at[todo[hit]]]
            todo = todo[~hit]
            at[todo] += 1
            todo = todo[at[todo] < end[todo]]
            if not len(todo):
                break
        return value, found


class Counted:
    """Distinct longest n-grams and how often each class shows them."""

    def __init__(self, hi: np.ndarray, lo: np.ndarray, counts: np.ndarray) -> None:
        self.hi, self.lo, self.counts = hi, lo, counts  # counts [n-gram, class]

    @classmethod
    def of(cls, texts: list[str], toxic: np.ndarray, lut: np.ndarray) -> Counted:
        g = Grams(lut, texts)
        owner = np.searchsorted(g.starts, g.at, side="right") - 1
        counts = np.zeros((len(g.at), 2), dtype=np.int64)
        counts[np.arange(len(g.at)), np.asarray(toxic, dtype=np.int64)[owner]] = 1
        return cls.added([cls(*g.packed(), counts)])

    @classmethod
    def added(cls, parts: list[Counted]) -> Counted:
        hi, lo, counts = (np.concatenate([getattr(p, c) for p in parts]) for c in ("hi", "lo", "counts"))
        order = np.lexsort((lo, hi))
        hi, lo, counts = hi[order], lo[order], counts[order]
        new = np.ones(len(hi), dtype=bool)
        new[1:] = (hi[1:] != hi[:-1]) | (lo[1:] != lo[:-1])
        at = np.flatnonzero(new)
        return cls(hi[at], lo[at], np.add.reduceat(counts, at, axis=0) if len(at) else counts)

    def order(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """As Grams.order, of each n-gram once."""
        letter = lambda j: ((self.hi if j >= 3 else self.lo).view(np.uint64) >> U64(21 * (j % 3))) & U64((1 << 21) - 1)
        c = np.zeros(len(self.hi), dtype=np.uint64)
        for j in range(1, k + 1):
            c += letter(j) * CONSTANTS[j]
        return mix(letter(0) * CONSTANTS[0] + U64(1) + c + U64(k)), mix(c + U64(k))

    def batches(self) -> Iterator[pa.RecordBatch]:
        t = pa.table({"hi": self.hi, "lo": self.lo, "ordinary": self.counts[:, 0], "toxic": self.counts[:, 1]})
        yield from t.to_batches(max_chunksize=50_000)


class Model:
    """Log-ratio tables of the two class models, and the curve."""

    def __init__(self, ordinary: list[str], toxic: list[str]) -> None:
        self.learn(Counted.of(ordinary + toxic, np.repeat([0, 1], [len(ordinary), len(toxic)]), letters()))

    @classmethod
    def counted(cls, grams: Counted) -> Model:
        m = cls.__new__(cls)
        m.learn(grams)
        return m

    def learn(self, grams: Counted) -> None:
        self.lut = letters()
        self.curve = None
        both = grams.order
        # shared lower orders: continuation counts (different letters seen before), interpolated from the shortest up
        shared = None
        for k in range(ORDER - 1):
            at = np.unique(both(k + 1)[0], return_index=True)[1]  # each longer n-gram once
            low, ctx = (v[at] for v in both(k))
            u, first, inverse = np.unique(low, return_index=True, return_inverse=True)
            count = np.bincount(inverse)
            c, c_inverse = np.unique(ctx[first], return_inverse=True)
            total, kinds = np.bincount(c_inverse, weights=count), np.bincount(c_inverse)
            below = np.full(len(u), 1.0 / max(2, len(u))) if shared is None else shared.get(both(k - 1)[0][at][first])[0].astype(float)
            p = np.maximum(count - DISCOUNT, 0) / total[c_inverse] + DISCOUNT * kinds[c_inverse] / total[c_inverse] * below
            shared = Table(u, p)
        # the highest order by class, over the n-grams and contexts that either class has shown
        n = ORDER - 1
        keys, ctx = both(n)
        keys, at = np.unique(keys, return_index=True)
        ctx = ctx[at]
        low = shared.get(both(n - 1)[0][at])[0].astype(float)
        contexts = np.unique(ctx)
        where = np.searchsorted(contexts, ctx)
        ps, lambdas = [], []
        for own in grams.counts[at].T.astype(float):
            total = np.bincount(where, weights=own, minlength=len(contexts))
            kinds = np.bincount(where, weights=own > 0, minlength=len(contexts))
            spread = np.where(total > 0, DISCOUNT * kinds / np.maximum(total, 1), 1.0)
            lambdas.append(spread)
            ps.append(np.maximum(own - DISCOUNT, 0) / np.maximum(total[where], 1) + spread[where] * np.maximum(low, 1e-9))
        self.seen = Table(keys, np.log(ps[1]) - np.log(ps[0]))
        self.unseen = Table(contexts, np.log(lambdas[1]) - np.log(lambdas[0]))

    def evidence(self, texts: list[str]) -> np.ndarray:
        """Per text: mean log-ratio of a word, the same over its expressions, their number and the strongest."""
        g = Grams(self.lut, texts)
        keys, contexts = g.order(ORDER - 1)
        value, found = self.seen.get(keys)
        rest = np.flatnonzero(~found)
        value[rest] = self.unseen.get(contexts[rest])[0]
        words = np.bincount(g.word, weights=value, minlength=g.words) if g.words else np.zeros(0)
        owner = np.searchsorted(g.starts, g.word_at, side="right") - 1
        n = len(texts)
        count = np.maximum(np.bincount(owner, minlength=n), 1)
        out = words > STANDS_OUT
        strong = np.bincount(owner[out], weights=words[out], minlength=n)
        top = np.zeros(n)
        np.maximum.at(top, owner, words)
        return np.stack([np.bincount(owner, weights=words, minlength=n) / count, strong / np.sqrt(count), np.log1p(np.bincount(owner[out], minlength=n)), np.minimum(top, 20) / 10, strong / count], axis=1)

    def fit_curve(self, x: np.ndarray, toxic: np.ndarray) -> None:
        """x: the evidence of some texts."""
        self.mean, self.std = x.mean(axis=0), x.std(axis=0) + 1e-9
        x = np.concatenate([(x - self.mean) / self.std, np.ones((len(x), 1))], axis=1)
        w = np.zeros(x.shape[1])
        weight = np.where(toxic, PRIOR / max(1, toxic.sum()), (1 - PRIOR) / max(1, (~toxic).sum())) * len(x)
        for _ in range(50):
            p = 1 / (1 + np.exp(-(x @ w).clip(-30, 30)))
            r = p * (1 - p) * weight
            step = np.linalg.solve((x * r[:, None]).T @ x + np.eye(len(w)) * 1e-2, x.T @ (weight * (toxic - p)) - 1e-2 * w)
            w += step
            if np.abs(step).max() < 1e-8:
                break
        self.curve = w

    def scores(self, texts: list[str]) -> np.ndarray:
        if self.curve is None:
            return np.zeros(len(texts))
        x = (self.evidence(texts) - self.mean) / self.std
        return 1 / (1 + np.exp(-(x @ self.curve[:-1] + self.curve[-1]).clip(-500, 500)))


def _labelled(labels: DataFrame, remainder: int) -> DataFrame:
    return labels.where("toxic in (0, 1) and doc_id is not null").where(fold(F.col("doc_id")) == remainder).select("doc_id", F.col("toxic").cast("int").alias("toxic")).distinct()


def _counts(docs: DataFrame, labels: DataFrame) -> Counted:
    """The n-grams of every labelled row of remainder 0, added up in tasks and by Spark. The driver gets each distinct n-gram once."""
    spark = docs.sparkSession

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lut, held, n = letters(), [], 0
        for b in slices(batches, most=1_000_000):
            held.append(Counted.of(b.column(0).to_pylist(), np.asarray(b.column(1)), lut))
            n += len(held[-1].hi)
            if n >= HELD_GRAMS:
                held = [Counted.added(held)]
                n = len(held[0].hi)
                if n >= HELD_GRAMS // 2:
                    yield from held.pop().batches()
                    n = 0
        if held:
            yield from Counted.added(held).batches()

    rows = docs.where("text is not null").where(fold(F.col("doc_id")) == 0).select("doc_id", "text").join(_labelled(labels, 0), "doc_id").select("text", "toxic")
    total = rows.mapInArrow(run, _COUNTS).groupBy("hi", "lo").agg(F.sum("ordinary").alias("ordinary"), F.sum("toxic").alias("toxic"))
    total = Scratch(spark).keep(total, "grams")
    rows_at_once = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50000")  # the rows are short
    try:
        t = total.toArrow()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows_at_once)
    return Counted.added([Counted(t["hi"].to_numpy(), t["lo"].to_numpy(), np.stack([t["ordinary"].to_numpy(), t["toxic"].to_numpy()], axis=1))])


def _curve_sample(docs: DataFrame, labels: DataFrame, model: Model, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Evidence and class of the labelled rows of remainder 2 whose ids hash lowest, at most n of a class, of any length. Texts stay in the executors.

    At most 2 * n ids of a class are drawn, from the labels alone, so the join that fetches their texts broadcasts a bounded set."""
    marked = _labelled(labels, 2).withColumn("h", F.xxhash64("doc_id"))
    ids = reduce(lambda a, b: a.unionByName(b), [marked.where(F.col("toxic") == k).orderBy("h", "doc_id").limit(2 * n) for k in (0, 1)])
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, most=2_000_000):
            x = held.value.evidence(b.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([b.column("toxic"), b.column("h"), b.column("doc_id"), pa.array(x.tolist(), pa.list_(pa.float64()))], names=["toxic", "h", "doc_id", "evidence"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text is not null").join(F.broadcast(ids.withColumn("doc_id", F.col("doc_id").cast("long"))), "doc_id")
    got = rows.select("doc_id", "text", "toxic", "h").mapInArrow(run, _EVIDENCE).collect()
    held.unpersist()
    got = sorted(got, key=lambda r: (r.h, r.doc_id, r.evidence))
    some = [r for k in (0, 1) for r in [r for r in got if r.toxic == k][:n]]
    return np.array([r.evidence for r in some]).reshape(len(some), -1), np.array([r.toxic == 1 for r in some], dtype=bool)


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model | None:
    """Fits the models on every labelled row of remainder 0 of the fold, the curve on `sample_rows` of each class of remainder 2; 1 is held out. None without both classes."""
    grams = _counts(docs, labels)
    if not grams.counts.any(axis=0).all():
        return None
    model = Model.counted(grams)
    x, toxic = _curve_sample(docs, labels, model, sample_rows)
    if not toxic.any() or toxic.all():
        return None
    model.fit_curve(x, toxic)
    del grams
    trim_driver(docs.sparkSession)  # what counting and sorting the n-grams took here
    return model


def score(docs: DataFrame, model: Model | None, threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of `docs`: doc_id, held_out, score, predicted."""
    held = docs.sparkSession.sparkContext.broadcast(model)  # two numbers for each distinct n-gram of the labelled rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for b in slices(batches, most=2_000_000):
            ids, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            s = np.zeros(len(texts)) if m is None else m.scores([t or "" for t in texts])
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array([i is not None and fold_of(i) == 1 for i in ids]), pa.array(s), pa.array((s >= threshold).astype(np.int32))],
                names=["doc_id", "held_out", "score", "predicted"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, RESULT)


def reject(docs: DataFrame, model: Model | None, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of `docs` that score below `threshold`, all columns."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for b in slices(batches, most=2_000_000):
            if m is not None:
                b = b.filter(pa.array(m.scores([t or "" for t in b.column("text").to_pylist()]) < threshold))
            yield b

    return docs.mapInArrow(run, docs.schema)
