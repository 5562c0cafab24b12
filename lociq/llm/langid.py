"""Language identification by cross-parsing entropy.

One suffix automaton is built per language from labelled text. An unseen text is parsed greedily against it: a phrase is the longest
substring of the reference from where the last phrase ended, or one symbol that the reference lacks. Phrases times the logarithm of the reference's size, over
the text's symbols, estimate the cross entropy between the text and the language, where a symbol that the reference lacks counts twice (an escape and the symbol); the language with the least wins (ties: the value that sorts first). Texts
are lower-cased letter by letter, and each run of other characters counts as one gap.

Whole texts are parsed, every letter of the samples is told apart, and every label is learned. Blocks of `BLOCK` symbols are walked side by side; where a block
begins inside a phrase it is walked again from the state that the block before it ends in, as far as the two walks differ, so blocks do not show in the result.

A null text or one without a letter gives `und` and score 0. If no labelled row is left to learn from, every text gives `und`. Repeated
rows are answered alike; a null doc_id keeps its row. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, code_points, fold, fold_of, slices

SAMPLE_ROWS = 60  # labelled rows per language that the automata are fitted on
SAMPLE_SYMBOLS = 40_000  # symbols per language, to the end of the text that reaches them
LONG = 4_000  # longer rows are sampled only where no others are left
DENSE = 1 << 24  # cells of a table of transitions; larger ones are kept as sorted pairs, with the same result
BLOCK = 512
MOST_SENT = 200_000  # sampled ids that every executor is sent; more are joined by a shuffle, with the same result
STATE, FLAG = (1 << 30) - 1, 1 << 30
GAP = 0

RESULT = "doc_id long, held_out boolean, lang_pred string, score double"


def automaton(text: np.ndarray) -> list[dict[int, int]]:
    """Suffix automaton of a symbol sequence: the transitions of each state; state 0 is the root."""
    step: list[dict[int, int]] = [{}]
    link, length = [-1], [0]
    last = 0
    for c in text.tolist():
        cur = len(step)
        step.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in step[p]:
            step[p][c] = cur
            p = link[p]
        if p >= 0:
            q = step[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                clone = len(step)
                step.append(dict(step[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and step[p].get(c) == q:
                    step[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    return step


class Parser:
    """Total transitions for greedy parsing: the next state, with FLAG where the symbol begins a phrase."""

    def __init__(self, text: np.ndarray, width: int, dense: int = DENSE) -> None:
        """`text` holds symbols of an alphabet of `width`; those that it lacks share one column."""
        own = np.unique(text)
        self.local = np.full(width, len(own), dtype=np.int64)
        self.local[own] = np.arange(len(own))
        self.size, self.width = len(text), len(own) + 1
        step = automaton(self.local[text])
        self.root = np.full(self.width, FLAG, dtype=np.int64)
        for c, to in step[0].items():
            self.root[c] = to | FLAG
        self.table = None
        if len(step) * self.width <= dense:
            self.table = np.tile(self.root.astype(np.int32), (len(step), 1))
            for at, to in enumerate(step[1:], 1):
                for c, v in to.items():
                    self.table[at, c] = v
            self.table = self.table.ravel()
            return
        pairs = sorted((at * self.width + c, v) for at, to in enumerate(step) if at for c, v in to.items())
        self.keys, self.values = (np.array(x, dtype=np.int64) for x in zip(*pairs)) if pairs else (np.zeros(0, dtype=np.int64),) * 2

    def __call__(self, state: np.ndarray, c: np.ndarray) -> np.ndarray:
        key = state.astype(np.int64) * self.width + c
        if self.table is not None:
            return self.table[key]
        if not len(self.keys):
            return self.root[c].astype(np.int32)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.values[at], self.root[c]).astype(np.int32)


class Model:
    """Alphabet and one parser per language."""

    def __init__(self, labelled: list[tuple[str, str]], dense: int = DENSE) -> None:
        by: dict[str, list[str]] = {}
        for lang, text in labelled:
            by.setdefault(lang, []).append(text)
        self.alphabet = sorted({low(c) for _, text in labelled for c in set(text) if c.isalpha()})
        self.other = len(self.alphabet) + 1
        self.languages = sorted(by)
        self.parsers = [Parser(self._reference(by[lang]), self.other + 1, dense) for lang in self.languages]

    def _reference(self, texts: list[str]) -> np.ndarray:
        """Whole texts, in the order given, until SAMPLE_SYMBOLS are reached."""
        parts, n = [], 0
        for t in texts:
            if n >= SAMPLE_SYMBOLS:
                break
            parts.append(self.symbols([t])[0])
            n += len(parts[-1])
        return np.concatenate(parts)

    def lut(self) -> np.ndarray:
        """Symbol of each code point: gap, letters of the samples from 1, one symbol for letters that no sample has."""
        at = {c: i + 1 for i, c in enumerate(self.alphabet)}
        out = np.zeros(0x110000, dtype=np.int32)
        for i in range(0x110000):
            c = chr(i)
            if c.isalpha():
                out[i] = at.get(low(c), self.other)
        return out

    def symbols(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Symbols of all texts, offsets of each, and the number of letters in each."""
        if not hasattr(self, "_lut"):
            self._lut = self.lut()
        points, starts = code_points(texts)
        s = self._lut[points]
        letters = np.concatenate([[0], np.cumsum(s != GAP)])
        keep = (s != GAP) | (np.concatenate([[GAP], s[:-1]]) != GAP)
        place = np.concatenate([[0], np.cumsum(keep)])
        return s[keep], place[starts], letters[starts[1:]] - letters[starts[:-1]]

    def phrases(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Phrases and lacking symbols [text, language], and the letters of each text."""
        s, starts, letters = self.symbols(texts)
        size = np.diff(starts)
        counts, lacks = np.zeros((2, len(texts), len(self.parsers)), dtype=np.int64)
        blocks = -(-size // BLOCK)
        owner = np.repeat(np.arange(len(texts)), blocks)
        if not len(owner):
            return counts, lacks, letters
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        begin = starts[:-1][owner] + nth * BLOCK
        length = np.minimum(BLOCK, starts[1:][owner] - begin)
        order = np.argsort(-length, kind="stable")
        alive = np.searchsorted(-length[order], -np.arange(1, length.max() + 1), side="right")
        inner, follows = np.flatnonzero(nth > 0), np.concatenate([nth[1:] > 0, [False]])  # blocks that go on with a text, and those that are gone on with
        for k, parser in enumerate(self.parsers):
            c = parser.local[s]
            walk = np.zeros(len(s), dtype=np.int32)
            state = np.zeros(len(order), dtype=np.int32)
            for i, n in enumerate(alive):
                at = begin[order[:n]] + i
                v = parser(state[:n], c[at])
                walk[at] = v
                state[:n] = v & STATE
            todo = inner
            while len(todo):
                now = walk[begin[todo] - 1] & STATE
                rest, ended = todo, []
                for i in range(BLOCK):
                    over = length[rest] <= i
                    ended.append(rest[over])
                    rest, now = rest[~over], now[~over]
                    if not len(rest):
                        break
                    at = begin[rest] + i
                    v = parser(now, c[at])
                    differ = (v & STATE) != (walk[at] & STATE)
                    walk[at] = v
                    rest, now = rest[differ], v[differ] & STATE
                ended = np.concatenate([*ended, rest])  # walked to the end without meeting the first walk: the next block's start has changed
                todo = np.sort(ended[follows[ended]]) + 1
            for out, one in ((counts, walk >> 30), (lacks, c == parser.width - 1)):
                total = np.concatenate([[0], np.cumsum(one)])
                out[:, k] = total[starts[1:]] - total[starts[:-1]]
        return counts, lacks, letters

    def predict(self, texts: list[str]) -> list[tuple[str, float]]:
        if not self.parsers:
            return [("und", 0.0)] * len(texts)
        counts, lacks, letters = self.phrases(texts)
        cost = (counts + lacks) * np.log([max(2, p.size) for p in self.parsers])  # dividing by the text's symbols would not change the order
        out = []
        for c, n in zip(cost, letters):
            if not n:
                out.append(("und", 0.0))
                continue
            best = int(np.argmin(c))
            out.append((self.languages[best], float(1 / np.exp(-(c - c[best]).clip(0, 700)).sum())))
        return out


def low(c: str) -> str:
    """A letter in lower case, as one letter."""
    return c.lower()[0]


def fit(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """Fits on at most `sample_rows` labelled rows of each language (those whose ids hash lowest, long ones last) outside the held-out fold. The ids are chosen in one pass, then their texts
    are fetched; of rows that repeat an id in a language one counts."""
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & (fold(F.col("doc_id")) != 1)).select("lang", "text", "doc_id")
    order = Window.partitionBy("lang").orderBy((F.length("text") > LONG), F.xxhash64("doc_id"), "doc_id")
    ids = rows.select("lang", "doc_id", "text").withColumn("n", F.row_number().over(order)).where(F.col("n") <= sample_rows).select("lang", "doc_id", "n")
    ids = Scratch(docs.sparkSession).keep(ids.groupBy("lang", "doc_id").agg(F.min("n").alias("n")), "ids")
    few = ids.count() <= MOST_SENT  # sample_rows a language: the texts stay where they are unless there are very many languages
    got = rows.join(F.broadcast(ids) if few else ids.hint("merge"), ["lang", "doc_id"]).groupBy("lang", "n").agg(F.min("text").alias("text")).collect()
    return Model([(r.lang, r.text) for r in sorted(got, key=lambda r: (r.lang, r.n))])


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """One row per row of `docs`: doc_id, held_out, lang_pred, score."""
    held = docs.sparkSession.sparkContext.broadcast(model)  # SAMPLE_SYMBOLS and one text more a language, as a table of transitions

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for b in slices(batches, most=3_000_000):
            ids, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            got = m.predict([t or "" for t in texts])
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array([i is not None and fold_of(i) == 1 for i in ids]), pa.array([x for x, _ in got], pa.string()), pa.array([x for _, x in got], pa.float64())],
                names=["doc_id", "held_out", "lang_pred", "score"],
            )

    return docs.select("doc_id", "text").mapInArrow(predict, RESULT)
