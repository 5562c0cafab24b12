"""SentencePiece encoding and decoding with N-best segmentations.

A text becomes `▁` and itself with spaces as `▁`; its segmentations are the paths of a lattice whose edges are vocabulary pieces, and a path's score
is the sum of its pieces'. Forward Viterbi scores say for every place the best score of any path that leads there. They are the exact
heuristic of an A-star search from the end back to the start, which therefore takes complete segmentations off its queue in order of score. As the
heuristic is exact, every entry of the queue leads to a segmentation of just its score: entries below the N best are never kept, and the best way on from an
entry is followed at once. Pieces are found along a trie and entries point back to the one they came from, so time is linear in a text without spaces, too.
Characters outside the vocabulary fall back on byte pieces, which score `PENALTY` below the worst piece each.

No piece holds a `▁` after another character, so a text's lattice falls apart at word starts, and a long word's between neighbours that no piece holds. Words
are searched once and kept; a text's N best are merged from its words' N best: only the N - 1 words whose second choice costs least can differ from the
best. Ties are broken by the piece ids.

The model may be any SentencePiece vocabulary with scores, and is searched as a unigram model; a merge vocabulary's scores are merge ranks, so its best
segmentation here is the one of least summed rank, not the one its merges would make. No normaliser is applied.

Nulls and empty texts have no pieces, score 0 and decode to an empty text. A text with `▁` of its own decodes to spaces there and reports no round trip.
Repeated rows are answered alike, null ids keep their rows, other columns are ignored.
"""

from __future__ import annotations

import gc
import heapq
import math
import re
import zlib
from array import array
from bisect import insort
from collections.abc import Iterator
from functools import lru_cache
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import slices

N_BEST = 3
PENALTY = 10.0
UNUSED = -1e6  # vocabularies mark pieces that are never to be used by scores far below
GAP = "▁"
SECOND = itemgetter(2)
RESULT = "doc_id long, n_pieces long, score double, ids_crc32 long, nbest_scores array<double>, n_decoded long, round_trip boolean"


class Pieces:
    """A SentencePiece vocabulary as a lattice of scored pieces."""

    MOST_WORDS, SHORT = 600_000, 64  # kept words, and the characters of the longest that is kept or searched uncut

    def __init__(self, path: str, n_best: int = N_BEST) -> None:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.n_best = n_best
        self.text = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
        plain = [i for i in range(len(self.text)) if sp.get_score(i) > UNUSED and not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]
        self.score = {i: sp.get_score(i) for i in plain}
        self.ids = {self.text[i]: i for i in plain}
        self.bytes = {int(self.text[i][3:5], 16): i for i in range(len(self.text)) if sp.is_byte(i)}
        worst = min(s for s in self.score.values() if s > UNUSED) - PENALTY
        self.score |= dict.fromkeys(self.bytes.values(), worst)
        self.value = {i: b for b, i in self.bytes.items()}
        self.unknown = worst
        self.trie: dict = {}
        for t, i in self.ids.items():
            node = self.trie  # character: [further characters, (score, ids) of the piece that ends here]
            for c in t:
                last = node.setdefault(c, [{}, None])
                node = last[0]
            last[1] = (self.score[i], (i,))
        self.pairs = {a + b for t in self.ids for a, b in zip(t, t[1:])}
        inner = any(GAP in t.lstrip(GAP) for t in self.ids)
        lines = any("\n" in t for t in self.ids)
        # places where no piece can cross: a gap after another character, and line ends where no piece has them
        self.split = re.compile(r"(?s).+" if inner else rf"{GAP}*[^{GAP}]+|{GAP}+" if lines else rf"\n|{GAP}+(?=\n)|{GAP}*[^{GAP}\n]+|{GAP}+")
        self.words: dict[str, tuple] = {}

    def lattice(self, word: str) -> tuple[list, list[float]]:
        """For each place the pieces that end there (start, score, ids), and the best score of a path that leads there."""
        n = len(word)
        into: list = [[] for _ in range(n + 1)]
        best = [-math.inf] * (n + 1)
        best[0] = 0.0
        root = self.trie
        for i in range(n):
            node, at, alone = root, best[i], False
            j = i
            while j < n and node and (found := node.get(word[j])):
                node, piece = found
                j += 1
                if piece:
                    s, k = piece
                    into[j].append((i, s, k))
                    if at + s > best[j]:
                        best[j] = at + s
                    alone = alone or j == i + 1
            if not alone:
                b = tuple([self.bytes[x] for x in word[i].encode("utf-8", "surrogatepass")])
                s = self.unknown * len(b)
                into[i + 1].append((i, s, b))
                if at + s > best[i + 1]:
                    best[i + 1] = at + s
        return into, best

    def first(self, word: str) -> tuple[float, list[int], float]:
        """The best segmentation's score and ids, and what the second costs against it: the first way through the queue, and its head after that."""
        into, best = self.lattice(word)
        j, g, second, steps = len(word), 0.0, -math.inf, []
        while j:
            ways = into[j]
            if len(ways) == 1:
                way = ways[0]
            else:
                top, way = -math.inf, None
                for x in ways:
                    score = best[x[0]] + (g + x[1])
                    if score > top:
                        if top > second:
                            second = top
                        top, way = score, x
                    elif score > second:
                        second = score
            j, g = way[0], g + way[1]
            steps.append(way[2])
        return best[-1], [k for step in reversed(steps) for k in step], best[-1] - second

    def search(self, word: str, n: int) -> list[tuple[float, tuple]]:
        """The n best segmentations (score, ids), best first."""
        into, best = self.lattice(word)
        # entries: (-score, number, place, score from there on, pieces from there on, linked); sorted, the n best and their ties
        queue: list = [(-best[-1], 0, len(word), 0.0, None)]
        out: list = []
        number = 0
        while queue and (len(out) < n or -queue[0][0] == out[-1][0] and len(out) < 4 * n):
            f, _, j, g, linked = queue.pop(0)
            spare = n - len(out) - 1
            while j:
                ways = into[j]
                if len(ways) == 1:
                    i, s, k = ways[0]
                    j, g, linked = i, g + s, (k, linked)
                    continue
                top, way = -math.inf, None
                for x in ways:
                    score = best[x[0]] + (g + x[1])
                    if score > top:
                        top, way = score, x
                for x in ways:
                    if x is not way:
                        score = -(best[x[0]] + (g + x[1]))
                        if score <= f if spare <= 0 else len(queue) < spare or score <= queue[spare - 1][0]:
                            number += 1
                            insort(queue, (score, number, x[0], g + x[1], (x[2], linked)))
                            while len(queue) > spare > 0 and queue[-1][0] > queue[spare - 1][0]:
                                queue.pop()
                j, g, linked = way[0], g + way[1], (way[2], linked)
            ids: list = []
            while linked:
                k, linked = linked
                ids += k
            out.append((-f, tuple(ids)))
        return sorted(out, key=lambda x: (-x[0], x[1]))[:n]

    def parts(self, word: str) -> list[str]:
        """A word, cut where no piece can cross: between neighbours that no piece holds next to each other."""
        out, at = [], 0
        for i in range(1, len(word)):
            if word[i - 1 : i + 1] not in self.pairs:
                out.append(word[at:i])
                at = i
        return [*out, word[at:]]

    def word(self, word: str) -> tuple:
        """(ids as bytes, best score, cost of the second choice, costs of the N best or the word to search for them, decoded)"""
        if len(word) > self.SHORT and len(parts := self.parts(word)) > 1:
            got = [self.words.get(w) or self.word(w) for w in parts]
            top, costs = self.merged(got)
            decoded = self.decode(np.frombuffer(b"".join([g[0] for g in got]), dtype="<u4").tolist(), False)  # a character's bytes never fall apart, but replaced ones may follow each other
            return b"".join([g[0] for g in got]), top, costs[1] if len(costs) > 1 else math.inf, costs, decoded
        top, ids, second = self.first(word)
        got = (array("I", ids).tobytes(), top, second, word, self.decode(ids, False))
        if len(self.words) >= self.MOST_WORDS:
            self.words.clear()
        if len(word) <= self.SHORT:
            self.words[word] = got
        return got

    def merged(self, got: list[tuple]) -> tuple[float, list[float]]:
        """The best score of some words in a row, and what the N best cost against it."""
        costs = [0.0]
        if self.n_best > 1:
            for g in heapq.nsmallest(self.n_best - 1, got, key=SECOND):
                own = [g[1] - s for s, _ in self.search(g[3], self.n_best)] if isinstance(g[3], str) else g[3]
                costs = sorted([a + b for a in costs for b in own])[: self.n_best]
        return sum([g[1] for g in got]), costs

    def decode(self, ids, first: bool = True) -> str:
        """The text of some piece ids; the leading gap goes where the ids start a text."""
        if self.value.keys().isdisjoint(ids):
            text = "".join([self.text[i] for i in ids]).replace(GAP, " ")
            return text[1:] if first and text[:1] == " " else text
        out, held = [], bytearray()
        for i in ids:
            if i in self.value:
                held.append(self.value[i])
            else:
                if held:
                    out.append(held.decode("utf-8", "replace"))
                    held.clear()
                out.append(self.text[i])
        if held:
            out.append(held.decode("utf-8", "replace"))
        text = "".join(out).replace(GAP, " ")
        return text[1:] if first and text[:1] == " " else text

    def encode(self, text: str) -> tuple[bytes, list[float], str]:
        """(ids of the best segmentation, scores of the N best, decoded text)"""
        if not text:
            return b"", [0.0], ""
        words = self.words
        got = [words.get(w) or self.word(w) for w in self.split.findall(GAP + text.replace(" ", GAP))]
        top, costs = self.merged(got)
        return b"".join([g[0] for g in got]), [top - c for c in costs], "".join([g[4] for g in got])[1:]


@lru_cache(maxsize=2)
def pieces_of(path: str, n_best: int = N_BEST) -> Pieces:
    return Pieces(path, n_best)


def encode(docs: DataFrame, model: str, n_best: int = N_BEST) -> DataFrame:
    """One row per row of `docs`: the digest of its best segmentation, the N best scores, and whether decoding gives the text back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pieces_of(model, n_best)
        for b in slices(batches, most=2_000_000):
            rows = []
            gc.disable()  # many small tuples without cycles, which the collector would visit again and again
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ids, scores, decoded = p.encode(text or "")
                rows.append((doc, len(ids) // 4, scores[0], zlib.crc32(ids), scores, len(decoded), decoded == (text or "")))
            gc.enable()
            cols = list(zip(*rows))
            types = (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.list_(pa.float64()), pa.int64(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["doc_id", "n_pieces", "score", "ids_crc32", "nbest_scores", "n_decoded", "round_trip"])

    return docs.select("doc_id", "text").mapInArrow(run, RESULT)
