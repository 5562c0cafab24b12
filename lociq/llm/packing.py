"""Bounded-space online packing of token sequences.

Each partition keeps a fixed number of open windows of `window` tokens. A document's ids arrive in order; what is longer than
a window is cut into full windows first. The rest goes whole to the open window that it fits best (least room left). When none
fits, the fullest open window takes as much of the piece as it has room for and is emitted, full; the remainder is placed like
any other piece. At a partition's end the open windows are set aside with their ids, and groups of `merge_of` partitions' leftovers are
then poured together into full windows. The last rest of each group is laid out in windows whose lengths are powers of two, which
need no padding.

Nulls and empty texts give one piece that holds the end id alone; repeated rows are packed as rows of their own; a row with a null
doc_id is packed too. An empty table gives no rows. Other columns of the input are ignored.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, slices

END = 1
WINDOW = 2048
OPEN = 16
MERGE_OF = 64

PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_DRAFT = PIECE + ", ids binary, part long, slot int"
_COLUMNS = [c.split()[0] for c in PIECE.split(", ")]


def _byte_letters() -> dict[int, str]:
    """Byte-level alphabet of public byte BPE vocabularies: printable Latin-1 bytes stand for themselves, the rest from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class WordTokenizer:
    """Ids of a text as little-endian uint32 bytes, by caches of white-space-separated chunks and of words.

    White space never survives the vocabulary's own splitting, so chunks are independent. Chunks of simple Latin letters are split by
    the vocabulary's pattern here and only unseen words reach its merge model; all others go through the whole tokenizer.
    """

    WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
    SIMPLE = regex.compile(r"[!-\xa0\xa1-įı-ɏ]+")
    MOST_CHUNKS, MOST_WORDS = 300_000, 800_000

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.letters = _byte_letters()
        self.chunks: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}

    def _word(self, word: str) -> bytes:
        mapped = word if word.isascii() else "".join(self.letters[b] for b in word.encode())
        out = np.array([t.id for t in self.model.tokenize(mapped)], dtype="<u4").tobytes()
        if len(self.words) >= self.MOST_WORDS:
            self.words.clear()
        if len(word) <= 64:
            self.words[word] = out
        return out

    def _chunk(self, chunk: str) -> bytes:
        if not chunk:
            return b""
        if "<|" not in chunk and "\xa0" not in chunk and "\x85" not in chunk and self.SIMPLE.fullmatch(chunk):
            words = self.words
            out = b"".join([words.get(w) or self._word(w) for w in self.WORDS.findall(chunk.lower())])
        else:
            out = np.array(self.tokenizer.encode(chunk, add_special_tokens=False).ids, dtype="<u4").tobytes()
        if len(self.chunks) >= self.MOST_CHUNKS:
            self.chunks.clear()
        if len(chunk) <= 64:
            self.chunks[chunk] = out
        return out

    def __call__(self, text: str) -> bytes:
        chunks = self.chunks
        out = []
        for c in text.replace("\n", " ").split(" "):
            got = chunks.get(c)
            out.append(self._chunk(c) if got is None else got)
        return b"".join(out)


@lru_cache(maxsize=2)
def tokenizer_of(path: str) -> WordTokenizer:
    """One tokenizer, and its caches, for all tasks of a worker process."""
    return WordTokenizer(path)


class Windows:
    """The open windows of one partition; rows come out as windows are emitted."""

    def __init__(self, window: int, n: int) -> None:
        self.window, self.n = window, n
        self.open: list[tuple[int, list]] = []
        self.done: list[list] = []

    def add(self, doc, ids: bytes) -> None:
        total, at = len(ids) // 4, 0
        while total - at >= self.window:
            self.done.append([(doc, at, self.window, total, ids)])
            at += self.window
        if at < total:
            self._place(doc, at, total, ids)

    def _place(self, doc, at: int, total: int, ids: bytes) -> None:
        need = total - at
        fits = [(self.window - used, i) for i, (used, _) in enumerate(self.open) if self.window - used >= need]
        if fits:
            i = min(fits)[1]
        elif len(self.open) < self.n:
            self.open.append((0, []))
            i = len(self.open) - 1
        else:
            i = max(range(len(self.open)), key=lambda k: self.open[k][0])
            used, pieces = self.open.pop(i)
            room = self.window - used
            pieces.append((doc, at, room, total, ids))
            self.done.append(pieces)
            self._place(doc, at + room, total, ids)
            return
        used, pieces = self.open[i]
        pieces.append((doc, at, need, total, ids))
        if used + need == self.window:
            self.open.pop(i)
            self.done.append(pieces)
        else:
            self.open[i] = (used + need, pieces)


def _rows(out: dict, pieces: list, sequence: int, part: int, slot: int, carry: bool) -> None:
    offset = 0
    for doc, at, n, total, ids in pieces:
        part_ids = ids[4 * at : 4 * (at + n)]
        for k, v in zip((*_COLUMNS, "ids", "part", "slot"), (doc, at, n, zlib.crc32(part_ids), total, sequence, offset, part_ids if carry else None, part, slot)):
            out[k].append(v)
        offset += n


_SCHEMA = pa.schema([*((c, pa.int64()) for c in _COLUMNS), ("ids", pa.binary()), ("part", pa.int64()), ("slot", pa.int32())])


def _empty() -> dict:
    return {k: [] for k in _SCHEMA.names}


def pack(docs: DataFrame, tokenizer: str, window: int = WINDOW, open_windows: int = OPEN, merge_of: int = MERGE_OF, end: int = END) -> DataFrame:
    """Packs column `text` of `docs` (doc_id, text, ...) and returns one row per piece (schema PIECE)."""
    tail = np.array([end], dtype="<u4").tobytes()

    def draft(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        encode, windows, emitted = tokenizer_of(tokenizer), Windows(window, open_windows), 0
        for b in slices(batches, most=2_000_000):
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                windows.add(doc, encode(text or "") + tail)
            out = _empty()
            for pieces in windows.done:
                _rows(out, pieces, (part << 32) + emitted, part, -1, False)
                emitted += 1
            windows.done.clear()
            yield pa.RecordBatch.from_pydict(out, schema=_SCHEMA)
        out = _empty()
        for slot, (_, pieces) in enumerate(windows.open):
            _rows(out, pieces, -1, part, slot, True)
        yield pa.RecordBatch.from_pydict(out, schema=_SCHEMA)

    def merge(t: pa.Table) -> pa.Table:
        rows = t.sort_by([("part", "ascending"), ("slot", "ascending"), ("offset", "ascending")]).to_pylist()
        group = rows[0]["part"] // merge_of
        pieces = deque([r["doc_id"], r["start"], r["doc_tokens"], r["ids"]] for r in rows)
        left, sequence, out = sum(len(p[3]) // 4 for p in pieces), (1 << 62) + (group << 32), _empty()
        while left:
            room = window if left >= window else 1 << (left.bit_length() - 1)
            took = []
            left -= room
            while room:
                doc, start, total, ids = pieces[0]
                n = min(room, len(ids) // 4)
                took.append((doc, start, n, total, ids[: 4 * n]))
                room -= n
                if 4 * n == len(ids):
                    pieces.popleft()
                else:
                    pieces[0] = [doc, start + n, total, ids[4 * n :]]
            offset = 0
            for doc, start, n, total, ids in took:
                for k, v in zip(_SCHEMA.names, (doc, start, n, zlib.crc32(ids), total, sequence, offset, None, group, 0)):
                    out[k].append(v)
                offset += n
            sequence += 1
        return pa.table(out, schema=_SCHEMA).select(_COLUMNS)

    scratch = Scratch(docs.sparkSession)
    drafts = scratch.keep(docs.select("doc_id", "text").mapInArrow(draft, _DRAFT), "pieces")
    placed = drafts.where("slot < 0").select(_COLUMNS)
    rest = drafts.where("slot >= 0")
    merged = rest.groupBy(F.expr(f"part div {merge_of}")).applyInArrow(merge, PIECE)
    return placed.unionByName(merged)
