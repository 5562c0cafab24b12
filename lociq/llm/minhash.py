"""Near-duplicate documents by HyperMinHash.

A document's set of word shingles is hashed into `REGISTERS` buckets. A register keeps, for the least hash of its bucket, the number of leading zeros and
`MANTISSA` bits after them, 16 bits in all. Bands of `ROWS` registers are the keys under which documents meet. The share of equal registers,
corrected for the collisions that sets of these sizes make by chance, estimates the Jaccard similarity of those that meet, and pairs that could be
linked are confirmed on full shingle sets of their whole texts.

Documents with equal sets form a class first, and one stands for it. Representatives that meet under keys are confirmed each against one of the keys'
least ones, that with which it shares most keys; the components of these links leave little. Then only keys under which several components meet are
looked at again: there every pair of different components is estimated, in blocks of bounded bytes, and a representative that has a possible partner
is marked. Marked ones come back to their block with their texts, are confirmed there on full sets, and a spanning forest of the links leaves the
task, so that what goes on never exceeds the rows, no link between components is lost, and more links inside a component change nothing. A band misses
a pair at the threshold with probability 1 - 0.85^4; all 32 together miss it once in 10^10.

Texts are hashed in segments, so a very long one needs memory for its own shingles only.

Nulls, empty texts and texts without words have an empty set and link with nothing. A text with fewer words than a shingle has one shingle, all of it.
Rows are documents of their own where doc_ids repeat or are null (ordered by doc_id with nulls last, then text). Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, Scratch, keyed, mix, release, seeds, slices, surrogate, trim
from .components import components

WORDS = 5
PERCENT = 85  # links from 100 * intersection >= PERCENT * union
REGISTERS, ROWS, MANTISSA = 128, 4, 10
BANDS = REGISTERS // ROWS
SIGMAS = 5.0  # an estimate within so many standard deviations of the threshold asks for confirmation
BLOCK = 2048  # representatives of a key that are compared in one task, as far as their sets
HEAVY = 1 << 20  # hold so many shingles at most
LEAVES = 1024  # representatives that are confirmed against one in a task
SEGMENT = 1 << 20  # bytes of texts that are hashed at once

BYTES = seeds(256, 41)
BASE = int(seeds(1, 42)[0])
INVERSE = pow(BASE, -1, 1 << 64)
PLACES = seeds(16, 43)
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = 1 << max(16, (n - 1).bit_length())
        have = np.full(size, U64(base))
        have[0] = 1
        _powers[base] = have = np.multiply.accumulate(have)
    return have[:n]


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, *range(9, 14)]] = True


def _words(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and start of each word of some bytes that end with white space."""
    space = _SPACE[x]
    before = np.concatenate([[True], space[:-1]])
    start, stop = np.flatnonzero(~space & before), np.flatnonzero(space & ~before)
    total = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(BYTES[_LOWER[x]] * _power(BASE, len(x)))])
    return mix((total[stop] - total[start]) * _power(INVERSE, len(x) + 1)[start] + (stop - start).astype(np.uint64)), start


def shingles(texts: list[bytes], words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of some texts, sorted and distinct within each, and each hash's text."""
    x = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
    parts, at = [], 0
    while at < len(x):  # segments end with white space
        stop = at + SEGMENT
        while stop < len(x) and not _SPACE[x[stop - 1]]:
            more = np.flatnonzero(_SPACE[x[stop : stop + SEGMENT]])
            stop = stop + int(more[0]) + 1 if len(more) else stop + SEGMENT
        h, begin = _words(x[at:stop])
        parts.append((h, begin + at))
        at = stop
    word, start = (np.concatenate(v) for v in zip(*parts))
    begin = np.cumsum([0] + [len(t) + 1 for t in texts])
    owner = np.searchsorted(begin, start, side="right") - 1
    count = np.bincount(owner, minlength=len(texts))
    first = np.cumsum(count) - count
    left = (first + count)[owner] - np.arange(len(word))  # words from here to the text's end
    padded = np.concatenate([word, np.zeros(words, dtype=np.uint64)])
    h = np.zeros(len(word), dtype=np.uint64)
    for k in range(words):
        h += np.where(left > k, padded[k : k + len(word)] * PLACES[k % 16] + U64(k + 1), U64(0))
        if k % 16 == 15:
            h = mix(h)
    whole = (left >= words) | ((count[owner] < words) & (np.arange(len(word)) == first[owner]))
    h, owner = mix(h[whole]), owner[whole]
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    return h[new], owner[new]


def sketch(h: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """Registers [text, bucket] of sorted shingle hashes; 0 is an empty one."""
    out = np.zeros((n, REGISTERS), dtype=np.uint16)
    bits = REGISTERS.bit_length() - 1
    bucket = (h >> U64(64 - bits)).astype(np.int64)
    cell = owner * REGISTERS + bucket
    first = np.ones(len(h), dtype=bool)
    first[1:] = cell[1:] != cell[:-1]
    rest = (h[first] << U64(bits)) | U64(1 << (bits - 1))
    zeros = np.full(len(rest), 0, dtype=np.uint64)
    y = rest.copy()
    for s in (32, 16, 8, 4, 2, 1):
        low = (y >> U64(64 - s)) == 0
        zeros[low] += U64(s)
        y[low] <<= U64(s)
    mantissa = (y << U64(1)) >> U64(64 - MANTISSA)
    out.ravel()[cell[first]] = (((zeros + U64(1)) << U64(MANTISSA)) | mantissa).astype(np.uint16)
    return out


def bands(registers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys [text, band] and which of them stand for at least one shingle."""
    r = registers.reshape(len(registers), BANDS, ROWS).astype(np.uint64)
    key = np.zeros(r.shape[:2], dtype=np.uint64)
    for k in range(ROWS):
        key += r[:, :, k] * PLACES[k + 4]
    key = mix(key + np.arange(BANDS, dtype=np.uint64)[None, :] * PLACES[9])
    return key.view(np.int64), r.any(axis=2)


def chance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Probability that two registers of disjoint sets with a and b shingles agree, neither being empty."""
    out = np.zeros(np.broadcast(a, b).shape)
    la, lb = a / REGISTERS, b / REGISTERS
    for z in range(40):
        width = 2.0 ** -(z + 1 + MANTISSA)
        lo, hi = 2.0 ** -(z + 1), 2.0**-z
        s = la + lb
        out += la * lb * width * (np.exp(-s * lo) - np.exp(-s * hi)) / np.maximum(s, 1e-12)
    return np.minimum(out, 0.5)


def estimate(x: np.ndarray, y: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Collision-corrected Jaccard estimates of register rows x and y with set sizes a and b."""
    used = np.maximum(((x != 0) | (y != 0)).sum(axis=-1), 1)
    same = ((x == y) & (x != 0)).sum(axis=-1) / used
    c = chance(a, b)
    return (same - c) / (1 - c)


def _slack(used: np.ndarray, sizes: np.ndarray, percent: int) -> np.ndarray:
    """How far below the threshold an estimate may lie. The least hashes of the used buckets are a sample, without replacement, of the union's shingles: the deviation at the threshold follows."""
    j = percent / 100
    union = np.maximum(sizes / (1 + j), 2.0)
    return 0.02 + SIGMAS * np.sqrt(j * (1 - j) / np.maximum(used, 1) * np.maximum(union - used, 0) / (union - 1))


def _could(x, y, a, b, percent: int) -> np.ndarray:
    fits = 100 * np.minimum(a, b) >= percent * np.maximum(a, b)
    return fits & (estimate(x, y, a, b) >= percent / 100 - _slack(((x != 0) | (y != 0)).sum(axis=-1), a + b, percent))


_SKETCH = "key long, n_shingles long, set_a long, set_b long, registers binary, bands array<long>"
_SKETCH_ARROW = pa.schema([("key", pa.int64()), ("n_shingles", pa.int64()), ("set_a", pa.int64()), ("set_b", pa.int64()), ("registers", pa.binary()), ("bands", pa.list_(pa.int64()))])


def _raw(texts: list) -> list[bytes]:
    return [(t or "").encode("utf-8", "surrogatepass") for t in texts]


def _sketches(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, most=1 << 20):
            h, owner = shingles(_raw(b.column(1).to_pylist()), words)
            n = b.num_rows
            size = np.bincount(owner, minlength=n)
            edge = np.concatenate([[0], np.cumsum(size)])
            sums = []
            for k in (0, 1):  # two sums name the set
                s = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(mix(h + PLACES[11 + k]))])
                sums.append(mix(s[edge[1:]] - s[edge[:-1]]).view(np.int64))
            r = sketch(h, owner, n)
            key, used = bands(r)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(size), *map(pa.array, sums), pa.array([x.tobytes() for x in r], pa.binary()), pa.array([k[u] for k, u in zip(key, used)], pa.list_(pa.int64()))],
                schema=_SKETCH_ARROW,
            )

    return run


def _registers(col: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(col.to_pylist()), dtype=np.uint16).reshape(-1, REGISTERS)


def _estimated(percent: int):
    """(a, b, sizes and registers of both) -> (a, b, size of a) of pairs that could be linked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x, y = _registers(b.column("ra")), _registers(b.column("rb"))
                na, nb = (np.asarray(b.column(c)).astype(float) for c in ("na", "nb"))
                ok = pa.array(_could(x, y, na, nb, percent))
                yield pa.RecordBatch.from_arrays([b.column(c).filter(ok) for c in ("a", "b", "na")], names=["a", "b", "na"])

    return run


_CELL = ("band", "i", "j")


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Whole cells (rows of equal band, i and j, which follow each other), some small ones at once."""
    held: list[pa.Table] = []
    n = weight = 0
    for b in batches:
        if not b.num_rows:
            continue
        t = pa.Table.from_batches([b])
        c = [np.asarray(b.column(k)) for k in _CELL]
        edge = np.flatnonzero(np.logical_or.reduce([v[1:] != v[:-1] for v in c]))
        ends = held and any(held[-1].column(k)[-1].as_py() != v[0] for k, v in zip(_CELL, c))
        if (n >= BLOCK or weight >= HEAVY) and (ends or len(edge)):
            cut = 0 if ends else int(edge[0]) + 1
            yield pa.concat_tables([*held, t.slice(0, cut)])
            held, n, weight, t = [], 0, 0, t.slice(cut)
        held.append(t)
        n += t.num_rows
        weight += int(np.asarray(t.column("n")).sum())
    if held:
        yield pa.concat_tables(held)


def _candidates(cell, side, label, same_side, size, r, percent: int, most: int = 400_000):
    """Lists of places (x, y) in one cell that could be linked: of rows sorted by cell, each is held against the row 1, 2, ... further on. Labels may change meanwhile."""
    n = len(cell)
    end = np.searchsorted(cell, cell, side="right")
    used = np.packbits(r != 0, axis=1)
    x, held, count = np.arange(n), [], 0
    for d in range(1, n):
        x = x[end[x] > x + d]
        if not len(x):
            break
        y = x + d
        ok = (label[x] != label[y]) & (same_side[x] | (side[x] != side[y])) & (100 * np.minimum(size[x], size[y]) >= percent * np.maximum(size[x], size[y]))
        for s in range(0, int(ok.sum()), 1 << 14):
            a = x[ok][s : s + (1 << 14)]
            b = a + d
            alike, either = ((r[a] == r[b]) & (r[a] != 0)).sum(axis=1), np.bitwise_count(used[a] | used[b]).sum(axis=1, dtype=np.int64)
            a = a[alike >= (percent / 100 - _slack(either, size[a] + size[b], percent)) * either]  # an estimate is never above this share: chance agreement only lowers it
            a = a[_could(r[a], r[a + d], size[a], size[a + d], percent)]
            if len(a):
                held.append((a, a + d))
                count += len(a)
        if count >= most:
            yield tuple(np.concatenate(v) for v in zip(*held))
            held, count = [], 0
    if held:
        yield tuple(np.concatenate(v) for v in zip(*held))


def _places(t: pa.Table) -> tuple[np.ndarray, ...]:
    """cell, side, label and whether a cell's rows of one side meet: rows of a table of whole cells."""
    c = [np.asarray(t.column(k)) for k in _CELL]
    cell = np.concatenate([[0], np.cumsum(np.logical_or.reduce([v[1:] != v[:-1] for v in c]))])
    _, label = np.unique(np.stack([cell, np.asarray(t.column("component"))]), axis=1, return_inverse=True)
    return cell, np.asarray(t.column("block")), label.ravel(), c[1] == c[2]


def _marked(percent: int):
    """Rows of representatives in cells -> (band, i, j, block, key) of those that could be linked with one of another component there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _cells(batches):
            cell, side, label, same_side = _places(t)
            r, size = _registers(t.column("registers")), np.asarray(t.column("n")).astype(float)
            names, full = bands(r)
            names = np.where(full, names, -np.arange(len(names))[:, None])
            here = np.argmax(names == np.asarray(t.column("band"))[:, None], axis=1)
            good = np.zeros(len(cell), dtype=bool)
            for x, y in _candidates(cell, side, label, same_side, size, r, percent):
                for s in range(0, len(x), 1 << 16):
                    a, b = x[s : s + (1 << 16)], y[s : s + (1 << 16)]
                    first = np.argmax(names[a] == names[b], axis=1) == here[a]  # a pair is looked at under its first common key only
                    good[a[first]] = good[b[first]] = True
            yield from t.filter(pa.array(good)).select(_MARKED).to_batches()

    return run


_MARKED = ["band", "i", "j", "block", "key", "component", "n"]


def _forest(percent: int, words: int):
    """Rows of cells with their texts -> (a, b): links, confirmed on full sets, that join the components of each cell as far as any links do."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _cells(batches):
            cell, side, label, same_side = _places(t)
            key = np.asarray(t.column("key"))
            texts = _raw(t.column("text").to_pylist())
            t = None
            h, owner = shingles(texts, words)
            texts = None
            size = np.bincount(owner, minlength=len(key))
            edge = np.concatenate([[0], np.cumsum(size)])
            r = sketch(h, owner, len(key))
            names = np.unique(h, return_inverse=True)[1]
            here = np.zeros(len(h), dtype=bool)
            out = []
            for x, y in _candidates(cell, side, label, same_side, size.astype(float), r, percent):
                order = np.argsort(x, kind="stable")
                x, y = x[order], y[order]
                cuts = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]]))
                for s, e in zip(cuts, [*cuts[1:], len(x)]):
                    a, others = x[s], y[s:e]
                    mine = names[edge[a] : edge[a + 1]]
                    here[mine] = True
                    others = others[label[others] != label[a]]
                    for at in range(0, len(others), 1024):
                        b = others[at : at + 1024]
                        n = size[b]
                        each = np.repeat(edge[b] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
                        common = np.add.reduceat(here[names[each]].astype(np.int64), np.concatenate([[0], np.cumsum(n)[:-1]])) if len(b) else n
                        for c in b[100 * common >= percent * (n + size[a] - common)].tolist():
                            if label[c] != label[a]:
                                out.append((key[a], key[c]))
                                label[label == label[c]] = label[a]
                    here[mine] = False
            a, b = np.array(out, dtype=np.int64).reshape(-1, 2).T
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])
            trim()

    return run


def _by_cell(rows: DataFrame) -> DataFrame:
    return rows.repartition(*_CELL).sortWithinPartitions(*_CELL, "block", "key")


def _links(cells: DataFrame, texts: DataFrame, percent: int, words: int) -> DataFrame:
    """Links between rows of cells. Each row fetches its text once for each of its cells; the join is alike at every size, with no broadcast of what grows."""
    return _by_cell(cells.hint("merge").join(texts, "key")).mapInArrow(_forest(percent, words), "a long, b long")


def _stars(best: DataFrame) -> DataFrame:
    """Cells of pairs (a, b, size of a): b and so many of its partners as one task confirms."""
    wide = best.groupBy("b").agg(F.greatest(F.ceil(F.count(F.lit(1)) / LEAVES), F.ceil(F.sum("na") / HEAVY)).cast("int").alias("salts"))
    leaves = best.join(wide, "b").select(F.col("b").alias("band"), F.pmod(F.xxhash64("a"), F.col("salts")).cast("int").alias("i"), F.lit(1).alias("block"), F.col("a").alias("key"), F.col("na").alias("n"))
    centres = wide.select(F.col("b").alias("band"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("i"), F.lit(0).alias("block"), F.col("b").alias("key"), F.lit(0).cast("long").alias("n"))
    return leaves.unionByName(centres).withColumn("j", F.lit(-1)).withColumn("component", F.col("key")).select(_MARKED)


def near_duplicates(docs: DataFrame, percent: int = PERCENT, words: int = WORDS) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of `docs`."""
    return _near_duplicates(keyed(docs), percent, words)


def _near_duplicates(source: DataFrame, percent: int, words: int) -> DataFrame:
    """The same of a keyed table, and its key."""
    spark = source.sparkSession
    scratch = Scratch(spark)
    texts = source.select("key", "text")
    sketched = scratch.keep(texts.mapInArrow(_sketches(words), _SKETCH), "sketches")
    # written, so that the join below reads it by a shuffle of its own and the adaptive planner can split the rows of a class that holds a third of all
    classes = scratch.keep(sketched.where("n_shingles > 0").groupBy("set_a", "set_b", "n_shingles").agg(F.min("key").alias("rep"), F.count(F.lit(1)).alias("size")), "classes")
    reps = scratch.keep(sketched.join(classes, F.col("key") == F.col("rep"), "left_semi").select("key", "n_shingles", "registers", "bands"), "representatives")
    meet = reps.select("key", F.explode("bands").alias("band"))
    least = meet.groupBy("band").agg(F.min("key").alias("b"), F.count(F.lit(1)).alias("size")).where("size > 1").drop("size")
    star = meet.withColumnRenamed("key", "a").join(least, "band").where("a <> b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared"))
    nearest = star.groupBy("a").agg(F.max_by("b", F.struct("shared", -F.col("b"))).alias("b"))
    side = lambda x: reps.select(F.col("key").alias(x), F.col("n_shingles").alias(f"n{x}"), F.col("registers").alias(f"r{x}"))
    best = scratch.keep(nearest.join(side("a"), "a").join(side("b"), "b").select("a", "b", "na", "nb", "ra", "rb").mapInArrow(_estimated(percent), "a long, b long, na long"), "best")
    links = scratch.keep(_links(_stars(best), texts, percent, words), "links")
    release(spark)
    grown = components(links, scratch)

    # keys under which several components still meet
    labelled = reps.join(grown.withColumnRenamed("id", "key"), "key", "left").select("key", "n_shingles", "registers", "bands", F.coalesce("component", "key").alias("component"))
    again = labelled.select("key", "component", F.col("n_shingles").alias("n"), F.explode("bands").alias("band"))
    mixed = again.groupBy("band").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.count(F.lit(1)).alias("size"), F.sum("n").alias("weight")).where("x <> y")
    mixed = mixed.select("band", F.greatest(F.ceil(F.col("size") / BLOCK), F.ceil(F.col("weight") / HEAVY)).cast("int").alias("blocks"))
    dealt = again.join(mixed, "band").withColumn("block", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))
    cells = dealt.select("key", "band", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")).select("key", "band", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    met = cells.join(labelled.select("key", "component", F.col("n_shingles").alias("n"), "registers"), "key").select(*_MARKED, "registers")
    marked = scratch.keep(_by_cell(met).mapInArrow(_marked(percent), "band long, i int, j int, block int, key long, component long, n long"), "marked")
    release(spark)
    more = scratch.keep(_links(marked, texts, percent, words), "links")
    final = components(links.unionByName(more), scratch)

    member = sketched.join(classes.where("size > 1"), ["set_a", "set_b", "n_shingles"], "left").select("key", "n_shingles", F.coalesce("rep", "key").alias("rep"))
    named = member.join(final.withColumnRenamed("id", "rep"), "rep", "left").select("key", "n_shingles", F.coalesce("component", "rep").alias("component"))
    if surrogate(source):
        ids = source.select(F.col("key").alias("component"), F.col("doc_id").alias("component_id"))
        named = named.join(source.select("key", "doc_id"), "key").join(ids, "component")
    else:
        named = named.withColumn("doc_id", F.col("key")).withColumn("component_id", F.col("component"))
    return named.select("doc_id", "n_shingles", "component_id", (F.col("key") == F.col("component")).alias("kept"), "key")


def one_of_each(docs: DataFrame, percent: int = PERCENT, words: int = WORDS) -> DataFrame:
    """The rows of `docs` that stand for their group: the least of each component, and every row without a partner."""
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    source = keyed(docs, *others)  # the one numbering for sketches and for the rows that stay
    kept = _near_duplicates(source, percent, words).where("kept")
    if not surrogate(source):
        return docs.join(kept.select("doc_id"), "doc_id", "left_semi").select(docs.columns)
    return source.join(kept.select("key"), "key", "left_semi").drop("key").withColumnsRenamed({f"keep_{i}": c for i, c in enumerate(others)}).select(docs.columns)
