"""Near-duplicate embeddings by lattice hashing.

Vectors of unit length are projected at random to 8 dimensions, once for each table, and decoded to the nearest point of the E8 lattice. A vector is filed under its
own cell and, for probing, under the `PROBES` neighbouring cells nearest to it; two vectors meet where one's own cell is among the other's.
Whoever meets is compared by cosine in double precision. A pair that meets in several tables is counted in the first of these only,
which both vectors' lists of cells tell, so no pair is ever shuffled: a cell returns counts and a spanning forest of its links. Cells with
more than `BLOCK` entries are split into blocks that are compared two by two.

Equal vectors of a label are one class with a weight. Labels, and numbers of dimensions, are never mixed. Vectors that are null, zero or hold null or
non-finite components, or whose label is null, link with nothing. Where vec_ids repeat or are null, rows are ordered by (vec_id with nulls last, label,
embedding) and are vectors of their own. Other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, Scratch, mix, seeds
from .components import components

COSINE = 0.93
TABLES, PROBES, SCALE = 8, 4, 0.5
BLOCK = 4096
CELLS = 1 + PROBES
PLACES = seeds(16, 71)

# the 240 shortest vectors of E8: two places of +-1, or all places +-1/2 with an even number of minus signs
ROOTS = np.array(
    [[(i == a) * s + (i == b) * t for i in range(8)] for a, b in combinations(range(8), 2) for s, t in product((1, -1), repeat=2)]
    + [[x / 2 for x in s] for s in product((1, -1), repeat=8) if np.prod(s) > 0]
)


def _d8(x: np.ndarray) -> np.ndarray:
    """Nearest points with integer coordinates of even sum."""
    p = np.round(x)
    off = x - p
    odd = np.flatnonzero(p.sum(axis=1) % 2)
    worst = np.abs(off[odd]).argmax(axis=1)
    p[odd, worst] += np.where(off[odd, worst] >= 0, 1, -1)
    return p


def decode(x: np.ndarray) -> np.ndarray:
    """Nearest E8 points of the rows of x."""
    a, b = _d8(x), _d8(x - 0.5) + 0.5
    nearer = ((x - b) ** 2).sum(axis=1) < ((x - a) ** 2).sum(axis=1)
    return np.where(nearer[:, None], b, a)


def cells(unit: np.ndarray, label: np.ndarray, tables: int = TABLES, probes: int = PROBES, scale: float = SCALE) -> np.ndarray:
    """Cell numbers [vector, table, own cell and probed ones]."""
    n, dim = unit.shape
    out = np.zeros((n, tables, 1 + probes), dtype=np.int64)
    for t in range(tables):
        x = unit @ np.random.default_rng((7, t, dim)).normal(size=(dim, 8)) * scale
        home = decode(x)
        near = np.argsort(-((x - home) @ ROOTS.T), axis=1, kind="stable")[:, :probes]
        points = np.concatenate([home[:, None, :], home[:, None, :] + ROOTS[near]], axis=1)
        h = np.zeros(points.shape[:2], dtype=np.uint64)
        for k in range(8):
            h += np.round(points[:, :, k] * 2).astype(np.int64).astype(np.uint64) * PLACES[k]
        h = mix(h + np.array([t], dtype=np.uint64) * PLACES[8] + mix(label.astype(np.uint64) * PLACES[9] + U64(dim))[:, None])
        out[:, t] = h.view(np.int64)
    return out


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, embedding as array<double>, label) -> valid rows (key, label, dim, vector bytes)."""
    for b in batches:
        rows = [(k, int(lab), np.array(v, dtype=np.float64)) for k, v, lab in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()) if v and lab is not None and None not in v]
        rows = [r for r in rows if np.isfinite(r[2]).all() and r[2].any()]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2].tobytes() for r in rows], pa.binary())], names=["key", "label", "vector"])


def _unit(vectors: list[bytes]) -> np.ndarray:
    x = np.frombuffer(b"".join(vectors), dtype=np.float64).reshape(len(vectors), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # squares neither overflow nor vanish
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _filed(tables: int, probes: int, scale: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            key, label, vector = np.asarray(b.column(0)), np.asarray(b.column(1)), b.column(2).to_pylist()
            sizes = np.array([len(v) for v in vector])
            codes: list = [None] * len(vector)
            for size in np.unique(sizes):
                i = np.flatnonzero(sizes == size)
                for k, c in zip(i, cells(_unit([vector[j] for j in i]), label[i], tables, probes, scale)):
                    codes[k] = c.tobytes()
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(np.asarray(b.column(3))), b.column(2), pa.array(codes, pa.binary())], names=["key", "weight", "vector", "cells"])

    return run


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, cells) -> one row for each cell a vector is filed under."""
    for b in batches:
        if b.num_rows:
            c = np.stack([np.frombuffer(x, dtype=np.int64) for x in b.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.asarray(b.column(0)), c.shape[1])), pa.array(c.ravel())], names=["key", "cell"])


def _forest(x: np.ndarray, y: np.ndarray, n: int) -> np.ndarray:
    """Least label reachable from each of n nodes over the links x - y."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, x, low)
        np.minimum.at(new, y, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _compared(cosine: float, tables: int, probes: int):
    """All entries of two blocks of one cell -> (key, links, to): weights of the links counted here, and forest edges."""

    def meet(own: np.ndarray, other: np.ndarray, t: int) -> np.ndarray:
        return (own[:, None, t, 0] == other[None, :, t, :].transpose(2, 0, 1)).any(axis=0)

    def run(table: pa.Table) -> pa.Table:
        cell, i, j = (table.column(c)[0].as_py() for c in ("cell", "i", "j"))
        key, weight, block = (np.asarray(table.column(c)) for c in ("key", "weight", "block"))
        unit = _unit(table.column("vector").to_pylist())
        codes = np.frombuffer(b"".join(table.column("cells").to_pylist()), dtype=np.int64).reshape(len(key), tables, 1 + probes)
        here = int(np.flatnonzero((codes[0] == cell).any(axis=1))[0])
        home = codes[:, here, 0] == cell
        order = np.argsort(key, kind="stable")
        left, right = order[block[order] == i], order[block[order] == j]
        links, ends = np.zeros(len(key), dtype=np.int64), []
        for s in range(0, len(left), 1024):
            a = left[s : s + 1024]
            for z in range(0, len(right), 1024):
                b = right[z : z + 1024]
                near = unit[a] @ unit[b].T >= cosine
                near &= home[a][:, None] | home[b][None, :]
                near &= key[a][:, None] < key[b][None, :] if i == j else key[a][:, None] != key[b][None, :]
                p, q = np.nonzero(near)
                p, q = a[p], b[q]
                first = np.ones(len(p), dtype=bool)  # not met in an earlier table, nor in this one's other vector's cell
                for t in range(here):
                    first &= ~((codes[p, t, :1] == codes[q, t]).any(axis=1) | (codes[q, t, :1] == codes[p, t]).any(axis=1))
                two = ~(home[p] & home[q]) & (codes[p, here, :1] == codes[q, here]).any(axis=1) & (codes[q, here, :1] == codes[p, here]).any(axis=1)
                first &= ~two | (np.minimum(codes[p, here, 0], codes[q, here, 0]) == cell)
                np.add.at(links, p[first], weight[q[first]])
                np.add.at(links, q[first], weight[p[first]])
                if len(p):
                    ends.append((p, q))
        if not ends:
            return pa.table({"key": key[:0], "links": links[:0], "to": key[:0]})
        label = order[_forest(*(np.argsort(order)[np.concatenate(x)] for x in zip(*ends)), len(key))][np.argsort(order)]
        told = (links > 0) | (label != np.arange(len(key)))
        return pa.table({"key": key[told], "links": links[told], "to": key[label[told]]})

    return run


def near_vectors(vectors: DataFrame, cosine: float = COSINE, tables: int = TABLES, probes: int = PROBES, scale: float = SCALE) -> DataFrame:
    """vec_id, n_links, component_id, kept for each row of `vectors` (vec_id, embedding, label)."""
    spark = vectors.sparkSession
    scratch = Scratch(spark)
    t = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"), F.col("label").cast("long").alias("label"))
    n, ids = t.agg(F.count(F.lit(1)), F.countDistinct("vec_id")).first()
    natural = n == ids
    if natural:
        source = t.withColumn("key", F.col("vec_id").cast("long"))
    else:
        source = scratch.keep(t.orderBy(F.col("vec_id").asc_nulls_last(), F.col("label").asc_nulls_last(), F.col("embedding").asc_nulls_last()).withColumn("key", F.monotonically_increasing_id()), "keyed")
    valid = scratch.keep(source.select("key", "embedding", "label").mapInArrow(_vectors, "key long, label long, vector binary"), "valid")
    classes = valid.groupBy("label", "vector").agg(F.min("key").alias("key"), F.count(F.lit(1)).alias("weight"))
    filed = scratch.keep(classes.select("key", "label", "vector", "weight").mapInArrow(_filed(tables, probes, scale), "key long, weight long, vector binary, cells binary"), "filed")
    entries = scratch.keep(filed.select("key", "cells").mapInArrow(_entries, "key long, cell long"), "entries")
    sizes = entries.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    dealt = entries.join(sizes, "cell").withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int")).withColumn("block", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))
    met = dealt.select("key", "cell", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")).select("key", "cell", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    told = scratch.keep(met.join(filed, "key").groupBy("cell", "i", "j").applyInArrow(_compared(cosine, tables, probes), "key long, links long, to long"), "links")
    grown = components(told.select(F.col("key").alias("a"), F.col("to").alias("b")), scratch)
    links = told.groupBy("key").agg(F.sum("links").alias("links"))
    per_class = filed.select("key", "weight").join(links, "key", "left").join(grown.withColumnRenamed("id", "key"), "key", "left")
    per_class = per_class.select(F.col("key").alias("rep"), (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "key").alias("component"))
    members = valid.join(classes.withColumnRenamed("key", "rep"), ["label", "vector"]).select("key", "rep").join(per_class, "rep").drop("rep")
    out = source.select("key", "vec_id").join(members, "key", "left").select("key", "vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component", "key").alias("component"))
    if natural:
        out = out.withColumn("component_id", F.col("component"))
    else:
        out = out.join(source.select(F.col("key").alias("component"), F.col("vec_id").alias("component_id")), "component")
    return out.select("vec_id", "n_links", "component_id", (F.col("key") == F.col("component")).alias("kept"))
