"""Linkage, kinship and principal components."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def ld_pairs(gt: DataFrame, variants: DataFrame, window: int) -> DataFrame:
    """snp1, snp2, n, r2 of neighbouring variants."""
    return ld_correlations(gt, variants, window).select("snp1", "snp2", "n", (F.col("r") * F.col("r")).alias("r2"))


def ld_correlations(gt: DataFrame, variants: DataFrame, window: int) -> DataFrame:
    """snp1, snp2, n, r of variants on a chromosome within `window` bases; samples are matched by key, pairs only within neighbouring bins."""
    v = variants.select("snp_id", "chromosome", "position").withColumn("bin", F.floor(F.col("position") / window))
    a = v.select(F.col("snp_id").alias("snp1"), "chromosome", F.col("position").alias("p1"), F.explode(F.array(F.col("bin"), F.col("bin") + 1, F.col("bin") - 1)).alias("bin"))
    near = a.join(v.select(F.col("snp_id").alias("snp2"), "chromosome", F.col("position").alias("p2"), "bin"), ["chromosome", "bin"])
    near = near.where((F.col("snp1") < F.col("snp2")) & (F.abs(F.col("p1") - F.col("p2")) <= window)).select("snp1", "snp2")
    g = gt.where("dosage is not null")
    left = near.join(g.select(F.col("snp_id").alias("snp1"), "sample_id", F.col("dosage").cast("double").alias("x")), "snp1")
    both = left.join(g.select(F.col("snp_id").alias("snp2"), "sample_id", F.col("dosage").cast("double").alias("y")), ["snp2", "sample_id"])
    return both.groupBy("snp1", "snp2").agg(F.count(F.lit(1)).alias("n"), F.corr("x", "y").alias("r"))


def _greedy(ranked: list, neighbours: dict) -> list:
    kept: list = []
    gone: set = set()
    for s in ranked:
        if s not in gone:
            kept.append(s)
            gone |= neighbours.get(s, set())
    return kept


def clump(ld: DataFrame, order: DataFrame, r2: float) -> DataFrame:
    """chromosome, snp_id kept greedily in the order of `rank`: a kept variant removes its neighbours with r2 above the limit.

    The choice depends on order, so a chromosome is one sequential task; what it needs is its variants and linked pairs, not genotypes.
    With ranks by p this is clumping, with ranks by position pruning."""
    links = ld.where(F.col("r2") > r2).select("snp1", "snp2")
    pairs = links.unionByName(links.select(F.col("snp2").alias("snp1"), F.col("snp1").alias("snp2"))).groupBy("snp1").agg(F.collect_set("snp2").alias("near"))
    rows = order.join(pairs, order["snp_id"] == pairs["snp1"], "left").select("chromosome", "snp_id", "rank", "near")

    def run(t: pd.DataFrame) -> pd.DataFrame:
        t = t.sort_values(["rank", "snp_id"])
        near = {s: set(n) for s, n in zip(t.snp_id, t.near) if n is not None}
        return pd.DataFrame({"chromosome": t.chromosome.iloc[0], "snp_id": _greedy(list(t.snp_id), near)})

    return rows.groupBy("chromosome").applyInPandas(run, "chromosome long, snp_id long")


BLOCK_CELLS = 2**22  # samples by variants of a block of samples
BLOCK = "block long, ids array<long>, snps array<long>, share array<double>, kind string, cells binary"
PAIRS = 2**17  # pairs of samples that leave a task at a time


def _blocks(gt: DataFrame) -> tuple[DataFrame, int]:
    """Blocks of samples, and their number: the samples' ids, the variants called in any of them with the column `share` of gt, and the dosages packed by bytes where these are small and whole."""
    g = gt.where("dosage is not null and sample_id is not null and snp_id is not null")
    n = g.agg(F.approx_count_distinct("sample_id").alias("samples"), F.approx_count_distinct("snp_id").alias("variants")).first()
    blocks = max(1, -(-n.samples // max(64, min(1024, BLOCK_CELLS // max(1, n.variants)))))

    def pack(t: pa.Table) -> pa.Table:
        block, sample, snp, dosage, share = (c.combine_chunks().to_numpy(zero_copy_only=False) for c in t.columns)
        ids, row = np.unique(sample, return_inverse=True)
        snps, first, column = np.unique(snp, return_index=True, return_inverse=True)
        small = bool((np.abs(dosage) <= 100).all() and (dosage == np.rint(dosage)).all())
        cells = np.full((len(ids), len(snps)), -128, np.int8) if small else np.full((len(ids), len(snps)), np.nan)
        cells[row, column] = dosage
        return pa.table({"block": [int(block[0])], "ids": [ids], "snps": [snps], "share": [share[first]], "kind": [cells.dtype.str], "cells": [cells.tobytes()]}, pa.schema([
            ("block", pa.int64()), ("ids", pa.list_(pa.int64())), ("snps", pa.list_(pa.int64())), ("share", pa.list_(pa.float64())), ("kind", pa.string()), ("cells", pa.binary())]))

    share = F.col("share").cast("double") if "share" in gt.columns else F.lit(0.0)
    rows = g.select(F.pmod(F.xxhash64(F.col("sample_id").cast("long")), F.lit(blocks)).alias("block"), F.col("sample_id").cast("long"), F.col("snp_id").cast("long"), F.col("dosage").cast("double"), share.alias("share"))
    return rows.groupBy("block").applyInArrow(pack, BLOCK), blocks


def _unpacked(ids, snps, share, kind: str, cells: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    x = np.frombuffer(cells, kind).reshape(len(ids), len(snps))
    return ids, snps, share, np.where(x == -128, np.nan, x) if x.dtype == np.int8 else x


class _Pairs:
    """Two blocks over the variants that both have, and sums over the variants that both samples of a pair have called."""

    def __init__(self, a: tuple, b: tuple):
        self.ids, self.others = a[0], b[0]
        _, i, j = np.intersect1d(a[1], b[1], assume_unique=True, return_indices=True)
        self.share, self.x, self.y = a[2][i], a[3][:, i], b[3][:, j]
        self.called, self.other_called = (~np.isnan(self.x)).astype(np.float64), (~np.isnan(self.y)).astype(np.float64)
        self.levels = np.unique(self.y[~np.isnan(self.y)])
        self.step = max(1, PAIRS // max(1, len(self.others)))

    def weighted(self, rows: slice, weight: np.ndarray | None = None) -> np.ndarray:
        c = self.called[rows]
        return (c if weight is None else c * weight) @ self.other_called.T

    def differing(self, rows: slice, f: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
        """Sums of f of the difference of dosages, a product of matrices for each dosage of the second block."""
        x, out = self.x[rows], np.zeros((len(self.x[rows]), len(self.others)))
        if len(self.levels) > 16:  # not whole dosages: variant by variant
            for a, b in zip(x.T, self.y.T):
                out += np.nan_to_num(f(np.abs(a[:, None] - b)), copy=False)
            return out
        for v in self.levels:
            out += np.nan_to_num(f(np.abs(x - v)), copy=False) @ (self.y == v).astype(np.float64).T
        return out

    def slices(self) -> Iterator[slice]:
        return (slice(i, i + self.step) for i in range(0, len(self.ids), self.step))


def _all_pairs(blocks: DataFrame, n: int, measure: Callable[[_Pairs, slice], tuple[np.ndarray, list[np.ndarray]]], schema: str) -> DataFrame:
    """s1, s2 and what `measure` gives (which pairs to keep, and columns) of all pairs of samples. A task holds two blocks, whatever the number of samples, and a block goes to as many tasks as there are blocks."""
    fields = [(c.split()[0], pa.int64() if c.endswith(" long") else pa.float64()) for c in ["s1 long", "s2 long", *schema.split(", ")]]

    def compare(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [({t.column(0)[k].as_py(), t.column(1)[k].as_py()}, t.column(2)[k].as_py(), _block_of(t.slice(k, 1), 3)) for t in parts for k in range(t.num_rows)]
        if len(rows) < len(rows[0][0]):  # the other block has no samples
            return
        rows.sort(key=lambda r: r[1])
        p = _Pairs(rows[0][2], rows[-1][2])
        for part in p.slices():
            s = p.ids[part][:, None]
            keep, columns = measure(p, part)
            if len(rows) == 1:
                keep &= s < p.others
            i, j = np.nonzero(keep)
            a, b = p.ids[part][i], p.others[j]
            data = [np.minimum(a, b), np.maximum(a, b), *(c[i, j] for c in columns)]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, (_, t) in zip(data, fields)], [f[0] for f in fields])

    other = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))).alias("other")
    sent = blocks.select("*", other).select(F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), *blocks.columns)
    return sent.repartition(min(2048, 2 * n * (n + 1)), "i", "j").groupBy("i", "j").applyInArrow(compare, "s1 long, s2 long, " + schema)


def kinship(gt: DataFrame, least: float = 0.0) -> DataFrame:
    """s1, s2, n, ibs: mean identity by state over variants that both samples have called, at least `least`. Products of blocks of samples; the rows are as many as pairs."""

    def measure(p: _Pairs, rows: slice) -> tuple[np.ndarray, list[np.ndarray]]:
        n = p.weighted(rows)
        ibs = 1 - p.differing(rows, lambda d: d) / (2 * np.maximum(n, 1))
        return (n > 0) & (ibs >= least), [n.astype(np.int64), ibs]

    return _all_pairs(*_blocks(gt), measure, "n long, ibs double")


def gram(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """i, j, dot: inner products over dimensions of a column of equal-length arrays (features by features), one pass, combined on the map side."""
    v = F.col(vector)
    x = vectors.where(v.isNotNull()).select(F.posexplode(F.transform(v, lambda a: a.cast("double"))).alias("i", "x"), vector)
    y = x.select("i", "x", F.posexplode(vector).alias("j", "y")).where("i <= j")
    return y.groupBy("i", "j").agg(F.sum(F.col("x") * F.col("y")).alias("dot"))


def principal_components(gram_rows: list, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues and vectors of a small symmetric matrix given as (i, j, value) rows."""
    n = 1 + max(r[1] for r in gram_rows)
    m = np.zeros((n, n))
    for i, j, v in gram_rows:
        m[i, j] = m[j, i] = v
    w, v = np.linalg.eigh(m)
    order = np.argsort(-w)[:k]
    return w[order], v[:, order]


def tracy_widom(eigenvalues: DataFrame) -> DataFrame:
    """idx, stat of eigenvalues (idx from the largest, value), corrected for the effective number of markers by suffix sums.

    There are as many rows as there are components that were kept, so one ordered window holds them all."""
    w = Window.orderBy("idx").rowsBetween(0, Window.unboundedFollowing)
    t = eigenvalues.withColumns({"l1": F.sum("value").over(w), "l2": F.sum(F.col("value") * F.col("value")).over(w), "n": F.count(F.lit(1)).over(w).cast("double")})
    t = t.withColumn("s2", F.col("n") * F.col("n") * F.col("l2") / (F.col("l1") * F.col("l1"))).where("s2 > n").withColumn("v", F.col("n") * (F.col("n") + 2) / (F.col("s2") - F.col("n"))).where("v > 1")
    root, n = F.sqrt(F.col("v") - 1), F.sqrt("n")
    mu = (root + n) * (root + n) / F.col("v")
    sigma = (root + n) / F.col("v") * F.pow(1 / root + 1 / n, F.lit(1.0 / 3))
    return t.select("idx", ((F.col("n") * F.col("value") / F.col("l1") - mu) / sigma).alias("stat"))


def kinship_moments(gt: DataFrame, variants_summary: DataFrame) -> DataFrame:
    """s1, s2, kinship by the method of moments over variants that both samples have called.

    Expected shares of alleles identical by state given identity by descent (0, 1 or 2) come from allele frequencies; the observed counts of IBS 0, 1 and 2
    are solved for the shares of IBD, which are bounded to 0..1, and kinship is share1 / 4 + share2 / 2."""
    return _all_pairs(*_blocks(_with_frequency(gt, variants_summary)), lambda p, rows: (lambda k: (~np.isnan(k), [k]))(_moments_kinship(p, rows)), "kinship double")


def _with_frequency(gt: DataFrame, variants_summary: DataFrame) -> DataFrame:
    return gt.join(F.broadcast(variants_summary.where(F.col("maf") > 0).select("snp_id", F.col("maf").alias("share"))), "snp_id")  # one number a variant


def _moments_kinship(pairs: _Pairs, rows: slice) -> np.ndarray:
    """Kinship of some samples of the first block with all of the second, none where they share no called variant."""
    p, q = pairs.share, 1 - pairs.share
    e00, e10, e11 = (pairs.weighted(rows, e) for e in (2 * p * p * q * q, 4 * p * p * p * q + 4 * p * q * q * q, 2 * p * p * q + 2 * p * q * q))
    n0, n1 = (pairs.differing(rows, lambda d, k=k: (d == k).astype(np.float64)) for k in (2, 1))
    with np.errstate(divide="ignore", invalid="ignore"):
        z0 = np.clip(n0 / e00, 0, 1)
        z1 = np.maximum(0, np.minimum(1 - z0, (n1 - z0 * e10) / e11))
    return np.where(pairs.weighted(rows) > 0, z1 / 4 + (1 - z0 - z1) / 2, np.nan)


def related_samples(kinship: DataFrame, least: float) -> DataFrame:
    """sample_id of both members of every pair whose kinship reaches `least`."""
    near = kinship.where(F.col("kinship") >= least)
    return near.select(F.col("s1").alias("sample_id")).union(near.select("s2")).distinct()


def relatives(gt: DataFrame, variants_summary: DataFrame, least: float) -> DataFrame:
    """related_samples(kinship_moments(...), least) without the table of pairs. Samples that have a relative within their block are settled there; the others only are compared with all blocks."""
    blocks, n = _blocks(_with_frequency(gt, variants_summary))

    def own(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in parts:
            for k in range(t.num_rows):
                row = t.slice(k, 1)
                a = _block_of(row, 1)
                p, near = _Pairs(a, a), np.zeros(len(a[0]), bool)
                for rows in p.slices():
                    kin = _moments_kinship(p, rows)
                    near[rows] = ((kin >= least) & (p.ids[rows][:, None] != p.others)).any(axis=1)
                yield pa.RecordBatch.from_arrays([*row.columns, pa.array([near], pa.list_(pa.bool_()))], [*row.schema.names, "near"])

    def others(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in parts:
            for k in range(t.num_rows):
                row = t.slice(k, 1).select(t.schema.names[2:])
                (ids, snps, share, x), b = _block_of(row, 0), _block_of(row, 6)
                rest = ~row.column(5).flatten().to_numpy(zero_copy_only=False)
                p = _Pairs((ids[rest], snps, share, x[rest]), b)
                near = [p.ids[rows][(_moments_kinship(p, rows) >= least).any(axis=1)] for rows in p.slices()]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(near), pa.int64())], ["sample_id"])

    settled = blocks.mapInArrow(own, BLOCK + ", near array<boolean>")
    done = settled.select(F.explode(F.arrays_zip("ids", "near")).alias("x")).where("x.near").select(F.col("x.ids").alias("sample_id"))
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))).alias("other")
    left = settled.where(F.exists("near", lambda x: ~x)).select("block", "ids", "snps", "share", "kind", "cells", "near", every).where("other <> block")
    columns = ["ids", "snps", "share", "kind", "cells"]
    pairs = left.join(blocks.select(F.col("block").alias("other"), *[F.col(c).alias(f"{c}2") for c in columns]), "other").select("block", "other", *columns, "near", *[f"{c}2" for c in columns])
    pairs = pairs.groupBy("block", "other").applyInArrow(others, "sample_id long")
    return done.unionByName(pairs).distinct()


def _block_of(row: pa.RecordBatch, at: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    return _unpacked(*(row.column(at + c).flatten().to_numpy() for c in range(3)), row.column(at + 3)[0].as_py(), row.column(at + 4)[0].as_py())


def standardised(gt: DataFrame) -> DataFrame:
    """sample_id, snp_id, z of called cells; variants that do not vary are left out. A missing cell is absent, which is the variant's mean."""
    s = gt.where("dosage is not null").groupBy("snp_id").agg(F.avg("dosage").alias("m"), F.stddev_samp("dosage").alias("sd")).where("sd > 0")
    return gt.where("dosage is not null").join(s, "snp_id").select("sample_id", "snp_id", ((F.col("dosage") - F.col("m")) / F.col("sd")).alias("z"))


def _row_blocks(z: DataFrame) -> DataFrame:
    return z.groupBy("sample_id").agg(F.collect_list(F.struct("snp_id", "z")).alias("cells"))  # as long as there are variants


def variant_gram(gt: DataFrame) -> DataFrame:
    """i, j, dot: products of standardised variants over samples. Each task multiplies its samples as a matrix, so one table of variants squared leaves it, however many samples it read."""
    import numpy as np
    import pandas as pd

    def products(batches):
        total, places = np.zeros((0, 0)), {}
        for t in batches:
            ids = sorted({c["snp_id"] for cells in t.cells for c in cells} - places.keys())
            for i in ids:
                places[i] = len(places)
            if len(places) > len(total):
                more = np.zeros((len(places), len(places)))
                more[: len(total), : len(total)] = total
                total = more
            x = np.zeros((len(t), len(places)))
            for r, cells in enumerate(t.cells):
                for c in cells:
                    x[r, places[c["snp_id"]]] = c["z"]
            total += x.T @ x
        ids = np.array(sorted(places), dtype=np.int64)
        at = np.array([places[i] for i in ids], dtype=np.int64)
        a, b = np.triu_indices(len(ids))
        yield pd.DataFrame({"i": ids[a], "j": ids[b], "dot": total[at[a], at[b]]} if len(ids) else {"i": [], "j": [], "dot": []})

    return _row_blocks(standardised(gt)).mapInPandas(products, "i long, j long, dot double").groupBy("i", "j").agg(F.sum("dot").alias("dot"))


def sample_components(gt: DataFrame, k: int) -> tuple[DataFrame, list[tuple[float, float, float]]]:
    """(sample_id, pc1 ... pck), and eigenvalue, Tracy-Widom statistic and p of every component.

    The matrix of variants by variants is solved on the driver, so prune the variants first: a few thousand make a table of some 100 MB. Samples are never gathered:
    each is projected on the loadings, which every task holds."""
    from ..functions import stats

    rows = variant_gram(gt).collect()
    ids = sorted({r.i for r in rows})
    place = {i: n for n, i in enumerate(ids)}
    import numpy as np

    m = np.zeros((len(ids), len(ids)))
    for r in rows:
        m[place[r.i], place[r.j]] = m[place[r.j], place[r.i]] = r.dot
    values, vectors = np.linalg.eigh(m)
    order = np.argsort(-values)
    values, vectors = np.maximum(values[order], 1e-12), vectors[:, order]
    tests = [(float(v), float(t), stats.tracy_widom_upper(float(t))) for v, t in zip(values, stats.tracy_widom(values))]
    loadings = gt.sparkSession.createDataFrame([(i, [float(x) for x in vectors[place[i], :k]]) for i in ids], "snp_id long, v array<double>")
    cells = standardised(gt).join(F.broadcast(loadings), "snp_id")  # k numbers a pruned variant
    return cells.groupBy("sample_id").agg(*[F.sum(F.col("z") * F.col("v")[i]).alias(f"pc{i + 1}") for i in range(k)]), tests


def components_needed(tests: list[tuple[float, float, float]], p: float = 0.05, most: int | None = None) -> int:
    """How many components are significant one after another from the first, at least one; `most` bounds them."""
    n = 0
    while n < len(tests) and tests[n][2] <= p:
        n += 1
    return min(max(1, n), most or len(tests))
