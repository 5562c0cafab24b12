"""Binary genotype sets: .bim and .fam as text, .bed as two bits a call, variant by variant."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# The file's first three bytes, and the count of the first allele behind each two-bit code (-1: missing).
MAGIC = bytes((0x6C, 0x1B, 0x01))
CODES = np.array([2, -1, 1, 0], dtype=np.int8)
CHROMOSOMES = {23: "X", 24: "Y", 25: "XY", 26: "MT"}
FAM = "pedigree string, member string, father string, mother string, sex int, affected double"
BIM = "chromosome string, snp_name string, morgans double, position long, allele_a string, allele_b string"
CHUNK = 1 << 20  # calls that are decoded at once
RANGE = 1 << 26  # bytes that one task reads


def _numbered(df: DataFrame, name: str) -> DataFrame:
    """Rows numbered from 0 in file order; these tables have a row for each variant or sample."""
    w = Window.orderBy("_order")
    return df.withColumn("_order", F.monotonically_increasing_id()).withColumn(name, (F.row_number().over(w) - 1).cast("long")).drop("_order")


def read_tables(spark: SparkSession, base: str) -> tuple[DataFrame, DataFrame]:
    """(variants with snp_id, samples with sample_id) of `base`.bim and `base`.fam."""
    read = lambda path, schema: spark.read.schema(schema).option("sep", "\t").csv(path)
    return _numbered(read(f"{base}.bim", BIM), "snp_id"), _numbered(read(f"{base}.fam", FAM), "sample_id")


def _opened(path: str):
    """(file system, path within it) of a local path or a URI, as tasks see it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def read_genotypes(spark: SparkSession, base: str, n_samples: int, samples: list[int] | None = None, snps: tuple[int, int] | None = None) -> DataFrame:
    """sample_id, snp_id, dosage of `base`.bed. A row of the plan is a range of whole variants, and its task reads those bytes only, so a file of any size is read in parallel.

    `samples` (indices) and `snps` (a half-open range) choose what is read and decoded. The file's length must be that of whole variants."""
    width = -(-n_samples // 4)
    chosen = np.array(samples, dtype=np.int64) if samples is not None else np.arange(n_samples)
    if len(chosen) and (chosen.min() < 0 or chosen.max() >= n_samples):
        raise ValueError("sample indices must be within the file")
    system, path = _opened(f"{base}.bed")
    size = system.get_file_info(path).size
    with system.open_input_file(path) as f:
        if f.read_at(3, 0) != MAGIC:
            raise ValueError("not a variant-major .bed file")
    if not width or (size - 3) % width:
        raise ValueError(f"{size - 3} bytes are no whole number of variants of {n_samples} samples")
    lo, hi = max(0, snps[0]) if snps else 0, min(snps[1], (size - 3) // width) if snps else (size - 3) // width
    each = max(1, RANGE // width)  # variants of a range
    step = max(1, CHUNK // max(1, len(chosen)))

    def decode(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, path = _opened(f"{base}.bed")
        with system.open_input_file(path) as f:
            for t in rows:
                for first in t.id:
                    last = min(int(first) + each, hi)
                    for a in range(int(first), last, step):
                        n = min(step, last - a)
                        part = np.frombuffer(f.read_at(n * width, 3 + a * width), dtype=np.uint8).reshape(n, width)
                        calls = CODES[np.stack([(part >> s) & 3 for s in (0, 2, 4, 6)], axis=2).reshape(n, -1)[:, chosen]]
                        d = pd.array(calls.ravel().astype("int32"), dtype="Int32")
                        d[calls.ravel() < 0] = pd.NA
                        yield pd.DataFrame({"sample_id": np.tile(chosen, n), "snp_id": np.repeat(np.arange(a, a + n), len(chosen)), "dosage": d})

    ranges = max(1, -(-(hi - lo) // each))
    return spark.range(lo, max(lo, hi), each, numPartitions=ranges).mapInPandas(decode, "sample_id long, snp_id long, dosage int")


def encode(genotypes: DataFrame, n_samples: int) -> DataFrame:
    """snp_id, record: the packed bytes of each variant, ready to be written in order of snp_id."""
    cells = genotypes.select("snp_id", F.struct("sample_id", "dosage").alias("c")).groupBy("snp_id").agg(F.collect_list("c").alias("cells"))

    def pack(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        code = {2: 0, None: 1, 1: 2, 0: 3}
        for t in rows:
            out = []
            for cells in t.cells:
                x = np.full(-(-n_samples // 4) * 4, 1, dtype=np.uint8)
                x[n_samples:] = 0
                for c in cells:
                    x[c["sample_id"]] = code[None if c["dosage"] is None else int(c["dosage"])]
                q = x.reshape(-1, 4)
                out.append(bytes(q[:, 0] | q[:, 1] << 2 | q[:, 2] << 4 | q[:, 3] << 6))
            yield pd.DataFrame({"snp_id": t.snp_id, "record": out})

    return cells.mapInPandas(pack, "snp_id long, record binary")


def write(genotypes: DataFrame, variants: DataFrame, samples: DataFrame, base: str) -> None:
    """Writes `base`.bed, .bim and .fam on the driver's disk; records stream through the driver one at a time. Variants without a chromosome are dropped."""
    kept = variants.where("chromosome is not null")
    n = samples.count()
    with open(f"{base}.bed", "wb") as f:
        f.write(MAGIC)
        missing = bytes([0x55]) * (n // 4) + (bytes([0x55 & ((1 << 2 * (n % 4)) - 1)]) if n % 4 else b"")
        for r in kept.select("snp_id").join(encode(genotypes, n), "snp_id", "left").orderBy("snp_id").toLocalIterator():
            f.write(bytes(r.record) if r.record is not None else missing)
    code = F.col("chromosome").cast("string")
    for k, v in CHROMOSOMES.items():
        code = F.when(F.col("chromosome").cast("string") == str(k), v).otherwise(code)
    for ext, df, order in (("bim", kept.select(code, "snp_name", F.lit(0), "position", "allele_a", "allele_b", "snp_id"), "snp_id"), ("fam", samples.select("pedigree", "member", "father", "mother", "sex", "affected", "sample_id"), "sample_id")):
        with open(f"{base}.{ext}", "w") as f:
            for r in df.orderBy(order).toLocalIterator():
                f.write("\t".join("0" if x is None else str(x) for x in r[:-1]) + "\n")
