"""Shared plumbing: table access, materialisation in the shared folder, hashing and batch helpers."""

from __future__ import annotations

import tempfile
import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
ROWS_AT_ONCE = 128


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or a temporary one where it is unset and all tasks run in this process (tests); elsewhere an unset one is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        got = spark.sparkContext._jsc.sc().getCheckpointDir()
        base = got.get() if got.isDefined() else None
    if not base:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="lociq-")
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


class Scratch:
    """Written tables that cut lineage; drop() removes those no longer needed."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.base = spark, f"{shared_dir(spark)}/{uuid.uuid4().hex}"
        self.n = 0
        # rows that go to Python at once: texts are long, and a batch must fit beside others in a worker's memory
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ROWS_AT_ONCE))

    def keep(self, df: DataFrame, name: str = "t") -> DataFrame:
        self.n += 1
        path = f"{self.base}/{self.n}_{name}"
        df.write.option("compression", "zstd").parquet(path)
        trim_driver(self.spark)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._lociq_path = path
        return out

    def drop(self, *dfs: DataFrame) -> None:
        jvm = self.spark._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for df in dfs:
            path = jvm.org.apache.hadoop.fs.Path(df._lociq_path)
            path.getFileSystem(conf).delete(path, True)


def fold(doc_id: Column) -> Column:
    """crc32 of the id's decimal text, modulo 3; 1 marks a held-out row."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 3


def fold_of(doc_id: int) -> int:
    return zlib.crc32(str(doc_id).encode()) % 3


def slices(batches: Iterable[pa.RecordBatch], text: str = "text", most: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Cuts Arrow batches by rows so that a slice holds about `most` bytes of text (one longer text alone)."""
    for b in batches:
        if not b.num_rows:
            continue
        col = b.column(b.schema.get_field_index(text))
        size = np.asarray(pc.fill_null(pc.binary_length(col), 0), dtype=np.int64)
        part = (np.cumsum(size) - size) // most
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1), b.num_rows]
        for a, z in zip(cuts, cuts[1:]):
            yield b.slice(a, z - a)


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply)."""
    h = h ^ (h >> U64(30))
    h = h * U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(27)
    h *= U64(0x94D049BB133111EB)
    h ^= h >> U64(31)
    return h


def seeds(n: int, seed: int) -> np.ndarray:
    """n odd 64-bit constants that depend on `seed` only."""
    return np.random.default_rng(seed).integers(0, 2**63, n, dtype=np.uint64) * U64(2) + U64(1)


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All code points of the texts, one zero after each, and the offset at which each text starts (one more at the end)."""
    lengths = np.fromiter((len(t) for t in texts), dtype=np.int64, count=len(texts))
    starts = np.concatenate([[0], np.cumsum(lengths + 1)])
    raw = "\0".join(texts).encode("utf-32-le", "surrogatepass") + b"\0\0\0\0" * bool(texts)
    return np.frombuffer(raw, dtype=np.uint32), starts


def keyed(docs: DataFrame, *keep: str) -> DataFrame:
    """key long, doc_id, text and the columns in `keep` (renamed keep_0, ...): the key orders documents. It is the doc_id where that is unique and never null; otherwise rows are numbered in order of
    (doc_id with nulls last, text, other columns do not count), so that repeated rows are documents of their own."""
    t = docs.select("doc_id", "text", *(docs[c].alias(f"keep_{i}") for i, c in enumerate(keep)))
    n, ids = t.agg(F.count(F.lit(1)), F.countDistinct("doc_id")).first()
    if n == ids:
        return t.select(F.col("doc_id").cast("long").alias("key"), "*")
    return Scratch(docs.sparkSession).keep(t.orderBy(F.col("doc_id").asc_nulls_last(), F.col("text").asc_nulls_last()).select(F.monotonically_increasing_id().alias("key"), "*"), "keyed")


def text_bytes(docs: DataFrame) -> int:
    return docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0


def buckets(spark: SparkSession, amount: int, each: int) -> int:
    """Parts into which packed rows are dealt: one for each `each` of `amount`, the shuffle's partitions at least."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-amount // each))


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of plans that nothing refers to any more. The scheduler holds on to the plan it ran last, so a trivial one runs first."""
    import gc

    spark.range(1).write.format("noop").mode("overwrite").save()
    gc.collect()
    spark._jvm.System.gc()
    trim_driver(spark)


def surrogate(source: DataFrame) -> bool:
    """Whether keyed() had to number the rows."""
    return hasattr(source, "_lociq_path")


def trim() -> None:
    """Gives a worker's freed memory back to the system: Arrow's pool and the C heap keep it otherwise."""
    import ctypes

    pa.default_memory_pool().release_unused()
    give_back = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if give_back:
        give_back(0)


def trim_driver(spark: SparkSession) -> None:
    """trim() of the driver and of its JVM, whose C heap keeps what compilers and codecs have freed: hundreds of MB after some dozens of queries. A JVM that lacks the command is left as it is."""
    from py4j.protocol import Py4JJavaError

    trim()
    jvm = spark._jvm
    of = jvm.java.lang.Class.forName

    def array(kind, *items):
        out = spark.sparkContext._gateway.new_array(kind, len(items))
        for i, x in enumerate(items):
            out[i] = x
        return out

    # by reflection, as py4j finds no methods of the server's class, which its module hides
    invoke = of("javax.management.MBeanServer").getMethod("invoke", array(jvm.java.lang.Class, *map(of, ("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;"))))
    server, command = jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand")
    try:
        invoke.invoke(server, array(jvm.java.lang.Object, command, "systemTrimNativeHeap", None, None))
    except Py4JJavaError:
        pass
