"""What the operators of this subpackage share: tables, staged results, words and Arrow blocks."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.shipping import ship

#: Words are maximal runs of anything but these six ASCII white-space characters.
WORD = "[^\\x20\\x09-\\x0D]+"
#: Rows in an Arrow batch: small, as a row may hold a very long text.
BATCH_ROWS = 128
#: Bytes after which a batch ends before it has so many rows.
BATCH_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a local one of our own only on a local master without one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and the executors share")
        root = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root


def stage(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Write ``df`` to the shared folder, in a folder for each value of ``by``, and read it again: lineage ends there, and a lost executor loses nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/staged-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").partitionBy(*by or []).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_path = path
    return out


def unstage(df: DataFrame) -> None:
    """Delete a staged table that nothing will read again."""
    path = getattr(df, "_staged_path", None)
    if path:
        delete_folder(df.sparkSession, path)


def delete_folder(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


def arrow_rows(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Ready the session for Python steps over long texts."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


@contextmanager
def arrow_batches(spark: SparkSession, rows: int) -> Iterator[None]:
    """Ready the session for eager Python steps over short rows, and leave its settings as they were."""
    ship(spark)
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def blocks(batches: Iterable[pa.RecordBatch], target_bytes: int = 16 << 20) -> Iterator[pa.Table]:
    """Join small Arrow batches into blocks of about ``target_bytes``, so that vectorised steps pay off."""
    held: list[pa.RecordBatch] = []
    size = 0
    for b in batches:
        if b.num_rows:
            held.append(b)
            size += b.nbytes
        if size >= target_bytes:
            yield pa.Table.from_batches(held).combine_chunks()
            held, size = [], 0
            pa.default_memory_pool().release_unused()  # workers live on into later stages
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def row_hash(df: DataFrame) -> F.Column:
    """A hash of all columns of a row, but for maps and variants, which have no order: tells unlike rows of one id apart alike in every run."""
    return F.xxhash64(*[df[f.name] for f in df.schema if not re.search("map<|variant", f.dataType.simpleString())])


def text_or_empty() -> F.Column:
    return F.coalesce(F.col("text"), F.lit(""))


def bucket_ranks(df: DataFrame, keys: list[str], order: list[str], rows_per_bucket: int = 50_000) -> DataFrame:
    """Add ``rank0``, the row's place from 0 among the rows with its ``keys``, in the order of the hash of ``order``.

    A key may hold a third of all rows, so no window spans a key: rows fall into buckets by the leading bits of a
    hash, buckets are counted, and a window over the counts gives each bucket's first place. ``order`` has to tell
    rows apart; rows that it can't tell apart get different places in no fixed order.
    """
    from pyspark.sql import Window as W

    n = df.count()
    buckets = max(8, -(-n // rows_per_bucket))
    h = df.withColumn("_h", F.xxhash64(*order)).withColumn("_b", F.pmod(F.shiftright("_h", 20), F.lit(buckets)))
    counts = h.groupBy(*keys, "_b").agg(F.count("*").alias("_n"))
    firsts = counts.withColumn("_first", F.sum("_n").over(W.partitionBy(*keys).orderBy("_b")) - F.col("_n")).drop("_n")
    firsts = firsts.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_b").alias("_kb"), "_first")
    inner = F.row_number().over(W.partitionBy(*keys, "_b").orderBy("_h", *order)) - 1
    on = F.col("_b") == F.col("_kb")
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    return h.withColumn("_i", inner).join(firsts, on).withColumn("rank0", F.col("_first") + F.col("_i")).drop("_h", "_b", "_kb", "_first", "_i", *[f"_k_{k}" for k in keys])


def row_ids(start: int, n: int):
    """Ids for rows ``start`` to ``start + n`` of this task's partition; a task that runs anew gives the same ones."""
    import numpy as np
    from pyspark import TaskContext

    return (TaskContext.get().partitionId() << 40) + start + np.arange(n, dtype=np.int64)


def frequent(counts: DataFrame, n: str, most: int) -> DataFrame:
    """The rows of ``counts`` with the highest ``n``, at most ``most`` of them: a set small enough to broadcast.

    A histogram over eighths of powers of two gives the threshold, so no sort is needed and ties stay together.
    """
    level = F.floor(F.log2(F.col(n).cast("double")) * 8)
    sizes = sorted(((r[0], r[1]) for r in counts.groupBy(level.alias("l")).agg(F.count("*")).collect()), reverse=True)
    total, least = 0, None
    for lev, k in sizes:
        if total + k > most:
            break
        total, least = total + k, lev
    return counts.filter(level >= least) if least is not None else counts.limit(0)
