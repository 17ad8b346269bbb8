"""Lines that documents share, found with levelled sorted runs of line hashes.

Documents come in batches of ascending ids. A batch's lines, one row for each distinct hash, meet every run of hashes
seen before: what no run holds becomes a run of its own, what one holds is repeated. Runs are tables dealt and sorted by
hash, so that a meeting merges them where they lie and moves the batch alone; once a level holds ``FANOUT`` runs, they
become one run of the next level, so a hash is written anew only as often as there are levels.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import delete_folder, frequent, shared_dir, stage, text_or_empty, unstage

#: Code points that a stripped line needs to count.
LEAST_CHARS = 10
#: Batches that a whole table comes in, and runs that a level holds before they are merged.
BATCHES, FANOUT = 6, 3
#: Repeated lines that meet their places by a broadcast instead of a shuffle: 24 bytes each.
HOT = 1 << 17
STRIPPED = " \t\n\x0b\f\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(STRIPPED)), UPPER, LOWER)


def line_hashes(docs: DataFrame) -> DataFrame:
    """(doc_id, th, pos, h, g) for each line that is long enough: th tells texts of one id apart, h and g name the key in 128 bits."""
    text = docs.select("doc_id", text_or_empty().alias("text")).withColumn("th", F.xxhash64("text"))
    lines = text.select("doc_id", "th", F.posexplode(F.split("text", "\n")).alias("pos", "line")).select("doc_id", "th", "pos", line_key(F.col("line")).alias("key"))
    return lines.filter(F.length("key") >= LEAST_CHARS).select("doc_id", "th", "pos", F.xxhash64("key").alias("h"), F.xxhash64(F.lit(11), "key").alias("g"))


def in_batches(lines: DataFrame, docs: DataFrame, batches: int) -> DataFrame:
    """Add ``batch``: ids are cut at their quantiles, so that a smaller batch has smaller ids; null ids come last."""
    cuts = docs.agg(F.percentile_approx("doc_id", [i / batches for i in range(1, batches)], 10_000)).first()[0] if batches > 1 else None
    after = [F.when(F.col("doc_id") > c, 1).otherwise(0) for c in cuts or []]
    return lines.withColumn("batch", F.when(F.col("doc_id").isNull(), len(after)).otherwise(sum(after, F.lit(0))))


@contextmanager
def sorted_scans(spark: SparkSession) -> Iterator[None]:
    """Plans read runs bucket by bucket, also where they only unite them, and know that a bucket of one file is sorted."""
    held = {"spark.sql.legacy.bucketedTableScan.outputOrdering": "true", "spark.sql.sources.bucketing.autoBucketedScan.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    for k, v in held.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


class LineRuns:
    """The runs of one store. ``admit`` takes batches in the order in which their documents have a claim to lines."""

    def __init__(self, spark: SparkSession, fanout: int = FANOUT) -> None:
        self.spark, self.fanout = spark, fanout
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.root = f"{shared_dir(spark)}/runs-{uuid.uuid4().hex}"
        self.levels: list[list[DataFrame]] = []
        self.tables: list[str] = []

    def _write(self, rows: DataFrame) -> DataFrame:
        """A table dealt into buckets by hash, one sorted file each."""
        name = f"line_run_{uuid.uuid4().hex}"
        rows = rows.repartition(self.buckets, "h", "g").sortWithinPartitions("h", "g")
        rows.write.format("parquet").option("compression", "zstd").option("path", f"{self.root}/{name}").bucketBy(self.buckets, "h", "g").sortBy("h", "g").saveAsTable(name)
        self.tables.append(name)
        return self.spark.table(name)

    def runs(self) -> list[DataFrame]:
        """(h, g) of every run, the oldest level first."""
        return [r.filter("not old").select("h", "g") for level in reversed(self.levels) for r in level]

    def admit(self, lines: DataFrame) -> DataFrame:
        """Add a batch; returns (h, g, first, lost, old, n) for its distinct hashes, which is also its run.

        ``old``: an earlier batch has the line, so no document of this one keeps it. ``lost``: some document loses it;
        else ``first``, the smallest id (null: only documents without an id), keeps it.
        """
        met = lines.groupBy("h", "g").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("_last"), F.bool_or(F.col("doc_id").isNull()).alias("_null"), F.count("*").alias("n"))
        old = F.lit(False)
        for i, run in enumerate(self.runs()):  # marks instead of an anti-join's rows, as both halves are used
            met = met.join(run.withColumn(f"_{i}", F.lit(True)).hint("merge"), ["h", "g"], "left")
            old = old | F.coalesce(F.col(f"_{i}"), F.lit(False))
        shared = F.col("first").isNotNull() & (F.col("_null") | (F.col("_last") > F.col("first")))
        with sorted_scans(self.spark):
            kept = self._write(met.withColumn("old", old).select("h", "g", "first", (F.col("old") | shared).alias("lost"), "old", "n"))
            self._place(kept, 0)
        return kept

    def _place(self, run: DataFrame, level: int) -> None:
        if level == len(self.levels):
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) == self.fanout:
            runs, self.levels[level] = [r.filter("not old").select("h", "g", "old") for r in self.levels[level]], []
            merged = runs[0]
            for r in runs[1:]:
                merged = merged.unionByName(r)
            self._place(self._write(merged), level + 1)

    def drop(self) -> None:
        for name in self.tables:
            self.spark.sql(f"drop table if exists {name}")
        delete_folder(self.spark, self.root)


def repeated_lines(docs: DataFrame, batches: int = BATCHES) -> DataFrame:
    """(doc_id, th, drop): the places of the lines that each text loses, for texts that lose any.

    A line that a third of all documents hold is one row of its batch after partial aggregation, and the lines found most
    often meet their places by a broadcast of at most ``HOT`` rows; what is left has no line with a large share of rows.
    """
    spark = docs.sparkSession
    lines = stage(in_batches(line_hashes(docs), docs, batches), by=["batch"])
    store, decided = LineRuns(spark), None
    for b in range(batches):
        got = store.admit(lines.filter(F.col("batch") == b)).filter("lost").select(F.lit(b).alias("batch"), "h", "g", "first", "old", "n")
        decided = got if decided is None else decided.unionByName(got)
    hot = F.broadcast(frequent(decided, "n", HOT).drop("n").withColumn("hot", F.lit(True)))
    keys = ["batch", "h", "g"]
    met = lines.join(hot, keys, "left")
    rest = decided.join(hot.select(*keys), keys, "left_anti").drop("n")
    loses = F.col("old") | ~F.col("doc_id").eqNullSafe(F.col("first"))
    lost = met.filter(F.col("hot") & loses).select("doc_id", "th", "pos").unionByName(met.filter("hot is null").drop("first", "old").join(rest, keys).filter(loses).select("doc_id", "th", "pos"))
    out = stage(lost.groupBy("doc_id", "th").agg(F.collect_set("pos").alias("drop")))
    store.drop()
    unstage(lines)
    return out


def dedup_lines(docs: DataFrame, batches: int = BATCHES) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept) for each row: its text without the lines that a smaller doc_id holds.

    Only lines whose stripped, lower-cased form has ``LEAST_CHARS`` code points are dropped; those of one document, even
    equal ones, stay together. Ids are numbers; rows of one id are one document; null ids are one document after all
    others. A null or empty text is one empty line. Other columns of ``docs`` are not used.
    """
    text = docs.select("doc_id", text_or_empty().alias("text")).withColumn("th", F.xxhash64("text"))
    drop = repeated_lines(docs, batches).select(F.col("doc_id").alias("_id"), F.col("th").alias("_th"), "drop")
    met = text.join(drop, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("th") == F.col("_th")), "left")

    def without(lines: Column) -> Column:
        return F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("drop")), lambda i: F.get(lines, i)), "\n")

    lines = F.split("text", "\n")
    kept = F.when(F.col("drop").isNull(), F.col("text")).otherwise(F.get(F.transform(F.array(lines), without), F.lit(0)))  # the outer step splits once
    return met.select("doc_id", F.size(lines).cast("long").alias("n_lines"), F.coalesce(F.size("drop"), F.lit(0)).cast("long").alias("n_dropped"), kept.alias("kept"))


def line_report(docs: DataFrame) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept_sha256) for each row of ``docs``."""
    return dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


ORACLE_SQL = f"""
WITH rows_ AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
one AS (SELECT r, doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM rows_),
keyed AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{UPPER}', '{LOWER}') AS key FROM one),
firsts AS (SELECT key, min(doc_id) AS first FROM keyed WHERE length(key) >= {LEAST_CHARS} GROUP BY key),
judged AS (SELECT k.r, k.pos, k.line, coalesce(k.doc_id IS DISTINCT FROM f.first, false) AND f.key IS NOT NULL AS gone FROM keyed k LEFT JOIN firsts f ON k.key = f.key AND length(k.key) >= {LEAST_CHARS}),
kept AS (SELECT r, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '') AS text FROM judged GROUP BY r)
SELECT doc_id, n_lines, n_dropped, sha256(text) AS kept_sha256 FROM kept JOIN rows_ USING (r)
"""
