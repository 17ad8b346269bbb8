"""A full-text index in immutable segments, so that a build writes the documents that changed and no others.

Documents belong to files, which change as a whole. A segment holds the postings and lengths of the files that one build
read, with the version in which they were written; a file's newest version is what counts, so older rows and those of
deleted files are dead where they stand. Once a level holds ``FANOUT`` segments, their living rows become one of the next
level: a row is written anew only as often as there are levels.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fts

FANOUT = 4
KEY = ["file", "ordinal"]
POSTINGS = "term string, file string, ordinal int, places array<long>, born long"
LENGTHS = "file string, ordinal int, dl int, born long"
#: (name, level) of each segment of a version, the oldest first.
Manifest = list[tuple[str, int]]


class Segments:
    """The segments under ``home``; which of them a version has is said by its manifest."""

    def __init__(self, spark: SparkSession, home: str, columns: list[str], fanout: int = FANOUT) -> None:
        self.spark, self.home, self.columns, self.fanout = spark, home, columns, fanout

    def _write(self, name: str, postings: DataFrame, lengths: DataFrame) -> None:
        postings.sort("term", *KEY).write.mode("overwrite").parquet(f"{self.home}/{name}/postings")
        lengths.write.mode("overwrite").parquet(f"{self.home}/{name}/lengths")

    def add(self, manifest: Manifest, docs: DataFrame, version: int, alive: DataFrame) -> Manifest:
        """The manifest with a segment of ``docs`` (file, ordinal and the columns), and with full levels merged; ``alive`` has (file, born)."""
        born = F.lit(version).cast("long").alias("born")
        postings, lengths = fts.build_index(docs, self.columns, KEY)
        name = f"s{version}"
        self._write(name, postings.select("term", *KEY, "places", born), lengths.select(*KEY, "dl", born))
        out, level = [*manifest, (name, 0)], 0
        while len(full := [n for n, k in out if k == level]) >= self.fanout:
            level += 1
            name = f"s{version}-{level}"
            self._write(name, *self.read([(n, level) for n in full], alive))
            out = [x for x in out if x[0] not in full] + [(name, level)]
        return out

    def read(self, manifest: Manifest, alive: DataFrame) -> tuple[DataFrame, DataFrame]:
        """The living (postings, lengths) of a manifest's segments."""
        out = []
        for what, schema in (("postings", POSTINGS), ("lengths", LENGTHS)):
            rows = self.spark.createDataFrame([], schema)
            if manifest:
                rows = self.spark.read.schema(schema).parquet(*[f"{self.home}/{n}/{what}" for n, _ in manifest])
            out.append(rows.join(alive, ["file", "born"], "left_semi").select(*[c.split()[0] for c in schema.split(", ")]))
        return out[0], out[1]
