"""The symbol graph of a project: built, kept in versions, brought up to date and queried."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.lineage import cut
from ..functions.text import import_directory, signature_arity
from ..operators import fts, graph, lexical, lookup, segments, semantic, traverse
from ..sources import project, symbols

#: The tables of a version and their columns.
TABLES = {
    "file_graphs": symbols.SCHEMA,
    "fingerprints": "path string, fingerprint string, born long",
    "nodes": "id long, file string, line int, kind int, name string, receiver string, signature string, doc string, embeds array<string>, ordinal int",
    "edges": "edge_id long, from_id long, to_id long, kind int, site string",
    "edges_by_target": "edge_id long, from_id long, to_id long, kind int, site string",
    "vectors": "id long, embedding array<float>",
}
#: Symbols that agree in these have the same vector.
VECTOR_KEY = ["file", "kind", "name", "receiver", "signature", "doc"]
#: What a table is dealt by into buckets.
DEALT = {"edges": "from_id", "edges_by_target": "to_id"}
#: Bits of an edge's id for the reference's place in its file.
PLACES = 24
COLUMNS = ["name", "receiver", "signature", "doc", "file"]
#: (default, most) of depth and of rows for each question.
LIMITS = {"search": (None, (5, 10)), "callers": ((1, 3), (20, 50)), "callees": ((1, 3), (20, 50)), "trace": ((3, 5), (40, 100)), "impact": ((2, 5), (40, 100))}


def clamped(value: int | None, bounds: tuple[int, int]) -> int:
    """The default if missing or not positive, the most if above it."""
    return min(value, bounds[1]) if value and value > 0 else bounds[0]


def build(graphs: DataFrame, module: str) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, file, line, kind, ...) and edges (edge_id, from_id, to_id, kind, site) from parsed files."""
    raw, refs, imports = symbols.exploded(graphs)
    ids = graph.assign_ids(raw.withColumnRenamed("ordinal", "at"), ["at"])
    nodes = ids.select("id", "file", "line", "kind", "name", "receiver", "signature", "doc", "embeds", F.col("ordinal").cast("int").alias("ordinal"))
    owner = nodes.select("file", F.col("ordinal").alias("owner"), F.col("id").alias("owner_id"), (F.col("id") - F.col("ordinal")).alias("first"))
    # Edges stand in the order of their files and, in each, of its references, whichever symbol owns them.
    placed = refs.join(owner, ["file", "owner"]).withColumn("at", F.shiftleft("first", PLACES).bitwiseOR(F.col("at").cast("long"))).drop("first")
    dirs = imports.withColumn("dir", import_directory(F.col("path"), F.lit(module)))
    calls = graph.resolve_refs(placed, dirs, nodes)
    arity = signature_arity(F.col("signature"))
    where = graph.directory(F.col("file")).alias("dir")
    methods = nodes.filter(F.col("kind") == graph.METHOD).select(where, "receiver", F.col("id").alias("method_id"), "name", arity.alias("a"), F.concat_ws(":", "file", F.col("line").cast("string")).alias("site"))
    types = nodes.filter(F.col("kind").isin(graph.TYPE, graph.INTERFACE, graph.STRUCT)).select(where, F.col("name").alias("type"), "kind", "embeds", "id")
    last = types.groupBy("dir", "type").agg(F.max_by(F.struct("kind", "embeds"), "id").alias("x")).select("dir", "type", "x.kind", "x.embeds")
    embeds = last.select("dir", "type", F.explode("embeds").alias("embedded")).filter(~F.contains("embedded", F.lit(".")))
    sets = graph.method_sets(last, methods, embeds).join(methods.select("method_id", "name", "a", "site"), "method_id").select("dir", "type", "name", F.col("a.n_params").alias("n_params"), F.col("a.n_results").alias("n_results"), "method_id", "site")
    own = methods.join(last.filter(F.col("kind") == graph.INTERFACE).select("dir", F.col("type").alias("receiver")), ["dir", "receiver"]).select("dir", F.col("receiver").alias("type"), "name", F.col("a.n_params").alias("n_params"), F.col("a.n_results").alias("n_results"), "method_id", "site")
    impls = graph.implementation_edges(own, sets).select("from_id", "to_id", F.lit(graph.IMPL).alias("kind"), "site")
    impls = impls.withColumn("at", F.row_number().over(W.partitionBy("from_id").orderBy("to_id", "site")) - 1)
    # Those that implement come last.
    last = F.shiftleft("from_id", PLACES).bitwiseOR(F.col("at").cast("long")).bitwiseOR(F.lit(1 << 62))
    every = calls.withColumnRenamed("at", "edge_id").unionByName(impls.withColumn("edge_id", last).drop("at"))
    return nodes, every


class Engine:
    """Answers about the project under ``root``, from tables under ``home``; each build is a new version there.

    With an ``embedder``, versions hold a vector for each symbol, and searches rerank by them. Edges lie in ``buckets``
    by their sources and once more by their targets, so a walk in either direction opens the buckets of its frontier.
    """

    def __init__(self, spark: SparkSession, root: str, home: str, embedder: semantic.Embedder | None = None, buckets: int = 16) -> None:
        self.spark, self.root, self.home, self.embedder, self.buckets = spark, root, home, embedder, buckets
        self.segments = segments.Segments(spark, f"{home}/segments", COLUMNS)

    def _at(self, name: str = ""):
        """A path under ``home`` and its file system."""
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.home}/{name}" if name else self.home)
        return at, at.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())

    def _has(self, name: str) -> bool:
        at, fs = self._at(name)
        return fs.exists(at)

    def _versions(self) -> list[int]:
        at, fs = self._at()
        found = [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []
        return sorted(int(n[1:]) for n in found if n[:1] == "v" and n[1:].isdigit() and self._has(f"{n}/DONE"))

    def _mark(self, version: int, facts: dict) -> None:
        """The last step of a version: readers take versions with this mark only, so they never see half of one."""
        at, fs = self._at(f"v{version}/DONE")
        out = fs.create(at)
        out.write(bytearray(json.dumps(facts).encode()))
        out.close()

    def _facts(self, version: int) -> dict:
        """What the mark of a version says: its buckets and its segments."""
        at, fs = self._at(f"v{version}/DONE")
        stream = fs.open(at)
        try:
            return json.loads(bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)))
        finally:
            stream.close()

    def _table(self, version: int, name: str) -> str:
        """The catalogue's name of a table in buckets."""
        return f"symlattice_{hashlib.md5(self.home.encode()).hexdigest()[:12]}_v{version}_{name}"

    def _deal(self, edges: DataFrame, version: int, name: str) -> None:
        key, table = DEALT[name], self._table(version, name)
        self.spark.sql(f"drop table if exists {table}")
        dealt = edges.repartition(self.buckets, key).write.format("parquet").bucketBy(self.buckets, key).sortBy(key).mode("overwrite")
        dealt.option("path", f"{self.home}/v{version}/{name}").saveAsTable(table)

    @contextmanager
    def _alone(self) -> Iterator[None]:
        """One builder at a time; a lock that a lost driver left behind has to be removed by hand."""
        at, fs = self._at("LOCK")
        if not fs.createNewFile(at):
            raise BlockingIOError(f"{at.toString()} says that another build is under way")
        try:
            yield
        finally:
            fs.delete(at, False)

    def read(self, name: str, version: int | None = None) -> DataFrame:
        """A table of a version, the last one by default; empty before the first build, and vectors if it has none."""
        versions = [version] if version else self._versions()
        if not versions or name == "vectors" and not self._has(f"v{versions[-1]}/vectors"):
            return self.spark.createDataFrame([], TABLES[name])
        if name in DEALT:  # only the catalogue tells a plan about buckets
            table, key = self._table(versions[-1], name), DEALT[name]
            self.spark.sql(f"create table if not exists {table} ({TABLES[name]}) using parquet clustered by ({key}) sorted by ({key}) into {self._facts(versions[-1])['buckets']} buckets location '{self.home}/v{versions[-1]}/{name}'")
            return self.spark.table(table)
        return self.spark.read.parquet(f"{self.home}/v{versions[-1]}/{name}")

    def purge(self, keep: int = 2) -> None:
        """Delete all versions but the last ``keep``, which readers may still use, and the segments that none of these has."""
        versions = self._versions()
        kept = versions[-max(keep, 1) :]
        for v in versions[: -max(keep, 1)]:
            for name in DEALT:
                self.spark.sql(f"drop table if exists {self._table(v, name)}")
            at, fs = self._at(f"v{v}")
            fs.delete(at, True)
        used = {name for v in kept for name, _ in self._facts(v)["segments"]}
        at, fs = self._at("segments")
        for s in fs.listStatus(at) if kept and fs.exists(at) else []:
            if s.getPath().getName() not in used:
                fs.delete(s.getPath(), True)

    def postings(self) -> tuple[DataFrame, DataFrame]:
        """The living (postings, lengths) of the last version, by file and ordinal."""
        versions = self._versions()
        manifest = [tuple(x) for x in self._facts(versions[-1])["segments"]] if versions else []
        return self.segments.read(manifest, self._alive(self.read("fingerprints")))

    @staticmethod
    def _alive(marks: DataFrame) -> DataFrame:
        return marks.select(F.col("path").alias("file"), "born")

    def reindex(self) -> int:
        """Bring the index up to date and return its version; without changes it stays as it is.

        Files that changed are parsed anew, the others' parsed rows are kept; files that can't be parsed keep no
        fingerprint, so the next build tries them again. Symbols that didn't change keep their vectors. An embedder that
        fails leaves the last version as it was.
        """
        with self._alone():
            return self._reindex()

    def _reindex(self) -> int:
        files, versions = project.scan(self.spark, self.root), self._versions()
        # Taken once and before anything is parsed: a file that changes meanwhile differs from its mark at the next build.
        marks = cut(files.select("path", "fingerprint"))
        if versions:
            diff = cut(graph.snapshot_diff(self.read("fingerprints"), marks).filter("status <> 'same'"))
            if diff.isEmpty():
                return versions[-1]
            todo = files.join(diff.filter("status in ('added', 'changed')").select("path"), "path", "left_semi")
            kept = self.read("file_graphs").join(diff.select("path"), "path", "left_anti")
            graphs = kept.unionByName(symbols.file_graphs(todo))
            manifest = [tuple(x) for x in self._facts(versions[-1])["segments"]]
        else:
            graphs, manifest = symbols.file_graphs(files), []
        version = (versions[-1] if versions else 0) + 1
        before = self.read("fingerprints").select("path", "fingerprint", F.col("born").alias("was"))
        marks = marks.join(before, ["path", "fingerprint"], "left").select("path", "fingerprint", F.coalesce("was", F.lit(version).cast("long")).alias("born"))
        at = f"{self.home}/v{version}"
        graphs.write.mode("overwrite").parquet(f"{at}/file_graphs")
        graphs = self.spark.read.parquet(f"{at}/file_graphs")
        marks.join(graphs.select("path"), "path", "left_semi").write.mode("overwrite").parquet(f"{at}/fingerprints")
        nodes, edges = build(graphs, project.module_name(self.spark, self.root))
        nodes.sort("id").write.mode("overwrite").parquet(f"{at}/nodes")
        nodes = self.spark.read.parquet(f"{at}/nodes")
        alive = self._alive(self.spark.read.parquet(f"{at}/fingerprints"))
        manifest = self.segments.add(manifest, nodes.join(alive.filter(F.col("born") == version), "file", "left_semi"), version, alive)
        if self.embedder:
            known = self.read("nodes").join(self.read("vectors"), "id").select(*VECTOR_KEY, "embedding")
            found = graph.reuse_vectors(nodes, known, VECTOR_KEY).select("id", "embedding", semantic.node_text().alias("text"))
            todo = semantic.embedded(found.filter("embedding is null"), "id", "text", self.embedder)
            found.filter("embedding is not null").select("id", "embedding").unionByName(todo).sort("id").write.mode("overwrite").parquet(f"{at}/vectors")
        self._deal(edges, version, "edges")
        self._deal(self.spark.table(self._table(version, "edges")), version, "edges_by_target")
        self._mark(version, {"buckets": self.buckets, "segments": manifest})
        return version

    def search(self, query: str, limit: int | None = None, vectors: DataFrame | None = None, vector: list[float] | None = None) -> DataFrame:
        """Full-text hits from the kept postings, reranked by vectors if given or kept; lexical hits where full text finds none."""
        k, nodes = clamped(limit, LIMITS["search"][1]), self.read("nodes")
        found = fts.search_index(*self.postings(), segments.KEY, query, 8 * k)
        if vectors is None and self.embedder:
            vectors, vector = self.read("vectors"), self.embedder.embed([query])[0]
        if found.isEmpty():
            return lexical.explore(nodes, query, k)
        hits = nodes.join(F.broadcast(found), segments.KEY)  # at most 8 times the limit
        if vectors is not None and vector:
            return semantic.rerank(hits.join(vectors, "id", "left"), query, vector, k)
        return hits.orderBy(F.desc("score"), "id").limit(k)

    def _id(self, symbol: str) -> int:
        found = lookup.resolve_exact(self.read("nodes"), symbol).first()
        if not found:
            near = [r["name"] for r in lookup.resolve_fuzzy(self.read("nodes"), symbol, 5).select("name").collect()]
            raise LookupError(f"no symbol {symbol!r}; near: {', '.join(near) or 'none'}")
        return found["id"]

    def _walk(self, what: str, symbol: str, depth: int | None, limit: int | None, direction: str) -> DataFrame:
        deep, rows = LIMITS[what]
        found = traverse.discover(self.read("edges"), self._id(symbol), clamped(depth, deep), direction, by_target=self.read("edges_by_target"))
        return lookup.edge_labels(traverse.capped(found, clamped(limit, rows)), self.read("nodes")).orderBy("level", "path")

    def callers(self, symbol: str, depth: int | None = None, limit: int | None = None) -> DataFrame:
        return self._walk("callers", symbol, depth, limit, traverse.IN)

    def callees(self, symbol: str, depth: int | None = None, limit: int | None = None) -> DataFrame:
        return self._walk("callees", symbol, depth, limit, traverse.OUT)

    def trace(self, symbol: str, depth: int | None = None, limit: int | None = None) -> DataFrame:
        return self._walk("trace", symbol, depth, limit, traverse.BOTH)

    def impact(self, symbol: str, depth: int | None = None, limit: int | None = None) -> DataFrame:
        return self._walk("impact", symbol, depth, limit, traverse.OUT)

    def node(self, symbol: str) -> dict[str, DataFrame]:
        """A symbol's row, its edges by role, its source lines and what it reaches in two steps."""
        at = self._id(symbol)
        nodes, edges, back = self.read("nodes"), self.read("edges"), self.read("edges_by_target")
        own = nodes.filter(F.col("id") == at)
        file = own.first()["file"]
        one = self.spark.read.text(re.sub(r"([\[\]{}*?\\])", r"\\\1", f"{self.root}/{file}"), wholetext=True)
        files = one.select(F.lit(file).alias("file"), F.col("value").alias("text"))
        return {"node": own, "edges": lookup.edges_of(edges, at, back), "source": lookup.source_window(files, own.select("id", "file", "line")).orderBy("num"), "blast": traverse.discover(edges, at, 2, by_target=back)}
