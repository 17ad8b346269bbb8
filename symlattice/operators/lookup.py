"""Finding symbols and what surrounds them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import CALL, IMPL, METHOD, REF, site_is_test


def resolve_exact(symbols: DataFrame, symbol: str) -> DataFrame:
    """(id, step) of the symbol meant: Receiver.Name, else a name that is unique, else a file; at most one row."""
    recv, dot, name = symbol.partition(".")
    a = symbols.filter((F.col("receiver") == recv) & (F.col("name") == name)).agg(F.min("id").alias("id")) if dot and recv else symbols.limit(0).agg(F.min("id").alias("id"))
    b = symbols.filter(F.col("name") == symbol).agg(F.min("id").alias("id"), F.count("*").alias("n")).filter("n = 1").drop("n")
    base = symbol.rpartition("/")[2]
    file_base = F.substring_index("file", "/", -1)
    c = symbols.filter((F.col("file") == symbol) | (F.col("file") == base) | (file_base == base)).agg(F.min("id").alias("id"))
    steps = a.withColumn("step", F.lit(1)).unionByName(b.withColumn("step", F.lit(2))).unionByName(c.withColumn("step", F.lit(3)))
    return steps.filter("id is not null").agg(F.min(F.struct("step", "id")).alias("x")).filter("x is not null").select("x.id", "x.step")


def resolve_fuzzy(symbols: DataFrame, text: str, limit: int) -> DataFrame:
    q = text.lower()
    hit = F.contains(F.lower("name"), F.lit(q)) | F.contains(F.lower("file"), F.lit(q)) | F.contains(F.lower("doc"), F.lit(q))
    return symbols.filter(hit).orderBy("id").limit(limit)


def edges_of(edges: DataFrame, node: int, by_target: DataFrame | None = None) -> DataFrame:
    """(role, edge_id, from_id, to_id, kind, site) of a node's edges: callers, refs, impls (both ways), tests and calls.

    With ``by_target``, the same edges laid out by their targets, only the node's own part of either layout is read.
    """
    near = edges.filter((F.col("from_id") == node) | (F.col("to_id") == node))
    if by_target is not None:
        near = edges.filter(F.col("from_id") == node).unionByName(by_target.filter((F.col("to_id") == node) & (F.col("from_id") != node)))
    into, kind = F.col("to_id") == node, F.col("kind")
    roles = F.array_compact(
        F.array(
            F.when(into & (kind == CALL), "callers"),
            F.when(into & (kind == REF), "refs"),
            F.when(kind == IMPL, "impls"),
            F.when(into & site_is_test(F.col("site")), "tests"),
            F.when((F.col("from_id") == node) & (kind == CALL), "calls"),
        )
    )
    return near.select(F.explode(roles).alias("role"), "edge_id", "from_id", "to_id", "kind", "site")


def tested(edges: DataFrame) -> DataFrame:
    """(id, n_edges, n_tests) for every node that something points to."""
    return edges.groupBy(F.col("to_id").alias("id")).agg(F.count("*").alias("n_edges"), F.sum(site_is_test(F.col("site")).cast("long")).alias("n_tests"))


def interface_methods(symbols: DataFrame) -> DataFrame:
    """Methods whose receiver is the name of an interface."""
    names = symbols.filter("kind = 4").select(F.col("name").alias("receiver")).distinct()
    return symbols.filter(F.col("kind") == METHOD).join(names, "receiver", "left_semi")


def display_name() -> Column:
    return F.when((F.col("kind") == METHOD) & (F.col("receiver") != ""), F.concat("receiver", F.lit("."), "name")).otherwise(F.col("name"))


def edge_labels(edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """Edges with the labels of both ends, ``?`` for unknown nodes."""
    label = F.concat(display_name(), F.lit(" ("), "file", F.lit(":"), F.col("line").cast("string"), F.lit(")"))
    named = symbols.select("id", label.alias("label"))
    a = named.select(F.col("id").alias("from_id"), F.col("label").alias("from_label"))
    b = named.select(F.col("id").alias("to_id"), F.col("label").alias("to_label"))
    return edges.join(a, "from_id", "left").join(b, "to_id", "left").fillna("?", ["from_label", "to_label"])


def source_window(files: DataFrame, places: DataFrame, before: int = 2, after: int = 8) -> DataFrame:
    """(id, num, text): the lines around each place (id, file, line) of ``files`` (file, text)."""
    near = files.join(places, "file")
    lines = near.select("id", "line", F.posexplode(F.split("text", "\n")).alias("pos", "text"))
    num = F.col("pos") + 1
    return lines.filter(num.between(F.col("line") - before, F.col("line") + after)).select("id", num.alias("num"), F.regexp_replace("text", "\\r$", "").alias("text"))
