"""Building the symbol graph: ids, symbol tables, resolved references, implementation edges and increments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.lineage import cut
from ..functions.text import directory

CALL, REF, IMPL = 1, 2, 3
FUNC, METHOD, TYPE, INTERFACE, STRUCT, VAR, CONST = 1, 2, 3, 4, 5, 6, 7
HOPS = 8
#: Rows of either side of a name's pairs in one cell.
CELL = 4096


def assign_ids(symbols: DataFrame, order: list[str]) -> DataFrame:
    """``symbols`` (file and more) with dense ids: files in the order of their paths, symbols by ``order`` within them.

    Files are counted first and dealt in ranges of their paths. Running sums are taken within each range, and over a row
    for each range, so no task sees all files.
    """
    files = symbols.groupBy("file").agg(F.count("*").alias("n"))
    placed = cut(files.repartitionByRange("file").withColumn("d", F.spark_partition_id()))
    dirs = placed.groupBy("d").agg(F.sum("n").alias("dn"))
    dirs = dirs.withColumn("dbase", F.sum("dn").over(W.orderBy("d")) - F.col("dn")).drop("dn")
    based = placed.join(dirs, "d").withColumn("base", F.col("dbase") + F.sum("n").over(W.partitionBy("d").orderBy("file")) - F.col("n"))
    within = F.row_number().over(W.partitionBy("file").orderBy(*order)) - 1
    return symbols.withColumn("ordinal", within).join(based.select("file", "base"), "file").withColumn("id", F.col("base") + F.col("ordinal")).drop("base")


def last_declared(symbols: DataFrame) -> DataFrame:
    """(dir, name, id): the last symbol but methods of each name in a directory."""
    return symbols.filter(F.col("kind") != METHOD).groupBy(directory(F.col("file")).alias("dir"), "name").agg(F.max("id").alias("id"))


def unique_methods(symbols: DataFrame) -> DataFrame:
    """(dir, name, id) of methods whose name occurs once in its directory."""
    return symbols.filter(F.col("kind") == METHOD).groupBy(directory(F.col("file")).alias("dir"), "name").agg(F.count("*").alias("n"), F.min("id").alias("id")).filter("n = 1").drop("n")


def resolve_refs(refs: DataFrame, imports: DataFrame, symbols: DataFrame) -> DataFrame:
    """Edges (from_id, to_id, kind, site) for ``refs`` (owner_id, file, kind, pkg, name, line).

    A qualified name is looked up in its import's directory only, others in their own; a declared symbol comes before a
    method that is the only one of its name. ``imports`` has (file, alias, dir). What resolves to nothing or to its owner
    is dropped; edges are not made distinct. An ``at``, the reference's place in its file, stays with its edge.
    """
    own = directory(F.col("file"))
    named = refs.join(imports.select("file", F.col("alias").alias("pkg"), F.col("dir").alias("target")), ["file", "pkg"], "left")
    placed = named.withColumn("dir", F.when(F.coalesce("pkg", F.lit("")) == "", own).otherwise(F.col("target"))).filter("dir is not null")
    top = last_declared(symbols).withColumnRenamed("id", "top_id")
    alone = unique_methods(symbols).withColumnRenamed("id", "method_id")
    found = placed.join(top, ["dir", "name"], "left").join(alone, ["dir", "name"], "left").withColumn("to_id", F.coalesce("top_id", "method_id"))
    return found.filter("to_id is not null and to_id <> owner_id").select(F.col("owner_id").alias("from_id"), "to_id", "kind", F.concat_ws(":", "file", F.col("line").cast("string")).alias("site"), *[c for c in ("at",) if c in refs.columns])


def closure(pairs: DataFrame, hops: int = HOPS) -> DataFrame:
    """(a, b, hops): what each ``a`` reaches over (a, b) pairs in at most ``hops`` steps, by the fewest."""
    reached = pairs.select("a", "b").distinct().withColumn("hops", F.lit(1))
    front = reached
    for k in range(2, hops + 1):
        step = front.select("a", F.col("b").alias("via")).join(pairs.select(F.col("a").alias("via"), "b"), "via").select("a", "b").distinct()
        front = cut(step.join(reached, ["a", "b"], "left_anti").withColumn("hops", F.lit(k)))
        if front.isEmpty():
            break
        reached = reached.unionByName(front)
    return reached


def method_sets(types: DataFrame, methods: DataFrame, embeds: DataFrame) -> DataFrame:
    """(dir, type, method_id): a type's own methods and those of what it embeds, up to ``HOPS`` steps away."""
    key = lambda d, t: F.struct(d.alias("dir"), t.alias("type"))
    inherits = closure(embeds.select(key(F.col("dir"), F.col("type")).alias("a"), key(F.col("dir"), F.col("embedded")).alias("b")))
    whole = types.select("dir", "type", F.col("type").alias("of")).unionByName(inherits.select("a.dir", "a.type", F.col("b.type").alias("of")))
    return whole.join(methods.select("dir", F.col("receiver").alias("of"), "method_id"), ["dir", "of"]).select("dir", "type", "method_id").distinct()


def implementation_edges(interface_methods: DataFrame, set_methods: DataFrame) -> DataFrame:
    """(from_id, to_id, site) for methods (dir, type, name, n_params, n_results, method_id, site) of other types; the least site.

    Rows are made distinct before they meet, so the pairs, whose number grows with the square of a name's, aren't shuffled:
    an interface method brings its least site and the least one of another type, a method its type if it has only one.
    Only ids that have several names can meet twice; their pairs are aggregated. What a name has in excess of ``CELL``
    rows on either side is dealt into cells, so that no task has all pairs of a frequent one.
    """
    key = ["dir", "name", "n_params", "n_results"]
    several = lambda m: F.count("*").over(W.partitionBy(m)) > 1
    own = interface_methods.filter("type is not null").withColumnRenamed("method_id", "from_id").repartition("from_id")
    best = own.groupBy(*key, "from_id", "type").agg(F.min("site").alias("site")).groupBy(*key, "from_id").agg(F.sort_array(F.collect_list(F.struct(F.isnull("site").alias("none"), "site", "type"))).alias("x"))
    left = best.select(*key, "from_id", F.col("x")[0]["type"].alias("itype"), F.col("x")[0]["site"].alias("site"), F.get("x", F.lit(1))["site"].alias("next"), (F.size("x") > 1).alias("has_next"), several("from_id").alias("many_a"))
    ends = set_methods.filter("type is not null").withColumnRenamed("method_id", "to_id").repartition("to_id").groupBy(*key, "to_id").agg(F.min("type").alias("type"), F.max("type").alias("hi"))
    right = ends.select(*key, "to_id", F.when(F.col("type") == F.col("hi"), F.col("type")).alias("only"), several("to_id").alias("many_b"))

    sizes = left.select(*key, F.lit(1).alias("m"), F.lit(0).alias("n")).unionByName(right.select(*key, F.lit(0).alias("m"), F.lit(1).alias("n"))).groupBy(*key).agg(F.sum("m").alias("m"), F.sum("n").alias("n"))
    large = sizes.filter(f"m > 0 and n > 0 and (m > {CELL} or n > {CELL})").select(*key, F.ceil(F.col("m") / CELL).alias("rows"), F.ceil(F.col("n") / CELL).alias("cols"))

    # As many tasks as there are partitions, not as few as the rows' bytes would do with.
    tasks = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def celled(side: DataFrame, mine: str, other: str, m: str) -> DataFrame:
        one = F.lit(1).cast("long")
        dealt = side.join(large, key, "left").withColumn(mine[:-1], F.pmod(F.xxhash64(m), F.coalesce(mine, one)))
        return dealt.withColumn(other[:-1], F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce(other, one) - 1))).drop("rows", "cols").repartition(tasks, *key, "row", "col")

    other = ~F.col("only").eqNullSafe(F.col("itype"))
    both = celled(left, "rows", "cols", "from_id").join(celled(right, "cols", "rows", "to_id"), [*key, "row", "col"]).filter(other | F.col("has_next"))
    pairs = both.select("from_id", "to_id", F.when(other, F.col("site")).otherwise(F.col("next")).alias("site"), "many_a", "many_b")
    again = pairs.filter("many_a and many_b").groupBy("from_id", "to_id").agg(F.min("site").alias("site"))
    return pairs.filter("not (many_a and many_b)").select("from_id", "to_id", "site").unionByName(again)


def snapshot_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, status): added, changed, deleted or same, from (path, fingerprint) tables."""
    both = old.withColumnRenamed("fingerprint", "was").join(new, "path", "full_outer")
    status = F.when(F.col("was").isNull(), "added").when(F.col("fingerprint").isNull(), "deleted").when(F.col("was") != F.col("fingerprint"), "changed").otherwise("same")
    return both.select("path", status.alias("status"))


def reuse_vectors(symbols: DataFrame, vectors: DataFrame, key: list[str]) -> DataFrame:
    """``symbols`` with ``embedding`` where a vector has the same key; the rest have null and have to be embedded."""
    return symbols.join(vectors.dropDuplicates(key), key, "left")


def site_is_test(site: Column) -> Column:
    return F.endswith(F.regexp_extract(site, "^(.*):[^:]*$", 1), F.lit("_test.go"))
