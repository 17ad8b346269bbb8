"""Symbols, edges and files read from the driver's tables, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: More edges than any order has.
PER_ORDER = 1000


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def symbols(spark: SparkSession, d: str) -> DataFrame:
    """Parts as symbols: the first word of a name is the receiver, the second the symbol's name."""
    p = table(spark, d, "part")
    return p.select(
        F.col("p_partkey").alias("id"), F.element_at(F.split("p_name", " "), 2).alias("name"), F.element_at(F.split("p_name", " "), 1).alias("receiver"),
        F.col("p_type").alias("file"), F.col("p_brand").alias("doc"), (F.col("p_size") % 7 + 1).alias("kind"), F.col("p_size").alias("line"),
        F.concat(F.lit("("), F.replace("p_brand", F.lit("#"), F.lit(", ")), F.lit(") "), F.col("p_type")).alias("signature"),
    )


SYMBOLS = """symbols as (select p_partkey as id, split_part(p_name, ' ', 2) as name, split_part(p_name, ' ', 1) as receiver, p_type as file, p_brand as doc,
    p_size % 7 + 1 as kind, p_size as line, '(' || replace(p_brand, '#', ', ') || ') ' || p_type as signature from part)"""


def edges(spark: SparkSession, d: str) -> DataFrame:
    """Parts that follow each other in an order; the order and the place in it give the edge's id, so no global sort is needed."""
    x = table(spark, d, "lineitem")
    by = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate", "l_discount", "l_tax", "l_returnflag", "l_linestatus")
    row = x.select("l_orderkey", "l_linenumber", "l_suppkey", "l_returnflag", "l_linestatus", F.col("l_partkey").alias("from_id"), F.lead("l_partkey").over(by).alias("to_id"), F.row_number().over(by).alias("rn"))
    kind = F.when(F.col("l_returnflag") == "N", 1).when(F.col("l_returnflag") == "A", 2).otherwise(3)
    site = F.concat(F.lit("pkg"), (F.col("l_suppkey") % 10).cast("string"), F.when(F.col("l_linestatus") == "F", "/a_test.go:").otherwise("/a.go:"), F.col("l_linenumber").cast("string"))
    return row.filter("to_id is not null and to_id <> from_id").select((F.col("l_orderkey") * PER_ORDER + F.col("rn")).alias("edge_id"), "from_id", "to_id", kind.alias("kind"), site.alias("site"))


EDGES = """seq as (select l_orderkey, l_linenumber, l_suppkey, l_returnflag, l_linestatus, l_partkey as from_id,
    lead(l_partkey) over w as to_id, row_number() over w as rn from lineitem
    window w as (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate, l_discount, l_tax, l_returnflag, l_linestatus)),
edges as (select l_orderkey * 1000 + rn as edge_id, from_id, to_id, case l_returnflag when 'N' then 1 when 'A' then 2 else 3 end as kind,
    'pkg' || (l_suppkey % 10) || case when l_linestatus = 'F' then '/a_test.go:' else '/a.go:' end || l_linenumber as site
    from seq where to_id is not null and to_id <> from_id)"""
