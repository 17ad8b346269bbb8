"""Mixing sources to target weights along a curriculum, with DataFrame functions only.

Targets: sources in code-point order (null last) weigh 5, 2, 1, repeating, and share ``share`` times all words; no
target exceeds ``most`` times its source, and the excess is reshared by weight. That fixed point has a closed form: a
target is the lesser of its cap and ``level * weight``, where ``level`` is the largest of the levels that result if the
first k sources, by cap over weight, are full.

Within a source, documents stand in the order of a hash of their ids (rows of one id by size and a hash of the row), and a source takes whole rounds of them, then
documents up to the middle nearest the rest. Places in that order are running sums of words: hash buckets are summed
first, so a source that holds a third of all rows is spread over many windows.

Curriculum: a source's weight varies over the training run as 1 + slope * (2t - 1), which integrates to t + slope *
(t^2 - t). A document whose words start at share u of its source's words is trained at the time where that integral
reaches u; sorting by that time by range gives the training order.

Null texts have size 0; empty documents are never taken; repeated rows count as documents of their own.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, row_hash, stage

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2
#: How a source's weight changes over the run, by its place in WEIGHTS.
SLOPES = (0.5, 0.0, -0.5)
ROWS_PER_BUCKET = 20_000


def sized(docs: DataFrame) -> DataFrame:
    return docs.withColumn("size", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long"))


def _by_place(values: tuple, place: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), F.pmod(place, F.lit(len(values))) + 1)


def source_targets(sizes: DataFrame) -> DataFrame:
    """(source, source_size, weight, slope, target) from (source, size) rows: one row a source."""
    sums = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    placed = sums.withColumn("place", place).withColumn("weight", _by_place(WEIGHTS, F.col("place"))).withColumn("slope", _by_place(SLOPES, F.col("place")))
    capped = placed.withColumn("cap", F.col("source_size") * float(MOST))
    by = W.orderBy(F.col("cap") / F.col("weight"), "place")
    rest = F.sum("weight").over(by.rowsBetween(0, W.unboundedFollowing))
    full = F.coalesce(F.sum("cap").over(by.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    everything = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    levels = capped.withColumn("level", (F.sum("source_size").over(everything) * F.lit(SHARE) - full) / rest)
    level = F.max("level").over(everything)
    return levels.select("source", "source_size", "weight", "slope", F.round(F.least("cap", level * F.col("weight")), 6).alias("target"))


def mix(docs: DataFrame) -> DataFrame:
    """``docs``, which have doc_id, source and size, with source_size, target, taken and the position of the first copy.

    Rows of one doc_id stand in the order of their size and, if there is one, of the column ``_tie``. ``rounds`` is how often the mix takes a document, and ``place`` how many words of its source stand before it.
    """
    n = docs.count()
    digits = max(1, math.ceil(math.log(max(1, n / ROWS_PER_BUCKET), 16)))
    hashed = docs.withColumn("_h", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))).withColumn("_b", F.substring("_h", 1, digits))
    # Sources as a pair that is never null, so that the join and the window deal the rows alike: rows move once.
    hashed = hashed.withColumn("_s", F.coalesce("source", F.lit(""))).withColumn("_none", F.col("source").isNull())
    sums = stage(hashed.groupBy("source", "_s", "_none", "_b").agg(F.sum("size").alias("size")))
    before = F.sum("size").over(W.partitionBy("_s", "_none").orderBy("_b")) - F.col("size")
    targets = source_targets(sums).withColumn("_s", F.coalesce("source", F.lit(""))).withColumn("_none", F.col("source").isNull()).drop("source")
    starts = sums.select("_s", "_none", "_b", before.alias("_before")).join(targets, ["_s", "_none"]).select("_s", "_none", "_b", "_before", "source_size", "slope", "target")
    inner = F.sum("size").over(W.partitionBy("_s", "_none", "_b").orderBy("_h", "doc_id", "size", *["_tie"][: "_tie" in docs.columns]).rowsBetween(W.unboundedPreceding, 0)) - F.col("size")
    placed = hashed.join(starts.hint("merge"), ["_s", "_none", "_b"]).withColumn("_inner", inner)
    size = F.greatest("source_size", F.lit(1))
    whole = placed.withColumn("place", F.col("_before") + F.col("_inner")).withColumn("_full", F.floor(F.col("target") / size))
    left = F.col("target") - F.col("_full") * F.col("source_size")
    more = F.when((F.col("size") > 0) & (2 * F.col("place") + F.col("size") <= 2 * left), 1).otherwise(0)
    rounds = whole.withColumn("rounds", F.when(F.col("size") > 0, F.col("_full") + more).otherwise(0).cast("long")).withColumn("taken", F.col("rounds") * F.col("size"))
    out = rounds.withColumn("position", F.when(F.col("rounds") > 0, position(F.lit(0))))
    return out.drop("_h", "_b", "_s", "_none", "_before", "_inner", "_full")


def position(copy: Column) -> Column:
    """When in the run, from 0 to 1, the copy-th round reaches a document: the inverse of its source's demand."""
    u = F.least(F.lit(1.0), (F.col("place") + copy * F.col("source_size")) / F.greatest("target", F.lit(1.0)))
    s = F.col("slope")
    t = F.when(s == 0, u).otherwise((F.sqrt((1 - s) * (1 - s) + 4 * s * u) - (1 - s)) / (2 * s))
    return F.round(t, 9)


def mix_report(docs: DataFrame) -> DataFrame:
    narrow = stage(sized(docs).select("doc_id", "source", "size"))
    return mix(narrow).select("doc_id", "size", "source_size", "target", "taken", "position").orderBy("position", "doc_id")


def training_order(docs: DataFrame) -> DataFrame:
    """The rows that the mix takes, as often as it takes them, in the order of training (a sort by range)."""
    # The row travels as one column, so no name of its own can clash with a step's.
    rows = sized(docs.select("doc_id", "source", "text", F.struct(*[docs[c] for c in docs.columns]).alias("_row"), row_hash(docs).alias("_tie"))).drop("text")
    mixed = mix(rows).filter("rounds > 0")
    copies = mixed.withColumn("_copy", F.explode(F.sequence(F.lit(0), F.col("rounds") - 1)))
    return copies.withColumn("_at", position(F.col("_copy"))).orderBy("_at", "doc_id", "size", "_tie").select("_row.*")


ORACLE_SQL = """
with d as (select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::bigint as size from documents),
s as (select source, sum(size)::bigint as source_size, row_number() over (order by source nulls last) - 1 as place from d group by source),
w as (select *, [5, 2, 1][(place % 3 + 1)::int] as weight, [0.5::double, 0.0::double, -0.5::double][(place % 3 + 1)::int] as slope, source_size * 2.0::double as cap from s),
l as (select *, ((sum(source_size) over ())::double * 1.5::double
        - coalesce(sum(cap) over (order by cap / weight, place rows between unbounded preceding and 1 preceding), 0.0::double))
        / (sum(weight) over (order by cap / weight, place rows between current row and unbounded following))::double as level from w),
t as (select source, source_size, slope, round(least(cap, max(level) over () * weight), 6) as target from l),
p as (select d.*, t.source_size, t.slope, t.target,
        (sum(size) over (partition by d.source order by md5(coalesce(doc_id::varchar, '')), doc_id, size rows unbounded preceding) - size)::bigint as place
      from d join t on d.source is not distinct from t.source),
r as (select *, floor(target / greatest(source_size, 1)) as f from p),
k as (select *, case when size = 0 then 0 else f + (2 * place + size <= 2 * (target - f * source_size))::int end as rounds,
        least(1.0::double, place::double / greatest(target, 1.0::double)) as u from r)
select doc_id, size, source_size, target, (rounds * size)::bigint as taken,
       case when rounds > 0 then round(case when slope = 0 then u else (sqrt((1 - slope) * (1 - slope) + 4 * slope * u) - (1 - slope)) / (2 * slope) end, 9) + 0.0 end as position
from k
"""
