"""Queries over source files and paths that Spark writes from the tables: what is extracted, and what rules leave."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import symbols
from ..sources.ignore import rule_rows, unignored
from .carriers import table

_GO = """package p

type {0}{1} struct {{
	*{2}
	n int
}}

// {3}
func (x *{0}{1}) {2}(
	a, b int,
) error {{
	defer func() {{ {0}(a) }}()
	return lib.{2}("}}", 'x')
}}
"""
_TS = """// {3}
export class {0}{1} {{
  {2}(a: string, b = `x ${{f_of(`{{ ${{g_of(a)}}`)}}`): void {{
    const y{1} = () => {{ {0}(a) }}
  }}
}}
"""
_PY = """# {3}
class {0}{1}:
    def {2}(self, a):
        return {0}(a)
"""


def _written(template: str) -> Column:
    """The template with a part's two words, its key and its type in their places."""
    words = F.split("p_name", " ")
    holes = {"0": F.concat(F.lit("w_"), words[0]), "1": F.col("p_partkey").cast("string"), "2": F.concat(F.lit("v_"), words[1]), "3": F.col("p_type")}
    parts, rest = [], template.replace("{{", "\0").replace("}}", "\1")
    while rest:
        before, _, rest = rest.partition("{")
        parts.append(F.lit(before.replace("\0", "{").replace("\1", "}")))
        if rest:
            parts.append(holes[rest[0]])
            rest = rest[2:]
    return F.concat(*parts)


def _files(spark: SparkSession, d: str) -> DataFrame:
    """A source file for each part: Go, TypeScript or Python by its key.

    A part is a few bytes, its file a scan of tokens, so parts are dealt evenly to as many tasks as there are partitions:
    by bytes, one task would read and parse a million of them.
    """
    p, k = table(spark, d, "part").select("p_partkey", "p_name", "p_brand", "p_type"), F.col("p_partkey") % 3
    p = p.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    text = F.when(k == 0, _written(_GO)).when(k == 1, _written(_TS)).otherwise(_written(_PY))
    end = F.when(k == 0, ".go").when(k == 1, ".ts").otherwise(".py")
    return p.select(F.concat("p_brand", F.lit("/"), F.col("p_partkey").cast("string"), end).alias("path"), text.cast("binary").alias("content"))


def extracted_symbols(spark: SparkSession, d: str) -> DataFrame:
    nodes, _, _ = symbols.exploded(symbols.file_graphs(_files(spark, d)))
    return nodes.select("file", "ordinal", "line", "kind", "name", "receiver", "signature", "doc", F.array_join("embeds", ",").alias("embeds"))


def extracted_calls(spark: SparkSession, d: str) -> DataFrame:
    """Calls by their owners; one of a function without a name is called by the last name in it."""
    _, refs, _ = symbols.exploded(symbols.file_graphs(_files(spark, d)))
    return refs.filter(F.col("kind") == symbols.CALL).select("file", "owner", "name", "pkg", "line")


def ignored_paths(spark: SparkSession, d: str) -> DataFrame:
    """Pages' addresses as paths below their hosts: each host leaves out names with a leading 1 in its longest first folder, but for those that end in 5; no host has ``*.tmp``."""
    path = F.regexp_replace(F.regexp_replace("url", "^[a-z]+://", ""), "[?#].*$", "")
    paths = table(spark, d, "pages").select("page_id", path.alias("path")).filter("path rlike '^[^/]+(/[^/]+)+$'")
    first = paths.select(F.substring_index("path", "/", 1).alias("scope"), F.split("path", "/")[1].alias("f")).groupBy("scope").agg(F.max(F.struct(F.length("f"), "f")).alias("x"))
    own = first.select("scope", F.posexplode(F.array(F.concat(F.lit("/"), F.col("x.f"), F.lit("/1*")), F.lit("!*5"))).alias("at", "line"))
    rules = rule_rows(own.unionByName(spark.createDataFrame([("", 0, "*.tmp")], "scope string, at int, line string")))
    return unignored(paths, rules).select("page_id", "path")


_NAMED = "p as (select p_partkey as k, p_partkey % 3 as m, 'w_' || split_part(p_name, ' ', 1) as a, 'v_' || split_part(p_name, ' ', 2) as b, p_type as t, p_brand || '/' || p_partkey || ['.go', '.ts', '.py'][(p_partkey % 3 + 1)::int] as file from part)"
SQL: dict[str, str] = {
    "extracted_symbols": f"""with {_NAMED}
        select file, 0 as ordinal, [3, 2, 2][(m + 1)::int]::int as line, 5 as kind, a || k as name, '' as receiver, '' as signature, case when m = 0 then '' else t end as doc, case when m = 0 then b else '' end as embeds from p
        union all select file, 1, [9, 3, 3][(m + 1)::int]::int, 2, b, a || k, ['( a, b int, ) error', '(a: string, b = `x ${{f_of(`{{ ${{g_of(a)}}`)}}`): void', '(self, a)'][(m + 1)::int], case when m = 0 then t else '' end, '' from p
        union all select file, 2, 4, 6, 'y' || k, '', '', '', '' from p where m = 1""",
    "extracted_calls": f"""with {_NAMED}
        select file, 1 as owner, a as name, '' as pkg, [12, 0, 4][(m + 1)::int]::int as line from p where m <> 1
        union all select file, 1, 'a', '', 12 from p where m = 0 union all select file, 1, b, '', 13 from p where m = 0
        union all select file, 2, a, '', 4 from p where m = 1 union all select file, 1, 'f_of', '', 3 from p where m = 1 union all select file, 1, 'g_of', '', 3 from p where m = 1""",
    "ignored_paths": """with p as (select page_id, regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', '') as path from pages),
        s as (select *, string_split(path, '/') as x from p where regexp_matches(path, '^[^/]+(/[^/]+)+$')),
        f as (select x[1] as host, arg_max(x[2], (length(x[2]), x[2])) as f from s group by x[1])
        select page_id, path from s join f on x[1] = host where not ends_with(path, '.tmp') and not (len(x) > 2 and x[2] = f and starts_with(x[3], '1') and not ends_with(x[3], '5'))""",
}
QUERIES = {k: globals()[k] for k in SQL}
