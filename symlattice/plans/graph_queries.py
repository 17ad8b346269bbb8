"""Queries over the part-sequence graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import directory, import_directory, signature_arity
from ..operators import graph as G
from ..operators import lookup as L
from ..operators import traverse as T
from .carriers import EDGES, SYMBOLS, edges, symbols, table

START, DEPTH, WINDOW_NODE = 1, 3, 1


def assign_ids(spark: SparkSession, d: str) -> DataFrame:
    s = symbols(spark, d).withColumnRenamed("id", "part")
    return G.assign_ids(s, ["line", "part"]).select("file", "part", "ordinal", "id")


def dir_of(spark: SparkSession, d: str) -> DataFrame:
    path = F.regexp_replace("url", "^[a-z]+://", "")
    return table(spark, d, "pages").select("page_id", directory(path).alias("dir"))


def by_name_index(spark: SparkSession, d: str) -> DataFrame:
    return symbols(spark, d).groupBy("name").agg(F.array_join(F.sort_array(F.collect_list("id")), ",").alias("ids"), F.count("*").alias("n"))


def by_file_index(spark: SparkSession, d: str) -> DataFrame:
    return symbols(spark, d).groupBy("file").agg(F.array_join(F.sort_array(F.collect_list("id")), ",").alias("ids"), F.count("*").alias("n"))


def index_stats(spark: SparkSession, d: str) -> DataFrame:
    s, e = symbols(spark, d), edges(spark, d)
    one = s.agg(F.count("*").alias("n_symbols"), F.count_distinct("file").alias("n_files"))
    two = e.agg(F.count("*").alias("n_edges"), F.sum((F.col("kind") == 1).cast("long")).alias("n_calls"), F.sum((F.col("kind") == 2).cast("long")).alias("n_refs"), F.sum((F.col("kind") == 3).cast("long")).alias("n_impls"))
    return one.crossJoin(two)


def symbol_table_last_wins(spark: SparkSession, d: str) -> DataFrame:
    return G.last_declared(_placed(spark, d))


def unique_method(spark: SparkSession, d: str) -> DataFrame:
    return G.unique_methods(_placed(spark, d))


def _placed(spark: SparkSession, d: str) -> DataFrame:
    """Symbols in files of directories: the brand is the directory."""
    return symbols(spark, d).withColumn("file", F.concat(F.col("doc"), F.lit("/"), F.col("file")))


def _refs(spark: SparkSession, d: str) -> DataFrame:
    """Each edge as a reference from its source's file to its target's name, qualified by its target's directory for refs."""
    s = _placed(spark, d)
    a = s.select(F.col("id").alias("from_id"), "file")
    b = s.select(F.col("id").alias("to_id"), "name", F.col("doc").alias("tdir"))
    e = edges(spark, d).join(a, "from_id").join(b, "to_id")
    return e.select(F.col("from_id").alias("owner_id"), "file", "kind", F.when(F.col("kind") == 2, F.col("tdir")).otherwise("").alias("pkg"), "name", (F.col("edge_id") % 1000).alias("line"))


def resolve_refs(spark: SparkSession, d: str) -> DataFrame:
    s = _placed(spark, d)
    refs = _refs(spark, d)
    imports = refs.filter("pkg <> ''").select("file", F.col("pkg").alias("alias"), F.col("pkg").alias("dir")).distinct()
    return G.resolve_refs(refs, imports, s).groupBy("from_id", "to_id", "kind").agg(F.count("*").alias("n"), F.min("site").alias("site"))


def import_dir(spark: SparkSession, d: str) -> DataFrame:
    path = F.regexp_replace(F.regexp_replace("url", "^[a-z]+://", ""), "[?#].*$", "")
    return table(spark, d, "pages").select("page_id", import_directory(path, F.substring_index(path, "/", 1)).alias("dir"))


def method_set_closure(spark: SparkSession, d: str) -> DataFrame:
    """Nations embed their regions, suppliers their nations; a type's methods are the accounts named for it."""
    sup, nat, reg = (table(spark, d, t) for t in ("supplier", "nation", "region"))
    n = nat.join(reg, nat["n_regionkey"] == reg["r_regionkey"]).select("n_nationkey", "n_name", "r_name")
    s = sup.join(n, sup["s_nationkey"] == n["n_nationkey"])
    one = F.lit(".").alias("dir")
    embeds = n.select(one, F.col("n_name").alias("type"), F.col("r_name").alias("embedded")).unionByName(s.select(one, F.col("s_name").alias("type"), F.col("n_name").alias("embedded")))
    types = reg.select(one, F.col("r_name").alias("type")).unionByName(nat.select(one, F.col("n_name").alias("type"))).unionByName(sup.select(one, F.col("s_name").alias("type")))
    methods = reg.select(one, F.col("r_name").alias("receiver"), F.col("r_regionkey").cast("long").alias("method_id")).unionByName(
        nat.select(one, F.col("n_name").alias("receiver"), (F.col("n_nationkey") + 1000).cast("long").alias("method_id"))
    ).unionByName(sup.select(one, F.col("s_name").alias("receiver"), (F.col("s_suppkey") + 1_000_000).alias("method_id")))
    return G.method_sets(types, methods, embeds).select("type", "method_id")


def impl_edges(spark: SparkSession, d: str) -> DataFrame:
    """Parts of kind 4 as interface methods, all others as methods: equal brand, name and arities match."""
    s = symbols(spark, d)
    m = s.select(F.col("doc").alias("dir"), F.col("receiver").alias("type"), "name", (F.col("line") % 4).alias("n_params"), (F.col("line") % 2).alias("n_results"), F.col("id").alias("method_id"), F.concat_ws(":", "file", F.col("line").cast("string")).alias("site"), "kind")
    return G.implementation_edges(m.filter("kind = 4"), m)


def parse_signature(spark: SparkSession, d: str) -> DataFrame:
    return symbols(spark, d).select("id", "signature", signature_arity(F.col("signature")).alias("x")).select("id", F.col("x.n_params").alias("n_params"), F.col("x.n_results").alias("n_results"))


def interface_methods(spark: SparkSession, d: str) -> DataFrame:
    s = symbols(spark, d).withColumn("receiver", F.concat_ws("-", "receiver", "doc")).withColumn("name", F.when(F.col("kind") == 4, F.concat_ws("-", "receiver")).otherwise(F.col("name")))
    return L.interface_methods(s).select("id", "name", "receiver")


def _found(x: DataFrame) -> DataFrame:
    return x.select("level", F.array_join("path", ">").alias("path"), "edge_id", "from_id", "to_id")


def callees(spark: SparkSession, d: str) -> DataFrame:
    return _found(T.discover(edges(spark, d), START, DEPTH, T.OUT))


def callers(spark: SparkSession, d: str) -> DataFrame:
    return _found(T.discover(edges(spark, d), START, DEPTH, T.IN))


def trace(spark: SparkSession, d: str) -> DataFrame:
    return _found(T.discover(edges(spark, d), START, DEPTH, T.BOTH))


def impact(spark: SparkSession, d: str) -> DataFrame:
    """The first 40 edges, two levels deep: what the tool shows."""
    return _found(T.capped(T.discover(edges(spark, d), START, 2, T.OUT), 40))


def edges_of(spark: SparkSession, d: str) -> DataFrame:
    return L.edges_of(edges(spark, d), WINDOW_NODE).select("role", "edge_id")


def test_coverage(spark: SparkSession, d: str) -> DataFrame:
    return L.tested(edges(spark, d))


def node_context(spark: SparkSession, d: str) -> DataFrame:
    """For every symbol: its label and how many edges of each role it has."""
    e, s = edges(spark, d), symbols(spark, d)
    into = e.groupBy(F.col("to_id").alias("id")).agg(F.sum((F.col("kind") == 1).cast("long")).alias("callers"), F.sum((F.col("kind") == 2).cast("long")).alias("refs"), F.sum((F.col("kind") == 3).cast("long")).alias("impls_in"))
    out = e.groupBy(F.col("from_id").alias("id")).agg(F.sum((F.col("kind") == 1).cast("long")).alias("calls"), F.sum((F.col("kind") == 3).cast("long")).alias("impls_out"))
    return s.select("id", L.display_name().alias("label")).join(into, "id", "left").join(out, "id", "left").fillna(0)


def edge_labels(spark: SparkSession, d: str) -> DataFrame:
    return L.edge_labels(edges(spark, d), symbols(spark, d)).select("edge_id", "from_label", "to_label")


def resolve_exact(spark: SparkSession, d: str) -> DataFrame:
    s = symbols(spark, d)
    out = None
    for q in _targets():
        x = L.resolve_exact(s, q).select(F.lit(q).alias("query"), "id", "step")
        out = x if out is None else out.unionByName(x)
    return out


def _targets() -> tuple[str, ...]:
    return ("small.ring", "ring", "PROMO", "none")


def resolve_fuzzy(spark: SparkSession, d: str) -> DataFrame:
    return L.resolve_fuzzy(symbols(spark, d), "RING", 10).select("id", "name", "file", "doc")


def source_window(spark: SparkSession, d: str) -> DataFrame:
    """Around the middle line of each document."""
    docs = table(spark, d, "documents")
    places = docs.select(F.col("doc_id").alias("id"), F.col("doc_id").alias("file"), (F.floor(F.size(F.split("text", "\n")) / 2) + 1).alias("line"))
    return L.source_window(docs.select(F.col("doc_id").alias("file"), "text"), places)


def _bfs_sql(direction: str, depth: int) -> str:
    sides = {"out": ["from_id as cur, to_id as nxt"], "in": ["to_id as cur, from_id as nxt"], "both": ["from_id as cur, to_id as nxt", "to_id as cur, from_id as nxt"]}[direction]
    step = " union all ".join(f"select {s}, edge_id, from_id, to_id from edges where kind = 1" for s in sides)
    parts = [f"with {EDGES}, step as ({step}), l0 as (select 0 as level, {START}::bigint as nxt, []::bigint[] as path, 0::bigint as edge_id, 0::bigint as from_id, 0::bigint as to_id)"]
    for k in range(1, depth + 1):
        seen = " union all ".join(f"select nxt from l{i}" for i in range(k))
        parts.append(f"""l{k} as (select {k} as level, nxt, path, edge_id, from_id, to_id from (
            select s.nxt, list_append(f.path, s.edge_id) as path, s.edge_id, s.from_id, s.to_id,
                   row_number() over (partition by s.nxt order by list_append(f.path, s.edge_id)) as k
            from l{k - 1} f join step s on s.cur = f.nxt where s.nxt not in ({seen})) where k = 1)""")
    return ", ".join(parts) + " " + " union all ".join(f"select level, path, edge_id, from_id, to_id from l{k}" for k in range(1, depth + 1))


def _shown_sql(direction: str, depth: int, limit: str = "") -> str:
    return f"select level, array_to_string(path, '>') as path, edge_id, from_id, to_id from ({_bfs_sql(direction, depth)}) {limit}"


_PLACED = SYMBOLS.replace("p_type as file", "p_brand || '/' || p_type as file")
_REFS = f"""{_PLACED}, {EDGES},
top as (select doc as dir, name, max(id) as id from symbols where kind <> 2 group by all),
alone as (select doc as dir, name, min(id) as id from symbols where kind = 2 group by all having count(*) = 1),
refs as (select a.id as owner_id, a.file, e.kind, case when e.kind = 2 then b.doc else a.doc end as dir, b.name, e.edge_id % 1000 as line
         from edges e join symbols a on a.id = e.from_id join symbols b on b.id = e.to_id)"""
_NATIONS = "n as (select n_nationkey, n_name, r_name, n_regionkey from nation join region on n_regionkey = r_regionkey)"

SQL: dict[str, str] = {
    "assign_ids": f"with {SYMBOLS} select file, id as part, row_number() over (partition by file order by line, id) - 1 as ordinal, row_number() over (order by file, line, id) - 1 as id from symbols",
    "dir_of": "with p as (select page_id, regexp_replace(url, '^[a-z]+://', '') as u from pages) select page_id, case when instr(u, '/') > 0 then regexp_replace(u, '/[^/]*$', '') else '.' end as dir from p",
    "by_name_index": f"with {SYMBOLS} select name, array_to_string(list(id order by id), ',') as ids, count(*) as n from symbols group by name",
    "by_file_index": f"with {SYMBOLS} select file, array_to_string(list(id order by id), ',') as ids, count(*) as n from symbols group by file",
    "index_stats": f"with {SYMBOLS}, {EDGES} select (select count(*) from symbols) as n_symbols, (select count(distinct file) from symbols) as n_files, count(*) as n_edges, count(*) filter (kind = 1) as n_calls, count(*) filter (kind = 2) as n_refs, count(*) filter (kind = 3) as n_impls from edges",
    "symbol_table_last_wins": f"with {SYMBOLS} select doc as dir, name, max(id) as id from symbols where kind <> 2 group by all",
    "unique_method": f"with {SYMBOLS} select doc as dir, name, min(id) as id from symbols where kind = 2 group by all having count(*) = 1",
    "resolve_refs": f"with {_REFS}, r as (select r.*, coalesce(t.id, m.id) as to_id from refs r left join top t using (dir, name) left join alone m using (dir, name)) select owner_id as from_id, to_id, kind, count(*) as n, min(file || ':' || line) as site from r where to_id is not null and to_id <> owner_id group by all",
    "import_dir": "with p as (select page_id, regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', '') as u from pages), q as (select page_id, u, split_part(u, '/', 1) as m from p) select page_id, case when u = m then '.' when starts_with(u, m || '/') then substr(u, length(m) + 2) end as dir from q",
    "method_set_closure": f"""with {_NATIONS}, s as (select s_suppkey, s_name, n_name, n_nationkey, n_regionkey from supplier join n on s_nationkey = n_nationkey)
        select r_name as type, r_regionkey::bigint as method_id from region union select n_name, n_nationkey + 1000 from nation union select n_name, n_regionkey from n
        union select s_name, s_suppkey + 1000000 from supplier union select s_name, n_nationkey + 1000 from s union select s_name, n_regionkey from s""",
    "impl_edges": f"with {SYMBOLS}, m as (select doc as dir, receiver as type, name, line % 4 as p, line % 2 as r, id, file || ':' || line as site, kind from symbols) select a.id as from_id, b.id as to_id, min(a.site) as site from m a join m b on a.dir = b.dir and a.name = b.name and a.p = b.p and a.r = b.r and a.type <> b.type where a.kind = 4 group by a.id, b.id",
    "parse_signature": f"with {SYMBOLS} select id, (len(string_split(regexp_extract(signature, '^\\(([^()]*)\\)', 1), ',')))::int as n_params, 1 as n_results from symbols",
    "interface_methods": f"with {SYMBOLS}, s as (select id, case when kind = 4 then receiver || '-' || doc else name end as name, receiver || '-' || doc as receiver, kind from symbols) select id, name, receiver from s where kind = 2 and receiver in (select name from s where kind = 4)",
    "callees": _shown_sql("out", DEPTH),
    "callers": _shown_sql("in", DEPTH),
    "trace": _shown_sql("both", DEPTH),
    "impact": f"select level, array_to_string(path, '>') as path, edge_id, from_id, to_id from (select * from ({_bfs_sql('out', 2)}) order by level, path limit 40)",
    "edges_of": f"""with {EDGES} select 'callers' as role, edge_id from edges where to_id = {WINDOW_NODE} and kind = 1 union all select 'refs', edge_id from edges where to_id = {WINDOW_NODE} and kind = 2
        union all select 'impls', edge_id from edges where {WINDOW_NODE} in (from_id, to_id) and kind = 3 union all select 'tests', edge_id from edges where to_id = {WINDOW_NODE} and site like '%\\_test.go:%' escape '\\'
        union all select 'calls', edge_id from edges where from_id = {WINDOW_NODE} and kind = 1""",
    "test_coverage": f"with {EDGES} select to_id as id, count(*) as n_edges, count(*) filter (site like '%\\_test.go:%' escape '\\') as n_tests from edges group by to_id",
    "node_context": f"""with {SYMBOLS}, {EDGES}, i as (select to_id as id, count(*) filter (kind = 1) as callers, count(*) filter (kind = 2) as refs, count(*) filter (kind = 3) as impls_in from edges group by 1),
        o as (select from_id as id, count(*) filter (kind = 1) as calls, count(*) filter (kind = 3) as impls_out from edges group by 1)
        select id, case when kind = 2 and receiver <> '' then receiver || '.' || name else name end as label, coalesce(callers, 0) as callers, coalesce(refs, 0) as refs, coalesce(impls_in, 0) as impls_in, coalesce(calls, 0) as calls, coalesce(impls_out, 0) as impls_out
        from symbols left join i using (id) left join o using (id)""",
    "edge_labels": f"""with {SYMBOLS}, {EDGES}, l as (select id, case when kind = 2 and receiver <> '' then receiver || '.' || name else name end || ' (' || file || ':' || line || ')' as label from symbols)
        select edge_id, coalesce(a.label, '?') as from_label, coalesce(b.label, '?') as to_label from edges e left join l a on a.id = from_id left join l b on b.id = to_id""",
    "resolve_fuzzy": f"with {SYMBOLS} select id, name, file, doc from symbols where contains(lower(name), 'ring') or contains(lower(file), 'ring') or contains(lower(doc), 'ring') order by id limit 10",
    "resolve_exact": f"with {SYMBOLS} " + " union all ".join(
        f"""select * from (select '{q}' as query, id, step from (
            select min(id) as id, 1 as step from symbols where receiver = '{q.partition('.')[0]}' and name = '{q.partition('.')[2]}' and '{q}' like '_%.%'
            union all select min(id), 2 from symbols where name = '{q}' having count(*) = 1
            union all select min(id), 3 from symbols where file = '{q}' or split_part(file, '/', -1) = '{q.rpartition('/')[2]}') where id is not null order by step limit 1)"""
        for q in _targets()
    ),
    "source_window": """with d as (select doc_id as id, string_split(text, chr(10)) as l from documents), m as (select id, l, len(l) // 2 + 1 as line from d), x as (select id, line, unnest(l) as text, unnest(range(1, len(l) + 1)) as num from m)
        select id, num::int as num, regexp_replace(text, '\\r$', '') as text from x where num between line - 2 and line + 8""",
}
QUERIES = {k: globals()[k] for k in SQL}
