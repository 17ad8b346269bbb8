"""Queries over texts, paths and lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import graph as G
from ..operators import lines as N
from .carriers import table


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "lang", "source")


def fingerprint_files(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", F.concat_ws(":", F.sha2("text", 256), F.octet_length("text").cast("string")).alias("fingerprint"))


def incremental_diff(spark: SparkSession, d: str) -> DataFrame:
    """The old snapshot lacks one source and has other texts in French; the new one lacks another source."""
    docs = _docs(spark, d)
    path = F.col("doc_id").cast("string").alias("path")
    old = docs.filter("source <> 'src3'").select(path, F.sha2(F.when(F.col("lang") == "fr", F.concat("text", F.lit("."))).otherwise(F.col("text")), 256).alias("fingerprint"))
    new = docs.filter("source <> 'src5'").select(path, F.sha2("text", 256).alias("fingerprint"))
    return G.snapshot_diff(old, new)


def search_names(spark: SparkSession, d: str) -> DataFrame:
    return N.find_names(table(spark, d, "pages").select("page_id", "url"), "url", "\\.html$")


def grep_content(spark: SparkSession, d: str) -> DataFrame:
    return N.grep(_docs(spark, d), "doc_id", "[Ll]icense")


def line_range(spark: SparkSession, d: str) -> DataFrame:
    return N.line_range(_docs(spark, d), "doc_id", 2, 4)


def tail_lines(spark: SparkSession, d: str) -> DataFrame:
    return N.line_range(_docs(spark, d), "doc_id", -2, 0)


def literal_replace(spark: SparkSession, d: str) -> DataFrame:
    new, n = N.replaced(F.col("text"), "the ", "THE ")
    return _docs(spark, d).select("doc_id", F.md5(new).alias("replaced_md5"), n.alias("n"))


def truncate_text(spark: SparkSession, d: str) -> DataFrame:
    ascii_text = F.regexp_replace("text", "[^\\x00-\\x7F]", "?")
    return _docs(spark, d).select("doc_id", X.cut_bytes(ascii_text, 12_000, "...").alias("cut"))


def signature_clean(spark: SparkSession, d: str) -> DataFrame:
    ascii_text = F.regexp_replace("text", "[^\\x00-\\x7F]", "?")
    return _docs(spark, d).select("doc_id", X.clean_signature(ascii_text).alias("signature"))


def doc_first_line(spark: SparkSession, d: str) -> DataFrame:
    ascii_text = F.concat(F.lit("// # "), F.regexp_replace("text", "[^\\x00-\\x7F]", "?"))
    return _docs(spark, d).select("doc_id", X.first_doc_line(ascii_text).alias("doc"))


def mask_sensitive(spark: SparkSession, d: str) -> DataFrame:
    """Settings named for an event's type; those with sensitive names are hidden."""
    e = table(spark, d, "events")
    name = F.concat_ws("_", F.col("event_type"), F.when(F.col("value") > 50, "api-key").otherwise("limit"))
    return e.select("event_id", name.alias("name"), F.when(X.is_sensitive(name), "<hidden>").otherwise(F.col("props")).alias("value"))


def blacklist_match(spark: SparkSession, d: str) -> DataFrame:
    command = F.concat_ws(" ", F.lit("rm"), F.when(F.col("lang") == "en", "-rf").otherwise("-v"), F.substring("text", 1, 20))
    docs = _docs(spark, d)
    return docs.select("doc_id", (X.is_dangerous(F.col("text")) | X.is_dangerous(command)).alias("dangerous"))


def url_filter(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "pages").filter(F.rlike("url", F.lit("^https?://")))
    return p.select("page_id", F.parse_url("url", F.lit("HOST")).alias("host"), F.coalesce(F.parse_url("url", F.lit("QUERY")), F.lit("")).alias("query"))


def safe_path(spark: SparkSession, d: str) -> DataFrame:
    path = F.concat(F.lit("/"), F.regexp_replace("url", "^[a-z]+://[^/]*/", ""))
    moved = F.when(F.contains("url", F.lit("www.")), F.concat(F.lit("/usr"), path)).otherwise(F.concat(F.lit("/home/usr"), path))
    return table(spark, d, "pages").select("page_id", (~X.is_blocked_path(moved)).alias("safe"))


def approx_tokens(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", X.approximate_tokens(F.col("text")).alias("tokens"))


def ring_tail(spark: SparkSession, d: str) -> DataFrame:
    return N.ring_tail(_docs(spark, d), "doc_id", 10)


def modified_files(spark: SparkSession, d: str) -> DataFrame:
    """Users in the order of their first events."""
    return N.first_seen(table(spark, d, "events"), "user_id", "event_id")


def progress_steps(spark: SparkSession, d: str) -> DataFrame:
    """How far into its conversation each message stands, in steps of 5 %."""
    from pyspark.sql import Window as W

    c = table(spark, d, "conversations").select("conv_id", "turn")
    whole = W.partitionBy("conv_id")
    return c.select("conv_id", "turn", X.progress_step(F.row_number().over(whole.orderBy("turn")), F.count("*").over(whole)).alias("step"))


def list_dir(spark: SparkSession, d: str) -> DataFrame:
    """The top of the site tree: each first part of an address, a directory if more follows, with the sizes of files."""
    path = F.regexp_replace(F.regexp_replace("url", "^[a-z]+://[^/]*/?", ""), "[?#].*$", "")
    parts = table(spark, d, "pages").select(F.split(path, "/").alias("p"), F.length("html").cast("long").alias("size"))
    entries = parts.groupBy(F.element_at("p", 1).alias("name"), (F.size("p") > 1).alias("is_dir")).agg(F.sum("size").alias("size"))
    return N.listing(entries.filter("name <> ''"), "E")


def timestamps(spark: SparkSession, d: str) -> DataFrame:
    """Each event's time as RFC 3339, and what parsing that gives."""
    said = table(spark, d, "events").select("event_id", X.timestamp_text(F.col("ts")).alias("said"))
    return said.withColumn("seconds", F.unix_seconds(X.timestamp_of(F.col("said"))))


_ASCII = "regexp_replace(coalesce(text, ''), '[^\\x00-\\x7F]', '?', 'g')"
_D = "d as (select doc_id, coalesce(text, '') as text, lang, source from documents)"
_L = f"{_D}, l as (select doc_id, unnest(string_split(text, chr(10))) as line, unnest(range(1, len(string_split(text, chr(10))) + 1))::int as num, len(string_split(text, chr(10))) as n from d)"
_DANGER = " or ".join(f"regexp_matches(c, '{p.replace(chr(39), chr(39) * 2)}')" for p in X.DANGEROUS_COMMANDS)
_BLOCKED = " or ".join([f"u = '{r}' or starts_with(u, '{r}\\')" for r in X.BLOCKED_ROOTS] + [f"starts_with(u, '{s}') or (instr(u, '{s}') > 1 and u[instr(u, '{s}') - 1] in (':', '\\'))" for s in X.BLOCKED_SEGMENTS])

SQL: dict[str, str] = {
    "fingerprint_files": f"with {_D} select doc_id, sha256(text) || ':' || strlen(text) as fingerprint from d",
    "incremental_diff": f"""with {_D}, o as (select doc_id::varchar as path, sha256(case when lang = 'fr' then text || '.' else text end) as f from d where source <> 'src3'), n as (select doc_id::varchar as path, sha256(text) as f from d where source <> 'src5')
        select coalesce(o.path, n.path) as path, case when o.f is null then 'added' when n.f is null then 'deleted' when o.f <> n.f then 'changed' else 'same' end as status from o full join n on o.path = n.path""",
    "search_names": f"select page_id, url from pages where regexp_matches(split_part(url, '/', -1), '\\.html$') and not list_has_any(string_split(url, '/')[:-2], {list(N.UNSEARCHED)})",
    "grep_content": f"with {_L} select doc_id, num, trim(line) as line from l where regexp_matches(line, '[Ll]icense')",
    "line_range": f"with {_L} select doc_id, num, line from l where num between 2 and 4",
    "tail_lines": f"with {_L} select doc_id, num, line from l where num > n - 2",
    "literal_replace": f"with {_D} select doc_id, md5(replace(text, 'the ', 'THE ')) as replaced_md5, ((length(text) - length(replace(text, 'the ', ''))) / 4)::bigint as n from d",
    "truncate_text": f"with d as (select doc_id, {_ASCII} as t from documents) select doc_id, case when length(t) > 12000 then left(t, 12000) || '...' else t end as cut from d",
    "signature_clean": f"with d as (select doc_id, trim(regexp_replace({_ASCII}, '[\\x20\\x09-\\x0D]+', ' ', 'g')) as t from documents) select doc_id, case when length(t) > 120 then left(t, 120) || '…' else t end as signature from d",
    "doc_first_line": f"with d as (select doc_id, trim(split_part(regexp_replace('// # ' || {_ASCII}, '^[/#* \\t]+', ''), chr(10), 1)) as t from documents) select doc_id, case when length(t) > 160 then left(t, 160) || '…' else t end as doc from d",
    "mask_sensitive": "with e as (select event_id, event_type || '_' || case when value > 50 then 'api-key' else 'limit' end as name, props from events) select event_id, name, case when regexp_matches(name, '(?i)(^|[_\\-.])(key|token|secret|passwd|password|credential|auth)([_\\-.]|$)') then '<hidden>' else props end as value from e",
    "blacklist_match": f"with {_D}, x as (select doc_id, text as c from d union all select doc_id, 'rm ' || case when lang = 'en' then '-rf' else '-v' end || ' ' || left(text, 20) from d) select doc_id, bool_or({_DANGER}) as dangerous from x group by doc_id",
    "url_filter": "select page_id, regexp_extract(url, '^https?://([^/?#]*)', 1) as host, regexp_extract(url, '\\?([^#]*)', 1) as query from pages where regexp_matches(url, '^https?://')",
    "safe_path": f"with p as (select page_id, replace(lower(case when contains(url, 'www.') then '/usr' else '/home/usr' end || '/' || regexp_replace(url, '^[a-z]+://[^/]*/', '')), '/', '\\') as u from pages) select page_id, not ({_BLOCKED}) as safe from p",
    "approx_tokens": f"with {_D}, x as (select doc_id, length(text) as n, length(regexp_replace(text, '[^\\x00-\\x7F]', '', 'g')) as a from d) select doc_id, (a // 4 + floor((n - a) * 0.6::double))::bigint as tokens from x",
    "ring_tail": f"with {_L} select doc_id, num, line from l where num > n - case when n <= 10 then n else 6 + (n - 11) % 5 end",
    "modified_files": "select user_id, min(event_id) as first from events group by user_id",
    "timestamps": "select event_id, regexp_replace(strftime(ts, '%Y-%m-%dT%H:%M:%S.%f'), '\\.?0*$', '') || 'Z' as said, floor(epoch(ts))::bigint as seconds from events",
    "progress_steps": "select conv_id, turn, floor((row_number() over (partition by conv_id order by turn)) * 100 / (count(*) over (partition by conv_id)) / 5)::bigint as step from conversations",
    "list_dir": "with p as (select string_split(regexp_replace(regexp_replace(url, '^[a-z]+://[^/]*/?', ''), '[?#].*$', ''), '/') as p, length(html)::bigint as size from pages) select p[1] as name, len(p) > 1 as is_dir, sum(size)::bigint as size from p where p[1] <> '' and contains(lower(p[1]), 'e') group by all",
}
QUERIES = {k: globals()[k] for k in SQL}
