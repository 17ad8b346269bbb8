"""Queries over message logs, events and catalogues."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import chat
from .carriers import table

LIMIT, GAP, MOST = 1000, 3600, 3


def conversation_tokens(spark: SparkSession, d: str) -> DataFrame:
    return chat.token_totals(table(spark, d, "conversations"))


def compact_history(spark: SparkSession, d: str) -> DataFrame:
    return chat.compacted(table(spark, d, "conversations"), LIMIT).groupBy("conv_id", "fate").agg(F.count("*").alias("n"), F.max("turn").alias("last_turn"))


def merge_deltas(spark: SparkSession, d: str) -> DataFrame:
    return chat.merged(table(spark, d, "conversations"), "conv_id", "turn", "text")


def last_usage(spark: SparkSession, d: str) -> DataFrame:
    return chat.last_value(table(spark, d, "events").select("user_id", "ts", "event_id", "value"), "user_id", ["ts", "event_id"], "value")


def json_args(spark: SparkSession, d: str) -> DataFrame:
    """Each event's arguments, ``{}`` where they aren't JSON: its first key's count."""
    e = table(spark, d, "events")
    keys = F.json_object_keys(F.when(F.expr("try_parse_json(props)").isNotNull(), F.col("props")).otherwise("{}"))
    return e.select("event_id", F.coalesce(F.size(keys), F.lit(0)).alias("n_keys"), F.array_join(F.sort_array(keys), ",").alias("keys"))


def catalog_filter(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    hit = F.contains(F.lower("p_name"), F.lit("ring")) | F.contains(F.lower("p_brand"), F.lit("#11")) | F.contains(F.lower("p_type"), F.lit("promo"))
    return p.filter(hit).select("p_partkey", "p_name", "p_brand", "p_type")


def dedupe_names(spark: SparkSession, d: str) -> DataFrame:
    return chat.unique_names(table(spark, d, "part").select("p_partkey", "p_name"), "p_name", "p_partkey").select("p_partkey", "unique_name")


def serp_normalise(spark: SparkSession, d: str) -> DataFrame:
    """Pages as search results (title, address, snippet); those without an address go."""
    p = table(spark, d, "pages").filter("coalesce(url, '') <> ''")
    title = F.regexp_extract("html", "<title>([^<]*)</title>", 1)
    snippet = F.regexp_extract("html", "<h1>([^<]*)</h1>", 1)
    return p.select("page_id", chat.formatted_results(title, F.col("url"), snippet).alias("result"))


def merge_fragments(spark: SparkSession, d: str) -> DataFrame:
    """Conversations as streamed messages: odd turns are content, others parts of tool calls, whose index comes from the turn."""
    c = table(spark, d, "conversations")
    call = F.col("turn") % 2 == 0
    parts = c.select(
        F.col("conv_id").cast("string").alias("message"), F.col("turn").cast("long").alias("seq"), F.when(~call, F.col("text")).alias("content"), F.when(F.col("turn") == 1, F.col("role")).alias("reasoning"),
        F.when(call, (F.col("turn") / 2).cast("int") % 3).alias("tool_index"), F.when(call & (F.col("turn") > 2), F.concat(F.lit("call-"), F.col("turn").cast("string"))).alias("tool_id"), F.when(call, F.col("role")).alias("tool_name"),
        F.when(call, F.col("text")).alias("arguments"), (F.col("turn") == 5).alias("done"),
    )
    m = chat.merged_messages(parts)
    calls = F.array_join(F.transform("tool_calls", lambda x: F.concat_ws("|", x["index"].cast("string"), x["id"], x["name"], F.md5(x["arguments"].cast("binary")))), ";")
    return m.select("message", F.md5(F.col("content").cast("binary")).alias("content"), "reasoning", calls.alias("calls"), "n_fragments", "done")


def serp_payloads(spark: SparkSession, d: str) -> DataFrame:
    """Each host's pages as the payload of a search, of one shape or the other, read back and normalised."""
    p = table(spark, d, "pages")
    title, said = F.regexp_extract("html", "<title>([^<]*)</title>", 1), F.regexp_extract("html", "<h1>([^<]*)</h1>", 1)
    host = F.coalesce(F.parse_url(F.col("url"), F.lit("HOST")), F.lit(""))
    url = F.when(F.col("page_id") % 7 == 0, F.lit(None)).otherwise(F.col("url"))
    found = p.select(host.alias("host"), F.struct("page_id", title.alias("title"), url.alias("url"), said.alias("said")).alias("x")).groupBy("host").agg(F.sort_array(F.collect_list("x")).alias("x"))
    engine = F.when(F.length("host") % 2 == 0, "nested").otherwise("flat")
    nested = F.to_json(F.struct(F.struct(F.transform("x", lambda r: F.struct(r["title"].alias("title"), r["url"].alias("url"), r["said"].alias("description"))).alias("results")).alias("web")))
    flat = F.to_json(F.struct(F.transform("x", lambda r: F.struct(r["title"].alias("title"), r["url"].alias("url"), r["said"].alias("content"), r["page_id"].alias("score"))).alias("results")))
    payloads = found.select("host", engine.alias("engine"), F.when(engine == "nested", nested).otherwise(flat).alias("payload"))
    return chat.normalised_results(payloads, "host", "engine", "payload", MOST)


def idle_sessions(spark: SparkSession, d: str) -> DataFrame:
    return chat.idle_sessions(table(spark, d, "events"), "user_id", "ts", "event_id", GAP)


_TOKENS = "(length(regexp_replace(coalesce(text, ''), '[^\\x00-\\x7F]', '', 'g')) // 4 + floor((length(coalesce(text, '')) - length(regexp_replace(coalesce(text, ''), '[^\\x00-\\x7F]', '', 'g'))) * 0.6::double))::bigint"

SQL: dict[str, str] = {
    "conversation_tokens": f"select conv_id, count(*) as n_messages, sum({_TOKENS})::bigint as tokens from conversations group by conv_id",
    "compact_history": f"""with p as (select *, row_number() over (partition by conv_id order by turn) as place, row_number() over (partition by conv_id order by turn desc) as back, sum({_TOKENS}) over (partition by conv_id) as used, count(*) over (partition by conv_id) as n from conversations),
        q as (select *, place = 1 and role = 'system' as lead, n - max((place = 1 and role = 'system')::int) over (partition by conv_id) as rest from p)
        select conv_id, case when used >= {int(LIMIT * 0.8)} and rest >= 8 and not lead and back > 4 then 'summarise' else 'keep' end as fate, count(*) as n, max(turn) as last_turn from q group by all""",
    "merge_deltas": "select conv_id, string_agg(text, '' order by turn, text) as content, count(*) as n_deltas from conversations group by conv_id",
    "last_usage": "select user_id, arg_max(value, (ts, event_id)) as value from events where value is not null group by user_id",
    "json_args": "with e as (select event_id, case when json_valid(props) then props else '{}' end as p from events) select event_id, len(json_keys(p))::int as n_keys, array_to_string(list_sort(json_keys(p)), ',') as keys from e",
    "catalog_filter": "select p_partkey, p_name, p_brand, p_type from part where contains(lower(p_name), 'ring') or contains(lower(p_brand), '#11') or contains(lower(p_type), 'promo')",
    "dedupe_names": "with n as (select p_partkey, p_name, row_number() over (partition by p_name order by p_partkey) as k from part) select p_partkey, case when k = 1 then p_name else p_name || '-' || k end as unique_name from n",
    "serp_normalise": "select page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) || chr(10) || url || chr(10) || regexp_extract(html, '<h1>([^<]*)</h1>', 1) || chr(10) || '---' as result from pages where coalesce(url, '') <> ''",
    "merge_fragments": """with c as (select conv_id::varchar as message, turn, role, text, turn % 2 = 0 as call, (turn // 2) % 3 as i from conversations),
        k as (select message, i, coalesce(min('call-' || turn) filter (turn = f), '') as id, coalesce(arg_min(role, turn) filter (role <> ''), '') as name, coalesce(string_agg(text, '' order by turn), '') as arguments
            from (select *, min(turn) filter (turn > 2) over (partition by message, i) as f from c where call) group by message, i),
        t as (select message, string_agg(i || '|' || id || '|' || name || '|' || md5(arguments), ';' order by i) as calls from k group by message)
        select message, md5(coalesce(string_agg(text, '' order by turn) filter (not call), '')) as content, coalesce(max(role) filter (turn = 1), '') as reasoning, coalesce(any_value(calls), '') as calls, count(*) as n_fragments, bool_or(turn = 5) as done
        from c left join t using (message) group by message""",
    "serp_payloads": f"""with p as (select page_id, coalesce(nullif(regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1), ''), '') as host, case when page_id % 7 = 0 then null else url end as url, regexp_extract(html, '<title>([^<]*)</title>', 1) as title, regexp_extract(html, '<h1>([^<]*)</h1>', 1) as snippet from pages),
        r as (select host, title, url, snippet, (row_number() over (partition by host order by page_id))::int as rank from p where coalesce(url, '') <> '')
        select * from r where length(host) % 2 = 0 or rank <= {MOST}""",
    "idle_sessions": f"""with g as (select user_id, ts, event_id, case when epoch_us(ts) - epoch_us(lag(ts) over w) > {GAP}::bigint * 1000000 then 1 else 0 end as b from events window w as (partition by user_id order by ts, event_id)),
        s as (select user_id, sum(b) over (partition by user_id order by ts, event_id rows unbounded preceding)::bigint as session from g) select user_id, session, count(*) as n_events from s group by all""",
}
QUERIES = {k: globals()[k] for k in SQL}
