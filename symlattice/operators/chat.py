"""Message logs: token totals, compaction, merged deltas and result lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import approximate_tokens

KEEP_LAST, LEAST_MESSAGES, FULL = 4, 8, 0.8


def token_totals(messages: DataFrame) -> DataFrame:
    """(conv_id, n_messages, tokens)."""
    return messages.groupBy("conv_id").agg(F.count("*").alias("n_messages"), F.sum(approximate_tokens(F.coalesce("text", F.lit("")))).alias("tokens"))


def message_tokens() -> Column:
    """A message's tokens: its content, its reasoning and the names and arguments of the tools that it calls."""
    of = lambda c: F.coalesce(approximate_tokens(c), F.lit(0))
    calls = F.transform(F.coalesce("tool_calls", F.array()), lambda c: of(c["function"]["name"]) + of(c["function"]["arguments"]))
    return of(F.col("content")) + of(F.col("reasoning_content")) + F.aggregate(calls, F.lit(0).cast("long"), lambda a, n: a + n)


def compacted(messages: DataFrame, limit: int) -> DataFrame:
    """Messages (conv_id, turn, role, text) with ``fate``: keep, or summarise where the conversation is compacted.

    That is so when its tokens reach 80 % of the limit and at least 8 messages follow a leading system message; the
    system message and the last 4 stay.
    """
    conv = W.partitionBy("conv_id")
    lead = (F.col("place") == 1) & (F.col("role") == "system")
    placed = messages.withColumn("place", F.row_number().over(conv.orderBy("turn"))).withColumn("back", F.row_number().over(conv.orderBy(F.desc("turn"))))
    sized = placed.withColumn("used", F.sum(approximate_tokens(F.coalesce("text", F.lit("")))).over(conv)).withColumn("rest", F.count("*").over(conv) - F.max(lead.cast("int")).over(conv))
    due = (F.col("used") >= int(limit * FULL)) & (F.col("rest") >= LEAST_MESSAGES)
    return sized.withColumn("fate", F.when(due & ~lead & (F.col("back") > KEEP_LAST), "summarise").otherwise("keep")).drop("place", "back", "used", "rest")


def strip_reasoning(messages: DataFrame) -> DataFrame:
    """Reasoning stays only on assistant messages that call tools."""
    plain = (F.col("role") == "assistant") & (F.size(F.coalesce("tool_calls", F.array())) <= 0)
    return messages.withColumn("reasoning_content", F.when(plain, "").otherwise(F.col("reasoning_content")))


def merged(deltas: DataFrame, key: str, order: str, text: str) -> DataFrame:
    """Each stream's deltas joined in order."""
    parts = F.sort_array(F.collect_list(F.struct(order, text)))
    return deltas.groupBy(key).agg(F.array_join(F.transform(parts, lambda x: x[text]), "").alias("content"), F.count("*").alias("n_deltas"))


#: Fragments of messages: ``seq`` orders those of a message; a tool call's parts share its index.
FRAGMENTS = "message string, seq long, content string, reasoning string, tool_index int, tool_id string, tool_name string, arguments string, done boolean"
MESSAGE = "message string, content string, reasoning string, tool_calls array<struct<index:int,id:string,name:string,arguments:string>>, n_fragments long, done boolean"


def _joined(parts: Column, field: str) -> Column:
    return F.array_join(F.transform(parts, lambda x: F.coalesce(x[field], F.lit(""))), "")


def _first_said(parts: Column, field: str) -> Column:
    """The first value that isn't empty: later fragments of a call repeat it or leave it out."""
    return F.coalesce(F.try_element_at(F.filter(F.transform(parts, lambda x: x[field]), lambda v: F.coalesce(v, F.lit("")) != ""), F.lit(1)), F.lit(""))


def merged_messages(fragments: DataFrame) -> DataFrame:
    """Messages put together from fragments: contents and reasoning joined by ``seq``, tool calls merged by their index.

    A call's id and name are the first that its fragments give, its arguments those of all of them joined. A fragment that
    came twice, with an equal ``seq``, counts once. Columns as in ``MESSAGE``.
    """
    rest = [c.split()[0] for c in FRAGMENTS.split(", ")[2:]]
    once = fragments.groupBy("message", "seq").agg(F.min(F.struct(*rest)).alias("x")).select("message", "seq", "x.*")
    # A call's parts are put together by themselves, so a message's many calls don't share an array of all fragments.
    parts = F.sort_array(F.collect_list(F.struct("seq", "tool_id", "tool_name", "arguments")))
    calls = once.filter("tool_index is not null").groupBy("message", "tool_index").agg(parts.alias("p"))
    whole = F.struct(F.col("tool_index").alias("index"), _first_said(F.col("p"), "tool_id").alias("id"), _first_said(F.col("p"), "tool_name").alias("name"), _joined(F.col("p"), "arguments").alias("arguments"))
    calls = calls.groupBy("message").agg(F.sort_array(F.collect_list(whole)).alias("tool_calls"))
    said = F.sort_array(F.collect_list(F.when(F.col("content").isNotNull() | F.col("reasoning").isNotNull(), F.struct("seq", "content", "reasoning"))))
    texts = once.groupBy("message").agg(said.alias("s"), F.count("*").alias("n_fragments"), F.coalesce(F.bool_or("done"), F.lit(False)).alias("done"))
    none = F.array().cast("array<struct<index:int,id:string,name:string,arguments:string>>")
    return texts.join(calls, "message", "left").select("message", _joined(F.col("s"), "content").alias("content"), _joined(F.col("s"), "reasoning").alias("reasoning"), F.coalesce("tool_calls", none).alias("tool_calls"), "n_fragments", "done")


def last_value(rows: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """Each key's last value that isn't null."""
    return rows.filter(F.col(value).isNotNull()).groupBy(key).agg(F.max_by(value, F.struct(*order)).alias(value))


def unique_names(rows: DataFrame, name: str, order: str) -> DataFrame:
    """Names made unique: the second of a name gets -2, the third -3."""
    k = F.row_number().over(W.partitionBy(name).orderBy(order))
    return rows.withColumn("unique_name", F.when(k == 1, F.col(name)).otherwise(F.concat_ws("-", name, k.cast("string"))))


def idle_sessions(events: DataFrame, key: str, ts: str, order: str, seconds: int) -> DataFrame:
    """(key, session, n_events): a gap of more than ``seconds`` begins a new session."""
    by = W.partitionBy(key).orderBy(ts, order)
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    gap = micros(F.col(ts)) - micros(F.lag(ts).over(by))
    numbered = events.withColumn("session", F.sum(F.when(gap > seconds * 1_000_000, 1).otherwise(0)).over(by))
    return numbered.groupBy(key, "session").agg(F.count("*").alias("n_events"))


#: The two shapes in which results of a search come.
NESTED = "struct<web:struct<results:array<struct<title:string,url:string,description:string>>>>"
FLAT = "struct<results:array<struct<title:string,url:string,content:string>>>"
RESULT = "struct<title:string,url:string,snippet:string>"


def normalised_results(payloads: DataFrame, key: str, engine: str, payload: str, most: int) -> DataFrame:
    """(key, rank, title, url, snippet) of search payloads in JSON, whose shape the ``engine`` names: nested or flat.

    Results without an address go; missing titles and snippets are empty. Of a flat payload the first ``most`` results
    stay, in the order in which they came, as its engine takes no limit itself. Payloads that aren't JSON and those of
    another engine give nothing.
    """
    nested, flat = F.from_json(F.col(payload), NESTED)["web"]["results"], F.from_json(F.col(payload), FLAT)["results"]
    said = lambda c: F.coalesce(c, F.lit(""))
    one = lambda x, text: F.struct(said(x["title"]).alias("title"), said(x["url"]).alias("url"), said(x[text]).alias("snippet"))
    all_ = F.when(F.col(engine) == "nested", F.transform(nested, lambda x: one(x, "description"))).when(F.col(engine) == "flat", F.transform(flat, lambda x: one(x, "content")))
    kept = F.filter(F.coalesce(all_, F.array().cast(f"array<{RESULT}>")), lambda x: x["url"] != "")
    cut = F.when(F.col(engine) == "flat", F.slice(kept, 1, most)).otherwise(kept)
    return payloads.select(key, F.posexplode(cut).alias("pos", "x")).select(key, (F.col("pos") + 1).alias("rank"), "x.*")


def formatted_results(title: Column, url: Column, snippet: Column) -> Column:
    return F.concat(F.concat_ws("\n", title, url, snippet), F.lit("\n---"))
