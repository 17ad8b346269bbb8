"""Secret scans over a trigram inverted index, with DataFrame functions only.

Each rule's regex is turned into a Boolean trigram query: alternatives of sets of trigrams that any match contains, in
lower case. The index holds postings (trigram, document) for the trigrams that some query names; grouping a document's
postings under a set and counting them intersects the posting lists. Documents that satisfy a query are its candidates,
and only there does the regex run; a rule without mandatory trigrams, like that for hex digits, runs over all texts.

Null and empty texts have no matches. Rows that share a doc_id share their candidate rules, and each is verified on its
own text; a null doc_id counts as one id.
"""

from __future__ import annotations

from itertools import product
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

try:
    from re import _constants as sre
    from re import _parser
except ImportError:  # Python before 3.11
    import sre_constants as sre
    import sre_parse as _parser

#: Alternatives that a query may have; a regex with more of them keeps a looser query.
MOST_SETS = 64


class Rule(NamedTuple):
    kind: str
    pattern: str
    group: int  # the group whose length is tested
    least: int
    base: bool = False


def any_case(word: str) -> str:
    return "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in word)


_KEYS = "|".join([*map(any_case, ("password", "passwd", "secret", "token")), f"{any_case('api')}_?{any_case('key')}"])
#: Spans are listed by start, then in this order.
RULES = (
    Rule("assign", f"({_KEYS})[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6, True),
    Rule("access", "AKIA[A-Z0-9]+", 0, 20, True),
    # The maximal runs of hex digits that are long enough: the shorter ones need not be listed first.
    Rule("hex", "[0-9a-f]{24,}", 0, 24, True),
    Rule("github", "gh[pousr]_[A-Za-z0-9]{36,}", 0, 40),
    Rule("slack", "xox[abprs]-[A-Za-z0-9-]{10,}", 0, 15),
    Rule("jwt", "eyJ[A-Za-z0-9_-]{8,}\\.eyJ[A-Za-z0-9_-]{8,}\\.[A-Za-z0-9_-]{8,}", 0, 30),
    Rule("private_key", "-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 27),
)


def _strings(items) -> list[tuple[set[str] | None, list[frozenset[str]]]]:
    """For each item of a parsed sequence: the strings that it may be, or None with the trigram sets that it needs."""
    out = []
    for op, arg in items:
        if op is sre.LITERAL:
            out.append(({chr(arg).lower()}, []))
        elif op is sre.IN and all(o is sre.LITERAL for o, _ in arg):
            out.append(({chr(a).lower() for _, a in arg}, []))
        elif op is sre.SUBPATTERN:
            out.extend(_strings(arg[3]))
        elif op is sre.BRANCH:
            out.append((None, [s for branch in arg[1] for s in trigram_sets(branch)]))
        elif op is sre.MAX_REPEAT and arg[0] == arg[1] == 1:
            out.extend(_strings(arg[2]))
        elif op is sre.MAX_REPEAT and arg[0] >= 1:
            out.append((None, trigram_sets(arg[2])))
        else:
            out.append((None, [frozenset()]))
    return out


def trigram_sets(items) -> list[frozenset[str]]:
    """Alternative sets of trigrams: whatever matches the sequence contains, in lower case, all of at least one set."""
    sets: list[frozenset[str]] = [frozenset()]
    runs: set[str] = {""}

    def close(sets: list[frozenset[str]]) -> list[frozenset[str]]:
        alternatives = list(dict.fromkeys(frozenset(r[i : i + 3] for i in range(len(r) - 2)) for r in runs))
        return _both(sets, alternatives)

    for strings, needed in _strings(items):
        if strings is not None and len(runs) * len(strings) <= MOST_SETS:
            runs = {a + b for a, b in product(runs, strings)}
        else:
            sets, runs = close(sets), {""}
            if strings is None:
                sets = _both(sets, needed)
    return close(sets)


def _both(a: list[frozenset[str]], b: list[frozenset[str]]) -> list[frozenset[str]]:
    if len(a) * len(b) > MOST_SETS:
        return a
    return list(dict.fromkeys(x | y for x, y in product(a, b)))


def trigram_query(pattern: str) -> list[frozenset[str]]:
    """The pattern's query, or [] if some alternative has no mandatory trigram, so that every text has to be scanned."""
    sets = trigram_sets(_parser.parse(pattern))
    if any(not s for s in sets):
        return []
    return [s for s in sets if not any(o < s for o in sets)]


def postings(docs: DataFrame, trigrams: list[str]) -> DataFrame:
    """(trigram, doc_id) for the given trigrams."""
    low = F.lower(F.coalesce("text", F.lit("")))
    has = F.filter(F.array(*map(F.lit, trigrams)), lambda t: F.contains(F.col("low"), t))
    return docs.select("doc_id", low.alias("low")).select("doc_id", F.explode(has).alias("trigram"))


def candidates(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(doc_id, kinds): the rules whose trigram queries a document satisfies."""
    spark = docs.sparkSession
    needs = [(r.kind, k, t, len(s)) for r in rules for k, s in enumerate(trigram_query(r.pattern)) for t in sorted(s)]
    # A few rows for each rule: bounded by the rules, not by the data.
    wanted = F.broadcast(spark.createDataFrame(needs, "kind string, set int, trigram string, need int"))
    found = postings(docs, sorted({t for _, _, t, _ in needs})).join(wanted, "trigram")
    whole = found.groupBy("doc_id", "kind", "set").agg(F.count_distinct("trigram").alias("n"), F.first("need").alias("need")).filter("n = need")
    return whole.groupBy("doc_id").agg(F.collect_set("kind").alias("kinds"))


def spans(rule: Rule, order: int) -> Column:
    """The rule's matches in ``text`` as (start, order, end) structs: what lies between matches gives the places."""
    pattern = F.lit(rule.pattern)
    between, hits = F.split("text", rule.pattern, -1), F.regexp_extract_all("text", pattern, F.lit(0))
    tested = F.regexp_extract_all("text", pattern, F.lit(rule.group))
    rows = F.arrays_zip(F.slice(between, 1, F.size(hits)).alias("before"), hits.alias("hit"), tested.alias("tested"))
    kind = "struct<start:int,order:int,end:int>"
    zero = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{kind}>").alias("found"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["before"])
        end = start + F.length(x["hit"])
        one = F.array(F.struct(start.alias("start"), F.lit(order).alias("order"), end.alias("end")))
        return F.struct(end.alias("at"), F.when(F.length(x["tested"]) >= rule.least, F.concat(acc["found"], one)).otherwise(acc["found"]).alias("found"))

    return F.aggregate(rows, zero, step, lambda acc: acc["found"])


def secret_scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``docs`` with ``found``: every match of every rule as (start, order, end), sorted; code points, end exclusive."""
    by_id = candidates(docs, rules).select(F.col("doc_id").alias("_id"), "kinds")
    joined = docs.withColumn("_text", F.col("text")).withColumn("text", F.coalesce("text", F.lit(""))).join(by_id, F.col("doc_id").eqNullSafe(F.col("_id")), "left")
    none = F.array().cast("array<struct<start:int,order:int,end:int>>")
    parts = [F.when(F.array_contains("kinds", r.kind), spans(r, i)).otherwise(none) if trigram_query(r.pattern) else spans(r, i) for i, r in enumerate(rules)]
    return joined.withColumn("found", F.array_sort(F.concat(*parts))).withColumn("text", F.col("_text")).drop("_text", "_id", "kinds")


def span_text(found: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    names = F.array(*[F.lit(r.kind) for r in rules])
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", F.element_at(names, x["order"] + 1), x["start"], x["end"])), ",")


def secret_report(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    base = [i for i, r in enumerate(rules) if r.base]
    only = F.filter("found", lambda x: x["order"].isin(base))
    count = lambda i: F.size(F.filter("found", lambda x: x["order"] == i)).cast("long")
    return secret_scan(docs.select("doc_id", "text"), rules).select(
        "doc_id", *[count(i).alias(f"n_{rules[i].kind}") for i in base], F.sha2(span_text(only, rules), 256).alias("base_sha256"), span_text(F.col("found"), rules).alias("spans")
    )


def mask_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``docs`` with every found span of ``text`` replaced by ``<secret>``; overlapping spans become one."""
    # Other columns travel as one, so no name of theirs can clash with a step's.
    others = [docs[c] for c in docs.columns if c not in ("doc_id", "text")]
    scanned = secret_scan(docs.select("doc_id", "text", F.struct(*others, F.lit(0).alias("_")).alias("_row")), rules)

    def cut(acc: Column, x: Column) -> Column:
        before = F.substring(F.col("text"), acc["at"] + 1, F.greatest(x["start"] - acc["at"], F.lit(0)))
        mask = F.when(x["start"] >= acc["at"], F.lit("<secret>")).otherwise("")
        return F.struct(F.greatest(acc["at"], x["end"]).alias("at"), F.concat(acc["out"], before, mask).alias("out"))

    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    rest = lambda acc: F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, F.length("text")))
    masked = F.when(F.size("found") > 0, F.aggregate("found", zero, cut, rest)).otherwise(F.col("text"))
    return scanned.select(*[masked.alias(c) if c == "text" else F.col(c) if c == "doc_id" else F.col("_row")[c].alias(c) for c in docs.columns])


def oracle_sql(rules: tuple[Rule, ...] = RULES) -> str:
    """DuckDB SQL for the same result, scanning every text with every rule."""
    q = lambda s: "'" + s.replace("'", "''") + "'"
    parts = [
        f"""select i, {k} as ord, {q(r.kind)} as kind, {str(r.base).lower()} as base, unnest(range(1, len(h) + 1)) as n, b, h, g, {r.least} as least from (
        select i, string_split_regex(t, {q(r.pattern)}) as b, regexp_extract_all(t, {q(r.pattern)}, 0) as h, regexp_extract_all(t, {q(r.pattern)}, {r.group}) as g from d) where len(h) > 0"""
        for k, r in enumerate(rules)
    ]
    return f"""with d as (select row_number() over () as i, doc_id, coalesce(text, '') as t from documents),
    m as ({' union all '.join(parts)}),
    s as (select i, ord, kind, base, list_sum(list_transform(b[1:n], lambda x: length(x))) + coalesce(list_sum(list_transform(h[1:n-1], lambda x: length(x))), 0) as s, length(h[n]) as l
          from m where length(g[n]) >= least),
    f as (select i, count(*) filter (ord = 0) as a, count(*) filter (ord = 1) as b, count(*) filter (ord = 2) as c,
          string_agg(kind || ':' || s::bigint || ':' || (s + l)::bigint, ',' order by s, ord) filter (base) as basic,
          string_agg(kind || ':' || s::bigint || ':' || (s + l)::bigint, ',' order by s, ord) as spans from s group by i)
    select d.doc_id, coalesce(a, 0)::bigint as n_assign, coalesce(b, 0)::bigint as n_access, coalesce(c, 0)::bigint as n_hex,
           sha256(coalesce(basic, '')) as base_sha256, coalesce(spans, '') as spans from d left join f using (i)"""
