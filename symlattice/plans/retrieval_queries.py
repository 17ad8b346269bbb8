"""Full-text, lexical and vector retrieval."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import fts, lexical, semantic
from .carriers import SYMBOLS, symbols, table

WORD, WORDS, PHRASE, TOP = "that", "license under the the", "the_and that", 10
LEXICAL, NOWHERE = "small ring", "qqzx"


def fts_search(spark: SparkSession, d: str) -> DataFrame:
    return fts.search(table(spark, d, "documents"), ["source", "text"], "doc_id", WORD, TOP)


def fts_multi_term(spark: SparkSession, d: str) -> DataFrame:
    return fts.search(table(spark, d, "documents"), ["source", "text"], "doc_id", WORDS, TOP)


def fts_index_search(spark: SparkSession, d: str) -> DataFrame:
    """The same as fts_multi_term, from postings."""
    postings, dl = fts.build_index(table(spark, d, "documents"), ["source", "text"], "doc_id")
    return fts.search_index(postings, dl, "doc_id", WORDS, TOP)


def fts_index_phrase(spark: SparkSession, d: str) -> DataFrame:
    """All documents with a phrase and a word, from postings."""
    postings, dl = fts.build_index(table(spark, d, "documents"), ["source", "text"], "doc_id")
    return fts.search_index(postings, dl, "doc_id", PHRASE, None)


def pooled_vectors(spark: SparkSession, d: str) -> DataFrame:
    """For each event type's users the mean, the first and the last of their events' (value, id) vectors."""
    e = table(spark, d, "events").filter("value is not null")
    tokens = e.groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("event_id", "value"))).alias("x"))
    vectors = F.transform("x", lambda x: F.array(x["value"].cast("float"), x["event_id"].cast("float")))
    modes = [F.round(semantic.pooled(vectors, m)[0].cast("double"), 3).alias(m) for m in ("mean", "cls", "last")]
    return tokens.select("user_id", *modes)


def lexical_explore(spark: SparkSession, d: str) -> DataFrame:
    return lexical.explore(symbols(spark, d), LEXICAL, TOP).select("id", "name", "receiver", "score")


def _query_vector(spark: SparkSession, d: str) -> list[float]:
    return list(table(spark, d, "embeddings").filter("vec_id = 0").first()["embedding"])


def cosine_topk(spark: SparkSession, d: str) -> DataFrame:
    return semantic.nearest(table(spark, d, "embeddings"), _query_vector(spark, d), TOP)


def _candidates(spark: SparkSession, d: str) -> DataFrame:
    return symbols(spark, d).join(table(spark, d, "embeddings").select((F.col("vec_id") + 1).alias("id"), "embedding"), "id", "left")


def semantic_rerank(spark: SparkSession, d: str) -> DataFrame:
    return semantic.rerank(_candidates(spark, d), "small.ring", _query_vector(spark, d), TOP).select("id", "exact", "cosine")


def search_cascade(spark: SparkSession, d: str) -> DataFrame:
    """Full-text first; where it finds nothing, lexical search answers."""
    s = symbols(spark, d)
    columns = ["name", "receiver", "signature", "doc", "file"]
    out = []
    for q in (LEXICAL, NOWHERE + " ring"):
        found = fts.search(s, columns, "id", q, TOP * 8)
        if found.isEmpty():
            out.append(lexical.explore(s, q, TOP).select(F.lit(q).alias("query"), F.lit("lexical").alias("by"), "id", F.col("score").cast("double").alias("score")))
        else:
            out.append(found.limit(TOP).select(F.lit(q).alias("query"), F.lit("fts").alias("by"), "id", "score"))
    return out[0].unionByName(out[1])


def node_text(spark: SparkSession, d: str) -> DataFrame:
    return symbols(spark, d).select("id", semantic.node_text().alias("text"))


def vec_reuse(spark: SparkSession, d: str) -> DataFrame:
    """Symbols whose brand and type have a vector already, and those to embed."""
    from ..operators.graph import reuse_vectors

    s = symbols(spark, d)
    vectors = s.join(table(spark, d, "embeddings").select((F.col("vec_id") + 1).alias("id"), "embedding"), "id").groupBy("name", "doc", "file").agg(F.min("id").alias("vector_id"))
    return reuse_vectors(s.select("id", "name", "doc", "file"), vectors, ["name", "doc", "file"]).select("id", F.coalesce("vector_id", F.lit(-1)).alias("vector_id"))


def batch_pack(spark: SparkSession, d: str) -> DataFrame:
    """Batches of documents to embed, within each source's chunks of 1024 ids."""
    docs = table(spark, d, "documents").select("doc_id", "source", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("size"))
    batches = semantic.embed_batches(docs, "source", "doc_id", "size", F.floor(F.col("doc_id") / semantic.CHUNK_ROWS))
    return batches.groupBy("source", "chunk", "batch").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))


def _bm25_sql(source: str, key: str, columns: list[str], query: str, limit: int | None) -> str:
    phrases = [tuple(p) for p in fts.query_phrases(query)]
    distinct = list(dict.fromkeys(phrases))
    text = " || ' ' || ".join(f"coalesce({c}, '')" for c in columns)
    at = lambda p: " and ".join(f"t[i + {k}] = '{w}'" for k, w in enumerate(p))
    tf = ", ".join(f"len(list_filter(t, lambda x: x = '{p[0]}')) as tf{i}" if len(p) == 1 else f"len(list_filter(range(1, len(t) + 1), lambda i: {at(p)})) as tf{i}" for i, p in enumerate(distinct))
    stats = ", ".join(f"count(*) filter (tf{i} > 0) as n{i}" for i in range(len(distinct)))
    score = " + ".join(
        f"greatest(ln((docs - n{i} + 0.5::double) / (n{i} + 0.5::double)), 0.000001::double) * tf{i} * 2.2::double / (tf{i} + 1.2::double * (0.25::double + 0.75::double * dl / avgdl))" for i in (distinct.index(w) for w in phrases)
    )
    where = " and ".join(f"tf{i} > 0" for i in range(len(distinct)))
    return f"""select {key}, round({score}, 9) as score from (
        select {key}, len(t) as dl, {tf} from (select {key}, regexp_extract_all(strip_accents(lower({text})), '[\\p{{L}}\\p{{N}}]+') as t from {source})) c,
        (select count(*) as docs, avg(dl)::double as avgdl, {stats} from (select len(t) as dl, {tf} from (select regexp_extract_all(strip_accents(lower({text})), '[\\p{{L}}\\p{{N}}]+') as t from {source}))) s
        where {where} order by score desc, {key} {f"limit {limit}" if limit else ""}"""


def _lexical_sql(query: str, limit: int) -> str:
    q = query.strip().lower()
    ws = q.split()
    base = "regexp_replace(split_part(lower(file), '/', -1), '\\.go$', '')"
    each = ", ".join(f"case when lower(name) = '{w}' then 88 when {base} = '{w}' then 80 when starts_with(lower(name), '{w}') then 60 when contains(lower(name), '{w}') then 40 else 0 end" for w in ws)
    extra = " + ".join(f"case when contains(lower(name), '{w}') then 12 else 0 end + case when contains(lower(doc), '{w}') then 8 else 0 end" for w in ws if w != ws[-1]) or "0"
    anywhere = " or ".join(f"contains(lower(name), '{w}') or contains(lower(doc), '{w}')" for w in ws)
    raw = ", ".join(f"'{w}'" for w in query.split())
    return f"""select id, name, receiver, s3 as score from (select *, case when s2 = 0 and ({anywhere}) then 15 else s2 end as s3 from (
        select *, case when s1 > 0 and s1 < 88 then s1 + {extra} else s1 end as s2 from (select *, case when s0 > 0 and name in ({raw}) then s0 + 10 else s0 end as s1 from (
        select *, case when lower(name) = '{q}' then 100 when receiver <> '' and lower(receiver) || '.' || lower(name) = '{q}' then 95 when lower(file) = '{q}' then 90
            when w > 0 then w when contains(lower(file), '{q}') then 30 else 0 end as s0 from (select *, greatest({each}) as w from symbols))))) where s3 > 0 order by s3 desc, id limit {limit}"""


_COS = "list_dot_product(list_transform({a}, lambda x: x::double), list_transform({b}, lambda x: x::double)) / (sqrt(list_dot_product(list_transform({a}, lambda x: x::double), list_transform({a}, lambda x: x::double))) * sqrt(list_dot_product(list_transform({b}, lambda x: x::double), list_transform({b}, lambda x: x::double))))"
_NEAR = f"round({_COS.format(a='e.embedding', b='q.embedding')}, 5)"

SQL: dict[str, str] = {
    "fts_search": _bm25_sql("documents", "doc_id", ["source", "text"], WORD, TOP),
    "fts_multi_term": _bm25_sql("documents", "doc_id", ["source", "text"], WORDS, TOP),
    "fts_index_search": _bm25_sql("documents", "doc_id", ["source", "text"], WORDS, TOP),
    "fts_index_phrase": _bm25_sql("documents", "doc_id", ["source", "text"], PHRASE, None),
    "pooled_vectors": "select user_id, round(avg(value::float::double), 3) as mean, round(min_by(value, event_id)::float::double, 3) as cls, round(max_by(value, event_id)::float::double, 3) as last from events where value is not null group by user_id",
    "lexical_explore": f"with {SYMBOLS} {_lexical_sql(LEXICAL, TOP)}",
    "cosine_topk": f"select e.vec_id, {_NEAR} as cosine from embeddings e, (select embedding from embeddings where vec_id = 0) q order by cosine desc, e.vec_id limit {TOP}",
    "semantic_rerank": f"""with {SYMBOLS}, c as (select s.id, case when lower(name) = 'small.ring' then 100 when receiver <> '' and lower(receiver) || '.' || lower(name) = 'small.ring' then 95 when lower(file) = 'small.ring' then 90 else 0 end as exact, {_NEAR} as cosine
        from symbols s join embeddings e on s.id = e.vec_id + 1, (select embedding from embeddings where vec_id = 0) q)
        select id, exact, cosine from c where exact > 0 or cosine >= 0.25 order by exact desc, case when exact > 0 then 0 else cosine end desc, id limit {TOP}""",
    "search_cascade": f"""with {SYMBOLS} select '{LEXICAL}' as query, 'fts' as by, id, score from ({_bm25_sql('symbols', 'id', ['name', 'receiver', 'signature', 'doc', 'file'], LEXICAL, TOP)})
        union all select '{NOWHERE} ring', 'lexical', id, score::double from ({_lexical_sql(NOWHERE + ' ring', TOP)})""",
    "node_text": f"with {SYMBOLS} select id, concat_ws(' ', case when receiver <> '' then receiver || '.' || name else name end, nullif(signature, ''), nullif(doc, '')) as text from symbols",
    "vec_reuse": f"with {SYMBOLS}, v as (select name, doc, file, min(id) as vector_id from symbols where id - 1 in (select vec_id from embeddings) group by all) select id, coalesce(vector_id, -1) as vector_id from symbols left join v using (name, doc, file)",
    "batch_pack": """with recursive d as (select source, doc_id // 1024 as chunk, strlen(text)::bigint as size, row_number() over (partition by source, doc_id // 1024 order by doc_id) as i from documents where text <> ''),
        b as (select source, chunk, i, 0::bigint as batch, 1 as n, size as total, size from d where i = 1 union all
            select d.source, d.chunk, d.i, b.batch + (b.n >= 64 or b.total >= 16000)::bigint, case when b.n >= 64 or b.total >= 16000 then 1 else b.n + 1 end, case when b.n >= 64 or b.total >= 16000 then d.size else b.total + d.size end, d.size
            from b join d on d.source is not distinct from b.source and d.chunk = b.chunk and d.i = b.i + 1)
        select source, chunk, batch, count(*) as n, sum(size)::bigint as bytes from b group by source, chunk, batch""",
}
QUERIES = {k: globals()[k] for k in SQL}
