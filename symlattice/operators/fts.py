"""Full-text search: postings, document lengths and BM25.

Tokens are maximal runs of letters and digits in lower case, without the marks on Latin letters. A query's words must all
occur; a word with underscores is a phrase of adjacent tokens in one column. A score sums idf * tf * (k1 + 1) / (tf + k1 *
(1 - b + b * dl / avgdl)) over the query's words, repeats included; idf = ln((N - n + 0.5) / (n + 0.5)), at least 1e-6;
dl counts all columns. A key is one column or several.
"""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.lineage import cut

K1, B, LEAST_IDF = 1.2, 0.75, 1e-6
MARKS = "\\u0300-\\u036F"
#: What tokens consist of; marks that stand alone belong to the letter before.
INSIDE = f"[\\p{{L}}\\p{{N}}{MARKS}]"
TOKEN = f"[\\p{{L}}\\p{{N}}]{INSIDE}*"


def _folds() -> dict[str, str]:
    """Lower-case Latin letters with one mark, and the letter that is left without it; those with two keep them."""
    out = {}
    for c in map(chr, [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]):
        base, *marks = unicodedata.normalize("NFD", c)
        if len(marks) == 1 and c == c.lower() and base.isascii() and unicodedata.category(marks[0]) == "Mn":
            out[c] = base
    return out


FOLDS = _folds()
_BARE = str.maketrans(FOLDS | {chr(c): None for c in range(0x300, 0x370)})


def folded(token: Column) -> Column:
    """A lower-case token without marks; most have none, and their bytes tell."""
    bare = F.translate(token, "".join(FOLDS) + "".join(map(chr, range(0x300, 0x370))), "".join(FOLDS.values()))
    return F.when(F.length(token) == F.octet_length(token), token).otherwise(bare)


def query_phrases(query: str) -> list[list[str]]:
    """The query's words, each as its tokens; words of punctuation alone match nothing and give []."""
    return [re.findall(r"[^\W_]+", w) for w in re.findall(r"[a-z0-9_\u0080-\U0010FFFF]+", query.lower().translate(_BARE))]


def _keys(key: str | list[str]) -> list[str]:
    return [key] if isinstance(key, str) else key


def tokens(docs: DataFrame, columns: list[str], key: str | list[str]) -> DataFrame:
    """(key, col, pos, term): every token of the given columns, each text read once."""
    each = F.array(*[F.struct(F.lit(i).alias("col"), F.lower(F.coalesce(c, F.lit(""))).alias("text")) for i, c in enumerate(columns)])
    one = docs.select(*_keys(key), F.explode(each).alias("x")).select(*_keys(key), "x.col", F.posexplode(F.regexp_extract_all("x.text", F.lit(TOKEN), F.lit(0))).alias("pos", "term"))
    return one.withColumn("term", folded(F.col("term")))


def lengths(docs: DataFrame, columns: list[str], key: str | list[str]) -> DataFrame:
    return docs.select(*_keys(key), _length(columns).alias("dl"))


def _length(columns: list[str]) -> Column:
    n = F.lit(0)
    for c in columns:
        n = n + F.regexp_count(F.coalesce(c, F.lit("")), F.lit(TOKEN))
    return n


def _pattern(phrase: tuple[str, ...]) -> str:
    """A phrase in a lower-case text that keeps its marks: each letter with its variants, and only the first token is consumed, so that repeats overlap."""
    variants: dict[str, str] = {}
    for c, base in FOLDS.items():
        variants[base] = variants.get(base, base) + c
    first, *rest = ["".join((f"[{variants[c]}]" if c in variants else re.escape(c)) + f"[{MARKS}]*+" for c in t) for t in phrase]
    gap = f"[^\\p{{L}}\\p{{N}}{MARKS}]+"
    return f"(?<!{INSIDE}){first}(?={''.join(gap + t for t in rest)}(?!{INSIDE}))"


def search(docs: DataFrame, columns: list[str], key: str | list[str], query: str, limit: int | None) -> DataFrame:
    """(key, score) of the best matches, score descending and key ascending; no limit gives all matches.

    One pass over the texts counts each document's tokens and each phrase; what it found is kept, so statistics and
    scores read no text again.
    """
    phrases = query_phrases(query)
    if not phrases or any(not p for p in phrases):
        return docs.select(*_keys(key), F.lit(0.0).alias("score")).limit(0)
    distinct = list(dict.fromkeys(map(tuple, phrases)))
    tf = []
    for i, p in enumerate(distinct):
        counts = F.lit(0)
        for c in columns:
            counts = counts + F.regexp_count(F.lower(F.coalesce(c, F.lit(""))), F.lit(_pattern(p)))
        tf.append(counts.alias(f"tf{i}"))
    counted = cut(docs.select(*_keys(key), _length(columns).alias("dl"), *tf))
    stats = counted.agg(F.count("*").alias("docs"), F.avg("dl").alias("avgdl"), *_document_counts(distinct))
    return _ranked(counted, stats, phrases, distinct, key, limit)


def _document_counts(distinct: list[tuple[str, ...]]) -> list:
    return [F.sum(F.when(F.col(f"tf{i}") > 0, 1).otherwise(0)).alias(f"n{i}") for i in range(len(distinct))]


def _ranked(counted: DataFrame, stats: DataFrame, phrases: list[list[str]], distinct: list[tuple[str, ...]], key: str | list[str], limit: int | None) -> DataFrame:
    """Scores of ``counted`` (key, dl, tf0, ...) by one row of ``stats`` (docs, avgdl, n0, ...)."""
    joined = counted.filter(" and ".join(f"tf{i} > 0" for i in range(len(distinct)))).crossJoin(F.broadcast(stats))
    score = F.lit(0.0)
    for p in phrases:
        i = distinct.index(tuple(p))
        idf = F.greatest(F.log((F.col("docs") - F.col(f"n{i}") + 0.5) / (F.col(f"n{i}") + 0.5)), F.lit(LEAST_IDF))
        score = score + idf * F.col(f"tf{i}") * (K1 + 1) / (F.col(f"tf{i}") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    ranked = joined.select(*_keys(key), F.round(score, 9).alias("score"))
    return ranked.orderBy(F.desc("score"), *_keys(key)).limit(limit) if limit else ranked


def _shifted(places, by: int):
    return F.transform(places, lambda x: x - by)


#: Tokens of different columns are never adjacent: a column's places begin here times its number.
COLUMN = 1 << 40


def build_index(docs: DataFrame, columns: list[str], key: str | list[str]) -> tuple[DataFrame, DataFrame]:
    """Tables to keep: postings (term, key, places), to be sorted by term when written, and lengths (key, dl)."""
    place = (F.col("col") * F.lit(COLUMN) + F.col("pos")).alias("place")
    return tokens(docs, columns, key).select("term", *_keys(key), place).groupBy("term", *_keys(key)).agg(F.collect_list("place").alias("places")), lengths(docs, columns, key)


def search_index(postings: DataFrame, dl: DataFrame, key: str | list[str], query: str, limit: int | None) -> DataFrame:
    """``search`` over kept tables: the postings of the query's terms are read, no texts."""
    phrases = query_phrases(query)
    if not phrases or any(not p for p in phrases):
        return dl.select(*_keys(key), F.lit(0.0).alias("score")).limit(0)
    distinct = list(dict.fromkeys(map(tuple, phrases)))
    found = postings.filter(F.col("term").isin(list({t for p in distinct for t in p})))
    # A row for each document: its places of each of the query's terms.
    at = found.groupBy(*_keys(key)).agg(F.map_from_entries(F.collect_list(F.struct("term", "places"))).alias("at"))
    of = lambda t: F.coalesce(F.try_element_at("at", F.lit(t)), F.array().cast("array<long>"))
    tf = []
    for i, p in enumerate(distinct):
        starts = of(p[0])
        for k, t in enumerate(p[1:], 1):
            starts = F.array_intersect(starts, _shifted(of(t), k))
        tf.append(F.size(starts).alias(f"tf{i}"))
    counted = at.select(*_keys(key), *tf)
    every = dl.agg(F.count("*").alias("docs"), F.avg("dl").alias("avgdl"))
    stats = counted.agg(*_document_counts(distinct)).crossJoin(F.broadcast(every))
    return _ranked(counted.join(dl, _keys(key)), stats, phrases, distinct, key, limit)
