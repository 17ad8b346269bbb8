"""Scored lexical search over symbols: one expression tree, then top k."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _words(text: str) -> list[str]:
    return re.findall(r"[A-Za-z0-9_]+", text)


def lexical_score(query: str) -> Column:
    """The score of a symbol (name, receiver, file, doc) for a query."""
    q = query.strip().lower()
    ws, raw = _words(q) or [q], _words(query.strip())
    name, recv, file, doc = (F.lower(F.col(c)) for c in ("name", "receiver", "file", "doc"))
    base = F.regexp_replace(F.substring_index(file, "/", -1), "\\.go$", "")
    each = [
        F.when(name == w, 88).when(base == w, 80).when(F.startswith(name, F.lit(w)), 60).when(F.contains(name, F.lit(w)), 40).otherwise(0)
        for w in ws
    ]
    by_word = F.greatest(*each) if len(each) > 1 else each[0]
    by_word = F.when(by_word > 0, by_word).when(F.contains(file, F.lit(q)), 30).otherwise(0)
    score = F.when(name == q, 100).when((recv != "") & (F.concat(recv, F.lit("."), name) == q), 95).when(file == q, 90).otherwise(by_word)
    score = F.when((score > 0) & F.col("name").isin(raw), score + 10).otherwise(score) if raw else score
    extra = F.lit(0)
    for w in (w for w in ws if w != ws[-1]):
        extra = extra + F.when(F.contains(name, F.lit(w)), 12).otherwise(0) + F.when(F.contains(doc, F.lit(w)), 8).otherwise(0)
    score = F.when((score > 0) & (score < 88), score + extra).otherwise(score)
    anywhere = F.lit(False)
    for w in ws:
        anywhere = anywhere | F.contains(name, F.lit(w)) | F.contains(doc, F.lit(w))
    return F.when((score == 0) & anywhere, 15).otherwise(score)


def explore(symbols: DataFrame, query: str, limit: int) -> DataFrame:
    """``symbols`` that score, best first, the lowest ids first among equals."""
    return symbols.withColumn("score", lexical_score(query)).filter("score > 0").orderBy(F.desc("score"), "id").limit(limit)
