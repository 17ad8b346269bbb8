"""Token counts without token ids.

Pieces are counted once for each distinct pre-token of the corpus. Documents become pre-token frequencies, which are
joined to those counts and summed: with the frequent pre-tokens, whose table has at most ``HOT`` rows, where the text
is read; with all others in a shuffled join. A pre-token that a third of the documents share is thus never a join key
of the shuffle, and what moves is one row for a document and one for each of its rare pre-tokens.

Nulls and empty texts have 0 tokens; repeated rows, null or equal ids each keep a row of their own; other columns of
the input are not carried along.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import pretokens as P
from .common import arrow_rows, blocks, frequent, row_ids, stage, text_or_empty

#: Rows of the broadcast table at most.
HOT = 1 << 18
BLOCK = 16 << 20


def pretokens_of_words(words: list[str]) -> list[list[str]]:
    return [P.SPLIT.findall(w) for w in words]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for block in blocks(batches, BLOCK):
        coded, total = P.Coded(block["text"].chunk(0)), Counter()
        for w, f in zip(coded.words, np.bincount(coded.codes, minlength=len(coded.words)).tolist()):
            for p in P.SPLIT.findall(w):
                total[p] += f
        for i in np.flatnonzero(coded.odd):
            total.update(P.odd_pretokens(block["text"][int(i)].as_py(), P.tokenizer()))
        if total:
            yield pa.RecordBatch.from_pydict({"pretoken": pa.array(total.keys(), pa.string()), "n": pa.array(total.values(), pa.int64())})


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    tok = P.tokenizer()
    for b in batches:
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array([len(P.piece_ids(p, tok)) for p in b["pretoken"].to_pylist()], pa.int64())], names=[*b.schema.names, "pieces"])


def pretoken_pieces(docs: DataFrame) -> DataFrame:
    """(pretoken, n, pieces): every distinct pre-token of all texts, its frequency and its number of pieces."""
    arrow_rows(docs.sparkSession)
    counts = docs.select(text_or_empty().alias("text")).mapInArrow(_count, "pretoken string, n long").groupBy("pretoken").agg(F.sum("n").alias("n"))
    return counts.mapInArrow(_pieces, "pretoken string, n long, pieces long")


def _frequencies(hot):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, seen = hot.value, 0
        for block in blocks(batches, BLOCK):
            texts, n = block["text"].chunk(0), block.num_rows
            coded = P.Coded(texts)
            known = np.zeros(len(coded.words), np.int64)
            rare: dict[str, int] = {}
            word_at, rare_at = [], []  # rare pre-tokens of each word
            for i, w in enumerate(coded.words):
                for p in P.SPLIT.findall(w):
                    k = table.get(p)
                    if k is None:
                        word_at.append(i)
                        rare_at.append(rare.setdefault(p, len(rare)))
                    else:
                        known[i] += k
            owner = np.repeat(np.arange(n), coded.per_text)
            sums = np.bincount(owner, weights=known[coded.codes], minlength=n).astype(np.int64) if n else known
            per_word = np.bincount(np.asarray(word_at, np.int64), minlength=len(coded.words))
            starts = np.cumsum(per_word) - per_word
            at = P.ragged_take(starts, per_word, coded.codes)
            who, what = np.repeat(owner, per_word[coded.codes]), np.asarray(rare_at, np.int64)[at]
            extra = []
            for i in np.flatnonzero(coded.odd).tolist():
                for p in P.odd_pretokens(texts[i].as_py(), P.tokenizer()):
                    if p in table:
                        sums[i] += table[p]
                    else:
                        extra.append((i, rare.setdefault(p, len(rare))))
            if extra:
                who, what = np.append(who, [x[0] for x in extra]), np.append(what, [x[1] for x in extra])
            pairs, freq = np.unique(who * max(1, len(rare)) + what, return_counts=True)
            who, what = pairs // max(1, len(rare)), pairs % max(1, len(rare))
            rid = row_ids(seen, n)
            seen += n
            none = lambda k, kind: pa.nulls(k, kind)
            yield pa.RecordBatch.from_pydict({"rid": rid, "doc_id": block["doc_id"].chunk(0), "n_bytes": pc.binary_length(texts).cast(pa.int64()), "pretoken": none(n, pa.string()), "freq": none(n, pa.int64()), "known": sums})
            if len(what):
                names = pa.array(rare.keys(), pa.string())
                for a in range(0, len(what), 1 << 18):
                    z = slice(a, a + (1 << 18))
                    k = len(what[z])
                    yield pa.RecordBatch.from_pydict({"rid": rid[who[z]], "doc_id": none(k, block["doc_id"].type), "n_bytes": none(k, pa.int64()), "pretoken": names.take(pa.array(what[z])), "freq": freq[z].astype(np.int64), "known": none(k, pa.int64())})

    return run


def token_counts(docs: DataFrame, hot_rows: int = HOT) -> DataFrame:
    """(doc_id, n_bytes, n_tokens) for each row of ``docs`` (doc_id, text)."""
    spark = docs.sparkSession
    vocabulary = stage(pretoken_pieces(docs))
    table = {r[0]: r[1] for r in frequent(vocabulary, "n", hot_rows).select("pretoken", "pieces").collect()}
    hot = spark.sparkContext.broadcast(table)
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", text_or_empty().alias("text")).mapInArrow(_frequencies(hot), f"rid long, doc_id {kind}, n_bytes long, pretoken string, freq long, known long")
    # A document's own row gets a key that no pre-token has, so that these rows spread over all partitions.
    keyed = rows.withColumn("key", F.coalesce("pretoken", F.concat(F.lit(" "), F.col("rid").cast("string"))))
    joined = keyed.join(vocabulary.select(F.col("pretoken").alias("key"), "pieces"), "key", "left")
    return joined.groupBy("rid").agg(
        F.max("doc_id").alias("doc_id"), F.max("n_bytes").alias("n_bytes"), F.sum(F.coalesce(F.col("known"), F.col("freq") * F.col("pieces"))).alias("n_tokens")
    ).drop("rid")
