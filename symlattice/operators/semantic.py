"""Vectors: cosine similarity, reranking with exact hits first, and what is to be embedded."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.shipping import ship

LEAST_COSINE = 0.25
BATCH_TEXTS, BATCH_BYTES = 64, 16_000
#: Rows in a chunk of a group, on average; a batch never spans chunks.
CHUNK_ROWS = 1024


class Embedder(Protocol):
    """What turns texts into vectors; models are the user's."""

    dim: int

    def embed(self, texts: list[str]) -> list[list[float]]: ...


def cosine(vector: Column, query: list[float]) -> Column:
    """Cosine to a literal query vector in double precision; 0 for other lengths, no vector or a zero norm."""
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda x, y: x + y)
    q = F.array(*[F.lit(float(x)) for x in query])
    dot = total(F.zip_with(vector, q, lambda a, b: a.cast("double") * b))
    norm = F.sqrt(total(F.transform(vector, lambda a: a.cast("double") * a.cast("double"))))
    qnorm = sum(float(x) * float(x) for x in query) ** 0.5
    return F.when((F.size(vector) == len(query)) & (norm > 0) & (F.lit(qnorm) > 0), dot / (norm * qnorm)).otherwise(0.0)


def nearest(vectors: DataFrame, query: list[float], limit: int, key: str = "vec_id") -> DataFrame:
    return vectors.select(key, F.round(cosine(F.col("embedding"), query), 5).alias("cosine")).orderBy(F.desc("cosine"), key).limit(limit)


def exact_score(query: str) -> Column:
    """100 for the name, 95 for receiver and name, 90 for the file, in any case; else 0."""
    q, name, recv = query.strip().lower(), F.lower("name"), F.lower("receiver")
    return F.when(name == q, 100).when((recv != "") & (F.concat(recv, F.lit("."), name) == q), 95).when(F.lower("file") == q, 90).otherwise(0)


def rerank(candidates: DataFrame, query: str, vector: list[float], limit: int) -> DataFrame:
    """Candidates (id, name, receiver, file, embedding) with vectors: exact hits first, then those near enough."""
    scored = candidates.filter("embedding is not null").withColumn("exact", exact_score(query)).withColumn("cosine", F.round(cosine(F.col("embedding"), vector), 5))
    return scored.filter((F.col("exact") > 0) | (F.col("cosine") >= LEAST_COSINE)).orderBy(
        F.desc("exact"), F.desc(F.when(F.col("exact") > 0, F.lit(0.0)).otherwise(F.col("cosine"))), "id"
    ).limit(limit)


def node_text() -> Column:
    """What is embedded of a symbol: [Receiver.]Name, its signature and its doc."""
    full = F.when(F.col("receiver") != "", F.concat("receiver", F.lit("."), "name")).otherwise(F.col("name"))
    return F.concat_ws(" ", full, *[F.when(F.col(c) != "", F.col(c)) for c in ("signature", "doc")])


def batch_numbers(sizes: Iterable[int]) -> Iterator[int]:
    """Each text's batch: one closes at BATCH_TEXTS texts or BATCH_BYTES bytes, and the next begins anew."""
    at, n, total = 0, 0, 0
    for x in sizes:
        yield at
        n, total = n + 1, total + x
        if n >= BATCH_TEXTS or total >= BATCH_BYTES:
            at, n, total = at + 1, 0, 0


def embedded(texts: DataFrame, key: str, text: str, embedder: Embedder) -> DataFrame:
    """(key, embedding): the vectors of all texts, by the batches of ``batch_numbers`` in each Arrow block of a partition.

    Nothing is shuffled, and a batch's vectors don't depend on what else is in it. Empty and null texts get zeros and are
    never sent. The embedder travels to the workers once for each task, so one that loads a model loads it there.
    """

    def run(blocks: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks:
            out: list[list[float]] = [[0.0] * embedder.dim] * b.num_rows
            full = [(i, t) for i, t in enumerate(b[text].to_pylist()) if t]
            groups: dict[int, list[tuple[int, str]]] = {}
            for (i, t), n in zip(full, batch_numbers(len(t.encode()) for _, t in full)):
                groups.setdefault(n, []).append((i, t))
            for group in groups.values():
                for (i, _), v in zip(group, embedder.embed([t for _, t in group]), strict=True):
                    out[i] = v
            yield pa.RecordBatch.from_arrays([b[key], pa.array(out, pa.list_(pa.float32()))], names=[key, "embedding"])

    ship(texts.sparkSession)
    return texts.select(key, text).mapInArrow(run, f"`{key}` {texts.schema[key].dataType.simpleString()}, embedding array<float>")


#: Modes of pooling and their numbers; ``unspecified`` leaves it to the model.
POOLING = {"unspecified": -1, "none": 0, "mean": 1, "cls": 2, "last": 3}


def pooled(vectors: Column, mode: str, default: str = "mean") -> Column:
    """One vector of a text's token vectors: their mean, the first (cls) or the last; ``none`` keeps them as they are."""
    mode = default if mode == "unspecified" else mode
    if mode not in POOLING or mode == "unspecified":
        raise ValueError(f"no mode of pooling: {mode}")
    if mode == "none":
        return vectors
    if mode != "mean":
        return F.try_element_at(vectors, F.lit(1 if mode == "cls" else -1))
    doubles = F.transform(vectors, lambda v: F.transform(v, lambda x: x.cast("double")))
    total = F.aggregate(F.slice(doubles, 2, F.greatest(F.size(vectors), F.lit(1))), F.try_element_at(doubles, F.lit(1)), lambda a, v: F.zip_with(a, v, lambda x, y: x + y))
    return F.when(F.size(vectors) > 0, F.transform(total, lambda x: x / F.size(vectors)))


def embed_batches(texts: DataFrame, group: str, order: str, size: str, chunk: Column | None = None) -> DataFrame:
    """The texts that aren't empty, with ``chunk`` and ``batch``: a batch closes at BATCH_TEXTS texts or BATCH_BYTES bytes.

    A group falls into chunks, so none goes through one task: by ``chunk`` or else by a hash of ``order``, about CHUNK_ROWS
    each. In a chunk texts stand in order, and each batch begins where the last one closed.
    """

    def close(t):
        t = t.sort_by(order)
        return t.append_column("batch", pa.array(batch_numbers(t[size].to_pylist()), pa.int64()))

    full = texts.filter(F.col(size) > 0)
    if chunk is not None:
        dealt = full.withColumn("chunk", chunk)
    else:
        chunks = full.groupBy(F.col(group).alias("_g")).agg(F.ceil(F.count("*") / CHUNK_ROWS).alias("_k"))
        dealt = full.join(chunks, F.col(group).eqNullSafe(F.col("_g"))).withColumn("chunk", F.pmod(F.xxhash64(order), F.col("_k"))).drop("_g", "_k")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in dealt.schema)
    return dealt.groupBy(group, "chunk").applyInArrow(close, f"{kinds}, batch long")
