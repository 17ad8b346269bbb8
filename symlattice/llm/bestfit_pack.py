"""Best-fit decreasing packing of all documents into sequences of a fixed number of tokens.

Lengths are integers up to the capacity, so the lengths' histogram, at most ``capacity`` rows for any corpus, says all
that best fit needs. The packer walks it from the longest length down; a segment tree over remaining capacities finds
the tightest open bin in logarithmic time, and bins of equal remaining capacity, which best fit cannot tell apart, are
filled in one step. Its result is a short list of runs (of a length's pieces ranked ``first`` onwards, ``each`` go into
each bin from ``bin`` on, from ``offset`` on), and every piece finds its place by its rank among the pieces of its
length. Ranks come from counted buckets, so no task holds a length's pieces, however many share it.

Tokenising splits each distinct word of a block once and asks the library for each distinct pre-token once in a worker.
Null or empty texts are their end mark alone; repeated rows are packed as often as they occur.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import pretokens as P
from .common import arrow_rows, blocks, bucket_ranks, row_ids, stage, text_or_empty

CAPACITY = 4096
END = 1
#: Pre-tokens whose ids a worker remembers; beyond that it starts anew.
REMEMBERED = 300_000
BLOCK = 8 << 20


class TightestBin:
    """A segment tree over remaining capacities 0 to ``capacity``; each leaf holds runs of bins with that much room."""

    def __init__(self, capacity: int) -> None:
        self.size = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.size)
        self.runs: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]

    def add(self, room: int, first: int, n: int) -> None:
        self.runs[room].append((first, n))
        i = room + self.size
        while i:
            self.count[i] += n
            i >>= 1

    def tightest(self, need: int) -> int:
        """The least room of at least ``need`` that some bin has, or -1."""
        i = need + self.size
        if self.count[i]:
            return need
        while i > 1:
            if not i & 1 and self.count[i + 1]:
                i += 1
                while i < self.size:
                    i = 2 * i if self.count[2 * i] else 2 * i + 1
                return i - self.size
            i >>= 1
        return -1

    def take(self, room: int, most: int) -> tuple[int, int]:
        """Remove up to ``most`` bins of one run with exactly this room."""
        first, n = self.runs[room].pop()
        got = min(n, most)
        if n > got:
            self.runs[room].append((first + got, n - got))
        i = room + self.size
        while i:
            self.count[i] -= got
            i >>= 1
        return first, got


def best_fit_runs(histogram: list[tuple[int, int]], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first, n, each, bin, offset) runs that pack ``histogram``, (length, pieces) rows, by best-fit decreasing."""
    tree, runs, bins = TightestBin(capacity), [], 0
    for length, n in sorted(histogram, reverse=True):
        rank = 0
        while rank < n:
            room = tree.tightest(length)
            if room < 0:
                fit = capacity // length
                fresh = -(-(n - rank) // fit)
                first, got, room = bins, fresh, capacity
                bins += fresh
            else:
                fit = room // length
                first, got = tree.take(room, -(-(n - rank) // fit))
            # A bin that takes a piece is the tightest for the next one as long as it has room: it is filled before another.
            full = min(got, (n - rank) // fit)
            if full:
                runs.append((length, rank, full * fit, fit, first, capacity - room))
                if room - fit * length:
                    tree.add(room - fit * length, first, full)
                rank += full * fit
            if rank < n and full < got:
                left = min(n - rank, fit)
                runs.append((length, rank, left, fit, first + full, capacity - room))
                if room - left * length:
                    tree.add(room - left * length, first + full, 1)
                rank += left
                if got - full > 1:
                    tree.add(room, first + full + 1, got - full - 1)
    return runs


def _pieces(capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, seen = P.tokenizer(), 0
        known: dict[str, bytes] = {}  # ids as bytes: a tenth of the room of a list
        for block in blocks(batches, BLOCK):
            texts, n = block["text"].chunk(0), block.num_rows
            coded = P.Coded(texts)
            parts = []
            for w in coded.words:
                each = []
                for p in P.SPLIT.findall(w):
                    ids = known.get(p)
                    if ids is None:
                        ids = known[p] = np.asarray(P.piece_ids(p, tok), "<u4").tobytes()
                    each.append(ids)
                parts.append(b"".join(each))
            if len(known) > REMEMBERED:
                known.clear()
            per_word = np.fromiter(map(len, parts), np.int64, len(parts)) // 4
            pool = np.frombuffer(b"".join(parts), "<u4")
            del parts
            stop = np.cumsum(per_word)
            text_end = np.cumsum(coded.per_text)
            rid = row_ids(seen, n)
            seen += n
            out: dict[str, list] = {k: [] for k in ("at", "piece", "start", "length", "ids_crc32")}
            begin = 0
            for i, end in enumerate(text_end.tolist()):
                if coded.odd[i]:
                    ids = np.fromiter((x for p in P.odd_pretokens(texts[i].as_py(), tok) for x in P.piece_ids(p, tok)), np.uint32)
                else:
                    ids = pool[P.ragged_take(stop - per_word, per_word, coded.codes[begin:end])] if end > begin else pool[:0]
                begin = end
                ids = np.append(ids, np.uint32(END)).astype("<u4")
                for k, a in enumerate(range(0, len(ids), capacity)):
                    part = ids[a : a + capacity]
                    out["at"].append(i)
                    out["piece"].append(k)
                    out["start"].append(a)
                    out["length"].append(len(part))
                    out["ids_crc32"].append(zlib.crc32(part.tobytes()))
            at = np.asarray(out.pop("at"), np.int64)
            yield pa.RecordBatch.from_pydict(
                {"rid": rid[at], "doc_id": block["doc_id"].chunk(0).take(pa.array(at)), "piece": pa.array(out["piece"], pa.int32())} | {k: pa.array(out[k], pa.int64()) for k in ("start", "length", "ids_crc32")}
            )

    return run


def token_pieces(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(rid, doc_id, piece, start, length, ids_crc32): each document's ids and the end mark, cut at every ``capacity`` ids."""
    arrow_rows(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", text_or_empty().alias("text")).mapInArrow(_pieces(capacity), f"rid long, doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def best_fit_pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add sequence_id and offset to ``pieces`` (rid, piece, length and more; lengths 1 to ``capacity``)."""
    spark = pieces.sparkSession
    histogram = [(r[0], r[1]) for r in pieces.groupBy("length").agg(F.count("*")).collect()]
    by_length: dict[int, list] = {}
    for length, *run in best_fit_runs(histogram, capacity):
        by_length.setdefault(length, []).append(tuple(run))
    rows = [(k, v) for k, v in by_length.items()]
    runs = spark.createDataFrame(rows, "length long, runs array<struct<first:long,n:long,each:long,bin:long,offset:long>>")
    ranked = bucket_ranks(pieces, ["length"], ["rid", "piece"])
    run = F.element_at(F.filter("runs", lambda r: (r["first"] <= F.col("rank0")) & (F.col("rank0") < r["first"] + r["n"])), 1)
    placed = ranked.join(F.broadcast(runs), "length").withColumn("run", run).withColumn("k", F.col("rank0") - F.col("run.first"))
    return placed.withColumn("sequence_id", F.col("run.bin") + F.floor(F.col("k") / F.col("run.each"))).withColumn(
        "offset", F.col("run.offset") + F.pmod(F.col("k"), F.col("run.each")) * F.col("length")
    ).drop("runs", "run", "k", "rank0")


def pack_documents(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    return best_fit_pack(stage(token_pieces(docs, capacity)), capacity).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
