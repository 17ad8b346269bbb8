"""Removal of repeated passages by distributed prefix doubling.

A byte goes if a string of ``LENGTH`` bytes covers it that also starts in a document with a smaller id. Such strings are
suffixes' prefixes of that length, so positions are ranked by growing prefixes until they are unique or the length is
reached: first by ``FIRST`` bytes, then by pairs of ranks at offset ``FIRST``, then by pairs that end at ``LENGTH``. Ranks
are names, equal for equal prefixes (64-bit hashes), as only equality matters here.

* First ranks. Of the ``LENGTH - FIRST + 1`` names within a string, the least one stands for it, so equal strings have
  equal least names; neighbouring positions mostly share theirs and form a run. Runs meet by their names (delta-coded
  in blocks, one group for each range of names), and those whose name no other document has are unique and drop out.
* Pairs. Spark deals the runs that are left, with the bytes that they span, by name and sorts them; each task walks its
  sorted names, pairs ranks at the growing offsets, ranks the pairs anew and drops what is unique after each round. At
  the full length, a position whose rank a smaller document has is covered.

Before they are dealt, equal strings within a block of documents are settled there, so a passage in a third of all
documents sends a few rows for each block, not one for each document.

Null and empty texts keep nothing and lose nothing. Rows with a null doc_id neither lose bytes nor take any. Rows that
share a doc_id never take bytes from each other. Other columns are not carried along.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, blocks, row_ids, text_or_empty
from .pretokens import ragged_take

LENGTH, FIRST = 50, 24
#: Positions of a run at most: as many as a mask has bits.
RUN = 63
#: Bytes of text in a block: each takes some 40 bytes of a worker's memory.
BLOCK = 6 << 20
#: Bytes of text for each group of names.
GROUP = 48 << 20
#: Names meet by their upper bits; a chance meeting only adds a run to look at.
DROPPED = np.uint64(16)
_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xBF58476D1CE4E5B9))


def pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Names for pairs of names."""
    h = (a * _A) ^ (b + _B)
    h ^= h >> np.uint64(31)
    h *= _C
    return h ^ (h >> np.uint64(29))


#: Positions that are named at a time: what stands between texts and names stays in a core's cache.
CHUNK = 1 << 17


def first_names(data: np.ndarray) -> np.ndarray:
    """The name of the FIRST bytes from each position on; beyond the end stand zeros."""
    n = len(data)
    padded, names = np.zeros(n + 40, np.uint8), np.empty(n, np.uint64)
    padded[:n] = data
    for a in range(0, n, CHUNK):
        k = min(CHUNK, n - a)
        words = np.empty(k + 24, np.uint64)
        for i in range(8):
            size = (len(words) - i + 7) // 8
            words[i::8] = np.frombuffer(padded[a + i : a + i + 8 * size].tobytes().ljust(8 * size, b"\0"), "<u8")
        names[a : a + k] = pair(pair(words[:k], words[8 : k + 8]), words[16 : k + 16])
    return names


def least_names(names: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` names in a row."""
    out = np.empty(len(names) - width + 1, np.uint64)
    for a in range(0, len(out), CHUNK):
        m, j = names[a : a + CHUNK + width - 1], 1
        while 2 * j <= width:
            m, j = np.minimum(m[:-j], m[j:]), 2 * j
        out[a : a + CHUNK] = np.minimum(m[: len(m) - (width - j)], m[width - j :])
    return out


class Runs:
    """The runs of a block of byte strings: each one's least name, owner, first position and length."""

    def __init__(self, texts: list[bytes]) -> None:
        size = np.fromiter(map(len, texts), np.int64, len(texts))
        self.data = np.frombuffer(b"".join(texts), np.uint8)
        self.starts = np.cumsum(size) - size
        n = len(self.data)
        self.names = first_names(self.data)
        self.least = self.owner = self.at = self.length = np.zeros(0, np.int64)
        self.first_run = np.zeros(len(texts) + 1, np.int64)
        if n < LENGTH:
            return
        m = least_names(self.names, LENGTH - FIRST + 1)
        inside = np.zeros(n + 1, np.int8)
        long = size >= LENGTH
        np.add.at(inside, self.starts[long], 1)
        np.add.at(inside, (self.starts + size - LENGTH + 1)[long], -1)
        inside = np.cumsum(inside[:-1], dtype=np.int8) > 0
        begin = np.zeros(n, bool)
        begin[0] = True
        begin[1 : len(m)] = m[1:] != m[:-1]
        begin[self.starts[size > 0]] = True
        begin[1:] |= inside[1:] != inside[:-1]
        at = np.flatnonzero(begin)
        length = np.diff(np.append(at, n))
        cut = -(-length // RUN)
        if (cut > 1).any():
            at = np.repeat(at, cut) + RUN * ragged_take(np.zeros(len(cut), np.int64), cut, np.arange(len(cut)))
            length = np.diff(np.append(at, n))
        keep = inside[at]
        self.at, self.length = at[keep], length[keep]
        # Least names lie close to 0; mixed once more they spread evenly over all groups.
        self.least = pair(m[self.at], np.zeros(len(self.at), np.uint64))
        self.owner = np.searchsorted(self.starts, self.at, "right") - 1
        # Empty texts share their start with the next one, which is the owner.
        self.first_run = np.searchsorted(self.owner, np.arange(len(texts) + 1))


def _planes(x: np.ndarray) -> bytes:
    """Numbers by byte planes: the upper planes of small numbers are zeros, which shuffles compress away."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes()


def _numbers(b: bytes, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(size, -1).T).view(kind).ravel()


_MANY = np.uint32(1 << 31)


def _name_groups(groups: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = 0
        for table in blocks(batches, BLOCK):
            runs = Runs([x.as_buffer().to_pybytes() if x.is_valid else b"" for x in table["text"].chunk(0)])
            upper = runs.least.astype(np.uint64) >> DROPPED
            order = np.argsort(upper, kind="stable")
            names, owner = upper[order], runs.owner[order]
            first = np.flatnonzero(np.append(True, names[1:] != names[:-1])) if len(names) else np.zeros(0, np.int64)
            if len(first):
                many = np.minimum.reduceat(owner, first) != np.maximum.reduceat(owner, first)
                of = np.repeat(many, np.diff(np.append(first, len(names))))
            else:
                many, of = np.zeros(0, bool), np.zeros(0, bool)
            settled = np.sort(order[of])
            sent = np.concatenate([first[many], np.flatnonzero(~of)])
            flags = np.concatenate([np.full(int(many.sum()), _MANY), np.zeros(int((~of).sum()), np.uint32)]).astype(np.uint32)
            by = np.argsort(names[sent], kind="stable")
            sent, flags = sent[by], flags[by]
            values, index = names[sent], order[sent].astype(np.uint32) | flags
            edges = np.searchsorted(values, (np.arange(1, groups) * ((1 << 64 - int(DROPPED)) // groups)).astype(np.uint64)) if groups > 1 else np.zeros(0, np.int64)
            cuts = [0, *edges.tolist(), len(values)]
            # What turns runs into documents goes along once, with the group that the block calls home.
            home = int(row_ids(seen, 1)[0] % groups)
            blk = int(row_ids(seen, 1)[0])
            seen += 1
            out = {"grp": [], "names": [], "index": [], "first": [], "settled": [], "ids": [], "th": []}
            for g in np.union1d(np.flatnonzero(np.diff(cuts)), home).tolist():
                out["grp"].append(g)
                out["names"].append(_planes(np.diff(values[cuts[g] : cuts[g + 1]], prepend=np.uint64(0))))
                out["index"].append(_planes(index[cuts[g] : cuts[g + 1]]))
                out["first"].append(_planes(runs.first_run.astype(np.uint32)) if g == home else b"")
                out["settled"].append(_planes(settled.astype(np.uint32)) if g == home else b"")
                out["ids"].append(table["doc_id"].chunk(0).to_pylist() if g == home else [])
                out["th"].append(table["th"].chunk(0).to_pylist() if g == home else [])
            yield pa.RecordBatch.from_pydict(
                {"grp": pa.array(out["grp"], pa.int32()), "blk": pa.array([blk] * len(out["grp"]), pa.int64())} | {k: pa.array(out[k], pa.binary()) for k in ("names", "index", "first", "settled")}
                | {"ids": pa.array(out["ids"], pa.list_(table["doc_id"].type)), "th": pa.array(out["th"], pa.list_(pa.int64()))}
            )

    return run


def _met(table: pa.Table) -> pa.Table:
    """For each block in one group of names, its runs whose name another document has, too."""
    names, index, block = [], [], []
    for i, (a, b) in enumerate(zip(table["names"].to_pylist(), table["index"].to_pylist())):
        v = np.cumsum(_numbers(a, np.uint64), dtype=np.uint64)
        names.append(v)
        index.append(_numbers(b, np.uint32))
        block.append(np.full(len(v), i, np.int64))
    names, index, block = map(np.concatenate, (names, index, block))
    many, run = (index & _MANY) > 0, index & ~_MANY
    # Within a block, names of more than one document are flagged, so names from two blocks or flagged ones are repeated.
    order = np.argsort(names, kind="stable")
    s, b, m = names[order], block[order], many[order]
    first = np.flatnonzero(np.append(True, s[1:] != s[:-1])) if len(s) else np.zeros(0, np.int64)
    found = np.zeros(len(s), bool)
    if len(first):
        again = (np.minimum.reduceat(b, first) != np.maximum.reduceat(b, first)) | np.logical_or.reduceat(m, first)
        found[order] = np.repeat(again, np.diff(np.append(first, len(s))))
    found &= ~many
    edges = np.searchsorted(block, np.arange(table.num_rows + 1))
    runs = [_planes(np.sort(run[a:z][found[a:z]])) for a, z in zip(edges[:-1].tolist(), edges[1:].tolist())]
    return table.select(["blk", "first", "settled", "ids", "th"]).append_column("runs", pa.array(runs, pa.binary()))


def _by_document(table: pa.Table) -> pa.Table:
    """(doc_id, th, runs) for a block's documents, from what all groups found."""
    home = next(i for i, f in enumerate(table["first"].to_pylist()) if f)
    first = _numbers(table["first"][home].as_py(), np.uint32).astype(np.int64)
    parts = [_numbers(x, np.uint32) for c in ("runs", "settled") for x in table[c].to_pylist()]
    got = np.sort(np.concatenate(parts)).astype(np.int64)
    doc = np.searchsorted(first, got, "right") - 1
    cut = np.flatnonzero(np.diff(doc, prepend=-1))
    at = pa.array(doc[cut])
    local = pa.ListArray.from_arrays(pa.array(np.append(cut, len(got)).astype(np.int32)), pa.array((got - first[doc]).astype(np.int32)))
    return pa.table({"doc_id": table["ids"][home].values.take(at), "th": table["th"][home].values.take(at), "runs": local})


def repeated_runs(docs: DataFrame, groups: int) -> DataFrame:
    """(doc_id, th, runs): the runs of each document whose first rank another document has."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    tables = f"first binary, settled binary, ids array<{kind}>, th array<long>"
    dealt = docs.mapInArrow(_name_groups(groups), f"grp int, blk long, names binary, index binary, {tables}")
    met = dealt.groupBy("grp").applyInArrow(_met, f"blk long, {tables}, runs binary")
    return met.groupBy("blk").applyInArrow(_by_document, f"doc_id {kind}, th long, runs array<int>")


def covered(rank: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Which positions have a rank that a smaller document has, too."""
    order = np.argsort(rank, kind="stable")
    s, d = rank[order], doc[order]
    first = np.flatnonzero(np.append(True, s[1:] != s[:-1]))
    out = np.empty(len(rank), bool)
    out[order] = d > np.repeat(np.minimum.reduceat(d, first), np.diff(np.append(first, len(s))))
    return out


def shared(rank: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Which positions have a rank that another document has."""
    order = np.argsort(rank, kind="stable")
    s, d = rank[order], doc[order]
    first = np.flatnonzero(np.append(True, s[1:] != s[:-1]))
    out = np.empty(len(rank), bool)
    out[order] = np.repeat(np.minimum.reduceat(d, first) != np.maximum.reduceat(d, first), np.diff(np.append(first, len(s))))
    return out


def double(names: np.ndarray, at: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Which of the positions ``at`` start a LENGTH-byte string that a smaller document has, by doubling their prefixes."""
    left, length, rank = np.arange(len(at), dtype=np.int32), FIRST, names[at]
    while length < LENGTH and len(left):
        offset = min(length, LENGTH - length)
        # The second of a pair is the first rank that ends where the longer prefix ends.
        rank = pair(rank, names[at[left] + length + offset - FIRST])
        length += offset
        keep = shared(rank, doc[left])
        left, rank = left[keep], rank[keep]
    out = np.zeros(len(at), bool)
    if len(left):
        out[left] = covered(rank, doc[left])
    return out


def _masks(run: np.ndarray, place: np.ndarray, yes: np.ndarray, n: int) -> np.ndarray:
    """For each run, the bits of its positions that are covered."""
    bits = np.where(yes, np.uint64(1) << place.astype(np.uint64), np.uint64(0))
    out = np.zeros(n, np.uint64)
    if len(run):
        first = np.flatnonzero(np.diff(run, prepend=-1))
        out[run[first]] = np.bitwise_or.reduceat(bits, first)
    return out


def _settle(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _settled(batches, buckets)

    return run


def _settled(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """Settle what a block can, and send on the runs with positions for which it is the block's smallest document."""
    for table in blocks(batches, BLOCK):
        runs = Runs([x.as_buffer().to_pybytes() for x in table["text"].chunk(0)])
        wanted = table["runs"].chunk(0)
        per = np.diff(wanted.offsets.to_numpy())
        picked = np.unique(np.repeat(runs.first_run[:-1], per) + wanted.flatten().to_numpy())
        ids, th = table["doc_id"].chunk(0).to_numpy(), table["th"].chunk(0).to_numpy()
        at, length, owner, least = (x[picked] for x in (runs.at, runs.length, runs.owner, runs.least))
        k = np.repeat(np.arange(len(picked)), length)
        place = ragged_take(np.zeros(len(picked), np.int64), length, np.arange(len(picked)))
        here = double(runs.names, at[k] + place, ids[owner[k]])
        done = _masks(k, place, here, len(picked))
        local = at - runs.starts[owner]
        open_k, open_place = k[~here], place[~here]
        first = np.flatnonzero(np.diff(open_k, prepend=-1))
        r, lo = open_k[first], open_place[first]
        hi = open_place[np.append(first[1:], len(open_k)) - 1] if len(first) else lo
        done_at = np.flatnonzero(done)
        # Settled masks and open spans, bundled by bucket: compressed together, neighbouring texts take little room.
        which = np.concatenate([pair(least[done_at], done[done_at]), least[r]]) % np.uint64(buckets)
        order = np.argsort(which, kind="stable")
        edges = np.searchsorted(which[order], np.arange(buckets + 1))
        run = np.concatenate([done_at, r])
        begin = np.concatenate([np.zeros(len(done_at), np.int64), lo])
        size = np.concatenate([np.zeros(len(done_at), np.int64), hi - lo + LENGTH])
        mask = np.concatenate([done[done_at], np.zeros(len(r), np.uint64)])
        data = runs.data.tobytes()
        out = {"bucket": [], "bundle": []}
        for g in np.flatnonzero(np.diff(edges)):
            x = order[edges[g] : edges[g + 1]]
            x = x[np.argsort(run[x], kind="stable")]
            q = run[x]
            o = owner[q]
            spans = b"".join(data[a:z] for a, z in zip((at[q] + begin[x]).tolist(), (at[q] + begin[x] + size[x]).tolist()))
            columns = (least[q], ids[o].astype(np.int64), th[o], (local[q] + begin[x]).astype(np.uint32), mask[x], size[x].astype(np.uint32))
            raw = b"".join(map(_planes, columns)) + spans
            out["bucket"].append(int(g))
            out["bundle"].append(len(x).to_bytes(4, "little") + len(raw).to_bytes(4, "little") + pa.compress(raw, "zstd", asbytes=True))
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(out["bucket"], pa.int32()), "bundle": pa.array(out["bundle"], pa.binary())})


def _unbundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for bundle in b["bundle"].to_pylist():
            n, size = int.from_bytes(bundle[:4], "little"), int.from_bytes(bundle[4:8], "little")
            raw, columns, at = pa.decompress(bundle[8:], size, "zstd", asbytes=True), [], 0
            for kind in (np.int64, np.int64, np.int64, np.uint32, np.int64, np.uint32):
                width = np.dtype(kind).itemsize * n
                columns.append(_numbers(raw[at : at + width], kind))
                at += width
            m, ids, th, s, mask, length = columns
            offsets = np.concatenate([[0], np.cumsum(length)]).astype(np.int32)
            spans = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(raw[at:])])
            yield pa.RecordBatch.from_pydict({"m": m, "doc_id": ids, "th": th, "s": s.astype(np.int64), "mask": mask, "bytes": pc.if_else(pa.array(length > 0), spans, pa.scalar(None, pa.binary()))})


def _rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Walk runs sorted by name; a chunk ends where a name does."""

    def ranked(t: pa.Table) -> pa.RecordBatch:
        spans = t["bytes"].chunk(0)
        size = pc.binary_length(spans).to_numpy().astype(np.int64)
        data = np.frombuffer(b"".join(x.as_buffer() for x in spans), np.uint8)
        starts = np.cumsum(size) - size
        n = size - LENGTH + 1
        k = np.repeat(np.arange(len(n)), n)
        place = ragged_take(np.zeros(len(n), np.int64), n, np.arange(len(n)))
        ids = t["doc_id"].chunk(0).to_numpy()
        mask = _masks(k, place, double(first_names(data), starts[k] + place, ids[k]), len(n))
        return pa.RecordBatch.from_arrays([t["doc_id"].chunk(0), t["th"].chunk(0), t["s"].chunk(0), pa.array(mask.view(np.int64))], names=["doc_id", "th", "s", "mask"]).filter(pa.array(mask > 0))

    held: list[pa.RecordBatch] = []
    rows = 0
    for b in batches:
        whole = b["bytes"].is_null()
        yield b.select(["doc_id", "th", "s", "mask"]).filter(whole)
        b = b.filter(pc.invert(whole))
        if not b.num_rows:
            continue
        m = b["m"].to_numpy()
        if rows >= 1 << 16:
            last = held[-1]["m"][-1].as_py()
            cut = int(np.searchsorted(m != last, True)) if (m != last).any() else len(m)
            if cut < len(m):
                yield ranked(pa.Table.from_batches([*held, b.slice(0, cut)]).combine_chunks())
                held, rows, b = [], 0, b.slice(cut)
        held.append(b)
        rows += b.num_rows
    if held:
        yield ranked(pa.Table.from_batches(held).combine_chunks())


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = {"n_bytes": [], "n_removed": [], "n_spans": [], "kept_sha256": []}
        for text, found in zip(b["text"], b["found"]):
            raw = text.as_buffer().to_pybytes()
            gone = np.zeros(len(raw) + 1, np.int32)
            if found.is_valid:
                s = found.values.field("s").to_numpy()
                mask = found.values.field("mask").to_numpy()
                bits = np.unpackbits(np.ascontiguousarray(mask).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
                row, place = np.nonzero(bits)
                at = s[row] + place
                np.add.at(gone, at, 1)
                np.add.at(gone, at + LENGTH, -1)
            gone = np.cumsum(gone[:-1]) > 0
            kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
            out["n_bytes"].append(len(raw))
            out["n_removed"].append(int(gone.sum()))
            out["n_spans"].append(int((gone & ~np.append(False, gone[:-1])).sum()) if len(raw) else 0)
            out["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
        yield pa.RecordBatch.from_pydict({"doc_id": b["doc_id"]} | {k: pa.array(v, pa.string() if k == "kept_sha256" else pa.int64()) for k, v in out.items()})


def removed_passages(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) for each row of ``docs``."""
    arrow_rows(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    texts = docs.select("doc_id", text_or_empty().alias("text")).withColumn("th", F.hash("text").cast("long"))
    known = texts.filter("doc_id is not null")
    total = known.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    groups = max(4, -(-total // GROUP))
    runs = repeated_runs(known, groups).groupBy("doc_id", "th").agg(F.flatten(F.collect_list("runs")).alias("runs"))
    # Both joins deal the same texts by the same keys, so Spark shuffles them once. Merged at any size: one plan for all.
    sent = known.join(runs.hint("merge"), ["doc_id", "th"]).mapInArrow(_settle(groups), "bucket int, bundle binary")
    dealt = sent.repartition("bucket").mapInArrow(_unbundle, "m long, doc_id long, th long, s long, mask long, bytes binary")
    ranked = dealt.withColumn("doc_id", F.col("doc_id").cast(kind)).sortWithinPartitions("m").mapInArrow(_rank, f"doc_id {kind}, th long, s long, mask long")
    found = ranked.groupBy("doc_id", "th").agg(F.collect_list(F.struct("s", "mask")).alias("found"))
    both = known.join(found.hint("merge"), ["doc_id", "th"], "left").unionByName(texts.filter("doc_id is null"), allowMissingColumns=True)
    return both.mapInArrow(_cut, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
