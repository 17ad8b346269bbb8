"""MinHash near-duplicates: one-permutation hashing, optimal densification, banded buckets and star-shaped candidates.

A document's set holds the 64-bit hashes of its distinct 3-word shingles. Rows with equal sets form a class, and only one
of them goes on. One permutation splits the hash range into bins, whose minima are the signature; an empty bin borrows
from a bin that a fixed random sequence names first among the filled ones. Bands of the signature name buckets. In each
bucket a random member, another one in each band, is the centre of a star of candidate pairs, so a bucket of n gives
n - 1 pairs. Pairs are confirmed on the full sets.

A star can miss a link between two members neither of which is the centre. That matters only if they end up in
different components, so the members of buckets in which several components meet go through a prefix-filtered join, which
finds every such link among them (see ``leftover_links``).

Components come from alternating large-star and small-star steps on edge tables in the shared folder.

Null and empty texts have an empty set and are linked with nothing. A null doc_id is linked with nothing and is kept.
Rows that share a doc_id are judged each by its own text. Other columns are not carried along.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, blocks, row_hash, row_ids, stage, text_or_empty, unstage

SHINGLE = 3
#: Links have 100 * intersection >= PERCENT * union.
PERCENT = 85
BINS, BANDS, ROWS = 128, 25, 5
#: Sizes of sets fall into levels, each so many times the one below, in the join of what stars leave.
LEVEL = 1.04
#: Central members of a shingle's largest component that others are compared with before all that may be linked is.
CENTRES = 8
BLOCK = 6 << 20
_M = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _M[1]
    h = (h ^ (h >> np.uint64(27))) * _M[2]
    return h ^ (h >> np.uint64(31))


def shingle_sets(texts: pa.Array, size: int = SHINGLE) -> Iterator[np.ndarray]:
    """Each text's sorted distinct shingle hashes; the whole sequence as one if it has fewer words; none without words."""
    split = pc.ascii_split_whitespace(pc.ascii_lower(texts.cast(pa.large_string())))
    flat = split.flatten().dictionary_encode()
    names = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in flat.dictionary.to_pylist()), np.uint64, len(flat.dictionary))
    real = pc.not_equal(flat.dictionary, "").to_numpy(zero_copy_only=False)
    codes = flat.indices.to_numpy()
    words, real, ends = names[codes], real[codes], split.offsets.to_numpy()
    for a, b in zip(ends[:-1].tolist(), ends[1:].tolist()):
        w = words[a:b]
        if not (real[a:b].all() if b > a else True):
            w = w[real[a:b]]
        n = len(w) - size + 1
        if not len(w):
            yield w
        else:
            h = np.zeros(max(1, n), np.uint64)
            for i in range(min(size, len(w))):
                h = mixed(h * _M[0] + w[i : i + len(h)])
            yield np.unique(h)


_SEQUENCES = np.random.default_rng(12).integers(0, BINS, (BINS, 256))


def signature(s: np.ndarray) -> np.ndarray:
    """Bin minima of a non-empty sorted set, densified."""
    bins = (s >> np.uint64(57)).astype(np.int64)
    first = np.flatnonzero(np.diff(bins, prepend=-1))
    sig, filled = np.zeros(BINS, np.uint64), np.zeros(BINS, bool)
    sig[bins[first]], filled[bins[first]] = s[first], True
    empty = np.flatnonzero(~filled)
    if len(empty):
        hit = filled[_SEQUENCES[empty]]
        at = _SEQUENCES[empty, hit.argmax(1)]
        lost = ~hit.any(1)  # the next filled bin, for the few that the sequence doesn't reach
        at[lost] = bins[first][np.searchsorted(bins[first], empty[lost]) % len(first)]
        sig[empty] = sig[at]
    return sig


def band_keys(sig: np.ndarray) -> np.ndarray:
    rows = sig[: BANDS * ROWS].reshape(BANDS, ROWS)
    h = np.arange(BANDS, dtype=np.uint64) * _M[1]
    for i in range(ROWS):
        h = mixed(h * _M[0] + rows[:, i])
    return h.view(np.int64)


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen = 0
    for block in blocks(batches, BLOCK):
        keys, sizes, bands = [], [], []
        for s in shingle_sets(block["text"].chunk(0)):
            sizes.append(len(s))
            keys.append(hashlib.md5(s.tobytes()).digest() if len(s) else None)
            bands.append(band_keys(signature(s)) if len(s) else None)
        same = {c: block[c].chunk(0) for c in ("doc_id", "th")}
        yield pa.RecordBatch.from_pydict({"rid": row_ids(seen, len(keys))} | same | {"key": pa.array(keys, pa.binary()), "n_shingles": pa.array(sizes, pa.int64()), "bands": pa.array(bands, pa.list_(pa.int64()))})
        seen += len(keys)


def _hashed(docs: DataFrame) -> DataFrame:
    """(doc_id, th, text): rows with a hash that tells the texts of one doc_id apart."""
    return docs.select("doc_id", text_or_empty().alias("text")).select("doc_id", F.xxhash64("text").alias("th"), "text")


def sketches(docs: DataFrame) -> DataFrame:
    """(rid, doc_id, th, key, n_shingles, bands): the class key of each row's set, its size and its buckets."""
    arrow_rows(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return _hashed(docs).mapInArrow(_sketch, f"rid long, doc_id {kind}, th long, key binary, n_shingles long, bands array<long>")


def star_pairs(buckets: DataFrame) -> DataFrame:
    """(a, b) with a < b: each bucket's centre with each other member; buckets are (bucket, id, n) rows."""
    centre = buckets.groupBy("bucket").agg(F.min(F.struct(F.xxhash64("bucket", "id").alias("h"), F.col("id"), F.col("n"))).alias("c"), F.count("*").alias("k")).filter("k > 1")
    pairs = buckets.join(centre.select("bucket", F.col("c.id").alias("c"), F.col("c.n").alias("cn")), "bucket").filter("id <> c")
    return _like_sized(pairs, "n", "cn").select(F.least("id", "c").alias("a"), F.greatest("id", "c").alias("b")).distinct()


def _like_sized(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Sets that differ more in size than links allow can't be linked."""
    return pairs.filter(F.least(a, b) * 100 >= F.greatest(a, b) * PERCENT)


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for block in blocks(batches, BLOCK):
        yield pa.RecordBatch.from_pydict({"id": block["id"].chunk(0), "shingles": pa.array([s.tobytes() for s in shingle_sets(block["text"].chunk(0))], pa.binary())})


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ok = []
        for x, y in zip(b["sa"], b["sb"]):
            x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
            at = np.searchsorted(y, x)
            both = int((y[np.minimum(at, len(y) - 1)] == x).sum())
            ok.append(100 * both >= PERCENT * (len(x) + len(y) - both))
        yield b.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))


def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The candidate pairs whose full sets are similar enough."""
    left = pairs.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("sa")), "a")
    both = left.join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("sb")), "b")
    return both.select("a", "b", "sa", "sb").mapInArrow(_confirm, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(id, component) for every node of ``edges`` (a, b): the smallest id that it reaches."""
    now = stage(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct())
    mark = None
    while True:
        # Large star: every larger neighbour of a node moves to the least id among the node and its neighbours.
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        # Small star: a node and its smaller neighbours move to the least of them.
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b"))).filter("a <> b").distinct()
        then, now = now, stage(small)
        unstage(then)
        got = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if got == mark:
            break
        mark = got
    roots = now.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
    return now.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(roots)


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        sets = [np.frombuffer(v.as_buffer(), np.int64) for v in b["shingles"]]
        sizes = np.fromiter(map(len, sets), np.int64, len(sets))
        at = pa.array(np.repeat(np.arange(len(sets)), sizes))
        yield pa.RecordBatch.from_pydict({"id": b["id"].take(at), "component": b["component"].take(at), "n": np.repeat(sizes, sizes), "shingle": np.concatenate([np.zeros(0, np.int64), *sets])})


def prefixes(sets: DataFrame) -> DataFrame:
    """(id, component, n, at, shingle): of each set (id, component, shingles), the prefix in which links have to meet.

    Shingles that only one component has come first, then rare ones: any order that all sets share would do. Two sets
    with enough in common share one of their first n - ceil(n * PERCENT / 100) + 1 shingles. Those of one component
    are no keys, but take their places.
    """
    terms = sets.select("id", "component", "shingles").mapInArrow(_listed, "id long, component long, n long, shingle long")
    met = terms.groupBy("shingle").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("df")).filter("lo <> hi").select("shingle", "df")
    own = terms.join(met.hint("merge"), "shingle").groupBy("id").agg(F.first("component").alias("component"), F.first("n").alias("n"), F.sort_array(F.collect_list(F.struct("df", "shingle"))).alias("own"))
    alone = F.col("n") - F.size("own")
    most = F.col("n") - F.expr(f"(n * {PERCENT} + 99) div 100") + 1 - alone
    first = F.when(most > 0, F.slice("own", F.lit(1), F.greatest(most, F.lit(1)).cast("int")))
    return own.select("id", "component", "n", alone.alias("alone"), F.posexplode(first).alias("k", "x")).select("id", "component", "n", (F.col("alone") + F.col("k")).alias("at"), F.col("x.shingle").alias("shingle"))


def _similar_at(pairs: DataFrame) -> DataFrame:
    """(a, b) for pairs of rows of ``prefixes`` that meet in a shingle and may be links.

    At the first shingle that two sets share, what stands before it on either side is not in both.
    """
    most = F.least(F.col("n") - F.col("at"), F.col("o_n") - F.col("o_at"))
    found = _like_sized(pairs, "n", "o_n").filter(most * 100 >= (F.col("n") + F.col("o_n") - most) * PERCENT)
    return found.select(F.least("id", "o_id").alias("a"), F.greatest("id", "o_id").alias("b")).distinct()


def central_pairs(rows: DataFrame) -> DataFrame:
    """Each row of ``prefixes`` outside a shingle's largest component with that component's most central members there.

    The fewer shingles stand before the common one, the closer a set is to all others that have it. Most of what stars
    missed is found here, with a few rows for each row.
    """
    here = rows.groupBy("shingle", "component").count()
    main = here.groupBy("shingle").agg(F.max_by("component", "count").alias("main"), F.count("*").alias("k")).filter("k > 1").drop("k")
    tagged = rows.join(main, "shingle")
    slot = F.pmod(F.xxhash64("id", "shingle"), F.lit(CENTRES))
    centres = tagged.filter("component = main").groupBy("shingle", slot.alias("slot")).agg(F.min(F.struct("at", F.xxhash64("id", "shingle").alias("h"), "id", "n")).alias("o"))
    centres = centres.select("shingle", F.col("o.id").alias("o_id"), F.col("o.n").alias("o_n"), F.col("o.at").alias("o_at"))
    return _similar_at(tagged.filter("component <> main").join(centres, "shingle"))


def _levelled(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows of ``prefixes`` as the smaller and as the larger set of a pair, each with the levels of size where they meet.

    A place in a prefix bounds the sizes of the sets that it can link: the smaller set of a pair shows its own size's
    level, the larger one all levels that it can link there, and most places have none.
    """
    level = lambda n: F.floor(F.log(n.cast("double")) / float(np.log(LEVEL)))
    # most * 100 >= (n + m - most) * PERCENT, solved for the size of the other set.
    fits = F.expr(f"(n - at) * {100 + PERCENT} div {PERCENT} - n")
    small = rows.filter(fits >= F.col("n")).withColumn("level", level(F.col("n")))
    least, greatest = F.expr(f"(n * {PERCENT} + 99) div 100"), F.least("n", fits)
    large = rows.withColumn("least", least).withColumn("most", greatest).filter("least <= most and most > 0").withColumn("level", F.explode(F.sequence(level(F.col("least")), level(F.col("most"))))).drop("least", "most")
    return small, large


def component_pairs(small: DataFrame, large: DataFrame) -> DataFrame:
    """(id, component, n, other): each set with the other components that have a set which it meets in a prefix.

    A component shows itself once at each shingle and level, with its sizes and its best place, so a set meets as many
    rows there as there are components, however many members they have.
    """

    def met(own: DataFrame, others: DataFrame) -> DataFrame:
        best = F.max(F.col("n") - F.col("at")).alias("most")
        whole = others.groupBy("shingle", "level", F.col("component").alias("other")).agg(best, F.min("n").alias("lo"), F.max("n").alias("hi"))
        most = F.least(F.col("n") - F.col("at"), F.col("most"))
        may = (F.col("component") != F.col("other")) & (most * 100 >= (F.col("n") + F.col("lo") - most) * PERCENT) & (F.col("lo") * PERCENT <= F.col("n") * 100) & (F.col("hi") * 100 >= F.col("n") * PERCENT)
        return own.join(whole, ["shingle", "level"]).filter(may).select("id", "component", "n", "other")

    return met(small, large).unionByName(met(large, small)).distinct()


def linkable(pairs: DataFrame, full: DataFrame) -> DataFrame:
    """The rows (id, component, other) of ``component_pairs`` that a link may join, by what a set has in common with all of a component.

    No member of a component has more in common with a set than all its members together. Where that is too little, the
    set meets none of them one by one, so groups of copies that are alike but not enough cost a look for each copy.
    """
    sizes = full.groupBy("component").agg(F.count("*").alias("members"), F.min("n").alias("lo"), F.max("n").alias("hi")).withColumnRenamed("component", "other")
    known = stage(pairs.join(sizes, "other"))
    several = known.filter("members > 1")
    ids, groups = several.select("id").distinct(), several.select(F.col("other").alias("component")).distinct()
    own = full.join(ids, "id").select("id", "component", "shingles").mapInArrow(_listed, "id long, component long, n long, shingle long").select("id", "shingle")
    whole = full.join(groups, "component").select("id", "component", "shingles").mapInArrow(_listed, "id long, component long, n long, shingle long").select(F.col("component").alias("other"), "shingle").distinct()
    common = several.join(own, "id").join(whole, ["other", "shingle"]).groupBy("id", "other").agg(F.count("*").alias("both"))
    size = F.greatest("lo", F.least("both", "hi"))
    left = several.join(common, ["id", "other"]).filter(F.col("both") * 100 >= (F.col("n") + size - F.least("both", size)) * PERCENT)
    return known.filter("members = 1").select("id", "component", "other").unionByName(left.select("id", "component", "other"))


def leftover_pairs(rows: DataFrame, full: DataFrame) -> DataFrame:
    """All pairs of rows of ``prefixes`` that may link two components; ``full`` are the sets (id, component, n, shingles)."""
    small, large = _levelled(rows)
    may = stage(linkable(component_pairs(small, large), full))
    ours = small.join(may.select("id", "other"), "id")
    theirs = large.join(may.select("id", "other"), "id").select("shingle", "level", F.col("component").alias("other"), F.col("other").alias("component"), *[F.col(c).alias(f"o_{c}") for c in ("id", "n", "at")])
    return _similar_at(ours.join(theirs, ["shingle", "level", "component", "other"]).filter("n < o_n or n = o_n and id < o_id"))


def relabelled(of: DataFrame, links: DataFrame) -> DataFrame:
    """``of`` (id, component and more), which may say so several times, with the components that ``links`` (a, b) join made one."""
    if links.isEmpty():
        return of
    ids = of.select("id", "component").distinct()
    between = links.join(ids.select(F.col("id").alias("a"), F.col("component").alias("ca")), "a").join(ids.select(F.col("id").alias("b"), F.col("component").alias("cb")), "b")
    merged = stage(components(between.select(F.col("ca").alias("a"), F.col("cb").alias("b")))).select(F.col("id").alias("component"), F.col("component").alias("merged"))
    return of.join(merged, "component", "left").withColumn("component", F.coalesce("merged", "component")).drop("merged")


def leftover_links(buckets: DataFrame, labels: DataFrame, sets: DataFrame) -> DataFrame:
    """The links (a, b) that stars didn't find and that join components, among members of buckets in which several meet."""
    tagged = buckets.join(labels, "id", "left").withColumn("component", F.coalesce("component", "id"))
    meeting = tagged.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo <> hi").select("bucket")
    members = tagged.join(meeting, "bucket").select("id", "component").distinct()
    full = stage(sets.join(members, "id").withColumn("n", F.expr("cast(octet_length(shingles) div 8 as long)")))
    rows = stage(prefixes(full))
    first = stage(confirmed(central_pairs(rows), sets))
    rows, full = stage(relabelled(rows, first)), stage(relabelled(full, first))
    return first.unionByName(stage(confirmed(leftover_pairs(rows, full), sets)))


def grouped(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, th, key, n_shingles) for each row, and (key, root), the least (doc_id, th) of each class's component."""
    rows = stage(sketches(docs))
    with_set = rows.filter("key is not null and doc_id is not null")
    one = F.min(F.struct("doc_id", "th", "rid"))
    classes = with_set.groupBy("key").agg(one.alias("one"), F.min_by("bands", F.struct("doc_id", "th", "rid")).alias("bands"), F.first("n_shingles").alias("n"))
    classes = stage(classes.select("key", F.col("one.rid").alias("id"), F.struct("one.doc_id", "one.th").alias("own"), "bands", "n"))
    single = classes.select("id", "n", F.explode("bands").alias("bucket"))
    buckets = stage(single.join(single.groupBy("bucket").count().filter("count > 1").select("bucket"), "bucket"))
    pairs = stage(star_pairs(buckets))
    # Sorted and merged at any size: the same plan for a small corpus as for a large one.
    wanted = classes.select("id", "own.doc_id", "own.th").join(buckets.select("id").distinct(), "id").hint("merge")
    sets = stage(_hashed(docs).join(wanted, ["doc_id", "th"]).select("id", "text").mapInArrow(_sets, "id long, shingles binary").dropDuplicates(["id"]))
    labels = stage(components(stage(confirmed(pairs, sets))))
    labelled = classes.select("key", "id", "own").join(labels, "id", "left").withColumn("component", F.coalesce("component", "id"))
    labelled = stage(relabelled(labelled, leftover_links(buckets, labels, sets)).select("key", "component", "own"))
    roots = labelled.groupBy("component").agg(F.min("own").alias("root"))
    return rows.select("doc_id", "th", "key", "n_shingles"), labelled.join(roots, "component").select("key", "root")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of ``docs``."""
    rows, roots = grouped(docs)
    out = rows.join(roots, "key", "left")
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("root.doc_id", "doc_id"))
    return out.select("doc_id", "n_shingles", own.alias("component_id"), F.coalesce(F.col("doc_id") == own, F.lit(True)).alias("kept"))


def keep_one_of_each(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each component: that with the least doc_id and, of several texts of it, the least hash.

    Of rows that share doc_id and text, the one with the least hash of all its columns stays, so reruns agree. Rows
    without a set stay, one for each (doc_id, text); rows without a doc_id stay all.
    """
    rows, roots = grouped(docs)
    alone = rows.filter("key is null and doc_id is not null").select("doc_id", "th")
    kept = roots.select("root.doc_id", "root.th").unionByName(alone).distinct().withColumnsRenamed({"doc_id": "_d", "th": "_t"})
    hashed = docs.filter("doc_id is not null").withColumn("_th", F.xxhash64(text_or_empty()))
    found = hashed.join(kept, (F.col("doc_id") == F.col("_d")) & (F.col("_th") == F.col("_t")), "left_semi")
    one = found.groupBy("doc_id", "_th").agg(F.min_by(F.struct(*[found[c] for c in docs.columns]), row_hash(found)).alias("_row"))
    return one.select("_row.*").unionByName(docs.filter("doc_id is null"))
