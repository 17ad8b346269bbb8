"""I-Match fingerprints, with DataFrame functions only.

Terms are the distinct words of a text (ASCII letters in lower case). The lexicon keeps the terms whose document
frequency lies in a band of shares of the corpus. It is cut at random into ``EVEN`` subsets, so that each of its terms is in
one; ``SPARSE`` further subsets hold one term in 256 each, for long texts. A fingerprint hashes, for each subset, the
sorted list of the text's terms in it. An edit that touches no term of a subset leaves that subset's hash alone, so the
share of equal hashes is a likeness.

The lexicon is broadcast: a term in a share ``LEAST`` of all documents leaves room for at most (terms a document) /
``LEAST`` terms, however many documents there are, and the threshold is raised until at most ``LEXICON`` terms pass. A
text without terms of the lexicon has the hash of all its sorted terms in every place; a text without words that of none.

Documents stand in a ring, by doc_id downwards. The ring is made of ids alone; then a text and the head that the one before
it takes of it move by hash, so no task holds a range of texts.

A null text is empty. Of rows that repeat a doc_id, those with one text have one place in the ring, and other texts
have places by their hash; each row gets what its place gets. Rows with a null doc_id get no next text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import frequent, stage, text_or_empty

EVEN, SPARSE = 24, 8
SUBSETS = EVEN + SPARSE
LEAST, MOST = 0.001, 0.25
LEXICON = 1 << 17
#: Bits of a code that name its term.
CODE = 57
#: Places in a range of the ring's ids.
PLACES = 200_000


def terms(text: Column) -> Column:
    """The distinct words of a text in lower case: what white space parts."""
    return F.array_remove(F.array_distinct(F.split(F.lower(text), "[\\x20\\x09-\\x0D]+")), "")


def lexicon(docs: DataFrame) -> DataFrame:
    """(term, code): terms within the band of document frequencies, with a code for each subset that has them.

    A code is the subset's number followed by 57 bits of the term's hash, so sorted codes are sorted terms, by subset.
    """
    n = docs.count()
    df = docs.select(F.explode(terms(text_or_empty())).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    band = stage(df.filter(f"df >= 2 and df >= {LEAST * n} and df <= greatest({MOST * n}, 2)"))
    even = F.pmod(F.xxhash64("term", F.lit(1)), F.lit(EVEN)).cast("int")
    sparse = F.pmod(F.xxhash64("term", F.lit(2)), F.lit(256)).cast("int")
    both = F.when(sparse < SPARSE, F.array(even, sparse + EVEN)).otherwise(F.array(even))
    name = F.xxhash64("term").bitwiseAND(F.lit((1 << CODE) - 1))
    return frequent(band, "df", LEXICON).select("term", F.explode(both).alias("subset")).select("term", F.shiftleft(F.col("subset").cast("long"), CODE).bitwiseOR(name).alias("code"))


def likeness(a: Column, b: Column) -> Column:
    """The share of equal hashes among the subsets in which either text has terms."""
    both = F.arrays_zip(a.alias("a"), b.alias("b"))
    used = F.size(F.filter(both, lambda x: (x["a"] != 0) | (x["b"] != 0)))
    return F.round(F.size(F.filter(both, lambda x: (x["a"] == x["b"]) & (x["a"] != 0))) / F.greatest(used, F.lit(1)), 6)


def ring(places: DataFrame) -> DataFrame:
    """Add next_id and next_th to (doc_id, th, ...), whose rows (doc_id, th) tells apart: downwards, and from the least to the greatest."""
    ranges = max(1, places.count() // PLACES)
    ranged = stage(places.repartitionByRange(ranges, "doc_id", "th").withColumn("_r", F.spark_partition_id()))
    tops = sorted(tuple(r) for r in ranged.groupBy("_r").agg(F.max(F.struct("doc_id", "th")).alias("top")).select("_r", "top.doc_id", "top.th").collect())
    after = [(r, *tops[i - 1][1:]) for i, (r, _, _) in enumerate(tops)]  # one row for each range
    kind = places.schema["doc_id"].dataType.simpleString()
    below = places.sparkSession.createDataFrame(after, f"_r int, _id {kind}, _th long")
    down = W.partitionBy("_r").orderBy(F.col("doc_id").desc(), F.col("th").desc())
    step = ranged.withColumn("_next", F.lead(F.struct("doc_id", "th")).over(down)).join(below, "_r", "left")
    return step.withColumn("next_id", F.coalesce("_next.doc_id", "_id")).withColumn("next_th", F.coalesce("_next.th", "_th")).drop("_r", "_id", "_th", "_next")


def fingerprints(docs: DataFrame, lex: DataFrame, texts: list[str], key: list[str], keep: list[str]) -> DataFrame:
    """``key`` and ``keep`` for each key of ``docs``, with fp_<name>, the fingerprint of each of the text columns.

    Rows with one key have one text. Terms meet the broadcast lexicon as rows; grouping them by the key again moves
    nothing if ``docs`` are dealt by it.
    """
    listed = docs.select(*key, *keep, *[terms(F.col(t)).alias(t) for t in texts])
    # What a key has once is one of the exploded elements: a column beside them would be copied for each term.
    info = F.struct(*keep, *[F.hash(F.sort_array(t), F.lit(1)).alias(f"_w_{t}") for t in texts])
    own = F.array(F.struct(F.lit(None).cast("string").alias("term"), F.lit(-1).alias("of"), info.alias("info")))

    def marked(t: str, i: int) -> Column:
        return F.transform(t, lambda x: F.struct(x.alias("term"), F.lit(i).alias("of"), F.lit(None).alias("info")))

    rows = listed.select(*key, F.inline(F.concat(own, *[marked(t, i) for i, t in enumerate(texts)])))
    met = rows.join(F.broadcast(lex), "term", "left").filter("of < 0 or code is not null")
    got = [F.array_distinct(F.sort_array(F.collect_list(F.when(F.col("of") == i, F.col("code"))))).alias(f"_f_{t}") for i, t in enumerate(texts)]
    grouped = met.groupBy(*key).agg(*got, F.first("info", ignorenulls=True).alias("info")).select(*key, "info.*", *[f"_f_{t}" for t in texts])
    # Sorted, the codes of one subset stand together: from the first place that names it to the last.
    subset = lambda x: F.shiftright(x, CODE).cast("int")
    ordered = [c for t in texts for c in (F.transform(f"_f_{t}", subset).alias(f"_s_{t}"), F.reverse(F.transform(f"_f_{t}", subset)).alias(f"_b_{t}"))]
    placed = grouped.select("*", *ordered)

    def hashes(t: str) -> Column:
        def one(s: Column) -> Column:
            first, back = F.array_position(f"_s_{t}", s), F.array_position(f"_b_{t}", s)
            n = F.size(f"_s_{t}") + 2 - back - first
            return F.when((first == 0) | (back == 0), F.lit(0)).otherwise(F.hash(F.slice(f"_f_{t}", first.cast("int"), n.cast("int"))))

        return F.when(F.size(f"_f_{t}") == 0, F.array_repeat(f"_w_{t}", SUBSETS)).otherwise(F.transform(F.sequence(F.lit(0), F.lit(SUBSETS - 1)), one))

    return placed.select(*key, *keep, *[hashes(t).alias(f"fp_{t}") for t in texts])


def imatch_report(docs: DataFrame) -> DataFrame:
    """Each document's fingerprint, that of its edited text, and their likeness and the next document's."""
    texts = docs.select("doc_id", text_or_empty().alias("text")).withColumn("th", F.xxhash64("text"))
    lex, known, lone = lexicon(texts), texts.filter("doc_id is not null"), texts.filter("doc_id is null")
    places = stage(ring(stage(known.groupBy("doc_id", "th").agg(F.max(F.length("text")).alias("n"), F.count("*").alias("copies")))))
    wanted = places.select(F.col("next_id").alias("doc_id"), F.col("next_th").alias("th"), F.col("doc_id").alias("_to"), F.col("th").alias("_to_th"), F.floor(F.col("n") / 2).cast("int").alias("half"))
    # Both joins deal the same texts by the same keys, so Spark shuffles them once. Merged at any size: one plan for all.
    heads = known.join(wanted.hint("merge"), ["doc_id", "th"]).groupBy("_to", "_to_th").agg(F.min(F.expr("substring(text, 1, half)")).alias("head"))
    heads = heads.select(F.col("_to").alias("doc_id"), F.col("_to_th").alias("th"), "head")
    size, half = F.length("text"), F.floor(F.length("text") / 2).cast("int")

    def measured(d: DataFrame) -> DataFrame:
        edited = F.concat(F.substring(F.col("text"), F.lit(1), size - half), F.substring(F.col("head"), F.lit(1), half))
        rows = d.select("doc_id", "th", "text", edited.alias("edited")).withColumn("n_chars", F.length("text").cast("long")).withColumn("edited_sha256", F.sha2("edited", 256))
        return fingerprints(rows, lex, ["text", "edited"], ["doc_id", "th"], ["n_chars", "edited_sha256"])

    found = stage(measured(known.join(heads.hint("merge"), ["doc_id", "th"], "left")))
    after = found.select(F.col("doc_id").alias("next_id"), F.col("th").alias("next_th"), F.col("fp_text").alias("fp_next"))
    linked = found.join(places.select("doc_id", "th", "next_id", "next_th", "copies"), ["doc_id", "th"]).join(after, ["next_id", "next_th"], "left")
    alone = measured(lone.withColumn("head", F.lit(""))).join(lone.groupBy("th").agg(F.count("*").alias("copies")), "th").withColumn("fp_next", F.lit(None).cast("array<int>"))
    shown = lambda c: F.array_join(F.transform(c, lambda x: F.lpad(F.hex(x.bitwiseAND(F.lit(0xFFFFFFFF))), 8, "0")), "")
    columns = ["doc_id", "n_chars", "edited_sha256", "fp_text", "fp_edited", "fp_next", "copies"]
    return linked.select(columns).unionByName(alone.select(columns)).select(
        "doc_id", "n_chars", "edited_sha256", shown("fp_text").alias("fingerprint"), shown("fp_edited").alias("edited_fingerprint"),
        likeness(F.col("fp_text"), F.col("fp_edited")).alias("near_edited"), F.coalesce(likeness(F.col("fp_text"), F.col("fp_next")), F.lit(0.0)).alias("near_next"),
        F.explode(F.expr("sequence(1, copies)")).alias("_copy"),
    ).drop("_copy")
