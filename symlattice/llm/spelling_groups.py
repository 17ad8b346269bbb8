"""Words that differ by one letter, found with PartEnum signatures on their letters.

A word's letters with their repeats are a binary vector, with a place for each letter and how often it came before. One
edit changes at most two places. The places are cut into ``PARTS`` parts; two words one edit apart agree on all but two
of them, so they share the signature made of the rest for at least one choice of two parts. As one edit can't change both
the first and the last three letters of a word of seven, a signature also names either of these. Words meet by equal
signatures and are then compared; the whole is joins and aggregates.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stage, text_or_empty, unstage

#: Parts into which the places of letters are cut; words meet by what two of them leave.
PARTS = 5
LEAST_CHARS, LEAST_COUNT = 7, 2
#: Letters at either end of which one edit leaves one whole.
END = 3
#: A form is this many times as frequent as the word.
TIMES = 10
#: Doublings after which no chain of forms goes on: each form is ten times as frequent, and counts end at 2^63.
DOUBLINGS = 5
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RUN = f"[A-Za-zÀ-ÿ]{{{LEAST_CHARS},}}"


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n): the lower-cased runs of letters, some of them less a letter, as ``spelling_groups`` says.

    Shorter runs can't give a word that is long enough, and runs end where letters do, so only longer ones are taken.
    """
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(text_or_empty(), F.lit(RUN), F.lit(0))).alias("run"))
    runs = runs.select("id", F.translate("run", UPPER, LOWER).alias("run")).withColumn("c", F.crc32(F.concat_ws(":", "id", "run").cast("binary")))
    at = (F.col("c") % F.length("run")).cast("int")
    word = F.when(F.col("c") % 31 == 0, F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))).otherwise(F.col("run"))
    return runs.select(word.alias("word")).filter(F.length("word") >= LEAST_CHARS).groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= LEAST_COUNT)


def letter_parts(words: DataFrame, parts: int = PARTS) -> list[str]:
    """The letters of each part, dealt by their frequency so that parts weigh alike; any deal gives the same pairs.

    There are at most 90 letters.
    """
    counts = words.select(F.explode(F.split("word", "")).alias("c")).groupBy("c").agg(F.count("*").alias("n")).collect()
    out, load = [""] * parts, [0] * parts
    for n, c in sorted(((r["n"], r["c"]) for r in counts), reverse=True):
        i = load.index(min(load))
        out[i], load[i] = out[i] + c, load[i] + n
    return out


def signatures(words: DataFrame, letters: list[str]) -> DataFrame:
    """(word, n, c, sig) for each choice ``c`` of two parts and an end: what they leave, named by a hash.

    Words with equal names are compared, so a clash of hashes costs a comparison and no more.
    """
    ordered = words.withColumn("_s", F.array_join(F.sort_array(F.split("word", "")), ""))  # no lambda: both sides of the join share one shuffle
    ends = F.substring("word", 1, END), F.substring("word", -END, END)
    names = [F.xxhash64(F.lit(c), F.translate("_s", letters[i] + letters[j], ""), ends[e]) for c, (i, j, e) in enumerate(choices(len(letters)))]
    return ordered.select("word", "n", F.posexplode(F.array(*names)).alias("c", "sig"))


def choices(parts: int) -> list[tuple[int, int, int]]:
    """(part, part, 0 for the first letters or 1 for the last) of each signature."""
    return [(i, j, e) for i, j in combinations(range(parts), 2) for e in (0, 1)]


def near_words(words: DataFrame, parts: int = PARTS) -> DataFrame:
    """(a, a_n, b, b_n), a before b, each pair of ``words`` (word, n) that one inserted, deleted or replaced letter tells apart, once.

    A pair meets in every choice that holds the parts in which it differs; it counts in the first of them, and at the
    last letters only if the first ones differ.
    """
    letters = letter_parts(words, parts)
    sigs = signatures(words, letters)
    a = sigs.select("sig", F.col("c").alias("a_c"), F.col("word").alias("a"), F.col("n").alias("a_n"))
    b = sigs.select("sig", F.col("c").alias("b_c"), F.col("word").alias("b"), F.col("n").alias("b_n"))
    at = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.lit(e).alias("end")) for i, j, e in choices(parts)])
    others = F.array(*[F.lit("".join(letters[:p] + letters[p + 1 :])) for p in range(parts)])

    def differ(part: Column) -> Column:
        """Whether the words, one edit apart, have unlike letters of a part."""
        away = F.get(others, part)
        return F.call_function("translate", "a", away, F.lit("")) != F.call_function("translate", "b", away, F.lit(""))

    def of(field: str) -> Column:
        return F.get(at, F.col("a_c"))[field]

    i, j = of("i"), of("j")
    first = (differ(i) & differ(j)) | (differ(j) & (i == 0)) | (differ(i) & (i == 0) & (j == 1))
    near = (F.col("a") < F.col("b")) & (F.abs(F.length("a") - F.length("b")) <= 1) & (F.col("a_c") - F.col("b_c") == 0) & ((of("end") == 0) | (F.substring("a", 1, END) != F.substring("b", 1, END)))
    return a.join(b, "sig").filter(near & (F.levenshtein("a", "b", 1) == 1) & first).select("a", "a_n", "b", "b_n")


def with_forms(words: DataFrame, pairs: DataFrame) -> DataFrame:
    """``words`` with form, n_near and form_n."""
    one = lambda word, near: F.struct(F.col(word).alias("word"), F.col(near).alias("near"), F.col(f"{near}_n").alias("near_n"))
    ways = pairs.select(F.inline(F.array(one("a", "b"), one("b", "a"))))
    best = ways.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("m"), F.col("near").alias("w"))).alias("best"))
    met = words.join(best, "word", "left")
    form = -F.col("best.m") >= TIMES * F.col("n")
    return met.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(form, F.col("best.w")).alias("form"), F.when(form, -F.col("best.m")).alias("form_n"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) for each word of ``forms`` that has a form: the last of the forms that follow from it.

    Every round replaces a word's target by its target's own, so a chain halves; none is longer than 19 forms.
    """
    way = stage(forms.filter("form is not null").select("word", F.col("form").alias("root")))
    for _ in range(DOUBLINGS):
        further = way.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        met = stage(way.join(further, "root", "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_on")))
        unstage(way)
        way = met.drop("_on")
        way._staged_path = met._staged_path
        if met.filter("_on").limit(1).count() == 0:
            break
    return way


def spelling_groups(docs: DataFrame) -> DataFrame:
    """(word, n, n_near, form, form_n, root) for each word of the texts of ``docs``.

    Words are runs of letters ``[A-Za-z\\u00C0-\\u00FF]``, A-Z lower-cased; where 31 divides the crc32 of id and run, the run
    loses a letter. Those with 7 code points and 2 occurrences stay. Words are near if one edit tells them apart; a
    word's form is its most frequent near word (ties: the first in code-point order) if that is ten times as frequent, its
    root the last form in a row. A null text has no words, a null id counts as an empty one, repeated rows count again.
    No word is near itself; a table without words gives no rows. Other columns of ``docs`` are not used.
    """
    words = stage(word_counts(docs))
    forms = stage(with_forms(words, near_words(words)))
    unstage(words)
    met = forms.join(roots(forms), "word", "left")
    return met.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
