"""Quality rules as a short-circuit cascade.

Each rule is a vectorised test of a block of texts. Its cost (seconds a row) and its selectivity (share of rows that it
rejects) are measured on a sample of about ``SAMPLE_ROWS`` rows; rules then run in the order of rejections per cost, and
each sees only what the ones before it left. The order changes what the cascade costs, never which rows it keeps.

A null or empty text has no words and is rejected for it; rows are judged alone, so repeats and ties don't matter.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cached_property
from time import perf_counter
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, blocks

SAMPLE_ROWS = 2000
WINDOW = 8
BLOCK = 6 << 20


class Texts:
    """Measures of a block of texts, each computed when first asked for."""

    def __init__(self, texts: pa.Array) -> None:
        self.texts = pc.fill_null(texts.cast(pa.large_string()), "")

    def __len__(self) -> int:
        return len(self.texts)

    @cached_property
    def _words(self) -> tuple[np.ndarray, pa.Array, np.ndarray]:
        """Each word's code and text, and the distinct words."""
        split = pc.ascii_split_whitespace(self.texts)
        owner = np.repeat(np.arange(len(self)), np.diff(split.offsets.to_numpy()))
        flat = split.flatten().dictionary_encode()
        codes = flat.indices.to_numpy()
        real = pc.not_equal(flat.dictionary, "").to_numpy(zero_copy_only=False)
        if not real.all():
            keep = real[codes]
            owner, codes = owner[keep], codes[keep]
        return codes, flat.dictionary, owner

    def _sum(self, values: np.ndarray) -> np.ndarray:
        return np.bincount(self._words[2], weights=values, minlength=len(self)).astype(np.int64)

    @cached_property
    def n_words(self) -> np.ndarray:
        return np.bincount(self._words[2], minlength=len(self)).astype(np.int64)

    @cached_property
    def word_chars(self) -> np.ndarray:
        codes, words, _ = self._words
        return self._sum(pc.utf8_length(words).to_numpy()[codes])

    def count(self, pattern: str) -> np.ndarray:
        return pc.count_substring_regex(self.texts, pattern).to_numpy().astype(np.int64)

    @cached_property
    def n_symbols(self) -> np.ndarray:
        return self.count(r"[#*$%&|<>]")

    @cached_property
    def n_dup_lines(self) -> np.ndarray:
        split = pc.split_pattern(self.texts, "\n")
        owner = np.repeat(np.arange(len(self)), np.diff(split.offsets.to_numpy()))
        lines = split.flatten().dictionary_encode()
        keep = pc.match_substring_regex(lines.dictionary, r"[^\x20\x09-\x0D]").to_numpy(zero_copy_only=False)[lines.indices.to_numpy()]
        owner, codes = owner[keep], lines.indices.to_numpy()[keep].astype(np.int64)
        distinct = np.unique(owner * (len(lines.dictionary) + 1) + codes) // (len(lines.dictionary) + 1)
        return np.bincount(owner, minlength=len(self)) - np.bincount(distinct, minlength=len(self))

    @cached_property
    def n_repeat_words(self) -> np.ndarray:
        codes, _, owner = self._words
        n = len(codes) - WINDOW + 1
        if n <= 0:
            return np.zeros(len(self), np.int64)
        h = np.zeros(n, np.uint64)
        for i in range(WINDOW):
            h = (h ^ (codes[i : i + n].astype(np.uint64) + np.uint64(1))) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        inside = owner[:n] == owner[WINDOW - 1 :]
        h = (h ^ owner[:n].astype(np.uint64)) * np.uint64(0xBF58476D1CE4E5B9)
        at = np.flatnonzero(inside)
        order = np.argsort(h[at], kind="stable")
        s = h[at][order]
        same = s[1:] == s[:-1]
        twice = np.zeros(len(s), bool)
        twice[1:] |= same
        twice[:-1] |= same
        edge = np.zeros(len(codes) + 1, np.int64)
        found = at[order][twice]
        edge[found] += 1
        np.add.at(edge, found + WINDOW, -1)
        return self._sum((np.cumsum(edge[:-1]) > 0).astype(np.float64))

    @cached_property
    def n_stutter(self) -> np.ndarray:
        """Words equal to the one before."""
        codes, _, owner = self._words
        same = np.zeros(len(codes))
        same[1:] = (codes[1:] == codes[:-1]) & (owner[1:] == owner[:-1])
        return self._sum(same)

    @cached_property
    def letters(self) -> tuple[np.ndarray, np.ndarray]:
        return self.count(r"\p{Lu}"), self.count(r"\p{L}")


class Rule(NamedTuple):
    name: str
    rejects: Callable[[Texts], np.ndarray]


#: A text is rejected by any of these. The first two are the base rules.
RULES = (
    Rule("few_words", lambda t: t.n_words < 20),
    Rule("repeated_windows", lambda t: 100 * t.n_repeat_words > 30 * t.n_words),
    Rule("symbols", lambda t: 10 * t.n_symbols > 3 * t.n_words),
    Rule("capitals", lambda t: 2 * t.letters[0] > t.letters[1]),
    Rule("exclamations", lambda t: 2 * t.count("!") > t.n_words),
    Rule("stutter", lambda t: 100 * t.n_stutter > 30 * t.n_words),
    Rule("word_length", lambda t: (t.word_chars < 2 * t.n_words) | (t.word_chars > 20 * t.n_words)),
    Rule("few_letters", lambda t: 2 * t.letters[1] < t.word_chars),
    Rule("repeated_lines", lambda t: (100 * t.n_dup_lines > 30 * (t.count("\n") + 1)) & (t.n_dup_lines > 3)),
)


def _measure(rules):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, BLOCK):
            out = []
            for r in rules:
                texts, began = Texts(block["text"].chunk(0)), perf_counter()
                rejected = int(r.rejects(texts).sum())
                out.append((r.name, perf_counter() - began, block.num_rows, rejected))
            names, seconds, rows, rejected = zip(*out)
            yield pa.RecordBatch.from_pydict({"rule": names, "seconds": seconds, "rows": rows, "rejected": rejected})

    return run


def cascade_order(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample_rows: int = SAMPLE_ROWS) -> list[tuple[Rule, float, float]]:
    """(rule, seconds a row, share rejected), most rejections per second first."""
    n = docs.count()
    part = docs.select("text").sample(min(1.0, sample_rows / max(1, n)), seed=7)
    found = {r["rule"]: r for r in part.mapInArrow(_measure(rules), "rule string, seconds double, rows long, rejected long").groupBy("rule").agg(F.sum("seconds").alias("s"), F.sum("rows").alias("n"), F.sum("rejected").alias("k")).collect()}
    rated = [(r, f["s"] / f["n"], f["k"] / f["n"]) if (f := found.get(r.name)) else (r, 1.0, 0.0) for r in rules]
    return sorted(rated, key=lambda x: -x[2] / max(x[1], 1e-9))


def cascade(texts: pa.Array, rules: list[Rule], first: Texts | None = None) -> np.ndarray:
    """Which texts no rule rejects. A rule sees those that are left; measures are shared as long as none went."""
    left, seen = np.arange(len(texts)), first or Texts(texts)
    for r in rules:
        if not len(left):
            break
        bad = r.rejects(seen)
        if bad.any():
            left = left[~bad]
            if first is None or bad.mean() > 0.5:
                seen, first = Texts(texts.take(pa.array(left))), None
            else:
                keep, whole = ~bad, seen
                seen = _Part(whole, np.flatnonzero(keep))
    kept = np.zeros(len(texts), bool)
    kept[left] = True
    return kept


class _Part(Texts):
    """Rows ``at`` of texts that have been measured already."""

    def __init__(self, whole: Texts, at: np.ndarray) -> None:
        self.whole, self.at = whole, at
        self.texts = whole.texts.take(pa.array(at))

    n_words = property(lambda self: self.whole.n_words[self.at])
    word_chars = property(lambda self: self.whole.word_chars[self.at])
    n_symbols = property(lambda self: self.whole.n_symbols[self.at])
    n_dup_lines = property(lambda self: self.whole.n_dup_lines[self.at])
    n_repeat_words = property(lambda self: self.whole.n_repeat_words[self.at])
    n_stutter = property(lambda self: self.whole.n_stutter[self.at])


def _judge(rules: list[Rule], counts: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, BLOCK):
            texts = pc.fill_null(block["text"].chunk(0), "")
            whole = Texts(texts) if counts else None
            kept = cascade(texts, rules, whole)
            if not counts:
                yield from block.filter(pa.array(kept)).to_batches()
                continue
            failed = (whole.n_words < 20) | (100 * whole.n_repeat_words > 30 * whole.n_words)
            yield pa.RecordBatch.from_pydict(
                {"doc_id": block["doc_id"].chunk(0)} | {k: getattr(whole, k).astype(np.int64) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")} | {"base_failed": failed, "kept": kept & ~failed}
            )

    return run


def quality_filter(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of ``docs`` (a text column and any others) that no rule rejects."""
    arrow_rows(docs.sparkSession)
    order = [r for r, _, _ in cascade_order(docs, rules)]
    return docs.mapInArrow(_judge(order, False), docs.schema)


def quality_report(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Each document's base counts and the cascade's verdict."""
    arrow_rows(docs.sparkSession)
    order = [r for r, _, _ in cascade_order(docs, rules)]
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(_judge(order, True), f"doc_id {kind}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean")
