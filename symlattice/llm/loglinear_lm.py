"""Scoring texts with a log-bilinear model that numpy trains by noise-contrastive estimation.

Every word has a place in the model: the most frequent training words, whose number grows with the square root of the
training tokens, have vectors of their own, and all others share vectors by a hash of their ending in classes, a quarter
as many. The score of a token after two others is (c1 * q[h1] + c2 * q[h2]) . r[w] + b[w]. Each round, every task that
reads training documents trains from the same parameters on its own tokens, against noise from the unigram distribution;
the tasks' changes, weighted by their tokens, are averaged in slices by Spark and start the next round.

Normalising takes two levels: tokens ordered by frequency fall into groups, about the root of their number; a group has
a probability by vectors of its own, trained likewise, and a token one among its group. A word of a class has the
probability of the class times its share of the class's smoothed counts. Counts of words beyond the ``HOT`` most frequent
ones come by a shuffled join.

Null texts are empty and score their end alone; rows with a null doc_id are training documents; repeated rows are each
scored. Training order within a task is seeded, so a task that runs anew gives the same parameters.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, blocks, frequent, row_ids, stage, text_or_empty

FOLDS, HELD_OUT = 5, 1
#: Words with vectors of their own: so many, or this many times the root of the training tokens if that is more.
MODEL_WORDS, PER_ROOT = 2000, 1
#: A word has its own vectors if it occurs so often; words of a class share an ending of so many characters.
LEAST_COUNT, ENDING = 3, 3
DIM = 24
#: A row of output vectors ends with its bias, which meets a 1 in the contexts.
WIDTH = DIM + 1
ROUNDS = 2
BATCH, NOISE, GROUP_NOISE, RATIO, RATE = 1024, 96, 32, 16.0, 0.1
HOT = 1 << 18
BLOCK = 12 << 20
#: Rows whose scores over a level fit a core's cache.
ROWS = 1 << 11
SLICE = 1 << 14
#: Tasks whose changes are averaged first.
TASKS = 256
END = 0


def word_class(word: str, first: int, n: int) -> int:
    """The id of a word without vectors of its own."""
    return first + zlib.crc32(word[-ENDING:].encode()) % n


class Block:
    """A block of texts as word codes, ``words`` and words per text; words are lower-cased (A-Z) runs without white space."""

    def __init__(self, texts: pa.Array) -> None:
        split = pc.ascii_split_whitespace(pc.ascii_lower(texts.cast(pa.large_string())))
        per_text = np.diff(split.offsets.to_numpy())
        flat = split.flatten().dictionary_encode()
        codes, self.words = flat.indices.to_numpy(), flat.dictionary.to_pylist()
        owner = np.repeat(np.arange(len(per_text)), per_text)
        if "" in self.words:
            keep = codes != self.words.index("")
            codes, owner = codes[keep], owner[keep]
        self.codes, self.owner, self.n = codes, owner, len(per_text)
        self.per_text = np.bincount(owner, minlength=self.n)

    def stream(self, ids: dict[str, int], classes: int) -> tuple[np.ndarray, ...]:
        """Each token's model id, the two before it and its text; and each word's id. Every text ends with END and begins after two of them."""
        first = len(ids) + 1
        known = np.fromiter((ids.get(w) or word_class(w, first, classes) for w in self.words), np.int32, len(self.words))
        w = np.full(len(self.codes) + self.n, END, np.int32)
        w[np.arange(len(self.codes)) + self.owner] = known[self.codes]
        starts = np.cumsum(self.per_text + 1) - (self.per_text + 1)
        h1 = np.concatenate([[END], w[:-1]])[: len(w)].astype(np.int32)
        h2 = np.concatenate([[END, END], w[:-2]])[: len(w)].astype(np.int32)
        h2[starts] = END
        return w, h1, h2, np.repeat(np.arange(self.n), self.per_text + 1), known


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for table in blocks(batches, BLOCK):
        b = Block(table["text"].chunk(0))
        n = np.bincount(b.codes, minlength=len(b.words))
        yield pa.RecordBatch.from_pydict({"word": pa.array(b.words, pa.string()), "c": n}).filter(pa.array(n > 0))


class Model:
    """In one flat vector: out (words x WIDTH) with vectors r and biases b, q (words x DIM), the groups' out_g with gr and gb, and c (2 x DIM)."""

    def __init__(self, flat: np.ndarray, words: int) -> None:
        self.flat, self.words, self.size = flat, words, math.isqrt(words - 1) + 1
        self.groups, at = -(-words // self.size), 0
        for name, rows, width in (("out", words, WIDTH), ("q", words, DIM), ("out_g", self.groups, WIDTH), ("c", 2, DIM)):
            end = at + rows * width
            setattr(self, name, flat[at:end].reshape(rows, width))
            at = end
        self.r, self.b, self.gr, self.gb = self.out[:, :DIM], self.out[:, DIM], self.out_g[:, :DIM], self.out_g[:, DIM]

    @classmethod
    def fresh(cls, unigram: np.ndarray) -> Model:
        """Small random vectors, and log-probabilities of the tokens alone as biases: at first a unigram model."""
        words, rng = len(unigram), np.random.default_rng(5)
        of_groups = np.add.reduceat(unigram, np.arange(0, words, math.isqrt(words - 1) + 1))
        vectors = lambda n: rng.normal(0, 0.1, (n, DIM))
        r, q, gr = vectors(words), vectors(words), vectors(len(of_groups))
        parts = [np.column_stack([r, np.log(unigram)]), q, np.column_stack([gr, np.log(of_groups)]), np.ones(DIM), np.full(DIM, 0.5)]
        return cls(np.concatenate([p.ravel() for p in parts]).astype(np.float32), words)

    def _context_tables(self) -> list[np.ndarray]:
        """What a word adds to a context from either place before the token."""
        return [np.column_stack([c * self.q, np.full(self.words, 0.5, np.float32)]) for c in self.c]

    @staticmethod
    def _log_softmax(x: np.ndarray, rows: np.ndarray, at: np.ndarray, got: np.ndarray) -> None:
        """Add to ``got`` the log-probabilities of the outputs ``at`` of a level, a few contexts at a time."""
        ones = np.ones(len(rows), np.float32)
        for a in range(0, len(x), ROWS):
            z = slice(a, a + ROWS)
            s = x[z] @ rows.T
            if s.max() > 60 or s.min() < -60:  # else no exponential leaves the range of its type
                s -= s.max(1)[:, None]
            own = s[np.arange(len(s)), at[z]]
            got[z] += own - np.log(np.exp(s, out=s) @ ones)

    def log_probs(self, w: np.ndarray, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """Natural log-probabilities: that of a token's group and that of the token in it."""
        result, (near, far) = np.empty(len(w), np.float32), self._context_tables()
        for a in range(0, len(w), 1 << 16):
            z = slice(a, a + (1 << 16))
            order = np.argsort(w[z] // self.size, kind="stable")
            ww, x = w[z][order], near.take(h1[z][order], 0)
            x += far.take(h2[z][order], 0)
            group, got = ww // self.size, np.zeros(len(order), np.float32)
            self._log_softmax(x, self.out_g, group, got)
            cuts = np.flatnonzero(np.diff(group, prepend=-1, append=-1)).tolist()
            for i, k in zip(cuts[:-1], cuts[1:]):
                first = int(group[i]) * self.size
                mine = slice(first, first + self.size)
                self._log_softmax(x[i:k], self.out[mine], ww[i:k] - first, got[i:k])
            result[a + order] = got
        return result


def _spread(ids: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct ids and the sums of their ``rows``."""
    order = np.argsort(ids, kind="stable")
    s = ids[order]
    first = np.flatnonzero(np.append(True, s[1:] != s[:-1]))
    return s[first], np.add.reduceat(rows.take(order, 0), first)


def train(model: Model, unigram: np.ndarray, streams: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]], seed: int) -> int:
    """One pass of AdaGrad over NCE's loss; noise is shared within a batch. Returns the number of tokens."""
    rng, seen = np.random.default_rng(seed), 0
    power = Model(np.ones_like(model.flat), model.words)
    cumulative, of_groups = np.cumsum(unigram), np.add.reduceat(unigram, np.arange(0, model.words, model.size))
    log_noise, log_groups = np.log(RATIO * unigram).astype(np.float32), np.log(RATIO * of_groups).astype(np.float32)

    def step(name: str, ids, grad: np.ndarray) -> None:
        p, g2 = getattr(model, name), getattr(power, name)
        total = grad * grad
        total += g2[ids]
        g2[ids] = total
        np.sqrt(total, out=total)
        np.divide(grad, total, out=total)
        total *= np.float32(RATE)
        p[ids] += total

    def nce(name: str, x: np.ndarray, ww: np.ndarray, noise: np.ndarray, logs: np.ndarray) -> np.ndarray:
        """Step a level's vectors and biases; the gradient of the contexts."""
        n, rows = len(ww), getattr(model, name)
        rw, rn = rows.take(ww, 0), rows.take(noise, 0)
        up = np.einsum("ij,ij->i", x, rw)
        up -= logs[ww]
        np.exp(up, out=up)
        up += 1
        np.reciprocal(up, out=up)
        against = -rn
        against[:, DIM] += logs[noise]
        down = x @ against.T
        np.exp(down, out=down)
        down += 1
        np.divide(np.float32(-RATIO / len(noise)), down, out=down)
        dx = up[:, None] * rw[:, :DIM]
        dx += down @ rn[:, :DIM]
        grad = np.empty((n + len(noise), WIDTH), np.float32)
        np.multiply(up[:, None], x, out=grad[:n])
        np.matmul(down.T, x, out=grad[n:])
        step(name, *_spread(np.concatenate([ww, noise]), grad))
        return dx

    # Sorting two bytes a number takes a pass for each byte.
    kind = np.uint16 if model.words <= 1 << 16 else np.int32
    for w, h1, h2 in ((x.astype(kind) for x in stream) for stream in streams):
        # A batch takes every so many tokens: far apart from each other, but next to those of the batch before.
        stride = max(1, len(w) // BATCH)
        for a in range(stride):
            ww, a1, a2 = w[a::stride], h1[a::stride], h2[a::stride]
            noise = np.minimum(np.searchsorted(cumulative, rng.random(NOISE) * cumulative[-1]), model.words - 1).astype(kind)
            q1, q2 = model.q.take(a1, 0), model.q.take(a2, 0)
            x = np.ones((len(ww), WIDTH), np.float32)
            np.add(model.c[0] * q1, model.c[1] * q2, out=x[:, :DIM])
            with np.errstate(over="ignore"):  # what is too large for an exponential has a gradient of 0 or 1
                dx = nce("out", x, ww, noise, log_noise)
                dx += nce("out_g", x, ww // model.size, noise[:GROUP_NOISE] // model.size, log_groups)
            dc = np.stack([np.einsum("ij,ij->j", dx, q1), np.einsum("ij,ij->j", dx, q2)])
            step("q", *_spread(np.concatenate([a1, a2]), np.concatenate([dx * model.c[0], dx * model.c[1]])))
            step("c", slice(None), dc)
        seen += len(w)
    return seen


def _trainer(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flat, unigram, ids, classes = shared.value
        model = Model(flat.copy(), len(unigram))
        n = train(model, unigram, (Block(t["text"].chunk(0)).stream(ids, classes)[:3] for t in blocks(batches, BLOCK)), TaskContext.get().partitionId())
        if n:
            change = (model.flat - flat).astype(np.float16)
            for k in range(0, len(change), SLICE):
                yield pa.RecordBatch.from_pydict({"slice": [k // SLICE], "part": [TaskContext.get().partitionId() // TASKS], "tokens": [float(n)], "change": pa.array([change[k : k + SLICE].tobytes()], pa.binary())})

    return run


def _average(t: pa.Table) -> pa.Table:
    """The mean of a slice's changes, weighted by tokens."""
    n = t["tokens"].to_numpy()
    total = sum(k * np.frombuffer(v.as_buffer(), np.float16).astype(np.float32) for k, v in zip(n, t["change"]))
    return pa.table({"slice": t["slice"][:1], "tokens": [n.sum()], "change": pa.array([(total / n.sum()).astype(np.float16).tobytes()], pa.binary())})


def fit(train_docs: DataFrame, ids: dict[str, int], unigram: np.ndarray, classes: int) -> Model:
    """The model after ``ROUNDS`` rounds, each over another part of all training documents."""
    spark = train_docs.sparkSession
    unigram = unigram / unigram.sum()
    model = Model.fresh(unigram)
    part = F.pmod(F.shiftright(F.xxhash64("doc_id"), 7), F.lit(ROUNDS))
    for k in range(ROUNDS):
        shared = spark.sparkContext.broadcast((model.flat, unigram, ids, classes))
        found = train_docs.filter(part == k).select("text").mapInArrow(_trainer(shared), "slice long, part long, tokens double, change binary")
        flat = model.flat.copy()
        # In two levels, so that no group holds a row for each task of a large cluster.
        means = "slice long, tokens double, change binary"
        parts = found.groupBy("slice", "part").applyInArrow(_average, means)
        for row in parts.groupBy("slice").applyInArrow(_average, means).toLocalIterator():
            at = row["slice"] * SLICE
            flat[at : at + SLICE] += np.frombuffer(row["change"], np.float16)
        model = Model(flat, len(unigram))
        shared.unpersist()
    return model


def _scorer(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flat, words, ids, classes, hot, end, class_totals = shared.value
        model, seen = Model(flat, words), 0
        log_end, log_class, nothing = math.log10(end + 0.5), np.log10(class_totals), float("nan")
        for t in blocks(batches, BLOCK):
            b = Block(t["text"].chunk(0))
            w, h1, h2, owner, known = b.stream(ids, classes)
            of = known - (len(ids) + 1)
            fitted = np.bincount(owner, weights=model.log_probs(w, h1, h2), minlength=b.n) / math.log(10)
            per_word = np.fromiter((hot.get(x, nothing) for x in b.words), float, len(b.words))
            is_hot = ~np.isnan(per_word)
            log_word = np.where(is_hot, np.log10(per_word + 0.5), 0.0)
            # What a word of a class adds to the model's score: its share of the class, or for a rare word the part known here.
            log_share = np.where(of >= 0, log_word - log_class[np.maximum(of, 0)], 0.0)
            at_hot = is_hot[b.codes]
            total = lambda x: np.bincount(b.owner, weights=x, minlength=b.n)
            base = total(log_word[b.codes]) + log_end
            score = fitted + total(log_share[b.codes])
            known = np.bincount(b.owner[at_hot], minlength=b.n) + (1 if end else 0)
            rare = ~at_hot
            pairs, freq = np.unique(b.owner[rare].astype(np.int64) * (len(b.words) + 1) + b.codes[rare], return_counts=True)
            who, what = pairs // (len(b.words) + 1), pairs % (len(b.words) + 1)
            rid = row_ids(seen, b.n)
            seen += b.n
            none = lambda k, kind: pa.nulls(k, kind)
            yield pa.RecordBatch.from_pydict(
                {"rid": rid, "doc_id": t["doc_id"].chunk(0), "held_out": t["held_out"].chunk(0), "n_tokens": b.per_text.astype(np.int64) + 1, "known": known, "base": base, "score": score, "word": none(b.n, pa.string()), "freq": none(b.n, pa.int64())}
            )
            names = pa.array(b.words, pa.string())
            for a in range(0, len(what), 1 << 18):
                z = slice(a, a + (1 << 18))
                k = len(what[z])
                yield pa.RecordBatch.from_pydict(
                    {"rid": rid[who[z]], "doc_id": none(k, t["doc_id"].type), "held_out": none(k, pa.bool_()), "n_tokens": none(k, pa.int64()), "known": none(k, pa.int64()), "base": none(k, pa.float64()), "score": none(k, pa.float64()), "word": names.take(pa.array(what[z])), "freq": freq[z].astype(np.int64)}
                )

    return run


def lm_scores(docs: DataFrame) -> DataFrame:
    """Each document's unigram score and the model's, in log10, with the fold it is in and its numbers of tokens."""
    spark = docs.sparkSession
    arrow_rows(spark)
    fold = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS, F.lit(0))
    split = docs.select("doc_id", text_or_empty().alias("text"), (fold == HELD_OUT).alias("held_out"))
    learn = split.filter("not held_out")
    counts = stage(learn.select("text").mapInArrow(_count, "word string, c long").groupBy("word").agg(F.sum("c").alias("c")))
    end = learn.count()
    distinct, words_total = counts.agg(F.count("*"), F.coalesce(F.sum("c"), F.lit(0))).first()
    most = min(max(MODEL_WORDS, int(PER_ROOT * math.sqrt(words_total))), HOT // 2)
    words = [(r[0], r[1]) for r in counts.filter(F.col("c") >= LEAST_COUNT).orderBy(F.desc("c"), "word").limit(most).collect()]
    ids = {w: i + 1 for i, (w, _) in enumerate(words)}
    classes = max(MODEL_WORDS, len(words)) // 4
    hot = {r[0]: float(r[1]) for r in frequent(counts, "c", HOT).collect()} | {w: float(c) for w, c in words}
    # Each class has the smoothed counts of its words and of one unseen word.
    class_totals = np.full(classes, 0.5)
    of = F.crc32(F.expr(f"right(word, {ENDING})").cast("binary")) % classes
    for k, c, n in counts.groupBy(of.alias("k")).agg(F.sum("c"), F.count("*")).collect():
        class_totals[k] += c + 0.5 * n
    for w, c in words:
        class_totals[word_class(w, 0, classes)] -= c + 0.5
    total, kinds = words_total + end, distinct + (1 if end else 0)
    model = fit(learn, ids, np.concatenate([[end + 0.5], [c for _, c in words], class_totals]), classes)
    shared = spark.sparkContext.broadcast((model.flat, model.words, ids, classes, hot, end, class_totals))
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = split.mapInArrow(_scorer(shared), f"rid long, doc_id {kind}, held_out boolean, n_tokens long, known long, base double, score double, word string, freq long")
    # A document's own row gets a key that no word has, so that these rows spread over all partitions.
    keyed = rows.withColumn("key", F.coalesce("word", F.concat(F.lit(" "), F.col("rid").cast("string"))))
    joined = keyed.join(counts.select(F.col("word").alias("key"), "c"), "key", "left")
    rare = F.col("freq") * F.log10(F.coalesce(F.col("c"), F.lit(0)) + 0.5)
    sums = joined.groupBy("rid").agg(
        F.max("doc_id").alias("doc_id"), F.max("held_out").alias("held_out"), F.max("n_tokens").alias("n_tokens"),
        F.sum(F.coalesce(F.col("known"), F.when(F.col("c") > 0, F.col("freq")), F.lit(0))).alias("n_known"),
        F.sum(F.coalesce(F.col("base"), rare)).alias("b"), F.sum(F.coalesce(F.col("score"), rare)).alias("score"),
    )
    base = F.col("b") - F.col("n_tokens") * math.log10(total + 0.5 * (kinds + 1))
    return sums.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), base.alias("base_score"), "score")
