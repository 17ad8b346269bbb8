"""The model's vocabulary and its normalising."""

import numpy as np
import pytest

from symlattice.llm.loglinear_lm import END, Model, lm_scores, train


def test_two_levels_sum_to_one():
    rng = np.random.default_rng(1)
    n = 203
    m = Model.fresh(rng.dirichlet(np.ones(n)))
    m.flat[:] += rng.normal(0, 0.3, len(m.flat)).astype(np.float32)
    w, h = np.arange(n), np.full(n, 7)
    assert np.exp(m.log_probs(w, h, np.full(n, END))).sum() == pytest.approx(1, abs=1e-4)


def test_rare_words_have_contexts(spark):
    """Words beyond the 2000 most frequent ones follow their own kind; a model with one token for all of them can't tell."""
    rng = np.random.default_rng(2)
    frequent = " ".join(f"f{i}" for i in range(2000))
    rows = [(10_000 + k, frequent) for k in range(60)]
    rows += [(k, " ".join(f"{rng.integers(3000)}{'xyz' if k % 2 else 'uvw'}" for _ in range(60))) for k in range(1200)]
    rows += [(None, "")]
    same, mixed = "77xyz 5xyz 901xyz 18xyz 333xyz 1200xyz", "77xyz 5uvw 901xyz 18uvw 333xyz 1200uvw"
    held = [k for k in range(20_000, 20_100) if __import__("zlib").crc32(str(k).encode()) % 5 == 1][:2]
    rows += [(held[0], same), (held[1], mixed)]
    got = {r.doc_id: r.score - r.base_score for r in lm_scores(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[held[0]] > got[held[1]] + 1


def test_two_levels_by_hand():
    """The batched products against one token at a time, in double precision."""
    rng = np.random.default_rng(4)
    m = Model.fresh(rng.dirichlet(np.ones(77)))
    m.flat[:] += rng.normal(0, 0.5, len(m.flat)).astype(np.float32)
    w, h1, h2 = (rng.integers(0, 77, 500) for _ in range(3))
    r, q, b, gr, gb, c = (getattr(m, k).astype(float) for k in ("r", "q", "b", "gr", "gb", "c"))
    for got, i, a1, a2 in zip(m.log_probs(w, h1, h2), w, h1, h2):
        x, g = c[0] * q[a1] + c[1] * q[a2], i // m.size
        mine = slice(g * m.size, (g + 1) * m.size)
        of_group, inside = gr @ x + gb, r[mine] @ x + b[mine]
        want = of_group[g] - np.log(np.exp(of_group).sum()) + inside[i - g * m.size] - np.log(np.exp(inside).sum())
        assert got == pytest.approx(want, abs=1e-4)


def test_training_learns_what_follows():
    rng = np.random.default_rng(6)
    w = np.cumsum(rng.integers(1, 3, 40_000)) % 40 + 1
    h1, h2 = np.append(END, w[:-1]), np.append([END, END], w[:-2])
    m = Model.fresh(np.full(41, 1 / 41))
    before = m.log_probs(w, h1, h2).mean()
    assert train(m, np.full(41, 1 / 41), iter([(w, h1, h2)] * 6), 1) == 6 * len(w)
    assert before == pytest.approx(-np.log(41), abs=0.1) and m.log_probs(w, h1, h2).mean() > -1.2
