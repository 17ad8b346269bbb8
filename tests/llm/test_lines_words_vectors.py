"""Line dedup, spelling groups and centroid clusters against brute force, and their odd rows."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from symlattice.llm import centroid_clusters, line_dedup, spelling_groups
from symlattice.llm import queries as Q

SF = "/root/testdata/sf0.001"
LOWERED = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def order(i):
    return (i is None, i or 0)


def brute_lines(rows):
    def key(line):
        return line.strip(" \t\n\x0b\f\r").translate(LOWERED)

    first = {}
    for i, t in rows:
        for line in (t or "").split("\n"):
            first[key(line)] = min(first.get(key(line), (True, 1)), order(i))
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(key(x)) < 10 or first[key(x)] == order(i)]
        out.append((i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(map(repr, out))


ODD = [
    (1, "a line that repeats\nshort\n\n  A LINE that repeats\t\nown line of one"),
    (2, "short\na line that repeats\nshort"),
    (2, "a second row of two\nA Line That Repeats"),
    (2, "a second row of two\nA Line That Repeats"),
    (None, "only without an id\na second row of two"),
    (None, "only without an id"),
    (3, None),
    (4, ""),
    (5, "\n"),
    (6, "ÄÖÜ äöü ßßß\näöü äöü ßßß\nＡ wide line here "),
    (7, "äöü äöü ßßß\nÄÖÜ äöü ßßß\n Ａ wide line here"),
    (8, "\n".join(f"line number {i % 9000} of a long one" for i in range(30_000))),
    (9, "\n".join(f"line number {i % 9000} of a long one" for i in range(500, 20_000))),
    (-4, "line number 777 of a long one\n\n\x0bline number 778 of a long one"),
]


def line_rows(df):
    return sorted(repr(tuple(r)) for r in line_dedup.line_report(df).collect())


@pytest.mark.parametrize("back", [False, True])
def test_odd_lines(spark, back):
    rows = ODD[::-1] if back else ODD
    df = spark.createDataFrame([(i, t, "x", 1, True) for i, t in rows], "doc_id long, text string, key string, h int, old boolean")
    assert line_rows(df) == brute_lines(ODD)
    assert line_rows(df.limit(0)) == []


def test_a_line_in_most_documents(spark):
    rows = [(i, f"the line that all have\nown line number {i}\npair of lines {i // 2}") for i in range(700)]
    assert line_rows(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)) == brute_lines(rows)


def test_runs_over_many_batches(spark):
    """Levels: every batch is a run, every third merges; a line counts as old in all later batches."""
    store = line_dedup.LineRuns(spark, fanout=2)
    seen = set()
    for b in range(7):
        words = [f"line {random.Random(b * 50 + i).randrange(120)} of some text" for i in range(60)]
        lines = line_dedup.line_hashes(spark.createDataFrame([(b, "\n".join(words))], "doc_id long, text string"))
        got = store.admit(lines)
        assert got.filter("old").count() == len(set(words) & seen) and got.count() == len(set(words))
        seen |= set(words)
        assert [len(x) for x in store.levels] == [(b + 1) >> i & 1 for i in range(len(store.levels))]
    runs = store.runs()
    assert sum(r.count() for r in runs) == len(seen)
    with line_dedup.sorted_scans(spark):
        met = line_dedup.line_hashes(spark.createDataFrame([(1, "x")], "doc_id long, text string")).join(runs[0].hint("merge"), ["h", "g"], "left_anti")
        plan = met._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.count("Sort [") == 1 and "Bucketed: true" in plan  # only the batch moves
    store.drop()


def brute_words(rows):
    n = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = run.translate(LOWERED)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    words = {w: c for w, c in n.items() if len(w) >= 7 and c >= 2}
    by, near = defaultdict(set), defaultdict(set)
    for w in words:
        for k in {w} | {w[:p] + w[p + 1 :] for p in range(len(w))}:
            by[k].add(w)
    for group in by.values():
        for a in group:
            for b in group - {a}:
                if len(a) == len(b):
                    if sum(x != y for x, y in zip(a, b)) == 1:
                        near[a].add(b)
                elif abs(len(a) - len(b)) == 1:
                    s, t = sorted((a, b), key=len)
                    if any(t[:p] + t[p + 1 :] == s for p in range(len(t))):
                        near[a].add(b)
    form = {}
    for w in words:
        if near[w]:
            best = min(near[w], key=lambda x: (-words[x], x))
            if words[best] >= 10 * words[w]:
                form[w] = best
    out = []
    for w in words:
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, words[w], len(near[w]), words.get(form.get(w))))
    return sorted(map(repr, out))


def word_rows(df):
    return sorted(repr(tuple(r)) for r in spelling_groups.spelling_groups(df).collect())


def test_spelling_groups(spark):
    rows = [tuple(r) for r in Q.table(spark, SF, "documents").select("doc_id", "text").collect()]
    got = word_rows(Q.table(spark, SF, "documents"))
    assert got == brute_words(rows) and len(got) > 1000


def test_odd_words(spark):
    r = random.Random(5)
    dense = ["".join(r.choice("abÀ") for _ in range(r.choice((7, 8)))) for _ in range(900)]
    rows = [
        (1, "aaaaaaa " * 2 + "aaaaaaaa " * 20 + "aaaaaaaaa " * 200 + "aaaaaaaaaa " * 2000),
        (2, "Überall überall ÜBERALL überalL äberall äberall ×÷×÷×÷× ×÷×÷×÷×"),
        (None, "separate seperate separete separaate separat eparate " * 2),
        (None, "separate " * 30),
        (3, None),
        (4, ""),
        (5, "abcdefg" * 2000 + " " + "abcdefg" * 2000),
        (6, " ".join(dense * 2)),
        (6, " ".join(dense * 2)),
        (7, "separate1seperate_separate-separate'separate中separate"),
    ]
    df = spark.createDataFrame([(i, t, "w", 1) for i, t in rows], "doc_id long, text string, word string, n int")
    assert word_rows(df) == brute_words(rows)
    assert word_rows(df.limit(0)) == [] and word_rows(df.filter("doc_id = 3")) == []


def test_any_parts_give_the_same_pairs(spark):
    r = random.Random(4)
    words = spark.createDataFrame([(w, 2) for w in {"".join(r.choice("abcd") for _ in range(7)) for _ in range(500)}], "word string, n long")
    want = None
    for parts in (2, 3, 5, 7):
        got = sorted(map(tuple, spelling_groups.near_words(words, parts).collect()))
        assert len(got) == len(set(got)) > 50 and (want is None or got == want)
        want = got


def brute_clusters(rows, k=40, rounds=5):
    kept = [(i, np.floor(256 * np.array(v, float)).astype(int).tolist(), v) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and np.isfinite(x) and abs(x) < 2**18 for x in v)]
    first = sorted(kept, key=lambda r: (hashlib.sha256(f"2:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[2]))[:k]
    centroids = [v for _, v, _ in first]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(centroids))

    for r in range(rounds + 1):
        found = [nearest(v) for _, v, _ in kept]
        if r < rounds:
            for c in range(len(centroids)):
                mine = [v for (_, v, _), f in zip(kept, found) if f[1] == c]
                if mine:
                    centroids[c] = [sum(x) // len(mine) for x in zip(*mine)]
    inertia = Counter()
    for d, c in found:
        inertia[c] += d
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(repr((i, c, d, inertia[c], sum(inertia.values()), sha[c])) for (i, _, _), (d, c) in zip(kept, found))


def vector_rows(df):
    return sorted(repr(tuple(r)) for r in centroid_clusters.cluster_report(df).collect())


def test_odd_vectors(spark):
    r = random.Random(3)
    grid = [[float(r.randrange(-1, 2)) for _ in range(64)] for _ in range(30)]
    rows = [(i, grid[i % 30] if i % 3 else grid[0]) for i in range(150)]
    rows += [(i, [r.gauss(0, 0.01) for _ in range(64)]) for i in range(150, 200)]
    rows += [(1, grid[2]), (1, grid[1]), (None, grid[3]), (None, grid[3]), (501, None), (502, []), (503, [1.0] * 63), (504, [1.0] * 65), (505, [None] + [1.0] * 63)]
    rows += [(506, [float("nan")] + [1.0] * 63), (507, [float("inf")] + [1.0] * 63), (508, [-1e30] + [0.0] * 63), (509, [-262143.5] * 64), (510, [262143.5] * 64)]
    df = spark.createDataFrame([(i, v, 1, "n") for i, v in rows], "vec_id long, embedding array<double>, cluster int, n string")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert vector_rows(df) == brute_clusters(rows)
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before
    few = [x for x in rows if x[0] in (1, 150, 151)]
    assert vector_rows(df.filter("vec_id in (1, 150, 151)")) == brute_clusters(few)
    assert vector_rows(df.limit(0)) == [] and vector_rows(df.filter("vec_id = 501")) == []


def test_tree_finds_what_a_full_search_finds():
    r = np.random.default_rng(1)
    for k in (1, 4, 5, 6, 40, 300):
        centroids = r.integers(-3, 4, (k, 64)) * (r.random((k, 64)) < 0.1)
        tree = centroid_clusters.tree_over(centroids)
        q = np.concatenate([r.integers(-3, 4, (500, 64)) * (r.random((500, 64)) < 0.1), centroids, (centroids + centroids[::-1]) // 2])
        d = ((q[:, None] - centroids[None]) ** 2).sum(-1)
        arg, best = tree.nearest(q)
        assert (best == d.min(1)).all() and (arg == d.argmin(1)).all()
