"""The numbered operators against their SQL or brute force, at the smallest scale."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from compare import assert_same, connection
from symlattice.llm import imatch, pretokens
from symlattice.llm import queries as Q
from symlattice.llm.bestfit_pack import best_fit_runs
from symlattice.llm.near_dup import keep_one_of_each, near_duplicates
from symlattice.llm.secret_scan import trigram_query
from symlattice.llm.style_tree import Page

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def docs(spark):
    return {r[0]: r[1] or "" for r in Q.table(spark, SF, "documents").select("doc_id", "text").collect()}


@pytest.fixture(scope="module")
def ids(docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    return {k: t.encode(v, add_special_tokens=False).ids for k, v in docs.items()}


@pytest.mark.parametrize("name", sorted(Q.ORACLE_SQL))
def test_equals_its_sql(spark, name):
    assert_same(Q.QUERIES[name](spark, SF), connection(SF), Q.ORACLE_SQL[name])


def test_trigram_queries():
    assert trigram_query("[0-9a-f]{24,}") == []
    assert trigram_query("AKIA[A-Z0-9]+") == [frozenset({"aki", "kia"})]
    assert trigram_query("(abcd|xyz)q?") == [frozenset({"abc", "bcd"}), frozenset({"xyz"})]
    assert trigram_query("(abcd|xy)q?") == []


def test_repeated_passages(spark, docs):
    first, want = {}, {}
    for k in sorted(docs):
        b = docs[k].encode()
        gone = bytearray(len(b))
        for i in range(len(b) - 49):
            if first.get(b[i : i + 50], k) < k:
                gone[i : i + 50] = b"\1" * 50
        for i in range(len(b) - 49):
            first.setdefault(b[i : i + 50], k)
        spans = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        want[k] = (len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest())
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in Q.op2_suffix_dedup(spark, SF).collect()}
    assert got == want


def test_token_counts(spark, docs, ids):
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in Q.op3_token_counts(spark, SF).collect()}
    assert got == {k: (len(docs[k].encode()), len(v), len(v) > 2048) for k, v in ids.items()}


def test_main_text(spark):
    src = {r.page_id: r.html or "" for r in Q.table(spark, SF, "pages").collect()}
    for r in Q.op4_style_tree(spark, SF).collect():
        want = Page(re.search("<article>.*", src[r.page_id], re.S)[0].partition("</article>")[0])
        assert r.text == "\n".join(t for _, t in want.blocks) and r.n_chars == len(r.text)


def test_language_model(spark, docs):
    held = {k: zlib.crc32(str(k).encode()) % 5 == 1 for k in docs}
    words = {k: v.encode().lower().split() + [None] for k, v in docs.items()}
    c = Counter(w for k, ws in words.items() if not held[k] for w in ws)
    n, v = sum(c.values()), len(c)
    rows = Q.op5_loglinear_lm(spark, SF).collect()
    for r in rows:
        ws = words[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[r.doc_id], len(ws), sum(w in c for w in ws), n)
        assert r.base_score == pytest.approx(sum(np.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws))
    out = [r for r in rows if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)


def test_quality(spark, docs):
    for r in Q.op7_quality_rules(spark, SF).collect():
        text = docs[r.doc_id]
        w = WORD.findall(text)
        grams = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
        n, cover = Counter(grams), set()
        for i, g in enumerate(grams):
            if n[g] > 1:
                cover.update(range(i, i + 8))
        lines = [x for x in text.split("\n") if WORD.search(x)]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(cover))
        assert r.base_failed == (len(w) < 20 or 100 * len(cover) > 30 * len(w)) and not (r.base_failed and r.kept)


def test_quality_keeps_clean_documents(spark):
    good = {r.doc_id: r.quality for r in Q.table(spark, SF, "labels").collect()}
    for r in Q.op7_quality_rules(spark, SF).collect():
        if r.doc_id in good and not r.base_failed:
            assert r.kept == (good[r.doc_id] == 1)


@pytest.mark.parametrize("first", range(0, 0x3400, 0x400))
def test_ids_of_every_code_point(first):
    tok = pretokens.tokenizer()
    for frame in ("a{}b", "{}", "9{}'s {}A"):
        texts = [frame.replace("{}", chr(c)) for c in range(first, first + 0x400)]
        coded, at = pretokens.Coded(pa.array(texts)), 0
        for i, (text, n) in enumerate(zip(texts, coded.per_text)):
            fast = [p for k in coded.codes[at : at + n] for p in pretokens.SPLIT.findall(coded.words[k])]
            at += n
            found = pretokens.odd_pretokens(text, tok) if coded.odd[i] else fast
            assert [x for p in found for x in pretokens.piece_ids(p, tok)] == tok.encode(text, add_special_tokens=False).ids, hex(first + i)


def test_packing(spark, ids):
    places, seen = {}, {}
    for r in Q.op8_bestfit_packing(spark, SF).collect():
        part = (ids[r.doc_id] + [1])[r.start : r.start + r.length]
        assert len(part) == r.length and r.start == 4096 * r.piece and zlib.crc32(np.array(part, "<u4").tobytes()) == r.ids_crc32
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
        seen[r.doc_id] = seen.get(r.doc_id, 0) + r.length
    assert seen == {k: len(v) + 1 for k, v in ids.items()}
    for p in places.values():
        end = 0
        for at, n in sorted(p):
            assert at == end
            end += n
        assert end <= 4096


def test_packing_is_best_fit_decreasing():
    rng = np.random.default_rng(3)
    for _ in range(100):
        cap = int(rng.choice([10, 37, 64]))
        sizes = rng.choice(np.arange(1, cap + 1), int(rng.integers(1, 9)), replace=False)
        hist = [(int(s), int(rng.integers(1, 9))) for s in sizes]
        bins = []
        for s, n in sorted(hist, reverse=True):
            for _ in range(n):
                fits = [i for i, room in enumerate(bins) if room >= s]
                i = min(fits, key=bins.__getitem__) if fits else len(bins)
                bins[i : i + 1] = [(bins[i] if fits else cap) - s]
        used = Counter()
        for length, _, n, each, first, _ in best_fit_runs(hist, cap):
            for k in range(n):
                used[first + k // each] += length
        assert sorted(cap - u for u in used.values()) == sorted(bins)


def test_fingerprints(spark, docs):
    frame = Q.table(spark, SF, "documents").select("doc_id", "text")
    codes = {}
    for r in imatch.lexicon(frame).collect():
        codes.setdefault(r.term, set()).add(r.code)
    words = lambda s: {w for w in re.split(r"[\x20\x09-\x0D]+", s.lower()) if w}
    df = Counter(w for s in docs.values() for w in words(s))
    assert set(codes) == {w for w, k in df.items() if k >= 2 and imatch.LEAST * len(docs) <= k <= max(2, imatch.MOST * len(docs))}
    subsets = {w: {c >> imatch.CODE for c in x} for w, x in codes.items()}
    assert all(sum(k < imatch.EVEN for k in x) == 1 and all(k < imatch.SUBSETS for k in x) for x in subsets.values())

    def cut(s):
        """A text's terms in each subset; all its terms in each without any of the lexicon."""
        found = words(s) & set(codes)
        return [frozenset(w for w in found if k in subsets[w]) if found else frozenset(words(s) | {""}) for k in range(imatch.SUBSETS)]

    def alike(a, b):
        used = sum(bool(x or y) for x, y in zip(a, b))
        return round(sum(x == y and bool(x) for x, y in zip(a, b)) / max(1, used), 6)

    order = sorted(docs, reverse=True)
    after = dict(zip(order, order[1:] + order[:1]))
    rows = {r.doc_id: r for r in Q.op9_imatch(spark, SF).collect()}
    by_text = {}
    for k, r in rows.items():
        s = docs[k]
        half = len(s) // 2
        edited = s[: len(s) - half] + docs[after[k]][:half]
        assert r.n_chars == len(s) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert by_text.setdefault(s, r.fingerprint) == r.fingerprint
        assert r.near_edited == pytest.approx(alike(cut(s), cut(edited)), abs=1e-6)
        assert r.near_next == pytest.approx(alike(cut(s), cut(docs[after[k]])), abs=1e-6)
    assert len({r.fingerprint for r in rows.values()}) == len({tuple(cut(s)) for s in docs.values()})


def test_ring_of_repeated_ids(spark):
    """Repeated rows share a place; other texts of one id have places of their own; one place follows itself."""
    rows = [(1, "aa bb"), (1, "aa bb"), (2, "cc dd"), (2, "ee ff"), (None, "gg hh"), (None, "gg hh")]
    got = imatch.imatch_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0) for r in got) == [0, 0, 1, 1, 2, 2]
    assert len({r.edited_sha256 for r in got if r.doc_id == 1}) == 1
    assert {r.edited_sha256 for r in got if r.doc_id is None} == {hashlib.sha256(b"gg ").hexdigest()}
    assert all(r.near_next == 0 for r in got)
    alone = imatch.imatch_report(spark.createDataFrame([(7, "aa bb")], "doc_id long, text string")).collect()
    assert alone[0].near_next == 1 and alone[0].edited_sha256 == hashlib.sha256(b"aa aa").hexdigest()


def brute_components(docs):
    sets = {}
    for k, v in docs.items():
        w = v.encode().lower().split()
        sets[k] = {tuple(w[i : i + 3]) for i in range(len(w) - 2)} if len(w) > 2 else {tuple(w)} if w else set()
    root = {k: k for k in docs}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in docs:
        for b in docs:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {k: (len(sets[k]), find(k), find(k) == k) for k in docs}


def test_near_duplicates(spark, docs):
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in Q.op10_minhash_near_dup(spark, SF).collect()}
    assert got == brute_components(docs)


def test_links_that_stars_miss(spark):
    """Many edited copies of a text, at the edge of the threshold."""
    rng = np.random.default_rng(11)
    base = [f"w{i}" for i in range(150)]
    docs = {}
    for k in range(150):
        words = list(base)
        for at in rng.choice(150, int(rng.integers(2, 8)), replace=False):
            words[at] = f"x{k}_{at}"
        docs[k] = " ".join(words)
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_duplicates(df).collect()}
    assert got == brute_components(docs)


def test_links_across_sizes(spark):
    """Texts that grow out of each other, so that links have sets of unlike sizes, among copies that share most shingles."""
    rng = np.random.default_rng(5)
    base = [f"w{i}" for i in range(120)]
    docs = {}
    for k in range(120):
        words = base[: int(rng.integers(95, 121))] + [f"y{k}_{i}" for i in range(int(rng.integers(0, 12)))]
        words[int(rng.integers(0, 90))] = f"x{k % 9}"
        docs[k] = " ".join(words)
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_duplicates(df).collect()}
    assert got == brute_components(docs)


def test_one_of_each_loses_no_text(spark):
    a, b = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(30))
    rows = [(1, a, 0), (1, b, 1), (2, b, 2), (3, a, 3), (4, "", 4), (4, None, 4), (5, None, 5), (None, a, 6), (None, a, 6), (1, a, 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n int")
    got = sorted(((r.doc_id or 0), r.text or "") for r in keep_one_of_each(df).collect())
    assert got == sorted([(0, a), (0, a), (1, a), (1, b), (4, ""), (5, "")])


def test_groups_of_copies_that_are_not_linked(spark):
    """Three groups of k near copies, alike by about 0.82: what is compared grows with k, not with its square."""
    from symlattice.llm import near_dup

    seen = []
    for k in (20, 40):
        r = np.random.default_rng(7)
        base = [f"b{i}" for i in range(400)]
        rows = []
        for g in range(3):
            own = list(base)
            for i in range(6):
                own[66 * i + 20 * g] = f"g{g}x{i}"  # 0.81 to 0.83 between groups
            for c in range(k):
                copy = list(own)
                copy[int(r.integers(400))] = f"c{g}y{c}"
                rows.append((g * 1000 + c, " ".join(copy)))
        pairs = []
        plain = near_dup.leftover_pairs

        def counted(rows, full):
            out = near_dup.stage(plain(rows, full))
            pairs.append(out.count())
            return out

        near_dup.leftover_pairs = counted
        try:
            got = {x.doc_id: x.component_id for x in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
        finally:
            near_dup.leftover_pairs = plain
        assert got == {i: i // 1000 * 1000 for i, _ in rows} == {i: x[1] for i, x in brute_components(dict(rows)).items()}
        seen.append(sum(pairs))
    assert seen[1] <= 3 * seen[0] + 40, seen
