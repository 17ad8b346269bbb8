"""The pipeline against plain Python, stage by stage in effect, at the smallest scale."""

import hashlib
import re
import unicodedata
import zlib
from collections import Counter

import numpy as np

import corpus_pipeline
from symlattice.llm.curriculum_mix import MOST, SHARE, WEIGHTS
from symlattice.llm.secret_scan import RULES
from test_operators import SF, WORD, brute_components


def passes(text):
    words = WORD.findall(text)
    n, chars = len(words), sum(map(len, words))
    grams = [tuple(words[i : i + 8]) for i in range(n - 7)]
    times, cover = Counter(grams), set()
    for i, g in enumerate(grams):
        if times[g] > 1:
            cover.update(range(i, i + 8))
    kinds = Counter(unicodedata.category(c) for c in text)
    letters = sum(v for k, v in kinds.items() if k[0] == "L")
    lines = [x for x in text.split("\n") if WORD.search(x)]
    again = len(lines) - len(set(lines))
    return not (
        n < 20 or 100 * len(cover) > 30 * n or 10 * len(re.findall(r"[#*$%&|<>]", text)) > 3 * n or 2 * kinds["Lu"] > letters or 2 * text.count("!") > n
        or 100 * sum(a == b for a, b in zip(words, words[1:])) > 30 * n or chars < 2 * n or chars > 20 * n or 2 * letters < chars or again > 3 and 100 * again > 30 * (text.count("\n") + 1)
    )


def masked(text):
    found = sorted((m.start(), i, m.end()) for i, r in enumerate(RULES) for m in re.finditer(r.pattern, text, re.ASCII) if len(m[r.group]) >= r.least)
    at, out = 0, ""
    for start, _, end in found:
        if start >= at:
            out += text[at:start] + "<secret>"
        at = max(at, end)
    return out + text[at:] if found else text


def rounds(docs):
    """How often the mix takes each document."""
    size = {k: len(WORD.findall(t)) for k, (t, _) in docs.items()}
    total = Counter()
    for k, (_, s) in docs.items():
        total[s] += size[k]
    names = sorted(total, key=lambda s: (s is None, s))
    weight = {s: WEIGHTS[i % len(WEIGHTS)] for i, s in enumerate(names)}
    target, rest = {}, SHARE * sum(total.values())
    open_ = set(names)
    while open_:  # reshare what is above a cap until nothing is
        level = rest / sum(weight[s] for s in open_)
        full = {s for s in open_ if MOST * total[s] < level * weight[s]}
        if not full:
            target |= {s: level * weight[s] for s in open_}
            break
        target |= {s: float(MOST * total[s]) for s in full}
        rest -= sum(MOST * total[s] for s in full)
        open_ -= full
    out, place = {}, Counter()
    for k in sorted(docs, key=lambda k: (hashlib.md5(str(k).encode()).hexdigest(), k)):
        s = docs[k][1]
        whole = int(target[s] // max(1, total[s]))
        out[k] = whole + (2 * place[s] + size[k] <= 2 * (target[s] - whole * total[s])) if size[k] else 0
        place[s] += size[k]
    return out


def test_pipeline_equals_plain_python(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "source").collect()
    good = {r.doc_id: (r.text, r.source) for r in rows if passes(r.text or "")}
    kept = {k for k, x in brute_components({k: t for k, (t, _) in good.items()}).items() if x[2]}
    docs = {k: (masked(good[k][0]), good[k][1]) for k in kept}
    times = rounds(docs)
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = Counter()
    for k, n in times.items():
        ids = np.array(t.encode(docs[k][0], add_special_tokens=False).ids + [1], "<u4")
        for i, a in enumerate(range(0, len(ids), 4096)):
            part = ids[a : a + 4096]
            want[k, i, a, len(part), zlib.crc32(part.tobytes())] += n
    got, places = Counter(), {}
    for r in corpus_pipeline.run(spark, SF).collect():
        got[r.doc_id, r.piece, r.start, r.length, r.ids_crc32] += 1
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert got == +want
    for p in places.values():
        assert sum(n for _, n in p) <= 4096 and all(a + n == b for (a, n), (b, _) in zip(sorted(p), sorted(p)[1:])) and min(p)[0] == 0
