"""What a host's tree has to keep and to remove."""

import math
import random
import time
from collections import Counter, defaultdict

from symlattice.llm.style_tree import HIGHER, LOWER, OPEN, Page, _hash, extract_pages


def extracted(spark, pages):
    df = spark.createDataFrame([(i, f"http://{h}/{i}", x) for i, (h, x) in enumerate(pages)], "page_id long, url string, html string")
    return {r.page_id: r.text for r in extract_pages(df).collect()}


def test_copies_and_shared_texts(spark):
    """A third of the host is one page; one paragraph in five is on every page."""
    own = [f"<div><p>{'same' if i < 40 else i} a</p><p>{'same' if i < 40 else i} b</p><p>shared</p></div>" for i in range(120)]
    got = extracted(spark, [("h", x) for x in own])
    assert got == {i: f"{k} a\n{k} b" for i in range(120) for k in ["same" if i < 40 else i]}


def test_repeated_notice_in_articles(spark):
    got = extracted(spark, [("h", f"<article><p>text {i}</p><p>notice</p></article>") for i in range(30)])
    assert got == {i: f"text {i}" for i in range(30)}


def test_low_names_are_no_hard_zero(spark):
    wrap = '<div class="page with-menu"><div id="header-fixed">{}</div></div>'
    pages = [("a", wrap.format(f"<article><div class=post-header><h1>t{i}</h1></div><p>x{i}</p></article>")) for i in range(5)]
    pages += [("b", wrap.format(f"<p>main text {i}</p><div class=comments>c{i}</div>")) for i in range(5)]
    got = extracted(spark, pages)
    assert got == {i: f"t{i}\nx{i}" for i in range(5)} | {i + 5: f"main text {i}" for i in range(5)}


def test_small_hosts_have_their_own_trees(spark):
    """What eight pages of a small host share goes there, and stays where one page has it, however many other hosts there are."""
    pages = [("a", f"<div id=p{i}><p>a {i}</p><p>chrome</p></div>") for i in range(8)] + [("b", "<div id=p><p>chrome</p></div>")]
    pages += [(f"h{k}", f"<div id=p{k}><p>of {k}</p></div>") for k in range(90)]
    got = extracted(spark, pages)
    assert [got[i] for i in range(9)] == [f"a {i}" for i in range(8)] + ["chrome"]
    assert [got[9 + k] for k in range(90)] == [f"of {k}" for k in range(90)]


def test_deep_marks_and_self_closed_elements(spark):
    deep = "<div>" * 20
    got = extracted(spark, [("a", f"{deep}<article><p>in</p></article><aside>no</aside><div class=comments>c</div>"), ("b", '<p>one<svg class="i"/>two</p><p>three<svg><text>no</text></svg></p><iframe/>four')])
    assert got[0] == "in" and got[1].split() == ["onetwo", "three", "four"]


def test_broken_pages_end_soon():
    began = time.perf_counter()
    for part in ('<a b="', "<p ", "<!-- x ", "< "):
        assert [t for _, t in Page("<p>one</p>" + part * 500_000).blocks][0] == "one"
    assert time.perf_counter() - began < 60


def plain_texts(pages, entropies=True):
    """The texts that a host's tree gives by loops over its pages; without ``entropies``, every text says all it can."""
    hosts = {}
    for i, host, source in pages:
        hosts.setdefault(host, []).append((i, source, Page(source)))
    out = {}
    for found in hosts.values():
        one = {}
        for _, source, page in found:
            free = not any(node.kind == HIGHER for node, _ in page.blocks)
            same = tuple((node.path, text) for node, text in page.blocks if node.kind == (OPEN if free else HIGHER))
            one[same] = min(one.get(same, ("~",)), (f"{_hash(source):020d}", page, free), key=lambda x: x[0])
        at, texts, layouts = {}, defaultdict(list), defaultdict(Counter)
        for _, page, free in one.values():
            for key, n in Counter((node.path, text) for node, text in page.blocks if node.kind != LOWER).items():
                texts[key].append((n, free))
            at |= {(node.path, text): node for node, text in page.blocks}
            for path, shape in page.layouts:
                layouts[path][shape] += 1

        def entropy(counts):
            return -sum(c / sum(counts) * math.log(c / sum(counts)) for c in counts)

        looks = {p: entropy(c.values()) / math.log(max(sum(c.values()), 2)) for p, c in layouts.items()}
        says = {k: 1 - entropy([n for n, _ in c]) / math.log(len(one) + 1) if entropies else 1.0 for k, c in texts.items()}
        inner = defaultdict(list)
        for k, c in texts.items():
            inner[k[0]].append((sum(n for n, _ in c), says[k]))
        low = set()
        for k in texts:
            node, many = at[k], inner[k[0]]
            worth = 0.7 * sum(n * s for n, s in many) / sum(n for n, _ in many) + 0.3 * looks.get(node.parent, 0)
            if 0.8 * says[k] + 0.2 * (1 if node.kind == HIGHER else worth) < 0.3:
                low.add(k)
        weight = {k: sum(n for n, free in c if free) * len(k[1]) * says[k] for k, c in texts.items()}
        named = Counter()
        for k in texts:
            for name in at[k].named:
                named[name] += weight[k]
        main = {n for n, w in named.items() if w > 0.5 * sum(weight.values())}
        for i, _, page in found:
            stays = main if all(node.kind != HIGHER for node, _ in page.blocks) else set()
            out[i] = "\n".join(t for node, t in page.blocks if node.kind != LOWER and (node.path, t) not in low and stays.issuperset(node.named))
    return out


def test_equals_plain_trees(spark):
    """Whole pages and made hosts; what entropies say about the latter changes their texts."""
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    rows = [(r.page_id, (r.url or "").split("/")[2].lower() if "://" in (r.url or "") else "", r.html or "") for r in pages.collect()]
    got = {r.page_id: (r.text, r.n_chars) for r in extract_pages(pages).collect()}
    assert got == {i: (t, len(t)) for i, t in plain_texts(rows).items()}
    rng = random.Random(7)
    made = []
    for i in range(150):
        parts = [f"<p>{rng.choice(['own', 'seen'])} {rng.randrange(12)}</p>" for _ in range(rng.randrange(1, 6))] + ["<p>on most</p>"] * (rng.random() < 0.9) + ["<div class=comments>c</div>"] * (rng.random() < 0.5)
        rng.shuffle(parts)
        tag = rng.choice(("article", "div", "div"))
        made.append((f"h{rng.randrange(3)}", f"<{tag}>{''.join(parts)}</{tag}><footer>f</footer>"))
    rows = [(i, h, x) for i, (h, x) in enumerate(made)]
    want = plain_texts(rows)
    assert extracted(spark, made) == want and sum(want[i] != t for i, t in plain_texts(rows, False).items()) > 50


def test_all_class_words_name_a_path():
    """Branches that differ only in a later word of their class are branches of their own."""
    paths = [[node.path for node, _ in Page(f'<div class="a b c {x}"><p>text</p></div>').blocks] for x in ("d", "e", "d")]
    assert paths[0] != paths[1] and paths[0] == paths[2]
