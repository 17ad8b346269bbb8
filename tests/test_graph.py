"""Projects: ignore rules, extraction, building, increments, questions, sessions and skills."""

import json
import random
import sqlite3

import pytest
from pyspark.sql import functions as F

from symlattice.functions.text import approximate_tokens, cut_bytes, decoded_line, import_directory, is_blocked_path, is_dangerous, is_sensitive, signature_arity, timestamp_of, timestamp_text
from symlattice.operators import chat, fts, lines, lookup, semantic, traverse
from symlattice.plans.engine import COLUMNS, TABLES, Engine, build, clamped
from symlattice.sources import catalog, project, symbols

SHAPES = """package shapes

import (
\t"fmt"
\tmath2 "example/m/mathx"
)

type Shape interface {
\tArea() float64
}

type Base struct{ id int }

// Area of a base.
func (b *Base) Area() float64 { return 0 }

type Square struct {
\tBase
\tside float64
}

const limit = 3

var total int

// Sum adds.
func Sum(a, b int) int {
\ttotal += a
\treturn helper(a) + math2.Twice(b) + limit
}

func helper(x int) int { fmt.Println(x); return x }
"""
MATHX = "package mathx\n\nfunc Twice(n int) int { return n + n }\n"
PY = "class Greeter:\n    def greet(self, name):\n        return helper(name)\n\ndef helper(x):\n    return x\n"
BRACED = {
    "ts": "class Greeter { greet(name: string): string { return helper(name); } }\nfunction helper(x: string) { return x; }\n",
    "java": "class Greeter { String greet(String n) { return helper(n); } String helper(String n) { return n; } }\n",
    "rs": "struct Greeter;\nimpl Greeter { fn greet(&self) -> i32 { helper(1) } }\nfn helper(x: i32) -> i32 { x }\n",
    "cpp": "class Greeter { public: int greet(int n) { return helper(n); } };\nint helper(int n) { return n; }\n",
    "cs": "class Greeter { int greet(int n) { return helper(n); } int helper(int n) { return n; } }\n",
    "php": "<?php class Greeter { function greet($n) { return helper($n); } }\nfunction helper($n) { return $n; }\n",
    "kt": "class Greeter { fun greet(n: Int): Int { return helper(n) } }\nfun helper(n: Int): Int { return n }\n",
    "scala": "class Greeter { def greet(n: Int): Int = { helper(n) } }\nobject M { def helper(n: Int): Int = { n } }\n",
    "dart": "class Greeter { int greet(int n) { return helper(n); } }\nint helper(int n) { return n; }\n",
    "rb": "class Greeter\n  def greet(n)\n    helper(n)\n  end\nend\ndef helper(n)\n  n\nend\n",
}


@pytest.fixture()
def tree(tmp_path):
    root = tmp_path / "proj"
    for path, text in {"go.mod": "module example/m\n", "shapes.go": SHAPES, "mathx/mathx.go": MATHX, "tools/greet.py": PY, "node_modules/a.js": "function no() {}", "a.log": "x", ".gitignore": "skipped/\n", "skipped/b.go": "package b\n", "README.md": "#"}.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_text(text)
    return root


def test_scan(spark, tree):
    rows = project.scan(spark, str(tree)).collect()
    assert sorted(r.path for r in rows) == ["mathx/mathx.go", "shapes.go", "tools/greet.py"]
    assert all(r.fingerprint.count(":") == 2 for r in rows) and project.module_name(spark, str(tree)) == "example/m"


def test_build(spark, tree):
    graphs = symbols.file_graphs(project.scan(spark, str(tree))).cache()
    nodes, edges = build(graphs, "example/m")
    by_id = {r.id: r for r in nodes.collect()}
    assert sorted(by_id) == list(range(len(by_id)))
    by_name = {(r.receiver, r.name): r for r in by_id.values()}
    assert by_name["", "Square"].embeds == ["Base"] and by_name["", "Sum"].signature == "(a, b int) int" and by_name["", "Sum"].doc == "Sum adds."
    assert by_name["Shape", "Area"].kind == 2 and by_name["Greeter", "greet"].kind == 2
    got = {(by_id[e.from_id].name, by_id[e.to_id].name, e.kind) for e in edges.collect()}
    assert {("Sum", "helper", 1), ("Sum", "Twice", 1), ("Sum", "total", 2), ("Sum", "limit", 2), ("greet", "helper", 1), ("Area", "Area", 3)} <= got


def test_languages(spark):
    df = spark.createDataFrame([(f"x.{e}", bytearray(t, "utf-8")) for e, t in BRACED.items()], "path string, content binary")
    for r in symbols.file_graphs(df).collect():
        names = {(n.receiver, n.name) for n in r.nodes}
        assert ("Greeter", "greet") in names and "helper" in {n for _, n in names}, (r.path, names)
        assert "helper" in {x.name for x in r.refs}, r.path


def test_grouped_declarations():
    source = "package p\n\nconst (\n\tA = iota\n\tB\n\tx, y = 1, f(\n\t\t2)\n)\n\nvar (\n\tm = map[string]int{\n\t\t\"k\": 1,\n\t}\n)\n\ntype (\n\t// T is one.\n\tT struct {\n\t\tBase\n\t\tn int\n\t}\n\tI interface {\n\t\tDo(a int) error\n\t}\n\tF func(int) int\n)\n\nfunc G() { A() }\n"
    nodes, _, _ = symbols.parse_go(source)
    got = [(n["kind"], n["name"], n["receiver"], n["line"]) for n in nodes]
    assert got == [(7, "A", "", 4), (7, "B", "", 5), (7, "x", "", 6), (7, "y", "", 6), (6, "m", "", 11), (5, "T", "", 18), (4, "I", "", 22), (2, "Do", "I", 23), (3, "F", "", 25), (1, "G", "", 28)]
    assert next(n for n in nodes if n["name"] == "T")["embeds"] == ["Base"]


def test_edges_have_ids_of_their_own(spark):
    """Two calls on one line are two edges, in the order in which they stand."""
    text = "package p\n\nfunc a() int { return c() + b() + c() }\n\nfunc b() int { return 1 }\n\nfunc c() int { return 2 }\n"
    df = spark.createDataFrame([("p/x.go", bytearray(text, "utf-8"))], "path string, content binary")
    nodes, edges = build(symbols.file_graphs(df), "m")
    name = {r.id: r.name for r in nodes.collect()}
    rows = sorted((r.edge_id, name[r.to_id]) for r in edges.filter("kind = 1").collect())
    assert [n for _, n in rows] == ["c", "b", "c"] and len({k for k, _ in rows}) == 3


def test_edges_stand_in_the_order_of_files(spark):
    """An edge of a nested symbol doesn't come after those of the symbols around it, but where its call stands."""
    text = "class A { one() { const x = () => { b() }; c() } }\nfunction b() {}\nfunction c() {}\nfunction d() { c() }\n"
    nodes, edges = build(symbols.file_graphs(spark.createDataFrame([("p/x.ts", bytearray(text, "utf-8"))], "path string, content binary")), "m")
    name = {r.id: r.name for r in nodes.collect()}
    rows = [(name[r.from_id], name[r.to_id]) for r in edges.orderBy("edge_id").collect()]
    assert rows == [("x", "b"), ("one", "c"), ("d", "c")] and [name[i] for i in sorted(name)] == ["A", "one", "x", "b", "c", "d"]


def test_nested_signatures(spark):
    want = {
        "": (0, 0), "()": (0, 0), "() error": (0, 1), "(a, b int) (int, error)": (2, 2), "(m map[string]func(a, b int) (c, d int), n int) []string": (2, 1),
        "(f func(func(func(a, b int)) (x, y int)), n int) func(a, b int) (int, error)": (2, 1), "(s struct{ a, b int }) (func(a, b int), map[k]v, error)": (1, 3), "(a int) ()": (1, 0),
    }
    df = spark.createDataFrame(list(enumerate(want)), "i int, s string")
    got = {r.s: (r.x.n_params, r.x.n_results) for r in df.select("s", signature_arity(F.col("s")).alias("x")).collect()}
    assert got == want


def test_engine(spark, tree, tmp_path):
    e = Engine(spark, str(tree), str(tmp_path / "index"), buckets=2)
    with pytest.raises(LookupError):
        e.callers("helper")
    assert e.reindex() == 1 and e.reindex() == 1
    assert {r.from_label.split(" ")[0] for r in e.callees("Sum").collect()} == {"Sum"}
    assert {r.to_label.split(" ")[0] for r in e.callees("Sum").collect()} == {"helper", "Twice"}
    assert e.search("Twice").first()["name"] == "Twice" and e.search("wic").first()["name"] == "Twice"
    assert [r.num for r in e.node("Twice")["source"].collect()] == [1, 2, 3, 4]
    (tree / "mathx/mathx.go").write_text(MATHX + "\nfunc Thrice(n int) int { return Twice(n) + n }\n")
    (tree / "tools/greet.py").unlink()
    assert e.reindex() == 2
    assert {r.file for r in e.read("nodes").collect()} == {"shapes.go", "mathx/mathx.go"}
    assert e.callers("Twice", depth=1).count() == 2


def letters(works=True):
    """An embedder for tests: counts of four letters. Its class is a local one, as workers don't import this module."""

    class Letters:
        dim = 4

        def embed(self, texts):
            if not works:
                raise RuntimeError("no model")
            assert len(texts) <= 64 and all(texts)
            return [[float(t.lower().count(c)) for c in "wtsn"] for t in texts]

    return Letters()


def same_hits(e, queries):
    """What the kept segments find, which has to be what a search over all symbols finds."""
    key = ["file", "ordinal"]
    kept = {q: [(r.file, r.ordinal, r.score) for r in fts.search_index(*e.postings(), key, q, None).sort(*key).collect()] for q in queries}
    assert kept == {q: [(r.file, r.ordinal, r.score) for r in fts.search(e.read("nodes"), COLUMNS, key, q, None).sort(*key).collect()] for q in queries}
    return kept


def test_segments_hold_what_changed(spark, tmp_path):
    """Builds write the files that changed; searches over segments, merged or not, equal those over a full index."""
    root, home = tmp_path / "proj", tmp_path / "index"
    root.mkdir()
    for i in range(5):
        (root / f"f{i}.go").write_text(f"package p\n\n// word{i} Café shared\nfunc F{i}() {{ Common() }}\n")
    e = Engine(spark, str(root), str(home), buckets=2)
    e.segments.fanout = 3
    for step in range(4):
        if step:
            (root / f"f{step}.go").write_text(f"package p\n\n// changed{step} cafe shared\nfunc F{step}() {{}}\n\nfunc More{step}() {{}}\n")
        if step == 2:
            (root / "f0.go").unlink()
        assert e.reindex() == step + 1
        facts = e._facts(step + 1)
        assert len(facts["segments"]) == [1, 2, 1, 2][step]
        born = {(r.file, r.born) for r in spark.read.parquet(f"{home}/segments/s{step + 1}/postings").collect()}
        assert step == 0 and len(born) == 5 or born == {(f"f{step}.go", step + 1)}
        hits = same_hits(e, ("CAFÉ", "word2", "changed2", "cafe_shared"))
        assert len(hits["cafe_shared"]) == len(hits["CAFÉ"]) == (5 if step < 2 else 4) and bool(hits["word2"]) == (step < 2) and bool(hits["changed2"]) == (step >= 2)
    assert e.search("changed3").first()["name"] == "F3"
    e.purge(1)
    assert {x.name for x in (home / "segments").iterdir()} == {n for n, _ in e._facts(4)["segments"]}
    other = Engine(spark, str(root), str(home))
    assert same_hits(other, ("shared",)) and other.callers("More3").collect() == []


def test_walks_open_only_the_buckets_of_their_frontier(spark, tree, tmp_path):
    e = Engine(spark, str(tree), str(tmp_path / "index"), buckets=16)
    e.reindex()
    node = {(r.receiver, r.name): r.id for r in e.read("nodes").collect()}
    spark.conf.set("spark.sql.sources.bucketing.autoBucketedScan.enabled", "false")  # so that plans say which buckets they open
    for table, key in (("edges", "from_id"), ("edges_by_target", "to_id")):
        for _ in range(2):
            plan = e.read(table).filter(F.col(key).isin([node["", "helper"]]))._jdf.queryExecution().executedPlan().toString()
            assert "SelectedBucketsCount: 1 out of 16" in plan and "Exchange" not in plan, plan
            spark.sql(f"drop table {e._table(1, table)}")  # as a new session finds it
    spark.conf.set("spark.sql.sources.bucketing.autoBucketedScan.enabled", "true")
    plain = e.read("edges").select("*")
    for mode in (traverse.OUT, traverse.IN, traverse.BOTH):
        for name in ("Sum", "helper", "Twice"):
            got = [tuple(r) for r in traverse.discover(e.read("edges"), node["", name], 3, mode, by_target=e.read("edges_by_target")).orderBy("level", "path").collect()]
            assert got == [tuple(r) for r in traverse.discover(plain, node["", name], 3, mode).orderBy("level", "path").collect()]
    rows = sorted((r.role, r.site) for r in e.node("Twice")["edges"].collect())
    assert rows == sorted((r.role, r.site) for r in lookup.edges_of(plain, node["", "Twice"]).collect()) and rows


def test_engine_keeps_vectors_and_locks(spark, tree, tmp_path):
    home = str(tmp_path / "index")
    e = Engine(spark, str(tree), home, letters())
    assert all(e.read(t).count() == 0 for t in TABLES) and e.search("Twice").count() == 0
    assert e.reindex() == 1
    nodes = {r.id: r for r in e.read("nodes").collect()}
    text = lambda r: " ".join(x for x in ((r.receiver + "." if r.receiver else "") + r.name, r.signature, r.doc) if x)
    want = lambda ns: {i: letters().embed([text(r)])[0] for i, r in ns.items()}
    assert {r.id: r.embedding for r in e.read("vectors").collect()} == want(nodes)
    assert e.search("Twice").first()["name"] == "Twice"
    # Symbols that stay keep their vectors, so an embedder that only refuses does no harm where a file goes.
    (tree / "tools/greet.py").unlink()
    assert Engine(spark, str(tree), home, letters(False)).reindex() == 2
    assert {r.id: r.embedding for r in e.read("vectors").collect()} == want({r.id: r for r in e.read("nodes").collect()})
    (tree / "mathx/mathx.go").write_text(MATHX + "\nfunc Thrice(n int) int { return Twice(n) + n }\n")
    with pytest.raises(Exception, match="no model"):
        Engine(spark, str(tree), home, letters(False)).reindex()
    assert e._versions() == [1, 2] and not e._has("LOCK")
    with e._alone(), pytest.raises(BlockingIOError):
        e.reindex()
    assert e.reindex() == 3
    e.purge(1)
    assert e._versions() == [3] and e.search("Thrice").first()["name"] == "Thrice"
    assert same_hits(e, ("sum", "a int", "mathx_mathx go", "int_a", "adds_sum"))["mathx_mathx go"]


def test_vectors_of_empty_and_many_texts(spark):
    rows = [(i, None if i % 7 == 0 else "" if i % 7 == 1 else "w" * (i % 50 + 1)) for i in range(500)]
    got = {r.id: r.embedding for r in semantic.embedded(spark.createDataFrame(rows, "id long, t string"), "id", "t", letters()).collect()}
    assert got == {i: [float(len(t or "")), 0.0, 0.0, 0.0] for i, t in rows}


def test_pooling(spark):
    v = F.array(F.array(F.lit(1.0), F.lit(2.0)), F.array(F.lit(3.0), F.lit(6.0)))
    assert [one(spark, semantic.pooled(v, m)) for m in ("mean", "cls", "last", "unspecified")] == [[2.0, 4.0], [1.0, 2.0], [3.0, 6.0], [2.0, 4.0]]
    none = F.array().cast("array<array<float>>")
    assert one(spark, semantic.pooled(none, "mean")) is None and one(spark, semantic.pooled(none, "last")) is None
    with pytest.raises(ValueError):
        semantic.pooled(v, "max")


def test_variables_and_aliases():
    kinds = lambda text, e: [(n["kind"], n["name"]) for n in symbols.parse_braced(text, e)[0]]
    assert kinds("type Id<T> = string | T;\nexport const f = (x) => g(x);\nlet n = 1;\n", ".ts") == [(3, "Id"), (6, "f"), (6, "n")]
    assert kinds("mod m { static N: i32 = 1; const K: i32 = 2; fn f() { let x = 1; } }\ntype R = i32;\n", ".rs") == [(3, "m"), (6, "N"), (7, "K"), (2, "f"), (3, "R")]
    assert kinds("static const int n = 1;\nunion U { int a; };\n", ".c") == [(5, "U")]


def test_bfs_equals_nested_loops(spark):
    rng = random.Random(4)
    pairs = [(i, *rng.sample(range(12), 2)) for i in range(40)]
    df = spark.createDataFrame([(i, a, b, 1) for i, a, b in pairs], "edge_id long, from_id long, to_id long, kind int")
    for mode in (traverse.OUT, traverse.IN, traverse.BOTH):
        seen, front, want = {0}, [0], []
        for _ in range(3):
            new = []
            for cur in front:
                for i, a, b in pairs:
                    n = b if a == cur and mode != traverse.IN else a if b == cur and mode != traverse.OUT else None
                    if n is not None and n not in seen:
                        seen.add(n)
                        new.append(n)
                        want.append(i)
            front = new
        for listed in (1000, 0):  # frontiers named in a filter, and joined
            traverse.LISTED, before = listed, traverse.LISTED
            try:
                assert [r.edge_id for r in traverse.discover(df, 0, 3, mode).orderBy("level", "path").collect()] == want
            finally:
                traverse.LISTED = before


def test_bm25_equals_fts5(spark):
    rows = [(0, "main.go", "add", "", "(a, b int) int", "adds numbers"), (1, "main.go", "Greet", "Hello", "", "says hello to add"), (2, "util.go", "read_file_range", "", "", "reads a range of a file"), (3, "util.go", "helper", "", "(int int)", "")]
    cols = ["name", "receiver", "signature", "doc", "file"]
    df = spark.createDataFrame([(r[0], r[2], r[3], r[4], r[5], r[1]) for r in rows], "id long, name string, receiver string, signature string, doc string, file string")
    con = sqlite3.connect(":memory:")
    con.execute("create virtual table t using fts5(name, receiver, signature, doc, file)")
    con.executemany("insert into t(rowid, name, receiver, signature, doc, file) values (?, ?, ?, ?, ?, ?)", [(r[0], r[2], r[3], r[4], r[5], r[1]) for r in rows])
    for q in ("add", "int", "int int", "read_file_range", "range file", "go", "nothing"):
        match = " ".join('"' + w.replace("_", " ") + '"' for w in q.split())
        want = [(i, round(-s, 9)) for i, s in con.execute("select rowid, rank from t where t match ? order by rank, rowid", (match,))]
        got = [(r.id, r.score) for r in fts.search(df, cols, "id", q, 10).collect()]
        assert [g[0] for g in got] == [w[0] for w in want] and [g[1] for g in got] == pytest.approx([w[1] for w in want], abs=1e-8), q
    assert fts.search(df, cols, "id", "，", 10).count() == 0


def test_folding_equals_fts5(spark):
    """Marks go from Latin letters as they do in FTS5, in texts and queries, composed or not, and in phrases."""
    con = sqlite3.connect(":memory:")
    con.execute("create virtual table t using fts5(a)")
    texts = ["café crème", "CAFE creme", "cafe\u0301 creme", "naïve Über-Straße", "uber strasse", "smörgåsbord øl łódź", "aa aa aa", "aa-aá", *("x" + c + "y" for c in fts.FOLDS)]
    con.executemany("insert into t(rowid, a) values (?, ?)", enumerate(texts))
    df = spark.createDataFrame(list(enumerate(texts)), "id long, a string").cache()
    queries = ["café", "Cafe\u0301 creme", "straße", "øl lodz", "aa_aa", "cafe_creme"]
    postings, dl = fts.build_index(df, ["a"], "id")
    postings = postings.cache()
    for q in queries:
        want = [(i, round(-s, 9)) for i, s in con.execute("select rowid, rank from t where t match ? order by rank, rowid", (" ".join('"' + w.replace("_", " ") + '"' for w in q.split()),))]
        for got in (fts.search(df, ["a"], "id", q, 500), fts.search_index(postings, dl, "id", q, 500)):
            rows = [(r.id, r.score) for r in got.collect()]
            assert [r[0] for r in rows] == [w[0] for w in want] and [r[1] for r in rows] == pytest.approx([w[1] for w in want], abs=1e-8), q
    # Each folded letter is found by its base and finds texts with it, as there.
    for c, base in list(fts.FOLDS.items())[::150]:
        hits = {i for (i,) in con.execute("select rowid from t where t match ?", (f'"x{base}y"',))}
        assert {r.id for r in fts.search(df, ["a"], "id", f"x{base}y", None).collect()} == hits == {r.id for r in fts.search(df, ["a"], "id", f"x{c}y", None).collect()}


def one(spark, column):
    return spark.range(1).select(column).first()[0]


def test_text_functions(spark):
    for text, want in {"()": (0, 0), "() string": (0, 1), "(a, b int) int": (2, 1), "(a int) (int, error)": (1, 2), "(s string, args ...any)": (2, 0), "() (n int)": (0, 1), "(f func(a, b int) int, m map[string]int) error": (2, 1)}.items():
        assert tuple(one(spark, signature_arity(F.lit(text)))) == want, text
    for path, want in {"m/internal/llm": "internal/llm", "m": ".", "m/zz": "zz", "fmt": None, "github.com/x/y": None}.items():
        assert one(spark, import_directory(F.lit(path), F.lit("m"))) == want
    assert one(spark, cut_bytes(F.lit("ab求和"), 5)) == "ab求…" and one(spark, cut_bytes(F.lit("ab"), 2)) == "ab"
    assert one(spark, approximate_tokens(F.lit("abcdefgh求和求"))) == 3
    assert one(spark, is_sensitive(F.lit("MY_API-KEY"))) and not one(spark, is_sensitive(F.lit("MONKEY")))
    assert one(spark, is_dangerous(F.lit("sudo rm -rf /"))) and not one(spark, is_dangerous(F.lit("ls -l")))
    assert one(spark, is_blocked_path(F.lit("/etc/passwd"))) and not one(spark, is_blocked_path(F.lit("/home/me/proj/bin")))


def test_timestamps(spark):
    at = lambda s: F.lit(s).cast("timestamp")
    for s, want in {"2024-01-01 00:00:10": "2024-01-01T00:00:10Z", "2024-01-01 00:00:10.5": "2024-01-01T00:00:10.5Z", "2024-12-31 23:59:00.000001": "2024-12-31T23:59:00.000001Z"}.items():
        assert one(spark, timestamp_text(at(s))) == want and one(spark, timestamp_of(F.lit(want)) == at(s))
    assert one(spark, timestamp_of(F.lit("2024-01-01T02:00:00.123456789+02:00")) == at("2024-01-01 00:00:00.123456"))
    assert one(spark, timestamp_of(F.lit("yesterday"))) is None and one(spark, timestamp_of(F.lit("2024-13-01T00:00:00Z"))) is None


def test_message_tokens(spark):
    calls = "array<struct<function:struct<name:string,arguments:string>>>"
    rows = [("a" * 8, "b" * 9, [(("c" * 4, "d" * 8),), (("e" * 4, None),)]), (None, None, None), ("求和求", "", [])]
    got = [r[0] for r in spark.createDataFrame(rows, f"content string, reasoning_content string, tool_calls {calls}").select(chat.message_tokens()).collect()]
    assert got == [2 + 2 + 1 + 2 + 1, 0, 1]


def test_lines(spark):
    names = spark.createDataFrame([("src/a.go",), ("build/a.go",), ("x/bin/y/a.go",), ("bin",), ("src/a.goo",)], "p string")
    assert [r.p for r in lines.find_names(names, "p", "\\.go$|^bin$").collect()] == ["src/a.go", "bin"]
    assert one(spark, lines.edited(F.lit("a b a"), "a", "c")) == "c b c"
    with pytest.raises(Exception, match="nothing to replace"):
        one(spark, lines.edited(F.col("id").cast("string"), "z", "c"))
    with pytest.raises(ValueError):
        lines.edited(F.lit("a"), "", "c")
    df = spark.createDataFrame([("f", "line1\nfoo 2\nline3\nfoo 4")], "path string, text string")
    got = lambda x: [(r.num, r.line) for r in x.orderBy("num").collect()]
    assert got(lines.line_range(df, "path", 1, 2)) == [(1, "line1"), (2, "foo 2")] and got(lines.line_range(df, "path", -9, 0))[0] == (1, "line1")
    assert got(lines.line_range(df, "path", -1, 0)) == [(4, "foo 4")] and got(lines.grep(df, "path", "foo")) == [(2, "foo 2"), (4, "foo 4")]
    with pytest.raises(ValueError):
        lines.line_range(df, "path", 3, 2)
    assert clamped(None, (1, 3)) == 1 and clamped(9, (1, 3)) == 3 and clamped(2, (1, 3)) == 2


def test_sessions_and_skills(spark, tmp_path):
    (tmp_path / "s").mkdir()
    (tmp_path / "s/a.json").write_text(json.dumps({"working_dir": "/w", "messages": [{"role": "user", "content": "hi"}]}))
    (tmp_path / "s/b.json").write_text(json.dumps([{"role": "assistant", "content": "yo", "reasoning_content": "r", "tool_calls": [{"id": "1", "function": {"name": "f", "arguments": "{}"}}]}, {"role": "assistant", "content": "z", "reasoning_content": "r"}]))
    rows = catalog.sessions(spark, str(tmp_path / "s")).collect()
    assert [(r.name, r.working_dir, len(r.messages)) for r in rows] == [("b", None, 2), ("a", "/w", 1)]
    messages = catalog.sessions(spark, str(tmp_path / "s")).select(F.explode("messages").alias("m")).select("m.*")
    assert sorted(r.reasoning_content or "" for r in chat.strip_reasoning(messages).filter("role = 'assistant'").collect()) == ["", "r"]
    for i, text in enumerate(["---\nname: pdf\ndescription: \"reads\"\n---\nbody", "---\nname: own\ncategory: code\n---\n", "no front", "---\nname: pdf\n---\nsecond"]):
        (tmp_path / f"s/{i}.md").write_text(text)
    got = {r.name: r for r in catalog.skills(spark, str(tmp_path / "s")).collect()}
    assert set(got) == {"pdf", "own"} and got["pdf"].category == "document" and got["pdf"].description == "reads" and got["pdf"].body == "body" and got["own"].category == "code"
    assert [r.name for r in catalog.matching(catalog.skills(spark, str(tmp_path / "s")), "DOC").collect()] == ["pdf"]


def test_sinks_and_repair(spark, tmp_path):
    from symlattice.functions.text import repaired
    from symlattice.sources import sinks

    assert sinks.free_name({"proj", "proj-2"}, "/w/proj/", "x") == "proj-3" and sinks.free_name(set(), "", "x") == "x"
    m = spark.createDataFrame([(2, "assistant", "b"), (1, "user", "a")], "seq int, role string, content string")
    sinks.save_session(m, str(tmp_path), "one", "/w")
    sinks.save_session(m, str(tmp_path), "one", "/w2")
    at = tmp_path / "new" / "er" / "a.txt"
    for append, text, want in ((False, "one\n", "one\n"), (True, "zwei ü", "one\nzwei ü"), (False, "three", "three")):
        sinks.write_file(spark, str(at), text, append)
        assert at.read_text() == want and [x.name for x in at.parent.iterdir() if not x.name.endswith(".crc")] == ["a.txt"]
    row = catalog.sessions(spark, str(tmp_path)).first()
    assert (row.name, row.working_dir, [x.content for x in row.messages]) == ("one", "/w2", ["a", "b"])
    assert one(spark, repaired(F.lit("Ã©tÃ©"))) == "été" and one(spark, repaired(F.lit("été"))) == "été"
    for text in ("，天", "été…", "“q”", "plain"):
        assert one(spark, repaired(F.lit(text.encode().decode("latin-1")))) == text
    assert one(spark, repaired(F.lit("ï¼Œ"))) == "，" and one(spark, repaired(F.lit("“q” é"))) == "“q” é"
    raw = spark.createDataFrame([(bytearray("中文", "gbk"),), (bytearray("中文", "utf-8"),), (None,)], "b binary")
    assert [r[0] for r in raw.select(decoded_line(F.col("b"))).collect()] == ["中文", "中文", None]


def test_skill_text(spark, tmp_path):
    for name in ("pdf", "other"):
        (tmp_path / name).mkdir()
        (tmp_path / name / "SKILL.md").write_text(f"of {name}")
    assert catalog.skill_text(spark, str(tmp_path), " pdf ") == "of pdf"
    for bad in ("", ".", "..", "../pdf", "a/b", "a\\b"):
        with pytest.raises(ValueError):
            catalog.skill_text(spark, str(tmp_path), bad)
    with pytest.raises(LookupError):
        catalog.skill_text(spark, str(tmp_path), "none")
