"""Extraction: what each language declares and calls, identifiers, and sources that mislead a scan."""

import random

import pyarrow as pa
import pytest

from symlattice.plans.source_queries import QUERIES
from symlattice.sources import symbols
from symlattice.sources.lexing import LEXICONS, mates, tokens


def parsed(extension, source):
    nodes, refs, imports = symbols.parse(f"x.{extension}", source.encode())
    calls = [(r["name"], nodes[r["owner"]]["name"] if r["owner"] >= 0 else "") for r in refs if r["kind"] == symbols.CALL]
    return {"nodes": [(n["kind"], n["receiver"], n["name"]) for n in nodes], "calls": calls, "raw": nodes, "refs": refs, "imports": imports}


F, M, T, I, S, V, C = 1, 2, 3, 4, 5, 6, 7
GOLDEN = {
    "go": (
        "package p\n\nimport (\n\t\"fmt\"\n\tx \"a/strs\"\n)\n\ntype W interface { A(); B(n int) error }\n\ntype S struct {\n\tBase\n\t*x.Far\n\tf, g func(int) W\n}\n\nfunc (s *S) A() { fmt.Println(x.Up(`raw ( {`), \"}\") }\n\nvar table = map[string]func(){\n\t\"a\": func() { run() },\n}\n\nconst r = '}'\n",
        [(I, "", "W"), (M, "W", "A"), (M, "W", "B"), (S, "", "S"), (M, "S", "A"), (V, "", "table"), (C, "", "r")],
        [("Println", "A"), ("Up", "A"), ("run", "table")],
    ),
    "ts": (
        "export class G extends mix(B) {\n  f = (x: number) => { inner(x) }\n  @dec() async m<T>(w: string): Promise<T> { return helper<T>(`a ${call(`b ${deep()}`)} }`) }\n}\nconst add = (a) => { return plus(a) }, u = 'it\\'s ('\nconst h = async function named(x) { await last(x) }\ninterface I { q(x: number): void }\ntype A = { b: string }\nfunction main(): { a: string } {\n  for (const z of list()) z.use().then(y => new Gone(y))\n}\n",
        [(S, "", "G"), (M, "G", "m"), (V, "", "add"), (V, "", "u"), (V, "", "h"), (I, "", "I"), (M, "I", "q"), (T, "", "A"), (F, "", "main")],
        [("mix", "G"), ("inner", "G"), ("dec", "G"), ("helper", "m"), ("call", "m"), ("deep", "m"), ("plus", "add"), ("last", "h"), ("list", "main"), ("then", "main"), ("use", "main")],
    ),
    "jsx": ("const V = (p) => <div title=\"{\">{show(p)} don't</div>\nfunction next() { return /[/(]{2}/.test(q()) }\n", [(V, "", "V"), (F, "", "next")], [("show", "V"), ("test", "next"), ("q", "next")]),
    "py": ("# one\ndef f(a):\n    x = g(a)\n    return h(a)\n\nclass K:\n    def m(self): return 1\n", [(F, "", "f"), (V, "", "x"), (S, "", "K"), (M, "K", "m")], [("g", "x"), ("h", "f")]),
    "java": (
        "class A extends B {\n  private int x = f(), y;\n  @Override @Ann(\"(\")\n  public <T> List<T> greet(String who) throws E {\n    Runnable r = new Runnable() { public void run() { go(); } };\n    return this.<T>h(\"\"\"\n } \"q\" \"\"\");\n  }\n  A() { init(); }\n}\nenum N { P(1), Q; }\nrecord R(int a) { int s() { return t(); } }\n",
        [(S, "", "A"), (V, "", "x"), (V, "", "y"), (M, "A", "greet"), (V, "", "r"), (M, "A", "run"), (T, "", "N"), (S, "", "R"), (M, "R", "s")],
        [("f", "x"), ("go", "run"), ("h", "greet"), ("init", "A"), ("t", "s")],
    ),
    "c": ("#define M(x) { \\\n  f(x)\nstatic int *add(int a) { return g(a) + '}' + h->k(\"{\"); }\nstruct P { int x; };\nstruct P *make(void) { return add(1); }\n", [(F, "", "add"), (S, "", "P"), (S, "", "P"), (F, "", "make")], [("g", "add"), ("k", "add"), ("add", "make")]),
    "cpp": ("namespace n {\ntemplate <class T> class V : public B<T> {\n public:\n  explicit V(int a) : b(a) { i(); }\n  int get() const override { return h<int>(R\"x(})\" )x\"); }\n};\nvoid V::out(int a) { std::move(a); }\n}\n", [(S, "", "V"), (M, "V", "V"), (M, "V", "get"), (F, "", "out")], [("i", "V"), ("h", "get"), ("move", "out")]),
    "cs": ("namespace N { class A : B { public int X { get; set; } = f(); string G(string w) => H(this.n, @\"c:\\\"); void M<T>(T a) where T : class { var q = $\"{call(1)} {{no(}}\"; g?.K(2); } } }\n", [(S, "", "A"), (V, "", "X"), (M, "A", "G"), (M, "A", "M"), (V, "", "q")], [("f", "X"), ("H", "G"), ("call", "q"), ("K", "M")]),
    "php": ("it's (html)\n<?php class G { public $x = 1; private static ?int $y; function greet($w) { return helper($this->n, <<<EOT\n don't { call(\nEOT); } static function st() { self::a(); $b->c(); new D(); } }\nfunction helper($n) { return strlen(\"{$n->k()}\"); } ?> isn't ( <?php last();", [(S, "", "G"), (V, "", "x"), (V, "", "y"), (M, "G", "greet"), (M, "G", "st"), (F, "", "helper")], [("helper", "greet"), ("a", "st"), ("c", "st"), ("strlen", "helper"), ("k", "helper"), ("last", "")]),
    "rb": ("module Z\n  class G < B\n    # says\n    def greet(who)\n      helper who, <<~S\n        end def (\n      S\n      return if done?(who)\n      x = if a then b(1) else 2 end\n      who.up.strip\n    end\n    def self.build(a) = make(a)\n    def last\n      while ready do tick 1 end\n      finish \"#{deep(1)} end\"\n    end\n  end\nend\n", [(T, "", "Z"), (S, "", "G"), (M, "G", "greet"), (V, "", "x"), (M, "G", "build"), (M, "G", "last")], [("helper", "greet"), ("done?", "greet"), ("b", "greet"), ("strip", "greet"), ("up", "greet"), ("make", "build"), ("tick", "last"), ("finish", "last"), ("deep", "last")]),
    "rs": ("pub struct G;\nimpl<T> Tr for G<T> {\n  pub fn greet<'a>(&'a self, w: &'a str) -> String { helper('}', r#\"\"{\"#).trim() }\n}\nfn life<'a>(x: &'a str, y: &'a str) -> char { f(x) }\n/* a /* b { */ c */\nfn after() -> Vec<Box<dyn Fn(i32)>> { g::h::<i32>(1) }\ntrait Q { fn d(&self) { z() } }\nconst N: usize = calc();\nmod m { fn inner() {} }\n", [(S, "", "G"), (M, "G", "greet"), (F, "", "life"), (F, "", "after"), (I, "", "Q"), (M, "Q", "d"), (C, "", "N"), (T, "", "m"), (M, "m", "inner")], [("trim", "greet"), ("helper", "greet"), ("f", "life"), ("h", "after"), ("z", "d"), ("calc", "N")]),
    "kt": ("class G(val n: String = d()) {\n    fun greet(w: String): String = helper(n, \"${w.up()} }\")\n    val x = y()\n    companion object { fun c() { list.each { e(it) } } }\n}\nfun String.ext(): Int { return g() }\nfun one() =\n    two()\nenum class E { A(1) }\n", [(S, "", "G"), (M, "G", "greet"), (V, "", "x"), (M, "G", "c"), (F, "", "ext"), (F, "", "one"), (T, "", "E")], [("d", "G"), ("helper", "greet"), ("up", "greet"), ("y", "x"), ("each", "c"), ("e", "c"), ("g", "ext"), ("two", "one")]),
    "scala": ("class G {\n  def greet(w: String): String =\n    helper(n, s\"${up(w)} }\")\n  val v = k(1)\n}\nobject M { def helper(n: Int): Int = { z(n) } }\ntrait Q { def a(x: Int): Int }\n", [(S, "", "G"), (M, "G", "greet"), (V, "", "v"), (T, "", "M"), (M, "M", "helper"), (I, "", "Q"), (M, "Q", "a")], [("helper", "greet"), ("up", "greet"), ("k", "v"), ("z", "helper")]),
    "dart": ("class G {\n  String greet(String w) => helper(this.n, '${up(w)} }');\n  void m() async { await f(r'\\'); }\n}\nint top(int n) { return g(n); }\nmixin X { }\n", [(S, "", "G"), (M, "G", "greet"), (M, "G", "m"), (F, "", "top"), (T, "", "X")], [("helper", "greet"), ("up", "greet"), ("f", "m"), ("g", "top")]),
}


@pytest.mark.parametrize("extension", sorted(GOLDEN))
def test_declared_and_called(extension):
    source, nodes, calls = GOLDEN[extension]
    got = parsed(extension, source)
    assert got["nodes"] == nodes and got["calls"] == calls


def test_every_language_has_an_extension():
    assert {x for x in symbols._LANGUAGE.values()} == set(symbols.LANGUAGES) and len(symbols._LANGUAGE) == 32


def test_go_signatures_and_places():
    got = parsed("go", "package p\n\n// Multi adds,\n// and more.\nfunc Multi(\n\ta int,\n\tb string,\n) (int, error) {\n\treturn f(a), nil\n}\nfunc face(v interface{}) struct{ x int } { return g(v) }\nvar x, y = 1, h()\nfunc gen[T any](x T) (T, error) { return k[T](x), nil }\n")
    sign = {n["name"]: n["signature"] for n in got["raw"]}
    assert sign["Multi"] == "( a int, b string, ) (int, error)" and sign["face"] == "(v interface{}) struct{ x int }" and sign["gen"] == "[T any](x T) (T, error)"
    assert [n["line"] for n in got["raw"]] == [5, 11, 12, 12, 13] and got["raw"][0]["doc"] == "// and more."
    assert got["calls"] == [("f", "Multi"), ("g", "face"), ("h", "x"), ("k", "gen")]


def test_go_identifiers():
    """Types of fields and signatures count, names of declarations, callees and members don't."""
    got = parsed("go", "package p\n\nimport \"q\"\n\ntype A struct {\n\tb B\n\tC\n\tm map[K]q.Out\n}\n\nfunc f(x B) B {\n\tdefer func() { hidden(e) }()\n\tx.field.go1(limit)\n\treturn A{key: total, C: C{}}.with(q.Up(n))\n}\n")
    mine = lambda o: [r["name"] for r in got["refs"] if r["kind"] == symbols.REF and r["owner"] == o]
    assert mine(0) == ["B", "C", "C", "K", "Out"]
    assert mine(1) == ["x", "B", "B", "limit", "n"]
    assert got["raw"][0]["embeds"] == ["C"] and got["imports"] == {"q": "q"}
    assert [(r["name"], r["pkg"]) for r in got["refs"] if r["kind"] == symbols.CALL] == [("e", ""), ("hidden", ""), ("go1", ""), ("with", ""), ("Up", "q")]


def test_calls_by_language():
    """What is a word of one language is a name in another."""
    assert parsed("ts", "function f() { append(select(match(len(range(lock(end()))))) ) }")["calls"] == [(n, "f") for n in ("append", "select", "match", "len", "range", "lock", "end")]
    assert parsed("go", "package p\nfunc f() { x := append(make(T), len(y)); select {} ; switch (x) {} }")["calls"] == [("append", "f"), ("make", "f"), ("len", "f")]


def test_places_in_ranges():
    r = random.Random(2)
    for _ in range(200):
        ranges = [(a, a + r.randrange(0, 9)) for a in (r.randrange(60) for _ in range(r.randrange(0, 12)))]
        places = [r.randrange(70) for _ in range(30)]
        assert symbols.in_none_of(places, ranges) == [not any(a <= p < b for a, b in ranges) for p in places]


@pytest.mark.parametrize("language", sorted(LEXICONS))
def test_any_text_ends(language):
    """Whatever stands in a file, tokens don't overlap, brackets pair up, and a walk ends."""
    r = random.Random(language)
    bits = ["'", '"', "`", "${", "#{", "{", "}", "(", ")", "[", "]", "<", ">", "//", "/*", "*/", "\n", " ", "fn", "def", "class", "A", "b", "=", "=>", ",", ";", ".", "end", "do", "if", "const", "<<~X", "<?php", "@", "$x", '"""', "r#\"", "func", "type", "interface", "impl", "for", "->", "::", "é", "\\", "1"]
    extension = {x: es.split()[0] for x, es in symbols.LANGUAGES.items()} | {"script": ".ts"}
    for _ in range(150):
        source = " ".join(r.choice(bits) for _ in range(r.randrange(60))) if r.random() < 0.5 else "".join(r.choice(bits) for _ in range(r.randrange(60)))
        ts = tokens(source, language)
        assert all(a.end <= b.start or b.text == "(" for a, b in zip(ts, ts[1:])) and len(mates(ts)) == len(ts)
        symbols.parse(f"x{extension[language]}", source.encode())


def test_file_graphs_keeps_what_parses(spark):
    files = [("a.go", b"package p\nfunc f() {}\n"), ("b.py", b"def broken(:\n"), ("c.txt", b"no code"), ("d.ts", b"\xff\xfe function g() {}"), ("e.rb", b"")]
    got = {r.path: [n.name for n in r.nodes] for r in symbols.file_graphs(spark.createDataFrame([(p, bytearray(c)) for p, c in files], "path string, content binary")).collect()}
    assert got == {"a.go": ["f"], "d.ts": ["g"], "e.rb": []}


@pytest.mark.parametrize("query", ["extracted_symbols", "extracted_calls"])
def test_files_of_parts_are_parsed_by_many_tasks(spark, query):
    """One small file of parts doesn't make one task parse all their sources."""
    rows = [n for n in QUERIES[query](spark, "/root/testdata/sf0.001").rdd.mapPartitions(lambda p: [sum(1 for _ in p)]).collect() if n]
    assert len(rows) > 1 and max(rows) < 0.6 * sum(rows)


def test_files_leave_in_slices():
    """A task holds the symbols of a slice of its files, however many files a batch has."""
    files = [{"path": f"{i}.go" if i % 2 else f"{i}.txt", "content": b"package p\nfunc f() {}\n"} for i in range(2 * symbols.SLICE + 10)]
    got = list(symbols._parse(iter([pa.RecordBatch.from_pylist(files)])))
    assert [b.num_rows for b in got] == [symbols.SLICE // 2, symbols.SLICE // 2, 5]
    assert [p for b in got for p in b["path"].to_pylist()] == [f["path"] for f in files if f["path"].endswith(".go")]
