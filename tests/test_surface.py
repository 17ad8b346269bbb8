"""Table functions in SQL, and the registry of questions."""

import pytest

from symlattice.plans import surface
from symlattice.plans.engine import Engine
from symlattice.sources import project, symbols

GO = "package p\n\nfunc A() { B() }\n\nfunc B() {}\n"


def test_sql_and_engine_give_the_same_symbols(spark, tmp_path):
    root = tmp_path / "proj"
    root.mkdir()
    for name, text in {"a.go": GO, "b.py": "class K:\n    def m(self): return f(1)\n", "c.py": "def broken(:\n"}.items():
        (root / name).write_text(text)
    surface.register(spark)
    project.scan(spark, str(root)).createOrReplaceTempView("source_files")
    sql = spark.sql("select path, s.* from source_files, lateral extract_symbols(path, content) s").collect()
    graphs = {r.path: r for r in symbols.file_graphs(spark.table("source_files")).collect()}
    want = sorted((p, i, n.name, n.receiver, n.kind, n.line) for p, g in graphs.items() for i, n in enumerate(g.nodes))
    assert sorted((r.path, r.ordinal, r.name, r.receiver, r.kind, r.line) for r in sql) == want and len(want) == 4
    refs = spark.sql("select path, r.* from source_files, lateral extract_references(path, content) r where kind = 1").collect()
    assert sorted((r.path, r.name, r.owner) for r in refs) == [("a.go", "B", 0), ("b.py", "f", 1)]
    assert spark.sql("select * from extract_symbols(null, null)").collect() == []


def test_registry(spark, tmp_path):
    root = tmp_path / "proj"
    root.mkdir()
    (root / "a.go").write_text(GO)
    e = Engine(spark, str(root), str(tmp_path / "index"), buckets=2)
    e.reindex()
    t = surface.tools(e)
    assert t.names() == sorted(f"symbol_{x}" for x in ("search", "node", "callers", "callees", "trace", "impact"))
    assert [r.to_label.split(" ")[0] for r in t.call("symbol_callees", symbol="A").collect()] == ["B"]
    assert t.call("symbol_search", query="A", max_results=1).first()["name"] == "A" and set(t.call("symbol_node", symbol="A")) == {"node", "edges", "source", "blast"}
    for name, given, error in (("symbol_callers", {}, TypeError), ("symbol_callers", {"symbol": 3}, TypeError), ("symbol_callers", {"symbol": "A", "depth": True}, TypeError), ("symbol_callers", {"symbol": "A", "x": 1}, TypeError), ("nothing", {}, LookupError)):
        with pytest.raises(error):
            t.call(name, **given)
    with pytest.raises(ValueError):
        t.add(surface.Tool("symbol_node", "", {}, lambda: None))
    assert {(r.name, r.argument, r.type, r.required) for r in t.describe(spark).collect()} >= {("symbol_callers", "symbol", "str", True), ("symbol_trace", "depth", "int", False)}
