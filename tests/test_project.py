"""Ignore rules as rows and in walks, against a plain reading of all rules for all paths; listings that are pruned."""

import os
import random
import re

import pytest

from symlattice.sources import project
from symlattice.sources.ignore import Matcher, rule_of, rule_rows, unignored
from symlattice.sources.tree import TreeReader, register


def plain_match(line, path):
    """(whether a line matches a path or a directory above it, whether it re-includes); directories end with a slash."""
    line = line.rstrip("\r\n").strip()
    if not line or line.startswith("#"):
        return False, False
    again, line = line.startswith("!"), line.removeprefix("!")
    line = line.removeprefix("\\") if line[:2] in ("\\#", "\\!") else line
    folder, line = line.endswith("/"), line.rstrip("/")
    anchored, line = "/" in line, line.removeprefix("/")
    out = re.escape(line).replace(r"\*\*/", "(?:.*/)?")
    out = (out[: -len(r"/\*\*")] + "/.*" if out.endswith(r"/\*\*") else out).replace(r"\*", "[^/]*")
    return bool(line and re.match(f"^{'' if anchored else '(?:.*/)?'}{out}{'/.*' if folder else '(?:/.*)?'}$", path)), again


def plain_ignored(path, scopes):
    parts = path.rstrip("/").split("/")
    for k in range(1, len(parts) + 1):
        step = "/".join(parts[:k]) + ("/" if k < len(parts) or path.endswith("/") else "")
        for scope, lines in scopes.items():
            if scope and not (step.startswith(scope + "/") and len(step) > len(scope) + 1):
                continue
            said = [again for line in lines for hit, again in [plain_match(line, step[len(scope) + 1 :] if scope else step)] if hit]
            if said and not said[-1]:
                return True
    return False


def left(spark, paths, scopes):
    lines = [(s, i, x) for s, ls in scopes.items() for i, x in enumerate(ls)]
    rules = rule_rows(spark.createDataFrame(lines, "scope string, at int, line string"))
    return sorted(r.path for r in unignored(spark.createDataFrame([(p, 1) for p in paths], "path string, depth int"), rules).collect())


CASES = [
    ("build/", "build/", True), ("build/", "build", False), ("build/", "build/x.go", True), ("/foo.log", "foo.log", True), ("/foo.log", "a/foo.log", False), ("foo.log", "a/b/foo.log", True), ("?.log", "a.log", False),
    ("*.min.js", "bundle.min.js", True), ("*.log\n!keep.log", "keep.log", False), ("*.log\n!keep.log", "drop.log", True), ("a/**/z.go", "a/b/c/z.go", True), ("# c\n\n*.log\r", "x.log", True), ("\\#foo.go", "#foo.go", True),
    ("dir/\n!dir/keep.go", "dir/keep.go", True), ("**/res/values*/", "app/res/values-es/x.xml", True), ("dist/\n!dist/", "dist/keep.go", False), ("a/**", "a/b", True), ("a/**", "a", False), ("**/x", "p/q/x/y", True), ("/", "a", False),
]


def test_ignore_lines(spark):
    for lines, path, want in CASES:
        assert plain_ignored(path, {"": lines.split("\n")}) == want, (lines, path)
    # Each case in a scope of its own, all at once.
    scopes = {f"s{i}": c[0].split("\n") for i, c in enumerate(CASES)}
    paths = [f"s{i}/{c[1]}" for i, c in enumerate(CASES)]
    assert left(spark, paths, scopes) == sorted(p for p, c in zip(paths, CASES) if not c[2])


def drawn(r):
    names = ["a", "b", "ab", "a.log", "b.min.js", "x.go", "build", "res", "values-es"]
    path = lambda: "/".join(r.choice(names) for _ in range(r.randrange(1, 5))) + r.choice(["", "", "/"])
    line = lambda: r.choice(["", "!"]) + r.choice(["", "", "/", "**/"]) + r.choice([*names, "*", "a*", "*.log", "*.min.js", "a/b", "a/*/x.go", "a/**/x.go", "b/**", "*b", "res/values*"]) + r.choice(["", "", "/"])
    folders = {""} | {path().strip("/") for _ in range(3)}
    return sorted({path() for _ in range(60)}), {s: [line() for _ in range(r.randrange(1, 7))] for s in folders}


def test_rules_as_rows_equal_a_plain_reading(spark):
    for seed in range(6):
        paths, scopes = drawn(random.Random(seed))
        assert left(spark, paths, scopes) == [p for p in paths if not plain_ignored(p, scopes)], seed


def walked(path, scopes):
    """What a walk says that asks each scope's matcher about each step and keeps the last line that matched."""
    matchers, held = {s: Matcher(ls) for s, ls in scopes.items()}, {}
    parts = path.rstrip("/").split("/")
    for k in range(1, len(parts) + 1):
        step = "/".join(parts[:k])
        for scope, m in matchers.items():
            if scope and not step.startswith(scope + "/"):
                continue
            said = m.last(step[len(scope) + 1 :] if scope else step, k < len(parts) or path.endswith("/"))
            held[scope] = max((x for x in (held.get(scope), said) if x), default=None)
            if held[scope] and not held[scope][1]:
                return True
    return False


def test_matchers_equal_a_plain_reading():
    r = random.Random(9)
    for _ in range(400):
        paths, scopes = drawn(r)
        for p in paths:
            assert walked(p, scopes) == plain_ignored(p, scopes), (p, scopes)


def test_ten_thousand_scopes(spark):
    """A plan's size doesn't depend on the number of rules files."""
    lines = spark.range(10_000).selectExpr("concat('p', id % 100, '/d', id) as scope", "0 as at", "concat('skip', id % 7, if(id % 2 = 0, '/', '*')) as line")
    paths = spark.range(10_000).selectExpr("concat('p', id % 100, '/d', id, '/skip', id % 5, '/x.go') as path")
    rules = rule_rows(lines)
    kept = unignored(paths, rules)
    assert len(kept._jdf.queryExecution().optimizedPlan().toString()) < 20_000
    assert kept.count() == sum(1 for i in range(10_000) if i % 7 != i % 5)


@pytest.fixture()
def tree(tmp_path):
    root = tmp_path / "proj"
    files = {
        "main.go": "package main", "go.mod": "module m", "a/one.go": "x", "a/skip/two.go": "x", "a/.gitignore": "skip/\n", "b/skip/three.go": "x", "dist/keep.go": "x", "vendor/keep.go": "x", ".gitignore": "!vendor/\r\ntmp/\r\nsrc/secret/\n!src/secret/real.go\n",
        "tmp/one.go": "x", "src/secret/real.go": "x", ".git/hook.py": "x", ".symlattice-old/y.go": "x", "node_modules/deep/er/x.js": "x", ".hidden/_private.ts": "x", "big/at.go": "y" * project.LARGEST, "big/over.go": "y" * (project.LARGEST + 1), "bad/.gitignore": None, "bad/z.go": "x", "UP.GO": "x",
    }
    for path, text in files.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_bytes(b"\xff\xfe\x00z.go" if text is None else text.encode())
    os.symlink(root / "a", root / "linked")
    os.symlink(root / "main.go", root / "linked.go")
    return root


WANT = [".hidden/_private.ts", "UP.GO", "a/one.go", "b/skip/three.go", "bad/z.go", "big/at.go", "main.go", "vendor/keep.go"]


def test_scan_is_pruned(spark, tree):
    rows = {r.path: r for r in project.scan(spark, str(tree)).collect()}
    assert sorted(rows) == WANT
    stat = os.stat(tree / "main.go")
    assert rows["main.go"].fingerprint.split(":")[1:] == [str(stat.st_mtime_ns), "12"] and bytes(rows["main.go"].content) == b"package main"
    assert sorted(r.path for r in project.scan(spark, f"file://{tree}").collect()) == WANT


def test_what_is_ignored_is_never_entered(tree):
    """However a walk is shared out, it opens no directory that rules ignore and no file that filters leave out."""
    from pyspark.sql.datasource import In, LessThanOrEqual

    for parts in (1, 2, 5, 1000):
        reader = TreeReader({"path": str(tree), "rules": "\n".join(project.DEFAULT_IGNORES), "skip": project.SKIPPED_DIRECTORIES, "content": "true", "partitions": str(parts)})
        assert list(reader.pushFilters([In(("extension",), project.SOURCE_EXTENSIONS), LessThanOrEqual(("length",), project.LARGEST)])) == []
        entered, opened = [], []
        entries, content = reader.files.entries, reader.files.content
        reader.files.entries = lambda p: entered.append(p) or entries(p)
        reader.files.content = lambda p: opened.append(p) or content(p)
        got = sorted(row[0] for p in reader.partitions() for row in reader.read(p))
        assert got == WANT
        assert not {p.split("/")[0] for p in entered} & {"node_modules", "dist", "tmp", ".git", ".symlattice-old", "linked"} and "a/skip" not in entered and "src/secret" not in entered
        assert {p for p in opened if not p.endswith(".gitignore")} == set(WANT)


def test_filters_reach_the_source(spark, tree):
    register(spark)
    df = spark.read.format("pruned_tree").load(str(tree)).filter("extension = '.go' and length <= 1").filter("path like 'a%'")
    assert [(r.path, r.content) for r in df.collect()] == [("a/one.go", None)]


def test_list_directory(spark, tree):
    rows = [(r.name, r.is_dir, r["size"]) for r in project.list_directory(spark, str(tree)).collect()]
    names = sorted(os.listdir(tree), key=lambda n: (not (tree / n).is_dir(), n))
    assert [r[0] for r in rows] == [n for n in names if not n.startswith("linked")] and ("main.go", False, 12) in rows and ("a", True, 0) in rows
    assert [r.name for r in project.list_directory(spark, str(tree), "GO").collect()] == ["UP.GO", "go.mod", "main.go"]
    assert project.list_directory(spark, str(tree / "none")).count() == 0


def test_rules_of_lines():
    assert rule_of("*.a*") == (False, False, "regex", r"^(?:.*/)?[^/]*\.a[^/]*/?$") and rule_of("!/a/b/") == (True, True, "path", "a/b") and rule_of("**/x") == (False, False, "name", "x") and rule_of(" # ") is None
