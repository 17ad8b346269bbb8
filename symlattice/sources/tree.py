"""A data source over directory trees that never enters what rules ignore.

``spark.read.format("pruned_tree").load(root)`` gives (path, is_dir, length, modified, content) of the files below a root.
Partitions are directories; each is walked where it is read, with the rules that hold there. Filters on ``extension``,
``name`` and ``length`` reach the walk, so files that fail them are never opened.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from urllib.parse import unquote, urlparse

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, LessThan, LessThanOrEqual

from ..functions.shipping import ship
from .ignore import matcher, rules_text

SCHEMA = "path string, name string, extension string, is_dir boolean, length long, modified long, content binary"
RULES_FILE = ".gitignore"
#: A walk's state for one scope: its directory, its lines, and what the last line so far says: (place, again).
Scope = tuple[str, tuple[str, ...], tuple[int, bool] | None]


class Files:
    """Listing and reading under a root: local paths by the system, other schemes by Arrow's file systems."""

    def __init__(self, root: str) -> None:
        u = urlparse(root)
        self.arrow, self.root = None, unquote(u.path) if u.scheme == "file" else root
        if u.scheme not in ("", "file"):
            from pyarrow import fs

            self.arrow, self.root = fs.FileSystem.from_uri(root)

    def at(self, path: str) -> str:
        return f"{self.root.rstrip('/')}/{path}" if path else self.root

    def entries(self, path: str) -> list[tuple[str, bool, int, int]]:
        """(name, is directory, length, modified in ns) by name; links and what is neither file nor directory are left out, as are directories that can't be read."""
        out = []
        try:
            if self.arrow:
                from pyarrow import fs

                for x in self.arrow.get_file_info(fs.FileSelector(self.at(path))):
                    if x.type in (fs.FileType.File, fs.FileType.Directory):
                        out.append((x.base_name, x.type == fs.FileType.Directory, x.size or 0, x.mtime_ns or 0))
            else:
                with os.scandir(self.at(path)) as found:
                    for x in found:
                        if x.is_dir(follow_symlinks=False) or x.is_file(follow_symlinks=False):
                            s = x.stat(follow_symlinks=False)
                            out.append((x.name, x.is_dir(follow_symlinks=False), s.st_size, s.st_mtime_ns))
        except OSError:
            return []
        return sorted(out)

    def content(self, path: str) -> bytes | None:
        try:
            if self.arrow:
                with self.arrow.open_input_stream(self.at(path)) as f:
                    return f.read()
            with open(self.at(path), "rb") as f:
                return f.read()
        except OSError:
            return None  # it went meanwhile


class Subtree(InputPartition):
    """A directory with the scopes above it; ``deep``: with all below, otherwise its own files alone."""

    def __init__(self, path: str, scopes: tuple[Scope, ...], deep: bool) -> None:
        self.path, self.scopes, self.deep = path, scopes, deep


class TreeReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.files = Files(options["path"])
        self.skipped = re.compile(options.get("skip", "(?!)"))
        self.first: tuple[str, ...] = tuple(options.get("rules", "").split("\n")) if options.get("rules") else ()
        self.content, self.recursive = options.get("content", "false") == "true", options.get("recursive", "true") == "true"
        self.directories, self.with_rules = options.get("directories", "false") == "true", options.get("gitignore", "true") == "true"
        self.most = int(options.get("partitions", "64"))
        self.within: dict[str, frozenset] = {}
        self.longest: int | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            name = ".".join(f.attribute) if hasattr(f, "attribute") else ""
            if name in ("extension", "name") and isinstance(f, (In, EqualTo)):
                values = frozenset(f.value if isinstance(f, In) else [f.value])
                self.within[name] = self.within.get(name, values) & values
            elif name == "length" and isinstance(f, (LessThan, LessThanOrEqual)):
                longest = f.value - isinstance(f, LessThan)
                self.longest = longest if self.longest is None else min(self.longest, longest)
            else:
                yield f

    def entered(self, path: str, scopes: tuple[Scope, ...]) -> tuple[list[tuple[str, str, bool, int, int, tuple[Scope, ...]]], tuple[Scope, ...]]:
        """A directory's entries that no rule ignores, each with what the scopes say of it, and the scopes in the directory."""
        found = self.files.entries(path)
        if self.with_rules and any(n == RULES_FILE and not d for n, d, _, _ in found) and (lines := rules_text(self.files.content(f"{path}/{RULES_FILE}" if path else RULES_FILE) or b"")):
            if not path and self.first:
                scopes = (("", self.first + tuple(lines), None),)
            elif any(x.strip() for x in lines):
                scopes = (*scopes, (path, tuple(lines), None))
        out = []
        for name, is_dir, length, modified in found:
            if is_dir and self.skipped.search(name):
                continue
            at = f"{path}/{name}" if path else name
            now = []
            for scope, lines, held in scopes:
                said = matcher(lines).last(at[len(scope) + 1 :] if scope else at, is_dir)
                held = max((x for x in (held, said) if x), default=None)
                if held and not held[1]:
                    break
                now.append((scope, lines, held))
            else:
                out.append((at, name, is_dir, length, modified, tuple(now)))
        return out, scopes

    def partitions(self) -> list[InputPartition]:
        """Directories are opened breadth first until there are enough to share out; no file is."""
        first: tuple[Scope, ...] = (("", self.first, None),) if self.first else ()
        todo, own = [("", first)], []
        while self.recursive and todo and len(todo) + len(own) < self.most:
            path, scopes = todo.pop(0)
            own.append(Subtree(path, scopes, False))
            todo += [(at, now) for at, _, is_dir, _, _, now in self.entered(path, scopes)[0] if is_dir]
        return own + [Subtree(p, s, self.recursive) for p, s in todo]

    def read(self, partition: Subtree) -> Iterator[tuple]:
        todo = [(partition.path, partition.scopes)]
        while todo:
            path, scopes = todo.pop()
            for at, name, is_dir, length, modified, now in self.entered(path, scopes)[0]:
                if is_dir and partition.deep:
                    todo.append((at, now))
                if is_dir and not self.directories:
                    continue
                dot = name.rfind(".")
                kind = name[dot:].lower() if dot >= 0 else ""
                if not all((kind if k == "extension" else name) in v for k, v in self.within.items()) or self.longest is not None and length > self.longest:
                    continue
                content = self.files.content(at) if self.content and not is_dir else None
                if content is not None or is_dir or not self.content:
                    yield at, name, kind, is_dir, 0 if is_dir else length, modified, content


class TreeSource(DataSource):
    """Options: path, rules (lines that hold before the root's own), skip (a pattern of directory names), content, recursive, directories, gitignore, partitions."""

    @classmethod
    def name(cls) -> str:
        return "pruned_tree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> TreeReader:
        return TreeReader({k.lower(): v for k, v in self.options.items()})


def register(spark: SparkSession) -> None:
    ship(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(TreeSource)
