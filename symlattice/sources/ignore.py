"""Ignore rules as rows, and the paths that they leave.

Within one rules file the last line that matches decides; a path is ignored if any scope above it says so, and what lies
below an ignored directory is ignored whatever later lines say. A line matches an entry of a tree, and with it all that
lies below; so the entries of all paths meet the rules once, by joins on their scope and on what the rule names.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from functools import lru_cache
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.shipping import ship


class Rule(NamedTuple):
    """``again``: re-includes; ``folder``: directories only; ``kind``: name, suffix (of a name), path or regex (over paths, directories with a slash at their end)."""

    again: bool
    folder: bool
    kind: str
    key: str


RULE = "again boolean, folder boolean, kind string, key string"


def rule_of(line: str) -> Rule | None:
    """What a rules line says of paths relative to its scope; None for blanks and comments. A question mark stands for itself."""
    line = line.rstrip("\r\n").strip()
    if not line or line.startswith("#"):
        return None
    again, line = line.startswith("!"), line.removeprefix("!")
    line = line.removeprefix("\\") if line[:2] in ("\\#", "\\!") else line
    folder = line.endswith("/")
    line = line.rstrip("/")
    while line.startswith("**/") and "/" not in line[3:]:
        line = line[3:]
    anchored = "/" in line
    line = line.removeprefix("/")
    if not line:
        return None
    if "*" not in line:
        return Rule(again, folder, "path" if anchored else "name", line)
    if not anchored and re.fullmatch(r"\*\.[^*/]+", line):
        return Rule(again, folder, "suffix", line[1:])
    out, i = "", 0
    while i < len(line):
        if line.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif line.startswith("/**", i) and i + 3 == len(line):
            out, i = out + "/.*", i + 3
        elif line[i] == "*":
            out, i = out + "[^/]*", i + 1
        else:
            out, i = out + re.sub(r"[\\.^$|?+()\[\]{}]", r"\\\g<0>", line[i]), i + 1
    return Rule(again, folder, "regex", f"^{'' if anchored else '(?:.*/)?'}{out}/{'' if folder else '?'}$")


def rules_text(content: bytes) -> list[str]:
    """The lines of a rules file; one that isn't UTF-8 has none."""
    try:
        return content.decode("utf-8").split("\n")
    except UnicodeDecodeError:
        return []


class Matcher:
    """One scope's rules, by name, suffix and path in dictionaries; only those with other wildcards are tried in turn."""

    def __init__(self, lines: Iterable[str]) -> None:
        self.keyed: dict[tuple[str, str], list[tuple[int, bool, bool]]] = {}
        self.tried: list[tuple[int, bool, bool, re.Pattern]] = []
        for at, line in enumerate(lines):
            if not (r := rule_of(line)):
                continue
            if r.kind == "regex":
                self.tried.append((at, r.folder, r.again, re.compile(r.key)))
            else:
                self.keyed.setdefault((r.kind, r.key), []).append((at, r.folder, r.again))

    def last(self, rel: str, is_dir: bool) -> tuple[int, bool] | None:
        """(place, again) of the last line that matches this entry itself."""
        name = rel.rpartition("/")[2]
        keys = [("name", name), ("path", rel), *(("suffix", name[i:]) for i, c in enumerate(name) if c == ".")]
        found = [(at, again) for k in keys for at, folder, again in self.keyed.get(k, ()) if is_dir or not folder]
        found += [(at, again) for at, folder, again, p in self.tried if (is_dir or not folder) and p.match(f"{rel}/" if is_dir else rel)]
        return max(found, default=None)


@lru_cache(maxsize=256)
def matcher(lines: tuple[str, ...]) -> Matcher:
    return Matcher(lines)


def rule_rows(lines: DataFrame) -> DataFrame:
    """(scope, at, again, folder, kind, key) of rules ``lines`` (scope, at, line); the root's scope is ''."""
    ship(lines.sparkSession)

    @F.pandas_udf(RULE)
    def said(line: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([rule_of(x or "") or (None,) * 4 for x in line], columns=Rule._fields)

    return lines.select("scope", "at", said("line").alias("r")).select("scope", "at", "r.*").filter("kind is not null")


def unignored(paths: DataFrame, rules: DataFrame) -> DataFrame:
    """The rows of ``paths`` (path, ...) that no rule ignores; rules are rows of ``rule_rows``.

    A path ends with a slash if it is a directory. Entries are the paths and the directories above them, each once; what
    meets rules with wildcards are the entries of the rule's scope.
    """
    parts = F.split(F.rtrim("path", F.lit("/")), "/")
    last = F.size(parts)
    steps = F.transform(F.sequence(F.lit(1), last), lambda i: F.struct(F.array_join(F.slice(parts, 1, i), "/").alias("entry"), ((i < last) | F.endswith("path", F.lit("/"))).alias("is_dir"), i.alias("depth")))
    whole = paths.select("path").distinct()
    climbed = whole.select("path", F.inline(steps))
    entry = F.split("entry", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(entry) - 1), lambda i: F.struct(F.array_join(F.slice(entry, 1, i), "/").alias("scope"), F.array_join(F.slice(entry, i + 1, F.size(entry)), "/").alias("rel")))
    scoped = climbed.select("entry", "is_dir").distinct().select("entry", "is_dir", F.inline(above)).withColumn("name", F.substring_index("rel", "/", -1))
    dots = F.filter(F.sequence(F.lit(1), F.length("name")), lambda i: F.substring("name", i, F.lit(1)) == ".")
    suffixes = F.transform(dots, lambda i: F.struct(F.lit("suffix").alias("kind"), F.substring("name", i, F.length("name")).alias("key")))
    own = F.array(F.struct(F.lit("name").alias("kind"), F.col("name").alias("key")), F.struct(F.lit("path").alias("kind"), F.col("rel").alias("key")))
    said = ["entry", "is_dir", "scope", "at", "again"]
    keyed = scoped.select("entry", "is_dir", "scope", F.inline(F.concat(own, suffixes))).join(rules, ["scope", "kind", "key"]).filter("is_dir or not folder").select(*said)
    tried = scoped.join(rules.filter("kind = 'regex'"), "scope").filter((F.col("is_dir") | ~F.col("folder")) & F.rlike(F.when(F.col("is_dir"), F.concat("rel", F.lit("/"))).otherwise(F.col("rel")), F.col("key"))).select(*said)
    met = keyed.unionByName(tried).groupBy("entry", "is_dir", "scope").agg(F.max(F.struct("at", "again")).alias("said"))
    # What a directory's line says holds below it until a later line of the same scope says otherwise.
    down = W.partitionBy("path", "scope").orderBy("depth").rowsBetween(W.unboundedPreceding, 0)
    held = climbed.join(met, ["entry", "is_dir"]).withColumn("now", F.max("said").over(down))
    return paths.join(held.filter("not now.again").select("path").distinct(), "path", "left_anti")
