"""Files as lines: listing, grep, ranges, tails and literal replacement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GREP_BYTES = 1 << 20


def lines(files: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, num, line): every line with its number from 1."""
    return files.select(key, F.posexplode(F.split(text, "\n")).alias("pos", "line")).select(key, (F.col("pos") + 1).alias("num"), "line")


def grep(files: DataFrame, key: str, pattern: str) -> DataFrame:
    """Lines that match, trimmed, of files of at most 1 MiB."""
    small = files.filter(F.octet_length("text") <= GREP_BYTES).filter(F.rlike("text", F.lit(pattern)))
    return lines(small, key).filter(F.rlike("line", F.lit(pattern))).withColumn("line", F.trim("line"))


def line_range(files: DataFrame, key: str, start: int, end: int) -> DataFrame:
    """Lines start to end, both included; an end of 0 or less means the last line, a negative start the last lines."""
    if start < 0:
        split = F.split("text", "\n")
        first = F.greatest(F.size(split) + start, F.lit(0))
        tail = files.select(key, first.alias("first"), F.posexplode(F.slice(split, first + 1, F.lit(-start))).alias("pos", "line"))
        return tail.select(key, (F.col("first") + F.col("pos") + 1).alias("num"), "line")
    if 0 < end < start:
        raise ValueError("the end stands before the start")
    found = lines(files, key).filter(F.col("num") >= max(start, 1))
    return found.filter(F.col("num") <= end) if end > 0 else found


# The folders in which no names are sought.
UNSEARCHED = (".git", "node_modules", "vendor", ".idea", ".vscode", "dist", "build", "bin", "obj")


def find_names(paths: DataFrame, path: str, pattern: str) -> DataFrame:
    """Rows whose path's last part matches and lies in none of the folders UNSEARCHED."""
    parts = F.split(path, "/")
    folders = F.slice(parts, 1, F.size(parts) - 1)
    return paths.filter(F.rlike(F.element_at(parts, -1), F.lit(pattern)) & ~F.arrays_overlap(folders, F.array(*map(F.lit, UNSEARCHED))))


def replaced(text: Column, old: str, new: str) -> tuple[Column, Column]:
    """The text with every occurrence replaced, and how many there were."""
    gone = F.replace(text, F.lit(old), F.lit(""))
    return F.replace(text, F.lit(old), F.lit(new)), ((F.length(text) - F.length(gone)) / len(old)).cast("long")


def edited(text: Column, old: str, new: str) -> Column:
    """The text with every occurrence replaced; a text without any fails the query, as an edit that changes nothing is a mistake."""
    if not old:
        raise ValueError("what is to be replaced can't be empty")
    return F.when(F.contains(text, F.lit(old)), F.replace(text, F.lit(old), F.lit(new))).otherwise(F.raise_error(F.lit("nothing to replace: the text doesn't occur")))


def listing(entries: DataFrame, part: str = "") -> DataFrame:
    """Directory entries (name, is_dir, size), directories first, optionally only names with ``part`` in any case."""
    shown = entries.filter(F.contains(F.lower("name"), F.lit(part.lower()))) if part else entries
    return shown.orderBy(F.desc("is_dir"), "name")


RING_LINES = 200


def ring_tail(files: DataFrame, key: str, most: int = RING_LINES) -> DataFrame:
    """What a ring of lines still holds after all were appended: beyond ``most`` lines, the older half goes at once."""
    n = F.size(F.split("text", "\n"))
    kept = F.when(n <= most, n).otherwise(most // 2 + 1 + F.pmod(n - most - 1, F.lit(most - most // 2)))
    tail = files.select(key, (n - kept).alias("gone"), F.posexplode(F.slice(F.split("text", "\n"), n - kept + 1, kept)).alias("pos", "line"))
    return tail.select(key, (F.col("gone") + F.col("pos") + 1).alias("num"), "line")


def first_seen(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Distinct keys in the order in which they first came."""
    return rows.groupBy(key).agg(F.min(order).alias("first"))
