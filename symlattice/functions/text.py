"""Column expressions on names, paths, lines and texts."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns and prefixes that results depend on.
SENSITIVE_NAME = r"(?i)(^|[_\-.])(key|token|secret|passwd|password|credential|auth)([_\-.]|$)"
DANGEROUS_COMMANDS = (
    r"(?i)\brm\s+-[rf]",
    r"(?i)\brmdir\s+/[s]",
    r"(?i)\bformat\s+[a-z]:",
    r"(?i)\bmkfs",
    r"(?i)\bshutdown",
    r"(?i)\breboot",
    r"(?i)\bdd\s+if=",
    r"(?i)\bdeltree",
    r"(?i)\bdiskpart",
    r":\(\)",
    r"(?i)\bRemove-Item\b.*\b-Recurse\b",
    r"(?i)\bRemove-Item\b.*\b-Force\b",
    r"(?i)\bStop-Computer\b",
    r"(?i)\bRestart-Computer\b",
    r"(?i)\bFormat-Volume\b",
    r"(?i)\bClear-Disk\b",
)
BLOCKED_ROOTS = (r"c:\windows", r"c:\program files", r"c:\programdata", r"c:\windows.old", r"c:\$recycle.bin", r"c:\system volume information")
BLOCKED_SEGMENTS = (r"\etc", r"\usr", r"\boot", r"\dev", r"\proc", r"\sys", r"\var", r"\library", r"\system", r"\private")
SIGNATURE_BYTES, DOC_BYTES, MARK = 120, 160, "…"


def collapsed(text: Column) -> Column:
    """White space as single spaces, none at the ends."""
    return F.trim(F.regexp_replace(text, "[\\x20\\x09-\\x0D]+", " "))


def cut_bytes(text: Column, most: int, mark: str = MARK) -> Column:
    """At most ``most`` bytes, with a mark where something was cut; a character is never split."""
    whole = F.decode(F.substring(F.encode(text, "UTF-8"), 1, most), "UTF-8")
    ascii_only = F.octet_length(text) == F.length(text)
    # Beyond ASCII, the longest prefix of characters that fits is found by their summed sizes.
    sizes = F.transform(F.split(text, ""), lambda c: F.octet_length(c))
    fits = F.aggregate(sizes, F.struct(F.lit(0).alias("n"), F.lit(0).alias("b")), lambda a, s: F.struct(F.when(a["b"] + s <= most, a["n"] + 1).otherwise(a["n"]).alias("n"), (a["b"] + s).alias("b")), lambda a: a["n"])
    short = F.when(ascii_only, whole).otherwise(F.substring(text, F.lit(1), fits))
    return F.when(F.octet_length(text) > most, F.concat(short, F.lit(mark))).otherwise(text)


def clean_signature(text: Column) -> Column:
    return cut_bytes(collapsed(text), SIGNATURE_BYTES)


def first_doc_line(text: Column) -> Column:
    """A comment's first line without its leading marks."""
    return cut_bytes(F.trim(F.substring_index(F.regexp_replace(text, "^[/#* \\t]+", ""), "\n", 1)), DOC_BYTES)


def directory(path: Column) -> Column:
    return F.when(F.instr(path, "/") > 0, F.regexp_replace(path, "/[^/]*$", "")).otherwise(".")


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, "(\\.[^./]+)$", 1))


def import_directory(path: Column, module: Column) -> Column:
    """The project directory that an import path names; null for other modules."""
    inside = F.startswith(path, F.concat(module, F.lit("/")))
    return F.when(path == module, ".").when(inside, F.substring(path, F.length(module) + 2, F.length(path)))


def signature_arity(signature: Column) -> Column:
    """struct(n_params, n_results) of ``(a, b) r`` or ``(a) (r, s)``, by one walk over the characters.

    Commas count inside the first brackets, and inside the second if nothing stands between, at no deeper nesting; anything
    else behind the first ones is one result.
    """
    # group: 1 and 2 for the two lists, 0 elsewhere; said: whether the list says anything; tail: something stands outside.
    names = ("depth", "groups", "group", "commas1", "said1", "commas2", "said2", "tail")
    start = F.struct(*[F.lit(0).alias(n) for n in names])

    def step(s: Column, ch: Column) -> Column:
        opens, shuts = ch.isin("(", "[", "{"), ch.isin(")", "]", "}")
        outside, blank = s["depth"] == 0, F.trim(ch) == ""
        lists = outside & (ch == "(") & (s["tail"] == 0) & (s["groups"] < 2)
        top, flag = s["depth"] == 1, lambda c: c.cast("int")

        def inside(k: int) -> tuple[Column, Column]:
            here = s["group"] == k
            comma = here & top & (ch == ",")
            says = here & ~outside & ~blank & ~(top & shuts)
            return s[f"commas{k}"] + flag(comma), F.greatest(s[f"said{k}"], flag(says))

        (c1, s1), (c2, s2) = inside(1), inside(2)
        depth = s["depth"] + flag(opens) - flag(shuts & ~outside)
        group = F.when(lists, s["groups"] + 1).when(outside, 0).otherwise(s["group"])
        tail = F.greatest(s["tail"], flag(outside & ~blank & ~lists & (s["groups"] > 0)))
        values = (depth, s["groups"] + flag(lists), group, c1, s1, c2, s2, tail)
        return F.struct(*[v.alias(n) for n, v in zip(names, values)])

    def count(s: Column) -> Column:
        results = F.when(s["groups"] == 2, F.when(s["said2"] == 1, s["commas2"] + 1).otherwise(0)).otherwise(s["tail"])
        return F.struct(F.when(s["said1"] == 1, s["commas1"] + 1).otherwise(0).alias("n_params"), results.alias("n_results"))

    return F.aggregate(F.split(signature, ""), start, step, count)


def approximate_tokens(text: Column) -> Column:
    """A quarter of the ASCII characters, rounded down, and 0.6 of the others, rounded down."""
    ascii_chars = F.length(F.regexp_replace(text, "[^\\x00-\\x7F]", ""))
    return F.floor(ascii_chars / 4) + F.floor((F.length(text) - ascii_chars) * F.lit(0.6))


def is_sensitive(name: Column) -> Column:
    return F.rlike(name, F.lit(SENSITIVE_NAME))


def is_dangerous(command: Column) -> Column:
    out = F.lit(False)
    for p in DANGEROUS_COMMANDS:
        out = out | F.rlike(command, F.lit(p))
    return out


def is_blocked_path(path: Column) -> Column:
    """Whether an absolute path lies in a system directory."""
    norm = F.replace(F.lower(path), F.lit("/"), F.lit("\\"))
    out = F.lit(False)
    for r in BLOCKED_ROOTS:
        out = out | (norm == F.lit(r)) | F.startswith(norm, F.lit(r + "\\"))
    for s in BLOCKED_SEGMENTS:
        at = F.instr(norm, s)
        before = F.substring(norm, at - 1, F.lit(1))
        out = out | F.startswith(norm, F.lit(s)) | ((at > 1) & before.isin(":", "\\"))
    return out


def words(text: Column) -> Column:
    """Lower-case words of ASCII letters, digits and underscores, and of all characters beyond ASCII."""
    return F.filter(F.split(F.lower(text), "[^a-z0-9_\\x{80}-\\x{10FFFF}]+"), lambda w: w != "")


def progress_step(done: Column, total: Column, percent: int = 5) -> Column:
    """The step of ``percent`` that a progress has reached; none without a total."""
    return F.when(total > 0, F.floor(done * 100 / total / percent))


# Windows-1252's characters for the bytes 80 to 9F, without the five that it leaves free.
WINDOWS_1252 = "€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ"
_BYTES_1252 = "".join(map(chr, (b for b in range(0x80, 0xA0) if b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D))))


def repaired(text: Column) -> Column:
    """UTF-8 that was read as Windows-1252 or Latin-1 and saved again: undone where the bytes are valid UTF-8."""
    bytewise = F.translate(text, WINDOWS_1252, _BYTES_1252)
    raw = F.encode(bytewise, "ISO-8859-1")
    wrong = F.rlike(bytewise, F.lit("[\\x{c2}-\\x{f4}][\\x{80}-\\x{bf}]")) & ~F.rlike(bytewise, F.lit("[\\x{100}-\\x{10FFFF}]"))
    return F.when(wrong & F.is_valid_utf8(raw.cast("string")), raw.cast("string")).otherwise(text)


def decoded_line(raw: Column) -> Column:
    """Bytes as text: UTF-8 where they are valid (and repaired), GBK elsewhere, which Spark's own decoding doesn't know; only the latter reach Python with content."""

    @F.pandas_udf("string")
    def _from_gbk(raw: pd.Series) -> pd.Series:
        return raw.map(lambda b: None if b is None else bytes(b).decode("gbk", "replace"))

    valid = F.is_valid_utf8(raw.cast("string"))
    return F.when(valid, repaired(raw.cast("string"))).otherwise(_from_gbk(F.when(~valid, raw)))


def timestamp_text(ts: Column) -> Column:
    """RFC 3339 in UTC with as many digits of a second as it has."""
    utc = F.to_utc_timestamp(ts, F.current_timezone())
    return F.concat(F.regexp_replace(F.date_format(utc, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), "\\.?0*$", ""), F.lit("Z"))


def timestamp_of(text: Column) -> Column:
    """The timestamp that RFC 3339 says, to the microsecond; null for anything else."""
    return F.when(F.rlike(text, F.lit("^\\d{4}-\\d\\d-\\d\\dT\\d\\d:\\d\\d:\\d\\d(\\.\\d{1,9})?(Z|[+-]\\d\\d:\\d\\d)$")), text.try_cast("timestamp"))
