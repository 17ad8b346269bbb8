"""Skills (Markdown files with front matter) and saved sessions (JSON files)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# The categories of skills that name none.
CATEGORIES = {
    "brainstorming": "workflow",
    "code-review": "code",
    "doc-writing-guide": "document",
    "document-review": "workflow",
    "docx": "document",
    "executing-plans": "workflow",
    "finishing-a-development-branch": "workflow",
    "gh-address-comments": "github",
    "gh-fix-ci": "github",
    "github": "github",
    "html-deck": "document",
    "html-report": "document",
    "loop-execution": "workflow",
    "pdf": "document",
    "pptx": "document",
    "pr-reviewing": "github",
    "receiving-code-review": "code",
    "requesting-code-review": "code",
    "research-guide": "research",
    "resuming": "workflow",
    "setup-project": "workflow",
    "skill-authoring": "workflow",
    "skill-creator": "workflow",
    "systematic-debugging": "code",
    "tdd": "code",
    "using-hotl": "workflow",
    "verification-before-completion": "code",
    "writing-plans": "workflow",
    "xlsx": "document",
    "yeet": "github",
}
FRONT = "(?s)^---[ \\t]*\\r?\\n(.*?)\\r?\\n---[ \\t]*(?:\\r?\\n|$)(.*)$"
_CALL = "struct<id:string,type:string,index:int,function:struct<name:string,arguments:string>>"
MESSAGE = f"struct<role:string,content:string,tool_calls:array<{_CALL}>,tool_call_id:string,reasoning_content:string>"


def _field(front: Column, key: str) -> Column:
    return F.regexp_replace(F.trim(F.regexp_extract(front, f"(?m)^{key}:[ \\t]*(.*?)[ \\t\\r]*$", 1)), "^[\"'](.*)[\"']$", "$1")


def parsed_skills(files: DataFrame) -> DataFrame:
    """(name, description, version, category, body, path) of ``files`` (path, text): named ones, the first of each name."""
    front = F.regexp_extract("text", FRONT, 1)
    fields = {k: _field(front, k) for k in ("name", "description", "version", "category")}
    rows = files.select("path", *[c.alias(k) for k, c in fields.items()], F.when(F.rlike("text", F.lit(FRONT)), F.trim(F.regexp_extract("text", FRONT, 2))).otherwise(F.col("text")).alias("body")).filter("name <> ''")
    known = F.create_map(*[F.lit(x) for kv in CATEGORIES.items() for x in kv])
    first = rows.withColumn("k", F.row_number().over(W.partitionBy("name").orderBy("path"))).filter("k = 1").drop("k")
    return first.withColumn("category", F.coalesce(F.nullif("category", F.lit("")), F.try_element_at(known, F.col("name")), F.lit("other")))


def skills(spark: SparkSession, root: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").load(root)
    return parsed_skills(files.select("path", F.decode("content", "UTF-8").alias("text"))).orderBy("name")


def skill_text(spark: SparkSession, root: str, name: str) -> str:
    """The whole SKILL.md of a skill's folder below ``root``; a name that leads elsewhere is refused."""
    name = name.strip()
    if not name or "/" in name or "\\" in name or ".." in name or name == ".":
        raise ValueError(f"no name of a skill: {name!r}")
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "SKILL.md").load(root).filter(F.element_at(F.split("path", "/"), -2) == name)
    row = found.orderBy(F.length("path")).select(F.decode("content", "UTF-8")).first()
    if row is None:
        raise LookupError(f"no skill {name!r}")
    return row[0]


def matching(found: DataFrame, query: str) -> DataFrame:
    """Skills with the query in their name, category or description, in any case, by name."""
    q = query.lower()
    hit = F.lit(False)
    for c in ("name", "category", "description"):
        hit = hit | F.contains(F.lower(c), F.lit(q))
    return found.filter(hit).orderBy("name")


def sessions(spark: SparkSession, root: str) -> DataFrame:
    """(name, working_dir, messages): records, and older files that are a bare array of messages; names descending."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.json").load(root).select("path", F.decode("content", "UTF-8").alias("text"))
    bare = F.startswith(F.trim("text"), F.lit("["))
    record = F.from_json("text", f"working_dir string, messages array<{MESSAGE}>")
    messages = F.when(bare, F.from_json("text", f"array<{MESSAGE}>")).otherwise(record["messages"])
    name = F.regexp_replace(F.substring_index("path", "/", -1), "\\.json$", "")
    return files.select(name.alias("name"), F.when(~bare, record["working_dir"]).alias("working_dir"), messages.alias("messages")).orderBy(F.desc("name"))
