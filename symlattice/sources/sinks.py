"""Writers: sessions under names of their own, and texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def free_name(taken: set[str], working_dir: str, fallback: str) -> str:
    """The last part of a working directory, with -2, -3 and so on if it is taken; ``fallback`` without one."""
    base = working_dir.replace("\\", "/").rstrip("/").rpartition("/")[2] or fallback
    name, k = base, 1
    while name in taken:
        k += 1
        name = f"{base}-{k}"
    return name


def save_session(messages: DataFrame, root: str, name: str, working_dir: str) -> str:
    """Write one session's messages (in ``seq`` order) as ``name``.json, replacing it; the file is whole or absent."""
    spark = messages.sparkSession
    fields = [c for c in messages.columns if c != "seq"]
    inner = F.sort_array(F.collect_list(F.struct("seq", F.struct(*fields).alias("m"))))
    record = messages.agg(F.to_json(F.struct(F.lit(working_dir).alias("working_dir"), F.transform(inner, lambda x: x["m"]).alias("messages"))).alias("value")).first()[0]
    write_file(spark, f"{root}/{name}.json", record)
    return f"{root}/{name}.json"


def write_file(spark: SparkSession, path: str, text: str, append: bool = False) -> None:
    """Write one file, over what is there or after it, with the folders above it; it is the old one or the new one, never half of either."""
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    part = jvm.org.apache.hadoop.fs.Path(at.getParent(), f".{at.getName()}.part")
    conf = spark._jsparkSession.sessionState().newHadoopConf()
    fs = at.getFileSystem(conf)
    out = fs.create(part, True)
    if append and fs.exists(at):
        before = fs.open(at)
        jvm.org.apache.hadoop.io.IOUtils.copyBytes(before, out, conf, False)
        before.close()
    out.write(bytearray(text, "utf-8"))
    out.close()
    fs.delete(at, False)
    fs.rename(part, at)


def write_lines(lines: DataFrame, path: str, append: bool = False) -> None:
    """Write a text column as lines of a folder's files, over what is there or after it."""
    lines.write.mode("append" if append else "overwrite").text(path)
