"""The event relation that every source gives and every query reads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.paths import project_from_cwd as project_of  # noqa: F401

USAGE = "struct<input: bigint, output: bigint, cache_read: bigint, cache_write: bigint>"
EVENT = f"file string, line bigint, sub int, ts string, tool string, session_id string, project string, role string, kind string, text string, tool_name string, cmd string, exit_code int, ts_exact boolean, confidence string, tokens bigint, model string, usage {USAGE}"
# Characters of text kept.
RESULT_CHARS, TEXT_CHARS = 2_000, 200_000


def usage(i: Column, o: Column, r: Column, w: Column) -> Column:
    """A usage record; nothing below zero, null if all are zero or missing."""
    parts = [F.greatest(F.coalesce(x.cast("bigint"), F.lit(0)), F.lit(0)) for x in (i, o, r, w)]
    named = F.struct(*(p.alias(n) for p, n in zip(parts, ("input", "output", "cache_read", "cache_write"), strict=True)))
    return F.when(sum(parts[1:], parts[0]) > 0, named)


def finished(df: DataFrame, tool: str) -> DataFrame:
    """Missing columns filled, text cut to its limit, columns in order."""
    have = set(df.columns)
    default = {"tool": F.lit(tool), "ts_exact": F.lit(True), "confidence": F.lit("exact"), "project": F.lit("unknown"), "text": F.lit(""), "sub": F.lit(0)}
    cols = []
    for name, kind in (f.split(" ", 1) for f in EVENT.replace(": ", ":").split(", ", 17) if f):
        c = F.coalesce(F.col(name), default[name]) if name in have and name in default else F.col(name) if name in have else default.get(name, F.lit(None))
        cols.append(c.cast(kind).alias(name))
    out = df.select(*cols)
    return out.withColumn("text", F.when(F.col("kind") == "tool_result", F.substring("text", 1, RESULT_CHARS)).otherwise(F.substring("text", 1, TEXT_CHARS)))


def lines(spark: SparkSession, paths: list[str] | str, glob: str = "*.jsonl") -> DataFrame:
    """file, line, raw text of each non-blank line. A file is split among tasks like any other; `line` orders its lines (where the
    task's part begins plus the line's number in the task), so no shuffle has to."""
    read = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", glob).text(paths)
    # Spark's path metadata is a URI: paths with reserved characters come percent-encoded
    place = F.col("_metadata.file_block_start") + F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    rows = read.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_modification_time").alias("mtime"), place.alias("line"), F.col("value").alias("raw"))
    return rows.where(F.trim("raw") != "")


def iso(ts: Column) -> Column:
    """UTC ISO-8601 of a number (milliseconds beyond 1e12, else seconds) or a string; null if it is neither."""
    n = ts.cast("string").try_cast("double")
    t = F.when(n > 1e12, F.timestamp_millis(n.cast("bigint"))).when(n.isNotNull(), F.timestamp_seconds(n)).otherwise(ts.cast("string").try_cast("timestamp"))
    return F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
