"""The event corpus as a whole: where each source keeps its logs, reading all of them with a report, and reading a written corpus back."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .schema import EVENT

# The folders below a home folder that hold each source's logs, and the names of the files in them.
ROOTS = {
    "claude_code": (".claude/projects",),
    "codex": (".codex/sessions", ".codex/archived_sessions"),
    "grok": (".grok/sessions",),
    "gemini_cli": (".gemini/tmp",),
    "antigravity": (".gemini/antigravity-cli/conversations",),
    "cursor": ("Library/Application Support/Cursor/User", ".config/Cursor/User", "AppData/Roaming/Cursor/User"),
}
FILES = {"claude_code": "*.jsonl", "codex": "*.jsonl", "grok": "chat_history.jsonl", "gemini_cli": "session-*.json", "antigravity": "*.db", "cursor": "state.vscdb"}


def discover(spark: SparkSession, home: str, tool: str, roots: Mapping[str, tuple[str, ...]] = ROOTS) -> list[str]:
    """The folders of a source below a home folder that exist, on whatever file system that is."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    found = []
    for r in roots[tool]:
        p = path(f"{home.rstrip('/')}/{r}")
        if p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
            found.append(p.toString())
    return found


def files(spark: SparkSession, paths: list[str], tool: str) -> DataFrame:
    """path, length and modificationTime of a source's files; contents are not read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", FILES[tool]).load(paths).select("path", "length", "modificationTime")


def read_events(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """A written corpus (JSON lines): the events, and one row with lines and bad, those that are no JSON object. Blank lines are neither. Fields that are missing or of another kind are null."""
    lines = spark.read.text(path).where(F.trim("value") != "").select(F.try_parse_json("value").alias("v"))
    good = F.col("v").isNotNull() & F.schema_of_variant("v").startswith("OBJECT")
    fields = [f.split(" ", 1) for f in EVENT.replace(": ", ":").split(", ", 17) if f]
    events = lines.where(good).select(*(F.try_variant_get("v", f"$.{n}", k).alias(n) for n, k in fields))
    return events, lines.agg(F.count("*").alias("lines"), F.count_if(~good).alias("bad"))


def pruned(events: DataFrame, tools: list[str] | None = None, limit: int | None = None) -> DataFrame:
    """Only some sources' events, and of each source those of its newest `limit` files."""
    own = events.where(F.col("tool").isin(tools)) if tools else events
    if limit is None:
        return own
    newest = own.groupBy("tool", "file").agg(F.max("ts").alias("last"))
    from ..operators.score import ranked

    kept = ranked(newest, ["tool"], [F.desc("last"), F.asc("file")], limit).select("tool", "file")
    return own.join(kept, ["tool", "file"], "left_semi")


def report(spark: SparkSession, events: DataFrame, listed: Mapping[str, DataFrame], bad: Mapping[str, DataFrame]) -> DataFrame:
    """tool, files, parsed, failed, bad_lines, events: of each source how many files it has, how many gave events or had a line that could be read, and what did not. listed: files() by tool; bad: bad_lines() by tool (file, lines, bad)."""
    own = events.groupBy("tool", F.col("file")).agg(F.count("*").alias("n"))
    rows = None
    for tool, f in listed.items():
        uri = lambda c: F.regexp_replace(c, "^file:/+", "/")
        x = f.select(uri(F.col("path")).alias("file")).join(own.where(F.col("tool") == tool).groupBy(uri(F.col("file")).alias("file")).agg(F.sum("n").alias("n")), "file", "left")
        if tool in bad:
            x = x.join(bad[tool].select(uri(F.col("file")).alias("file"), "lines", "bad"), "file", "left")
        else:
            x = x.withColumns({"lines": F.lit(None).cast("long"), "bad": F.lit(None).cast("long")})
        read = F.col("n").isNotNull() | (F.coalesce("lines", F.lit(0)) > F.coalesce("bad", F.lit(0)))
        x = x.agg(F.count("*").alias("files"), F.count_if(read).alias("parsed"), F.count_if(~read).alias("failed"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad_lines"), F.coalesce(F.sum("n"), F.lit(0)).alias("events")).select(F.lit(tool).alias("tool"), "*")
        rows = x if rows is None else rows.unionByName(x)
    return rows


def warnings(report: DataFrame) -> list[str]:
    """What a reader of the report should know: sources without files, sources whose every file failed, files that failed."""
    out = []
    for r in report.orderBy("tool").collect():  # a row for each source
        if not r.files:
            out.append(f"{r.tool}: no files")
        elif not r.parsed:
            out.append(f"{r.tool}: none of {r.files} files could be read")
        elif r.failed or r.bad_lines:
            out.append(f"{r.tool}: {r.failed} files and {r.bad_lines} lines could not be read")
    return out


def record_types(lines: DataFrame, handled: list[str], ignored: list[str] = ()) -> DataFrame:
    """type, state (unknown or ignored) and n of parsed lines (v) whose type no event is made of."""
    kind = F.coalesce(F.try_variant_get("v", "$.type", "string"), F.lit("?"))
    rows = lines.where("v is not null").groupBy(kind.alias("type")).agg(F.count("*").alias("n")).where(~F.col("type").isin(list(handled)))
    return rows.select("type", F.when(F.col("type").isin(list(ignored)), "ignored").otherwise("unknown").alias("state"), "n")
