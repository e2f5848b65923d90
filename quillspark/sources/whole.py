"""Sources read a file at a time: JSON documents, and SQLite databases by copies in executors' own temporary folders."""

from __future__ import annotations

import os
import sqlite3
import tempfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.paths import normalize_project, project_from_encoded
from .protobuf import strings
from .schema import finished, iso, project_of, usage


# Role and kind of each step type.
STEPS = {
    14: ("user", "prompt"), 23: ("user", "prompt"), 132: ("assistant", "reply"), 15: ("assistant", "thinking"), 21: ("assistant", "tool_call"), 9: ("assistant", "tool_call"),
    17: ("assistant", "tool_call"), 127: ("assistant", "tool_call"), 5: ("tool", "tool_result"), 8: ("tool", "tool_result"), 7: ("tool", "tool_result"), 90: ("system", "meta"),
    98: ("system", "meta"), 101: ("system", "meta"), 139: ("system", "meta"), 33: ("system", "meta"), 25: ("assistant", "tool_call"), 91: ("assistant", "tool_call"),
    138: ("assistant", "tool_call"), 28: ("tool", "error"), 31: ("tool", "error"),
}


# What strings that only route a step look like.
ROUTES = r"(?i)^(?:[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}|(?:\w+\(\*\)\s*)+)$"


def routes(s: Column) -> Column:
    """Whether a string is blank, an identifier, a list of permissions, a session's or a step's envelope, a folder or a call's JSON."""
    t = F.btrim(s, F.lit(" \t\r\n"))
    low = F.lower(F.substring(t, 1, 40))
    return (t == "") | t.rlike(ROUTES) | low.startswith("sessionid") | low.startswith("unsupported mime type") | F.substring(t, 1, 200).contains('"step_index"') | t.startswith("file:///") | (t.startswith("{") & F.substring(t, 1, 400).contains('"toolAction"'))


def gemini_cli(spark: SparkSession, paths) -> DataFrame:
    kind = "sessionId string, projectHash string, startTime string, messages array<struct<id: string, timestamp: string, type: string, content: string, model: string, tokens: struct<input: bigint, output: bigint, cached: bigint, thoughts: bigint, tool: bigint>, toolCalls: array<struct<id: string, name: string, args: string, result: string>>>>"
    docs = spark.read.schema(kind).option("multiLine", "true").option("mode", "PERMISSIVE").option("recursiveFileLookup", "true").option("pathGlobFilter", "session-*.json").json(paths)
    m = docs.select(F.col("_metadata.file_path").alias("file"), "sessionId", "projectHash", "startTime", F.posexplode("messages").alias("line", "m"))
    role = F.when(F.col("m.type") == "user", "user").when(F.col("m.type").isin("gemini", "assistant", "model"), "assistant")
    m = m.withColumn("role", role).where("role is not null")
    t = lambda c: F.coalesce(F.col(f"m.tokens.{c}"), F.lit(0))
    cached = F.least(t("cached"), t("input"))
    used = usage(t("input") + t("tool") - cached, t("output") + t("thoughts"), cached, F.lit(0))
    none = F.lit(None).cast("string")
    said = F.array(F.struct(F.lit(0).alias("sub"), F.when(F.col("role") == "user", "prompt").otherwise("reply").alias("kind"), F.col("m.content").alias("text"), none.alias("name")))
    calls = F.flatten(F.transform(F.coalesce("m.toolCalls", F.array().cast("array<struct<id: string, name: string, args: string, result: string>>")), lambda c, i: F.array(F.struct((2 * i + 1).alias("sub"), F.lit("tool_call").alias("kind"), c["args"].alias("text"), c["name"].alias("name")), F.struct((2 * i + 2).alias("sub"), F.lit("tool_result").alias("kind"), c["result"].alias("text"), c["name"].alias("name")))))
    e = m.withColumn("u", used).select("*", F.explode(F.concat(said, calls)).alias("e")).where("not (e.kind = 'tool_result' and e.text is null)")
    e = e.select("file", F.col("line").cast("bigint"), F.col("e.sub").alias("sub"), F.coalesce(iso(F.col("m.timestamp")), iso(F.col("startTime"))).alias("ts"), F.col("sessionId").alias("session_id"), F.concat(F.lit("gemini:"), F.substring("projectHash", 1, 8)).alias("project"), F.when(F.col("e.kind") == "tool_result", "tool").otherwise(F.col("role")).alias("role"), F.col("e.kind").alias("kind"), F.col("e.text").alias("text"), F.col("e.name").alias("tool_name"), F.col("m.model").alias("model"), F.when(F.col("e.sub") == 0, F.col("u")).alias("usage"))
    return finished(e, "gemini_cli")


def _rows(content: bytes, query: str) -> list[tuple]:
    """Rows of a database given by its bytes; none if it can't be read. The copy lives for the call alone."""
    with tempfile.TemporaryDirectory() as d:
        path = os.path.join(d, "copy.db")
        with open(path, "wb") as f:
            f.write(content)
        try:
            db = sqlite3.connect(f"file:{path}?mode=ro", uri=True)
            try:
                return db.execute(query).fetchall()
            finally:
                db.close()
        except sqlite3.DatabaseError:
            return []


def sqlite_rows(spark: SparkSession, paths, query: str, glob: str, schema: str) -> DataFrame:
    """file and the query's columns for every database below the paths."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(paths).select("path", "modificationTime", "content")
    names = [c.split()[0] for c in schema.split(", ")]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for path, at, content in part.itertuples(index=False):
                rows = _rows(bytes(content), query)
                if rows:
                    yield pd.DataFrame(rows, columns=names).assign(file=path, mtime=at)

    return files.mapInPandas(run, f"{schema}, file string, mtime timestamp")


def unreadable(spark: SparkSession, paths, glob: str, table: str) -> DataFrame:
    """file and bad (whether its table can't be read) of every database below the paths: what the readers of rows pass over."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(paths).select("path", "content")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            bad = [_rows(bytes(c), f"SELECT count(*) FROM {table}") == [] for c in part["content"]]
            yield pd.DataFrame({"file": part["path"], "bad": bad})

    return files.mapInPandas(run, "file string, bad boolean")


def workspace_folders(spark: SparkSession, paths) -> DataFrame:
    """cid, folder: the folders of conversations that a workspace's own database lists, by the workspace.json beside it."""
    folder = lambda c: F.regexp_replace(c, r"/[^/]+$", "")
    named = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "workspace.json").text(paths, wholetext=True)
    named = named.select(folder(F.col("_metadata.file_path")).alias("dir"), F.try_variant_get(F.try_parse_json("value"), "$.folder", "string").alias("folder"))
    items = sqlite_rows(spark, paths, "SELECT CAST(value AS TEXT) FROM ItemTable WHERE key = 'composer.composerData'", "state.vscdb", "value string")
    listed = F.try_variant_get(F.try_parse_json("value"), "$.allComposers", "array<struct<composerId: string>>")
    found = items.select(folder(F.col("file")).alias("dir"), F.explode(listed).alias("c")).select("dir", F.col("c.composerId").alias("cid")).where("cid is not null")
    return found.join(named.where("folder is not null"), "dir").groupBy("cid").agg(F.min_by("folder", "dir").alias("folder"))


def _uri_path(uri) -> Column:
    """The path of a file URI, or of a plain path."""
    return F.nullif(F.try_url_decode(F.regexp_replace(F.regexp_replace(uri, "^file://", ""), r"\+", "%2B")), F.lit(""))


def cursor(spark: SparkSession, paths, home: str | None = None) -> DataFrame:
    """Conversations in a key-value table: bubbles of composers, in their headers' order, those without one after them by time.
    A conversation's project is that of the folder its composer names, else of the first that a bubble names, else of its
    workspace's, else of a folder's encoded name in a bubble."""
    kv = sqlite_rows(spark, paths, "SELECT key, CAST(value AS TEXT) FROM cursorDiskKV WHERE key LIKE 'composerData:%' OR key LIKE 'bubbleId:%' ORDER BY key", "*.vscdb", "key string, value string")
    kv = kv.withColumn("v", F.try_parse_json("value")).where("v is not null").withColumn("cid", F.element_at(F.split("key", ":"), 2))
    g = lambda p, k="string": F.try_variant_get("v", f"$.{p}", k)
    composers = kv.where("key like 'composerData:%'").select("file", "cid", g("createdAt").alias("c_at"), g("modelConfig.modelName").alias("c_model"), g("fullConversationHeadersOnly", "array<struct<bubbleId: string>>").alias("heads"), F.coalesce(*(F.nullif(g(f"workspaceIdentifier.uri.{k}"), F.lit("")) for k in ("fsPath", "path", "external"))).alias("c_uri"))
    order = composers.select("file", "cid", F.posexplode("heads").alias("pos", "h")).select("file", "cid", "pos", F.col("h.bubbleId").alias("bid"))
    b = kv.where("key like 'bubbleId:%'").select("file", "cid", F.element_at(F.split("key", ":"), 3).alias("bid"), g("createdAt").alias("at"), g("type", "int").alias("type"), g("capabilityType", "int").alias("cap"), g("text").alias("said"), g("thinking.text").alias("thought"), g("toolFormerData.name").alias("name"), g("toolFormerData.status").alias("status"), g("toolFormerData.rawArgs").alias("args"), g("toolFormerData.result").alias("result"), g("toolFormerData.error", "variant").alias("failed"), g("modelInfo.modelName").alias("b_model"), _uri_path(F.get(F.filter(g("workspaceUris", "array<string>"), lambda u: u != ""), F.lit(0))).alias("uri"), F.nullif(g("workspaceProjectDir"), F.lit("")).alias("encoded"), usage(g("tokenCount.inputTokens", "bigint"), g("tokenCount.outputTokens", "bigint"), F.lit(0), F.lit(0)).alias("u"))
    b = b.join(composers.drop("heads"), ["file", "cid"], "left").join(order, ["file", "cid", "bid"], "left")
    b = b.withColumn("line", F.row_number().over(Window.partitionBy("file", "cid").orderBy(F.col("pos").asc_nulls_last(), "at", "bid")).cast("bigint"))
    talk = Window.partitionBy("file", "cid").orderBy("line").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    known = lambda c: F.first(c, ignorenulls=True).over(talk)
    b = b.withColumns({"uri": known("uri"), "encoded": known("encoded")}).join(workspace_folders(spark, paths), "cid", "left")
    cwd = F.coalesce(_uri_path(F.col("c_uri")), F.col("uri"), _uri_path(F.col("folder")))
    project = F.when(cwd.isNotNull(), project_of(cwd, home)).when(F.col("encoded").isNotNull(), normalize_project(project_from_encoded(F.regexp_extract("encoded", r"([^/]+)/*$", 1), home))).otherwise("unknown")
    one = lambda sub, kind, text: F.struct(F.lit(sub).alias("sub"), kind.alias("kind"), text.alias("text"))
    bad = F.col("failed").isNotNull() | (F.col("status") == "error")
    after = one(1, F.when(bad, "error").otherwise("tool_result"), F.coalesce("result", F.col("failed").cast("string"), F.lit("")))
    call = F.array(one(0, F.lit("tool_call"), F.coalesce("args", F.lit(""))))
    parts = F.when(F.col("type") == 1, F.array(one(0, F.lit("prompt"), F.col("said")))).when(F.col("cap") == 15, F.when(F.col("result").isNotNull() | bad, F.concat(call, F.array(after))).otherwise(call)).when(F.col("cap") == 30, F.array(one(0, F.lit("thinking"), F.coalesce("thought", "said")))).otherwise(F.array(one(0, F.lit("reply"), F.col("said"))))
    e = b.where("type in (1, 2)").select("*", F.explode(parts).alias("e"))
    model = lambda c: F.when(~F.col(c).isin("default", "auto"), F.nullif(c, F.lit("")))
    cmd = F.try_variant_get(F.try_parse_json("args"), "$.command", "string")

    e = e.select("file", "line", F.col("e.sub").alias("sub"), F.coalesce(iso(F.col("at")), iso(F.col("c_at"))).alias("ts"), iso(F.col("at")).isNotNull().alias("ts_exact"), F.col("cid").alias("session_id"), project.alias("project"), F.when(F.col("e.kind") == "prompt", "user").when(F.col("e.kind").isin("tool_result", "error"), "tool").otherwise("assistant").alias("role"), F.col("e.kind").alias("kind"), F.col("e.text").alias("text"), F.col("name").alias("tool_name"), F.when(F.col("e.kind") == "tool_call", cmd).alias("cmd"), F.coalesce(model("b_model"), model("c_model")).alias("model"), F.when(F.col("e.sub") == 0, F.col("u")).alias("usage"))
    return finished(e, "cursor")


def antigravity(spark: SparkSession, paths, kinds: dict[int, tuple[str, str]] | None = None) -> DataFrame:
    """Steps of protocol-buffer payloads: of what is written the longest string, of others all; a message inside JSON is taken out,
    and strings that only route a step say nothing. kinds: role and kind by step type; others are system meta. The project is
    that of the first folder among a conversation's metadata."""
    steps = sqlite_rows(spark, paths, "SELECT idx, step_type, step_payload FROM steps ORDER BY idx", "*.db", "idx long, step_type int, payload binary")
    notes = sqlite_rows(spark, paths, "SELECT data FROM trajectory_metadata_blob", "*.db", "payload binary")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield part.drop(columns="payload").assign(texts=part["payload"].map(lambda p: [t for _, t in strings(p)]))

    t = steps.mapInPandas(run, "idx long, step_type int, file string, mtime timestamp, texts array<string>")
    said = notes.mapInPandas(run, "file string, mtime timestamp, texts array<string>")
    folders = F.filter("texts", lambda s: s.startswith("file:///") | s.startswith("/Users/") | s.startswith("/home/"))
    where = said.select("file", F.regexp_replace(F.get(folders, F.lit(0)), "^file://", "").alias("cwd")).where("cwd is not null").groupBy("file").agg(F.min("cwd").alias("cwd"))
    rows = [(k, *v) for k, v in (kinds or STEPS).items()]
    known = spark.createDataFrame(rows, "step_type int, role string, kind string")
    e = t.join(F.broadcast(known), "step_type", "left").withColumn("role", F.coalesce("role", F.lit("system"))).withColumn("kind", F.coalesce("kind", F.lit("meta"))).join(where, "file", "left")
    own = F.filter("texts", lambda s: ~routes(s))
    longest = F.aggregate(own, F.lit(""), lambda a, s: F.when(F.length(s) > F.length(a), s).otherwise(a))
    held = F.coalesce(*(F.when(F.trim(x) != "", x) for x in (F.try_variant_get(F.try_parse_json(F.when(F.ltrim(longest).startswith("{"), longest)), f"$.{k}", "string") for k in ("Message", "message", "Prompt", "text"))), longest)
    e = e.withColumn("text", F.when(F.col("kind").isin("prompt", "reply", "thinking"), held).otherwise(F.array_join(own, "\n")))
    cmd = F.when((F.col("kind") == "tool_call") & F.col("text").contains('"CommandLine"'), F.try_variant_get(F.try_parse_json("text"), "$.CommandLine", "string"))
    e = e.select("file", F.col("idx").alias("line"), "role", "kind", "text", cmd.alias("cmd"), project_of(F.col("cwd")).alias("project"), F.date_format("mtime", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("ts"), F.lit(False).alias("ts_exact"), F.lit("heuristic").alias("confidence"), F.regexp_extract("file", r"([^/]+)\.db$", 1).alias("session_id"))
    return finished(e, "antigravity")
