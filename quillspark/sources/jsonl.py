"""Sources of one JSON record per line, read as variants: fields that are missing or of another kind are null, not errors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .schema import finished, iso, lines, project_of, usage

_BLOCKS = "array<struct<type: string, text: string, thinking: string, id: string, name: string, tool_use_id: string, is_error: boolean, content: variant, input: struct<command: string, file_path: string, path: string>>>"


def _v(path: str, kind: str = "string", of: str = "v") -> Column:
    return F.try_variant_get(F.col(of), f"$.{path}", kind)


def _parsed(spark: SparkSession, paths, glob: str = "*.jsonl") -> DataFrame:
    return lines(spark, paths, glob).withColumn("v", F.try_parse_json("raw"))


def bad_lines(spark: SparkSession, paths, glob: str = "*.jsonl") -> DataFrame:
    """How many lines of each file are no JSON."""
    return _parsed(spark, paths, glob).groupBy("file").agg(F.count("*").alias("lines"), F.count_if(F.col("v").isNull()).alias("bad"))


def _flat(content: Column, depth: int = 3) -> Column:
    """Text of a string, or of a list of strings and blocks, whose content may be such a list again."""
    text = F.try_variant_get(content, "$", "string")
    if not depth:
        return F.coalesce(text, F.lit(""))

    def one(block: Column) -> Column:
        inner = F.coalesce(F.try_variant_get(block, "$.text", "string"), _flat(F.try_variant_get(block, "$.content", "variant"), depth - 1))
        return F.when(F.schema_of_variant(block) == "STRING", F.try_variant_get(block, "$", "string")).otherwise(inner)

    # a list tried first: a list may be cast to a string, a string is no list
    parts = F.filter(F.transform(F.try_variant_get(content, "$", "array<variant>"), one), lambda x: x != "")
    return F.coalesce(F.array_join(parts, "\n"), text, F.lit(""))


def claude_code(spark: SparkSession, paths) -> DataFrame:
    """Usage is billed once for each message, on its first event; results get the name of the newest earlier call with their id."""
    v = _parsed(spark, paths).where("v is not null")
    v = v.select("file", "line", _v("type").alias("type"), _v("timestamp").alias("at"), _v("sessionId").alias("session_id"), _v("cwd").alias("cwd"), _v("message.model").alias("model"), F.coalesce(_v("message.id"), _v("requestId")).alias("mid"), _v("message.content", "variant").alias("content"), _v("toolUseResult.exitCode", "int").alias("exit_code"), usage(_v("message.usage.input_tokens", "bigint"), _v("message.usage.output_tokens", "bigint"), _v("message.usage.cache_read_input_tokens", "bigint"), _v("message.usage.cache_creation_input_tokens", "bigint")).alias("u"))
    v = v.where(F.col("type").isin("user", "assistant", "attachment", "system"))
    # a list tried first: a string would be no list, a list may be cast to a string
    blocks = F.try_variant_get("content", "$", _BLOCKS)
    whole = F.array(F.struct(*(x.alias(n) for n, x in (("type", F.lit("whole")), ("text", F.try_variant_get("content", "$", "string")), ("thinking", F.lit(None).cast("string")), ("id", F.lit(None).cast("string")), ("name", F.lit(None).cast("string")), ("tool_use_id", F.lit(None).cast("string")), ("is_error", F.lit(None).cast("boolean")), ("content", F.lit(None).cast("variant")), ("input", F.lit(None).cast("struct<command: string, file_path: string, path: string>"))))))
    own = F.when(F.col("type").isin("user", "assistant"), F.coalesce(blocks, whole)).otherwise(whole)
    e = v.withColumn("billed", F.when(F.col("u").isNotNull(), F.row_number().over(Window.partitionBy("file", F.coalesce("mid", F.concat(F.lit("line "), "line")), F.col("u").isNull()).orderBy("line")) == 1))
    e = e.select("*", F.posexplode_outer(own).alias("sub", "b"))
    b = lambda f: F.col(f"b.{f}")
    kind = F.when(F.col("type").isin("attachment", "system"), "meta").when(b("type").isin("whole", "text"), F.when(F.col("type") == "user", "prompt").otherwise("reply")).when(b("type") == "thinking", "thinking").when(b("type") == "tool_use", "tool_call").when(b("type") == "tool_result", F.when(b("is_error"), "error").otherwise("tool_result")).otherwise("meta")
    role = F.when(F.col("type").isin("attachment", "system"), "system").when(b("type") == "tool_result", "tool").otherwise(F.col("type"))
    text = F.when(b("type") == "thinking", b("thinking")).when(b("type") == "tool_result", _flat(b("content"))).when(b("type") == "tool_use", F.coalesce(b("input.command"), b("input.file_path"), b("input.path"))).otherwise(b("text"))
    e = e.select("file", "line", "sub", iso(F.col("at")).alias("ts"), "session_id", project_of(F.col("cwd")).alias("project"), role.alias("role"), kind.alias("kind"), text.alias("text"), b("name").alias("tool_name"), b("input.command").alias("cmd"), F.when(b("type") == "tool_result", F.col("exit_code")).alias("exit_code"), "model", F.when(F.col("billed") & (F.coalesce("sub", F.lit(0)) == 0), F.col("u")).alias("usage"), b("id").alias("_id"), b("tool_use_id").alias("_of"))
    calls = e.where("kind = 'tool_call'").select("file", F.col("_id").alias("_of"), F.col("line").alias("_at"), F.col("tool_name").alias("_name"))
    near = e.where("_of is not null").select("file", "line", "sub", "_of").join(calls, ["file", "_of"]).where("_at <= line").groupBy("file", "line", "sub").agg(F.max_by("_name", "_at").alias("_call"))
    e = e.join(near, ["file", "line", "sub"], "left").withColumn("tool_name", F.coalesce("tool_name", "_call"))
    return finished(e, "claude_code")


def codex(spark: SparkSession, paths) -> DataFrame:
    """Running token counters become differences; a fall begins anew. Model and directory hold until the next record that names them; before the first, the first."""
    v = _parsed(spark, paths).where("v is not null")
    p = lambda path, kind="string": _v(f"payload.{path}", kind)
    v = v.select("file", "line", _v("type").alias("type"), p("type").alias("sub_type"), _v("timestamp").alias("at"), p("id").alias("sid"), p("cwd").alias("cwd"), p("model").alias("m"), p("role").alias("who"), F.coalesce(p("message"), p("text")).alias("message"), p("content", "variant").alias("content"), p("name").alias("name"), p("call_id").alias("call_id"), p("arguments").alias("arguments"), p("output", "variant").alias("output"),
        *(p(f"info.{t}.{c}", "bigint").alias(f"{t[:4]}_{c}") for t in ("total_token_usage", "last_token_usage") for c in ("input_tokens", "cached_input_tokens", "output_tokens", "total_tokens")))
    file = Window.partitionBy("file")
    past = file.orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    ahead = file.orderBy("line").rowsBetween(0, Window.unboundedFollowing)
    known = lambda c: F.coalesce(F.last(c, ignorenulls=True).over(past), F.first(c, ignorenulls=True).over(ahead))
    v = v.withColumn("model", known(F.when(F.col("type").isin("session_meta", "turn_context"), F.nullif("m", F.lit(""))))).withColumn("dir", known(F.col("cwd"))).withColumn("session_id", known(F.when(F.col("type") == "session_meta", F.col("sid"))))
    counted = v.where("tota_total_tokens is not null")
    w = file.orderBy("line")
    fell = F.lag("tota_total_tokens").over(w).isNull() | (F.col("tota_total_tokens") < F.lag("tota_total_tokens").over(w))
    step = lambda c: F.when(fell, F.col(f"tota_{c}")).otherwise(F.greatest(F.col(f"tota_{c}") - F.lag(f"tota_{c}").over(w), F.lit(0)))
    steps = counted.select("file", "line", *(step(c).alias(f"d_{c}") for c in ("input_tokens", "cached_input_tokens", "output_tokens", "total_tokens")))
    v = v.join(steps, ["file", "line"], "left")
    got = {c: F.coalesce(f"d_{c}", f"last_{c}") for c in ("input_tokens", "cached_input_tokens", "output_tokens", "total_tokens")}
    is_ = lambda t, *s: (F.col("type") == t) & F.col("sub_type").isin(*s)
    kind = F.when(is_("event_msg", "user_message"), "prompt").when(is_("event_msg", "token_count"), "meta").when(is_("response_item", "message") & (F.col("who") == "assistant"), "reply").when(is_("response_item", "message") & (F.col("who") != "user"), "meta").when(is_("response_item", "reasoning"), "thinking").when(is_("response_item", "function_call", "custom_tool_call", "local_shell_call"), "tool_call").when(is_("response_item", "function_call_output", "custom_tool_call_output"), "tool_result")
    out = _flat(F.col("output"))
    low = F.lower(F.substring(out, 1, 400))
    failed = (low.contains("error") & low.contains("exit")) | low.startswith("error")
    args = F.try_parse_json("arguments")
    listed = F.try_variant_get(args, "$.command", "array<string>")
    cmd = F.coalesce(F.concat_ws(" ", listed), F.try_variant_get(args, "$.command", "string"), F.try_variant_get(args, "$.cmd", "string"))
    inner = F.regexp_extract(cmd, r"^(?:/\S*/)?bash -lc (.*)$", 1)
    cmd = F.when(listed.isNull() & cmd.isNull(), F.lit(None)).when(inner != "", F.regexp_replace(inner, r"""^["']|["']$""", "")).otherwise(cmd)
    e = v.withColumn("kind", F.when((kind == "tool_result") & failed, "error").otherwise(kind)).where("kind is not null")
    e = e.withColumn("tool_name", F.coalesce("name", F.last("name", ignorenulls=True).over(Window.partitionBy("file", "call_id").orderBy("line").rowsBetween(Window.unboundedPreceding, 0))))
    role = F.when(F.col("kind") == "prompt", "user").when(F.col("kind").isin("reply", "thinking", "tool_call"), "assistant").when(F.col("kind").isin("tool_result", "error"), "tool").otherwise("system")
    text = F.when(F.col("kind").isin("tool_result", "error"), out).when(F.col("kind") == "tool_call", cmd).otherwise(F.coalesce("message", _flat(F.col("content"))))
    counts = is_("event_msg", "token_count")
    e = e.select("file", "line", iso(F.col("at")).alias("ts"), "session_id", project_of(F.col("dir")).alias("project"), role.alias("role"), "kind", text.alias("text"), "tool_name", F.when(F.col("kind") == "tool_call", cmd).alias("cmd"), "model",
        F.when(counts & (got["total_tokens"] > 0), got["total_tokens"]).alias("tokens"), F.when(counts, usage(got["input_tokens"] - F.coalesce(got["cached_input_tokens"], F.lit(0)), got["output_tokens"], got["cached_input_tokens"], F.lit(0))).alias("usage"))
    return finished(e, "codex")


def grok(spark: SparkSession, paths) -> DataFrame:
    """Chats without times: prompts take theirs from the history beside them by their first 200 characters, the rest the file's."""
    v = _parsed(spark, paths, "chat_history.jsonl").where("v is not null")
    folder = lambda c: F.regexp_replace(c, r"/[^/]+/[^/]+$", "")
    h = _parsed(spark, paths, "prompt_history.jsonl").where("v is not null").select(F.regexp_replace("file", r"/[^/]+$", "").alias("dir"), F.trim(F.substring(_v("prompt"), 1, 200)).alias("key"), "line", iso(_v("timestamp")).alias("seen"))
    h = h.groupBy("dir", "key").agg(F.min_by("seen", "line").alias("seen"))
    v = v.select("file", "line", "mtime", _v("type").alias("type"), _flat(_v("content", "variant")).alias("text"), _v("synthetic_reason").alias("synthetic"), _v("tool_call_id").alias("call_id"), _v("tool_calls", "array<struct<id: string, function: struct<name: string>>>").alias("calls"), F.coalesce(_v("kind.action.query"), _v("kind.tool_type")).alias("query"))
    kind = F.when((F.col("type") == "user") & F.col("synthetic").isNotNull(), "meta").when(F.col("type") == "user", "prompt").when(F.col("type") == "assistant", "reply").when(F.col("type") == "reasoning", "thinking").when(F.col("type") == "tool_result", "tool_result").when(F.col("type") == "backend_tool_call", "tool_call").when(F.col("type") == "system", "meta")
    e = v.withColumn("kind", kind).where("kind is not null").withColumn("dir", folder(F.col("file"))).withColumn("key", F.when(F.col("kind") == "prompt", F.trim(F.substring("text", 1, 200))))
    e = e.join(h, ["dir", "key"], "left")
    asked = v.select("file", F.col("line").alias("_at"), F.explode("calls").alias("c")).select("file", "_at", F.col("c.id").alias("call_id"), F.col("c.function.name").alias("tool_name"))
    named = e.where("call_id is not null").select("file", "line", "call_id").join(asked, ["file", "call_id"]).where("_at <= line").groupBy("file", "line").agg(F.max_by("tool_name", "_at").alias("tool_name"))
    calls = v.select("file", "line", "mtime", F.posexplode("calls").alias("k", "c")).select("file", "line", (F.col("k") + 1).alias("sub"), "mtime", F.lit("assistant").alias("role"), F.lit("tool_call").alias("kind"), F.col("c.function.name").alias("tool_name"))
    role = F.when(F.col("type").isin("user", "system"), F.col("type")).when(F.col("type") == "tool_result", "tool").otherwise("assistant")
    e = e.join(named, ["file", "line"], "left").select("file", "line", F.lit(0).alias("sub"), "mtime", "seen", role.alias("role"), "kind", F.coalesce(F.nullif("text", F.lit("")), "query").alias("text"), "tool_name")
    e = e.unionByName(calls, allowMissingColumns=True)
    cwd = F.try_url_decode(F.regexp_replace(F.try_url_decode(F.regexp_replace(F.regexp_extract("file", r"/([^/]+)/[^/]+/[^/]+$", 1), r"\+", "%2B")), r"\+", "%2B"))
    e = e.withColumn("ts", F.coalesce("seen", F.date_format("mtime", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"))).withColumn("ts_exact", F.col("seen").isNotNull())
    return finished(e.withColumn("session_id", F.regexp_extract("file", r"/([^/]+)/[^/]+$", 1)).withColumn("project", project_of(cwd)), "grok")
