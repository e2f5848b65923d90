"""Facets, spend and activity over the event relation (seq, ts, tool, session_id, project, role, kind, text, model, usage)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import words as W


def coverage(events: DataFrame, key: str = "tool") -> DataFrame:
    return events.groupBy(key).agg(F.min("ts").alias("first"), F.max("ts").alias("last"), F.count_distinct("session_id").alias("sessions"), F.count("*").alias("events"))


def slice_counts(events: DataFrame, *keys: str) -> DataFrame:
    """Events and sessions of the whole and of each value of each key, by one pass of grouping sets."""
    for k in keys:
        events = events.withColumn(k, F.coalesce(F.col(k), F.lit("unknown")))
    sets = [[], *([F.col(k)] for k in keys)]
    out = events.groupingSets(sets, *(F.col(k) for k in keys)).agg(F.count("*").alias("events"), F.count_distinct("session_id").alias("sessions"))
    kind = F.coalesce(*(F.when(F.col(k).isNotNull(), k) for k in keys), F.lit("global"))
    return out.select(kind.alias("slice"), F.coalesce(*keys, F.lit("")).alias("value"), "events", "sessions")


def first_occurrence(rows: DataFrame, key: str, by: list[str], order: str) -> DataFrame:
    """Rows whose key is seen for the first time in its slice; a row without a key always stays."""
    rank = F.row_number().over(Window.partitionBy(*by, key).orderBy(order))
    empty = F.col(key).isNull() | (F.col(key) == "")
    return rows.where(empty).unionByName(rows.where(~empty).withColumn("_rank", rank).where("_rank = 1").drop("_rank"))


def prices(spark: SparkSession, path: str | None = None) -> DataFrame:
    """The price table, or that of a JSON file: a list of {pattern, input, output, cache_read, cache_write, cached_input}, or such a list under `models`. Rows without a pattern are left out."""
    names = "pattern string, p_input double, p_output double, p_read double, p_write double, p_cached double"
    if path is None:
        return spark.createDataFrame([(k, *v) for k, v in W.PRICES.items()], names)
    row = "struct<pattern: string, input: double, output: double, cache_read: double, cache_write: double, cached_input: double>"
    doc = spark.read.text(path, wholetext=True).select(F.try_parse_json("value").alias("v"))
    rows = doc.select(F.explode(F.coalesce(F.try_variant_get("v", "$.models", f"array<{row}>"), F.try_variant_get("v", "$", f"array<{row}>"))).alias("r")).select("r.*")
    return rows.where("pattern <> ''").toDF(*(n.split()[0] for n in names.split(", ")))


def priced(usage: DataFrame, rates: DataFrame, cached_tools: tuple[str, ...] = ("codex", "gemini_cli")) -> DataFrame:
    """usage (model, tool, input, output, cache_read, cache_write) with cost: the longest price prefix of the model; null if none.

    The prefix is looked up for distinct models only, which are few, then joined back on equality."""
    models = usage.select("model").distinct().where("model is not null")
    best = models.join(F.broadcast(rates), F.col("model").startswith(F.col("pattern"))).groupBy("model").agg(F.max_by(F.struct(*rates.columns), F.length("pattern")).alias("r")).select("model", "r.*")
    read = F.when(F.col("tool").isin(*cached_tools), F.col("p_cached")).otherwise(F.col("p_read"))
    cost = (F.col("input") * F.col("p_input") + F.col("output") * F.col("p_output") + F.col("cache_read") * read + F.col("cache_write") * F.col("p_write")) / 1e6
    return usage.join(best, "model", "left").withColumn("cost", cost)


def spend_by(priced_usage: DataFrame, *keys: str) -> DataFrame:
    """Token sums and cost; the cost of a group is null only if nothing in it has a price."""
    return priced_usage.groupBy(*keys).agg(*(F.sum(c).alias(c) for c in ("input", "output", "cache_read", "cache_write")), F.sum("cost").alias("cost"), F.count("*").alias("responses"))


def by_model(priced_usage: DataFrame, n: int = 60) -> DataFrame:
    """Sums of each model and tool, the costliest first, then those with most tokens."""
    rows = spend_by(priced_usage, "model", "tool").withColumn("cost", F.round("cost", 4))
    return rows.orderBy(F.coalesce("cost", F.lit(0.0)).desc(), (F.col("input") + F.col("output")).desc(), "model", "tool").limit(n)


def by_tool(priced_usage: DataFrame, n: int = 20, session: str = "session_id") -> DataFrame:
    """tool, cost, tokens and sessions, the costliest first."""
    rows = priced_usage.groupBy("tool").agg(F.round(F.coalesce(F.sum("cost"), F.lit(0.0)), 4).alias("cost"), F.sum(F.col("input") + F.col("output") + F.col("cache_read") + F.col("cache_write")).alias("tokens"), F.count_distinct(session).alias("sessions"))
    return rows.orderBy(F.desc("cost"), "tool").limit(n)


def by_day(priced_usage: DataFrame, day: str = "day") -> DataFrame:
    """day, cost and tokens, in order of days."""
    rows = priced_usage.where(F.col(day).isNotNull()).groupBy(F.col(day).alias("day")).agg(F.round(F.coalesce(F.sum("cost"), F.lit(0.0)), 4).alias("cost"), F.sum(F.col("input") + F.col("output") + F.col("cache_read") + F.col("cache_write")).alias("tokens"))
    return rows.orderBy("day")


def cache_hit_rate(usage: DataFrame) -> DataFrame:
    """The share of all tokens on the prompt's side that a cache served."""
    below = F.sum("input") + F.sum("cache_read") + F.sum("cache_write")
    return usage.agg(F.coalesce(F.round(F.when(below > 0, F.sum("cache_read") / below), 4), F.lit(0.0)).alias("rate"))


def usage_delta(cumulative: DataFrame, by: str, order: str, total: str) -> DataFrame:
    """What each row adds to a running counter; a counter that falls has begun anew."""
    before = F.lag(total).over(Window.partitionBy(by).orderBy(order))
    return cumulative.withColumn("delta", F.when(before.isNull() | (F.col(total) < before), F.col(total)).otherwise(F.col(total) - before))


def last_known(rows: DataFrame, value: str, by: str, order: str, name: str) -> DataFrame:
    """The value last seen at or before each row; before the first, the first one after it."""
    past = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(name, F.coalesce(F.last(value, ignorenulls=True).over(past), F.first(value, ignorenulls=True).over(Window.partitionBy(by).orderBy(order).rowsBetween(0, Window.unboundedFollowing))))


def matched_calls(results: DataFrame, calls: DataFrame, keys: list[str], order: str, name: str) -> DataFrame:
    """Each result with the name of the newest call at or before it with its id; null if there is none. One ordered pass over both: no result meets all calls of its key."""
    rows = results.select("*", F.lit(None).cast("string").alias("_name"), F.lit(1).alias("_last"))
    both = rows.unionByName(calls.select(*keys, order, F.col(name).cast("string").alias("_name"), F.lit(0).alias("_last")), allowMissingColumns=True)
    past = Window.partitionBy(*keys).orderBy(order, "_last").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return both.withColumn(name, F.last("_name", ignorenulls=True).over(past)).where("_last = 1").drop("_name", "_last")


def longest_streak(days: DataFrame, by: str, day: str) -> DataFrame:
    """The longest run of days in a row, by gaps and islands over distinct days."""
    d = days.select(by, F.to_date(day).alias("d")).where("d is not null").distinct()
    isle = F.date_sub("d", F.row_number().over(Window.partitionBy(by).orderBy("d")))
    return d.withColumn("isle", isle).groupBy(by, "isle").count().groupBy(by).agg(F.max("count").alias("streak"))


def histogram(spark: SparkSession, rows: DataFrame, value: Column, low: int, high: int, name: str) -> DataFrame:
    """Counts of every value from low to high, zeros included."""
    n = rows.groupBy(value.cast("int").alias(name)).agg(F.count("*").alias("n"))
    return spark.range(low, high + 1).select(F.col("id").cast("int").alias(name)).join(n, name, "left").select(name, F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def emotions(rows: DataFrame, text: str = "text", longest: int = 200) -> DataFrame:
    """Hits of each family over texts of at most `longest` words."""
    human = rows.where(F.size(F.split(F.trim(text), r"\s+")) <= longest)
    got = human.agg(*(F.sum(F.regexp_count(text, F.lit(p))).alias(k) for k, p in W.EMOTIONS.items()))
    pairs = F.array(*(F.struct(F.lit(k).alias("family"), F.coalesce(F.col(k), F.lit(0)).cast("long").alias("n")) for k in W.EMOTIONS))
    return got.select(F.explode(pairs).alias("e")).select("e.*")
