"""The year in numbers: what was asked, when, how politely, and which phrases are a habit. Over events as facets.sliced() gives them, with prose."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import tokens as T
from ..functions import when
from ..functions import words as W

HUMAN_WORDS = 200
MIN_PROMPTS = 3


def prompt_rows(events: DataFrame) -> DataFrame:
    """Prompts with prose: seq, tool, project, day, hour, weekday, prose, n_words, human (short enough to be typed), repeat (an earlier prompt has its near-duplicate key)."""
    own = events.where((F.col("role") == "user") & (F.col("kind") == "prompt") & (F.col("prose") != "")).withColumn("key", T.shingle_key(F.coalesce("text", F.lit(""))))
    first = own.where("key <> ''").groupBy("key").agg(F.min("seq").alias("first"))
    n = F.size(F.filter(F.split("prose", r"\s+"), lambda w: w != ""))
    out = own.join(first, "key", "left").withColumns({"n_words": n.cast("long"), "repeat": F.coalesce(F.col("seq") > F.col("first"), F.lit(False)), "weekday": when.weekday(F.col("day"))})
    return out.select("seq", "tool", "project", "day", "hour", "weekday", "prose", "n_words", (F.col("n_words") <= HUMAN_WORDS).alias("human"), "repeat")


def numbers(prompts: DataFrame) -> DataFrame:
    """One row: words_to_ai (of all prompts, pasted ones too), prompts, human_prompts, days_active, first_day, last_day, tools_used, projects."""
    return prompts.agg(F.coalesce(F.sum("n_words"), F.lit(0)).alias("words_to_ai"), F.count("*").alias("prompts"), F.count_if("human").alias("human_prompts"), F.count_distinct("day").alias("days_active"), F.min("day").alias("first_day"), F.max("day").alias("last_day"), F.count_distinct("tool").alias("tools_used"), F.count_distinct(F.when(F.col("project") != "unknown", F.col("project"))).alias("projects"))


def prompts_by(prompts: DataFrame, key: str) -> DataFrame:
    return prompts.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n"))


def emotions(prompts: DataFrame) -> DataFrame:
    """family, n over prompts that were typed."""
    got = prompts.where("human").agg(*(F.sum(F.regexp_count("prose", F.lit(p))).alias(k) for k, p in W.EMOTIONS.items()))
    pairs = F.array(*(F.struct(F.lit(k).alias("family"), F.coalesce(F.col(k), F.lit(0)).cast("long").alias("n")) for k in W.EMOTIONS))
    return got.select(F.explode(pairs).alias("e")).select("e.*")


def signature(prompts: DataFrame, n: int = 5) -> DataFrame:
    """t, n, projects of the phrases that most projects share: each prompt counts a phrase once, repeats and pasted texts not at all."""
    own = prompts.where("human and not repeat").select("project", F.explode(F.array_distinct(T.ngrams(F.col("prose")))).alias("t"))
    # distinct projects of a phrase are few, prompts are not: counted by both first
    per = own.groupBy("t", "project").agg(F.count("*").alias("c")).groupBy("t").agg(F.sum("c").alias("n"), F.count("project").alias("projects"))
    return per.where(F.col("n") >= MIN_PROMPTS).orderBy(F.desc("projects"), F.desc("n"), "t").limit(n)


def voices(events: DataFrame) -> DataFrame:
    """side, term, n: word n-grams by how many prompts (repeats aside) and replies hold them."""
    prompts = prompt_rows(events).where("not repeat").select(F.lit("user").alias("side"), "prose")
    replies = events.where((F.col("role") == "assistant") & (F.col("kind") == "reply") & (F.col("prose") != "")).select(F.lit("assistant").alias("side"), "prose")
    own = prompts.unionByName(replies).select("side", F.explode(F.array_distinct(T.ngrams(F.col("prose")))).alias("term"))
    return own.groupBy("side", "term").agg(F.count("*").alias("n"))


def shareable(term: Column) -> Column:
    """Whether a term may stand on a card: it is not empty, names no folder and no file."""
    return F.coalesce((term != "") & ~term.contains("/") & ~term.contains("\\") & ~term.startswith("."), F.lit(False))


def first_shareable(terms: DataFrame, limit: int, *order) -> DataFrame:
    """The first `limit` terms (t) in an order that may stand on a card: judged first, cut then."""
    return terms.where(shareable(F.col("t"))).orderBy(*order).limit(limit)


def priciest_day(by_day: DataFrame) -> DataFrame:
    """date and cost of the day that cost most; of equal ones the first."""
    return by_day.where("cost is not null").orderBy(F.desc("cost"), "day").limit(1).select(F.col("day").alias("date"), F.round("cost", 2).alias("cost"))
