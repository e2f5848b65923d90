"""Scores over counted terms: distinctiveness, phrase strength, change over time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_n(counts: DataFrame, n: int, by: list[str] | None = None, value: str = "n", term: str = "term") -> DataFrame:
    """The n highest counts, of each group of `by` if given; ties to the smaller term."""
    order = [F.desc(value), F.asc(term)]
    if not by:
        return counts.orderBy(*order).limit(n)
    return counts.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= n)


def ranked(rows: DataFrame, by: list[str], order: list, n: int) -> DataFrame:
    """The first n rows of each group in an order."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= n).drop("rank")


def log_odds_z(n: Column, nt: Column, bg: Column, whole: Column, v: Column, alpha: float = 0.01) -> Column:
    """z of a term with n of its group's nt places, bg of all places `whole`, v distinct terms; null where it can't be told."""
    a0, aw = F.lit(alpha) * F.greatest(v, F.lit(1)), F.lit(alpha) * F.greatest(bg, F.lit(1))
    nr, yr = whole - nt, bg - n
    t0, t1, r0, r1 = n + aw, nt + a0 - n - aw, yr + aw, nr + a0 - yr - aw
    fit = (nt > 0) & (nr > 0) & (t1 > 0) & (r0 > 0) & (r1 > 0)
    return F.when(fit, F.round((F.log(t0 / t1) - F.log(r0 / r1)) / F.sqrt(1 / t0 + 1 / r0), 3))


def log_odds(counts: DataFrame, group: str, n: int = 200, min_count: int = 3, alpha: float = 0.01) -> DataFrame:
    """z of each term in its group against all other groups, with a Dirichlet prior. counts: group, term, n.

    Totals of groups and of terms are joined back as small aggregates; the counts themselves are shuffled by term once.
    """
    background = counts.groupBy("term").agg(F.sum("n").alias("bg"))
    groups = counts.groupBy(group).agg(F.sum("n").alias("nt"))
    whole = background.agg(F.sum("bg").alias("all"), F.count("*").alias("v"))
    x = counts.where(F.col("n") >= min_count).join(background, "term").join(F.broadcast(groups), group).crossJoin(F.broadcast(whole))
    z = log_odds_z(*(F.col(c) for c in ("n", "nt", "bg", "all", "v")), alpha)
    return ranked(x.select(group, "term", "n", z.alias("z")).where("z is not null"), [group], [F.desc("z"), F.desc("n"), F.asc("term")], n)


def pmi_phrases(phrase_counts: DataFrame, word_counts: DataFrame, n: int = 120, min_count: int = 4, min_pmi: float = 2.0) -> DataFrame:
    """Phrases whose words meet more often than apart. Both frames: term, n."""
    total_p, total_w = phrase_counts.agg(F.sum("n").alias("tp")), word_counts.agg(F.sum("n").alias("tw"))
    parts = F.split("term", " ")
    words = word_counts.select(F.col("term").alias("w"), F.col("n").alias("c"))
    x = phrase_counts.where(F.col("n") >= min_count).withColumn("wa", parts[0]).withColumn("wb", parts[1])
    x = x.join(words.select(F.col("w").alias("wa"), F.col("c").alias("ca")), "wa").join(words.select(F.col("w").alias("wb"), F.col("c").alias("cb")), "wb")
    x = x.crossJoin(F.broadcast(total_p)).crossJoin(F.broadcast(total_w))
    pmi = F.log2((F.col("n") / F.col("tp")) / ((F.col("ca") / F.col("tw")) * (F.col("cb") / F.col("tw"))))
    x = x.withColumn("pmi", F.round(pmi, 2)).where(pmi >= min_pmi)
    return x.orderBy((F.col("n") * F.col("pmi")).desc(), "term").limit(n).select("term", "n", "pmi")


def pmi_pairs(pairs: DataFrame, words: DataFrame, n: int = 120, min_count: int = 4, min_pmi: float = 2.0) -> DataFrame:
    """pmi_phrases() of pairs (a, b, n) that are not judged yet: a phrase is a pair of words of `words` (term, n), which the two joins find out and bring the counts for."""
    side = lambda x: words.select(F.col("term").alias(x), F.col("n").alias(f"c{x}"))
    x = pairs.join(side("a"), "a").join(side("b"), "b")
    whole = x.agg(F.sum("n").alias("tp")).crossJoin(words.agg(F.sum("n").alias("tw")))  # one row
    x = x.where(F.col("n") >= min_count).crossJoin(F.broadcast(whole))
    pmi = F.log2((F.col("n") / F.col("tp")) / ((F.col("ca") / F.col("tw")) * (F.col("cb") / F.col("tw"))))
    x = x.where(pmi >= min_pmi).select(F.concat_ws(" ", "a", "b").alias("term"), "n", F.round(pmi, 2).alias("pmi"))
    return x.orderBy((F.col("n") * F.col("pmi")).desc(), "term").limit(n)


def trends(counts: DataFrame, period: str, min_total: int = 8, n: int = 40) -> DataFrame:
    """Rising and fading terms between the earlier and the later half of the periods. counts: period, term, n."""
    # distinct periods are few: one window over them places the cut
    spans = counts.select(period).distinct()
    cut = spans.select(period, F.row_number().over(Window.orderBy(period)).alias("i"), F.count("*").over(Window.partitionBy()).alias("of")).where("of >= 2")
    x = counts.join(F.broadcast(cut), period).withColumn("late", F.col("i") > F.floor(F.col("of") / 2))
    early, late = F.when(~F.col("late"), F.col("n")).otherwise(0), F.when(F.col("late"), F.col("n")).otherwise(0)
    total = x.agg(F.greatest(F.sum(early), F.lit(1)).alias("te"), F.greatest(F.sum(late), F.lit(1)).alias("tl"))
    x = x.groupBy("term").agg(F.sum(early).alias("e"), F.sum(late).alias("l")).where(F.col("e") + F.col("l") >= min_total).crossJoin(F.broadcast(total))
    re, rl = (F.col("e") + 0.5) / F.col("te") * 1e5, (F.col("l") + 0.5) / F.col("tl") * 1e5
    x = x.select("term", (F.col("e") + F.col("l")).alias("n"), F.round(F.log2(rl / re), 3).alias("lift"))
    rising = x.orderBy(F.desc("lift"), F.desc("n"), "term").limit(n).withColumn("direction", F.lit("rising"))
    fading = x.orderBy("lift", F.desc("n"), "term").limit(n).withColumn("direction", F.lit("fading"))
    return rising.unionByName(fading)
