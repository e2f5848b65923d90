"""Tokens, phrases and word n-grams as column expressions (no Python per row).

Whether a token is vocabulary takes a dozen patterns, so it is asked of distinct tokens after they are counted: see judged().
"""

from __future__ import annotations

import functools

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import words as W
from .fold import composed


def _trimmed(c: Column) -> Column:
    return F.btrim(F.lower(c), F.lit("-.'"))


def among(t: Column, words: list[str]) -> Column:
    """t.isin(words), with the list made in the JVM at once: one by one, hundreds of literals take most of a query's time to build."""
    jvm = SparkContext._active_spark_context._jvm
    return type(t)(t._jc.isInCollection(jvm.java.util.regex.Pattern.compile(" ").splitAsStream(" ".join(words)).toList()))


def opaque(t: Column) -> Column:
    """A run of ten or more letters and digits with three runs of digits, or of fourteen with few vowels."""

    def odd(run: Column) -> Column:
        letters = F.length(F.regexp_replace(run, "[^a-z]", ""))
        vowels = F.length(F.regexp_replace(run, "[^aeiouy]", ""))
        return (F.length(run) >= 10) & (letters > 0) & ((F.regexp_count(run, F.lit("[0-9]+")) >= 3) | ((F.length(run) >= 14) & (vowels < 0.2 * letters)))

    return F.exists(F.regexp_extract_all(t, F.lit("[0-9a-z]+"), F.lit(0)), odd)


def keeps(t: Column) -> Column:
    """Whether a token is vocabulary."""
    digits = F.length(F.regexp_replace(t, "[^0-9]", ""))
    return (
        F.length(t).between(3, 28)
        & ~among(t, W.STOPWORDS)
        & ~t.rlike(W.HOST)
        & ~t.rlike(W.DOTTED)
        & (t.rlike("[aeiouy]") | t.rlike(r"[^\x00-\x7f]"))
        & ((digits == 0) | ((F.length(t) > 3) & (digits <= 0.4 * F.length(t))))
        & ~t.rlike(W.CREDENTIAL)
        & ~opaque(t)
    )


def raw_tokens(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(composed(text), F.lit(W.TOKEN), F.lit(0)), _trimmed)


def tokens(text: Column) -> Column:
    return F.filter(raw_tokens(text), keeps)


def judged(counts: DataFrame, *terms: str, n: str = "n") -> DataFrame:
    """Rows of counted terms that are vocabulary. The condition names the count, so that it stays above the aggregation and
    is asked once for each distinct term instead of at each of its places."""
    good = F.lit(True)
    for t in terms or ("term",):
        good = good & keeps(F.col(t))
    return counts.where(F.when(F.col(n) > 0, good))


def linked_tokens(text: Column) -> Column:
    """Raw tokens, each with the spaces, tabs or no-break spaces behind it where another token follows them at once."""
    return F.regexp_extract_all(composed(text), F.lit(W.LINKED), F.lit(0))


def words_and_pairs(text: Column) -> Column:
    """Of one reading of a text: each token, and each pair of tokens with spaces alone between them as `a b`. Neither is judged."""

    def of(found: Column) -> Column:
        bare = F.transform(found, lambda t: F.btrim(F.lower(t), F.lit("-.' \t\u00a0")))
        last = F.transform(found, lambda t: F.right(t, F.lit(1)).isin(" ", "\t", "\u00a0"))
        trios = F.arrays_zip(bare.alias("a"), F.slice(bare, 2, F.greatest(F.size(bare), F.lit(1))).alias("b"), last.alias("near"))
        return F.concat(bare, F.transform(F.filter(trios, lambda x: x["near"]), lambda x: F.concat(x["a"], F.lit(" "), x["b"])))

    # bound once: an array of one element, so that the extraction is not repeated for each use
    return F.flatten(F.transform(F.array(linked_tokens(text)), of))


def is_pair(t: Column) -> Column:
    return t.contains(" ")


def phrases(text: Column) -> Column:
    """Adjacent kept tokens with spaces, tabs or no-break spaces alone between them."""
    return F.filter(words_and_pairs(text), lambda t: is_pair(t) & keeps(F.split_part(t, F.lit(" "), F.lit(1))) & keeps(F.split_part(t, F.lit(" "), F.lit(2))))


def ngrams(text: Column, sizes: tuple[int, ...] = (2, 3)) -> Column:
    """Word n-grams with function words inside, neither first nor last, every word word-like. A word is judged once, whatever grams it is in."""

    def kind(w: Column) -> Column:
        return F.when(~w.rlike(W.WORD_LIKE), "x").when(among(w, W.BASE_STOP), "s").otherwise("g")

    def of(words: Column) -> Column:
        judged_ = F.transform(words, lambda w: F.struct(w.alias("w"), kind(w).alias("k")))

        def grams(rows: Column, n: int) -> Column:
            shifted = F.arrays_zip(*(F.slice(rows, i + 1, F.greatest(F.size(rows) - n + 1, F.lit(0))).alias(f"r{i}") for i in range(n)))
            inner = lambda x: functools.reduce(Column.__and__, (x[f"r{i}"]["k"] != "x" for i in range(1, n - 1)), F.lit(True))
            good = F.filter(shifted, lambda x: (x["r0"]["k"] == "g") & (x[f"r{n - 1}"]["k"] == "g") & inner(x))
            return F.transform(good, lambda x: F.concat_ws(" ", *(x[f"r{i}"]["w"] for i in range(n))))

        return F.transform(F.array(judged_), lambda rows: F.concat(*(grams(rows, n) for n in sizes)))[0]

    found = F.array(F.filter(raw_tokens(text), lambda t: t != ""))
    return F.transform(found, of)[0]


def shingle_key(text: Column, n: int = 6) -> Column:
    """The first n raw tokens that are letters only: near-duplicate prompts share it."""
    return F.concat_ws(" ", F.slice(F.filter(raw_tokens(text), lambda t: t.rlike(W.LETTERS)), 1, n))
