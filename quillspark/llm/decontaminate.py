"""Benchmark decontamination by spaced seeds, in DataFrame operations only.

Words are split at white space after lower-casing. A mask takes some positions of a window of SPAN words and ignores the
others, so a hash over the taken words still meets after a substitution at an ignored place. Hashes of all windows of the
test items join those of all windows of the documents; around each hit the words of the document are laid against the
item's, and the overlap counts if some stretch of STRETCH words (or the whole item, if shorter) agrees in AGREE of its
words. A mask takes two of a window's four pairs of words, and there is one for each choice: two substitutions leave two
pairs whole. Every stretch that counts therefore has a hit, wherever its substitutions are (tests/llm goes through all of
them); only hashes of 64 bits that collide could add a hit, and the words are compared after that. An item of fewer than
SPAN words has windows of its own length, with a mask for each word that may be replaced (one, from four words on); such
windows are made only of lengths that some item has.

The item side is broadcast while it has at most BROADCAST_WORDS words, which is counted; beyond that hits are found by a
shuffle of hashes with the document's id and the place alone, and only texts with a hit are joined again with their words.
Nothing is grouped by item, so a passage that many documents hold makes no hot key.

Defined cases. Null texts and ids of documents, and items without words, meet nothing. Repeated rows of a document give one
result; an id with several texts has the overlaps of all of them. Empty tables give no rows. Other columns, whatever their
names, are not looked at.
"""

from __future__ import annotations

import functools
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

SPAN = 8
MASKS = ((0, 1, 2, 3), (0, 1, 4, 5), (0, 1, 6, 7), (2, 3, 4, 5), (2, 3, 6, 7), (4, 5, 6, 7))
STRETCH, AGREE = 13, 0.75
BROADCAST_WORDS = 250_000


def _words(text: str) -> Column:
    """64-bit hashes of a text's words, in order."""
    return F.transform(F.array_remove(F.split(F.lower(F.col(text).cast("string")), r"[\x20\x09-\x0D]+"), ""), lambda w: F.xxhash64(w))


def _masks(span: int) -> list[tuple[int, ...]]:
    """Places that each mask of a window takes."""
    if span == SPAN:
        return list(MASKS)
    if span - math.ceil(span * AGREE):
        return [tuple(i for i in range(span) if i != gone) for gone in range(span)]
    return [tuple(range(span))]


def _seeds(df: DataFrame, spans: list[int], *columns: str) -> DataFrame:
    """A row for each mask of each window: its place `at` and its hash `seed`, beside columns. spans: windows' lengths."""
    windows = []
    for span in spans:
        n = F.size("words") - span + 1
        shifted = [F.when(n > 0, F.slice("words", i + 1, F.greatest(n, F.lit(0)))).alias(f"w{i}") for i in range(span)]
        found = df.select(*columns, F.posexplode(F.arrays_zip(*shifted)).alias("at", "w"))
        seeds = F.array(*(F.xxhash64(F.lit(span), F.lit(k), *(F.col(f"w.w{i}") for i in mask)) for k, mask in enumerate(_masks(span))))
        windows.append(found.select(*columns, "at", F.explode(seeds).alias("seed")))
    return functools.reduce(DataFrame.unionAll, windows)


def _laid(own: DataFrame, keys: list[str], items: DataFrame, item_id: str, item_text: str) -> DataFrame:
    """Overlaps that count. own: keys and the words of a text."""
    tests = items.select(F.col(item_id).cast("long").alias("item_id"), _words(item_text).alias("words")).where("size(words) > 0")
    sizes = tests.groupBy(F.least(F.size("words"), F.lit(SPAN)).alias("span")).agg(F.sum(F.size("words")).alias("n")).collect()  # SPAN rows at most
    spans = sorted(r["span"] for r in sizes) or [SPAN]
    few = sum(r["n"] for r in sizes) <= BROADCAST_WORDS
    of_span = lambda k: tests.where(F.least(F.size("words"), F.lit(SPAN)) == k)
    seeds = functools.reduce(DataFrame.unionAll, (_seeds(of_span(k), [k], "item_id").withColumnRenamed("at", "item_at") for k in spans)).distinct()
    named = tests.select("item_id", F.col("words").alias("item"))
    if few:
        met = _seeds(own, spans, *keys, "words").join(F.broadcast(seeds), "seed").join(F.broadcast(named), "item_id")
    else:
        own = own.withColumn("text_key", F.xxhash64("words"))
        hits = _seeds(own, spans, *keys, "text_key").join(seeds, "seed").drop("seed").distinct()
        met = hits.join(own, [*keys, "text_key"]).join(named, "item_id")
    # the item laid over the document: from its word `lo` on, as far as both reach
    start = F.col("at") - F.col("item_at")
    lo = F.greatest(-start, F.lit(0))
    length = F.least(F.size("item") - lo, F.size("words") - start - lo)
    agree = F.zip_with(F.slice("words", start + lo + 1, length), F.slice("item", lo + 1, length), lambda a, b: F.when(a == b, 1).otherwise(0))
    met = met.select(*keys, "item_id", start.alias("start"), F.size("item").alias("item_words"), agree.alias("agree"))
    stretch = F.least(F.lit(STRETCH), F.col("item_words"))
    enough = F.exists(F.sequence(F.lit(1), F.size("agree") - stretch + 1), lambda i: F.aggregate(F.slice("agree", i, stretch), F.lit(0), lambda s, x: s + x) >= F.ceil(stretch * AGREE))
    met = met.where((F.size("agree") >= stretch) & F.when(F.size("agree") >= stretch, enough))
    total = F.aggregate("agree", F.lit(0), lambda s, x: s + x)
    return met.groupBy(*keys, "item_id", "start").agg(F.max(total).cast("long").alias("matched"), F.max("item_words").cast("long").alias("item_words"))


def overlaps(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """doc_id, item_id, start (word of the document that the item's first word falls on), matched (agreeing words), item_words."""
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), _words(text_col).alias("words")).where("doc_id is not null")
    return _laid(own, ["doc_id"], items, item_id, item_text)


def leaks(docs: DataFrame, items: DataFrame, **columns: str) -> DataFrame:
    """One row for each document and item that overlap: doc_id, item_id, start and matched of the best overlap, item_words."""
    best = F.max_by(F.struct("start", "matched", "item_words"), F.struct("matched", -F.col("start")))
    return overlaps(docs, items, **columns).groupBy("doc_id", "item_id").agg(best.alias("b")).select("doc_id", "item_id", F.col("b.start").cast("long").alias("start"), "b.matched", "b.item_words")


def cleaned(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of docs whose text holds no item, with all their columns. Texts are known by 128 bits, whatever the ids."""
    key = [F.xxhash64(F.lit(i), F.col(text_col).cast("string")) for i in (1, 2)]
    own = docs.select(key[0].alias("_a"), key[1].alias("_b"), _words(text_col).alias("words"))
    gone = stored(_laid(own, ["_a", "_b"], items, item_id, item_text).select("_a", "_b").distinct(), "leaks")
    return docs.join(gone, (key[0] == gone["_a"]) & (key[1] == gone["_b"]), "left_anti")


def oracle_sql(docs: str = "documents", items: str = "benchmark") -> str:
    """leaks() in DuckDB's SQL, without seeds: every word of an item joins every equal word of the documents, and each
    way to lay an item over a document is judged by the places where they agree."""
    words = r"list_filter(string_split_regex(lower(text), '[\x20\x09-\x0D]+'), lambda w: w <> '')"
    return f"""WITH d AS (SELECT DISTINCT doc_id, {words} AS ws FROM {docs} WHERE doc_id IS NOT NULL), i AS (SELECT item_id, {words} AS ws FROM {items}),
dw AS (SELECT doc_id, hash(ws) AS k, len(ws) AS n, unnest(ws) AS w, generate_subscripts(ws, 1) - 1 AS pos FROM d),
iw AS (SELECT item_id, len(ws) AS n, unnest(ws) AS w, generate_subscripts(ws, 1) - 1 AS pos FROM i),
m AS (SELECT doc_id, k, item_id, dw.pos - iw.pos AS start, iw.pos AS pos, iw.n AS item_words, greatest(iw.pos - dw.pos, 0) AS lo, least(iw.n, dw.n - (dw.pos - iw.pos)) AS hi FROM dw JOIN iw USING (w)),
s AS (SELECT *, least({STRETCH}, item_words) AS len FROM m),
c AS (SELECT *, count(*) OVER (PARTITION BY doc_id, k, item_id, start ORDER BY pos RANGE BETWEEN CURRENT ROW AND {STRETCH - 1} FOLLOWING) AS ahead,
 count(*) FILTER (WHERE pos >= hi - len) OVER (PARTITION BY doc_id, k, item_id, start) AS final, count(*) OVER (PARTITION BY doc_id, k, item_id, start) AS matched FROM s WHERE hi - lo >= len),
g AS (SELECT DISTINCT doc_id, item_id, start, matched, item_words FROM c WHERE (pos <= hi - len AND ahead >= ceil(len * {AGREE})) OR final >= ceil(len * {AGREE}))
SELECT doc_id, item_id, start::BIGINT AS start, matched::BIGINT AS matched, item_words::BIGINT AS item_words FROM g QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY matched DESC, start) = 1"""
