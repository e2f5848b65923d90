"""Near-duplicate documents by HyperMinHash.

A document is the set of its distinct k-word shingles (words are `[^\\x20\\x09-\\x0D]+` after A-Z are lower-cased; with
fewer than k words the whole sequence is one shingle). Each of REGISTERS buckets keeps, of its hash's minimum over the
set, the count of leading zeros and MANTISSA bits after the first one: 16 bits instead of 32 or 64. Bands of registers
propose pairs, the Jaccard estimate corrected for chance collisions of compressed registers drops most wrong ones, and
full sets confirm the rest.

No group is ever expanded to all its pairs. Equal sets become one class first. Classes that share a band link to one
leader of the bucket; confirmed links make components; only buckets that still hold several components go on. There,
members outside the bucket's main component meet the others: as pairs in small buckets, in blocks of BLOCK members (fewer,
if their texts are long) inside a task, which returns confirmed links only, in large ones. So a link is lost only where no band of two similar sets
agrees, (1 - 0.8**6)**45, about 1e-6, or the estimate is five standard deviations low, both at the threshold itself; less
above it.

Defined cases. Null or wordless text: no shingles, linked with nothing, kept. Null doc_id: kept as a row, its class
takes part under its smallest id that is not null. Repeated rows come back as often as they came. An id with several texts
is found out and its rows are told apart by numbers of their own. An empty table gives no rows. Columns other than the id
and the text are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, bounded, dropped, hashed_words, mark, mixed, rng_constants, stored

BANDS, ROWS = 45, 6
REGISTERS = BANDS * ROWS
MANTISSA = 10
MARGIN = 0.12  # five standard deviations of the estimate at 0.8
BLOCK = 512  # members of a large bucket that one task compares with as many others
BLOCK_SHINGLES = 2_000_000  # that such a block of members holds together: long texts make smaller blocks
_ONES = (rng_constants(11, REGISTERS) >> U64(32)).astype(np.uint32) | np.uint32(1)
_TWOS = (rng_constants(12, REGISTERS) >> U64(32)).astype(np.uint32)
_MIX = rng_constants(13, 64) | U64(1)


# --- sets and registers ----------------------------------------------------------------------


def shingle_sets(column: pa.Array, k: int) -> Iterator[np.ndarray]:
    """For each row the sorted distinct 64-bit hashes of its shingles."""
    for a, b, words, firsts in hashed_words(column):
        if len(words) >= k:
            n = len(words) - k + 1
            grams = words[:n] * _MIX[0]
            for j in range(1, k):
                grams = grams + words[j : j + n] * _MIX[j]
            grams = mixed(grams)
        for i in range(b - a):
            lo, hi = firsts[i], firsts[i + 1]
            if hi - lo >= k:
                yield np.unique(grams[lo : hi - k + 1])
            elif hi > lo:
                own = words[lo:hi] * _MIX[: hi - lo]
                yield mixed(own.sum(keepdims=True) + np.array([hi - lo], np.uint64) * _MIX[-1])
            else:
                yield words[:0]


def registers(grams: np.ndarray) -> np.ndarray:
    """The HyperMinHash registers of a set that is not empty: 6 bits of leading zeros, then the mantissa."""
    low = grams.astype(np.uint32)[:, None]
    least = np.full(REGISTERS, 0xFFFFFFFF, dtype=np.uint32)
    step = 1024
    room = np.empty((min(step, len(low)), REGISTERS), dtype=np.uint32)
    for at in range(0, len(low), step):
        part = low[at : at + step]
        out = room[: len(part)]
        np.multiply(part, _ONES, out=out)
        out += _TWOS
        np.minimum(least, out.min(axis=0), out=least)
    part, exponent = np.frexp(least.astype(np.float64))
    zeros = np.where(least == 0, 32, 32 - exponent).astype(np.uint16)
    bits = np.where(least == 0, 0, (part * 2 - 1) * (1 << MANTISSA)).astype(np.uint16)
    return (zeros << np.uint16(MANTISSA)) | bits


def bands(regs: np.ndarray) -> np.ndarray:
    """One bucket number for each band, as signed 64-bit numbers."""
    rows = regs.reshape(-1, BANDS, ROWS).astype(np.uint64)
    keys = (rows * _MIX[:ROWS]).sum(axis=2, dtype=np.uint64) + np.arange(1, BANDS + 1, dtype=np.uint64) * _MIX[50]
    return mixed(keys).view(np.int64)


def estimates(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Jaccard estimates of rows of registers: the share that agrees, less what disjoint sets of these sizes share by chance."""
    same = (a == b).mean(axis=1)
    chance = 0.1699 * 2.0**-MANTISSA * 4.0 * na * nb / np.maximum(na + nb, 1) ** 2
    return (same - chance) / (1 - chance)


def sketches(docs: DataFrame, k: int, id_col: str, text_col: str) -> DataFrame:
    """One row for each document: doc_id, n_shingles, set_key (128 bits of its whole set, null if empty), regs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, keys, regs = [], [], []
            for grams in shingle_sets(batch.column(1), k):
                n.append(len(grams))
                keys.append(xxhash.xxh3_128_digest(grams.tobytes()) if len(grams) else None)
                regs.append(registers(grams).tobytes() if len(grams) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array(regs, pa.binary())], ["doc_id", "n_shingles", "set_key", "regs"])

    own = bounded(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return own.mapInArrow(run, "doc_id long, n_shingles long, set_key binary, regs binary")


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint16).reshape(-1, REGISTERS)


def _banded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            keys = bands(_matrix(batch.column(1)))
            ids = np.repeat(batch.column(0).to_numpy(zero_copy_only=False), BANDS)
            yield pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1)), pa.array(ids)], ["bucket", "node"])


# --- links -----------------------------------------------------------------------------------


def _confirmed(pairs: DataFrame, classes: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """Of pairs (a, b) of nodes, those whose full sets reach the threshold."""
    least = percent / 100 - MARGIN

    def estimate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                na, nb = (batch.column(i).to_numpy().astype(np.float64) for i in (2, 3))
                near = estimates(_matrix(batch.column(4)), _matrix(batch.column(5)), na, nb) >= least
                yield batch.select(["a", "b"]).filter(pa.array(near))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = []
            for x, y in zip(shingle_sets(batch.column(2), k), shingle_sets(batch.column(3), k), strict=True):
                both = len(np.intersect1d(x, y, assume_unique=True))
                near.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(near, pa.bool_()))

    def sided(df: DataFrame, side: str, *columns: str) -> DataFrame:
        return df.select(F.col("node").alias(side), *(F.col(c).alias(f"{c}_{side}") for c in columns))

    size = F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent
    met = pairs.join(sided(classes, "a", "n", "regs"), "a").join(sided(classes, "b", "n", "regs"), "b").where(size)
    likely = met.select("a", "b", "n_a", "n_b", "regs_a", "regs_b").mapInArrow(estimate, "a long, b long")
    likely = stored(likely, "likely")
    full = likely.join(sided(texts, "a", "text"), "a").join(sided(texts, "b", "text"), "b")
    return full.select("a", "b", "text_a", "text_b").mapInArrow(verify, "a long, b long")


def _across(open_: DataFrame, classes: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """Confirmed links between components within large buckets. open_: bucket, node, part, main, top, size, mass."""
    least = percent / 100 - MARGIN

    def run(group: pa.Table) -> pa.Table:
        rows = group.to_pydict()
        regs = np.frombuffer(b"".join(rows["regs"]), dtype=np.uint16).reshape(-1, REGISTERS)
        n, part, node = np.array(rows["n"], dtype=np.float64), np.array(rows["part"]), np.array(rows["node"])
        asked = np.array(rows["asked"])
        band = int(np.flatnonzero(bands(regs[:1])[0] == rows["bucket"][0])[0])
        target = np.flatnonzero(~asked)
        sets: dict[int, np.ndarray] = {}

        def whole(i: int) -> np.ndarray:
            if i not in sets:
                sets[i] = next(shingle_sets(pa.array([rows["text"][i]]), k))
            return sets[i]

        found: list[tuple[int, int]] = []
        for i in np.flatnonzero(asked):
            fits = target[(part[target] != part[i]) & (np.minimum(n[target], n[i]) * 100 >= np.maximum(n[target], n[i]) * percent)]
            if not len(fits):
                continue
            same = regs[fits] == regs[i]
            first = same.reshape(-1, BANDS, ROWS).all(axis=2).argmax(axis=1) == band  # each pair in one of its buckets
            chance = 0.1699 * 2.0**-MANTISSA * 4.0 * n[fits] * n[i] / (n[fits] + n[i]) ** 2
            near = fits[first & ((same.mean(axis=1) - chance) / (1 - chance) >= least)]
            for j in near:
                x, y = whole(i), whole(j)
                both = len(np.intersect1d(x, y, assume_unique=True))
                if 100 * both >= percent * (len(x) + len(y) - both):
                    found.append((min(node[i], node[j]), max(node[i], node[j])))
        return pa.table({"a": pa.array([x[0] for x in found], pa.int64()), "b": pa.array([x[1] for x in found], pa.int64())})

    parts = lambda n, mass: F.ceil(F.greatest((F.col(n) if isinstance(n, str) else n) / BLOCK, (F.col(mass) if isinstance(mass, str) else mass) / BLOCK_SHINGLES))
    sized = open_.select("bucket", "node", "part", (F.col("part") != F.col("main")).alias("minor"), parts("size", "mass").alias("tn"), parts(F.col("size") - F.col("top"), F.col("mass") * (F.col("size") - F.col("top")) / F.col("size")).alias("qn"))
    whole = sized.join(classes.select("node", "n", "regs"), "node").join(texts, "node")
    asked = whole.where("minor").select("*", F.lit(True).alias("asked"), F.pmod(F.xxhash64("node"), "qn").alias("q"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("tn") - 1)).alias("t"))
    others = whole.select("*", F.lit(False).alias("asked"), F.pmod(F.xxhash64("node"), "tn").alias("t"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("qn") - 1)).alias("q"))
    return asked.unionByName(others).groupBy("bucket", "q", "t").applyInArrow(run, "a long, b long")


def components(edges: DataFrame, label: str = "parts") -> DataFrame:
    """(node, part) of the graph's nodes: part is the smallest node reachable. Alternating large and small stars."""
    spark = edges.sparkSession
    now = stored(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct(), label)
    while True:
        # done when every node that points somewhere points at one node, which points nowhere
        ends = now.select(F.explode(F.array(F.struct(F.col("u").alias("x"), F.lit(1).alias("out"), F.lit(0).alias("into")), F.struct(F.col("v").alias("x"), F.lit(0).alias("out"), F.lit(1).alias("into")))).alias("e")).select("e.*")
        open_ = ends.groupBy("x").agg(F.sum("out").alias("out"), F.max("into").alias("into")).where("out > 1 or (out > 0 and into > 0)")
        if open_.isEmpty():
            break
        since = mark() - 1
        both = now.select("u", "v").unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        large = stored(large, label)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").where("u > v").distinct()
        now = stored(small, label)
        dropped(spark, since, keep=1)
    roots = now.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("part"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("part")).unionByName(roots)


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable), kept (the component's first document), links (confirmed links of its class that the search for components made use of; members of a component are not all compared, so other near copies may be more)."""
    spark = docs.sparkSession
    since = mark()
    own = stored(sketches(docs, k, id_col, text_col), "sketches")
    texts_of = own.where("doc_id is not null and set_key is not null").groupBy("doc_id").agg(F.min("set_key").alias("low"), F.max("set_key").alias("high"))
    if not texts_of.where("low <> high").isEmpty():
        out = stored(_by_rows(docs, k, percent, id_col, text_col), "near")
        dropped(spark, since, keep=1)
        return out
    # a class of equal sets is named by its smallest id, which stands for its text as well
    classes = own.where("set_key is not null").groupBy("set_key").agg(F.min("doc_id").alias("node"), F.first("n_shingles").alias("n"), F.first("regs").alias("regs")).where("node is not null")
    classes = stored(classes, "classes")
    buckets = classes.select("node", "regs").mapInArrow(_banded, "bucket long, node long")
    shared = buckets.groupBy("bucket").agg(F.min("node").alias("lead"), F.max("node").alias("other")).where("lead < other")
    multi = stored(buckets.join(shared, "bucket"), "buckets")
    texts = docs.select(F.col(id_col).cast("long").alias("node"), F.col(text_col).cast("string").alias("text")).where("node is not null")
    texts = texts.join(multi.select("node").distinct(), "node", "left_semi")
    texts = stored(texts.groupBy("node").agg(F.min("text").alias("text")), "texts")  # one text for each node, should ids repeat

    starred = multi.where("node != lead").select(F.least("node", "lead").alias("a"), F.greatest("node", "lead").alias("b")).distinct()
    links = stored(_confirmed(starred, classes, texts, k, percent), "links")
    first = stored(components(links), "first")
    named = multi.select("bucket", "node").join(first, "node", "left").withColumn("part", F.coalesce("part", "node")).join(classes.select("node", "n"), "node")
    held = named.groupBy("bucket", "part").agg(F.count("*").alias("c"), F.sum("n").alias("m")).groupBy("bucket").agg(F.max_by("part", F.struct("c", "part")).alias("main"), F.max("c").alias("top"), F.sum("c").alias("size"), F.sum("m").alias("mass"))
    open_ = stored(named.drop("n").join(held.where("top < size"), "bucket"), "open")
    if not open_.isEmpty():
        few = open_.where(F.col("size") < BLOCK // 8)
        one, two = (few.select("bucket", F.col("node").alias(x), F.col("part").alias(f"part_{x}")) for x in "ab")
        pairs = one.join(two, "bucket").where("part_a < part_b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        more = _confirmed(pairs, classes, texts, k, percent)
        many = _across(open_.where(F.col("size") >= BLOCK // 8), classes, texts, k, percent)
        more = stored(more.unionByName(many).distinct(), "links")
        links = links.unionByName(more)
        # the first components are stars already; new links join them
        first = components(first.where("node <> part").select(F.col("node").alias("a"), F.col("part").alias("b")).unionByName(more))
    parts = first
    degree = links.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("links"))
    found = classes.select("set_key", "node").join(parts, "node", "left").join(degree, "node", "left")
    found = stored(found.select("set_key", F.coalesce("part", "node").alias("part"), F.coalesce("links", F.lit(0)).alias("links")), "found")
    out = own.select("doc_id", "n_shingles", "set_key").join(found, "set_key", "left")
    out = out.select("doc_id", "n_shingles", F.coalesce("part", "doc_id").alias("component_id"), F.coalesce("links", F.lit(0)).cast("long").alias("links"))
    out = stored(out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull())), "near")
    dropped(spark, since, keep=1)
    return out


def _by_rows(docs: DataFrame, k: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """near_duplicates() where an id may have several texts."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = stored(rows.withColumn("row", F.monotonically_increasing_id()), "rows")
    near = near_duplicates(rows, k, percent, "row", "text").select(F.col("doc_id").alias("row"), "n_shingles", F.col("component_id").alias("part"), "links")
    named = rows.select("row", "doc_id").join(near, "row")
    least = named.groupBy("part").agg(F.min("doc_id").alias("component_id"))
    out = named.join(least, "part").select("doc_id", "n_shingles", "component_id", "links")
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()))


def deduplicated(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, with all their columns: of each group of near copies one row, that with the smallest id
    (one of them, should it be repeated; rows with an id before those without), and all rows without words. Decisions are
    about rows: rows of one id with different texts stay unless they are near copies."""
    ids = docs.select(F.col(id_col).cast("long").alias("id"))
    if ids.groupBy("id").count().where("id is null or count > 1").isEmpty():
        gone = stored(near_duplicates(docs, k, percent, id_col, text_col).where("not kept").select(F.col("doc_id").alias("_gone")), "gone")
        return docs.join(gone, docs[id_col].cast("long") == gone["_gone"], "left_anti")
    number = "_row" + "_" * sum(c.startswith("_row") for c in docs.columns)
    rows = stored(docs.withColumn(number, F.monotonically_increasing_id()), "rows")
    near = near_duplicates(rows, k, percent, number, text_col).select(F.col("doc_id").alias("_of"), F.col("component_id").alias("_part"))
    named = rows.select(F.col(number).alias("_of"), F.col(id_col).cast("long").alias("_id")).join(near, "_of")
    first = named.groupBy("_part").agg(F.min(F.struct(F.col("_id").isNull().alias("late"), "_id", "_of"))["_of"].alias("_of"))
    stay = stored(first, "stay")
    return rows.join(stay, rows[number] == stay["_of"], "left_semi").drop(number)


def oracle_sql(k: int, percent: int, table: str = "documents") -> str:
    """near_duplicates() without links in DuckDB's SQL: every shingle meets every equal one. Ids are distinct."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return f"""WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{upper}', '{lower}'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM {table}),
g AS (SELECT DISTINCT doc_id, CASE WHEN len(ws) < {k} THEN ws ELSE ws[i : i + {k - 1}] END AS g FROM (SELECT *, unnest(generate_series(1, greatest(len(ws) - {k - 1}, 1))) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n, md5(string_agg(array_to_string(g, ' '), chr(10) ORDER BY g)) AS key FROM g GROUP BY 1), c AS (SELECT key, min(doc_id) AS node, any_value(n) AS n FROM n GROUP BY 1),
s AS (SELECT node, c.n, g FROM c JOIN g ON g.doc_id = c.node),
l AS (SELECT a.node AS a, b.node AS b FROM s a JOIN s b ON a.g = b.g AND a.node < b.node GROUP BY a.node, b.node, a.n, b.n HAVING 100 * count(*) >= {percent} * (a.n + b.n - count(*))),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l), r(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
p AS (SELECT node, least(node, coalesce((SELECT min(b) FROM r WHERE r.a = node), node)) AS part FROM c)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(p.part, w.doc_id) AS component_id, w.doc_id = coalesce(p.part, w.doc_id) AS kept FROM w LEFT JOIN n USING (doc_id) LEFT JOIN c USING (key) LEFT JOIN p USING (node)"""
