"""Merkle fixity audit of archive replicas, and a reader of WARC files.

Each record is hashed; an archive's records lie in order of their offset, and ranges of FAN offsets, then of FAN such
ranges, and so on, have a hash over their parts' hashes up to one root for each archive. Replicas with equal roots are
equal, and the audit ends there. Otherwise it goes down from the roots through mismatching branches only, and ends at the
records that are changed, missing or added; of a level, which is stored in order, only the open branches are read.

A record's leaf is an order-free sum over its rows (a count and two sums of hashes), so a repeated offset makes no group to
collect; a node's parts are FAN at most.

warc_records() reads WARC files, compressed or not, through Spark's reader of texts: records are told apart by the line
that begins them and put together again by their Content-Length, one at a time, so that a task holds one record and
uncompressed files are split among tasks. A record's offset is its place in the uncompressed file.

Defined cases. A null field differs from an empty one; a null archive is one of its own. Negative offsets, and all rows
without an offset as one record (record_id null), are a branch of their own, outside the ranges. Two empty replicas are
equal. Repeated rows count: a replica with one more has a changed record. Other columns are not looked at. A WARC file
without a record gives no rows; a record without a header that can be read, or shorter than it says, has null for what is
not known, and its digest does not fit.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import dropped, mark, stored

FAN = 256
OPEN = 1000  # open branches that are named in a scan's filter; more are joined alone
KEY = ["archive", "node"]


# --- trees -----------------------------------------------------------------------------------


def leaves(records: DataFrame, offset: str, fields: list[str], archive: str | None = None) -> DataFrame:
    """archive, node (the offset) and hash of each record."""
    parts = [F.coalesce(F.concat(F.lit("="), F.col(f).cast("string")), F.lit("null")) for f in fields]
    digest = F.sha2(F.to_json(F.array(*parts)), 256)
    name = F.coalesce(F.concat(F.lit("="), F.col(archive).cast("string")), F.lit("")) if archive else F.lit("")
    rows = records.select(name.alias("archive"), F.col(offset).cast("long").alias("node"), digest.alias("d"))
    wide = lambda seed: F.sum(F.xxhash64(F.lit(seed), "d").cast("decimal(38,0)")).cast("string")
    sums = rows.groupBy(*KEY).agg(F.count("*").alias("n"), wide(1).alias("a"), wide(2).alias("b"), F.min("d").alias("d"))
    return sums.select(*KEY, F.sha2(F.concat_ws(" ", F.col("n").cast("string"), "a", "b", "d"), 256).alias("hash"))


def above(level: DataFrame) -> DataFrame:
    """The next level: a node for each range of FAN nodes."""
    parts = F.array_sort(F.collect_list(F.struct("node", "hash")))
    up = level.groupBy("archive", F.floor(F.col("node") / FAN).cast("long").alias("up")).agg(parts.alias("p"))
    return up.select("archive", F.col("up").alias("node"), F.sha2(F.to_json("p"), 256).alias("hash"))


def _ordered(level: DataFrame) -> DataFrame:
    """A level, stored in order of its nodes, so that a filter on branches skips what lies outside."""
    return stored(level.withColumn("up", F.floor(F.col("node") / FAN).cast("long")).repartitionByRange("archive", "node").sortWithinPartitions("archive", "node"), "level")


def trees(one: DataFrame, two: DataFrame, offset: str, fields: list[str], archive: str | None = None) -> list[tuple[DataFrame, DataFrame]]:
    """Levels of both replicas, from records (those outside the ranges too) up to one root an archive."""
    a, b = (_ordered(leaves(x, offset, fields, archive)) for x in (one, two))
    levels, most = [(a, b)], max(x.agg(F.max("node")).first()[0] or 0 for x in (a, b))
    a, b = (x.where("node >= 0") for x in (a, b))
    while most > 0:
        a, b = _ordered(above(a)), _ordered(above(b))
        levels.append((a, b))
        most //= FAN
    return levels


def _differing(a: DataFrame, b: DataFrame) -> DataFrame:
    """archive, node, ha and hb where two levels differ. Each node is in a level once."""
    a, b = (x.select(*KEY, F.col("hash").alias(h)) for x, h in ((a, "ha"), (b, "hb")))
    both = a.unionByName(b, allowMissingColumns=True).groupBy(*KEY).agg(F.max("ha").alias("ha"), F.max("hb").alias("hb"))
    return both.where("not (ha <=> hb)")


def audit(one: DataFrame, two: DataFrame, offset: str, fields: list[str], archive: str | None = None) -> DataFrame:
    """record_id and fault (changed, missing in the second replica, added to it) of every record that differs; with archive, a column that names the file of a record, that too."""
    spark = one.sparkSession
    since = mark()
    levels = trees(one, two, offset, fields, archive)
    outside = _differing(*(x.where("node is null or node < 0") for x in levels[0]))
    found: DataFrame | None = None
    for a, b in reversed(levels):
        a, b = (x.where("node >= 0") for x in (a, b))
        if found is not None:
            open_ = found.select("archive", F.col("node").alias("up"))
            few = open_.limit(OPEN + 1).collect()
            if not few:  # equal below here
                break
            if len(few) <= OPEN:
                names = sorted({r["up"] for r in few})
                a, b = (x.where(F.col("up").between(names[0], names[-1]) & F.col("up").isin(names)) for x in (a, b))
            a, b = (x.join(open_, ["archive", "up"], "left_semi") for x in (a, b))
        found = stored(_differing(a, b), "differ")
    found = found.unionByName(outside)
    fault = F.when(F.col("hb").isNull(), "missing").when(F.col("ha").isNull(), "added").otherwise("changed")
    named = [F.when(F.col("archive") != "", F.substring("archive", 2, 1 << 30)).alias(archive)] if archive else []
    out = stored(found.select(*named, F.col("node").alias("record_id"), fault.alias("fault")), "faults")
    dropped(spark, since, keep=1)
    return out


# --- WARC files ------------------------------------------------------------------------------

_BREAK = b"\r\n\r\nWARC/"
_HEAD = re.compile(rb"\d\.\d\r\n((?:[^\r\n]+\r\n)*)")
_FIELD = re.compile(rb"([^:\r\n]+):[ \t]*([^\r\n]*)\r\n")
RECORD = "archive string, part long, at long, size long, warc_type string, warc_id string, uri string, length long, digest string, digest_fits boolean, sha256 string"


def _record(raw: bytes) -> tuple:
    """type, id, uri, declared length and block digest of a record without its first five bytes, whether the digest fits, and the hash of the whole record."""
    head = _HEAD.match(raw)
    fields = {k.strip().lower(): v.strip().decode("utf-8", "replace") for k, v in _FIELD.findall(head[1])} if head else {}
    length = int(fields[b"content-length"]) if fields.get(b"content-length", "").isdigit() else None
    block = raw[head.end() + 2 : head.end() + 2 + length] if head and length is not None else None
    digest = fields.get(b"warc-block-digest")
    fits = None
    if digest and block is not None:
        name, _, value = digest.partition(":")
        if name.lower() in ("sha1", "sha256", "md5"):
            own = hashlib.new(name.lower(), block)
            fits = len(block) == length and value.lower() in (own.hexdigest(), base64.b32encode(own.digest()).decode().lower())
    elif length is not None and len(block) < length or head is None:
        fits = False
    return fields.get(b"warc-type"), fields.get(b"warc-record-id"), fields.get(b"warc-target-uri"), length, digest, fits, hashlib.sha256(b"WARC/" + (raw if block is None else raw[: head.end() + 2 + length])).hexdigest()


def _missing(raw: list[bytes]) -> bool:
    """Whether pieces are less of a record than it says itself."""
    head = _HEAD.match(raw[0])
    if not head:
        return False
    found = re.search(rb"(?i)(?:^|\n)content-length:[ \t]*(\d+)", head[1])
    return bool(found) and sum(map(len, raw)) + len(_BREAK) * (len(raw) - 1) < head.end() + 2 + int(found[1])


def warc_records(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """archive (the file), offset, warc_type, warc_id, uri, length, digest (as declared), digest_fits (null without one), sha256 of every record of WARC files."""
    text = spark.read.option("lineSep", _BREAK.decode()).option("recursiveFileLookup", "true").text(paths)
    text = text.select(F.col("_metadata.file_path").alias("archive"), F.col("_metadata.file_block_start").alias("part"), F.col("value").cast("binary").alias("piece"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []
        place, at = (None, 0), 0
        out: list[tuple] = []

        def whole() -> None:
            nonlocal at
            raw = _BREAK.join(held)
            size = len(raw) + len(_BREAK)
            out.append((*place, at, size, *_record(raw)))
            at += size
            held.clear()

        for batch in batches:
            for archive, part, piece in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if (archive, part) != place:
                    if held:
                        whole()
                    place, at = (archive, part), 0
                if held and not _missing(held):
                    whole()
                held.append(piece if held or part else piece.removeprefix(b"WARC/"))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], f.type) for i, f in enumerate(schema)], schema=schema)
                out.clear()
        if held:
            whole()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], f.type) for i, f in enumerate(schema)], schema=schema)

    kinds = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_()}
    schema = pa.schema([(n, kinds[k]) for n, k in (c.split() for c in RECORD.split(", "))])
    found = stored(text.mapInArrow(run, RECORD), "records")  # small rows: hashes instead of contents
    sizes = found.groupBy("archive", "part").agg(F.sum("size").alias("size"))
    before = F.coalesce(F.sum("size").over(Window.partitionBy("archive").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    begins = sizes.select("archive", "part", before.alias("begins"))  # a row for each split of a file
    return found.join(begins, ["archive", "part"]).select("archive", (F.col("begins") + F.col("at")).alias("offset"), "warc_type", "warc_id", "uri", "length", "digest", "digest_fits", "sha256")
