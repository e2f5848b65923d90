"""Documents for readers: the statistics as one JSON text, the page around it, and the audit of older pages.

What is collected is bounded before: rows per list by CAPS, members per scope by `members`.
"""

from __future__ import annotations

import json
import os
import re
import shutil
import tempfile
from collections.abc import Iterable
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.clean import hits
from .share import leaks

# Longest lists by facet; clouds of single words differ by scope.
CAPS = {"phrases_user": 80, "phrases_assistant": 80, "tools": 60, "commands": 60, "extensions": 40, "errors": 40, "distinctive_user": 120, "distinctive_assistant": 120}
CLOUD = {"global": 300, "tool": 300, "project": 150, "month": 150}
SCHEMA = 1
MARKER = "redaction-schema"
HEAD_BYTES = 8192
SECTIONS = ["schema_version", "generated_at", "source_events", "coverage", "totals", "clouds", "trends", "spend", "wrapped", "activity"]


def shortlist(facets: DataFrame) -> DataFrame:
    """The highest counts of each list, ties by term."""
    caps = F.create_map(*[F.lit(x) for kv in CAPS.items() for x in kv])
    cloud = F.create_map(*[F.lit(x) for kv in CLOUD.items() for x in kv])
    rank = F.row_number().over(Window.partitionBy("scope", "member", "facet").orderBy(F.desc("n"), "t"))
    return facets.withColumn("rank", rank).where(F.col("rank") <= F.coalesce(F.try_element_at(caps, F.col("facet")), F.try_element_at(cloud, F.col("scope")), F.lit(150)))


def clouds(facets: DataFrame, members: int = 60) -> dict[str, Any]:
    """Lists of {t, n} by scope, member and facet; of each scope the members with the most counted."""
    size = facets.groupBy("scope", "member").agg(F.sum("n").alias("size"))
    place = F.row_number().over(Window.partitionBy("scope").orderBy(F.desc("size"), "member"))
    chosen = size.withColumn("place", place).where(F.col("place") <= members).select("scope", "member")
    found: dict[str, Any] = {"global": {}, "by_tool": {}, "by_project": {}, "by_month": {}}
    rows = shortlist(facets.join(chosen, ["scope", "member"], "left_semi")).collect()
    for r in sorted(rows, key=lambda r: (r.scope, r.member or "", r.facet, r.rank)):
        into = found["global"] if r.scope == "global" else found[f"by_{r.scope}"].setdefault(r.member, {})
        into.setdefault(r.facet, []).append({"t": r.t, "n": r.n})
    return found


def statistics(**sections: Any) -> dict[str, Any]:
    """The document in its order of sections; missing ones are empty, unknown ones an error."""
    if unknown := sorted(set(sections) - set(SECTIONS)):
        raise ValueError(f"not sections: {', '.join(unknown)}")
    return {s: SCHEMA if s == "schema_version" and s not in sections else sections.get(s, {}) for s in SECTIONS}


def write_json(document: Any, path: str, mode: int = 0o644) -> None:
    """Compact JSON on the driver's disk. The file appears whole, with its mode from the start, or not at all."""
    target = Path(path)
    handle, name = tempfile.mkstemp(dir=target.parent, prefix=f".{target.name}.")  # 0600
    try:
        with os.fdopen(handle, "w", encoding="utf-8") as out:
            json.dump(document, out, ensure_ascii=False, separators=(",", ":"))
        os.chmod(name, mode)
        os.replace(name, target)
    except BaseException:
        os.unlink(name)
        raise


def write_sidecar(report: dict[str, Any], path: str) -> str | None:
    """Redaction terms, readable by their owner only. Returns why it could not be written, if so."""
    try:
        write_json(report, path, 0o600)
    except OSError as e:
        return str(e)
    return None


def write_events(events: DataFrame, path: str) -> None:
    """JSON lines in place of an older corpus, which stays until all new rows are written."""
    spark = events.sparkSession
    fresh = f"{path.rstrip('/')}._new"
    events.write.mode("overwrite").json(fresh)
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    source, target = hadoop(fresh), hadoop(path)
    store = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    old = hadoop(f"{path.rstrip('/')}._old")
    store.delete(old, True)
    if store.exists(target) and not store.rename(target, old):
        raise OSError(f"cannot move {path} away")
    if not store.rename(source, target):
        store.rename(old, target)
        raise OSError(f"cannot move {fresh} to {path}")
    store.delete(old, True)


def render(document: Any, template: str, place: str = "__STATS__") -> str:
    """The document inside a page's script block; `<` is escaped as JSON allows, so that no text can end the block."""
    return template.replace(place, json.dumps(document, ensure_ascii=False, separators=(",", ":")).replace("<", "\\u003c"))


def stamped(html: str, version: int = SCHEMA, marker: str = MARKER) -> str:
    """The page with its redaction schema in a comment after doctype and <html>."""
    head = re.match(r"\s*(<!doctype[^>]*>)?\s*(<html[^>]*>)?\s*", html, re.I)
    cut = head.end() if head and (head[1] or head[2]) else len(html) - len(html.lstrip())
    return f"{html[:cut]}<!-- {marker}: {version} -->\n{html[cut:]}"


def schema_of(html: str, marker: str = MARKER) -> int:
    """The schema stamped on a page; 0 without a stamp."""
    found = re.search(rf"<!--\s*{re.escape(marker)}:\s*(\d+)\s*-->", html)
    return int(found[1]) if found else 0


def snapshots(spark: SparkSession, folder: str, current: int = SCHEMA, marker: str = MARKER) -> DataFrame:
    """name, bytes, schema, shareable and stale of each page in a folder; only the head of a page is searched."""
    pages = spark.read.format("binaryFile").option("pathGlobFilter", "*.html").load(folder)
    head = F.decode(F.substring("content", 1, HEAD_BYTES), "ISO-8859-1")
    stamp = F.regexp_extract(head, rf"<!--\s*{re.escape(marker)}:\s*(\d+)\s*-->", 1)
    schema = F.coalesce(stamp.try_cast("int"), F.lit(0))
    name = F.element_at(F.split("path", "/"), -1)
    return pages.select(name.alias("name"), F.col("length").alias("bytes"), schema.alias("schema"), name.endswith("-shareable.html").alias("shareable"), (schema < current).alias("stale"))


# --- vocabulary ------------------------------------------------------------------------------

# Lists of the vocabulary and whether rare terms leave them, from how many terms on, and below which count.
VOCABULARY = {"prose_user": True, "prose_assistant": True, "tools": False, "commands": False}
FLOOR, FLOOR_TERMS = 2, 400


def gated(facets: DataFrame, literals: Iterable[str] = (), accounts: Iterable[str] = (), names: Iterable[str] = ()) -> DataFrame:
    """facet, t, n and verdict (kept, redacted, harvested, rare) of the global terms of the vocabulary's lists. A list of FLOOR_TERMS or more loses terms seen once, if it is one of words."""
    own = facets.where((F.col("scope") == "global") & F.col("facet").isin(list(VOCABULARY))).select("facet", "t", "n")
    floors = own.groupBy("facet").agg((F.count("*") >= FLOOR_TERMS).alias("_long"))  # a row for each list
    cut = F.col("_long") & F.col("facet").isin([k for k, v in VOCABULARY.items() if v]) & (F.col("n") < FLOOR)
    verdict = F.when(cut, "rare").when(hits(F.col("t"), list(literals)), "redacted").when(leaks(F.col("t"), accounts, names), "harvested").otherwise("kept")
    return own.join(F.broadcast(floors), "facet").select("facet", "t", "n", verdict.alias("verdict"))


def gate_report(terms: DataFrame) -> DataFrame:
    """seen, kept, redacted, harvested and rare: counts alone, since names would be what was taken out."""
    return terms.agg(F.count("*").alias("seen"), *(F.count_if(F.col("verdict") == v).alias(v) for v in ("kept", "redacted", "harvested", "rare")))


def write_vocabulary(terms: DataFrame, path: str) -> None:
    """The kept terms as JSON lines, by list and falling count, written where every executor can: a vocabulary grows with its corpus."""
    terms.where("verdict = 'kept'").select("facet", "t", "n").repartitionByRange("facet", F.desc("n"), "t").sortWithinPartitions("facet", F.desc("n"), "t").write.mode("overwrite").json(path)


def copy_snapshot(page: str, folder: str, stamp: str, label: str = "", statistics_path: str | None = None, shareable: bool = False) -> list[str]:
    """A page copied to <folder>/lexicon-<stamp>[-label][-shareable].html, with its statistics beside it unless it is the shareable one, which they would undo. Returns what was written."""
    name = "-".join(["lexicon", stamp, *label.strip().split()]) + ("-shareable" if shareable else "")
    target = Path(folder)
    target.mkdir(parents=True, exist_ok=True)
    saved = [str(target / f"{name}.html")]
    shutil.copy2(page, saved[0])
    if not shareable and statistics_path and Path(statistics_path).is_file():
        saved.append(str(target / f"{name}.stats.json"))
        shutil.copy2(statistics_path, saved[1])
    return saved
