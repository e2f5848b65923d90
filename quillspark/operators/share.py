"""Facet rows made fit to share: what was read off the machine goes, what was typed stays.

Facets are in long form: scope (global, tool, project, month), member, facet, t, n.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Texts and patterns of the shared document.
NOTICE = "omitted in share mode"
BANNER = "scrubbed for sharing"
DROPPED_FACETS = ["commands", "errors"]
MEANS_MACHINE = r"(?U)\w\.\w|[\\/@]|https?:"
SERVER_TOOL = r"(?i)^mcp__(.+?)__(.+)$"
BLANK = " \t\n\r\x0b\x0c"

KEY = ["scope", "member", "facet"]


def without_server(term: Column) -> Column:
    """mcp__server__tool becomes mcp:tool; other terms stay as they are."""
    own = F.btrim(term, F.lit(BLANK))
    return F.when(own.rlike(SERVER_TOOL), F.regexp_replace(own, SERVER_TOOL, "mcp:$2")).otherwise(term)


def name_pattern(names: Iterable[str]) -> str | None:
    """A pattern for whole names, as written and with runs of other signs read as one space. None without names."""
    forms: set[str] = set()
    for name in names:
        low = (name or "").strip().lower()
        forms |= {low, re.sub(r"[^a-z0-9]+", " ", low).strip()}
    found = sorted((re.escape(f) for f in forms if len(f) >= 2), key=lambda f: (-len(f), f))
    return f"(?<![a-z0-9])(?:{'|'.join(found)})(?![a-z0-9])" if found else None


def leaks(term: Column, accounts: Iterable[str] = (), names: Iterable[str] = ()) -> Column:
    """Whether a term shows a file, host, path or handle, holds an account of three or more letters, or is or holds a name.
    Null and blank terms do not."""
    low = F.lower(F.btrim(term, F.lit(BLANK)))
    held = low.rlike(MEANS_MACHINE)
    own = sorted(re.escape(a.strip().lower()) for a in accounts if a and len(a.strip()) >= 3)
    if own:
        held = held | low.rlike("|".join(own))
    if pattern := name_pattern(names):
        held = held | low.rlike(pattern)
    return F.coalesce(held, F.lit(False))


def leaks_text(term: object, accounts: Iterable[str] = (), names: Iterable[str] = ()) -> bool:
    """leaks() of one value on the driver; what is no text does not leak."""
    low = term.strip(BLANK).lower() if isinstance(term, str) else ""
    own = [a.strip().lower() for a in accounts if a and len(a.strip()) >= 3]
    pattern = name_pattern(names)
    return bool(low) and bool(re.search(MEANS_MACHINE.removeprefix("(?U)"), low) or any(a in low for a in own) or pattern and re.search(pattern, low))


def names_of(document: dict) -> list[str]:
    """Every project that a statistics document names: of its clouds and of its list of projects."""
    listed = (r.get("t") for r in (document.get("activity") or {}).get("top_projects") or [] if isinstance(r, dict))
    return sorted({n for n in [*((document.get("clouds") or {}).get("by_project") or {}), *listed] if isinstance(n, str)})


def shared(document: dict, accounts: Iterable[str] = ()) -> tuple[dict, dict[str, int]]:
    """A statistics document fit to share, and how many terms and lists left it: clouds as scrubbed() makes them, trends and the
    year's words without what leaks, projects and sessions by number, a note where estimates and times are."""
    out = json.loads(json.dumps(document))
    accounts, names = list(accounts), names_of(document)
    report = {"terms_dropped": 0, "facets_dropped": 0}

    def fit(items: list, of=lambda d: d.get("t") if isinstance(d, dict) else d[0] if isinstance(d, list) and d else d) -> list:
        kept = [d for d in items if not leaks_text(of(d), accounts, names)]
        report["terms_dropped"] += len(items) - len(kept)
        return kept

    clouds = out.get("clouds") or {}
    for bucket in [clouds.get("global") or {}, *(b for g in ("by_tool", "by_month") for b in (clouds.get(g) or {}).values())]:
        for facet, items in bucket.items():
            if facet in DROPPED_FACETS:
                bucket[facet], report["facets_dropped"] = [{"t": NOTICE, "n": 0}], report["facets_dropped"] + 1
            elif isinstance(items, list):
                merged: dict[str, dict] = {}
                for d in fit([{**d, "t": re.sub(SERVER_TOOL, r"mcp:\2", d["t"].strip())} if re.match(SERVER_TOOL, str(d.get("t")).strip()) else d for d in items if isinstance(d, dict)]):
                    held = merged.setdefault(d["t"], {**d, "n": 0})
                    held["n"] += d.get("n") or 0
                bucket[facet] = sorted(merged.values(), key=lambda d: -d["n"])
    if "by_project" in clouds:
        clouds["by_project"], report["facets_dropped"] = {}, report["facets_dropped"] + 1
    for part, keys in (("trends", ("rising", "fading")), ("wrapped", ("top_words",))):
        for key in keys:
            if isinstance((out.get(part) or {}).get(key), list):
                out[part][key] = fit(out[part][key])
    for key in ("top_phrase", "rising_word"):
        if key in (out.get("wrapped") or {}) and leaks_text(out["wrapped"][key], accounts, names):
            del out["wrapped"][key]
            report["terms_dropped"] += 1
    for key, label in (("top_projects", "project"), ("session_lengths", "session")):
        rows = (out.get("activity") or {}).get(key)
        if isinstance(rows, list):
            out["activity"][key] = [{**r, "t": f"{label} {i:02d}"} for i, r in enumerate(rows, 1)]
            report["facets_dropped"] += 1
    out["share_mode"] = True
    out["generated_at"] = " · ".join(filter(None, [out.get("generated_at"), BANNER]))
    if isinstance(out.get("spend"), dict):
        out["spend"]["estimates_note"] = " · ".join(filter(None, [out["spend"].get("estimates_note"), BANNER]))
    return out, report


def scrubbed(facets: DataFrame, accounts: Iterable[str] = (), names: Iterable[str] = ()) -> DataFrame:
    """Facet rows without projects, commands and errors (a notice stands for these lists), servers and leaking terms.
    Terms that become equal are added up. Accounts and names become one pattern: they are as few as a document's own lists."""
    rows = facets.where("scope <> 'project'")
    dropped = F.col("facet").isin(DROPPED_FACETS)
    notice = rows.where(dropped).select(*KEY).distinct().select(*KEY, F.lit(NOTICE).alias("t"), F.lit(0).cast("long").alias("n"))
    # judged inside the aggregation: as a filter below it, the patterns would be tried on every occurrence instead of every term
    kept = rows.where(~dropped).withColumn("t", without_server(F.col("t"))).groupBy(*KEY, "t").agg(F.sum("n").alias("n"), F.any_value(leaks(F.col("t"), accounts, names)).alias("leaks"))
    return kept.where("not leaks").drop("leaks").unionByName(notice)


def anonymous(rows: DataFrame, name: str, label: str, *order: Column | str, most: int = 40) -> DataFrame:
    """The first rows in an order, their names replaced by `label 01`, `label 02`, ..."""
    first = rows.orderBy(*order).limit(most)
    place = F.row_number().over(Window.orderBy(*order))  # over at most `most` rows
    return first.withColumn(name, F.format_string(f"{label} %02d", place))
