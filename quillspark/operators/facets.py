"""Facets of the event relation: words, phrases, tools, commands, file types and errors of the whole, of each tool, project and month.

Facets are in long form: scope, member, facet, t, n. A slice is one of four views of the same event, so occurrences are
counted once by tool, project and month together and rolled up by grouping sets; only prompts, whose near-duplicates count
once in each slice, are looked at slice by slice, and of those only the first of each key.

Events need: seq (their order), ts, tool, session_id, project, role, kind, text, tool_name, cmd, tokens, and prose, the text
as its author wrote it (null or empty where there is none), as functions.clean.prose() gives it.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import clean as C
from ..functions import commands as X
from ..functions import tokens as T
from ..functions import when
from .score import log_odds_z, ranked

SCOPES = ("global", "tool", "project", "month")
#: Facets whose terms are words or phrases, and are judged as vocabulary.
SPOKEN = ("prose_user", "prose_user_raw", "prose_assistant", "prose_assistant_raw", "phrases_user", "phrases_assistant")


def sliced(events: DataFrame, zone: str | None = None) -> DataFrame:
    """The events with what slices and days need: tool and project never null, day, hour, month, sid."""
    named = lambda c: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit("unknown"))
    day = when.local_date(F.col("ts"), zone)
    return events.withColumns({"tool": named("tool"), "project": named("project")}).withColumns({
        "day": day, "hour": when.local_hour(F.col("ts"), zone), "month": when.month(day), "sid": F.concat_ws(":", "tool", F.coalesce(F.col("session_id").cast("string"), F.lit("None"))),
    })


def _rolled(counts: DataFrame, *keys: str) -> DataFrame:
    """Counts by tool, project and month and other keys, as counts of each slice: scope, member, other keys, n."""
    slices = ("tool", "project", "month")
    sets = [[*map(F.col, keys)], *([F.col(s), *map(F.col, keys)] for s in slices)]
    out = counts.groupingSets(sets, *map(F.col, (*slices, *keys))).agg(F.sum("n").alias("n"))
    scope = F.coalesce(*(F.when(F.col(s).isNotNull(), s) for s in slices), F.lit("global"))
    return out.select(scope.alias("scope"), F.coalesce(*slices, F.lit("all")).alias("member"), *keys, "n")


def _prompts(events: DataFrame) -> DataFrame:
    """Prompts with prose: with their near-duplicate key (of the whole text) and whether a word of theirs is vocabulary."""
    own = events.where((F.col("role") == "user") & (F.col("kind") == "prompt") & (F.col("prose") != ""))
    return own.withColumns({"key": T.shingle_key(F.coalesce("text", F.lit(""))), "worded": F.exists(T.raw_tokens(F.col("prose")), T.keeps)})


def _replies(events: DataFrame) -> DataFrame:
    own = events.where((F.col("role") == "assistant") & (F.col("kind") == "reply") & (F.col("prose") != ""))
    return own.withColumn("worded", F.exists(T.raw_tokens(F.col("prose")), T.keeps)).where("worded")


def counted_prompts(prompts: DataFrame) -> DataFrame:
    """scope, member, seq: the prompts that count in each slice, the first of each key and all without one."""
    keyed = prompts.where("key <> ''")
    sets = [[F.col("key")], *([F.col("key"), F.col(s)] for s in SCOPES[1:])]
    first = keyed.groupingSets(sets, F.col("key"), *map(F.col, SCOPES[1:])).agg(F.min("seq").alias("seq"))
    scope = F.coalesce(*(F.when(F.col(s).isNotNull(), s) for s in SCOPES[1:]), F.lit("global"))
    first = first.select(scope.alias("scope"), F.coalesce(*SCOPES[1:], F.lit("all")).alias("member"), "seq")
    views = F.array(F.struct(F.lit("global").alias("scope"), F.lit("all").alias("member")), *(F.struct(F.lit(s).alias("scope"), F.col(s).alias("member")) for s in SCOPES[1:]))
    loose = prompts.where("key = ''").select(F.explode(views).alias("v"), "seq").select("v.scope", "v.member", "seq")
    return first.unionByName(loose)


def spoken(events: DataFrame) -> DataFrame:
    """scope, member, facet, t, n of words and phrases. Events come from sliced()."""
    prompts, replies = _prompts(events).where("worded"), _replies(events)
    of = lambda facet, t: F.transform(t, lambda x: F.struct(F.lit(facet).alias("facet"), x.alias("t")))
    terms = T.words_and_pairs(F.col("prose"))
    both = lambda user: F.transform(F.array_distinct(terms), lambda x: F.struct(F.when(T.is_pair(x), f"phrases_{user}").otherwise(f"prose_{user}").alias("facet"), x.alias("t")))
    raw = lambda df, facets: df.select("tool", "project", "month", F.explode(facets).alias("f")).select("tool", "project", "month", "f.facet", "f.t")
    open_ = raw(prompts, of("prose_user_raw", T.raw_tokens(F.col("prose")))).unionByName(raw(replies, F.concat(both("assistant"), of("prose_assistant_raw", T.raw_tokens(F.col("prose"))))))
    whole = _rolled(open_.groupBy("tool", "project", "month", "facet", "t").agg(F.count("*").alias("n")), "facet", "t")
    own = counted_prompts(prompts).join(prompts.select("seq", "prose"), "seq").select("scope", "member", F.explode(both("user")).alias("f"))
    once = own.groupBy("scope", "member", "f.facet", "f.t").agg(F.count("*").alias("n"))
    word = lambda k: F.split_part("t", F.lit(" "), F.lit(k))
    good = F.when(F.col("facet").startswith("phrases"), T.keeps(word(1)) & T.keeps(word(2))).otherwise(T.keeps(F.col("t")))
    return whole.unionByName(once).where(F.when(F.col("n") > 0, good))  # judged once a term and slice: see tokens.judged()


def done(events: DataFrame, literals: Iterable[str] = ()) -> DataFrame:
    """scope, member, facet, t, n of tools, commands, extensions and errors. Terms that hold a literal do not count; in errors it is masked."""
    own = list(literals)
    safe = lambda c: F.when(~C.hits(c, own), c) if own else c
    head = safe(X.argv_head(F.col("cmd")))
    sub = F.when(head.isNotNull(), safe(X.subcommand(F.col("cmd"))))
    masked = C.redact(C.error_signature(F.coalesce("text", F.lit(""))), own, "REDACTED") if own else C.error_signature(F.coalesce("text", F.lit("")))
    fact = lambda facet, t: F.struct(F.lit(facet).alias("facet"), t.alias("t"))
    calls = F.array(fact("tools", F.coalesce(F.nullif("tool_name", F.lit("")), F.lit("unknown"))), fact("commands", head), fact("commands", sub), fact("extensions", safe(X.file_extension(F.coalesce("text", F.lit(""))))))
    facts = F.when(F.col("kind") == "tool_call", calls).otherwise(F.array(fact("errors", F.nullif(F.trim(F.regexp_replace(masked, r"\s+", " ")), F.lit("")))))
    rows = events.where(F.col("kind").isin("tool_call", "error")).select("tool", "project", "month", F.explode(facts).alias("f"))
    rows = rows.select("tool", "project", "month", "f.facet", "f.t").where("t is not null")
    return _rolled(rows.groupBy("tool", "project", "month", "facet", "t").agg(F.count("*").alias("n")), "facet", "t")


def facet_terms(events: DataFrame, zone: str | None = None, literals: Iterable[str] = ()) -> DataFrame:
    """All facets of all slices."""
    own = sliced(events, zone)
    return spoken(own).unionByName(done(own, literals))


def facet_counts(events: DataFrame, zone: str | None = None) -> DataFrame:
    """scope, member, events, sessions, llm_tokens, prompts, words of each slice. Prompts are those with a word of vocabulary, words all of these in prompts and replies."""
    own = sliced(events, zone)
    slices = SCOPES[1:]
    sets = [[], *([F.col(s)] for s in slices)]
    has = lambda kind, role: (F.col("kind") == kind) & (F.col("role") == role) & (F.col("prose") != "")
    n = F.when(has("prompt", "user") | has("reply", "assistant"), F.size(T.tokens(F.col("prose")))).otherwise(0)
    own = own.withColumns({"words": n.cast("long"), "llm": F.when(F.col("tokens") > 0, F.col("tokens")).otherwise(0).cast("long")})
    # first by slice and session, so that distinct sessions need no expansion of their own
    base = own.groupBy(*slices, "sid").agg(F.count("*").alias("events"), F.sum("llm").alias("llm_tokens"), F.count_if(has("prompt", "user") & (F.col("words") > 0)).alias("prompts"), F.sum("words").alias("words"))
    out = base.groupingSets(sets, *map(F.col, slices)).agg(F.sum("events").alias("events"), F.count_distinct("sid").alias("sessions"), *(F.sum(c).alias(c) for c in ("llm_tokens", "prompts", "words")))
    scope = F.coalesce(*(F.when(F.col(s).isNotNull(), s) for s in slices), F.lit("global"))
    return out.select(scope.alias("scope"), F.coalesce(*slices, F.lit("all")).alias("member"), "events", "sessions", "llm_tokens", "prompts", "words")


def distinctive(facets: DataFrame, facet: str, n: int = 120, min_count: int = 3, alpha: float = 0.01) -> DataFrame:
    """scope, member, t, n, z of the terms that set a slice apart from the whole, by log-odds against the global counts with a Dirichlet prior."""
    own = facets.where(F.col("facet") == facet).select("scope", "member", F.col("t").alias("term"), "n")
    background = own.where("scope = 'global'").select("term", F.col("n").alias("bg"))
    whole = background.agg(F.sum("bg").alias("all"), F.count("*").alias("v"))
    sizes = own.groupBy("scope", "member").agg(F.sum("n").alias("nt"))
    x = own.where((F.col("scope") != "global") & (F.col("n") >= min_count)).join(background, "term").join(F.broadcast(sizes), ["scope", "member"]).crossJoin(F.broadcast(whole))
    z = log_odds_z(*(F.col(c) for c in ("n", "nt", "bg", "all", "v")), alpha)
    return ranked(x.select("scope", "member", "term", "n", z.alias("z")).where("z is not null"), ["scope", "member"], [F.desc("z"), F.desc("n"), F.asc("term")], n).withColumnRenamed("term", "t")


def phrases_of(facets: DataFrame, side: str, n: int = 80, min_count: int = 4, min_pmi: float = 2.0) -> DataFrame:
    """scope, member, t, n, pmi of each slice's phrases whose words meet more often than apart. side: user or assistant."""
    key = ["scope", "member"]
    pairs = facets.where(F.col("facet") == f"phrases_{side}").select(*key, "t", "n", F.split_part("t", F.lit(" "), F.lit(1)).alias("a"), F.split_part("t", F.lit(" "), F.lit(2)).alias("b"))
    words = facets.where(F.col("facet") == f"prose_{side}").select(*key, F.col("t").alias("w"), F.col("n").alias("c"))
    totals = pairs.groupBy(*key).agg(F.sum("n").alias("tp")).join(words.groupBy(*key).agg(F.sum("c").alias("tw")), key)
    x = pairs.where(F.col("n") >= min_count)
    for side_ in "ab":
        x = x.join(words.select(*key, F.col("w").alias(side_), F.col("c").alias(f"c{side_}")), [*key, side_])
    x = x.join(F.broadcast(totals), key)  # a row for each slice
    pmi = F.log2((F.col("n") / F.col("tp")) / ((F.col("ca") / F.col("tw")) * (F.col("cb") / F.col("tw"))))
    x = x.where(pmi >= min_pmi).withColumn("pmi", F.round(pmi, 2))
    return ranked(x.select(*key, "t", "n", "pmi"), key, [(F.col("n") * F.col("pmi")).desc(), F.asc("t")], n)


def monthly_words(events: DataFrame, zone: str | None = None) -> DataFrame:
    """month, term, n: every occurrence of vocabulary in prompts, by month."""
    own = _prompts(sliced(events, zone)).select("month", F.explode(T.raw_tokens(F.col("prose"))).alias("term"))
    return T.judged(own.groupBy("month", "term").agg(F.count("*").alias("n")))


def coverage(events: DataFrame, zone: str | None = None) -> tuple[DataFrame, DataFrame]:
    """tool, first, last, events, sessions, heuristic; and tool, month, n. Events without a time are in no month."""
    own = sliced(events, zone)
    tools = own.groupBy("tool").agg(F.min(F.nullif("ts", F.lit(""))).alias("first"), F.max(F.nullif("ts", F.lit(""))).alias("last"), F.count("*").alias("events"), F.count_distinct("sid").alias("sessions"), F.count_if(F.col("confidence") == "heuristic").alias("heuristic"))
    return tools, own.where(F.nullif("ts", F.lit("")).isNotNull()).groupBy("tool", "month").agg(F.count("*").alias("n"))


