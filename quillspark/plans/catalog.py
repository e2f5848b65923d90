"""The queries of this package over the driver's tables, and the SQL they are checked against.

The event relation is read out of the tables: conversations give prompts and replies, documents prose by tool (lang) and
project (source), events timestamps, usage and models.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import clean as C
from ..functions import tokens as T
from ..functions import words as W
from ..operators import events as E
from ..operators import score as S
from ..operators import share
from .layout import spread

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def _query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    from . import cleaning, log  # noqa: F401  add their own

    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    from . import cleaning, log  # noqa: F401

    return dict(_SQL)


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _texts(spark: SparkSession, d: str, name: str, *columns: str) -> DataFrame:
    """A table whose texts take long to read: spread over all cores if it is small."""
    return spread(_t(spark, d, name).select(*columns))


# --- SQL that several checks share -----------------------------------------------------------


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


_STOP = ", ".join(_q(w) for w in W.STOPWORDS)
_BASE = ", ".join(_q(w) for w in W.BASE_STOP)


def _opaque(t: str) -> str:
    return f"""len(list_filter(regexp_extract_all({t}, '[0-9a-z]+'), lambda r: length(r) >= 10 AND regexp_matches(r, '[a-z]') AND (len(regexp_extract_all(r, '[0-9]+')) >= 3
 OR (length(r) >= 14 AND length(regexp_replace(r, '[^aeiouy]', '', 'g')) < 0.2 * length(regexp_replace(r, '[^a-z]', '', 'g')))))) > 0"""


def _keep(t: str) -> str:
    digits = f"length(regexp_replace({t}, '[^0-9]', '', 'g'))"
    return f"""(length({t}) BETWEEN 3 AND 28 AND {t} NOT IN ({_STOP}) AND NOT regexp_matches({t}, {_q(W.HOST)}) AND NOT regexp_matches({t}, {_q(W.DOTTED)})
 AND (regexp_matches({t}, '[aeiouy]') OR regexp_matches({t}, '[^\\x00-\\x7f]')) AND ({digits} = 0 OR (length({t}) > 3 AND {digits} <= 0.4 * length({t})))
 AND NOT regexp_matches({t}, {_q(W.CREDENTIAL)}) AND NOT ({_opaque(t)}))"""


_KEEP, _OPAQUE = _keep("t"), _opaque("t")


_FOUND = f"regexp_extract_all(nfc_normalize(text), {_q(W.token_re2())})"


def _toks(table: str, columns: str, where: str = "true") -> str:
    return f"SELECT {columns}, t FROM (SELECT {columns}, trim(lower(unnest({_FOUND})), '-.''') AS t FROM {table} WHERE {where})"

_TERMS = f"raw AS ({_toks('documents', 'doc_id, lang')}), kept AS (SELECT * FROM raw WHERE {_KEEP}), df AS (SELECT lang, t AS term, count(DISTINCT doc_id) AS n FROM kept GROUP BY ALL)"


def _terms(spark: SparkSession, d: str) -> DataFrame:
    """Document frequency of kept tokens by language."""
    found = _texts(spark, d, "documents", "lang", "text").select("lang", F.explode(F.array_distinct(T.raw_tokens(F.col("text")))).alias("term")).where("term is not null")
    return T.judged(found.groupBy("lang", "term").agg(F.count("*").alias("n")))


# --- lines ---


def _case_sql(key: str, values) -> str:
    return f"CASE {key} % {len(values)} " + " ".join(f"WHEN {i} THEN {'NULL' if v is None else _q(v)}" for i, v in enumerate(values)) + " END"


_CLASS = f"""CASE WHEN s = '' THEN 'B' WHEN {' OR '.join(f'regexp_matches(s, {_q(p)})' for p in C.STRONG_LINES)} THEN 'S' WHEN regexp_matches(s, {_q(C.FENCE_LINE)}) THEN 'F' WHEN {' OR '.join(f'regexp_matches(s, {_q(p)})' for p in C.GLUE_LINES)} THEN 'G'
 WHEN regexp_matches(s, {_q(C.PAIR_LINE)}) THEN CASE WHEN trim(regexp_extract(s, {_q(C.PAIR_LINE)}, 1)) <> '' AND regexp_matches(trim(regexp_extract(s, {_q(C.PAIR_LINE)}, 1)), {_q(C.SINGLE_VALUE)}) THEN 'g' ELSE 'A' END ELSE 'P' END"""


def line_classes(source: str) -> str:
    """Tables that end in kept (id, i, line): the lines of source (id, text) without structured regions, by windows over neighbours."""
    return f"""l AS (SELECT id, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM (SELECT id, string_split_regex(text, {_q(C.LINES)}) AS ls FROM {source})),
k AS (SELECT id, i, line, {_CLASS} AS c FROM (SELECT *, trim(line, ' ' || chr(9) || chr(13)) AS s FROM l)),
r AS (SELECT *, sum(CASE WHEN c = 'P' THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY i) AS run FROM k),
h AS (SELECT *, max(CASE WHEN c = 'S' THEN 1 ELSE 0 END) OVER w AS sure, min(CASE WHEN c IN ('S', 'F', 'G', 'g') THEN i END) OVER w AS lo, max(CASE WHEN c IN ('S', 'F', 'G', 'g') THEN i END) OVER w AS hi, lag(c) OVER (PARTITION BY id ORDER BY i) AS before FROM r WINDOW w AS (PARTITION BY id, run, c = 'P')),
f AS (SELECT a.id, a.i AS lo, min(b.i) AS hi FROM h a JOIN h b ON a.id = b.id AND b.i > a.i AND b.i <= a.i + 40 WHERE a.c = 'F' AND (a.before IS NULL OR a.before = 'B') AND b.c IN ('F', 'P') GROUP BY ALL),
g AS (SELECT f.id, f.lo, f.hi FROM f JOIN h e ON e.id = f.id AND e.i = f.hi AND e.c = 'F' WHERE f.hi > f.lo + 1 AND EXISTS (SELECT 1 FROM h x WHERE x.id = f.id AND x.i > f.lo AND x.i < f.hi AND x.c IN ('A', 'g'))),
kept AS (SELECT id, i, line FROM h WHERE NOT (c <> 'P' AND sure = 1 AND (c <> 'A' OR (i > lo AND i < hi))) AND NOT EXISTS (SELECT 1 FROM g WHERE g.id = h.id AND h.i BETWEEN g.lo AND g.hi))"""


# --- terms -----------------------------------------------------------------------------------


@_query(f"WITH {_TERMS} SELECT lang, term, n FROM df")
def term_doc_freq(spark, d):
    return _terms(spark, d)


@_query(f"WITH {_TERMS} SELECT lang, term, n, rank FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, term) AS rank FROM df) WHERE rank <= 50")
def top_terms(spark, d):
    return S.top_n(_terms(spark, d), 50, ["lang"]).select("lang", "term", "n", F.col("rank").cast("long").alias("rank"))


@_query(f"WITH {_TERMS} SELECT t AS term, count(*) AS n FROM kept GROUP BY 1")
def term_raw_count(spark, d):
    return T.judged(_texts(spark, d, "documents", "text").select(F.explode(T.raw_tokens(F.col("text"))).alias("term")).groupBy("term").agg(F.count("*").alias("n")))


def _odds_sql(df: str, group: str, n: int, least: int) -> str:
    return f"""bg AS (SELECT term, sum(n) AS bg FROM {df} GROUP BY 1), g AS (SELECT {group}, sum(n) AS nt FROM {df} GROUP BY 1), w AS (SELECT sum(bg) AS tot, count(*) AS v FROM bg),
x AS (SELECT d.{group}, d.term, d.n, 0.01 * greatest(bg, 1) AS aw, 0.01 * greatest(v, 1) AS a0, nt, tot - nt AS nr, bg - d.n AS yr FROM {df} d JOIN bg USING (term) JOIN g USING ({group}) CROSS JOIN w WHERE d.n >= {least}),
y AS (SELECT *, n + aw AS t0, nt + a0 - n - aw AS t1, yr + aw AS r0, nr + a0 - yr - aw AS r1 FROM x),
z AS (SELECT {group}, term, n, round((ln(t0 / t1) - ln(r0 / r1)) / sqrt(1 / t0 + 1 / r0), 3) AS z FROM y WHERE nt > 0 AND nr > 0 AND t1 > 0 AND r0 > 0 AND r1 > 0)
SELECT {group}, term, n, z FROM (SELECT *, row_number() OVER (PARTITION BY {group} ORDER BY z DESC, n DESC, term) AS k FROM z) WHERE k <= {n}"""


@_query(f"WITH {_TERMS}, {_odds_sql('df', 'lang', 100, 3)}")
def log_odds_by_lang(spark, d):
    return S.log_odds(_terms(spark, d), "lang", n=100)


_TALK = "(SELECT conv_id, turn, role, text FROM conversations WHERE role IN ('user', 'assistant'))"
_VOICE = f"raw AS ({_toks(_TALK, 'conv_id, turn, role')}), kept AS (SELECT * FROM raw WHERE {_KEEP}), df AS (SELECT role, t AS term, count(DISTINCT (conv_id, turn)) AS n FROM kept GROUP BY ALL)"


@_query(f"WITH {_VOICE}, {_odds_sql('df', 'role', 40, 3)}")
def voice_words(spark, d):
    talk = _texts(spark, d, "conversations", "conv_id", "turn", "role", "text").where(F.col("role").isin("user", "assistant"))
    df = talk.select("conv_id", "turn", "role", F.explode(F.array_distinct(T.raw_tokens(F.col("text")))).alias("term")).where("term is not null")
    return S.log_odds(T.judged(df.distinct().groupBy("role", "term").agg(F.count("*").alias("n"))), "role", n=40)


_PHRASES = f"""r AS (SELECT doc_id, unnest(regexp_extract_all(nfc_normalize(text), {_q(f'{W.token_re2()}(?:{W.GAP}{W.token_re2()})+')})) AS run FROM documents),
p AS (SELECT doc_id, ws, unnest(generate_series(1, len(ws) - 1)) AS i FROM (SELECT doc_id, list_transform(string_split_regex(run, {_q(W.GAP)}), lambda x: trim(lower(x), '-.''')) AS ws FROM r)),
q AS (SELECT doc_id, ws[i] AS a, ws[i + 1] AS b FROM p),
ph AS (SELECT a || ' ' || b AS term, count(DISTINCT doc_id) AS n FROM q WHERE {_keep('a')} AND {_keep('b')} GROUP BY 1)"""


@_query(f"""WITH {_TERMS}, {_PHRASES}, un AS (SELECT term, sum(n) AS n FROM df GROUP BY 1), tp AS (SELECT sum(n) AS tp FROM ph), tw AS (SELECT sum(n) AS tw FROM un),
s AS (SELECT ph.term, ph.n, log2((ph.n / tp) / ((ua.n / tw) * (ub.n / tw))) AS raw FROM ph JOIN un ua ON ua.term = split_part(ph.term, ' ', 1) JOIN un ub ON ub.term = split_part(ph.term, ' ', 2) CROSS JOIN tp CROSS JOIN tw WHERE ph.n >= 4)
SELECT term, n, round(raw, 2) AS pmi FROM s WHERE raw >= 2 ORDER BY n * round(raw, 2) DESC, term LIMIT 120""")
def pmi_phrases(spark, d):
    text = F.col("text")
    found = _texts(spark, d, "documents", "text").select(F.explode(F.array_distinct(T.words_and_pairs(text))).alias("term")).where("term is not null")
    # words and pairs are counted in one pass; conditions on the count keep both readers above the same exchange
    counts = found.groupBy("term").agg(F.count("*").alias("n"))
    part = lambda k: F.split_part("term", F.lit(" "), F.lit(k))
    pairs = counts.where(F.when(F.col("n") > 0, T.is_pair(F.col("term")))).select(part(1).alias("a"), part(2).alias("b"), "n")
    return S.pmi_pairs(pairs, T.judged(counts.where(F.when(F.col("n") > 0, ~T.is_pair(F.col("term"))))))


_GRAMS = f"""w AS (SELECT conv_id, turn, list_filter(list_transform({_FOUND}, lambda x: trim(lower(x), '-.''')), lambda x: x <> '') AS ws FROM conversations WHERE role = 'user'),
g AS (SELECT conv_id, turn, list_slice(ws, i, i + k - 1) AS gram FROM (SELECT *, unnest(generate_series(1, len(ws) - k + 1)) AS i FROM w CROSS JOIN (VALUES (2), (3)) n(k))),
ok AS (SELECT conv_id, turn, array_to_string(gram, ' ') AS term FROM g WHERE gram[1] NOT IN ({_BASE}) AND gram[len(gram)] NOT IN ({_BASE}) AND len(list_filter(gram, lambda x: NOT regexp_matches(x, {_q(W.WORD_LIKE)}))) = 0)"""


def _gram_rows(spark, d):
    users = _texts(spark, d, "conversations", "conv_id", "turn", "role", "text").where("role = 'user'")
    return users.select("conv_id", "turn", F.explode(T.ngrams(F.col("text"))).alias("term"))


@_query(f"WITH {_GRAMS} SELECT term, count(*) AS n FROM ok GROUP BY 1 HAVING count(*) >= 2")
def discourse_ngrams(spark, d):
    return _gram_rows(spark, d).groupBy("term").agg(F.count("*").alias("n")).where("n >= 2")


@_query(f"""WITH {_GRAMS} SELECT term, prompts, projects FROM (SELECT term, count(DISTINCT (conv_id, turn)) AS prompts, count(DISTINCT conv_id % 10) AS projects FROM ok GROUP BY 1)
WHERE prompts >= 3 ORDER BY projects DESC, prompts DESC, term LIMIT 50""")
def signature_phrases(spark, d):
    rows = _gram_rows(spark, d).distinct()  # a prompt counts once, its conversation's last digit stands for the project
    per = rows.groupBy("term").agg(F.count("*").alias("prompts"), F.count_distinct(F.col("conv_id") % 10).alias("projects"))
    return per.where("prompts >= 3").orderBy(F.desc("projects"), F.desc("prompts"), "term").limit(50)


@_query(f"""WITH raw AS ({_toks('(SELECT c.text, e.ts FROM conversations c JOIN events e ON c.conv_id = e.event_id)', 'ts')}), c AS (SELECT date_trunc('hour', ts) AS span, t AS term, count(*) AS n FROM raw WHERE {_KEEP} GROUP BY ALL),
s AS (SELECT span, row_number() OVER (ORDER BY span) AS i, count(*) OVER () AS k FROM (SELECT DISTINCT span FROM c)),
x AS (SELECT term, sum(CASE WHEN i <= k // 2 THEN n ELSE 0 END) AS e, sum(CASE WHEN i > k // 2 THEN n ELSE 0 END) AS l FROM c JOIN s USING (span) WHERE k >= 2 GROUP BY 1),
tot AS (SELECT greatest(sum(e), 1) AS te, greatest(sum(l), 1) AS tl FROM x),
y AS (SELECT term, e + l AS n, round(log2(((l + 0.5) / tl * 1e5) / ((e + 0.5) / te * 1e5)), 3) AS lift FROM x CROSS JOIN tot WHERE e + l >= 8)
SELECT term, n, lift, 'rising' AS direction FROM (SELECT * FROM y ORDER BY lift DESC, n DESC, term LIMIT 40) UNION ALL SELECT term, n, lift, 'fading' FROM (SELECT * FROM y ORDER BY lift, n DESC, term LIMIT 40)""")
def trends(spark, d):
    dated = _t(spark, d, "conversations").join(_t(spark, d, "events").select(F.col("event_id").alias("conv_id"), "ts"), "conv_id")
    c = dated.select(F.date_trunc("hour", "ts").alias("span"), F.explode(T.raw_tokens(F.col("text"))).alias("term")).groupBy("span", "term").agg(F.count("*").alias("n"))
    return S.trends(T.judged(c), "span")


@_query(f"""WITH {_TERMS}, u AS (SELECT term, sum(n) AS n FROM df GROUP BY 1), k AS (SELECT count(*) AS k FROM u)
SELECT term, n FROM u CROSS JOIN k WHERE n >= CASE WHEN k >= 400 THEN 2 ELSE 1 END AND NOT regexp_matches(term, '[./@\\\\]')""")
def vocab_gate(spark, d):
    u = _terms(spark, d).groupBy("term").agg(F.sum("n").alias("n"))
    floor = u.agg(F.when(F.count("*") >= 400, 2).otherwise(1).alias("least"))
    return u.crossJoin(F.broadcast(floor)).where(F.col("n") >= F.col("least")).where(~F.col("term").rlike(r"[./@\\]")).select("term", "n")


@_query(f"WITH raw AS (SELECT DISTINCT t FROM ({_toks('documents', 'doc_id')})) SELECT t AS term, regexp_matches(t, {_q(W.CREDENTIAL)}) AS credential, {_OPAQUE} AS opaque FROM raw WHERE regexp_matches(t, {_q(W.CREDENTIAL)}) OR {_OPAQUE}")
def opaque_tokens(spark, d):
    t = _texts(spark, d, "documents", "text").select(F.explode(T.raw_tokens(F.col("text"))).alias("term")).distinct()
    return t.select("term", F.col("term").rlike(W.CREDENTIAL).alias("credential"), T.opaque(F.col("term")).alias("opaque")).where("credential or opaque")


# --- near-duplicate prompts ------------------------------------------------------------------

_KEYED = f"k AS (SELECT *, array_to_string(list_slice(list_filter(list_transform({_FOUND}, lambda x: trim(lower(x), '-.''')), lambda x: regexp_matches(x, {_q(W.LETTERS)})), 1, 6), ' ') AS key FROM @@)"


@_query(f"WITH {_KEYED.replace('@@', 'documents')} SELECT doc_id, lang FROM (SELECT *, row_number() OVER (PARTITION BY lang, key ORDER BY doc_id) AS r FROM k) WHERE key = '' OR r = 1")
def dedup_first_occurrence(spark, d):
    docs = _texts(spark, d, "documents", "doc_id", "lang", "text").select("doc_id", "lang", T.shingle_key(F.col("text")).alias("key"))
    return E.first_occurrence(docs, "key", ["lang"], "doc_id").select("doc_id", "lang")


@_query(f"""WITH {_KEYED.replace('@@', 'conversations')}, r AS (SELECT *, count(*) OVER (PARTITION BY key) AS n, row_number() OVER (PARTITION BY key ORDER BY length(text) DESC, conv_id, turn, text) AS i FROM k WHERE role = 'user' AND key <> '')
SELECT key, n, text AS representative FROM r WHERE i = 1""")
def cluster_prompts(spark, d):
    """Prompts with one key are one; the longest, and of these the first, stands for them."""
    k = _t(spark, d, "conversations").where("role = 'user'").withColumn("key", T.shingle_key(F.col("text"))).where("key <> ''")
    return k.groupBy("key").agg(F.count("*").alias("n"), F.min_by("text", F.struct(-F.length("text"), "conv_id", "turn", "text")).alias("representative"))


# --- facets and activity ---------------------------------------------------------------------


def _events(spark, d):
    return _t(spark, d, "events").select("event_id", "ts", F.col("user_id").alias("session_id"), F.col("event_type").alias("tool"), "value")


@_query("SELECT event_type AS tool, min(ts) AS first, max(ts) AS last, count(DISTINCT user_id) AS sessions, count(*) AS events FROM events GROUP BY 1")
def coverage_by_tool(spark, d):
    return E.coverage(_events(spark, d))


@_query("""SELECT 'global' AS slice, '' AS value, count(*) AS events, count(DISTINCT doc_id) AS sessions FROM documents UNION ALL SELECT 'lang', coalesce(lang, 'unknown'), count(*), count(DISTINCT doc_id) FROM documents GROUP BY 2
UNION ALL SELECT 'source', coalesce(source, 'unknown'), count(*), count(DISTINCT doc_id) FROM documents GROUP BY 2""")
def slice_counts(spark, d):
    return E.slice_counts(_t(spark, d, "documents").withColumnRenamed("doc_id", "session_id"), "lang", "source")


@_query("SELECT conv_id, count(*) AS events, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END)::BIGINT AS prompts, min(turn) AS first, max(turn) AS last FROM conversations GROUP BY 1 ORDER BY events DESC, conv_id LIMIT 40")
def session_lengths(spark, d):
    s = _t(spark, d, "conversations").groupBy("conv_id").agg(F.count("*").alias("events"), F.count_if(F.col("role") == "user").alias("prompts"), F.min("turn").alias("first"), F.max("turn").alias("last"))
    return s.orderBy(F.desc("events"), "conv_id").limit(40)


@_query("SELECT source AS project, lang AS tool, count(*) AS n FROM documents WHERE source <> 'unknown' GROUP BY ALL")
def project_tool_pivot(spark, d):
    return _t(spark, d, "documents").where("source <> 'unknown'").groupBy(F.col("source").alias("project"), F.col("lang").alias("tool")).agg(F.count("*").alias("n"))


@_query("SELECT source AS project, count(*) AS n FROM documents WHERE source <> 'unknown' GROUP BY 1 ORDER BY n DESC, project LIMIT 24")
def top_projects(spark, d):
    return _t(spark, d, "documents").where("source <> 'unknown'").groupBy(F.col("source").alias("project")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "project").limit(24)


@_query("SELECT count(*) AS events, count(DISTINCT user_id) AS sessions, count(DISTINCT event_type) AS tools FROM events")
def totals(spark, d):
    return _events(spark, d).agg(F.count("*").alias("events"), F.count_distinct("session_id").alias("sessions"), F.count_distinct("tool").alias("tools"))


@_query("SELECT event_type AS tool, n, round(n / sum(n) OVER (), 4) AS share FROM (SELECT event_type, count(*) AS n FROM events GROUP BY 1) QUALIFY row_number() OVER (ORDER BY n DESC, event_type) = 1")
def top_tool(spark, d):
    n = _events(spark, d).groupBy("tool").agg(F.count("*").alias("n"))
    whole = n.agg(F.sum("n").alias("of"))
    return n.crossJoin(F.broadcast(whole)).orderBy(F.desc("n"), "tool").limit(1).select("tool", "n", F.round(F.col("n") / F.col("of"), 4).alias("share"))


@_query("SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1")
def per_day(spark, d):
    return _events(spark, d).groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))


@_query("SELECT h::INTEGER AS hour, coalesce(n, 0) AS n FROM range(24) r(h) LEFT JOIN (SELECT hour(ts) AS k, count(*) AS n FROM events GROUP BY 1) ON k = h")
def hour_histogram(spark, d):
    return E.histogram(spark, _events(spark, d), F.hour("ts"), 0, 23, "hour")


@_query("SELECT h::INTEGER AS weekday, coalesce(n, 0) AS n FROM range(1, 8) r(h) LEFT JOIN (SELECT isodow(ts) AS k, count(*) AS n FROM events GROUP BY 1) ON k = h")
def weekday_histogram(spark, d):
    return E.histogram(spark, _events(spark, d), F.expr("extract(DAYOFWEEK_ISO FROM ts)"), 1, 7, "weekday")


@_query("""WITH h AS (SELECT hour(ts)::INTEGER AS k, count(*) AS n FROM events GROUP BY 1), w AS (SELECT strftime(ts, '%a') AS k, count(*) AS n FROM events GROUP BY 1), b AS (SELECT CAST(ts AS DATE) AS k, count(*) AS n FROM events GROUP BY 1)
SELECT (SELECT k FROM h ORDER BY n DESC, k DESC LIMIT 1) AS peak_hour, (SELECT k FROM w ORDER BY n DESC, k DESC LIMIT 1) AS peak_weekday, (SELECT k FROM b ORDER BY n DESC, k LIMIT 1) AS busiest_day""")
def peaks(spark, d):
    e = _events(spark, d)
    most = lambda k, name: e.groupBy(k.alias("k")).agg(F.count("*").alias("n")).agg(F.max_by("k", F.struct("n", "k")).alias(name))
    day = e.groupBy(F.to_date("ts").alias("k")).agg(F.count("*").alias("n")).agg(F.min_by("k", F.struct(-F.col("n"), "k")).alias("busiest_day"))
    return most(F.hour("ts"), "peak_hour").crossJoin(most(F.date_format("ts", "E"), "peak_weekday")).crossJoin(day)


@_query("SELECT user_id, max(c) AS streak FROM (SELECT user_id, d - r::INTEGER AS isle, count(*) AS c FROM (SELECT user_id, d, row_number() OVER (PARTITION BY user_id ORDER BY d) AS r FROM (SELECT DISTINCT user_id, CAST(ts AS DATE) AS d FROM events)) GROUP BY ALL) GROUP BY 1")
def longest_streak(spark, d):
    return E.longest_streak(_t(spark, d, "events"), "user_id", "ts")


_EMOTION = ", ".join(f"sum(len(regexp_extract_all(text, {_q(p)}))) AS {k}" for k, p in W.EMOTIONS.items())


@_query(f"WITH e AS (SELECT {_EMOTION} FROM conversations WHERE role = 'user' AND len(regexp_split_to_array(trim(text), '\\s+')) <= 200) SELECT family, n::BIGINT AS n FROM e UNPIVOT (n FOR family IN ({', '.join(W.EMOTIONS)}))")
def emotion_counts(spark, d):
    return E.emotions(_t(spark, d, "conversations").where("role = 'user'"))


# --- spend -----------------------------------------------------------------------------------

# Models and usage out of the events: each type of event stands for a model, its value for tokens.
_MODELS = {"error": "claude-opus-5-20260101", "click": "gpt-5.4-mini-2026-01-01", "view": "gemini-2.5-flash-lite", "signup": "llama-9-turbo", "purchase": "claude-haiku-4-5-20251001"}
_USAGE = "u AS (SELECT event_id, ts, CASE WHEN event_type = 'click' THEN 'codex' ELSE 'claude_code' END AS tool, CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _MODELS.items()) + " END AS model, floor(value)::BIGINT AS input, floor(value * 2)::BIGINT AS output, floor(value * 3)::BIGINT AS cache_read, 1::BIGINT AS cache_write FROM events)"
_PRICES = "p(pattern, a, b, c, d, e) AS (VALUES " + ", ".join(f"('{k}', {', '.join(f'{x}::DOUBLE' for x in v)})" for k, v in W.PRICES.items()) + ")"
_COST = f"{_USAGE}, {_PRICES}, m AS (SELECT model, arg_max(pattern, length(pattern)) AS pattern FROM (SELECT DISTINCT model FROM u) JOIN p ON starts_with(model, pattern) GROUP BY 1), x AS (SELECT u.*, (input * a + output * b + cache_read * CASE WHEN tool IN ('codex', 'gemini_cli') THEN e ELSE c END + cache_write * d) / 1e6 AS cost FROM u LEFT JOIN m USING (model) LEFT JOIN p USING (pattern))"
_SUMS = "sum(input)::BIGINT AS input, sum(output)::BIGINT AS output, sum(cache_read)::BIGINT AS cache_read, sum(cache_write)::BIGINT AS cache_write, round(sum(cost), 4) AS cost, count(*) AS responses"


def _usage(spark, d):
    e = _t(spark, d, "events")
    model = F.coalesce(*(F.when(F.col("event_type") == k, v) for k, v in _MODELS.items()))
    floor = lambda k: F.floor(F.col("value") * k).cast("long")
    return e.select("event_id", "ts", F.when(F.col("event_type") == "click", "codex").otherwise("claude_code").alias("tool"), model.alias("model"), floor(1).alias("input"), floor(2).alias("output"), floor(3).alias("cache_read"), F.lit(1).cast("long").alias("cache_write"))


def _spend(spark, d, *keys):
    return E.spend_by(E.priced(_usage(spark, d), E.prices(spark)), *keys).withColumn("cost", F.round("cost", 4))


@_query(f"WITH {_COST} SELECT model, tool, {_SUMS} FROM x GROUP BY ALL")
def spend_by_model(spark, d):
    return _spend(spark, d, "model", "tool")


@_query(f"WITH {_COST} SELECT tool, {_SUMS} FROM x GROUP BY ALL")
def spend_by_tool(spark, d):
    return _spend(spark, d, "tool")


@_query(f"WITH {_COST}, y AS (SELECT CAST(ts AS DATE) AS day, * FROM x) SELECT day, {_SUMS} FROM y GROUP BY ALL")
def spend_by_day(spark, d):
    return E.spend_by(E.priced(_usage(spark, d).withColumn("day", F.to_date("ts")), E.prices(spark)), "day").withColumn("cost", F.round("cost", 4))


@_query(f"WITH {_COST} SELECT DISTINCT model FROM x WHERE cost IS NULL AND model IS NOT NULL")
def unpriced_models(spark, d):
    return E.priced(_usage(spark, d), E.prices(spark)).where("cost is null and model is not null").select("model").distinct()


@_query(f"WITH {_USAGE} SELECT round(sum(cache_read) / (sum(input) + sum(cache_read) + sum(cache_write)), 4) AS rate FROM u")
def cache_hit_rate(spark, d):
    return E.cache_hit_rate(_usage(spark, d))


@_query("SELECT event_type AS tool FROM events WHERE event_type <> 'error' EXCEPT SELECT event_type FROM events WHERE value > 400")
def tools_without_usage(spark, d):
    e = _t(spark, d, "events")
    return e.where("event_type <> 'error'").select(F.col("event_type").alias("tool")).subtract(e.where("value > 400").select("event_type"))


_RUN = "r AS (SELECT event_id, user_id, floor(value)::BIGINT AS total FROM events)"


@_query(f"WITH {_RUN}, l AS (SELECT *, lag(total) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM r) SELECT event_id, total, CASE WHEN before IS NULL OR total < before THEN total ELSE total - before END AS delta FROM l")
def usage_delta(spark, d):
    r = _t(spark, d, "events").select("event_id", "user_id", F.floor("value").cast("long").alias("total"))
    return E.usage_delta(r, "user_id", "event_id", "total").select("event_id", "total", "delta")


@_query("""WITH r AS (SELECT event_id, user_id, CASE WHEN event_type IN ('signup', 'purchase') THEN event_type END AS m FROM events)
SELECT event_id, coalesce(last_value(m IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), first_value(m IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS model FROM r""")
def asof_model(spark, d):
    r = _t(spark, d, "events").select("event_id", "user_id", F.when(F.col("event_type").isin("signup", "purchase"), F.col("event_type")).alias("m"))
    return E.last_known(r, "m", "user_id", "event_id", "model").select("event_id", "model")


@_query("""WITH c AS (SELECT user_id, event_id, event_type FROM events WHERE event_type IN ('click', 'view')), r AS (SELECT user_id, event_id FROM events WHERE event_type = 'error')
SELECT r.event_id, arg_max(c.event_type, c.event_id) AS call FROM r LEFT JOIN c ON c.user_id = r.user_id AND c.event_id <= r.event_id GROUP BY 1""")
def call_of_result(spark, d):
    e = _t(spark, d, "events")
    calls = e.where(F.col("event_type").isin("click", "view")).select("user_id", "event_id", F.col("event_type").alias("call"))
    return E.matched_calls(e.where("event_type = 'error'").select("user_id", "event_id"), calls, ["user_id"], "event_id", "call").select("event_id", "call")


# --- cleaning --------------------------------------------------------------------------------


@_query(f"""SELECT doc_id, ({' OR '.join(f"starts_with(lower(ltrim(text)), {_q(p)})" for p in C.INJECTED_PREFIXES)} OR {' OR '.join(f"contains(lower(left(text, 4000)), {_q(m)})" for m in C.INJECTED_MARKERS)}) AS injected FROM documents""")
def injected_messages(spark, d):
    return _texts(spark, d, "documents", "doc_id", "text").select("doc_id", C.is_injected(F.col("text")).alias("injected"))


@_query()
def clean_prose(spark, d):
    return _texts(spark, d, "documents", "doc_id", "text").select("doc_id", C.clean_prose(F.col("text")).alias("prose"))


@_query()
def code_messages(spark, d):
    return _texts(spark, d, "pages", "page_id", "html").select("page_id", C.looks_like_code(F.col("html")).alias("code"))


@_query()
def error_signatures(spark, d):
    texts = _texts(spark, d, "documents", "text").unionByName(_texts(spark, d, "conversations", "text"))
    return texts.select(C.error_signature(F.col("text")).alias("signature")).where("signature <> ''").groupBy("signature").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "signature").limit(40)


@_query()
def redact_terms(spark, d):
    return _texts(spark, d, "documents", "doc_id", "text").select("doc_id", C.redact(F.col("text"), ["example.com", "th er", "hash"]).alias("text"))


# --- sharing ---------------------------------------------------------------------------------

_ACCOUNTS, _NAMES = ["admin"], ["river-stone", "harbor"]


def _facets(spark, d):
    """Words of documents by tool (lang) and project (source), calls and messages of events, in the long form of facets."""
    scope = lambda name, member, facet, t: [F.lit(name).alias("scope"), member.alias("member"), F.lit(facet).alias("facet"), t.alias("t")]
    words = _terms(spark, d)
    events = _t(spark, d, "events").where("event_type is not null")
    call = F.concat(F.lit("mcp__s"), (F.col("user_id") % 3).cast("string"), F.lit("__"), F.col("event_type"))
    parts = [
        words.select(*scope("global", F.lit(""), "prose_user", F.col("term")), "n"),
        words.where("lang is not null").select(*scope("tool", F.col("lang"), "prose_user", F.col("term")), "n"),
        _t(spark, d, "documents").groupBy("source").agg(F.count("*").alias("n")).select(*scope("project", F.col("source"), "prose_user", F.col("source")), "n"),
        events.groupBy("event_type", call.alias("call")).agg(F.count("*").alias("n")).select(*scope("tool", F.col("event_type"), "tools", F.col("call")), "n"),
        events.groupBy("event_type", "props").agg(F.count("*").alias("n")).select(*scope("tool", F.col("event_type"), "errors", F.col("props")), "n"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy(*share.KEY, "t").agg(F.sum("n").alias("n"))


@_query(f"""WITH {_TERMS}, words AS (SELECT 'global' AS scope, '' AS member, 'prose_user' AS facet, term AS t, n FROM df UNION ALL SELECT 'tool', lang, 'prose_user', term, n FROM df WHERE lang IS NOT NULL),
calls AS (SELECT 'tool' AS scope, event_type AS member, 'tools' AS facet, 'mcp:' || event_type AS t, count(*) AS n FROM events WHERE event_type IS NOT NULL AND user_id IS NOT NULL GROUP BY event_type),
rows AS (SELECT * FROM words UNION ALL SELECT * FROM calls)
SELECT scope, member, facet, t, sum(n)::BIGINT AS n FROM rows
WHERE NOT regexp_matches(t, '[a-z0-9_][.][a-z0-9_]|[\\\\/@]|https?:') AND NOT contains(t, 'admin') AND NOT regexp_matches(t, '(^|[^a-z0-9])(river-stone|river stone|harbor)($|[^a-z0-9])') GROUP BY ALL
UNION ALL SELECT DISTINCT 'tool', event_type, 'errors', 'omitted in share mode', 0::BIGINT FROM events WHERE event_type IS NOT NULL""")
def scrubbed_facets(spark, d):
    return share.scrubbed(_facets(spark, d), _ACCOUNTS, _NAMES)


@_query("SELECT printf('project %02d', row_number() OVER (ORDER BY n DESC, source)) AS project, n FROM (SELECT source, count(*) AS n FROM documents WHERE source <> 'unknown' GROUP BY 1) ORDER BY n DESC, source LIMIT 24")
def anonymous_projects(spark, d):
    return share.anonymous(_t(spark, d, "documents").where("source <> 'unknown'").groupBy(F.col("source").alias("project")).agg(F.count("*").alias("n")), "project", "project", F.desc("n"), "project", most=24)


@_query("SELECT conv_id, events, printf('session %02d', row_number() OVER (ORDER BY events DESC, conv_id)) AS session FROM (SELECT conv_id, count(*) AS events FROM conversations GROUP BY 1) ORDER BY events DESC, conv_id LIMIT 40")
def anonymous_sessions(spark, d):
    rows = _t(spark, d, "conversations").groupBy("conv_id").agg(F.count("*").alias("events")).withColumn("session", F.col("conv_id").cast("string"))
    return share.anonymous(rows, "session", "session", F.desc("events"), "conv_id", most=40)
