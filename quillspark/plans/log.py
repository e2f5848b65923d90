"""Queries over a whole event log, read out of the driver's tables: talk from conversations, calls and failures from events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import clean as C
from ..functions import commands as X
from ..functions import paths as P

from ..functions import when
from ..functions import words as W
from ..operators import documents as D
from ..operators import events as E
from ..operators import facets as B
from ..operators import wrapped as Y
from ..operators.score import log_odds
from .catalog import _COST, _FOUND, _KEEP, _case_sql, _keep, _odds_sql, _q, _query, _t, _texts, _usage, line_classes

ZONE = "+03:00"
_TOOLS = ("claude_code", "codex", "grok", "gemini_cli")
_CMDS = ("git commit -m x", "FOO=1 /usr/bin/git push", "rg foo", "npm run build", "git -C /srv/x status", None, "(cd", "docker 'compose' up")
_TEXTS = ("src/app.PY", "see notes.md", "help.example.etoro", "https://x.y/z.js", "lib\\x.rs", "Makefile", "a/b/.env", "")
_FAILS = ("Exit code {}", "TypeError: cannot read x", "all fine", "fatal: not a git repository\nmore", "")
_SIGNS = ("Exit code N", "TypeError: cannot read x", "all fine", "fatal: not a git repository", None)


def _case(key: Column, values) -> Column:
    out = F.lit(None).cast("string")
    for i, v in enumerate(values):
        out = F.when(key % len(values) == i, F.lit(v)).otherwise(out)
    return out


def log(spark: SparkSession, d: str) -> DataFrame:
    """The event relation with prose. Prose is the text itself: what cleaning takes out has queries of its own."""
    talk = _texts(spark, d, "conversations", "conv_id", "turn", "role", "text")
    at = F.timestamp_seconds(F.lit(1767225600) + F.col("conv_id") * 25200 + F.col("turn") * 60)
    iso = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    kind = F.when(F.col("role") == "user", "prompt").when(F.col("role") == "assistant", "reply").otherwise("meta")
    none = F.lit(None).cast("string")
    talk = talk.select((F.col("conv_id") * 100_000 + F.col("turn")).alias("seq"), iso(at).alias("ts"), _case(F.col("conv_id"), _TOOLS).alias("tool"), F.col("conv_id").cast("string").alias("session_id"), _case(F.col("conv_id"), ("ferry", "cedar", None)).alias("project"), "role", kind.alias("kind"), "text",
        none.alias("tool_name"), none.alias("cmd"), F.lit(None).cast("long").alias("tokens"), F.when(F.col("role").isin("user", "assistant"), F.col("text")).otherwise("").alias("prose"), F.lit("exact").alias("confidence"))
    e = _t(spark, d, "events")
    kind = F.when(F.col("event_type").isin("click", "view"), "tool_call").when(F.col("event_type") == "error", "error").otherwise("meta")
    fails = F.when(F.col("event_id") % 5 == 0, F.concat(F.lit("Exit code "), F.col("event_id").cast("string"))).otherwise(_case(F.col("event_id"), _FAILS))
    acts = e.select((F.col("event_id") + (1 << 50)).alias("seq"), iso(F.col("ts")).alias("ts"), _case(F.col("user_id"), _TOOLS).alias("tool"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("session_id"), _case(F.col("user_id"), ("ferry", "maple", "", "cedar")).alias("project"), F.lit("assistant").alias("role"), kind.alias("kind"),
        F.when(kind == "tool_call", _case(F.col("event_id"), _TEXTS)).when(kind == "error", fails).alias("text"), F.when(kind == "tool_call", _case(F.col("user_id"), ("shell", "", "edit"))).alias("tool_name"), F.when(kind == "tool_call", _case(F.col("event_id"), _CMDS)).alias("cmd"),
        F.when(F.col("event_id") % 2 == 0, F.floor("value").cast("long")).alias("tokens"), F.lit("").alias("prose"), F.when(F.col("event_id") % 7 == 0, "heuristic").otherwise("exact").alias("confidence"))
    return talk.unionByName(acts)


_LOG = f"""log0 AS (SELECT conv_id * 100000 + turn AS seq, strftime(make_timestamp((1767225600 + conv_id * 25200 + turn * 60) * 1000000), '%Y-%m-%dT%H:%M:%SZ') AS ts, {_case_sql('conv_id', _TOOLS)} AS tool, conv_id::VARCHAR AS session_id, {_case_sql('conv_id', ('ferry', 'cedar', None))} AS project, role,
 CASE role WHEN 'user' THEN 'prompt' WHEN 'assistant' THEN 'reply' ELSE 'meta' END AS kind, text, NULL::VARCHAR AS tool_name, NULL::VARCHAR AS cmd, NULL::BIGINT AS tokens, CASE WHEN role IN ('user', 'assistant') THEN text ELSE '' END AS prose, 'exact' AS confidence FROM conversations
UNION ALL SELECT event_id + {1 << 50}, strftime(ts, '%Y-%m-%dT%H:%M:%SZ'), {_case_sql('user_id', _TOOLS)}, 'u' || user_id, {_case_sql('user_id', ('ferry', 'maple', '', 'cedar'))}, 'assistant', CASE WHEN event_type IN ('click', 'view') THEN 'tool_call' WHEN event_type = 'error' THEN 'error' ELSE 'meta' END,
 CASE WHEN event_type IN ('click', 'view') THEN {_case_sql('event_id', _TEXTS)} WHEN event_type = 'error' THEN CASE WHEN event_id % 5 = 0 THEN 'Exit code ' || event_id ELSE {_case_sql('event_id', _FAILS)} END END, CASE WHEN event_type IN ('click', 'view') THEN {_case_sql('user_id', ('shell', '', 'edit'))} END, CASE WHEN event_type IN ('click', 'view') THEN {_case_sql('event_id', _CMDS)} END,
 CASE WHEN event_id % 2 = 0 THEN floor(value)::BIGINT END, '', CASE WHEN event_id % 7 = 0 THEN 'heuristic' ELSE 'exact' END FROM events),
log1 AS (SELECT * EXCLUDE (tool, project), coalesce(nullif(tool, ''), 'unknown') AS tool, coalesce(nullif(project, ''), 'unknown') AS project, (strptime(ts, '%Y-%m-%dT%H:%M:%SZ') + INTERVAL 3 HOUR) AS wall FROM log0),
log AS (SELECT *, CAST(wall AS DATE) AS day, strftime(wall, '%Y-%m') AS month, tool || ':' || session_id AS sid FROM log1),
views AS (SELECT 'global' AS scope, 'all' AS member, * FROM log UNION ALL SELECT 'tool', tool, * FROM log UNION ALL SELECT 'project', project, * FROM log UNION ALL SELECT 'month', month, * FROM log)"""
_NORMAL = "lambda x: trim(lower(x), '-.''')"
_TOKENS = f"list_transform({_FOUND.replace('(text)', '(prose)')}, {_NORMAL})"
_KEY = f"array_to_string(list_slice(list_filter(list_transform({_FOUND.replace('(text)', '(coalesce(text, chr(32)))')}, {_NORMAL}), lambda x: regexp_matches(x, {_q(W.LETTERS)})), 1, 6), ' ')"
_TALK = f"""talk AS (SELECT seq, kind, {_KEY} AS key, {_TOKENS} AS toks FROM log WHERE prose <> '' AND ((role = 'user' AND kind = 'prompt') OR (role = 'assistant' AND kind = 'reply'))),
occ AS (SELECT seq, kind, key, t FROM (SELECT seq, kind, key, unnest(toks) AS t FROM talk) WHERE {_KEEP}), worded AS (SELECT seq, count(*) AS words FROM occ GROUP BY 1)"""


@_query(f"""WITH {_LOG}, {_TALK} SELECT scope, member, count(*) AS events, count(DISTINCT sid) AS sessions, sum(CASE WHEN tokens > 0 THEN tokens ELSE 0 END)::BIGINT AS llm_tokens,
count(*) FILTER (WHERE kind = 'prompt' AND words > 0) AS prompts, coalesce(sum(words), 0)::BIGINT AS words FROM views LEFT JOIN worded USING (seq) GROUP BY ALL""")
def facet_counts(spark, d):
    return B.facet_counts(log(spark, d), ZONE)


_SPOKEN = f"""own AS (SELECT v.scope, v.member, t.seq, t.kind, t.key FROM views v JOIN talk t USING (seq) JOIN worded USING (seq)),
once AS (SELECT scope, member, seq FROM (SELECT *, row_number() OVER (PARTITION BY scope, member, key ORDER BY seq) AS r FROM own WHERE kind = 'prompt') WHERE key = '' OR r = 1),
runs AS (SELECT seq, unnest(regexp_extract_all(nfc_normalize(prose), {_q(f'{W.token_re2()}(?:{W.GAP}{W.token_re2()})+')})) AS run FROM log JOIN talk USING (seq)),
near AS (SELECT seq, ws, unnest(generate_series(1, len(ws) - 1)) AS i FROM (SELECT seq, list_transform(string_split_regex(run, {_q(W.GAP)}), {_NORMAL}) AS ws FROM runs)),
ph AS (SELECT DISTINCT seq, ws[i] || ' ' || ws[i + 1] AS t FROM near WHERE {_keep('ws[i]')} AND {_keep('ws[i + 1]')}), dt AS (SELECT DISTINCT seq, t FROM occ),
spoken AS (SELECT scope, member, 'prose_user' AS facet, t, count(*) AS n FROM once JOIN dt USING (seq) GROUP BY ALL UNION ALL SELECT scope, member, 'phrases_user', t, count(*) FROM once JOIN ph USING (seq) GROUP BY ALL
UNION ALL SELECT scope, member, 'prose_user_raw', t, count(*) FROM own JOIN occ USING (seq) WHERE own.kind = 'prompt' GROUP BY ALL UNION ALL SELECT scope, member, 'prose_assistant_raw', t, count(*) FROM own JOIN occ USING (seq) WHERE own.kind = 'reply' GROUP BY ALL
UNION ALL SELECT scope, member, 'prose_assistant', t, count(*) FROM own JOIN dt USING (seq) WHERE own.kind = 'reply' GROUP BY ALL UNION ALL SELECT scope, member, 'phrases_assistant', t, count(*) FROM own JOIN ph USING (seq) WHERE own.kind = 'reply' GROUP BY ALL)"""


@_query(f"WITH {_LOG}, {_TALK}, {_SPOKEN} SELECT scope, member, facet, t, n FROM spoken")
def facet_words(spark, d):
    return B.spoken(B.sliced(log(spark, d), ZONE))


_ACTS = f"""calls AS (SELECT *, list_filter(string_split_regex(cmd, '\\s+'), lambda x: x <> '') AS ws, list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '') AS xs FROM views WHERE kind = 'tool_call'),
heads AS (SELECT *, nullif(list_extract(string_split(trim(list_extract(list_filter(ws, lambda x: NOT regexp_matches(x, {_q(X.ASSIGNMENT)})), 1), {_q(X._QUOTES)}), '/'), -1), '') AS head, trim(list_extract(list_filter(ws[2:], lambda x: NOT starts_with(x, '-')), 1), '''"') AS arg, coalesce(list_extract(xs, -1), '') AS word FROM calls),
subs AS (SELECT *, CASE WHEN head IN ({', '.join(map(_q, X.SUBCOMMANDS))}) AND NOT contains(arg, '/') AND NOT regexp_matches(arg, '^[.~$]') AND (regexp_matches(arg, '^\\p{{L}}+$') OR contains(arg, '-')) THEN head || ' ' || arg END AS sub, lower(regexp_extract(word, {_q(X.SUFFIX)}, 1)) AS ext FROM heads),
acts AS (SELECT scope, member, 'tools' AS facet, coalesce(nullif(tool_name, ''), 'unknown') AS t FROM calls UNION ALL SELECT scope, member, 'commands', head FROM subs WHERE head IS NOT NULL UNION ALL SELECT scope, member, 'commands', sub FROM subs WHERE sub IS NOT NULL
UNION ALL SELECT scope, member, 'extensions', ext FROM subs WHERE ext <> '' AND NOT contains(word, '://') AND (regexp_matches(word, '[/\\\\]') OR ext IN ({', '.join(map(_q, X.FILE_EXTS))}))
UNION ALL SELECT scope, member, 'errors', {_case_sql(f'(seq - {1 << 50})', _SIGNS)} FROM views WHERE kind = 'error')"""


@_query(f"WITH {_LOG}, {_ACTS} SELECT scope, member, facet, t, count(*) AS n FROM acts WHERE t IS NOT NULL GROUP BY ALL")
def facet_actions(spark, d):
    return B.done(B.sliced(log(spark, d), ZONE))


@_query(f"""WITH {_LOG}, {_TALK}, {_SPOKEN}, own2 AS (SELECT * FROM spoken WHERE facet = 'prose_user'), bg AS (SELECT t, n AS bg FROM own2 WHERE scope = 'global'), w AS (SELECT sum(bg) AS tot, count(*) AS v FROM bg), g AS (SELECT scope, member, sum(n) AS nt FROM own2 GROUP BY ALL),
x AS (SELECT o.scope, o.member, t, n, 0.01 * greatest(bg, 1) AS aw, 0.01 * greatest(v, 1) AS a0, nt, tot - nt AS nr, bg - n AS yr FROM own2 o JOIN bg USING (t) JOIN g USING (scope, member) CROSS JOIN w WHERE n >= 3 AND o.scope <> 'global'),
y AS (SELECT *, n + aw AS t0, nt + a0 - n - aw AS t1, yr + aw AS r0, nr + a0 - yr - aw AS r1 FROM x), z AS (SELECT scope, member, t, n, round((ln(t0 / t1) - ln(r0 / r1)) / sqrt(1 / t0 + 1 / r0), 3) AS z FROM y WHERE nt > 0 AND nr > 0 AND t1 > 0 AND r0 > 0 AND r1 > 0)
SELECT scope, member, t, n, z FROM z QUALIFY row_number() OVER (PARTITION BY scope, member ORDER BY z DESC, n DESC, t) <= 120""")
def facet_distinctive(spark, d):
    return B.distinctive(B.spoken(B.sliced(log(spark, d), ZONE)), "prose_user")


@_query(f"""WITH {_LOG}, {_TALK}, {_SPOKEN}, p AS (SELECT scope, member, t, n FROM spoken WHERE facet = 'phrases_assistant'), u AS (SELECT scope, member, t, n FROM spoken WHERE facet = 'prose_assistant'), tp AS (SELECT scope, member, sum(n) AS tp FROM p GROUP BY ALL), tw AS (SELECT scope, member, sum(n) AS tw FROM u GROUP BY ALL),
s AS (SELECT p.scope, p.member, p.t, p.n, log2((p.n / tp) / ((a.n / tw) * (b.n / tw))) AS raw FROM p JOIN u a ON a.scope = p.scope AND a.member = p.member AND a.t = split_part(p.t, ' ', 1) JOIN u b ON b.scope = p.scope AND b.member = p.member AND b.t = split_part(p.t, ' ', 2) JOIN tp ON tp.scope = p.scope AND tp.member = p.member JOIN tw ON tw.scope = p.scope AND tw.member = p.member WHERE p.n >= 4)
SELECT scope, member, t, n, round(raw, 2) AS pmi FROM s WHERE raw >= 2 QUALIFY row_number() OVER (PARTITION BY scope, member ORDER BY n * round(raw, 2) DESC, t) <= 80""")
def facet_phrases(spark, d):
    return B.phrases_of(B.spoken(B.sliced(log(spark, d), ZONE)), "assistant")


@_query(f"WITH {_LOG}, {_TALK} SELECT month, t AS term, count(*) AS n FROM occ JOIN log USING (seq) WHERE occ.kind = 'prompt' GROUP BY ALL")
def monthly_words(spark, d):
    return B.monthly_words(log(spark, d), ZONE)


@_query(f"WITH {_LOG} SELECT tool, min(ts) AS first, max(ts) AS last, count(*) AS events, count(DISTINCT sid) AS sessions, count(*) FILTER (WHERE confidence = 'heuristic') AS heuristic FROM log GROUP BY 1")
def coverage(spark, d):
    return B.coverage(log(spark, d), ZONE)[0]


@_query(f"WITH {_LOG} SELECT tool, month, count(*) AS n FROM log GROUP BY ALL")
def coverage_months(spark, d):
    return B.coverage(log(spark, d), ZONE)[1]


_PROMPTS = f"prompts AS (SELECT l.seq, l.tool, l.project, l.day, hour(l.wall) AS hour, strftime(l.wall, '%a') AS weekday, l.prose, len(list_filter(string_split_regex(l.prose, '\\s+'), lambda x: x <> '')) AS n_words, key <> '' AND row_number() OVER (PARTITION BY key ORDER BY seq) > 1 AS repeat FROM log l JOIN talk USING (seq) WHERE talk.kind = 'prompt')"


def _prompts(spark, d):
    return Y.prompt_rows(B.sliced(log(spark, d), ZONE))


@_query(f"WITH {_LOG}, {_TALK}, {_PROMPTS} SELECT coalesce(sum(n_words), 0)::BIGINT AS words_to_ai, count(*) AS prompts, count(*) FILTER (WHERE n_words <= 200) AS human_prompts, count(DISTINCT day) AS days_active, min(day) AS first_day, max(day) AS last_day, count(DISTINCT tool) AS tools_used, count(DISTINCT project) FILTER (WHERE project <> 'unknown') AS projects FROM prompts")
def wrapped_numbers(spark, d):
    return Y.numbers(_prompts(spark, d))


@_query(f"WITH {_LOG}, {_TALK}, {_PROMPTS} SELECT 'tool' AS key, tool AS value, count(*) AS n FROM prompts GROUP BY 2 UNION ALL SELECT 'day', day::VARCHAR, count(*) FROM prompts GROUP BY 2 UNION ALL SELECT 'hour', hour::VARCHAR, count(*) FROM prompts GROUP BY 2 UNION ALL SELECT 'weekday', weekday, count(*) FROM prompts GROUP BY 2")
def wrapped_activity(spark, d):
    own = _prompts(spark, d)
    parts = [Y.prompts_by(own, k).select(F.lit(k).alias("key"), F.col(k).cast("string").alias("value"), "n") for k in ("tool", "day", "hour", "weekday")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@_query(f"WITH {_LOG}, {_TALK}, {_PROMPTS} SELECT seq, n_words, repeat FROM prompts")
def repeated_prompts(spark, d):
    return _prompts(spark, d).select("seq", "n_words", "repeat")


_BASE = ", ".join(map(_q, W.BASE_STOP))
_GRAMS = f"""gw AS (SELECT seq, kind, list_filter(toks, lambda x: x <> '') AS ws FROM talk), gg AS (SELECT seq, kind, list_slice(ws, i, i + k - 1) AS g FROM (SELECT *, unnest(generate_series(1, len(ws) - k + 1)) AS i FROM gw CROSS JOIN (VALUES (2), (3)) v(k))),
grams AS (SELECT DISTINCT seq, kind, array_to_string(g, ' ') AS t FROM gg WHERE g[1] NOT IN ({_BASE}) AND g[len(g)] NOT IN ({_BASE}) AND len(list_filter(g, lambda x: NOT regexp_matches(x, {_q(W.WORD_LIKE)}))) = 0)"""


@_query(f"WITH {_LOG}, {_TALK}, {_PROMPTS}, {_GRAMS} SELECT t, n, projects FROM (SELECT g.t, count(*) AS n, count(DISTINCT project) AS projects FROM grams g JOIN prompts USING (seq) WHERE n_words <= 200 AND NOT repeat GROUP BY 1) WHERE n >= 3 ORDER BY projects DESC, n DESC, t LIMIT 5")
def wrapped_signature(spark, d):
    return Y.signature(_prompts(spark, d))


_EMOTION = ", ".join(f"coalesce(sum(len(regexp_extract_all(prose, {_q(p)}))), 0) AS {k}" for k, p in W.EMOTIONS.items())


@_query(f"WITH {_LOG}, {_TALK}, {_PROMPTS}, e AS (SELECT {_EMOTION} FROM prompts WHERE n_words <= 200) SELECT family, n::BIGINT AS n FROM e UNPIVOT (n FOR family IN ({', '.join(W.EMOTIONS)}))")
def wrapped_emotions(spark, d):
    return Y.emotions(_prompts(spark, d))


@_query(f"""WITH {_LOG}, {_TALK}, {_PROMPTS}, {_GRAMS}, df AS (SELECT 'assistant' AS side, t AS term, count(*) AS n FROM grams WHERE kind = 'reply' GROUP BY 2 UNION ALL SELECT 'user', t, count(*) FROM grams JOIN prompts USING (seq) WHERE NOT repeat GROUP BY 2), {_odds_sql('df', 'side', 20, 8)}""")
def voice_phrases(spark, d):
    return log_odds(Y.voices(B.sliced(log(spark, d), ZONE)), "side", n=20, min_count=8)


@_query(f"""WITH {_LOG}, {_TALK}, {_SPOKEN}, {_ACTS}, f AS (SELECT facet, t, n FROM spoken WHERE scope = 'global' AND facet IN ('prose_user', 'prose_assistant') UNION ALL SELECT facet, t, count(*) FROM acts WHERE scope = 'global' AND facet IN ('tools', 'commands') AND t IS NOT NULL GROUP BY ALL),
k AS (SELECT facet, count(*) >= 400 AS long FROM f GROUP BY 1)
SELECT facet, t, n, CASE WHEN long AND facet LIKE 'prose%' AND n < 2 THEN 'rare' WHEN regexp_matches(t, '(?i)(^|[^0-9A-Za-z])thand') THEN 'redacted' WHEN regexp_matches(lower(t), '[a-z0-9_][.][a-z0-9_]|[\\\\/@]|https?:') OR contains(lower(t), 'admin') OR regexp_matches(lower(t), '(^|[^a-z0-9])(ferry|npm)($|[^a-z0-9])') THEN 'harvested' ELSE 'kept' END AS verdict FROM f JOIN k USING (facet)""")
def vocabulary_gate(spark, d):
    return D.gated(B.facet_terms(log(spark, d), ZONE), ["thand"], ["admin"], ["ferry", "npm"])


# --- labels and times ------------------------------------------------------------------------

_PATHS = ("'/Users/ann/Projects/repo' || k", "'/Users/ann/Projects/repo' || k || '/.claude/worktrees/arm-' || k", "'/Users/ann/.codex/worktrees/18a0/repo' || k || '/src'", "'/Users/ann/conductor/workspaces/repo' || k || '/zurich'", "'/private/tmp/x' || k", "'/'", "NULL", "'/Users/ann/'", "'/home/bo/repo' || k || '/.worktrees/fix/deep'", "'/srv/worktrees/77'")
_LABELS = ("'repo' || k", "'repo' || k", "'repo' || k", "'repo' || k", "'tmp'", "'unknown'", "'unknown'", "'~'", "'repo' || k", "'unknown'")
_BRANCHES = ("NULL", "'arm-' || k", "NULL", "'zurich'", "NULL", "NULL", "NULL", "NULL", "'fix'", "NULL")
_OLD = ("'repo' || k", "'repo' || k || '--claude-worktrees-native-ota'", "'my-workspaces-thing'", "'worktrees-secret'", "'.claude-worktrees-x'", "'a-b--worktrees-C-d'", "''", "NULL")
_FIXED = ("'repo' || k", "'repo' || k", "'my-workspaces-thing'", "'unknown'", "'unknown'", "'a-b'", "'unknown'", "'unknown'")
_CUT = ("NULL", "'native-ota'", "NULL", "'secret'", "'x'", "'c-d'", "NULL", "NULL")
_case_of = lambda n, values: f"CASE k % {n} " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values)) + " END"
_KS = "c AS (SELECT c_custkey AS k FROM customer)"


@_query(f"WITH {_KS} SELECT k, {_case_of(10, _LABELS)} AS project, {_case_of(10, _BRANCHES)} AS branch FROM c")
def project_labels(spark, d):
    rows = _t(spark, d, "customer").select(F.col("c_custkey").alias("k")).withColumn("cwd", F.expr(_case_of(10, _PATHS)))
    return rows.select("k", P.project_from_cwd(F.col("cwd"), home="/Users/ann").alias("project"), P.branch_of_cwd(F.col("cwd"), home="/Users/ann").alias("branch"))


@_query(f"WITH {_KS} SELECT k, {_case_of(8, _FIXED)} AS project, {_case_of(8, _CUT)} AS branch FROM c")
def repaired_labels(spark, d):
    rows = _t(spark, d, "customer").select(F.col("c_custkey").alias("k")).withColumn("label", F.expr(_case_of(8, _OLD)))
    return rows.select("k", P.normalize_project(F.col("label")).alias("project"), P.branch_of_label(F.col("label")).alias("branch"))


@_query("""SELECT event_id, CASE event_id % 5 WHEN 0 THEN (ts + INTERVAL 3 HOUR)::DATE WHEN 1 THEN ts::DATE WHEN 2 THEN (ts + INTERVAL 8 HOUR)::DATE WHEN 3 THEN DATE '2026-08-02' END AS day,
CASE event_id % 5 WHEN 0 THEN hour(ts + INTERVAL 3 HOUR) WHEN 1 THEN hour(ts) WHEN 2 THEN hour(ts + INTERVAL 8 HOUR) END::INTEGER AS hour, coalesce(strftime(CASE event_id % 5 WHEN 0 THEN (ts + INTERVAL 3 HOUR)::DATE WHEN 1 THEN ts::DATE WHEN 2 THEN (ts + INTERVAL 8 HOUR)::DATE WHEN 3 THEN DATE '2026-08-02' END, '%Y-%m'), 'unknown') AS month FROM events""")
def local_times(spark, d):
    """Instants in UTC, wall clocks, instants of another offset, bare dates with rubbish behind, and rubbish."""
    at = lambda f: F.date_format("ts", f"yyyy-MM-dd'T'HH:mm:ss{f}")
    k = F.col("event_id") % 5
    ts = F.when(k == 0, at("'Z'")).when(k == 1, at("")).when(k == 2, at("'-05:00'")).when(k == 3, "2026-08-02 about noon").otherwise("never")
    rows = _t(spark, d, "events").select("event_id", ts.alias("ts"))
    day = when.local_date(F.col("ts"), ZONE)
    return rows.select("event_id", day.alias("day"), when.local_hour(F.col("ts"), ZONE).alias("hour"), when.month(day).alias("month"))


# --- spend in its orders ---------------------------------------------------------------------


def _priced(spark, d):
    return E.priced(_usage(spark, d).withColumn("session_id", F.col("event_id") % 50), E.prices(spark))


_TOKS = "sum(input + output + cache_read + cache_write)::BIGINT AS tokens"


@_query(f"WITH {_COST} SELECT model, tool, sum(input)::BIGINT AS input, sum(output)::BIGINT AS output, sum(cache_read)::BIGINT AS cache_read, sum(cache_write)::BIGINT AS cache_write, round(sum(cost), 4) AS cost, count(*) AS responses FROM x GROUP BY ALL ORDER BY coalesce(round(sum(cost), 4), 0) DESC, sum(input + output) DESC, model, tool LIMIT 3")
def costliest_models(spark, d):
    return E.by_model(_priced(spark, d), n=3)


@_query(f"WITH {_COST} SELECT tool, round(coalesce(sum(cost), 0), 4) AS cost, {_TOKS}, count(DISTINCT event_id % 50) AS sessions FROM x GROUP BY 1 ORDER BY cost DESC, tool LIMIT 20")
def costliest_tools(spark, d):
    return E.by_tool(_priced(spark, d))


@_query(f"WITH {_COST} SELECT CAST(ts AS DATE) AS day, round(coalesce(sum(cost), 0), 4) AS cost, {_TOKS} FROM x GROUP BY 1 ORDER BY 1")
def daily_spend(spark, d):
    return E.by_day(_priced(spark, d).withColumn("day", F.to_date("ts")))


@_query(f"WITH {_COST}, y AS (SELECT CAST(ts AS DATE) AS day, round(coalesce(sum(cost), 0), 4) AS cost FROM x GROUP BY 1) SELECT day AS date, round(cost, 2) AS cost FROM y ORDER BY y.cost DESC, day LIMIT 1")
def priciest_day(spark, d):
    return Y.priciest_day(E.by_day(_priced(spark, d).withColumn("day", F.to_date("ts"))))


# --- structure -------------------------------------------------------------------------------

_ADDED = ("", "\n---\nname: x\nkind: y\n---\nshort words here", "\n\n---\nname: x\nkind: y z w\n---\nshort words here", "\n{\n\"type\": \"string\"\n}\nIMPORTANT: check the loader", "\nNote: read this first\n\"a.b/c d e\": \"text of it\",\n\nExamples:\n}\nDone: with it now", "\nName: two words\nkey=1\nTitle: three more words")
@_query(f"""WITH t AS (SELECT conv_id * 100000 + turn AS id, text || {_case_sql('turn', _ADDED)} AS text FROM conversations), {line_classes('t')} SELECT id, string_agg(line, chr(10) ORDER BY i) AS kept FROM kept GROUP BY 1""")
def structured_lines(spark, d):
    rows = _texts(spark, d, "conversations", "conv_id", "turn", "text").select((F.col("conv_id") * 100_000 + F.col("turn")).alias("id"), F.concat("text", _case(F.col("turn"), _ADDED)).alias("text"))
    return rows.select("id", C.without_structure(F.col("text")).alias("kept"))
