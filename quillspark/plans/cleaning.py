"""SQL that the cleaning queries are checked against. RE2 has no look-around and its classes are ASCII: patterns that need more are written out for it."""

from __future__ import annotations

from ..functions import clean as C
from .catalog import _SQL, _case_sql, _q, line_classes

_WORD = r"[\p{L}\p{N}\p{M}_"  # the beginning of a class of Unicode words


def _re2(pattern: str) -> tuple[str, str]:
    """The pattern for RE2, and what a replacement must give back first."""
    if pattern == C.WINPATH or pattern == rf"(?U){C.WINPATH}":
        drive, share = C.WINPATH.removeprefix(r"(?<![\w:])").split(")*|", 1)
        return rf"(^|[^{_WORD[1:]}:])(?:{drive})*)|{share}", r"\1"
    if pattern.startswith(r"(?<![\w/])"):
        return r"(^|[^\w/])" + pattern.removeprefix(r"(?<![\w/])"), r"\1"
    if pattern.startswith("(?U)"):
        return pattern.removeprefix("(?U)").replace(r"[\w", _WORD), ""
    return pattern, ""


def _replaced(text: str, pattern: str, mark: str) -> str:
    own, back = _re2(pattern)
    return f"regexp_replace({text}, {_q(own)}, {_q(back + mark)}, 'g')"


def _chain(text: str, steps: list[tuple[str, str]]) -> str:
    for pattern, mark in steps:
        text = _replaced(text, pattern, mark)
    return text


_LETTERS = r"length(regexp_replace(s, '\P{L}', '', 'g'))"
_NOISE = f"(s <> '' AND ({' OR '.join(f'regexp_matches(s, {_q(p)})' for p in C.NOISE_LINES)} OR (length(s) > 200 AND NOT contains(left(s, 200), ' ')) OR (length(s) > 20 AND {_LETTERS} < 0.35 * length(s))))"
_BLANKS = "' ' || chr(9) || chr(10) || chr(13) || chr(11) || chr(12) || chr(160)"

_SQL["clean_prose"] = f"""WITH t AS (SELECT doc_id AS id, {_chain(f"regexp_replace(coalesce(text, ''), '\x1b\\[[0-9;]*m', ' ', 'g')", [(p, ' ') for p in C.BLOCKS])} AS text FROM documents), {line_classes('t')},
n AS (SELECT id, i, line FROM (SELECT id, i, line, trim(line) AS s FROM kept) WHERE NOT {_NOISE}),
j AS (SELECT t.id, coalesce(x.text, '') AS text FROM t LEFT JOIN (SELECT id, string_agg(line, chr(10) ORDER BY i) AS text FROM n GROUP BY 1) x USING (id))
SELECT id AS doc_id, trim(regexp_replace({_chain('text', [(p, ' ') for p in C.MASKS])}, '[ \\t]+', ' ', 'g'), {_BLANKS}) AS prose FROM j"""

_SQL["code_messages"] = f"""WITH t AS (SELECT page_id, trim(html) AS t FROM pages), l AS (SELECT *, list_slice(list_filter(string_split_regex(t, {_q(C.LINES)}), lambda x: trim(x) <> ''), 1, 200) AS ls FROM t)
SELECT page_id, coalesce({' OR '.join(f'starts_with(t, {_q(p)})' for p in C.CODE_PREFIXES)} OR (length(t) >= 40 AND len(ls) >= 4 AND len(list_filter(ls, lambda x: regexp_matches(x, {_q(C.CODE_LINE)}))) / len(ls) > 0.35), false) AS code FROM l"""


def _any(patterns: list[str]) -> str:
    return "(" + " OR ".join(f"regexp_matches(x, {_q(p)})" for p in patterns) + ")"


_MASKED = _chain("line", [(p, m.replace("$1", r"\1")) for p, m in C.SIGNATURE])
_SQL["error_signatures"] = f"""WITH t AS (SELECT regexp_replace(text, '\x1b\\[[0-9;]*m', ' ', 'g') AS body FROM (SELECT text FROM documents UNION ALL SELECT text FROM conversations) WHERE text IS NOT NULL),
l AS (SELECT body, list_filter(list_transform(string_split_regex(body, {_q(C.LINES)}), lambda x: trim(x)), lambda x: x <> '') AS ls FROM t), o AS (SELECT *, list_filter(ls, lambda x: NOT regexp_matches(x, {_q(C.SOURCE_LINE)})) AS own FROM l),
e AS (SELECT coalesce(list_extract(list_filter(own, lambda x: {_any(C.STRONG_ERRORS)}), 1), list_extract(list_filter(own, lambda x: {_any(C.WEAK_ERRORS)}), 1), CASE WHEN length(body) <= 2000 AND len(ls) <= 40 AND NOT regexp_matches(own[1], {_q(C.NOT_A_MESSAGE)}) THEN own[1] END, '') AS line FROM o),
m AS (SELECT regexp_replace({_MASKED}, '^(.*?[\\w)\\]''"]\\.)\\s+[A-Z].*$', '\\1') AS line FROM e)
SELECT signature, count(*) AS n FROM (SELECT left(trim(regexp_replace(line, '\\s+', ' ', 'g')), 110) AS signature FROM m) WHERE signature <> '' GROUP BY 1 ORDER BY n DESC, signature LIMIT 40"""

_SQL["redact_terms"] = r"SELECT doc_id, regexp_replace(text, '(?i)(^|[^0-9A-Za-z])(?:example[._\-]+com|th[\s._\-]+er|hash(?:\b|_))[0-9A-Za-z._\-]*', '\1 ', 'g') AS text FROM documents"
