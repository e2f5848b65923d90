import math

import pytest
from pyspark.sql import functions as F

from quillspark.functions import clean as C
from quillspark.functions import tokens as T
from quillspark.operators import events as E
from quillspark.operators import score as S


def one(spark, text, f):
    return spark.createDataFrame([(text,)], "t string").select(f(F.col("t")).alias("x")).first()["x"]


def counts(spark, **groups):
    return spark.createDataFrame([(g, t, n) for g, c in groups.items() for t, n in c.items()], "g string, term string, n long")


def test_log_odds_of_a_known_vector(spark):
    df = counts(spark, a={"ship": 9, "code": 5, "design": 3}, b={"code": 95, "test": 80, "ship": 1, "design": 37})
    z = {r.term: r.z for r in S.log_odds(df, "g").where("g = 'a'").collect()}
    assert z == {"ship": pytest.approx(5.347, abs=2e-3), "design": pytest.approx(0.278, abs=2e-3), "code": pytest.approx(-0.978, abs=2e-3)}


def test_pmi_of_a_known_vector(spark):
    p = spark.createDataFrame([("word cloud", 10), ("the code", 30)], "term string, n long")
    w = spark.createDataFrame([("word", 12), ("cloud", 11), ("the", 500), ("code", 100)], "term string, n long")
    assert [(r.term, r.pmi) for r in S.pmi_phrases(p, w).collect()] == [("word cloud", 9.52), ("the code", 2.54)]


def test_trends_need_two_periods(spark):
    df = spark.createDataFrame([("2026-01", "a", 20), ("2026-01", "b", 2), ("2026-02", "a", 2), ("2026-02", "b", 20)], "m string, term string, n long")
    got = [(r.direction, r.term, r.lift) for r in S.trends(df, "m").collect()]
    assert ("rising", "b", 3.036) in got and ("fading", "a", -3.036) in got
    assert S.trends(df.where("m = '2026-01'"), "m").count() == 0


def test_phrases_need_a_space_between(spark):
    assert [one(spark, t, T.phrases) for t in ("kind: string", "fast, cheap", "dev\nserver", "dev   server")] == [[], [], [], ["dev server"]]


def test_tokens_drop_secrets_hosts_and_noise(spark):
    assert one(spark, "The compiler at izs.com sk-proj-ab3xq9plm2 función 12 qwrtp i18nmanager", T.tokens) == ["compiler", "función", "i18nmanager"]


def test_kinds_of_lines(spark):
    lines = {'"type": "string",': "S", "[tool.black]": "S", '{"a b/c": 1': "S", "Note: read this first": "A", "Examples:": "A", "line-length = 88": "g", "}": "G", "'x',": "G", "---": "F", "plain words here": "P", "": "B", " \t": "B"}
    assert {t: one(spark, t, C.line_kind) for t in lines} == lines


@pytest.mark.parametrize(("text", "want"), [
    ("---\nname: x\n---\nwords that stay", "words that stay"), ("words first\n---\nname: x\n---\nwords that stay", "words first\n---\nname: x\n---\nwords that stay"),
    ("---\n\n---\nwords that stay", "---\n\n---\nwords that stay"), ('first words\n"k": 1\nsecond words', "first words\nsecond words"), (None, None), ("", ""),
    ('Label: of it\n"k": 1\nInner: two words\n}\nLast: one more', "Label: of it\nLast: one more"),
])
def test_structured_regions(spark, text, want):
    assert one(spark, text, C.without_structure) == want


@pytest.mark.parametrize(("text", "want"), [
    ('Note: read this first\n"type": "string"\n}', "Note: read this first"), ('{\n"type": "string"\n}\nIMPORTANT: check the loader', "IMPORTANT: check the loader"),
    ('[tool.black]\nline-length = 88\ntarget-version = "py39"\n\nDoes that look right?', "Does that look right?"), ("see https://x.y/z and a@b.co now", "see and now"), (None, ""),
])
def test_clean_prose(spark, text, want):  # also against SQL: plans/cleaning.py
    assert one(spark, text, C.clean_prose) == want


@pytest.mark.parametrize(("lits", "text", "want"), [(["river"], "driver screwdriver", "driver screwdriver"), (["cs"], "read the csv file", "read the csv file"), (["cargo-engine"], "HERD_LANE=cargo-engine failed", "HERD_LANE=X failed"), (["jane doe"], "signed by Jane Doe", "signed by X")])
def test_redact(spark, lits, text, want):
    assert one(spark, text, lambda c: C.redact(c, lits, "X")) == want


def test_error_signatures(spark):
    assert one(spark, "Exit code 1", C.error_signature) == "Exit code N"
    assert one(spark, "all fine\nTypeError: cannot read '/home/x/a.py' at 10.0.0.1", C.error_signature).startswith("TypeError: cannot read 'X'")


def test_injected_and_code(spark):
    assert one(spark, "  <system-reminder> x", C.is_injected) and not one(spark, "hello", C.is_injected)
    assert one(spark, "<!doctype html>", C.looks_like_code) and one(spark, "import a\nimport b\ndef f():\n  return 1\nclass Long name here: pass", C.looks_like_code)


def test_prices_take_the_longest_prefix_and_unknown_stays_null(spark):
    u = spark.createDataFrame([("gpt-5.4-mini-2026-01-01", "codex", 3200, 400, 1800, 0), ("llama-9-turbo", "x", 1, 1, 1, 1), ("claude-opus-5-x", "claude_code", 12, 340, 20000, 1500)], "model string, tool string, input long, output long, cache_read long, cache_write long")
    got = {r.model: r.cost for r in E.priced(u, E.prices(spark)).collect()}
    assert got["llama-9-turbo"] is None
    assert math.isclose(got["claude-opus-5-x"], 0.027935) and math.isclose(got["gpt-5.4-mini-2026-01-01"], (3200 * 0.25 + 400 * 2 + 1800 * 0.025) / 1e6)
    assert E.spend_by(E.priced(u, E.prices(spark)), "tool").where("tool = 'x'").first().cost is None


def test_streaks_and_counters(spark):
    d = spark.createDataFrame([("a", x) for x in ("2026-08-01", "2026-08-02", "2026-08-03", "2026-08-09")] + [("b", "2025-12-30"), ("b", "2025-12-31"), ("b", "2026-01-01"), ("c", None)], "k string, d string")
    assert {r.k: r.streak for r in E.longest_streak(d, "k", "d").collect()} == {"a": 3, "b": 3}
    c = spark.createDataFrame([("f", 1, 10), ("f", 2, 15), ("f", 3, 15), ("f", 4, 3)], "f string, i int, t long")
    assert [r.delta for r in E.usage_delta(c, "f", "i", "t").orderBy("i").collect()] == [10, 5, 0, 3]


def test_first_occurrence_keeps_rows_without_a_key(spark):
    d = spark.createDataFrame([(1, "x", "g"), (2, "x", "g"), (3, "", "g"), (4, "", "g"), (5, "x", "h")], "i int, k string, g string")
    assert sorted(r.i for r in E.first_occurrence(d, "k", ["g"], "i").collect()) == [1, 3, 4, 5]
