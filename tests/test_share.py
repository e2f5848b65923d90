import json
import os
import stat

import pytest
from pyspark.sql import functions as F

from quillspark.functions.fold import composed
from quillspark.operators import documents as D
from quillspark.operators import identities as I
from quillspark.operators import share as S


def facets(spark, *rows):
    return spark.createDataFrame(rows, "scope string, member string, facet string, t string, n long")


def test_scrubbing_keeps_words_and_drops_what_the_machine_says(spark):
    given = facets(
        spark,
        ("global", "", "prose_user", "harbour", 5), ("global", "", "prose_user", "combat_screen.gd", 4), ("global", "", "prose_user", "janes", 3), ("global", "", "phrases_user", "the big ship sails", 3),
        ("global", "", "phrases_user", "big shipping", 2), ("tool", "a", "tools", "mcp__ads__run", 2), ("tool", "a", "tools", "MCP__other__run", 3), ("tool", "a", "tools", "Bash", 1),
        ("tool", "a", "errors", "cannot open /etc/x", 9), ("tool", "a", "commands", "git push", 9), ("project", "big-ship", "prose_user", "word", 1), ("month", "2026-01", "prose_user", None, 1),
    )
    got = {(r.scope, r.facet, r.t): r.n for r in S.scrubbed(given, ["jane", "x"], ["big-ship"]).collect()}
    assert got == {
        ("global", "prose_user", "harbour"): 5, ("global", "phrases_user", "big shipping"): 2, ("tool", "tools", "mcp:run"): 5, ("tool", "tools", "Bash"): 1,
        ("tool", "errors", S.NOTICE): 0, ("tool", "commands", S.NOTICE): 0, ("month", "prose_user", None): 1,
    }
    assert S.scrubbed(given.limit(0)).count() == 0


def test_anonymous_names_follow_the_order(spark):
    rows = spark.createDataFrame([("b", 2), ("a", 2), ("c", 9), ("d", 1)], "t string, n long")
    assert {r.t: r.n for r in S.anonymous(rows, "t", "project", F.desc("n"), "t", most=3).collect()} == {"project 01": 9, "project 02": 2, "project 03": 2}


def test_document_and_page(spark, tmp_path):
    rows = [("global", "", "errors", f"e{i:03}", i) for i in range(60)] + [("tool", "a", "prose_user", "</script><!--", 3), ("month", "2026-01", "tools", "t", 1)]
    found = D.clouds(facets(spark, *rows))
    assert len(found["global"]["errors"]) == 40 and found["global"]["errors"][0] == {"t": "e059", "n": 59}
    document = D.statistics(clouds=found, totals={"events": 1})
    assert list(document) == D.SECTIONS and document["schema_version"] == 1
    with pytest.raises(ValueError):
        D.statistics(cloud={})
    page = D.stamped(D.render(document, "<!doctype html>\n<html lang=en><script>__STATS__</script>"))
    assert page.count("</script>") == 1 and page.startswith("<!doctype html>\n<html lang=en><!-- redaction-schema: 1 -->")
    assert json.loads(page.split("<script>")[1].split("</script>")[0]) == document
    (tmp_path / "new-shareable.html").write_text(page)
    (tmp_path / "old.html").write_text("<html>" + "é" * 9000 + "<!-- redaction-schema: 1 -->")
    got = {r.name: (r.schema, r.shareable, r.stale) for r in D.snapshots(spark, str(tmp_path)).collect()}
    assert got == {"new-shareable.html": (1, True, False), "old.html": (0, False, True)}
    assert D.schema_of(page) == 1 and D.schema_of("") == 0


def test_files_appear_whole(spark, tmp_path):
    path = tmp_path / "redact.json"
    path.write_text("old")
    assert D.write_sidecar({"identities": ["jane"]}, str(path)) is None
    assert json.loads(path.read_text()) == {"identities": ["jane"]} and stat.S_IMODE(os.stat(path).st_mode) == 0o600
    with pytest.raises(TypeError):
        D.write_json({"x": object()}, str(path))
    assert os.listdir(tmp_path) == ["redact.json"]
    assert D.write_sidecar({}, str(tmp_path / "none" / "x.json"))


def test_events_replace_an_older_corpus_only_when_written(spark, tmp_path):
    path = str(tmp_path / "events")
    D.write_events(spark.range(3), path)
    D.write_events(spark.range(5), path)
    assert spark.read.json(path).count() == 5
    with pytest.raises(Exception):
        D.write_events(spark.range(2).select(F.raise_error(F.lit("no")).alias("x")), path)
    assert spark.read.json(path).count() == 5


def test_identities():
    assert I.handles("12345+jane-doe@example.com") == ["jane-doe", "jane", "doe"] and I.handles(None) == []
    assert I.remote_owner("git@host.example:acme/tool.git") == I.remote_owner("https://u@host.example/acme/tool") == "acme" and I.remote_owner("/srv/x") is None
    bare, decorated, refused = I.branch_terms([("glyph-ab-one", "r"), ("glyphs-x", "q"), ("glyph-ab-two", "r"), ("docs", "r"), ("about", "r"), ("worktrees", "")])
    assert bare == ["glyph-ab", "glyph-ab-one", "glyph-ab-two", "glyphs-x"] and "worktree-docs" in decorated and ("docs", "short") in refused


def test_composition(spark):
    texts = ["été", "plain", "Å", None, "", "한"]
    got = [r.t for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(composed(F.col("t")).alias("t")).collect()]
    assert got == ["été", "plain", "Å", None, "", "한"]
