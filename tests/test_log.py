import json
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from quillspark.functions import clean as C
from quillspark.functions import commands as X
from quillspark.functions import paths as P
from quillspark.functions import tokens as T
from quillspark.functions import when
from quillspark.functions.fold import composed
from quillspark.operators import documents as D
from quillspark.operators import events as E
from quillspark.operators import facets as B
from quillspark.operators import identities as I
from quillspark.operators import wrapped as Y
from quillspark.sources import corpus, demo

REPO = Path(__file__).parent.parent


def one(spark, text, f):
    return spark.createDataFrame([(text,)], "t string").select(f(F.col("t")).alias("x")).first()["x"]


@pytest.mark.parametrize(("cmd", "head", "sub"), [
    ("FOO=1 /usr/bin/git commit", "git", None), ("git commit -m x", "git", "git commit"), ("git -C /srv/x status", "git", None), ("rg foo", "rg", None), ("npm run-script", "npm", "npm run-script"),
    ("docker 'compose' up", "docker", "docker compose"), ("(cd", "cd", None), ("A=1", None, None), ("", None, None), (None, None, None), ("go", "go", None), ("git ./x", "git", None),
])
def test_commands(spark, cmd, head, sub):
    if cmd == "FOO=1 /usr/bin/git commit":
        sub = None  # the word after the assignment is a path
    assert (one(spark, cmd, X.argv_head), one(spark, cmd, X.subcommand)) == (head, sub)


@pytest.mark.parametrize(("text", "want"), [("see src/a.PY", "py"), ("notes.md", "md"), ("help.example", "example"), ("help.etoro", None), ("https://x.y/z.js", None), ("a/b.etoro", "etoro"), ("Makefile", None), ("", None), (None, None), ("x.abcdefgh", None)])
def test_extensions(spark, text, want):
    assert one(spark, text, X.file_extension) == want


@pytest.mark.parametrize(("ts", "zone", "day", "hour"), [
    ("2026-08-01T22:30:00Z", "Asia/Jerusalem", "2026-08-02", 1), ("2026-08-01T22:30:00Z", "America/Los_Angeles", "2026-08-01", 15), ("2026-08-01T22:30:00", "Asia/Jerusalem", "2026-08-01", 22),
    ("2026-08-02", "Asia/Jerusalem", "2026-08-02", None), ("2026-08-02 rubbish", "UTC", "2026-08-02", None), ("2026-13-02 rubbish", "UTC", None, None), ("", "UTC", None, None), (None, "UTC", None, None),
])
def test_local_times(spark, ts, zone, day, hour):
    got = spark.createDataFrame([(ts,)], "t string").select(when.local_date(F.col("t"), zone).cast("string").alias("d"), when.local_hour(F.col("t"), zone).alias("h")).first()
    assert (got.d, got.h) == (day, hour)


@pytest.mark.parametrize(("cwd", "want"), [
    ("/w/ferry/.claude/worktrees/b", "ferry"), ("/w/ferry/.worktrees/b/src", "ferry"), ("/home/y/.codex/worktrees/1860/ferry", "ferry"), ("/h/x/.codex/worktrees/1860/ferry", "x"), ("/Users/x/conductor/workspaces/ferry/zurich", "ferry"), ("/private/tmp/x", "tmp"), ("/var/folders/a", "tmp"),
    ("/", "unknown"), ("", "unknown"), (None, "unknown"), ("/Users/x", "~"), ("/Users/x/", "~"), ("/Users/x/Projects/demo", "demo"), ("/srv/worktrees/1860", "unknown"), ("/tmpfiles/a", "a"), ("/Users/y/.worktrees/cafe", "cafe"),
])
def test_project_labels(spark, cwd, want):
    assert one(spark, cwd, lambda c: P.project_from_cwd(c, home="/Users/x")) == want


def test_encoded_folders(spark, tmp_path):
    assert one(spark, "-Users-x-Projects-my-web-app", P.decoded_dashes) == "/Users/x/Projects/my-web-app"
    assert one(spark, "-Users-x-Projects-ferry--claude-worktrees-arm-b", P.decoded_dashes) == "/Users/x/Projects/ferry/.claude/worktrees/arm-b"
    assert one(spark, "-Users-x-Projects-ferry--claude-worktrees-arm-b", P.project_from_encoded) == "ferry"
    assert one(spark, "%2FUsers%2Fx%2Fmy-app", P.project_from_encoded) == "my-app" and one(spark, "--", P.project_from_encoded) == "unknown"
    known = {"/a", "/a/my-web", "/a/my-web/app-x", "/a/my-web/app-x/.hid"}
    assert I.decode_dash_path("-a-my-web-app-x--hid", known.__contains__) == "/a/my-web/app-x/.hid"
    assert I.decode_dash_path("-a-b-c-d-e", set().__contains__) == "/a/b/c/d-e" and I.decode_dash_path("-") == "unknown"


def test_linked_worktrees_are_their_repositories(spark, tmp_path):
    admin = tmp_path / "ferry" / ".git" / "worktrees" / "loop"
    admin.mkdir(parents=True)
    (admin / "HEAD").write_text("ref: refs/heads/main_writer\n")
    beside = tmp_path / "ferry-loop" / "src"
    beside.mkdir(parents=True)
    (tmp_path / "ferry-loop" / ".git").write_text(f"gitdir: {admin}\n")
    assert I.linked_worktree(str(beside)) == (str(tmp_path / "ferry"), "main_writer") and I.linked_worktree(str(tmp_path / "ferry")) is None
    assert [tuple(r) for r in I.worktree_labels(spark, [str(beside)]).collect()] == [(str(beside), "ferry", "main_writer")]


def test_old_labels_are_repaired(spark):
    events = spark.createDataFrame([("ferry--claude-worktrees-native-ota",), ("loop-writer",), ("secret-thing",), ("keep",)], "project string")
    branches = spark.createDataFrame([("loop-writer", "ferry"), ("native-ota", "")], "branch string, repo string")
    assert [r.project for r in I.relabelled(events, branches, ["secret-thing"]).collect()] == ["ferry", "ferry", "redacted", "keep"]
    assert sorted((r.label, r.branch, r.repo) for r in I.project_labels(events).where("branch is not null").collect()) == [("ferry--claude-worktrees-native-ota", "native-ota", "ferry")]


def test_identities_from_configuration(tmp_path):
    user = '; mine\n[user]\n  name = Jane Doe\n  email = 71827484+jdoe@users.noreply.github.com\n'
    repo = '[core]\n bare = false\n[remote "origin"]\n url = git@github.com:janecorp/thing.git\n[remote "x"]\n url = https://github.com/the/y\n'
    assert I.git_config(repo)[1] == ("remote", "origin", "url", "git@github.com:janecorp/thing.git") and I.remote_owners(repo) == ["janecorp", "the"]
    accepted, refused = I.derived("/Users/janed/", [user], [repo])
    assert accepted == ["doe", "jane", "jane doe", "janecorp", "janed", "jdoe"] and refused == [("the", "short")]
    (tmp_path / "r.txt").write_text("# note\n\nriver\nriver\nstone \n")
    assert I.read_redact_file(str(tmp_path / "r.txt")) == ["river", "stone"] and I.read_redact_file(str(tmp_path / "none")) == []
    assert D.write_sidecar({"identities": ["river"], "branch_repos": {"cargo-engine": "ferry"}, "explicit": "no list"}, str(tmp_path / "redact.json")) is None
    old = I.read_sidecar(str(tmp_path / "redact.json"))
    every, by = I.redaction([], old, ["Stone"])
    assert by["explicit"] == ["stone"] and "cargo-engine" in by["branches"] and {"river", "worktree-cargo-engine"} <= set(every)
    assert I.redaction([], old, mode="off")[0] == ["river"] and I.redaction([], old, mode="decorated")[1]["branches"] == []
    assert I.read_sidecar(str(tmp_path / "r.txt")) == {} and I.unmasked("a river runs", ["river", "stone"]) == ["river"]


def test_literals_and_labels(spark):
    assert one(spark, "cargo_engine-notes", lambda c: C.hits(c, ["cargo-engine"])) and not one(spark, "driver", lambda c: C.hits(c, ["river"]))
    assert [one(spark, t, lambda c: C.scrub_label(c, ["cargo-engine"])) for t in ("cargo-engine", "keep")] == ["redacted", "keep"]


def test_tokens_of_other_scripts(spark):
    assert one(spark, "naïve שלום עולם привет, это мир 漢字 don't 12", T.tokens) == ["naïve", "שלום", "עולם", "привет", "мир"]
    assert one(spark, "función", composed) == "función" and one(spark, "función", T.tokens) == ["función"] and one(spark, None, composed) is None
    assert one(spark, "привет мир", T.phrases) == ["привет мир"] and one(spark, "abcשלום", T.raw_tokens) == ["abc", "שלום"]


def test_a_long_run_of_words_does_not_exhaust_the_stack(spark):
    assert len(one(spark, "word " * 50_000, T.words_and_pairs)) == 99_999


EVENT = "seq long, ts string, tool string, session_id string, project string, role string, kind string, text string, tool_name string, cmd string, tokens long, prose string, confidence string"


def event(seq, kind, text="", tool="codex", project="p", ts="2026-08-01T10:00:00Z", role=None, **more):
    role = role or {"prompt": "user", "reply": "assistant"}.get(kind, "assistant")
    return {"seq": seq, "ts": ts, "tool": tool, "session_id": "s", "project": project, "role": role, "kind": kind, "text": text, "tool_name": None, "cmd": None, "tokens": None, "prose": text if kind in ("prompt", "reply") else "", "confidence": "exact", **more}


def test_near_duplicates_count_once_in_each_slice(spark):
    same = "please perform the careful analysis again now {}"
    rows = [event(1, "prompt", same.format("alpha")), event(2, "prompt", same.format("beta"), tool="grok"), event(3, "prompt", same.format("gamma")), event(4, "prompt", "12 34"), event(5, "reply", "analysis analysis", ts=None), event(6, "tool_call", "a.py", cmd="git status", tokens=7)]
    df = spark.createDataFrame(rows, EVENT)
    got = {(r.scope, r.member, r.facet, r.t): r.n for r in B.facet_terms(df).collect()}
    assert got["global", "all", "prose_user", "analysis"] == 1 and got["tool", "grok", "prose_user", "beta"] == 1 and ("global", "all", "prose_user", "beta") not in got
    assert got["global", "all", "prose_user_raw", "analysis"] == 3 and got["global", "all", "prose_assistant", "analysis"] == 1 and got["month", "unknown", "prose_assistant", "analysis"] == 1
    assert got["tool", "codex", "commands", "git status"] == got["global", "all", "commands", "git"] == got["project", "p", "extensions", "py"] == got["global", "all", "tools", "unknown"] == 1
    counts = {(r.scope, r.member): r for r in B.facet_counts(df).collect()}
    assert (counts["global", "all"].events, counts["global", "all"].prompts, counts["global", "all"].llm_tokens, counts["global", "all"].sessions) == (6, 3, 7, 2)
    assert B.facet_terms(df.limit(0)).count() == 0
    safe = {r.t for r in B.done(B.sliced(df), ["status"]).where("facet = 'commands'").collect()}
    assert safe == {"git"}


def test_habits_and_volume(spark):
    same = "kindly check the whole build once more {}"
    rows = [event(i, "prompt", same.format(i)) for i in range(3)] + [event(10 + i, "prompt", f"{w} swap polling loop", project=f"q{i % 2}") for i, w in enumerate(("one", "now", "again", "later"))] + [event(20, "prompt", "thanks " * 300)]
    prompts = Y.prompt_rows(B.sliced(spark.createDataFrame(rows, EVENT)))
    got = Y.numbers(prompts).first()
    assert (got.words_to_ai, got.prompts, got.human_prompts, got.days_active) == (3 * 8 + 4 * 4 + 300, 8, 7, 1)
    assert [(r.t, r.n, r.projects) for r in Y.signature(prompts, 1).collect()] == [("polling loop", 4, 2)]
    assert {r.family: r.n for r in Y.emotions(prompts).collect()}["thanks"] == 0
    terms = spark.createDataFrame([("a/b", 9), (".x", 8), ("fine", 7), ("", 6), ("good", 5)], "t string, n int")
    assert [r.t for r in Y.first_shareable(terms, 1, F.desc("n")).collect()] == ["fine"]


def test_prices_of_a_file(spark, tmp_path):
    row = {"pattern": "new-model", "input": 1.0, "output": 2.0, "cache_read": 0.1, "cache_write": 0.0, "cached_input": 0.1}
    (tmp_path / "p.json").write_text(json.dumps({"models": [row, {"input": 3}]}, indent=1))
    (tmp_path / "q.json").write_text(json.dumps([row]))
    assert [E.prices(spark, str(tmp_path / f)).collect() for f in ("p.json", "q.json")] == [[("new-model", 1.0, 2.0, 0.1, 0.0, 0.1)]] * 2


def test_calls_are_matched_without_meeting_all_of_them(spark):
    calls = spark.createDataFrame([(1, 1, "a"), (1, 5, "b"), (2, 9, "c")], "k int, i int, call string")
    results = spark.createDataFrame([(1, 0), (1, 3), (1, 5), (2, 4)], "k int, i int")
    assert sorted((r.k, r.i, r.call) for r in E.matched_calls(results, calls, ["k"], "i", "call").collect()) == [(1, 0, None), (1, 3, "a"), (1, 5, "b"), (2, 4, None)]


def test_demo_corpus_round_trip_and_report(spark, tmp_path):
    own = demo.events(spark, 300)
    rows = own.collect()
    assert rows == demo.events(spark, 300).repartition(3).orderBy("line").collect() and [r.ts for r in rows] == sorted(r.ts for r in rows)
    assert len({r.tool for r in rows}) == 4 and len({r.project for r in rows}) >= 5 and len({r.ts[:7] for r in rows}) >= 3
    assert all(r.usage is None and r.model is None and not r.ts_exact for r in rows if r.tool == "grok")
    assert all(r.tokens == sum(r.usage) for r in rows if r.usage)
    D.write_events(own, str(tmp_path / "events"))
    (tmp_path / "events" / "more.json").write_text('{torn\n\n[1]\n{"tool": "x", "tokens": "many"}\n')
    back, lines = corpus.read_events(spark, str(tmp_path / "events"))
    assert back.count() == 301 and tuple(lines.first()) == (303, 2)
    assert back.where("tool = 'x' and tokens is null").count() == 1
    assert back.where("tool <> 'x'").orderBy("line").select("ts", "usage", "text").collect() == own.orderBy("line").select("ts", "usage", "text").collect()
    assert corpus.pruned(own, ["codex"]).select("tool").distinct().count() == 1 and corpus.pruned(own, limit=0).count() == 0


def test_sources_are_found_read_and_reported(spark, tmp_path):
    from quillspark.sources import SOURCES
    from quillspark.sources.jsonl import bad_lines

    place = tmp_path / ".codex" / "archived_sessions"
    place.mkdir(parents=True)
    (place / "a.jsonl").write_text(json.dumps({"type": "event_msg", "timestamp": "2026-01-01T00:00:00Z", "payload": {"type": "user_message", "message": "hello"}}) + "\n{torn\n")
    (place / "b.jsonl").write_text("{torn\n")
    paths = corpus.discover(spark, str(tmp_path), "codex")
    assert [p.rpartition("/")[2] for p in paths] == ["archived_sessions"] and corpus.discover(spark, str(tmp_path), "grok") == []
    got = corpus.report(spark, SOURCES["codex"](spark, paths), {"codex": corpus.files(spark, paths, "codex")}, {"codex": bad_lines(spark, paths)})
    assert tuple(got.first()) == ("codex", 2, 1, 1, 2, 1)
    assert corpus.warnings(got) == ["codex: 1 files and 2 lines could not be read"]


def test_vocabulary_and_snapshots(spark, tmp_path):
    terms = [("prose_user", f"word{i}x", 9) for i in range(400)] + [("prose_user", "hapax", 1), ("prose_user", "river-x", 9), ("prose_user", "a.tsx", 9), ("tools", "once", 1)]
    facets = spark.createDataFrame([("global", "all", f, t, n) for f, t, n in terms], "scope string, member string, facet string, t string, n long")
    gated = D.gated(facets, ["river"])
    assert tuple(D.gate_report(gated).first()) == (404, 401, 1, 1, 1)
    D.write_vocabulary(gated, str(tmp_path / "vocab"))
    assert spark.read.json(str(tmp_path / "vocab")).count() == 401
    page, stats = tmp_path / "p.html", tmp_path / "s.json"
    page.write_text("<html>")
    stats.write_text("{}")
    assert [Path(p).name for p in D.copy_snapshot(str(page), str(tmp_path / "snaps"), "2026-01-01-0000", "before it", str(stats))] == ["lexicon-2026-01-01-0000-before-it.html", "lexicon-2026-01-01-0000-before-it.stats.json"]
    assert [Path(p).name for p in D.copy_snapshot(str(page), str(tmp_path / "snaps"), "2026-01-01-0000", statistics_path=str(stats), shareable=True)] == ["lexicon-2026-01-01-0000-shareable.html"]


def test_the_rest_stands_without_the_corpus_operators(tmp_path):
    """A copy without the folders and the file that may be deleted still has the other queries."""
    tracked = subprocess.run(["git", "ls-files", "-co", "--exclude-standard"], cwd=REPO, capture_output=True, text=True, check=True).stdout.split()
    for name in tracked:
        if name.endswith(".py") and not name.startswith(("quillspark/llm/", "tests/")) and name != "corpus_pipeline.py" and (REPO / name).exists():
            (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
            (tmp_path / name).write_text((REPO / name).read_text())
    code = "import __spark_entry__ as e; q = e.queries(); print(len(q), any(k.startswith('op1_') for k in q), 'pipeline' in q, set(e.oracle_sql()) <= set(q))"
    got = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, check=True).stdout.split()
    assert int(got[0]) > 60 and got[1:] == ["False", "False", "True"]


def test_a_document_is_scrubbed_in_all_its_parts():
    from quillspark.operators import share

    document = {
        "generated_at": "now", "clouds": {"global": {"prose_user": [{"t": "fine", "n": 3}, {"t": "a.tsx", "n": 2}, {"t": "secretrepo", "n": 1}], "tools": [{"t": "mcp__a__shot", "n": 7}, {"t": "mcp__b__shot", "n": 6}, {"t": "mcp__onlytwoparts", "n": 1}], "errors": [{"t": "x", "n": 1}]}, "by_project": {"secretrepo": {}}, "by_month": {}},
        "trends": {"rising": [{"t": "janedoe-thing", "n": 1}, {"t": "good", "n": 1}]}, "wrapped": {"top_words": [["fine", 3], ["http://x", 2]], "top_phrase": "secretrepo rocks", "rising_word": "good"},
        "activity": {"top_projects": [{"t": "other-repo", "n": 1}], "session_lengths": [{"t": "s1", "n": 1}]}, "spend": {"estimates_note": "list prices"},
    }
    before = json.dumps(document)
    got, report = share.shared(document, ["janedoe"])
    assert json.dumps(document) == before and got["share_mode"] and share.names_of(document) == ["other-repo", "secretrepo"]
    assert got["clouds"]["global"] == {"prose_user": [{"t": "fine", "n": 3}], "tools": [{"t": "mcp:shot", "n": 13}, {"t": "mcp__onlytwoparts", "n": 1}], "errors": [{"t": share.NOTICE, "n": 0}]}
    assert got["clouds"]["by_project"] == {} and got["trends"]["rising"] == [{"t": "good", "n": 1}] and got["wrapped"] == {"top_words": [["fine", 3]], "rising_word": "good"}
    assert got["activity"] == {"top_projects": [{"t": "project 01", "n": 1}], "session_lengths": [{"t": "session 01", "n": 1}]} and got["spend"]["estimates_note"].startswith("list prices · ")
    assert report == {"terms_dropped": 5, "facets_dropped": 4}


def test_blocks_within_blocks_are_flattened(spark, tmp_path):
    from quillspark.sources import SOURCES

    blocks = [{"type": "tool_result", "tool_use_id": "t", "content": [{"type": "text", "text": "one"}, "two", {"content": [{"text": "three"}, {"content": "four"}]}, {"x": 1}]}]
    (tmp_path / "a.jsonl").write_text(json.dumps({"type": "user", "sessionId": "s", "timestamp": "2026-01-01T00:00:00Z", "message": {"content": blocks}}))
    assert [r.text for r in SOURCES["claude_code"](spark, str(tmp_path)).collect()] == ["one\ntwo\nthree\nfour"]


def test_workspaces_and_envelopes(spark, tmp_path):
    import sqlite3

    from quillspark.sources import SOURCES
    from quillspark.sources.whole import unreadable

    (tmp_path / "ws").mkdir()
    (tmp_path / "ws" / "workspace.json").write_text(json.dumps({"folder": "file:///Users/x/Projects/my%20app"}))
    db = sqlite3.connect(tmp_path / "ws" / "state.vscdb")
    db.execute("create table ItemTable(key text, value blob)")
    db.execute("insert into ItemTable values ('composer.composerData', ?)", (json.dumps({"allComposers": [{"composerId": "c2"}]}),))
    db.commit()
    db = sqlite3.connect(tmp_path / "state.vscdb")
    db.execute("create table cursorDiskKV(key text, value blob)")
    rows = {"composerData:c1": {"createdAt": 1, "workspaceIdentifier": {"uri": {"fsPath": "/w/ferry"}}}, "bubbleId:c1:a": {"type": 1, "text": "q1"}, "composerData:c2": {"createdAt": 1}, "bubbleId:c2:a": {"type": 1, "text": "q2"},
            "composerData:c3": {"createdAt": 1}, "bubbleId:c3:a": {"type": 1, "text": "q3", "workspaceProjectDir": "/h/.cursor/projects/-Users-x-Projects-cedar"}, "composerData:c4": {"createdAt": 1}, "bubbleId:c4:a": {"type": 1, "text": "q4"}, "bubbleId:c4:b": {"type": 2, "text": "a4", "workspaceUris": ["file:///w/birch"]}}
    db.executemany("insert into cursorDiskKV values (?, ?)", [(k, json.dumps(v)) for k, v in rows.items()])
    db.commit()
    assert {r.session_id: r.project for r in SOURCES["cursor"](spark, str(tmp_path)).collect()} == {"c1": "ferry", "c2": "my app", "c3": "cedar", "c4": "birch"}

    def packed(*texts):
        return b"".join(bytes([10, len(t)]) + t for t in (x.encode() for x in texts))

    (tmp_path / "conv").mkdir()
    db = sqlite3.connect(tmp_path / "conv" / "c.db")
    db.execute("create table steps(idx integer, step_type integer, step_payload blob)")
    db.execute("create table trajectory_metadata_blob(data blob)")
    db.execute("insert into trajectory_metadata_blob values (?)", (packed("some note here", "file:///Users/x/Projects/maple"),))
    db.executemany("insert into steps values (?, ?, ?)", [(1, 14, packed("123e4567-e89b-12d3-a456-426614174000-is-not", "please look at it", "sessionId: 12345678")), (2, 15, packed('{"message": "inner words"}', "short")), (3, 21, packed('{"CommandLine": "ls -l"}'))])
    db.commit()
    (tmp_path / "conv" / "torn.db").write_bytes(b"no database")
    got = SOURCES["antigravity"](spark, str(tmp_path / "conv")).orderBy("line").collect()
    assert [(r.kind, r.text, r.cmd, r.project) for r in got][1:] == [("thinking", "inner words", None, "maple"), ("tool_call", '{"CommandLine": "ls -l"}', "ls -l", "maple")]
    assert sorted((r.file.rpartition("/")[2], r.bad) for r in unreadable(spark, str(tmp_path / "conv"), "*.db", "steps").collect()) == [("c.db", False), ("torn.db", True)]


def test_the_whole_document_of_a_corpus(spark, tmp_path):
    from quillspark.operators import share
    from quillspark.plans import analyze

    events = demo.events(spark, 700)
    got = analyze.statistics(spark, events, zone="Asia/Jerusalem", literals=["copper-finch"], generated_at="2026-08-25T00:00:00Z")
    rows = events.collect()
    assert list(got) == D.SECTIONS and len(json.dumps(got)) < 4_000_000
    assert got["source_events"] == got["totals"]["events"] == 700 == sum(c["events"] for c in got["coverage"].values()) and set(got["coverage"]) == {r.tool for r in rows}
    assert got["totals"]["prompts"] == sum(r.kind == "prompt" for r in rows) == sum(got["activity"]["per_day"].values()) == sum(got["activity"]["hour_histogram"].values())
    assert sum(got["spend"]["tokens"].values()) == sum(r.tokens for r in rows if r.tokens) and got["spend"]["tools_without_usage"] == ["grok"] and got["spend"]["total_cost"] > 0
    assert "copper-finch" not in json.dumps(got) and "redacted" in got["clouds"]["by_project"] and len(got["clouds"]["by_month"]) >= 5
    cloud = got["clouds"]["global"]
    assert {d["t"]: d["n"] for d in cloud["commands"]}["git"] == sum(r.kind == "tool_call" and r.cmd.startswith("git") for r in rows) and cloud["errors"][0]["n"] > 0
    assert got["wrapped"]["politeness"]["please"] > 0 and got["wrapped"]["top_tool"]["name"] == "claude_code" and got["wrapped"]["longest_streak_days"] > 0
    D.write_json(got, str(tmp_path / "stats.json"))
    public, report = share.shared(json.loads((tmp_path / "stats.json").read_text()))
    assert public["clouds"]["by_project"] == {} and "amber-kettle" not in json.dumps(public) and report["facets_dropped"] > 3
    empty = analyze.statistics(spark, events.limit(0))
    assert empty["totals"]["events"] == 0 and empty["wrapped"]["words_to_ai"] == 0 and empty["trends"] == {"rising": [], "fading": []}
