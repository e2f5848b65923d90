import json
import sqlite3

from quillspark import sources as S
from quillspark.sources.jsonl import bad_lines
from quillspark.sources.protobuf import strings


def put(path, records):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join(r if isinstance(r, str) else json.dumps(r) for r in records))
    return str(path.parent)


def events(df):
    return [r.asDict(recursive=True) for r in df.orderBy("file", "line", "sub").collect()]


def test_claude_code_bills_a_message_once(spark, tmp_path):
    u = {"input_tokens": 12, "output_tokens": 340, "cache_read_input_tokens": 20000, "cache_creation_input_tokens": 1500}
    d = put(tmp_path / "p" / "a.jsonl", [
        {"type": "user", "sessionId": "s", "timestamp": "2026-01-01T10:00:00Z", "cwd": "/home/x/ferry", "message": {"content": "hello there"}},
        {"type": "assistant", "sessionId": "s", "message": {"id": "m", "model": "claude-opus-5", "usage": u, "content": [{"type": "thinking", "thinking": "hm"}, {"type": "text", "text": "hi"}, {"type": "tool_use", "id": "t1", "name": "Bash", "input": {"command": "ls"}}]}},
        {"type": "assistant", "sessionId": "s", "message": {"id": "m", "usage": u, "content": [{"type": "text", "text": "more"}]}},
        {"type": "user", "sessionId": "s", "message": {"content": [{"type": "tool_result", "tool_use_id": "t1", "is_error": True, "content": [{"type": "text", "text": "Exit code 1"}]}]}},
        {"type": "mode"}, "{torn", "",
    ])
    got = events(S.claude_code(spark, d))
    assert [e["kind"] for e in got] == ["prompt", "thinking", "reply", "tool_call", "reply", "error"]
    assert [e["usage"] is not None for e in got] == [False, True, False, False, False, False]
    assert got[1]["usage"] == {"input": 12, "output": 340, "cache_read": 20000, "cache_write": 1500}
    assert (got[3]["cmd"], got[5]["tool_name"], got[5]["text"], got[0]["project"]) == ("ls", "Bash", "Exit code 1", "ferry")
    assert bad_lines(spark, d).first()["bad"] == 1


def test_codex_differences_running_counters(spark, tmp_path):
    def tokens(i, c, o, t):
        return {"type": "event_msg", "payload": {"type": "token_count", "info": {"total_token_usage": {"input_tokens": i, "cached_input_tokens": c, "output_tokens": o, "total_tokens": t}}}}

    d = put(tmp_path / "a.jsonl", [
        tokens(1000, 0, 100, 1100), {"type": "session_meta", "payload": {"id": "s", "cwd": "/w/ferry"}}, {"type": "turn_context", "payload": {"model": "gpt-5.6-terra"}},
        {"type": "event_msg", "payload": {"type": "user_message", "message": "do it"}}, tokens(3000, 800, 250, 3250), tokens(3000, 800, 250, 3250),
        {"type": "response_item", "payload": {"type": "function_call", "name": "shell", "call_id": "c", "arguments": json.dumps({"command": ["bash", "-lc", "git status"]})}},
        {"type": "response_item", "payload": {"type": "function_call_output", "call_id": "c", "output": "error: exit 1"}},
        {"type": "turn_context", "payload": {"model": "gpt-5.4-mini"}}, tokens(5000, 1800, 400, 5400),
    ])
    got = events(S.codex(spark, d))
    used = [e for e in got if e["usage"]]
    assert [(e["usage"]["input"], e["usage"]["cache_read"], e["usage"]["output"], e["tokens"], e["model"]) for e in used] == [(1000, 0, 100, 1100, "gpt-5.6-terra"), (1200, 800, 150, 2150, "gpt-5.6-terra"), (1000, 1000, 150, 2150, "gpt-5.4-mini")]
    assert [(e["kind"], e["cmd"], e["tool_name"]) for e in got if e["kind"] in ("tool_call", "error")] == [("tool_call", "git status", "shell"), ("error", None, "shell")]
    assert {e["session_id"] for e in got} == {"s"}


def test_grok_takes_prompt_times_from_the_history(spark, tmp_path):
    put(tmp_path / "%2FUsers%2Fx%2Fdemo" / "prompt_history.jsonl", [{"timestamp": "2026-02-01T08:00:00Z", "session_id": "s1", "prompt": "build it"}])
    put(tmp_path / "%2FUsers%2Fx%2Fdemo" / "s1" / "chat_history.jsonl", [
        {"type": "user", "content": "build it"}, {"type": "user", "content": "ctx", "synthetic_reason": "x"}, {"type": "assistant", "content": "ok", "tool_calls": [{"id": "c", "function": {"name": "bash"}}]}, {"type": "tool_result", "tool_call_id": "c", "content": "done"},
    ])
    got = events(S.grok(spark, str(tmp_path)))
    assert [(e["kind"], e["ts_exact"]) for e in got] == [("prompt", True), ("meta", False), ("reply", False), ("tool_call", False), ("tool_result", False)]
    assert (got[0]["ts"], got[0]["project"], got[4]["tool_name"]) == ("2026-02-01T08:00:00.000Z", "demo", "bash")


def test_gemini_usage_and_calls(spark, tmp_path):
    d = put(tmp_path / "session-1.json", [{"sessionId": "s", "projectHash": "0123456789", "startTime": "2026-01-01T00:00:00Z", "messages": [{"type": "user", "content": "hey"}, {"type": "gemini", "content": "yo", "model": "gemini-3-pro", "tokens": {"input": 8000, "output": 400, "cached": 6000, "thoughts": 100, "tool": 0}, "toolCalls": [{"name": "ls", "args": {"p": 1}, "result": "x"}, {"name": "rm", "args": {}, "result": None}]}]}])
    got = events(S.gemini_cli(spark, d))
    assert [e["kind"] for e in got] == ["prompt", "reply", "tool_call", "tool_result", "tool_call"]
    assert got[1]["usage"] == {"input": 2000, "output": 500, "cache_read": 6000, "cache_write": 0}
    assert got[0]["project"] == "gemini:01234567"


def test_cursor_and_antigravity_databases(spark, tmp_path):
    db = sqlite3.connect(tmp_path / "state.vscdb")
    db.execute("create table cursorDiskKV(key text, value blob)")
    rows = {"composerData:c": {"createdAt": 1767225600000, "modelConfig": {"modelName": "gpt-5"}, "fullConversationHeadersOnly": [{"bubbleId": "b2"}, {"bubbleId": "b1"}]}, "bubbleId:c:b1": {"type": 2, "text": "answer", "tokenCount": {"inputTokens": 5, "outputTokens": 7}}, "bubbleId:c:b2": {"type": 1, "text": "ask"}, "bubbleId:c:b3": {"type": 2, "capabilityType": 15, "toolFormerData": {"name": "run", "status": "error", "rawArgs": '{"command": "ls"}'}}}
    db.executemany("insert into cursorDiskKV values (?, ?)", [*((k, json.dumps(v)) for k, v in rows.items()), ("bubbleId:c:bad", "{torn"), ("bubbleId:c:nul", None)])
    db.commit()
    got = events(S.cursor(spark, str(tmp_path)))
    assert [(e["kind"], e["model"]) for e in got] == [("prompt", "gpt-5"), ("reply", "gpt-5"), ("tool_call", "gpt-5"), ("error", "gpt-5")]
    assert got[1]["usage"]["output"] == 7 and got[2]["cmd"] == "ls"
    text = "please fix the build now".encode()
    blob = bytes([26, len(text) + 2, 10, len(text)]) + text
    assert strings(blob) == [("3.1", text.decode())] and strings(bytes(range(128, 168))) == []
    db = sqlite3.connect(tmp_path / "conv.db")
    db.execute("create table steps(idx integer, step_type integer, step_payload blob)")
    db.executemany("insert into steps values (?, ?, ?)", [(1, 14, blob), (2, 999, blob)])
    db.commit()
    assert [(e["kind"], e["confidence"], e["text"]) for e in events(S.antigravity(spark, str(tmp_path)))] == [("prompt", "heuristic", text.decode()), ("meta", "heuristic", text.decode())]
