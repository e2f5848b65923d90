"""Log sources: each takes (spark, paths) and returns the event relation. SOURCES keeps their order."""

from .jsonl import claude_code, codex, grok
from .whole import antigravity, cursor, gemini_cli

SOURCES = {"claude_code": claude_code, "codex": codex, "grok": grok, "gemini_cli": gemini_cli, "antigravity": antigravity, "cursor": cursor}
