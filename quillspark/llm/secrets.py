"""Secrets in text: named patterns, and strings that a public token vocabulary spells badly.

A byte-pair vocabulary covers prose with few tokens, random strings with many. A candidate is a run of LEAST or more of
`[A-Za-z0-9+/_=-]`; it is a `random` span if its characters per token stay under RATIO. Before that, known digests (hex of
a usual digest's length) and identifiers are set aside: UUIDs, numbers, and names, paths and versions, whose parts between
- _ / = + are words (few changes of case, and spelled well if long) with up to four digits behind them, or numbers of up to
14 digits. A run that named spans cover whole is theirs; one that reaches beyond them is judged as a whole, and its span
stands beside theirs. Named kinds: assign, access and hex, see PATTERNS.

Defined cases. A null text counts as empty: no spans. Repeated rows are each scanned. Texts of any length are taken whole,
in time proportional to it. Other columns, whatever their names, are not looked at, and redacted() returns them as they are.
Positions are code points, ends exclusive.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded

KINDS = ("assign", "access", "hex", "random")
LEAST, RATIO = 20, 1.9
_FLAGS = re.ASCII
# The named patterns and the lengths from which a match counts.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", _FLAGS | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")  # a shorter run has no longer one inside it
HEX = re.compile(r"[0-9a-f]{16,}")
ASSIGN_LEAST = 12
NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")
DIGESTS = (32, 40, 56, 64, 96, 128)

_CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % LEAST)
_HEXED = re.compile(r"[0-9a-fA-F]+")
_UUID = re.compile(r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}")
_PARTS = re.compile(r"[-_/=+]+")
_WORD = re.compile(r"([A-Za-z]+)\d{0,4}|\d{1,14}", _FLAGS)
_CASED = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")
LONG_WORD = 12  # letters from which a word of an identifier must be spelled well itself
_ENCODERS: dict[str, object] = {}


def encoder(path: str):
    if path not in _ENCODERS:
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _ENCODERS[path] = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _ENCODERS[path]


def _ratio(run: str, path: str) -> float:
    return len(run) / len(encoder(path).encode_ordinary(run))


def _identifier(run: str, path: str) -> bool:
    for part in filter(None, _PARTS.split(run)):
        word = _WORD.fullmatch(part)
        if not word:
            return False
        if letters := word[1]:
            if len(letters) < 3 * len(_CASED.findall(letters)) and len(letters) > 3 or len(letters) >= LONG_WORD and _ratio(letters, path) < RATIO:
                return False
    return True


def improbable(run: str, path: str) -> bool:
    """Whether a run of characters is random by its characters per token."""
    if run.isdigit() or _UUID.fullmatch(run) or _HEXED.fullmatch(run) and len(run) in DIGESTS:
        return False
    return _ratio(run, path) < RATIO and not _identifier(run, path)


def find(text: str, path: str) -> list[tuple[int, int, int]]:
    """(start, kind's number, end) of all spans of a text, in order."""
    spans = []
    low = text.lower()
    if any(name in low for name in NAMES):
        spans += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    if "AKIA" in text:
        spans += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    spans += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    spans.sort()
    named, i, reach = len(spans), 0, 0  # reach: how far named spans that begin before a place cover without a gap
    for m in _CANDIDATE.finditer(text):
        while i < named and spans[i][0] <= max(m.start(), reach):
            reach = max(reach, spans[i][2])
            i += 1
        if reach < m.end() and improbable(m[0], path):
            spans.append((m.start(), 3, m.end()))
    return sorted(spans)


def secret_spans(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and its spans: array of (kind, start, end, secret)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("secret", pa.string())]))
        for batch in batches:
            found = [[{"kind": KINDS[k], "start": a, "end": b, "secret": t[a:b]} for a, k, b in find(t, path)] for t in batch.column(1).fill_null("").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, kind)], ["doc_id", "spans"])

    own = bounded(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return own.mapInArrow(run, "doc_id long, spans array<struct<kind: string, start: long, end: long, secret: string>>")


def redacted(docs: DataFrame, path: str, text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """The same rows and columns, each secret's characters replaced by a mark (overlapping spans by one). A null text stays null."""

    def clean(text: str) -> str:
        out, at = [], 0
        for a, _, b in find(text, path):
            if a >= at:
                out += [text[at:a], mark]
            at = max(at, b)
        return "".join([*out, text[at:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            i = batch.schema.get_field_index(text_col)
            texts = [t if t is None else clean(t) for t in batch.column(i).to_pylist()]
            yield batch.set_column(i, batch.schema.field(i), pa.array(texts, batch.column(i).type))

    return bounded(docs).mapInArrow(run, docs.schema)


def digests(spans: DataFrame) -> DataFrame:
    """What a report on spans holds: counts by kind, a digest of the named kinds' places, and all places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [s or [] for s in batch.column(1).to_pylist()]
            counts = [pa.array([sum(x["kind"] == k for x in s) for s in rows], pa.int64()) for k in KINDS]
            places = [[f"{x['kind']}:{x['start']}:{x['end']}" for x in s] for s in rows]
            base = [hashlib.sha256(",".join(p for p in s if not p.startswith("random")).encode()).hexdigest() for s in places]
            yield pa.RecordBatch.from_arrays([batch.column(0), *counts, pa.array(base, pa.string()), pa.array([",".join(s) for s in places], pa.string())], ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    return spans.mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, n_random long, base_sha256 string, spans string")
