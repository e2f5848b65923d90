"""Texts in protocol-buffer bytes without their schema."""

from __future__ import annotations

from collections.abc import Iterator

# How deep and how far to look, and what counts as text.
DEPTH, FIELDS, LEAST = 12, 20_000, 8


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while at < len(data) and shift < 70:
        byte = data[at]
        value |= (byte & 127) << shift
        at, shift = at + 1, shift + 7
        if byte < 128:
            return value, at
    raise ValueError("torn varint")


def _text(raw: bytes) -> str | None:
    try:
        t = raw.decode("utf-8")
    except UnicodeDecodeError:
        return None
    shown = sum(c.isprintable() or c in "\n\r\t" for c in t)
    return t if len(t) >= LEAST and shown >= 0.9 * len(t) and sum(map(str.isalpha, t)) > 0.3 * len(t) else None


def fields(data: bytes) -> list[tuple[int, int, bytes]] | None:
    """(number, wire kind, payload) of a whole message, or None if the bytes are none."""
    out, at = [], 0
    try:
        while at < len(data):
            key, at = _varint(data, at)
            number, kind = key >> 3, key & 7
            if not number or kind not in (0, 1, 2, 5):
                return None
            start = at
            if kind == 0:
                _, at = _varint(data, at)
            elif kind == 2:
                size, start = _varint(data, at)
                at = start + size
            else:
                at += 8 if kind == 1 else 4
            if at > len(data):
                return None
            out.append((number, kind, data[start:at]))
    except ValueError:
        return None
    return out


def strings(data: bytes | None) -> list[tuple[str, str]]:
    """(path of field numbers, text) in order; a field that reads as a message with texts is one, else it may be a text."""
    left = FIELDS

    def walk(raw: bytes, path: str, depth: int) -> Iterator[tuple[str, str]]:
        nonlocal left
        for number, kind, part in fields(raw) or ():
            left -= 1
            if left < 0:
                return
            if kind != 2:
                continue
            here = f"{path}.{number}" if path else str(number)
            text = _text(part)
            inner = list(walk(part, here, depth + 1)) if depth < DEPTH else []
            if inner:
                yield from inner
            elif text is not None:
                yield here, text

    return list(walk(bytes(data or b""), "", 0))
