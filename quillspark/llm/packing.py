"""Packing tokenised documents into fixed-length sequences: best-fit decreasing, certified by dual feasible functions.

Documents become pieces of at most `capacity` token ids (only longer documents are cut). Pieces are dealt to partitions of
about PART pieces; each runs best-fit decreasing. The sum of a dual feasible function over a partition's sizes, divided by
its bound, never exceeds the bins that any packing needs, so a partition whose bin count equals the best such sum is
certified: by itself it can gain nothing. A partition with a gap releases all of its loose bins, and a certified one those
that its pieces' sum alone does not need, since others' pieces may fill them; the released pieces are dealt anew to
partitions of about PART and packed again, until nothing is loose, one partition has held all of them, or a round takes as many bins as were
released, in which case these stay as they were. Each piece carries the certificate of the partition that placed it:
part_bins, the bins of that partition, and part_bound, the fewest that any packing of its pieces needs.

Defined cases. A null or empty text is its end id alone. Repeated rows are packed as often as they come; null ids are
carried along. An empty table gives no rows. Other columns are not looked at. Texts of any length are taken whole.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, bounded, buffers, dropped, mark, stored, word_hashes

CAPACITY = 4096
END_ID = 1
PART = 8192
SLACK = 32  # free places from which a bin is worth releasing
_MOST_UNITS = 1_000_000  # kept by a worker, some 40 MB; then it starts anew
_SPECIAL = (b"<|startoftext|>", b"<|endoftext|>")
_KIND = np.full(256, 2, np.uint8)  # 0: white space, 1: ASCII letter, 2: other ASCII, 8: apostrophe or part of a longer character
_KIND[[9, 10, 11, 12, 13, 32]] = 0
_KIND[65:91] = _KIND[97:123] = 1
_KIND[128:] = _KIND[39] = 8
_SPELLED: dict[str, Spelled] = {}
_LOADED: dict[str, object] = {}


# --- tokens ----------------------------------------------------------------------------------


def tokenizer(path: str):
    if path not in _LOADED:
        from tokenizers import Tokenizer

        _LOADED[path] = Tokenizer.from_file(path)
    return _LOADED[path]


class Spelled:
    """Token ids by unit of text, each distinct unit encoded once.

    The vocabulary drops white space, lower-cases, and never merges across white space or between an ASCII letter and
    another ASCII character that is no apostrophe, so a text's ids are those of its units between such places. A text
    that names a special token is encoded whole. Units are known by a 64-bit hash.
    """

    def __init__(self, path: str):
        self.path = path
        self.clear()

    def clear(self) -> None:
        self.hashes = np.zeros(0, np.uint64)  # sorted
        self.slots = np.zeros(0, np.int64)
        self.ids = [np.zeros(0, np.uint32)]
        self.counts = [np.zeros(0, np.int64)]
        self.size = 0

    def _learn(self, hashes: np.ndarray, words: list[str]) -> None:
        counts, ids, at = [], [], 0
        while at < len(words):
            part = words[at : at + 2000]
            got = tokenizer(self.path).encode(" ".join(part), add_special_tokens=False)
            lens = np.fromiter(map(len, part), np.int64, len(part))
            ends = np.cumsum(lens + 1)
            starts = np.array(got.offsets, dtype=np.int64).reshape(-1, 2)[:, 0]
            counts.append(np.diff(np.searchsorted(starts, ends, side="left"), prepend=0))
            ids.append(np.array(got.ids, dtype=np.uint32))
            at += 2000
        self.ids.append(np.concatenate(ids))
        self.counts.append(np.concatenate(counts))
        slots = self.size + np.arange(len(hashes))
        self.size += len(hashes)
        into = np.searchsorted(self.hashes, hashes)
        self.hashes, self.slots = np.insert(self.hashes, into, hashes), np.insert(self.slots, into, slots)
        self.flat, counted = np.concatenate(self.ids), np.concatenate(self.counts)
        self.ids, self.counts = [self.flat], [counted]
        self.offsets = np.concatenate([[0], np.cumsum(counted)])

    def rows(self, data: np.ndarray, offsets: np.ndarray) -> Iterator[np.ndarray]:
        """The ids of each row of a block of UTF-8 texts."""
        kind = _KIND[data]
        solid = kind > 0
        first = solid.copy()
        first[1:] &= (kind[:-1] == 0) | (kind[1:] + kind[:-1] == 3)  # 1 beside 2: a letter beside another ASCII character
        edge = offsets[1:-1]
        edge = edge[(edge > 0) & (edge < len(data))]
        first[edge] = solid[edge]
        last = solid.copy()
        last[:-1] &= ~solid[1:] | first[1:]
        starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        firsts = np.searchsorted(starts, offsets)
        units, where, back = np.unique(word_hashes(data, starts, ends), return_index=True, return_inverse=True)
        at = np.searchsorted(self.hashes, units)
        known = at < len(self.hashes)
        known[known] = self.hashes[at[known]] == units[known]
        if not known.all():
            if self.size > _MOST_UNITS:
                self.clear()
                known[:] = False
            raw = data.tobytes()
            self._learn(units[~known], [raw[starts[i] : ends[i]].decode("utf-8", "replace") for i in where[~known]])  # lower-casing is left to the tokenizer, whose rules differ from Python's
        if not len(units):
            yield from (np.zeros(0, np.uint32) for _ in range(len(offsets) - 1))
            return
        slots = self.slots[np.searchsorted(self.hashes, units)][back]
        sizes = self.offsets[slots + 1] - self.offsets[slots]
        ends_at = np.cumsum(sizes)
        ids = self.flat[np.repeat(self.offsets[slots] - (ends_at - sizes), sizes) + np.arange(ends_at[-1])]
        bounds = np.concatenate([[0], ends_at])[firsts]
        for i in range(len(offsets) - 1):
            yield ids[bounds[i] : bounds[i + 1]]


def token_ids(column: pa.Array, path: str) -> Iterator[np.ndarray]:
    """Ids of each text of a column (null: none)."""
    known = _SPELLED.setdefault(path, Spelled(path))
    data, offsets = buffers(column)
    for a, b in blocks(offsets):
        own = data[offsets[a] : offsets[b]]
        raw = own.tobytes()
        special = any(x in raw for x in _SPECIAL)
        for i, ids in enumerate(known.rows(own, offsets[a : b + 1] - offsets[a])):
            if special:
                text = own[offsets[a + i] - offsets[a] : offsets[a + i + 1] - offsets[a]].tobytes()
                if any(x in text for x in _SPECIAL):
                    ids = np.array(tokenizer(path).encode(text.decode(), add_special_tokens=False).ids, np.uint32)
            yield ids


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, and a salt that spreads pieces evenly."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            out: list[tuple] = []
            for i, (doc, ids) in enumerate(zip(whole.column(0).to_pylist(), token_ids(whole.column(1), path), strict=True)):
                ids = np.append(ids, np.uint32(END_ID)).astype("<u4")
                for k, start in enumerate(range(0, len(ids), capacity)):
                    own = ids[start : start + capacity].tobytes()
                    crc = zlib.crc32(own)
                    out.append((doc, k, start, len(own) // 4, crc, xxhash.xxh64_intdigest(f"{doc} {k} {i} {crc}") >> 1))
            if out:
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "salt"]
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names)

    own = bounded(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return own.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, salt long")


# --- bins ------------------------------------------------------------------------------------


def lower_bound(sizes: np.ndarray, capacity: int) -> int:
    """The best bound over two families of dual feasible functions, on integers: u (sizes over C - e count as C, under e as 0) and floor((k + 1) x / C) / k where it is no whole multiple."""
    if not len(sizes):
        return 0
    x = np.asarray(sizes, dtype=np.int64)
    best = -(-int(x.sum()) // capacity)
    for e in np.unique(np.minimum(x, capacity - x)):
        if 0 < e <= capacity // 2:
            best = max(best, -(-int(np.where(x > capacity - e, capacity, np.where(x >= e, x, 0)).sum()) // capacity))
    for k in range(1, 21):
        whole, rest = np.divmod((k + 1) * x, capacity)
        best = max(best, -(-int(np.where(rest == 0, x * k, whole * capacity).sum()) // (capacity * k)))
    return best


def best_fit(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Best-fit decreasing: each size's bin and place in it, and the number of bins."""
    bins, places = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    open_rooms, n = 0, 0  # a bit for each room that some bin has
    for i in np.argsort(-np.asarray(sizes), kind="stable"):
        size = int(sizes[i])
        fits = open_rooms >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                open_rooms ^= 1 << room
        else:
            b, room, n = n, capacity, n + 1
        bins[i], places[i] = b, capacity - room
        if room > size:
            by_room[room - size].append(b)
            open_rooms |= 1 << (room - size)
    return bins, places, n


def _packed(capacity: int, last: bool, turn: int):
    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["length", "salt"], ascending=False, kind="stable").reset_index(drop=True)
        sizes = part["length"].to_numpy()
        bins, places, n = best_fit(sizes, capacity)
        bound = lower_bound(sizes, capacity)
        room = capacity - np.bincount(bins, weights=sizes, minlength=n)
        free = np.zeros(n, bool)
        if not last and n * capacity > sizes.sum() + SLACK and not (n == bound and room.max() <= SLACK):
            free = room > SLACK
            if n == bound and -(-(n * capacity - int(room.sum())) // capacity) < bound:
                free[:] = False  # sizes themselves need these bins, not chance
        base = (turn << 48) + (int(part["part"].iat[0]) << 24)
        return part.assign(sequence_id=base + bins, offset=places, part_bins=n, part_bound=bound, free=free[bins])

    return run


def packed(docs: DataFrame, path: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset, part_bins, part_bound for every piece of every document."""
    since = mark()
    left = stored(pieces(docs, path, capacity, id_col, text_col), "pieces")
    parts, bins = max(1, -(-left.count() // PART)), None
    done, turn = None, 0
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, salt long, part long, sequence_id long, offset long, part_bins long, part_bound long, free boolean"
    while True:
        dealt = left.select("doc_id", "piece", "start", "length", "ids_crc32", "salt", F.pmod(F.xxhash64("salt", F.lit(turn)), F.lit(parts)).alias("part"))
        ran = stored(dealt.groupBy("part").applyInPandas(_packed(capacity, parts == 1, turn), schema), "packed")
        gained = bins is None or ran.select("sequence_id").distinct().count() < bins
        kept = (ran.where("not free") if gained else left).drop("salt", "part", "free")
        done = kept if done is None else done.unionByName(kept)
        if not gained:
            break
        left = ran.where("free")
        bins, most = left.agg(F.countDistinct("sequence_id"), F.count("*")).first()
        if not bins:
            break
        parts, turn = -(-most // PART), turn + 1
    out = stored(done, "sequences")
    dropped(docs.sparkSession, since, keep=1)
    return out
