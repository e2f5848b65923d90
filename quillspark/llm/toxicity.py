"""Toxicity by gradient-boosted trees over dense features, calibrated by isotonic regression.

Features are rates over a text's words and characters: densities of a fixed lexicon of insults and of a lexicon learnt
from labelled texts (whole words and word beginnings whose share among toxic texts is far above their share among
others), how near such words stand to a second person, capitals, punctuation, and obfuscation: letters replaced by
look-alikes (after undoing them the word is in a lexicon) and letters repeated.

Training takes at most about `bound` labelled rows, a parameter, chosen by a hash of their id and cut into three parts:
one gives the lexicon, two the trees; for the calibration each of the two is scored by trees of the other. The lexicon
holds all words and beginnings that pass, each of which is in three toxic texts of the sample or more, so that its size
hangs on `bound` and not on the corpus.

Defined cases. A null text counts as empty; empty texts have all rates 0 and are scored like any. Labels other than 0 and 1
take no part; several labels of a document are as many rows. Without both labels in training all scores are the share of toxic
rows (0 without rows). Repeated rows are scored each. Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import blocks, bounded, buffers, word_bounds, word_hashes

BOUND = 24_000
STEMS = (4, 5, 6)
TREES, DEPTH, RATE, BINS = 60, 3, 0.15, 32
NEAR = 5  # words
# Insults, and words for a second person, in English, German, French and Spanish.
INSULTS = """idiot moron stupid loser scum trash clown pathetic worthless disgusting dumb fool jerk creep imbecile garbage vermin filth
freak pig bastard bitch asshole retard dummkopf trottel depp arschloch abschaum dreck versager widerlich blöd dumm idiotin schwein
imbécile crétin stupide minable ordure débile connard salope dégoûtant pourriture raté idiota imbécil estúpido tonto basura asqueroso
patético inútil payaso escoria cabrón perdedor""".split()
SECOND = """you your yours yourself youre ur u du dich dir dein deine deinen deiner ihr euch euer tu te toi ton ta tes vous votre vos tú ti
contigo usted ustedes vos vosotros tus""".split()

_RUN = np.zeros(256, bool)  # what words are made of, look-alikes included
_RUN[48:58] = _RUN[65:91] = _RUN[97:123] = _RUN[128:] = True
_RUN[[ord(c) for c in "@$*"]] = True
_LOOKS = np.arange(256, dtype=np.uint8)
for _a, _b in ("@a", "4a", "0o", "1i", "3e", "$s", "5s", "7t", "*u"):
    _LOOKS[ord(_a)] = ord(_b)
_PUNCT = np.zeros(256, bool)
_PUNCT[33:48] = _PUNCT[58:65] = _PUNCT[91:97] = _PUNCT[123:127] = True
FEATURES = ("words", "chars_per_word", "fixed", "fixed_n", "learnt", "learnt_n", "stem", "stem_n", "near_second", "second", "capitals", "shouted", "exclaim", "question", "punct", "digits", "symbols", "looks", "looks_n", "repeats")


def _of(words: list[str]) -> np.ndarray:
    texts = [w.encode() for w in words]
    ends = np.cumsum([len(t) for t in texts])
    data = np.frombuffer(b"".join(texts), np.uint8)
    return np.sort(word_hashes(data, np.concatenate([[0], ends[:-1]]), ends))


_INSULTS, _SECOND = _of(INSULTS), _of(SECOND)


def _member(h: np.ndarray, held: np.ndarray) -> np.ndarray:
    if not len(held):
        return np.zeros(len(h), bool)
    at = np.minimum(np.searchsorted(held, h), len(held) - 1)
    return held[at] == h


def _beginnings(own: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for p in STEMS:
        long = np.flatnonzero(ends - starts > p)
        yield long, word_hashes(own, starts[long], starts[long] + p) ^ np.uint64(p)


def _rows(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    data, offsets = buffers(column)
    for a, b in blocks(offsets):
        own, off = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        yield (own, off, *word_bounds(own, off, _RUN))


def features(column: pa.Array, words: np.ndarray, stems: np.ndarray) -> np.ndarray:
    """[row, feature]; words and stems are the sorted hashes of the learnt lexicon."""
    out = []
    for own, off, starts, ends, firsts in _rows(column):
        per_row = lambda x: np.diff(np.concatenate([[0], np.cumsum(x, dtype=np.float64)])[firsts])  # noqa: B023, E731
        per_text = lambda x: np.diff(np.concatenate([[0], np.cumsum(x, dtype=np.float64)])[off])  # noqa: B023, E731
        inside = lambda x: (lambda s: s[ends] - s[starts])(np.concatenate([[0], np.cumsum(x, dtype=np.int64)]))  # noqa: B023, E731
        n, chars = np.diff(firsts), np.diff(off)
        h = word_hashes(own, starts, ends)
        fixed, learnt, second = _member(h, _INSULTS), _member(h, words), _member(h, _SECOND)
        stem = np.zeros(len(h), bool)
        for long, hs in _beginnings(own, starts, ends):
            stem[long] |= _member(hs, stems)
        upper = (own >= 65) & (own < 91)
        lower = (own >= 97) & (own < 123)
        digit = (own >= 48) & (own < 58)
        sign = np.isin(own, [ord(c) for c in "@$*"])
        letters, signs = inside(upper | lower | (own >= 128)), inside(digit | sign)
        mixed = (letters > 0) & (signs > 0)
        plain = word_hashes(_LOOKS[own], starts, ends)
        looks = mixed & (_member(plain, _INSULTS) | _member(plain, words)) & ~fixed & ~learnt
        again = np.zeros(len(own), bool)
        again[2:] = (own[2:] == own[1:-1]) & (own[1:-1] == own[:-2]) & (lower | upper)[2:]
        hit = fixed | learnt | stem | looks
        near = np.zeros(len(h), bool)
        if second.any() and hit.any():
            at = np.flatnonzero(second)
            row_of = np.repeat(np.arange(len(n)), n)
            i = np.searchsorted(at, np.arange(len(h)))
            for j in (np.minimum(i, len(at) - 1), np.maximum(i - 1, 0)):
                near |= (np.abs(at[j] - np.arange(len(h))) <= NEAR) & (row_of[at[j]] == row_of)
        w, c = np.maximum(n, 1), np.maximum(chars, 1)
        count = {"fixed": fixed, "learnt": learnt, "stem": stem, "looks": looks}
        got = {k: per_row(v) for k, v in count.items()}
        cols = {
            "words": np.log1p(n), "chars_per_word": chars / w, "near_second": per_row(hit & near) / w, "second": per_row(second) / w,
            "capitals": per_text(upper) / np.maximum(per_text(upper | lower), 1), "shouted": per_row((inside(upper) == ends - starts) & (ends - starts > 1)) / w,
            "exclaim": per_text(own == 33) / c, "question": per_text(own == 63) / c, "punct": per_text(_PUNCT[own]) / c, "digits": per_text(digit) / c,
            "symbols": per_row(mixed) / w, "repeats": per_row(inside(again) > 0) / w,
        }
        for k, v in got.items():
            cols[k], cols[f"{k}_n"] = v / w, v
        out.append(np.stack([cols[f] for f in FEATURES], axis=1))
    return np.concatenate(out) if out else np.zeros((0, len(FEATURES)))


# --- trees -----------------------------------------------------------------------------------


def boosted(x: np.ndarray, y: np.ndarray) -> tuple[float, list[tuple[np.ndarray, np.ndarray, np.ndarray]]]:
    """Log-odds to start from, and trees of full depth: split features, thresholds (x > t goes right), leaf values."""
    start = float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], axis=1)
    score, trees = np.full(len(y), start), []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-score))
        g, h = y - p, p * (1 - p)
        node = np.zeros(len(y), np.int64)
        splits, cuts = np.zeros(2**DEPTH - 1, np.int64), np.full(2**DEPTH - 1, np.inf)
        for depth in range(DEPTH):
            width, base = 2**depth, 2**depth - 1
            best = np.full(width, 1e-6)
            for f, e in enumerate(edges):
                if not len(e):
                    continue
                key = node * (BINS + 1) + binned[:, f]
                gs, hs = (np.bincount(key, weights=v, minlength=width * (BINS + 1)).reshape(width, -1) for v in (g, h))
                gl, hl = gs.cumsum(1)[:, : len(e)], hs.cumsum(1)[:, : len(e)]
                gt, ht = gs.sum(1, keepdims=True), hs.sum(1, keepdims=True)
                gain = gl**2 / (hl + 1) + (gt - gl) ** 2 / (ht - hl + 1) - gt**2 / (ht + 1)
                gain[(hl < 0.3) | (ht - hl < 0.3)] = 0
                at = gain.argmax(1)
                for k in np.flatnonzero(gain[np.arange(width), at] > best):
                    best[k], splits[base + k], cuts[base + k] = gain[k, at[k]], f, e[at[k]]
            node = 2 * node + (x[np.arange(len(y)), splits[base + node]] > cuts[base + node])
        gs, hs = (np.bincount(node, weights=v, minlength=2**DEPTH) for v in (g, h))
        leaves = RATE * gs / (hs + 1)
        score = score + leaves[node]
        trees.append((splits, cuts, leaves))
    return start, trees


def margins(model: tuple[float, list[tuple[np.ndarray, np.ndarray, np.ndarray]]], x: np.ndarray) -> np.ndarray:
    start, trees = model
    out = np.full(len(x), start)
    every = np.arange(len(x))
    for splits, cuts, leaves in trees:
        node = np.zeros(len(x), np.int64)
        for depth in range(DEPTH):
            at = 2**depth - 1 + node
            node = 2 * node + (x[every, splits[at]] > cuts[at])
        out += leaves[node]
    return out


def isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: steps (upper ends of score, calibrated shares)."""
    order = np.argsort(score, kind="stable")
    blocks_: list[list[float]] = []
    for s, v in zip(score[order], y[order], strict=True):
        blocks_.append([float(v), 1.0, float(s)])
        while len(blocks_) > 1 and (blocks_[-2][0] * blocks_[-1][1] >= blocks_[-1][0] * blocks_[-2][1] or blocks_[-2][2] == blocks_[-1][2]):
            total, n, end = blocks_.pop()
            blocks_[-1] = [blocks_[-1][0] + total, blocks_[-1][1] + n, end]
    return np.array([b[2] for b in blocks_]), np.array([b[0] / b[1] for b in blocks_])


def calibrated(steps: tuple[np.ndarray, np.ndarray], score: np.ndarray) -> np.ndarray:
    """Linear between the steps' ends, so that the order of scores mostly stays."""
    ends, shares = steps
    return np.clip(np.interp(score, ends, shares), 0.0, 1.0) if len(ends) else np.zeros(len(score))


# --- training and scoring --------------------------------------------------------------------


def train(docs: DataFrame, labels: DataFrame, training: Column, bound: int = BOUND) -> dict:
    """docs: doc_id, text; labels: doc_id, toxic; training: which doc_ids may be learnt from."""
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where(training & F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull())
    n, toxic = rows.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    model = {"words": np.zeros(0, np.uint64), "stems": np.zeros(0, np.uint64), "share": toxic / n if n else 0.0}
    if not 0 < toxic < n:
        return model
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(3 << 28))
    few = rows.where(draw < min(1.0, bound / n) * (3 << 28)).withColumn("third", draw % 3)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(few), "doc_id")  # few: of at most about `bound` rows

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y = batch.column(1).to_numpy()
            at = 0
            for data, off, starts, ends, firsts in _rows(batch.column(0)):
                seen = [(np.arange(len(starts)), word_hashes(data, starts, ends), 0)] + [(i, h, 1) for i, h in _beginnings(data, starts, ends)]
                row_of = np.repeat(np.arange(len(off) - 1), np.diff(firsts))
                for places, h, stem in seen:
                    pairs = np.unique(np.stack([row_of[places].astype(np.uint64), h]), axis=1)
                    hit = y[at + pairs[0].astype(np.int64)]
                    k, back = np.unique(pairs[1], return_inverse=True)
                    bad = np.bincount(back, weights=hit, minlength=len(k)).astype(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(k.view(np.int64)), pa.array(np.full(len(k), stem, np.int32)), pa.array(bad), pa.array(np.bincount(back, minlength=len(k)).astype(np.int64) - bad)], ["key", "stem", "bad", "good"])
                at += len(off) - 1

    third = lambda k: own.where(F.col("third") == k).select("text", "toxic")
    seen = few.where("third = 0").agg(F.sum("toxic"), F.count("*")).first()
    if seen[0] and seen[1] > seen[0]:
        odds = F.log((F.col("bad") + 0.5) / (seen[0] + 1)) - F.log((F.col("good") + 0.5) / (seen[1] - seen[0] + 1))
        found = third(0).mapInArrow(keys, "key long, stem int, bad long, good long").groupBy("key", "stem").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
        found = found.where((F.col("bad") >= max(3, seen[0] // 250)) & (odds >= 2.5)).select("key", "stem").collect()
        for name, kind in (("words", 0), ("stems", 1)):
            model[name] = np.sort(np.array([r["key"] for r in found if r["stem"] == kind], np.int64).view(np.uint64))
    words, stems = model["words"], model["stems"]

    def dense(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = features(batch.column(0), words, stems)
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(list(x), pa.list_(pa.float64()))], ["toxic", "x"])

    halves = []
    for k in (1, 2):
        got = third(k).mapInArrow(dense, "toxic int, x array<double>").toArrow()
        x = np.array(got.column("x").to_pylist(), dtype=np.float64).reshape(-1, len(FEATURES))
        y = got.column("toxic").to_numpy().astype(np.float64)
        order = np.lexsort((*x.T, y))  # the same rows train the same trees, in whatever order they came
        halves.append((x[order], y[order]))
    if all(0 < y.sum() < len(y) for _, y in halves):
        (x1, y1), (x2, y2) = halves
        model["trees"] = boosted(np.concatenate([x1, x2]), np.concatenate([y1, y2]))
        unseen = np.concatenate([margins(boosted(x2, y2), x1), margins(boosted(x1, y1), x2)])
        model["steps"] = isotonic(unseen, np.concatenate([y1, y2]))
    return model


def scored(docs: DataFrame, model: dict, text_col: str = "text") -> DataFrame:
    """doc_id and score of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if "trees" not in model:
                score = np.full(batch.num_rows, model["share"])
            else:
                score = margins(model["trees"], features(batch.column(1), model["words"], model["stems"]))
                score = calibrated(model["steps"], score) if "steps" in model else 1 / (1 + np.exp(-score))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score, pa.float64())], ["doc_id", "score"])

    own = bounded(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return own.mapInArrow(run, "doc_id long, score double")
