"""Language by unigrams over word pieces, all segmentations summed.

Each language has a probability for every piece of a fixed public vocabulary. A word's probability is the sum, over all
ways to cut it into pieces, of the product of their probabilities, by the forward algorithm; training reestimates the
probabilities with forward and backward sums (ROUNDS of EM). All pieces of letters take part, of any length. Words are runs
of letters (Unicode category L) with the marks that follow them, lower-cased, behind the vocabulary's word mark; words of
more than LONGEST characters are taken in parts of LONGEST. A text's score for a language is the sum over its words.

Training takes whole texts of at most about `per_language` documents of each language, chosen by a hash of their id, and
the `languages` values of lang that most training rows have; both bounds are parameters. Languages are counted over all
training rows.

Defined cases. A null text, or one without a letter, is `und` with score 0. With no training row every text is. Repeated
rows are scored each. A language of null takes no part in training. Other columns are not looked at.
"""

from __future__ import annotations

import functools
import hashlib
import re
import sys
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from .common import U64, bounded

UNKNOWN = "und"
PER_LANGUAGE = 800
ROUNDS = 3
LONGEST = 40  # letters of a word taken at a time
LANGUAGES = 256  # learnt at most: the model has a row for each
STRAY = 1e-7  # of a character that no piece is
_MARK = "▁"
_FAST = re.compile(r"[^\W\d_]+")  # letters, and numerals such as a half
_MOST_WORDS = 200_000  # whose scores a worker keeps


def pieces_of(path: str) -> dict[str, int]:
    """The vocabulary's pieces that lower-cased words can hold, numbered."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    known = (model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)))
    fit = sorted({p for p in known if (b := p.removeprefix(_MARK)) == b.lower() and all(unicodedata.category(c)[0] in "LM" for c in b)})
    return {p: i for i, p in enumerate(fit)}


@functools.lru_cache(maxsize=1)
def _pattern() -> re.Pattern[str]:
    """Letters with the marks behind them, as one class of characters each: `re` knows no categories, and runs over classes fast."""

    def ranges(kinds: str) -> str:
        held = [i for i in range(sys.maxunicode + 1) if unicodedata.category(chr(i))[0] in kinds]
        first = [c for k, c in enumerate(held) if not k or held[k - 1] != c - 1]
        last = [c for k, c in enumerate(held) if k + 1 == len(held) or held[k + 1] != c + 1]
        return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in zip(first, last, strict=True))

    return re.compile(f"[{ranges('L')}][{ranges('LM')}]*")


def cut(text: str) -> list[str]:
    low = text.lower()
    plain = low.isascii() or int(np.frombuffer(low.encode("utf-32-le", "surrogatepass"), np.uint32).max()) < 0x300  # below the first mark
    words = _FAST.findall(low) if plain else []
    if not plain or words and not "".join(words).isalpha():
        words = _pattern().findall(low)
    return [w for x in words for w in ([x] if len(x) <= LONGEST else [x[i : i + LONGEST] for i in range(0, len(x), LONGEST)])]


class Finder:
    """Pieces by a 64-bit polynomial hash of their characters, in a table of open slots."""

    def __init__(self, pieces: dict[str, int]):
        self.mul = U64(0x9E3779B97F4A7C15)
        self.powers = np.cumprod(np.concatenate([[U64(1)], np.full(max([LONGEST, *map(len, pieces)]) + 1, self.mul)]))
        self.shift = U64(64 - 19)
        self.keys, self.ids = np.zeros(1 << 19, np.uint64), np.full(1 << 19, -1, np.int32)
        self.probes, self.longest = 1, max(map(len, pieces), default=1)
        for p, i in pieces.items():
            h = self.prefix(np.array([[ord(c) for c in p]], np.uint32))[0, -1]
            at, n = int(((np.array([h]) * self.mul) >> self.shift)[0]), 1
            while self.ids[at] >= 0:
                at, n = (at + 1) & (len(self.ids) - 1), n + 1
            self.keys[at], self.ids[at] = h, i
            self.probes = max(self.probes, n)

    def prefix(self, codes: np.ndarray) -> np.ndarray:
        """[word, n + 1] hashes of the first n characters."""
        out = np.zeros((codes.shape[0], codes.shape[1] + 1), np.uint64)
        for j in range(codes.shape[1]):
            out[:, j + 1] = out[:, j] * self.mul + codes[:, j].astype(np.uint64) + U64(1)
        return out

    def find(self, h: np.ndarray) -> np.ndarray:
        """Piece numbers, -1 where there is none."""
        at = ((h * self.mul) >> self.shift).astype(np.int64)
        out = np.where(self.keys[at] == h, self.ids[at], -1)
        for _ in range(1, self.probes):
            at = (at + 1) & (len(self.ids) - 1)
            out = np.where(self.keys[at] == h, self.ids[at], out)
        return out


def _lattices(words: list[str], finder: Finder) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Words by length: their places, and ids[length - 1, start, word] of pieces, -1 where there is none, -2 for a stray character."""
    by_length = defaultdict(list)
    for i, w in enumerate(words):
        by_length[len(w) + 1].append(i)
    for n, own in by_length.items():
        most = min(n, finder.longest)
        for at in range(0, len(own), 2048):
            part = own[at : at + 2048]
            codes = np.frombuffer("".join(_MARK + words[i] for i in part).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(part), n)
            sums = finder.prefix(codes).T
            ids = np.full((most, n, len(part)), -1, np.int32)
            for m in range(1, most + 1):
                ids[m - 1, : n - m + 1] = finder.find(sums[m:] - sums[: n - m + 1] * finder.powers[m])
            ids[0][ids[0] < 0] = -2
            yield np.array(part), ids


def _forward(ids: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """p[piece, language]: probabilities by piece, then those of a stray character, then 0. Returns the lattice's probabilities and forward sums."""
    most, n, w = ids.shape
    prob = p[ids]  # -1 is the last row, -2 the one before
    alpha = np.zeros((n + 1, w, p.shape[1]))
    alpha[0] = 1
    for a in range(n):
        for m in range(1, min(most, n - a) + 1):
            alpha[a + m] += alpha[a] * prob[m - 1, a]
    return prob, alpha


def _full(probs: np.ndarray) -> np.ndarray:
    return np.concatenate([probs.T, np.full((1, len(probs)), STRAY), np.zeros((1, len(probs)))])


def word_scores(words: list[str], finder: Finder, probs: np.ndarray) -> np.ndarray:
    """Natural log-probabilities [word, language]."""
    out, full = np.zeros((len(words), len(probs))), _full(probs)
    for own, ids in _lattices(words, finder):
        out[own] = np.log(np.maximum(_forward(ids, full)[1][-1], 1e-300))
    return out


def fitted(counts: dict[str, Counter], pieces: dict[str, int]) -> tuple[list[str], np.ndarray]:
    """Languages in order, and their piece probabilities, from word counts."""
    langs = sorted(counts)
    words = sorted(set().union(*counts.values())) if counts else []
    weights = np.array([[counts[x].get(w, 0) for x in langs] for w in words], dtype=np.float64).reshape(len(words), len(langs))
    size = max(1, len(pieces))
    probs = np.full((len(langs), size), 1.0 / size)
    lattices = list(_lattices(words, Finder(pieces)))
    for _ in range(ROUNDS):
        sums, full = np.zeros_like(probs), _full(probs)
        for own, ids in lattices:
            most, n, _ = ids.shape
            prob, alpha = _forward(ids, full)
            beta = np.zeros_like(alpha)
            beta[n] = weights[own] / np.maximum(alpha[n], 1e-300)
            for a in range(n - 1, -1, -1):
                for m in range(1, min(most, n - a) + 1):
                    beta[a] += prob[m - 1, a] * beta[a + m]
            for m in range(1, most + 1):
                at = ids[m - 1, : n - m + 1]
                held = at >= 0
                got = (alpha[: n - m + 1] * prob[m - 1, : n - m + 1] * beta[m:])[held]
                for j in range(len(langs)):
                    sums[j] += np.bincount(at[held], weights=got[:, j], minlength=size)
        shared = sums.sum(axis=0) + 0.1
        sums += 20.0 * shared / shared.sum() + 1e-3
        probs = sums / sums.sum(axis=1, keepdims=True)
    return langs, probs


def train(docs: DataFrame, training: Column, path: str, per_language: int = PER_LANGUAGE, languages: int = LANGUAGES) -> tuple[list[str], np.ndarray, dict[str, int]]:
    """docs: doc_id, text, lang; training: which rows may be learnt from. Shares are set by counts, so that each language gives about per_language documents or all it has."""
    pieces = pieces_of(path)
    rows = docs.where(training & F.col("lang").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(languages).collect()}
    if not sizes:
        return [], np.zeros((0, max(1, len(pieces)))), pieces
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)
    shares = docs.sparkSession.createDataFrame([(lang, min(1.0, per_language / n)) for lang, n in sizes.items()], "lang string, share double")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by = defaultdict(Counter)
        for batch in batches:
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                by[lang].update(cut(text or ""))
        out = [(x, w, n) for x, c in by.items() for w, n in c.items()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.string(), pa.string(), pa.int64()))], ["lang", "word", "n"])

    counts = defaultdict(Counter)
    for x in sizes:
        counts[x]  # a language whose sample is empty is still known
    few = rows.join(F.broadcast(shares), "lang").where(draw < F.col("share"))  # shares: `languages` rows at most
    got = few.select("text", "lang").mapInArrow(counted, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")).toArrow()
    for x, w, n in zip(*(got.column(i).to_pylist() for i in range(3)), strict=True):
        counts[x][w] = n
    return (*fitted(counts, pieces), pieces)


class _Scorer:
    def __init__(self, langs: list[str], probs: np.ndarray, pieces: dict[str, int]):
        self.langs, self.probs, self.finder = langs, probs, Finder(pieces)
        self.known: dict[str, int] = {}
        self.scores = np.zeros((0, len(langs)))

    def predict(self, texts: list[str]) -> tuple[list[str], list[float]]:
        split = [cut(t) for t in texts]
        new = list({w for words in split for w in words} - self.known.keys())
        if len(self.known) + len(new) > _MOST_WORDS:
            self.known, self.scores = {}, self.scores[:0]
            new = list({w for words in split for w in words})
        self.scores = np.concatenate([self.scores, word_scores(new, self.finder, self.probs)])
        at = len(self.known)
        self.known.update(zip(new, range(at, at + len(new)), strict=True))
        names, sure = [], []
        for words in split:
            if not words or not self.langs:
                names.append(UNKNOWN)
                sure.append(0.0)
                continue
            own = self.scores[np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))].sum(axis=0)
            best = int(own.argmax())
            names.append(self.langs[best])
            sure.append(float(1.0 / np.exp(own - own[best]).sum()))
        return names, sure


_SCORERS: dict[str, _Scorer] = {}


def predicted(docs: DataFrame, model: tuple[list[str], np.ndarray, dict[str, int]], text_col: str = "text") -> DataFrame:
    """The rows with lang_pred and score added (they replace columns of these names)."""
    langs, probs, pieces = model
    keys, table = list(pieces), probs.astype(np.float32)
    tag = hashlib.sha1(table.tobytes() + repr(langs).encode()).hexdigest()
    kept = bounded(docs).drop("lang_pred", "score")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if tag not in _SCORERS:
            _SCORERS.clear()
            _SCORERS[tag] = _Scorer(langs, table.astype(np.float64), {p: i for i, p in enumerate(keys)})
        scorer = _SCORERS[tag]
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text_col)).to_pylist()
            names, sure = [], []
            for at in range(0, len(texts), 512):
                a, b = scorer.predict([t or "" for t in texts[at : at + 512]])
                names += a
                sure += b
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names, pa.string()), pa.array(sure, pa.float64())], [*batch.schema.names, "lang_pred", "score"])

    return kept.mapInArrow(run, StructType([*kept.schema.fields, StructField("lang_pred", StringType()), StructField("score", DoubleType())]))
