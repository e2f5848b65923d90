"""Language-model scores of texts: a log-bilinear model over word symbols, trained with noise-contrastive estimation.

Words are `[^\\x20\\x09-\\x0D]+` after A-Z are lower-cased, then one end per text. The most frequent words are
symbols of their own, twice the square root of the training tokens of them (HEAD at least); every other word belongs to
one of CLASSES shapes (length, last character, kind of accents), which is its symbol. The model predicts a symbol from the
two before it: the context's vectors, each scaled by its position's vector, are summed and multiplied with the targets'
vectors. A softmax normalises over the HEAD first words, the shapes, the end and groups of up to GROUP of the other words,
whose shape is one; inside the group a second softmax over its words' vectors does. A rarer word inside its shape has the probability (c + 0.5) / (N + 0.5 (V + 1)), with c its count, N and V the shape's words and distinct words in
training. Scores are log10 sums.

Counts are exact over all training texts and grow with them. Frequent words' counts (TABLE at most) go to every task; a
rarer word's count reaches its text through a join on the word's 64-bit hash. The symbol model learns from all training
texts: about `sample` of them, chosen by a hash of their id, give the common start on the driver; from there each task
goes through all of its texts, and each row of the parameters becomes the tasks' mean, weighted by the steps that they
took on it. How rows lie in partitions therefore has an influence on the scores, as any order of training has.

Defined cases. A null or empty text is one end. Repeated rows are scored each. A null doc_id is in no fold: neither held
out nor learnt from. Without training rows N is 0 and the symbol model is uniform. Other columns are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import blocks, bounded, buffers, dropped, mark, single_threaded, stored, word_bounds, word_hashes

HEAD = 250
LENGTHS, LASTS, ACCENTS = 5, 4, 5
CLASSES = LENGTHS * LASTS * ACCENTS
END = HEAD + CLASSES
START = END + 1
SYMBOLS = END + 1  # without the other words: their symbols follow START, and as targets their groups follow END
GROUP = 256
GROWTH = 2
TABLE = 100_000
SAMPLE = 800
WIDTH, NOISE, INNER, EPOCHS, BATCH = 16, 64, 2, 3, 1024
RATE = 0.1
STEP = 512  # contexts in a batch of matrix products: the scores of a batch stay in a core's cache
HELD = 1 << 18  # targets that a task puts in random order at a time
PARTS = ("context", "target", "place", "word")
_HALF = math.log10(0.5)

_LAST = np.zeros(256, np.int64)  # 0 letter, 1 full stop and the like, 2 comma and the like, 3 other
_LAST[: 128] = 3
_LAST[65:91] = _LAST[97:123] = 0
_LAST[[ord(c) for c in ".!?"]] = 1
_LAST[[ord(c) for c in ",;:"]] = 2
_ACCENT = np.zeros(256, np.uint8)  # second bytes of two-byte letters, by the languages that use them most; the largest in a word counts
_ACCENT[0x80:] = 1
_ACCENT[[0xB1, 0xAD, 0xB3, 0xA1, 0xBA]] = 2
_ACCENT[[0xA8, 0xA9, 0xAA, 0xA7, 0xA0]] = 3
_ACCENT[[0xA4, 0xB6, 0xBC, 0x9F]] = 4


def shapes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The shape class of each word of a text (starts rise)."""
    length = np.searchsorted([3, 5, 7, 10], ends - starts, side="left")
    accent = np.maximum.reduceat(_ACCENT[data], starts).astype(np.int64) if len(starts) else np.zeros(0, np.int64)  # white space has none
    return (length * LASTS + _LAST[data[ends - 1]]) * ACCENTS + accent


@dataclass
class Words:
    """The words beyond the head that are symbols, those of a group beside one another: count and group of each, each group's first (and the end)."""

    count: np.ndarray
    group: np.ndarray
    first: np.ndarray

    def __post_init__(self) -> None:
        self.units = np.concatenate([np.arange(START + 1), SYMBOLS + self.group])

    def unit(self, symbol: np.ndarray) -> np.ndarray:
        """What the first softmax chooses for a symbol."""
        return self.units[symbol]


NO_WORDS = Words(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(1, np.int64))


@dataclass
class Counts:
    """What all tasks need of the training counts. hashes is sorted; symbol is -1 for words that are no symbols."""

    hashes: np.ndarray
    counts: np.ndarray
    symbol: np.ndarray
    class_tokens: np.ndarray
    class_words: np.ndarray
    tokens: int
    distinct: int
    texts: int
    words: Words

    def __post_init__(self) -> None:
        n = len(self.hashes)
        self.shift = np.uint64(64 - max(1, (4 * n).bit_length()))
        self.first = np.searchsorted(self.hashes >> self.shift, np.arange((1 << (64 - int(self.shift))) + 1, dtype=np.uint64)).astype(np.int32)
        self.probes = int(np.diff(self.first).max(initial=0))

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of hashes in the table, and whether they are there: their top bits say where to look."""
        at, known = np.zeros(len(hashes), np.int32), np.zeros(len(hashes), bool)
        if len(self.hashes):
            start = self.first[(hashes >> self.shift).astype(np.int64)]
            for k in range(self.probes):
                here = np.minimum(start + k, len(self.hashes) - 1)
                hit = self.hashes[here] == hashes
                at[hit] = here[hit]
                known |= hit
        return at, known


def _word_counts(docs: DataFrame) -> DataFrame:
    """word (its hash), shape, n over all texts. Each task sums what it has seen, up to a million words, before it sends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []

        def merged() -> tuple[np.ndarray, ...]:
            words, first, back = np.unique(np.concatenate([h[0] for h in held]), return_index=True, return_inverse=True)
            shape = np.concatenate([h[1] for h in held])[first]
            n = np.bincount(back, weights=np.concatenate([h[2] for h in held]), minlength=len(words))
            return words, shape, n.astype(np.int64)

        def sent() -> pa.RecordBatch:
            words, shape, n = merged()
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(shape.astype(np.int32)), pa.array(n)], ["word", "shape", "n"])

        for batch in batches:
            data, offsets = buffers(batch.column(0))
            for a, b in blocks(offsets):
                own = data[offsets[a] : offsets[b]]
                starts, ends, _ = word_bounds(own, offsets[a : b + 1] - offsets[a])
                if len(starts):
                    words, first, n = np.unique(word_hashes(own, starts, ends), return_index=True, return_counts=True)
                    held.append((words, shapes(own, starts, ends)[first], n))
                    if sum(len(h[0]) for h in held) > 1_000_000:
                        held[:] = [merged()]
                        if len(held[0][0]) > 1_000_000:
                            yield sent()
        if held:
            yield sent()

    parts = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "word long, shape int, n long")
    return parts.groupBy("word").agg(F.min("shape").alias("shape"), F.sum("n").alias("n"))


def _gathered(counts: DataFrame, texts: int) -> Counts:
    step = F.floor(F.log2("n") * 8)
    steps = counts.groupBy(step.alias("step")).agg(F.count("*").alias("words"), F.sum("n").alias("n")).orderBy(F.desc("step")).collect()
    tokens, distinct = sum(r["n"] for r in steps), sum(r["words"] for r in steps)
    own = max(HEAD, GROWTH * math.isqrt(tokens))
    least, total = None, 0
    for r in steps:
        total += r["words"]
        if total > TABLE and total - r["words"] >= own:
            break
        least = r["step"]
    often = counts.where(step >= least) if least is not None else counts.limit(0)
    got = often.select("word", "shape", "n").toArrow()
    words, shape, n = (got.column(i).to_numpy() for i in range(3))
    order = np.lexsort((words, -n))[:own]
    symbol = np.full(len(words), -1, np.int64)
    symbol[order[:HEAD]] = np.arange(len(order[:HEAD]))
    more = order[HEAD:]
    more = more[np.lexsort((words[more], -n[more], shape[more]))]
    symbol[more] = START + 1 + np.arange(len(more))
    _, first, sizes = np.unique(shape[more], return_index=True, return_counts=True)
    first = np.concatenate([*(np.arange(a, a + m, GROUP) for a, m in zip(first, sizes, strict=True)), [len(more)]]).astype(np.int64)
    grouped = Words(n[more], np.repeat(np.arange(len(first) - 1), np.diff(first)), first)
    by_class = counts.groupBy("shape").agg(F.sum("n").alias("n"), F.count("*").alias("words")).collect()
    class_tokens, class_words = np.zeros(CLASSES), np.zeros(CLASSES)
    for r in by_class:
        class_tokens[r["shape"]], class_words[r["shape"]] = r["n"], r["words"]
    np.subtract.at(class_tokens, shape[order], n[order])
    np.subtract.at(class_words, shape[order], 1)
    hashes = words.view(np.uint64)
    by_hash = np.argsort(hashes)
    return Counts(hashes[by_hash], n[by_hash], symbol[by_hash], class_tokens, class_words, tokens + texts, distinct + (texts > 0), texts, grouped)


# --- the symbol model ------------------------------------------------------------------------


def _symbols(own: np.ndarray, offsets: np.ndarray, counts: Counts):
    """Of a block: per word its symbol, shape, whether that is its symbol, count if in the table or else -1, hash; each row's first word."""
    starts, ends, firsts = word_bounds(own, offsets)
    hashes = word_hashes(own, starts, ends)
    at, known = counts.find(hashes)
    shape = shapes(own, starts, ends) if len(starts) else np.zeros(0, np.int64)
    symbol = np.where(known, counts.symbol[at], -1) if len(counts.hashes) else np.full(len(hashes), -1)
    count = np.where(known, counts.counts[at], -1) if len(counts.hashes) else np.full(len(hashes), -1)
    return np.where(symbol >= 0, symbol, HEAD + shape), shape, symbol < 0, count, hashes, firsts


def _chains(symbol: np.ndarray, firsts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Targets with their two contexts for all rows, ends included, and each row's first target."""
    rows = len(firsts) - 1
    target = np.insert(symbol, firsts[1:], END)
    begin = firsts[:-1] + np.arange(rows)
    one, two = np.roll(target, 1), np.roll(target, 2)
    one[begin] = START
    two[begin] = START
    later = begin + 1
    later = later[later < len(target)]
    inside = later[target[later - 1] != END]
    two[inside] = START
    return target, one, two, begin


def _inside(words: Words) -> np.ndarray:
    """The share that each word has in its group."""
    return words.count / np.bincount(words.group, weights=words.count, minlength=len(words.first) - 1)[words.group]


def _begun(unigram: np.ndarray, words: Words, seed: int = 7) -> tuple[dict[str, np.ndarray], dict[str, np.ndarray]]:
    """An untrained model and its Adagrad sums. The last column of a target or word is its bias: the log of its share among all (smoothed) or in its group."""
    rng = np.random.default_rng(seed)
    drawn = lambda n: rng.normal(0, 0.1, (n, WIDTH))
    bias = np.log((unigram + 0.5) / (unigram + 0.5).sum())
    m = {"context": drawn(SYMBOLS + 1 + len(words.count)), "target": np.column_stack([drawn(len(unigram)), bias]), "place": np.ones((2, WIDTH)), "word": np.column_stack([drawn(len(words.count)), np.log(_inside(words))])}
    m = {k: v.astype(np.float32) for k, v in m.items()}
    return m, {k: np.full_like(v, 1e-2) for k, v in m.items()}


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Learner:
    """Noise-contrastive training with Adagrad. The noise is the smoothed unigram distribution, and a batch shares its draws; inside a group it is the group's own, drawn for each target."""

    def __init__(self, model: dict[str, np.ndarray], grown: dict[str, np.ndarray], unigram: np.ndarray, words: Words, seed: int):
        self.m, self.grown = ({k: v.copy() for k, v in x.items()} for x in (model, grown))
        self.words, inside = words, _inside(words)
        self.word_cum, self.word_base = np.concatenate([[0], np.cumsum(words.count)]), np.log(INNER * inside).astype(np.float32)
        self.steps = {k: np.zeros(len(v), np.int64) for k, v in model.items()}  # taken on each row
        noise = (unigram + 0.5) / (unigram + 0.5).sum()
        self.cum, self.base = np.cumsum(noise), np.log(NOISE * noise).astype(np.float32)
        self.rng = np.random.default_rng(seed)

    def _move(self, part: str, rows: np.ndarray, grads: np.ndarray) -> None:
        order = np.argsort(rows)
        rows = rows[order]
        first = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
        at, g = rows[first], np.add.reduceat(grads[order], first, axis=0)
        self.grown[part][at] += g * g
        self.m[part][at] -= RATE * g / np.sqrt(self.grown[part][at])
        self.steps[part][at] += 1

    def learn(self, target: np.ndarray, one: np.ndarray, two: np.ndarray) -> None:
        """One pass over the targets in random order."""
        order = self.rng.permutation(len(target))
        for start in range(0, len(order), BATCH):
            i = order[start : start + BATCH]
            own, place = self.words.unit(target[i]), self.m["place"]
            h1, h2 = self.m["context"][one[i]], self.m["context"][two[i]]
            hidden = np.column_stack([h1 * place[0] + h2 * place[1], np.ones(len(i), np.float32)])
            drawn = np.minimum(np.searchsorted(self.cum, self.rng.random(NOISE)), len(self.cum) - 1)
            true, noise = self.m["target"][own], self.m["target"][drawn]
            scale = np.float32(len(i) ** -0.5)
            miss = (_sigmoid((true * hidden).sum(axis=1) - self.base[own]) - 1)[:, None] * scale
            err = _sigmoid(hidden @ noise.T - self.base[drawn]) * scale
            dh = (miss * true + err @ noise)[:, :WIDTH]
            grouped = np.flatnonzero(target[i] > START)
            if len(grouped):
                dh[grouped] += self._learn_words(target[i][grouped] - START - 1, hidden[grouped], scale)
            self._move("target", np.concatenate([own, drawn]), np.concatenate([miss * hidden, err.T @ hidden]))
            self._move("context", np.concatenate([one[i], two[i]]), np.concatenate([dh * place[0], dh * place[1]]))
            self._move("place", np.arange(2), np.stack([(dh * h1).sum(axis=0), (dh * h2).sum(axis=0)]))

    def _learn_words(self, word: np.ndarray, hidden: np.ndarray, scale: np.float32) -> np.ndarray:
        """A step on words inside their groups; the gradient of their contexts."""
        group = self.words.group[word]
        low, high = self.words.first[group], self.words.first[group + 1]
        at = self.word_cum[low] + self.rng.random((INNER, len(word))) * (self.word_cum[high] - self.word_cum[low])
        drawn = np.clip(np.searchsorted(self.word_cum, at, side="right") - 1, low, high - 1)
        w = np.concatenate([word[None, :], drawn]).T
        q = self.m["word"][w]
        err = _sigmoid(np.einsum("bkd,bd->bk", q, hidden) - self.word_base[w])
        err[:, 0] -= 1
        err *= scale
        self._move("word", w.ravel(), (err[:, :, None] * hidden[:, None, :]).reshape(-1, WIDTH + 1))
        return np.einsum("bk,bkd->bd", err, q)[:, :WIDTH]


def fitted(target: np.ndarray, one: np.ndarray, two: np.ndarray, seed: int = 7) -> dict[str, np.ndarray]:
    """A model of these targets alone."""
    unigram = np.bincount(target, minlength=SYMBOLS)
    own = Learner(*_begun(unigram, NO_WORDS, seed), unigram, NO_WORDS, seed)
    for _ in range(EPOCHS if len(target) else 0):
        own.learn(target, one, two)
    return own.m | {"group": NO_WORDS.group, "first": NO_WORDS.first}


def _unigram(known: Counts) -> np.ndarray:
    """How often the first softmax has each of its targets in training."""
    out = np.zeros(SYMBOLS + len(known.words.first) - 1)
    head = (known.symbol >= 0) & (known.symbol < HEAD)
    out[known.symbol[head]] = known.counts[head]
    out[HEAD:END], out[END] = known.class_tokens, known.texts
    out[SYMBOLS:] = np.bincount(known.words.group, weights=known.words.count, minlength=len(out) - SYMBOLS)
    return out


def _trained(learnt: DataFrame, known: Counts, share: float) -> dict[str, np.ndarray]:
    """The model of all texts of learnt: a start from a share of them, then a pass over all, averaged."""
    unigram = _unigram(known)

    def block_chains(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, ...]]:
        data, offsets = buffers(batch.column(0))
        for a, b in blocks(offsets):
            symbol, *_, firsts = _symbols(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], known)
            yield _chains(symbol, firsts)[:3]

    def chains(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for found in block_chains(batch):
                yield pa.RecordBatch.from_arrays([pa.array([x.astype(np.int32).tobytes()], pa.binary()) for x in found], ["t", "a", "b"])

    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)
    few = learnt.where(draw < share).orderBy("doc_id").select("text").mapInArrow(chains, "t binary, a binary, b binary").collect()
    own = Learner(*_begun(unigram, known.words), unigram, known.words, 7)
    first = [np.frombuffer(b"".join(r[i] for r in few), np.int32).astype(np.int64) for i in range(3)]
    for _ in range(EPOCHS):
        own.learn(*first)
    model = own.m
    shared = learnt.sparkSession.sparkContext.broadcast((model, own.grown, unigram))

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        single_threaded()
        model, grown, unigram = shared.value
        own, held = Learner(model, grown, unigram, known.words, 11 + TaskContext.get().partitionId()), []
        for batch in batches:
            for found in block_chains(batch):
                held.append(found)
                if sum(len(h[0]) for h in held) >= HELD:
                    own.learn(*map(np.concatenate, zip(*held, strict=True)))
                    held.clear()
        if held:
            own.learn(*map(np.concatenate, zip(*held, strict=True)))
        for k, part in enumerate(PARTS):
            rows = np.flatnonzero(own.steps[part])
            v = np.zeros((len(rows), WIDTH + 1), np.float32)
            v[:, : own.m[part].shape[1]] = own.m[part][rows]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), k, np.int32)), pa.array(rows.astype(np.int32)), pa.array(own.steps[part][rows]), *(pa.array(v[:, i]) for i in range(WIDTH + 1))], names)

    values = [f"v{i}" for i in range(WIDTH + 1)]
    names = ["part", "row", "steps", *values]
    moved = learnt.select("text").mapInArrow(learn, f"part int, row int, steps long, {', '.join(f'{v} float' for v in values)}")
    mean = moved.groupBy("part", "row").agg(*((F.sum(F.col(v) * F.col("steps")) / F.sum("steps")).cast("float").alias(v) for v in values)).toArrow()
    part, row = mean.column("part").to_numpy(), mean.column("row").to_numpy()
    means = np.stack([mean.column(v).to_numpy() for v in values], axis=1)
    for k, name in enumerate(PARTS):
        model[name][row[part == k]] = means[part == k][:, : model[name].shape[1]]
    return model | {"group": known.words.group, "first": known.words.first}


def log_probabilities(model: dict[str, np.ndarray], one: np.ndarray, two: np.ndarray, target: np.ndarray) -> np.ndarray:
    """log10 of each target's normalised probability; a context that recurs is computed once, contexts in batches of matrix products."""
    context, place, size = model["context"], model["place"], len(model["context"])
    unit = Words(target, model["group"], model["first"]).unit(target)
    key = one * size + two
    order = np.argsort(key)
    fresh = np.diff(key[order], prepend=-1) != 0
    keys, back = key[order][fresh], np.cumsum(fresh) - 1  # back: of each place in order, its context
    bounds = np.searchsorted(back, np.arange(0, len(keys) + STEP, STEP))
    out = np.empty(len(target))

    def logs(one: np.ndarray, two: np.ndarray, choices: np.ndarray, row: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Log-probability of choice `at` in context `row`. Scores are small (vectors are), and a softmax without its maximum is safe below 80."""
        hidden = np.column_stack([context[one] * place[0] + context[two] * place[1], np.ones(len(one), np.float32)])
        s = hidden @ choices.T
        if np.sqrt((hidden * hidden).sum(axis=1).max(initial=0) * (choices * choices).sum(axis=1).max(initial=0)) > 80:
            s -= s.max(axis=1, keepdims=True)
        own = s[row, at]
        np.exp(s, out=s)
        return own - np.log(s @ np.ones(s.shape[1], s.dtype))[row]

    for n, at in enumerate(range(0, len(keys), STEP)):
        part = keys[at : at + STEP]
        own = order[bounds[n] : bounds[n + 1]]
        out[own] = logs(part // size, part % size, model["target"], back[bounds[n] : bounds[n + 1]] - at, unit[own])
    grouped = np.flatnonzero(target > START)
    grouped = grouped[np.argsort(unit[grouped], kind="stable")]
    bounds = np.searchsorted(unit[grouped], SYMBOLS + np.arange(len(model["first"])))
    for g in np.flatnonzero(np.diff(bounds)):
        low, high = model["first"][g : g + 2]
        for at in range(bounds[g], bounds[g + 1], STEP):
            own = grouped[at : min(at + STEP, bounds[g + 1])]
            out[own] += logs(one[own], two[own], model["word"][low:high], np.arange(len(own)), target[own] - START - 1 - low)
    return out / math.log(10)


# --- scoring ---------------------------------------------------------------------------------


def scored(docs: DataFrame, training: Column, held_out: Column, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row of docs (doc_id, text)."""
    spark = docs.sparkSession
    since = mark()
    docs = bounded(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    learnt = docs.where(training)
    counts = stored(_word_counts(learnt), "words")
    texts = learnt.select("doc_id").count()
    known = _gathered(counts, texts)
    model = _trained(learnt.select("doc_id", "text"), known, min(1.0, sample / max(1, texts)))
    shared = spark.sparkContext.broadcast((known, model))
    below = math.log10(known.tokens + 0.5 * (known.distinct + 1))
    class_below = np.log10(known.class_tokens + 0.5 * (known.class_words + 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        single_threaded()
        known, model = shared.value
        for batch in batches:
            data, offsets = buffers(batch.column(1))
            parts = []
            for a, b in blocks(offsets):
                symbol, shape, tail, count, hashes, firsts = _symbols(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], known)
                target, one, two, begin = _chains(symbol, firsts)
                likely = np.add.reduceat(log_probabilities(model, one, two, target), begin)
                up = np.log10(np.maximum(count, 0) + 0.5)  # a rarer word counts as unseen until its count is joined
                sums = lambda x: np.diff(np.concatenate([[0.0], np.cumsum(x)])[firsts])  # noqa: B023, E731
                n = np.diff(firsts)
                base = sums(up) - n * below + math.log10(known.texts + 0.5) - below
                inner = sums(np.where(tail, up - class_below[shape], 0.0))
                seen = sums(count > 0) + (known.texts > 0)
                rare = count < 0
                lens = np.diff(np.concatenate([[0], np.cumsum(rare)])[firsts])
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lens)]).astype(np.int32)), pa.array(hashes[rare].view(np.int64)))
                parts.append((n + 1, seen, base, likely + inner, lists))
            if parts:
                cols = [pa.array(np.concatenate([p[i] for p in parts])) for i in range(4)]
                yield pa.RecordBatch.from_arrays([batch.column(0), cols[0].cast(pa.int64()), cols[1].cast(pa.int64()), *cols[2:], pa.concat_arrays([p[4] for p in parts])], ["doc_id", "n_tokens", "n_known", "base_score", "score", "rare"])

    first = docs.mapInArrow(run, "doc_id long, n_tokens long, n_known long, base_score double, score double, rare array<long>")
    first = stored(first.withColumn("row", F.monotonically_increasing_id()), "scores")
    asked = first.select("row", F.explode("rare").alias("word"))
    gain = F.log10(F.col("n") + 0.5) - F.lit(_HALF)
    more = asked.join(counts.select("word", "n"), "word").groupBy("row").agg(F.sum(gain).alias("gain"), F.count("*").alias("seen"))
    out = first.drop("rare").join(more, "row", "left").select(
        "doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "n_tokens", (F.col("n_known") + F.coalesce("seen", F.lit(0))).alias("n_known"),
        F.lit(known.tokens).cast("long").alias("train_tokens"), *((F.col(c) + F.coalesce("gain", F.lit(0.0))).alias(c) for c in ("base_score", "score")),
    )
    out = stored(out, "lm")
    dropped(spark, since, keep=1)
    return out
