"""Language model scores: a hashed maximum-entropy model with class-factored softmax."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, replace
from itertools import chain, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from earlywarn.llm.common import map_arrow, reachable, stored, text_of
from earlywarn.llm.hashing import MULTIPLIERS, mix


@dataclass(frozen=True)
class ModelSpec:
    """``frequent``: the words whose counts every task gets, as two arrays; all others are joined, so
    it moves work between tasks and joins and changes no score.

    The end and the ``heads`` - 1 most frequent words are classes of their own, all other words fall
    into ``tails`` classes by their last letters. ``features`` rows of weights are shared by hash.
    ``rounds``: the training documents are divided in so many parts; each is one round of gradient
    steps in all tasks at once, whose weights are then averaged. ``batch`` tokens make one step.
    ``task_tokens``: a task of a round learns from about so many at least, as it returns all weights.
    """

    frequent: int = 1 << 17
    heads: int = 32
    tails: int = 32
    features: int = 1 << 14
    rounds: int = 3
    batch: int = 16_384
    rate: float = 0.5
    flush: int = 300_000
    task_tokens: int = 500_000

    def __post_init__(self):
        if self.features & (self.features - 1) or self.tails & (self.tails - 1) or not self.features <= 1 << 16:
            raise ValueError("features (at most 65536) and tails must be powers of two")

    @property
    def classes(self) -> int:
        return self.heads + self.tails


#: The end of a text, where a hash of a word would stand. Hashes have bit 62 set.
END = 1 << 61


def word_hash(word: bytes, tails: int) -> int:
    """62 bits and bit 62; the lowest say which tail class the word's last letters belong to."""
    tail = (word[-1] * 31 + (word[-2] if len(word) > 1 else 0)) * 0x9E3779B1 >> 16 & (tails - 1)
    return (xxhash.xxh3_64_intdigest(word) >> 2 | 1 << 62) & -tails | tail


@dataclass
class Vocabulary:
    """Counts of the frequent words by ascending hash, and what the classes hold."""

    hashes: np.ndarray
    counts: np.ndarray
    heads: np.ndarray
    class_mass: np.ndarray
    tokens: int
    types: int


def word_hashes(words: list[bytes], tails: int) -> np.ndarray:
    """:func:`word_hash` of many words."""
    ends = np.cumsum(np.fromiter(map(len, words), "int64", len(words)))
    letters = np.frombuffer(b"".join(words), "uint8").astype("int64")
    before = np.where(np.diff(ends, prepend=0) > 1, letters[ends - 2], 0)
    tail = (letters[ends - 1] * 31 + before) * 0x9E3779B1 >> 16 & (tails - 1)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), "uint64", len(words))
    return (h >> np.uint64(2)).astype("int64") & -tails | 1 << 62 | tail


class Coder:
    """Turns words into places in the vocabulary, or hashes where they are not frequent."""

    def __init__(self, vocabulary: Vocabulary, spec: ModelSpec, limit: int = 400_000):
        self.v, self.spec = vocabulary, spec
        self.known, self.limit = {}, limit
        spots = np.searchsorted(vocabulary.hashes, vocabulary.heads)
        self.classes = spec.heads + (vocabulary.hashes & (spec.tails - 1))
        for rank, (spot, h) in enumerate(zip(spots, vocabulary.heads)):
            if spot < len(vocabulary.hashes) and vocabulary.hashes[spot] == h:
                self.classes[spot] = rank
        self.end = len(vocabulary.hashes)
        self.log_count = np.log10(vocabulary.counts + 1.0)

    def codes(self, words: Iterable[bytes], n: int) -> np.ndarray:
        """Codes of words, remembered; what is new is hashed and looked up together."""
        words = list(words)
        out = np.fromiter(map(self.known.get, words, repeat(-1)), "int64", n)
        spots = np.flatnonzero(out < 0)
        if len(spots):
            missing = list(map(words.__getitem__, spots.tolist()))
            new = list(dict.fromkeys(missing))
            h = word_hashes(new, self.spec.tails)
            at = np.searchsorted(self.v.hashes, h)
            there = at < self.end
            there[there] = self.v.hashes[at[there]] == h[there]
            found = dict(zip(new, np.where(there, at, h).tolist()))
            out[spots] = np.fromiter(map(found.__getitem__, missing), "int64", len(missing))
            if len(self.known) + len(found) > self.limit:
                self.known.clear()
            self.known.update(found)
        return out

    def describe(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Frequent or not, class, and the number that stands for the word in features."""
        frequent = codes < self.end
        classes = self.spec.heads + (codes & (self.spec.tails - 1))
        values = codes.astype("uint64")
        at = codes[frequent]
        classes[frequent], values[frequent] = self.classes[at], self.v.hashes[at]
        return frequent, classes, values


@dataclass
class Encoded:
    """Some texts side by side; ``first`` is where each one's tokens begin among ``truth``."""

    codes: np.ndarray
    frequent: np.ndarray
    truth: np.ndarray
    rows: np.ndarray
    words: np.ndarray
    first: np.ndarray


def encode(texts: list[list[bytes]], coder: Coder, spec: ModelSpec) -> Encoded:
    """Classes of all tokens, and for each the rows of weights that its context asks for: the word before,
    the one before that (a skip), the two words before, and the run of three classes before."""
    counts = np.array([len(t) for t in texts], "int64")
    codes = coder.codes(chain.from_iterable(texts), int(counts.sum()))
    frequent, classes, values = coder.describe(codes)
    # Three blanks stand before each text; words keep their order behind them.
    number = np.repeat(np.arange(len(texts)), counts)
    at = np.arange(len(codes)) + 3 * (number + 1)
    v, c = np.zeros(len(codes) + 3 * len(texts), "uint64"), np.zeros(len(codes) + 3 * len(texts), "uint64")
    v[at], c[at] = values, classes + 1
    # Each word and the end after the last are foretold from the three places before.
    before = np.arange(len(codes) + len(texts)) + 2 * np.repeat(np.arange(1, len(texts) + 1), counts + 1)
    m = MULTIPLIERS
    word, skip, pair, classes_before = v * m[1], v * m[2] + np.uint64(7), v * m[6], c * m[3]
    pair[1:] += v[:-1] * m[7]
    skip[1:] = skip[:-1].copy()
    classes_before[1:] += c[:-1] * m[4]
    classes_before[2:] += c[:-2] * m[5]
    top = np.uint64(64 - (spec.features - 1).bit_length())
    rows = np.stack([(mix(k) >> top).astype("uint16")[before] for k in (word, skip, pair, classes_before)])
    truth = np.zeros(len(before), "int64")
    first = np.cumsum(counts + 1) - (counts + 1)
    truth[np.arange(len(codes)) + number] = classes
    return Encoded(codes, frequent, truth, rows, number, first)


def log_classes(weights: np.ndarray, bias: np.ndarray, rows: np.ndarray, at_once: int = 1024) -> np.ndarray:
    """log P(class | context) for each token; so many at a time stay in a core's cache."""
    out = np.empty((rows.shape[1], weights.shape[1]), weights.dtype)
    spare = np.empty((min(at_once, len(out)), weights.shape[1]), weights.dtype)
    for start in range(0, len(out), at_once):
        logits, some = out[start : start + at_once], rows[:, start : start + at_once]
        weights.take(some[0], axis=0, out=logits, mode="clip")  # rows are within bounds
        part = spare[: len(logits)]
        for r in some[1:]:
            logits += weights.take(r, axis=0, out=part, mode="clip")
        logits += bias
        logits -= logits.max(axis=1, keepdims=True)
        logits -= np.log(np.exp(logits, out=part).sum(axis=1, keepdims=True))
    return out


def sums_by_row(values: np.ndarray, order: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """``np.add.reduceat(values[order], starts)``, to the bit. Runs of up to eight rows, which are nearly all, are
    added up side by side: what follows the first row, row by row, then the first."""
    sums = values.take(order[starts], axis=0)
    short = sizes <= 8
    some = np.flatnonzero(short & (sizes > 1))
    if len(some):
        rest = values.take(order[starts[some] + 1], axis=0)
        left = np.arange(len(some))
        for k in range(2, 8):
            left = left[sizes[some[left]] > k]
            rest[left] += values.take(order[starts[some[left]] + k], axis=0)
        sums[some] += rest
    long = np.flatnonzero(~short)
    if len(long):
        ends = np.cumsum(sizes[long])
        members = order[np.repeat(~short, sizes)]
        sums[long] = np.add.reduceat(values.take(members, axis=0), ends - sizes[long], axis=0)
    return sums


def gradient_step(weights, bias, often, rows: np.ndarray, truth: np.ndarray, rate: float) -> None:
    """One step up the likelihood; a row's step shrinks with the root of how often it was seen."""
    slope = log_classes(weights, bias, rows)
    np.negative(np.exp(slope, out=slope), out=slope)
    slope[np.arange(len(truth)), truth] += 1.0
    rate = rate / np.sqrt(len(rows))
    for r in rows:
        order = np.argsort(r, kind="stable")
        ordered = r[order]
        starts = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1]))
        used = ordered[starts]
        sizes = np.diff(np.append(starts, len(r)))
        sums = sums_by_row(slope, order, starts, sizes)
        often[used] += sizes
        sums *= (rate / np.sqrt(often[used])).astype("float32")[:, None]
        weights[used] += sums


def _words(batch: pa.RecordBatch) -> Iterator[list[bytes]]:
    texts = batch.column("text")
    for i in range(batch.num_rows):
        yield texts[i].as_buffer().to_pybytes().lower().split()


def _portions(batch: pa.RecordBatch, tokens: int) -> Iterator[list[list[bytes]]]:
    """Texts with about so many tokens together."""
    some, held = [], 0
    for words in _words(batch):
        some.append(words)
        held += len(words) + 1
        if held >= tokens:
            yield some
            some, held = [], 0
    if some:
        yield some


def _count(batches: Iterator[pa.RecordBatch], spec: ModelSpec) -> Iterator[pa.RecordBatch]:
    counts, texts = Counter(), 0

    def rows() -> pa.RecordBatch:
        hashes = [word_hash(w, spec.tails) for w in counts] + ([END] if texts else [])
        return pa.RecordBatch.from_arrays(
            [pa.array(hashes, pa.int64()), pa.array([*counts.values(), *([texts] if texts else [])], pa.int64())],
            names=["h", "c"],
        )

    for batch in batches:
        for words in _words(batch):
            counts.update(words)
            texts += 1
            if len(counts) > spec.flush:
                yield rows()
                counts, texts = Counter(), 0
    if texts:
        yield rows()


def count_words(texts: DataFrame, spec: ModelSpec) -> DataFrame:
    """``h, c``: how often each word and the end occur in the texts; combined in tasks and map-side."""
    each = map_arrow(texts.select("text"), lambda b: _count(b, spec), "h long, c long")
    return stored(each.groupBy("h").agg(F.sum("c").alias("c")), "counts")


def vocabulary_of(counts: DataFrame, spec: ModelSpec) -> tuple[Vocabulary, int | None]:
    """What tasks are sent, and the least quarter octave of counts whose words are all sent (null if none is).

    It follows from a histogram by quarter octaves, so at most ``frequent`` rows and the heads come back.
    """
    words = counts.where(F.col("h") != END)
    octave = F.floor(4 * F.log2("c")).cast("int")
    sizes = words.groupBy(octave.alias("o")).agg(F.count(F.lit(1)).alias("n")).collect()
    held, least = 0, None
    for r in sorted(sizes, key=lambda r: -r.o):
        if held + r.n > spec.frequent:
            break
        held, least = held + r.n, r.o
    first = words.orderBy(F.desc("c"), "h").limit(spec.heads - 1).collect() if spec.heads > 1 else []
    heads = np.array([r.h for r in first], "int64")
    wanted = F.col("h").isin(heads.tolist()) if len(heads) else F.lit(False)
    if least is not None:
        wanted = wanted | (octave >= least)
    # Columns, not rows: a word takes 16 bytes here.
    top = words.where(wanted).select("h", "c").toArrow()
    hashes, times = (top.column(c).to_numpy() for c in ("h", "c"))
    order = np.argsort(hashes)
    hashes, times = hashes[order].astype("int64"), times[order].astype("int64")
    tail = F.col("h").bitwiseAND(F.lit(spec.tails - 1)).alias("tail")
    mass = np.ones(spec.tails)
    in_tail = words.where(~F.col("h").isin([int(h) for h in heads])) if len(heads) else words
    for r in in_tail.groupBy(tail).agg(F.sum(F.col("c") + 1).alias("mass")).collect():
        mass[r.tail] += r.mass
    total = counts.agg(F.sum("c"), F.count(F.lit(1))).first()
    vocabulary = Vocabulary(
        hashes, times, np.concatenate([[END], heads]).astype("int64"), mass, int(total[0] or 0), int(total[1]),
    )
    return vocabulary, least


def _train(batches: Iterator[pa.RecordBatch], shared, spec: ModelSpec) -> Iterator[pa.RecordBatch]:
    vocabulary, start, bias = shared.value
    coder = Coder(vocabulary, spec)
    weights, often, tokens = start.copy(), np.ones(spec.features), 0
    for batch in batches:
        for texts in _portions(batch, 4 * spec.batch):
            e = encode(texts, coder, spec)
            tokens += len(e.truth)
            for at in range(0, len(e.truth), spec.batch):
                gradient_step(
                    weights, bias, often, e.rows[:, at : at + spec.batch], e.truth[at : at + spec.batch], spec.rate
                )
    if tokens:
        blocks = np.array_split(weights * np.float32(tokens), 32)
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(len(blocks)), pa.int32()), pa.array([tokens] * len(blocks), pa.int64()),
             pa.array([b.astype("<f4").tobytes() for b in blocks], pa.binary())],
            names=["block", "tokens", "weights"],
        )


def _sum_blocks(pdf: pd.DataFrame) -> pd.DataFrame:
    total = np.sum([np.frombuffer(w, "<f4").astype("float64") for w in pdf["weights"]], axis=0)
    return pd.DataFrame({
        "block": [pdf["block"].iloc[0]], "tokens": [pdf["tokens"].sum()], "weights": [total.astype("<f4").tobytes()]
    }).astype({"block": "int32"})


def _averaged(blocks: DataFrame, spec: ModelSpec, start: np.ndarray) -> np.ndarray:
    """Weights weighted by the tokens that each task learned from; summed in two steps, so no task gets
    the weights of all."""
    schema = "block int, tokens long, weights binary"
    some = blocks.withColumn("share", F.spark_partition_id() % 64)
    some = some.groupBy("block", "share").applyInPandas(_sum_blocks, schema)
    rows = sorted(some.groupBy("block").applyInPandas(_sum_blocks, schema).collect(), key=lambda r: r.block)
    if not rows:
        return start
    parts = [np.frombuffer(r.weights, "<f4") / np.float32(r.tokens) for r in rows]
    return np.concatenate(parts).reshape(spec.features, spec.classes).astype("float32")


def _score(batches: Iterator[pa.RecordBatch], shared, spec: ModelSpec) -> Iterator[pa.RecordBatch]:
    vocabulary, weights, bias = shared.value
    coder = Coder(vocabulary, spec)
    log_mass = np.log10(vocabulary.class_mass)
    names = ["doc_id", "row", "n_tokens", "n_frequent", "log_counts", "head_counts", "log_classes", "log_mass", "rare", "times"]
    for batch in batches:
        out: list[list] = [[] for _ in range(8)]
        for texts in _portions(batch, 4 * spec.batch):
            e = encode(texts, coder, spec)
            n = len(texts)
            logs = np.empty(len(e.truth))
            for at in range(0, len(logs), spec.batch):
                part = e.truth[at : at + spec.batch]
                each = log_classes(weights, bias, e.rows[:, at : at + spec.batch])
                logs[at : at + spec.batch] = each[np.arange(len(part)), part]
            own = np.delete(e.truth, np.append(e.first[1:], len(e.truth)) - 1)
            counted = np.zeros(len(e.codes))
            counted[e.frequent] = coder.log_count[e.codes[e.frequent]]
            in_tail = own >= spec.heads
            total = lambda x: np.bincount(e.words, x, minlength=n)  # noqa: B023, E731
            for column, values in zip(out, (
                np.diff(np.append(e.first, len(e.truth))), total(e.frequent), total(counted), total(counted * ~in_tail),
                np.add.reduceat(logs, e.first) / np.log(10.0), total(np.where(in_tail, log_mass[np.maximum(own - spec.heads, 0)], 0.0)),
            )):
                column.extend(values.tolist())
            at = np.flatnonzero(~e.frequent)
            ends = np.searchsorted(e.words[at], np.arange(n + 1))
            for k in range(n):
                rare, times = np.unique(e.codes[at[ends[k] : ends[k + 1]]], return_counts=True)
                out[6].append(rare)
                out[7].append(times)
        out[1] = [int(x) for x in out[1]]
        kinds = [pa.int64(), pa.int64(), *[pa.float64()] * 4, pa.list_(pa.int64()), pa.list_(pa.int64())]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("row"), *[pa.array(c, k) for c, k in zip(out, kinds)]], names=names
        )


_SCORED = (
    "doc_id long, row long, n_tokens long, n_frequent long, log_counts double, head_counts double, "
    "log_classes double, log_mass double, rare array<long>, times array<long>"
)


def score_texts(
    docs: DataFrame, train: Column, spec: ModelSpec | None = None, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """One row per row: ``doc_id, n_tokens, n_known, train_tokens, base_score, score``, logs to base ten.

    Texts where ``train`` holds (a condition on ``doc_id``) are learned from, all are scored. A text is its
    words with A-Z lowered and one end; null and empty texts are the end alone. ``base_score`` is
    the add-one unigram model, ``score`` the model here: P(class | the three words before), a softmax over
    hashed n-gram and skip features, times P(word | class), add-one within the class. Both sum to one
    over the vocabulary and one unknown word (per class). Without training texts all words are unknown.
    Repeated rows count and score as often as they stand; other columns are not read.

    Words are counted and compared by 62-bit hashes. Frequent words are sent to all tasks, a bounded table;
    counts of the others are joined, one row for each rare word of a text, and only their logs come
    back. Texts are never shuffled.
    """
    spec = spec or ModelSpec()
    texts = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"),
        F.monotonically_increasing_id().alias("row"),
    )
    learn = texts.where(train)
    counts = count_words(learn, spec)
    vocabulary, least = vocabulary_of(counts, spec)
    ends = counts.where(F.col("h") == END).agg(F.sum("c")).first()[0] or 0
    head_counts = vocabulary.counts[np.searchsorted(vocabulary.hashes, vocabulary.heads[1:])] if len(vocabulary.heads) > 1 else np.empty(0)
    mass = np.ones(spec.classes)
    mass[0] += ends
    mass[1 : 1 + len(head_counts)] += head_counts
    mass[spec.heads :] += vocabulary.class_mass
    bias = np.log(mass / mass.sum()).astype("float32")
    bias[1 + len(head_counts) : spec.heads] = -1e4  # classes that no word has
    weights = np.zeros((spec.features, spec.classes), "float32")
    context = docs.sparkSession.sparkContext
    reachable(docs.sparkSession)
    # Partitions are merged, never added; every core keeps a task.
    tasks = max(context.defaultParallelism, -(-vocabulary.tokens // (spec.rounds * spec.task_tokens)))
    for part in range(spec.rounds):
        shared = context.broadcast((vocabulary, weights, bias))
        slice_ = learn.where(F.pmod(F.xxhash64("doc_id"), F.lit(spec.rounds)) == part).select("text")
        slice_ = slice_.coalesce(tasks)
        step = replace(spec, rate=spec.rate / (1 + part))
        # Bound to this round's weights; the next round makes its own.
        blocks = map_arrow(slice_, _with(_train, shared, step), "block int, tokens long, weights binary")
        weights = _averaged(blocks, spec, weights)
        shared.unpersist()
    shared = context.broadcast((vocabulary, weights, bias))
    scored = stored(map_arrow(texts.select("doc_id", "row", "text"), _with(_score, shared, spec), _SCORED), "scored")
    rare = scored.select("row", F.explode(F.arrays_zip("rare", "times")).alias("x"))
    rare = rare.select("row", F.col("x.rare").alias("h"), F.col("x.times").alias("times"))
    others = counts if least is None else counts.where(F.floor(4 * F.log2("c")).cast("int") < least)
    rare = rare.join(others.hint("merge"), "h").groupBy("row").agg(
        F.sum("times").alias("n_rare"), F.sum(F.col("times") * F.log10(F.col("c") + 1)).alias("rare_logs")
    )
    out = scored.join(stored(rare, "rare").hint("merge"), "row", "left").withColumns({
        "n_rare": F.coalesce("n_rare", F.lit(0)), "rare_logs": F.coalesce("rare_logs", F.lit(0.0))
    })
    space = float(np.log10(vocabulary.tokens + vocabulary.types + 1.0))
    all_logs = F.col("log_counts") + F.col("rare_logs")
    return out.select(
        "doc_id", "n_tokens", (F.col("n_frequent") + F.col("n_rare") + F.lit(int(ends > 0))).alias("n_known"),
        F.lit(vocabulary.tokens).cast("long").alias("train_tokens"),
        (all_logs + float(np.log10(ends + 1.0)) - F.col("n_tokens") * space).alias("base_score"),
        (F.col("log_classes") + all_logs - F.col("head_counts") - F.col("log_mass")).alias("score"),
    )


def _with(fn, shared, spec: ModelSpec):
    return lambda batches: fn(batches, shared, spec)
