"""Line quality: a linear-chain conditional random field over the lines of a text."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from earlywarn.llm.common import map_arrow, text_of
from earlywarn.llm.statistics import DIGITS, LETTERS, SYMBOLS, UPPER, count_of, echoes

#: Features of one line; each line also sees those of the line before and after it.
LINE_FEATURES = (
    "symbols", "upper", "digits", "marks", "other", "echoes", "repetition", "seen_before", "word_length",
    "length", "blank",
)
N_FEATURES = 3 * len(LINE_FEATURES) + 3


@dataclass(frozen=True)
class LineSpec:
    """``max_rows`` bounds the labelled documents to learn from (ids that hash lowest), ``max_lines``
    their length: longer documents are scored like all others, but not learned from."""

    max_rows: int = 4_000
    max_lines: int = 1_000
    rounds: int = 120
    rate: float = 1.0
    ridge: float = 1e-6


@dataclass(frozen=True)
class LineModel:
    """Weights of the features for a good line, and of passing from bad/good to bad/good."""

    weights: np.ndarray
    moves: np.ndarray

    @staticmethod
    def blank() -> LineModel:
        return LineModel(np.zeros(N_FEATURES), np.zeros((2, 2)))


def _line(line: bytes, seen: set[bytes]) -> tuple[float, ...]:
    words = line.split()
    n = len(words)
    if n == 0:
        return (0.0,) * (len(LINE_FEATURES) - 1) + (1.0,)
    joined = b"".join(words)
    size, letters = len(joined), count_of(joined, LETTERS)
    symbols, digits, marks = count_of(joined, SYMBOLS), count_of(joined, DIGITS), count_of(joined, b"!?|")
    high = size - len(joined.translate(None, bytes(range(128, 256)))) if not joined.isascii() else 0
    before = line in seen
    seen.add(line)
    return (
        symbols / size, count_of(joined, UPPER) / letters if letters else 0.0, digits / size, marks / size,
        (size - letters - high - symbols - digits) / size, echoes(words) / n,
        1.0 - len(set(words)) / n, float(before), min(size / n, 40.0) / 10.0, math.log1p(n) / 5.0, 0.0,
    )


def line_features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of all lines, the lines of each text, the bytes of each line."""
    rows, counts, sizes = [], [], []
    for text in texts:
        lines, seen = text.split(b"\n"), set()
        rows.extend([_line(line, seen) for line in lines])
        counts.append(len(lines))
        sizes.extend(map(len, lines))
    own = np.array(rows, "float64").reshape(len(rows), len(LINE_FEATURES))
    counts = np.array(counts, "int64")
    first = np.zeros(len(own), bool)
    last = first.copy()
    ends = np.cumsum(counts)
    first[ends - counts], last[ends - 1] = True, True
    before, after = np.roll(own, 1, axis=0), np.roll(own, -1, axis=0)
    before[first], after[last] = 0.0, 0.0
    edges = np.column_stack([np.ones(len(own)), first, last])
    return np.hstack([own, before, after, edges]), counts, np.array(sizes, "float64")


def chain(unary: np.ndarray, counts: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Forward-backward over all texts side by side: P(good) of every line, expected moves, log of the
    normaliser. ``unary`` is the log-odds of good for each line, text after text."""
    order = np.argsort(-counts, kind="stable")
    lengths, offsets = counts[order], (np.cumsum(counts) - counts)[order]
    steps = int(lengths[0]) if len(lengths) else 0
    active = np.searchsorted(-lengths, -np.arange(steps), side="left")  # texts with more than t lines
    unary = np.clip(unary, -30.0, 30.0)
    emit = np.stack([np.ones_like(unary), np.exp(unary)], axis=1)
    pass_on = np.exp(np.clip(moves, -30.0, 30.0))
    forward, scale = np.empty_like(emit), np.empty(len(unary))
    for t in range(steps):
        at = offsets[: active[t]] + t
        a = emit[at] if t == 0 else (forward[at - 1] @ pass_on) * emit[at]
        scale[at] = a.sum(axis=1)
        forward[at] = a / scale[at][:, None]
    good, expected = np.empty(len(unary)), np.zeros((2, 2))
    later = np.ones((len(lengths), 2))
    for t in range(steps - 1, -1, -1):
        n = active[t]
        at = offsets[:n] + t
        both = forward[at] * later[:n]
        good[at] = both[:, 1] / both.sum(axis=1)
        if t:
            from_here = emit[at] * later[:n] / scale[at][:, None]
            expected += pass_on * (forward[at - 1].T @ from_here)
            later[:n] = from_here @ pass_on.T
    return good, expected, float(np.log(scale).sum())


def learn(features: np.ndarray, counts: np.ndarray, labels: np.ndarray, spec: LineSpec) -> LineModel:
    """Maximise the penalised likelihood of the line labels (those of their texts) by gradient steps."""
    if not len(counts):
        return LineModel.blank()
    truth = np.repeat(labels.astype("float64"), counts)
    seen = np.zeros((2, 2))
    for label in (0, 1):
        seen[label, label] = (counts[labels == label] - 1).sum()
    theta = np.zeros(N_FEATURES + 4)
    mean, spread = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, spec.rounds + 1):
        weights, moves = theta[:N_FEATURES], theta[N_FEATURES:].reshape(2, 2)
        good, expected, _ = chain(features @ weights, counts, moves)
        slope = np.concatenate([features.T @ (truth - good), (seen - expected).ravel()]) / len(truth)
        slope -= spec.ridge * theta
        mean = 0.9 * mean + 0.1 * slope
        spread = 0.999 * spread + 0.001 * slope**2
        theta = theta + spec.rate * (mean / (1 - 0.9**step)) / (np.sqrt(spread / (1 - 0.999**step)) + 1e-8)
    return LineModel(theta[:N_FEATURES], theta[N_FEATURES:].reshape(2, 2))


def score_texts(texts: list[bytes], model: LineModel) -> list[tuple[float, np.ndarray]]:
    """For each text its quality and the P(good) of its lines; lines weigh what they are long."""
    features, counts, sizes = line_features(texts)
    good, _, _ = chain(features @ model.weights, counts, model.moves)
    out, at = [], 0
    for n in counts:
        part, weight = good[at : at + n], sizes[at : at + n]
        total = weight.sum()
        score = float((part * weight).sum() / total) if total else float(part.mean())
        out.append((min(max(score, 0.0), 1.0), part))
        at += n
    return out


#: Texts scored side by side, and the bytes they may have together.
_TEXTS, _BYTES = 512, 8 << 20


def _portions(column: pa.Array) -> Iterator[list[bytes]]:
    texts, size = [], 0
    for i in range(len(column)):
        texts.append(column[i].as_buffer().to_pybytes())
        size += len(texts[-1])
        if len(texts) >= _TEXTS or size >= _BYTES:
            yield texts
            texts, size = [], 0
    if texts:
        yield texts


def _score(batches: Iterator[pa.RecordBatch], model: LineModel, with_lines: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        scored = [x for texts in _portions(batch.column("text")) for x in score_texts(texts, model)]
        lines = [part if with_lines else None for _, part in scored]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"), pa.array([s for s, _ in scored], pa.float64()),
                pa.array([len(part) for _, part in scored], pa.int64()),
                pa.array([int((part < 0.5).sum()) for _, part in scored], pa.int64()),
                pa.array(lines, pa.list_(pa.float64())),
            ],
            names=["doc_id", "score", "n_lines", "n_bad_lines", "lines"],
        )


def _featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [batch.column("text")[i].as_buffer().to_pybytes() for i in range(batch.num_rows)]
        if not texts:
            continue
        features, counts, _ = line_features(texts)
        parts = np.split(features, np.cumsum(counts)[:-1])
        yield pa.RecordBatch.from_arrays(
            [batch.column("id"), batch.column("label"), pa.array(counts),
             pa.array([p.astype("<f4").tobytes() for p in parts], pa.binary())],
            names=["id", "label", "n", "features"],
        )


def fit_lines(
    docs: DataFrame, labels: DataFrame, spec: LineSpec | None = None, id_col: str = "doc_id",
    text_col: str = "text", label_col: str = "quality", use: Column | None = None,
) -> LineModel:
    """Learn from labelled documents whose id meets ``use`` (a condition on ``id``).

    Without labelled rows, or with one class only, the model is what the ridge makes of them. The
    bounded sample of ids is joined first; its features are computed in tasks and only they come back.
    """
    spec = spec or LineSpec()
    ids = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label"))
    ids = ids.where(F.col("id").isNotNull() & F.col("label").isNotNull())
    ids = ids.where(use) if use is not None else ids
    ids = ids.groupBy("id").agg(F.min("label").alias("label")).orderBy(F.xxhash64("id"), "id").limit(spec.max_rows)
    text = text_of(text_col)
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text")).join(F.broadcast(ids), "id")
    rows = rows.where(F.size(F.split("text", "\n")) <= spec.max_lines).select("id", "label", "text")
    rows = map_arrow(rows, _featurise, "id long, label int, n long, features binary").dropDuplicates(["id"])
    sample = sorted(rows.collect(), key=lambda r: r.id)
    if not sample:
        return LineModel.blank()
    features = np.concatenate([np.frombuffer(r.features, "<f4") for r in sample]).astype("float64")
    counts, truth = np.array([r.n for r in sample]), np.array([r.label for r in sample])
    return learn(features.reshape(-1, N_FEATURES), counts, truth, spec)


def score_quality(
    docs: DataFrame, model: LineModel, id_col: str = "doc_id", text_col: str = "text", with_lines: bool = False,
) -> DataFrame:
    """One row per row: ``doc_id, score, n_lines, n_bad_lines, lines`` (P(good) by line, if asked for).

    A text's score is the mean probability that its lines are good, each weighing its length. Null
    and empty texts are one empty line, so they get a score too; repeated rows score alike; empty tables
    give no rows; other columns are not read. One pass without a shuffle; memory is one batch of texts.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    schema = "doc_id long, score double, n_lines long, n_bad_lines long, lines array<double>"
    return map_arrow(texts, lambda batches: _score(batches, model, with_lines), schema)
