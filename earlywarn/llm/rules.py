"""Quality rules: a decision list learned from labelled statistics, applied as Spark conditions."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from earlywarn.llm.common import map_arrow, text_of
from earlywarn.llm.statistics import (
    DIGITS,
    LETTERS,
    SYMBOLS,
    UPPER,
    code_points,
    count_of,
    echoes,
    repeated_lines,
    repeated_words,
)

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper",
          "n_letters", "n_digits", "n_marks", "n_distinct", "n_echoes")

#: What conditions may compare: ratios, which do not depend on a text's length.
FEATURES = {
    "mean_word": "word_chars / greatest(n_words, 1)",
    "symbol_share": "n_symbols / greatest(word_chars, 1)",
    "dup_line_share": "n_dup_lines / greatest(n_lines, 1)",
    "repeat_share": "n_repeat_words / greatest(n_words, 1)",
    "upper_share": "n_upper / greatest(n_letters, 1)",
    "digit_share": "n_digits / greatest(word_chars, 1)",
    "mark_share": "n_marks / greatest(word_chars, 1)",
    "distinct_share": "n_distinct / greatest(n_words, 1)",
    "echo_share": "n_echoes / greatest(n_words, 1)",
    "words_per_line": "n_words / greatest(n_lines, 1)",
}


def text_counts(data: bytes) -> tuple[int, ...]:
    """The ``COUNTS`` of one text in UTF-8."""
    words, lines = data.split(), data.split(b"\n")
    joined = b"".join(words)
    return (
        len(words), code_points(joined), count_of(joined, SYMBOLS), repeated_lines(lines), repeated_words(words),
        len(lines), count_of(joined, UPPER), count_of(joined, LETTERS), count_of(joined, DIGITS),
        count_of(joined, b"!?"), len(set(words)), echoes(words),
    )


def _count_batches(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("_text")
        rows = [text_counts(texts[i].as_buffer().to_pybytes()) for i in range(batch.num_rows)]
        counts = np.array(rows, "int64").reshape(len(rows), len(COUNTS))
        yield pa.RecordBatch.from_arrays(
            [batch.column(n) for n in names] + [pa.array(counts[:, i]) for i in range(len(COUNTS))],
            names=names + list(COUNTS),
        )


def with_counts(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` and the counts of every whole text, in one pass without a shuffle; null has no words."""
    inner = [f"_k{i}" for i in range(len(keep))]
    df = docs.select(*[F.col(f"`{c}`").alias(i) for c, i in zip(keep, inner)], text_of(text_col).alias("_text"))
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields if f.name != "_text")
    schema = ", ".join([kept, *[f"{c} long" for c in COUNTS]]) if kept else ", ".join(f"{c} long" for c in COUNTS)
    out = map_arrow(df, lambda batches: _count_batches(batches, inner), schema)
    return out.withColumnsRenamed(dict(zip(inner, keep)))


def base_failed() -> Column:
    return F.expr("n_words < 10 OR 100 * n_repeat_words > 20 * n_words")


@dataclass(frozen=True)
class RuleSpec:
    """``max_rows`` bounds the labelled sample that rules are learned from (the ids that hash lowest).

    A rule has at most ``max_conditions``; thresholds are tried at ``cuts`` quantiles. A rule must be
    right in ``min_precision`` of the rows it rejects, on rows it was not grown on, and must reject
    ``min_cover`` rows; at most ``max_rules`` are learned.
    """

    max_rows: int = 20_000
    max_rules: int = 12
    max_conditions: int = 3
    cuts: int = 64
    min_precision: float = 0.9
    min_cover: int = 5


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return x[self.feature] > self.threshold if self.above else x[self.feature] <= self.threshold

    def sql(self) -> str:
        return f"({FEATURES[self.feature]}) {'>' if self.above else '<='} {self.threshold!r}D"


Rule = tuple[Condition, ...]


def _covers(rule: Rule, x: dict[str, np.ndarray], n: int) -> np.ndarray:
    hit = np.ones(n, bool)
    for c in rule:
        hit &= c.holds(x)
    return hit


def _gain(p: int, n: int, p0: int, n0: int) -> float:
    """Information gained about the rejected class, times the rows of it that stay covered."""
    if p == 0:
        return -math.inf
    return p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0)))


def _grow(x: dict[str, np.ndarray], bad: np.ndarray, spec: RuleSpec) -> Rule:
    rule: list[Condition] = []
    hit = np.ones(len(bad), bool)
    while len(rule) < spec.max_conditions:
        p0, n0 = int((hit & bad).sum()), int((hit & ~bad).sum())
        if p0 == 0 or n0 == 0:
            break
        best, choice = 0.0, None
        for name in FEATURES:
            values, is_bad = x[name][hit], bad[hit]
            cuts = np.unique(np.quantile(values, np.linspace(0, 1, spec.cuts + 1), method="lower"))[:-1]
            order = np.argsort(values, kind="stable")
            ranked = values[order]
            below = np.searchsorted(ranked, cuts, side="right")
            bad_below = np.concatenate([[0], np.cumsum(is_bad[order])])[below]
            # Thresholds lie halfway to the next value that occurs, not on one.
            halfway = (ranked[below - 1] + ranked[np.minimum(below, len(ranked) - 1)]) / 2
            for cut, k, b in zip(halfway, below, bad_below):
                for above in (False, True):
                    p = int(p0 - b if above else b)
                    n = int((len(values) - k if above else k) - p)
                    gain = _gain(p, n, p0, n0) if p + n >= spec.min_cover else -math.inf
                    if gain > best + 1e-12:
                        best, choice = gain, Condition(name, above, float(cut))
        if choice is None:
            break
        rule.append(choice)
        hit &= choice.holds(x)
    return tuple(rule)


def _prune(rule: Rule, x: dict[str, np.ndarray], bad: np.ndarray) -> Rule:
    """Drop last conditions as long as the rule does no worse on rows it was not grown on."""

    def worth(r: Rule) -> float:
        hit = _covers(r, x, len(bad))
        p, n = int((hit & bad).sum()), int((hit & ~bad).sum())
        return (p - n) / (p + n) if p + n else -1.0

    while len(rule) > 1 and worth(rule[:-1]) >= worth(rule):
        rule = rule[:-1]
    return rule


def learn_rules(x: dict[str, np.ndarray], bad: np.ndarray, grow_on: np.ndarray, spec: RuleSpec) -> list[Rule]:
    """Sequential covering: grow a rule, prune it on the other rows, set aside what it covers, repeat."""
    rules: list[Rule] = []
    left = np.ones(len(bad), bool)
    while len(rules) < spec.max_rules and (bad & left).any():
        part = lambda mask: ({k: v[mask] for k, v in x.items()}, bad[mask])
        rule = _grow(*part(left & grow_on), spec)
        if not rule:
            break
        held, held_bad = part(left & ~grow_on)
        rule = _prune(rule, held, held_bad) if len(held_bad) else rule
        hit = _covers(rule, x, len(bad)) & left
        unseen = hit & ~grow_on
        seen = unseen if unseen.sum() >= spec.min_cover else hit
        if hit.sum() < spec.min_cover or bad[seen].mean() < spec.min_precision:
            break
        rules.append(rule)
        left &= ~hit
    return rules


def rules_sql(rules: list[Rule]) -> str:
    """The ordered list as one conditional expression: true where a document is rejected."""
    if not rules:
        return "false"
    cases = " ".join(f"WHEN {' AND '.join(c.sql() for c in rule)} THEN true" for rule in rules)
    return f"CASE {cases} ELSE false END"


def labelled_sample(labels: DataFrame, max_rows: int, id_col: str = "doc_id", label: str = "quality") -> DataFrame:
    """At most ``max_rows`` labelled ids, those with the lowest hash; ids without a label are left out."""
    ids = labels.where(F.col(label).isNotNull() & F.col(id_col).isNotNull())
    ids = ids.groupBy(F.col(id_col).alias("_id")).agg(F.min(label).alias("_label"))
    return ids.orderBy(F.xxhash64("_id"), "_id").limit(max_rows)


def fit_rules(
    docs: DataFrame, labels: DataFrame, spec: RuleSpec | None = None, id_col: str = "doc_id", text_col: str = "text",
) -> list[Rule]:
    """Learn rules that reject what ``labels.quality`` marks 0; no labels give no rules."""
    spec = spec or RuleSpec()
    sample = F.broadcast(labelled_sample(labels, spec.max_rows, id_col))  # at most max_rows ids
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_t")).join(sample, "_id")
    rows = with_counts(rows, "_t", ("_id", "_label")).where(~base_failed())
    # Ids may repeat in the documents; one row for each keeps the sample bounded.
    rows = rows.select("_id", "_label", *[F.expr(e).alias(n) for n, e in FEATURES.items()]).dropDuplicates(["_id"])
    pdf = rows.toPandas().sort_values("_id", ignore_index=True)
    if pdf.empty:
        return []
    x = {n: pdf[n].to_numpy("float64") for n in FEATURES}
    grow_on = pd.util.hash_array(pdf["_id"].to_numpy("int64")) % np.uint64(3) > 0
    return learn_rules(x, pdf["_label"].to_numpy() == 0, grow_on, spec)


def judge(
    docs: DataFrame, rules: list[Rule], text_col: str = "text", keep: tuple[str, ...] = ("doc_id",),
) -> DataFrame:
    """``keep``, the counts, ``base_failed``, ``rule`` (number of the rule that rejects, from 1) and ``kept``.

    A text fails the base with fewer than ten words or a fifth of its words in repeated windows; the
    list decides on the rest. Null and empty texts fail; repeated rows get the same verdict each; empty
    tables give no rows. Counting is one pass; the rules are ordered conditions inside the query.
    """
    counted = with_counts(docs, text_col, keep).withColumn("base_failed", base_failed())
    number = F.expr("CASE " + " ".join(
        f"WHEN {' AND '.join(c.sql() for c in rule)} THEN {i}" for i, rule in enumerate(rules, 1)
    ) + " ELSE 0 END") if rules else F.lit(0)
    rejected = F.expr(rules_sql(rules))
    return counted.withColumn("rule", F.when(~F.col("base_failed"), number)).withColumn(
        "kept", ~F.col("base_failed") & ~rejected
    )


def keep_good(
    docs: DataFrame, labels: DataFrame, spec: RuleSpec | None = None, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """``docs`` without the rows that base or rules reject; columns as they were.

    The other columns ride along through the counting pass, so nothing is joined or shuffled.
    """
    rules = fit_rules(docs, labels, spec, id_col, text_col)
    names = docs.columns
    inner = [f"_c{i}" for i in range(len(names))]
    out = judge(docs.toDF(*inner), rules, inner[names.index(text_col)], tuple(inner))
    return out.where("kept").select(*[F.col(i).alias(n) for i, n in zip(inner, names)])
