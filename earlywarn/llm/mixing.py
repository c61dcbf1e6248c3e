"""Mix sources to target weights along a curriculum."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from earlywarn.llm.common import NOT_SPACE, stored, text_of, with_places, with_row_numbers, word_count


@dataclass(frozen=True)
class MixSpec:
    """``weights`` repeat over the sources in code point order (null last).

    ``slopes`` repeat likewise: source s weighs ``target * (1 + slope * (2t - 1))`` at training
    time t from 0 to 1, so its demand over the whole run is its target. ``budget`` is the share of
    all words to take, ``repeats`` how often a document may be seen at most. ``cell_digits`` hex
    digits of the order hash make the cells whose totals are cumulated first.
    """

    weights: tuple[float, ...] = (5, 2, 1)
    slopes: tuple[float, ...] = (-0.5, 0.0, 0.5)
    budget: float = 1.0
    repeats: int = 3
    cell_digits: int = 3

    def __post_init__(self):
        if not self.weights or min(self.weights) <= 0 or self.repeats < 1:
            raise ValueError("weights must be positive and repeats at least 1")
        if any(not -1 <= s <= 1 for s in self.slopes) or not self.slopes:
            raise ValueError("slopes lie between -1 and 1")
        if not 0 < self.budget <= self.repeats:
            raise ValueError("the budget must be reachable")


def _cycle(values: tuple[float, ...], rank: Column) -> Column:
    return F.element_at(F.array(*[F.lit(float(v)) for v in values]), (rank % len(values) + 1).cast("int"))


def source_targets(sizes: DataFrame, spec: MixSpec) -> DataFrame:
    """``source, source_size`` -> with weight, slope and target; targets stop at the repeat limit.

    What a capped source cannot take goes to the others by weight. Each round only sums over the
    sources; at most as many rounds as sources are needed, usually a handful.
    """
    ranked = with_row_numbers(sizes, [F.col("source").asc_nulls_last()], "rank")
    ranked = stored(
        ranked.select(
            "source", "source_size", _cycle(spec.weights, F.col("rank")).alias("weight"),
            _cycle(spec.slopes, F.col("rank")).alias("slope"),
            (F.col("source_size") * spec.repeats).cast("double").alias("limit"),
        ),
        "sources",
    )
    total = (ranked.agg(F.sum("source_size")).first()[0] or 0) * spec.budget
    level, capped = None, 0.0
    held = -1
    while True:
        full = F.lit(False) if level is None else F.col("limit") <= F.col("weight") * level
        row = ranked.agg(
            F.sum(F.when(full, F.col("limit")).otherwise(0.0)).alias("capped"),
            F.sum(F.when(full, 0.0).otherwise(F.col("weight"))).alias("free"),
            F.count_if(full).alias("held"),
        ).first()
        if row.held == held or not row.free:
            break
        held, capped = row.held, row.capped
        level = (total - capped) / row.free
    target = F.least("limit", F.col("weight") * F.lit(float(level or 0.0)))
    return ranked.select("source", "source_size", "weight", "slope", target.alias("target"))


def mix_plan(
    docs: DataFrame, spec: MixSpec | None = None, id_col: str = "doc_id", text_col: str = "text",
    source_col: str = "source", keep: list[str] | None = None,
) -> DataFrame:
    """One row per document: how many of its words are taken, and where in training.

    Within a source, documents follow the hash of their id (then id, size and digest of the text);
    laid end to end again and again they fill the source's target exactly, so a document is taken
    whole, several times, in part at the end, or not at all. A document stands where the cumulated
    demand of its source's schedule reaches its first word. Returns ``doc_id, source, size,
    source_size, target, taken, positions`` (one training position in [0, 1] per copy) and the columns
    in ``keep``. Null texts have no words, null sources form a source; empty tables give no rows.

    A hot source is divided into cells by hash: cell totals are cumulated first, then the documents
    of each cell, so no task holds a source. Text is read once for its size and digest, and never
    shuffled; ``keep`` is for short columns.
    """
    spec = spec or MixSpec()
    kept = [F.col(f"`{c}`").alias(f"_keep_{i}") for i, c in enumerate(keep or [])]
    size = word_count(text_of(text_col))
    order = F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    rows = docs.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"),
        size.alias("size"), order.alias("order"), F.md5(text_of(text_col)).alias("digest"), *kept,
    ).withColumn("cell", F.substring("order", 1, spec.cell_digits))
    rows = stored(rows, "sizes")
    cells = stored(rows.groupBy("source", "cell").agg(F.sum("size").alias("cell_size")), "cells")
    per_source = cells.groupBy("source").agg(F.sum("cell_size").alias("source_size"))
    targets = stored(source_targets(per_source, spec), "targets")
    so_far = Window.partitionBy("source").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = cells.withColumn("cell_start", F.coalesce(F.sum("cell_size").over(so_far), F.lit(0)))
    starts = _same_source(starts, targets).drop("cell_size")
    in_cell = (
        Window.partitionBy("source", "cell").orderBy("order", F.col("doc_id"), "size", "digest")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    placed = rows.withColumn("in_cell", F.coalesce(F.sum("size").over(in_cell), F.lit(0)))
    a, b = placed.alias("a"), stored(starts, "starts").alias("b")
    placed = a.join(
        b, F.col("a.source").eqNullSafe(F.col("b.source")) & (F.col("a.cell") == F.col("b.cell"))
    ).select("a.*", "b.source_size", "b.target", "b.slope", (F.col("cell_start") + F.col("in_cell")).alias("start"))
    demand = F.floor(F.col("target") + 0.5).cast("long")
    left = demand - F.col("start")
    copies = [
        F.greatest(F.lit(0), F.least(F.col("size"), left - F.col("source_size") * k)).cast("long")
        for k in range(spec.repeats)
    ]
    places = [
        F.when(n > 0, position((F.col("start") + F.col("source_size") * k) / demand, F.col("slope")))
        for k, n in enumerate(copies)
    ]
    taken = copies[0]
    for n in copies[1:]:
        taken = taken + n
    return placed.select(
        "doc_id", "source", "size", "source_size", "target", taken.alias("taken"),
        F.filter(F.array(*places), lambda p: p.isNotNull()).alias("positions"),
        *[F.col(f"_keep_{i}").alias(c) for i, c in enumerate(keep or [])],
    )


def position(share: Column, slope: Column) -> Column:
    """The time at which a source with this slope has met ``share`` of its demand.

    The demand up to t is ``(1 - slope) t + slope t^2`` of the whole; this is its inverse.
    """
    gap = 1.0 - slope
    # A slope of one asks for nothing at the very start, where both sides are zero.
    return F.coalesce(F.try_divide(2.0 * share, gap + F.sqrt(gap * gap + 4.0 * slope * share)), F.lit(0.0))


def _same_source(cells: DataFrame, targets: DataFrame) -> DataFrame:
    a, b = cells.alias("a"), targets.alias("b")
    return a.join(b, F.col("a.source").eqNullSafe(F.col("b.source"))).select(
        "a.*", "b.source_size", "b.target", "b.slope"
    )


def mixed_documents(
    docs: DataFrame, spec: MixSpec | None = None, id_col: str = "doc_id", text_col: str = "text",
    source_col: str = "source", from_files: bool = False,
) -> DataFrame:
    """The mix itself: the rows of ``docs`` in training order, repeated as the plan says.

    The last copy of a document may be cut after the words that are still wanted, keeping the text
    up to there as it is. Columns are those of ``docs``.

    The plan is made of ids and sizes and written; texts meet it once, by their place in their file, and
    are range-sorted once. ``from_files``: ``docs`` reads a table's files row by row; anything else is
    written first, so that rows have a place.
    """
    names = docs.columns
    inner = [f"_c{i}" for i in range(len(names))]
    rows = with_places(docs, inner, from_files)
    named = dict(zip(names, inner))
    plan = mix_plan(rows, spec, named[id_col], named[text_col], named[source_col], keep=["_file", "_at"])
    copies = plan.select(
        "_file", "_at", F.col("doc_id").alias("_id"), F.col("size").alias("_size"), F.col("taken").alias("_taken"),
        F.posexplode("positions").alias("_copy", "_position"),
    )
    copies = stored(copies, "copies")
    wanted = F.least(F.col("_size"), F.col("_taken") - F.col("_size") * F.col("_copy"))
    text = F.col(named[text_col])
    # Every piece is a word with the space before it.
    pieces = F.split(text, f"(?<={NOT_SPACE})(?=[\\x20\\x09-\\x0D])")
    cut = F.when(wanted < F.col("_size"), F.array_join(F.slice(pieces, 1, wanted.cast("int")), "")).otherwise(text)
    out = rows.join(copies.hint("merge"), ["_file", "_at"]).withColumn(named[text_col], cut)
    out = out.orderBy("_position", F.col("_id"), "_copy")
    return out.select(*[F.col(i).alias(n) for i, n in zip(inner, names)])
