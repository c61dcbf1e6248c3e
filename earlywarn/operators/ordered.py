"""Looking ahead along an ordered history, also when one history is enormous."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from earlywarn.functions import named
from earlywarn.session import pin

# A history longer than this is cut into ranges; below it one task sorts it comfortably.
MAX_GROUP_ROWS = 5_000_000
# A task sorts about so many rows of long histories, in as many ranges as these make.
TASK_ROWS = 500_000
# Keys this few fit in every executor many times over.
MAX_BROADCAST_KEYS = 200_000


def next_name(value: str, k: int) -> str:
    return f"_next{k}_{value}"


def _order(columns: Sequence[str]) -> list[Column]:
    return [F.col(c).asc_nulls_last() for c in columns]


def _with_leads(df, keys, order, values, depth) -> DataFrame:
    # Every lead shares one window, so the plan has one exchange and one sort. Rows without a key
    # have no history; they are spread over many groups rather than heaped into one.
    orphan = F.greatest(*[F.col(k).isNull().cast("int") for k in keys], F.lit(0)) == 1
    spread = F.when(orphan, F.pmod(F.xxhash64(*order), F.lit(4096))).otherwise(F.lit(0))
    w = Window.partitionBy(*keys, spread).orderBy(*_order(order))
    return df.withColumns(
        {
            next_name(v, k): F.when(~orphan, F.lead(v, k).over(w))
            for v in values
            for k in range(1, depth + 1)
        }
    )


def with_followers(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    values: Sequence[str],
    depth: int,
    max_group_rows: int | None = MAX_GROUP_ROWS,
) -> DataFrame:
    """Append each value of the next ``depth`` rows of the same key.

    ``order`` must be a total order within a key. Ordinary keys go through one window. A count over
    the key column alone (combined map-side, before anything wide moves) finds keys longer than
    ``max_group_rows``; their rows are range-partitioned on (key, order) instead and cut into ranges
    (see :func:`_in_ranges`), each range is a window of its own, and only the first ``depth`` rows of a
    range are handed to the range before it. ``None`` skips the check, for input known to be short per key.
    """
    split = _split_long(df, keys, max_group_rows)
    if split is None:
        return _with_leads(df, keys, order, values, depth)
    usual, heavy, ranges = split
    out = _ranged_leads(heavy, keys, order, values, depth, ranges)
    return _with_leads(usual, keys, order, values, depth).unionByName(out)


@dataclass(frozen=True)
class _Ranges:
    """How rows of long keys are cut: into so many tasks, and each task's rows into ranges of so many."""

    tasks: int
    rows: int


def _split_long(df, keys, max_group_rows) -> tuple[DataFrame, DataFrame, _Ranges] | None:
    """Rows of ordinary keys, rows of keys longer than ``max_group_rows``, and how the latter are cut into
    ranges; None without such keys."""
    if max_group_rows is None:
        return None
    sizes = df.where(F.col(keys[0]).isNotNull()).groupBy(*keys).count()
    long_keys = sizes.where(F.col("count") > max_group_rows)
    found = long_keys.agg(F.count("*").alias("n"), F.sum("count").alias("rows")).first()
    if not found["n"]:
        return None
    picked = long_keys.drop("count")
    if found["n"] <= MAX_BROADCAST_KEYS:
        picked = F.broadcast(picked)
    usual = df.join(picked, list(keys), "left_anti").select(*[named(c) for c in df.columns])
    heavy = df.join(picked, list(keys), "left_semi").select(*[named(c) for c in df.columns])
    # Ranges may be many, tasks are not: every task costs the driver a sample of its rows and a result.
    usable = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tasks = max(usable, math.ceil(found["rows"] / TASK_ROWS))
    return usual, heavy, _Ranges(min(tasks, math.ceil(2 * found["rows"] / max_group_rows)), max_group_rows)


def _in_ranges(df: DataFrame, order: list[Column], ranges: _Ranges) -> DataFrame:
    """Add ``_range``: rows in ``order`` are dealt to tasks, and a task's sorted rows cut after every
    ``ranges.rows`` of them; later rows are in the same range or one of a higher number.

    The range a row falls in must not change between its uses, hence the checkpoint.
    """
    dealt = df.repartitionByRange(ranges.tasks, *order).sortWithinPartitions(*order)
    placed = dealt.withColumn("_range", F.monotonically_increasing_id())
    task, place = F.shiftright("_range", 33), F.col("_range").bitwiseAND(F.lit((1 << 33) - 1))
    return pin(placed.withColumn("_range", F.shiftleft(task, 33) + F.floor(place / ranges.rows)))


def _ranged_leads(df, keys, order, values, depth, ranges) -> DataFrame:
    ranged = _in_ranges(df, [*[F.col(k) for k in keys], *_order(order)], ranges)
    inside = Window.partitionBy(*keys, "_range").orderBy(*_order(order))
    needed = list(dict.fromkeys([*keys, *order, *values]))
    heads = (
        ranged.select(*needed, "_range")
        .withColumn("_pos", F.row_number().over(inside))
        .where(F.col("_pos") <= depth)
        .drop("_pos")
    )
    # Per key there are at most depth rows for each range: small, and independent of the row count.
    along = Window.partitionBy(*keys).orderBy(*_order(order))
    carried = list(dict.fromkeys([*order, *values]))
    borrowed = (
        heads.withColumns(
            {
                "_last": F.coalesce(F.lead("_range", 1).over(along) != F.col("_range"), F.lit(False)),
                "_ahead": F.collect_list(F.struct(*carried)).over(along.rowsBetween(1, depth)),
            }
        )
        .where("_last")
        .select(*keys, "_range", F.explode("_ahead").alias("_row"))
        .select(*keys, "_range", "_row.*")
        .withColumn("_borrowed", F.lit(True))
    )
    both = ranged.withColumn("_borrowed", F.lit(False)).unionByName(
        borrowed, allowMissingColumns=True
    )
    leads = {
        next_name(v, k): F.lead(v, k).over(inside) for v in values for k in range(1, depth + 1)
    }
    return both.withColumns(leads).where(~F.col("_borrowed")).drop("_borrowed", "_range")


def _later(keys: Sequence[str], time: str):
    # Backwards in time, so that the frame only ever grows and a history is passed over once.
    return Window.partitionBy(*keys).orderBy(F.col(time).desc()).rangeBetween(Window.unboundedPreceding, -1)


def with_next_event(
    df: DataFrame,
    key: str,
    time: str,
    event: str,
    output: str,
    tie: Sequence[str],
    max_group_rows: int | None = MAX_GROUP_ROWS,
) -> DataFrame:
    """Append the time of the key's first event later than the row: a minimum over the rows after it.

    ``time`` is a whole number, ``event`` a boolean. Rows without a key or a time get NULL. Rows of a key
    longer than ``max_group_rows`` are cut into ranges of (key, time, tie), each a window of its own; a
    range takes over, from the ranges after it, the first event later than its rows. Nothing is joined
    back to the rows but one line per range.
    """
    orphan = F.col(key).isNull() | F.col(time).isNull()
    at = F.when(F.col(event) & ~orphan, F.col(time))
    split = _split_long(df, [key], max_group_rows)
    usual = df if split is None else split[0]
    spread = F.when(orphan, F.pmod(F.xxhash64(*tie), F.lit(4096))).otherwise(F.lit(0))
    marked = usual.withColumn("_spread", spread)
    plain = marked.withColumn(
        output, F.when(~orphan, F.min(at).over(_later([key, "_spread"], time)))
    ).drop("_spread")
    if split is None:
        return plain
    _, heavy, ranges = split
    timed = heavy.where(~orphan)
    untimed = heavy.where(orphan).withColumn(output, F.lit(None).cast(df.schema[time].dataType))
    out = _ranged_next_event(timed, key, time, at, output, tie, ranges).unionByName(untimed)
    return plain.unionByName(out.select(*map(named, plain.columns)))


def _ranged_next_event(df, key, time, at, output, tie, ranges) -> DataFrame:
    # The place last, so that even equal rows can be divided.
    order = [F.col(key), F.col(time), *_order(tie), F.col("_row")]
    numbered = df.withColumn("_row", F.monotonically_increasing_id())
    ranged = _in_ranges(numbered, order, ranges).drop("_row")
    local = ranged.withColumn(output, F.min(at).over(_later([key, "_range"], time)))
    # One line for each range of a key. A moment may fill several ranges, so the first event of a range
    # is kept twice: of all its rows, and of those later than its first moment.
    first = F.min(time).over(Window.partitionBy(key, "_range"))
    lines = ranged.withColumn("_opens", first).groupBy(key, "_range").agg(
        F.min(time).alias("_from"), F.max(time).alias("_to"), F.min(at).alias("_any"),
        F.min(F.when(F.col(time) > F.col("_opens"), at)).alias("_late"),
    )
    along = Window.partitionBy(key).orderBy("_range")
    backwards = Window.partitionBy(key).orderBy(F.col("_range").desc())
    carried = F.min("_any").over(backwards.rowsBetween(Window.unboundedPreceding, -1))
    lines = lines.withColumn("_carry", carried)
    # For rows at a range's last moment: the next range that reaches beyond it follows the last range
    # that ends at it.
    following = {c: F.lead(c).over(along) for c in ("_from", "_any", "_late", "_carry")}
    beyond = F.when(
        following["_from"] > F.col("_to"), F.least(following["_any"], following["_carry"])
    ).otherwise(F.least(following["_late"], following["_carry"]))
    lines = lines.withColumn("_beyond", beyond)
    same_end = Window.partitionBy(key, "_to").orderBy("_range").rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing
    )
    lines = lines.select(key, "_range", "_to", "_carry", F.last("_beyond").over(same_end).alias("_beyond"))
    # Ordered ranges meet at one key at most, so the lines are as few as the long keys and the ranges.
    placed = local.join(lines, [key, "_range"])
    later = F.when(F.col(time) == F.col("_to"), F.col("_beyond")).otherwise(F.col("_carry"))
    return placed.withColumn(output, F.least(output, later)).drop("_range", "_to", "_carry", "_beyond")
