"""Left joins onto a table with one row per key, safe for hot keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from earlywarn.functions import named

# Above this many rows, or this many bytes, a lookup table is not shipped to every executor.
MAX_BROADCAST_ROWS = 200_000
MAX_BROADCAST_BYTES = 64 << 20
DEFAULT_SALTS = 16
# A key is hot when it holds one row of so many; hot keys are therefore at most as many.
HOT_SHARE = 200
# Counters of the sketch that finds them: it errs by less than one row in a third of these.
_TRACKED = 10_000


def table_bytes(table: DataFrame) -> int:
    """The bytes a table's values take up: the strings as they are, everything else as 16 a value."""
    sizes = [
        F.coalesce(F.octet_length(named(c)), F.lit(0)) + 16 if t == "string" else F.lit(16 + 16 * t.count(":"))
        for c, t in table.dtypes
    ]
    total = sizes[0]
    for s in sizes[1:]:
        total = total + s
    return table.agg(F.coalesce(F.sum(total.cast("bigint")), F.lit(0))).first()[0]


def hot_keys(df: DataFrame, keys: Sequence[str], share: int = HOT_SHARE) -> list[int]:
    """Hashes of the keys that hold at least one row in ``share``, from one pass over the keys alone.

    Each task keeps a sketch of its most frequent keys, and the sketches are merged. Counts are upper
    estimates, so no hot key is missed; a key that is nearly hot may come along.
    """
    row = df.select(_hash(keys).alias("_h")).agg(
        F.count(F.lit(1)).alias("n"), F.expr(f"approx_top_k(_h, {2 * share}, {_TRACKED})").alias("top")
    ).first()
    return [t["item"] for t in row["top"] or [] if t["count"] * share >= row["n"]]


def _hash(keys: Sequence[str]) -> Column:
    return F.xxhash64(*[named(k) for k in keys])


def lookup_join(
    df: DataFrame,
    table: DataFrame,
    keys: Sequence[str],
    rows: int | None = None,
    salts: int = DEFAULT_SALTS,
    size: int | None = None,
) -> DataFrame:
    """Left-join ``table`` (unique on ``keys``).

    ``rows`` is the counted size of the table, ``size`` its bytes (measured here when rows are few enough
    and it is not given): small in both and it is broadcast. A table of unknown or larger size is joined
    by shuffle. Keys found hot then spread over ``salts`` partitions, and only their rows of the table
    are copied as often; one salt means a plain shuffle join.
    """
    if rows is not None and rows <= MAX_BROADCAST_ROWS:
        if (table_bytes(table) if size is None else size) <= MAX_BROADCAST_BYTES:
            return df.join(F.broadcast(table), list(keys), "left")
    hot = hot_keys(df, keys) if salts > 1 else []
    if not hot:
        return df.join(table, list(keys), "left")
    others = [named(c) for c in df.columns if c not in set(keys)] or [named(k) for k in keys]
    is_hot = _hash(keys).isin(hot)
    spread = F.pmod(F.xxhash64(*others), F.lit(salts)).cast("int")
    salted = df.withColumn("_salt", F.when(is_hot, spread).otherwise(F.lit(0)))
    last = F.when(is_hot, F.lit(salts - 1)).otherwise(F.lit(0))
    copies = table.withColumn("_salt", F.explode(F.sequence(F.lit(0), last)))
    return salted.join(copies, [*keys, "_salt"], "left").drop("_salt")
