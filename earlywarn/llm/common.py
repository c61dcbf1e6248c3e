"""Shared pieces of the corpus operators: words, stored intermediate tables, row numbers."""

from __future__ import annotations

import gc
import os
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from earlywarn.session import scratch_path

#: Space and the control characters tab to carriage return separate words.
SPACE = r"[\x20\x09-\x0D]"
NOT_SPACE = r"[^\x20\x09-\x0D]"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the folder all executors share and read it back.

    Unlike a cache, the files survive the loss of an executor, and what reads them has no lineage.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table._stored_at = path
    return table


def discard(*tables: DataFrame | None) -> None:
    """Delete tables of :func:`stored` that nothing reads any more, because what was made of them is
    stored too. Shuffle files of finished jobs go when the driver's collector finds them unused."""
    for table in tables:
        path = getattr(table, "_stored_at", None)
        if path is not None:
            session = table.sparkSession
            where = session._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(session._jsc.hadoopConfiguration()).delete(where, True)


def collect_garbage(spark: SparkSession) -> None:
    """Let the driver drop plans that are no longer held, so that Spark deletes their shuffle files; with a
    large heap it might otherwise keep those of all turns of a loop."""
    gc.collect()
    spark._jvm.System.gc()


def with_places(docs: DataFrame, names: list[str], from_files: bool) -> DataFrame:
    """``docs`` with its columns renamed to ``names``, and ``_file, _at``: where a row stands in its file.

    Places are the same whenever and by however many tasks the files are read. ``from_files`` says that
    ``docs`` reads files row by row (columns and filters at most); other rows are written first.
    """
    def placed(df: DataFrame) -> DataFrame:
        return df.select(
            "*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_at")
        )

    named = docs.toDF(*names)
    if from_files:
        try:
            return placed(named)
        except AnalysisException:  # not files after all
            pass
    return placed(stored(named, "placed"))


def reachable(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it, if it isn't installed."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    paths = spark.sparkContext.environment.get("PYTHONPATH", "").split(os.pathsep)
    if root not in paths:
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join([root, *filter(None, paths)])


@contextmanager
def small_batches(spark: SparkSession, most: str = "8m") -> Iterator[None]:
    """Within, tables are sent to Python in batches of few bytes whatever rows hold: with long texts the ten thousand
    rows of a batch take more of an executor's memory, in both processes, than all else there."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key, None)
    spark.conf.set(key, most)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


#: Rows that ``map_arrow`` functions see at a time; what they hold besides the batch stays small.
SLICE = 1_000


def map_arrow(df: DataFrame, fn, schema) -> DataFrame:
    """``mapInArrow`` in small slices, with workers that can import this package."""
    reachable(df.sparkSession)

    def sliced(batches):
        return fn(batch.slice(at, SLICE) for batch in batches for at in range(0, batch.num_rows, SLICE))

    return df.mapInArrow(sliced, schema)


def text_of(column: str) -> Column:
    """The text, with null read as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def split_words(text: Column) -> Column:
    """All words of a text, in order."""
    return F.filter(F.split(text, SPACE + "+"), lambda w: w != "")


def word_count(text: Column) -> Column:
    """Number of words: the runs of spaces left after trimming, and one more."""
    trimmed = F.regexp_replace(text, f"^{SPACE}+|{SPACE}+$", "")
    runs = F.size(F.split(trimmed, SPACE + "+"))
    return F.when(trimmed == "", F.lit(0)).otherwise(runs).cast("long")


def with_row_numbers(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Add ``name``: 0, 1, 2… in the given order, without sending all rows through one task.

    The rows are range-sorted; a row's number is its place in its partition plus the rows of the
    partitions before it. Only one count per partition passes through a single task.
    """
    marked = stored(df.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()), "ordered")
    part, place = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    marked = marked.withColumns({"_part": part, "_place": place})
    sizes = marked.groupBy("_part").agg(F.count(F.lit(1)).alias("_rows"))
    before = sizes.alias("a").join(
        F.broadcast(sizes.alias("b")), F.col("b._part") < F.col("a._part"), "left"
    )
    before = before.groupBy(F.col("a._part").alias("_part")).agg(
        F.coalesce(F.sum("b._rows"), F.lit(0)).alias("_before")
    )
    return (
        marked.join(F.broadcast(before), "_part")  # one row per partition
        .withColumn(name, F.col("_before") + F.col("_place"))
        .drop("_at", "_part", "_place", "_before")
    )
