"""Files that keep arriving: score each as it lands and keep arrival statistics.

Cleaning and scoring are row-wise, so the stream needs no state and reuses the batch plans as they
are. Labels look ahead in a history and therefore stay a batch job.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from earlywarn.functions import null_tokens
from earlywarn.operators.calibration import CalibratedModel
from earlywarn.operators.profile import missing_fractions
from earlywarn.operators.report import label_counts
from earlywarn.plans.score import score
from earlywarn.sources.files import read_delimited, reader_options
from earlywarn.sources.registry import ModelNotFound, list_runs, load_model


def arriving_files(
    spark: SparkSession,
    folder: str,
    columns: Sequence[str],
    sep: str = ",",
    files_per_batch: int | None = None,
) -> DataFrame:
    """Stream of text records from CSV files that appear in ``folder``, all with these columns in this
    order. Files are read as in batch; a file with another header stops the stream instead of being
    read into the wrong columns. :func:`run_files_to_table` takes files of any layout.
    """
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    reader = spark.readStream.schema(schema).options(**reader_options(sep))
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    df = reader.csv(folder)
    return df.select(*[null_tokens(c).alias(c) for c in columns])


def run_to_table(
    stream: DataFrame,
    transform: Callable[[DataFrame], DataFrame],
    target: str,
    checkpoint: str,
) -> StreamingQuery:
    """Process everything that has arrived, exactly once, into Parquet files at ``target``."""
    return (
        transform(stream).writeStream.format("parquet").option("path", target)
        .option("checkpointLocation", checkpoint).outputMode("append")
        .trigger(availableNow=True).start()
    )


def run_files_to_table(
    spark: SparkSession,
    folder: str,
    columns: Sequence[str],
    transform: Callable[[DataFrame], DataFrame],
    target: str,
    checkpoint: str,
    files_per_batch: int = 1000,
) -> StreamingQuery:
    """Read each arriving file by its own header and separator, transform, and write Parquet.

    The stream only tells which files are new; their rows are read as every batch read does, so
    columns are bound by name. Output stands under the batch number and is overwritten, so a replayed
    batch replaces itself. At most ``files_per_batch`` paths come to the driver at a time.
    """
    listed = (
        spark.readStream.format("binaryFile")
        .schema("path string, modificationTime timestamp, length bigint, content binary")
        .option("maxFilesPerTrigger", files_per_batch).load(folder).select("path")
    )

    def one_batch(batch: DataFrame, number: int) -> None:
        paths = [r["path"] for r in batch.collect()]
        if paths:
            rows = read_delimited(batch.sparkSession, paths, columns=columns)
            transform(rows).write.mode("overwrite").parquet(f"{target}/batch={number}")

    return (
        listed.writeStream.foreachBatch(one_batch).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


MANIFEST = "number bigint, model_id string, version string, files array<string>"


def run_files_with_model(
    spark: SparkSession,
    folder: str,
    columns: Sequence[str],
    registry: str,
    target: str,
    checkpoint: str,
    model_id: str | None = None,
    transform: Callable[[CalibratedModel, DataFrame], DataFrame] = score,
    files_per_batch: int = 1000,
) -> StreamingQuery:
    """Score arriving files with a saved model, and record which model scored which files.

    Every batch first writes a manifest under ``target/manifest``: its number, the model and its version,
    and the files; then it loads that model and writes the scored rows under ``target/scored``. Without
    a ``model_id`` a batch takes the newest run of the registry. A batch that is replayed after a failure
    finds its manifest and repeats what stands there, so it gives the same rows even if a newer model was
    saved meanwhile; batches after it move on to that one. Files are read by their own header.
    """
    listed = (
        spark.readStream.format("binaryFile")
        .schema("path string, modificationTime timestamp, length bigint, content binary")
        .option("maxFilesPerTrigger", files_per_batch).load(folder).select("path")
    )

    def manifest_of(session: SparkSession, batch: DataFrame, number: int):
        place = f"{target}/manifest/batch={number}"
        known = _stored_rows(session, place)
        if known:
            return known[0]
        # One path for each file of the batch, whose number is bounded.
        files = sorted(r["path"] for r in batch.collect())
        runs = list_runs(session, registry)
        run = (runs if model_id is None else runs.where(F.col("model_id") == model_id)).first()
        if run is None:
            raise ModelNotFound(f"no model {model_id or ''} under {registry}")
        line = session.createDataFrame([(number, run["model_id"], run["version"], files)], MANIFEST)
        line.coalesce(1).write.mode("overwrite").json(place)
        return line.first()

    def one_batch(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        entry = manifest_of(session, batch, number)
        if entry["files"]:
            rows = read_delimited(session, entry["files"], columns=columns)
            scored = transform(load_model(entry["model_id"], registry), rows)
            scored = scored.withColumn("model_id", F.lit(entry["model_id"]))
            scored.write.mode("overwrite").parquet(f"{target}/scored/batch={number}")

    return (
        listed.writeStream.foreachBatch(one_batch).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def _stored_rows(spark: SparkSession, place: str) -> list:
    """The lines of a manifest; none when it was not written, or not to its end."""
    try:
        return spark.read.schema(MANIFEST).json(f"{place}/*.json").collect()
    except AnalysisException as exc:
        if "PATH_NOT_FOUND" not in str(exc):
            raise
        return []


def run_with_statistics(
    stream: DataFrame,
    transform: Callable[[DataFrame], DataFrame],
    target: str,
    statistics: str,
    checkpoint: str,
    label: str | None = "risk_label",
) -> StreamingQuery:
    """Like :func:`run_to_table`, with missing rates and risk counts recorded per batch.

    Both outputs are written under the batch number with overwrite, so a replayed batch replaces
    itself.
    """

    def one_batch(batch: DataFrame, number: int) -> None:
        rows = transform(batch).persist()
        try:
            rows.write.mode("overwrite").parquet(f"{target}/batch={number}")
            stats = missing_fractions(rows).select(
                F.lit("missing").alias("kind"), F.col("column").alias("name"),
                F.col("missing").alias("n"), "rows",
            )
            if label is not None and label in rows.columns:
                total = F.lit(rows.count()).cast("bigint")
                stats = stats.unionByName(
                    label_counts(rows, label).select(
                        F.lit("risk").alias("kind"), F.col(label).alias("name"), "n",
                        total.alias("rows"),
                    )
                )
            stats.write.mode("overwrite").parquet(f"{statistics}/batch={number}")
        finally:
            rows.unpersist()

    return (
        stream.writeStream.foreachBatch(one_batch).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
