"""Delimited text in, delimited text and JSON records out."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from functools import reduce

import pandas as pd
from pyarrow.fs import FileSystem
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from earlywarn.functions import named, null_tokens
from earlywarn.operators.filters import UnusableData
from earlywarn.presets import CRITICAL_COLUMNS, REQUIRED_COLUMNS

SEPARATORS = (",", ";", "\t", "|")
# What to do with rows whose number of cells is not that of the header.
FAIL, DROP = "fail", "drop"
_BROKEN = "_broken_row"


def reader_options(sep: str, encoding: str = "UTF-8", multiline: bool = False) -> dict[str, str]:
    """How every delimited file is read, in batch and as a stream."""
    return {
        "header": "true", "sep": sep, "multiLine": str(multiline).lower(), "escape": '"',
        "mode": "PERMISSIVE", "enforceSchema": "false", "encoding": encoding,
    }


def _raw(
    spark: SparkSession, paths: list[str], sep: str, names: Sequence[str], encoding: str, multiline: bool,
    broken: bool,
) -> DataFrame:
    fields = [T.StructField(n, T.StringType()) for n in names]
    reader = spark.read.options(**reader_options(sep, encoding, multiline))
    if broken:
        # Cells are only counted when no column is left out of the parsing.
        fields.append(T.StructField(_BROKEN, T.StringType()))
        reader = reader.option("columnNameOfCorruptRecord", _BROKEN).option("columnPruning", "false")
    return reader.schema(T.StructType(fields)).csv(paths)


def _parsed(names: Sequence[str]) -> Column:
    """Always true, but looks at a cell: the reader refuses to tell broken rows by themselves."""
    return F.length(F.concat_ws("", named(names[0]))) >= 0


def file_groups(
    spark: SparkSession, path: str | Sequence[str], sep: str | None = None, encoding: str = "UTF-8"
) -> list[tuple[str, list[str], list[str]]]:
    """(separator, header, files) for each layout among the files; the header line of a file decides."""
    paths = [path] if isinstance(path, str) else list(path)
    heads = header_catalogue(spark, paths, sep, encoding)
    each = heads.groupBy("file").agg(
        F.first("sep").alias("sep"), F.sort_array(F.collect_list(F.struct("position", "header"))).alias("cells")
    )
    layouts = each.groupBy("sep", F.col("cells.header").alias("header")).agg(
        F.sort_array(F.collect_list("file")).alias("files")
    )
    found = [(r["sep"], list(r["header"]), list(r["files"])) for r in layouts.collect()]
    if not found:
        raise UnusableData(f"{path} is empty")
    return sorted(found, key=lambda g: g[2])


def read_delimited(
    spark: SparkSession,
    path: str | Sequence[str],
    sep: str | None = None,
    columns: Sequence[str] | None = None,
    multiline: bool = False,
    encoding: str = "UTF-8",
    bad_rows: str = FAIL,
) -> DataFrame:
    """Read with a header row, every column as text, missing markers as NULL.

    Types are never inferred: that would need a second pass and could differ between files. Files may
    differ in separator and order of columns; each is read by its own header line, and a column that
    a file lacks is NULL there. ``columns`` prunes the result.

    A row with more or fewer cells than its header is never bent into shape: the read fails on it, or,
    with ``bad_rows="drop"``, leaves it to :func:`malformed_rows`.
    """
    if bad_rows not in (FAIL, DROP):
        raise ValueError("bad_rows is 'fail' or 'drop'")
    parts = []
    for own_sep, names, files in file_groups(spark, path, sep, encoding):
        df = _raw(spark, files, own_sep, names, encoding, multiline, broken=True)
        broken, fits = named(_BROKEN), _parsed(names) & named(_BROKEN).isNull()
        if bad_rows == FAIL:
            stop = F.raise_error(F.concat(F.lit("a row does not fit its header: "), broken))
            fits = F.when(fits, True).otherwise(stop.cast("boolean"))
        df = df.where(fits)
        wanted = [c for c in (columns if columns is not None else names) if c in names]
        parts.append(df.select(*[null_tokens(named(c)).alias(c) for c in wanted]))
    out = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    absent = [c for c in (columns or []) if c not in out.columns]
    if absent:
        raise UnusableData(f"no file has the columns {absent}")
    return out.select(*map(named, columns)) if columns is not None else out


def malformed_rows(
    spark: SparkSession, path: str | Sequence[str], sep: str | None = None, encoding: str = "UTF-8"
) -> DataFrame:
    """(file, record): the rows whose number of cells is not that of their file's header."""
    parts = []
    for own_sep, names, files in file_groups(spark, path, sep, encoding):
        df = _raw(spark, files, own_sep, names, encoding, False, broken=True)
        df = df.where(_parsed(names) & named(_BROKEN).isNotNull())
        parts.append(df.select(F.col("_metadata.file_path").alias("file"), named(_BROKEN).alias("record")))
    return reduce(DataFrame.unionByName, parts)


def header_of(spark: SparkSession, path: str, sep: str = ",") -> list[str]:
    """Column names only. The schema of a header-only read is known without scanning the rows."""
    reader = spark.read.option("header", True).option("sep", sep).option("inferSchema", False)
    return reader.option("escape", '"').csv(path).columns


def _first_lines(spark: SparkSession, paths: Sequence[str], encoding: str) -> DataFrame:
    """(file, head, error) for every file, in one job.

    Files are listed without their content; each task then opens its files and reads no further than
    the first line. A file that cannot be read or decoded is reported, not fatal.
    """

    def first_lines(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            heads, errors = [], []
            for path in batch["path"]:
                head, error = None, None
                try:
                    # Hadoop writes local paths as file:/x and has names of its own for object stores.
                    plain = re.sub(r"^s3[an]:", "s3:", re.sub(r"^file:/+", "/", path))
                    system, inner = FileSystem.from_uri(plain)
                    data = b""
                    with system.open_input_stream(inner) as stream:
                        while b"\n" not in data and (block := stream.read(65536)):
                            data += block
                    head = data.split(b"\n", 1)[0].decode(encoding).removeprefix("\ufeff").rstrip("\r")
                except Exception as exc:  # noqa: BLE001
                    error = f"{type(exc).__name__}: {exc}"
                heads.append(head)
                errors.append(error)
            yield pd.DataFrame({"file": batch["path"], "head": heads, "error": errors})

    listed = (
        spark.read.format("binaryFile").option("recursiveFileLookup", True).load(list(paths)).select("path")
    )
    return listed.mapInPandas(first_lines, "file string, head string, error string")


def unreadable_files(spark: SparkSession, path: str | Sequence[str], encoding: str = "UTF-8") -> DataFrame:
    """(file, error): the files whose header line cannot be read in this encoding."""
    paths = [path] if isinstance(path, str) else path
    return _first_lines(spark, paths, encoding).where("error IS NOT NULL").select("file", "error")


def header_catalogue(
    spark: SparkSession, path: str | Sequence[str], sep: str | None = None, encoding: str = "UTF-8"
) -> DataFrame:
    """(file, position, header, sep) for every readable file below ``path``; see :func:`unreadable_files`.

    Separators inside quotes do not count. Without a given one, each file uses the candidate that
    splits its first line into most cells.
    """
    paths = [path] if isinstance(path, str) else path
    first = _first_lines(spark, paths, encoding).where("head <> ''")
    outside = '(?=(?:[^"]*"[^"]*")*[^"]*$)'
    ways = []
    for rank, s in enumerate((sep,) if sep else SEPARATORS):
        cells = F.split("head", f"\\Q{s}\\E{outside}")
        ways.append(
            F.struct(
                F.size(cells).alias("n"), F.lit(-rank).alias("rank"), cells.alias("cells"), F.lit(s).alias("sep")
            )
        )
    best = ways[0] if len(ways) == 1 else F.greatest(*ways)
    split = first.select("file", best["sep"].alias("sep"), F.posexplode(best["cells"]))
    bare = F.replace(F.regexp_replace("col", '^"|"$', ""), F.lit('""'), F.lit('"'))
    return split.select("file", F.col("pos").alias("position"), bare.alias("header"), "sep")


def detect_separator(spark: SparkSession, path: str) -> str:
    """The separator of the first file's header line; a comma when none splits it."""
    return file_groups(spark, path)[0][0]


def check_contract(
    df: DataFrame,
    name: str | None = None,
    required: Sequence[str] = tuple(REQUIRED_COLUMNS),
    critical: Sequence[str] = tuple(CRITICAL_COLUMNS),
) -> list[str]:
    """Raise on unusable input; return the sorted non-critical columns that are missing."""
    if name is not None and not name.lower().endswith(".csv"):
        raise UnusableData("only .csv files are accepted")
    present = set(df.columns)
    fatal = sorted(set(critical) - present)
    if fatal:
        raise UnusableData(f"required columns are missing: {fatal}")
    if df.isEmpty():
        raise UnusableData("the input holds no rows")
    return sorted(set(required) - set(critical) - present)


def contract_report(
    spark: SparkSession,
    path: str | Sequence[str],
    required: Sequence[str] = tuple(REQUIRED_COLUMNS),
    critical: Sequence[str] = tuple(CRITICAL_COLUMNS),
    encoding: str = "UTF-8",
) -> DataFrame:
    """(file, rule, column, rows): one row for each rule that a file below ``path`` breaks.

    Where :func:`check_contract` stops at the first fault of one table, this looks at every file of a
    landing zone in one job and stops at none: names other than ``.csv``, headers that cannot be read,
    critical and other required columns that are missing, columns named twice, files without rows.
    ``rows`` are the lines after the header. Spark's readers do not list files of no bytes at all. Headers are read alone; lines are counted where they lie
    and combined before anything moves.
    """
    paths = [path] if isinstance(path, str) else list(path)
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(paths)
    # Readers spell a file's name in two ways; the listing knows both.
    files = listed.select(F.col("path").alias("file"), F.col("_metadata.file_path").alias("_uri"))
    lines = spark.read.option("recursiveFileLookup", True).text(paths).where(F.trim("value") != "")
    counts = lines.groupBy(F.col("_metadata.file_path").alias("_uri")).agg(F.count(F.lit(1)).alias("_lines"))
    headers = header_catalogue(spark, paths, encoding=encoding).groupBy("file").agg(
        F.collect_list("header").alias("_headers")
    )
    known = files.join(headers, "file", "left").join(counts, "_uri", "left")
    has = F.coalesce("_headers", F.array().cast("array<string>"))
    rows = F.greatest(F.coalesce("_lines", F.lit(0)) - 1, F.lit(0)).cast("bigint")
    sure = set(critical)
    missing = [(c, "critical column missing" if c in sure else "column missing") for c in dict.fromkeys([*critical, *required])]

    def fault(broken: Column, rule: str, column: str = "") -> Column:
        return F.when(broken, F.struct(F.lit(rule).alias("rule"), F.lit(column).alias("column")))

    readable = F.col("_headers").isNotNull()
    twice = F.filter(F.array_distinct(has), lambda h: F.size(F.filter(has, lambda o: o == h)) > 1)
    faults = F.concat(
        F.array(
            fault(~F.lower("file").endswith(".csv"), "not a .csv file"),
            fault(~readable & (F.coalesce("_lines", F.lit(0)) > 0), "header unreadable"),
            fault(rows == 0, "no rows"),
            *[fault(readable & ~F.array_contains(has, c), rule, c) for c, rule in missing],
        ),
        F.transform(twice, lambda h: F.struct(F.lit("column repeated").alias("rule"), h.alias("column"))),
    )
    broken = known.select("file", rows.alias("rows"), F.explode(F.filter(faults, lambda f: f.isNotNull())).alias("_f"))
    return broken.select("file", "_f.rule", "_f.column", "rows")


def write_delimited(df: DataFrame, path: str, sep: str = ",", mode: str = "errorifexists") -> None:
    df.write.mode(mode).option("header", True).option("sep", sep).option("escape", '"').csv(path)


def write_clean_and_dropped(clean: DataFrame, dropped: DataFrame, path: str) -> tuple[str, str]:
    """The standardised rows and the audit of dropped columns, as two CSV folders."""
    # The two output names.
    targets = (f"{path}/dados_ml_padronizados.csv", f"{path}/colunas_descartadas.csv")
    write_delimited(clean, targets[0])
    if dropped.columns:
        write_delimited(dropped, targets[1])
    return targets


def write_records(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One JSON object per row, NULL fields included."""
    df.write.mode(mode).option("ignoreNullFields", False).json(path)


def as_records(df: DataFrame) -> DataFrame:
    return df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("record"))


def write_training_table(df: DataFrame, path: str, year: str = "ano_ingresso") -> None:
    """Labelled rows as Parquet, one folder per year, so that a year split reads only its years.

    The rebalance keeps files at a sensible size: a year with few rows becomes one file and a year
    with a third of all rows is written by many tasks.
    """
    df.hint("rebalance", year).write.partitionBy(year).parquet(path)


def preview(df: DataFrame, n: int = 20) -> DataFrame:
    return df.limit(n)

