"""Token ids as a binary table: documents compressed one by one with a shared dictionary, and an offset index.

A store is a folder of three Parquet tables. ``dictionary`` has one row: the zstandard dictionary and its
SHA-256. ``shards`` has a row for each shard, the bytes of many documents after one another with an index
before them, and the smallest and largest id, by which a reader skips shards. ``ranges`` has a row for each
range of ids that one task wrote, with the number of ids before it.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from earlywarn.llm.byte_level import byte_level_ids, column_ids
from earlywarn.llm.common import map_arrow, text_of


@dataclass(frozen=True)
class StoreSpec:
    """``tokenizer`` is a path; null takes the public byte-level vocabulary of the environment.

    The dictionary of ``dictionary_bytes`` is fitted on about ``sample_documents`` documents, chosen by a
    hash over all of them, of which a longer one gives ``sample_ids`` consecutive ids from a place that the
    hash chooses too; it changes sizes, never results. ``shard_bytes``: when compressed documents fill so
    much, the shard ends; a longer document is a shard of its own.
    """

    tokenizer: str | None = None
    end_id: int = 2
    dictionary_bytes: int = 1 << 16
    sample_documents: int = 2048
    sample_ids: int = 2048
    level: int = 3
    shard_bytes: int = 4 << 20


#: Fixed layout, little-endian. Head: mark, bytes of an id, documents, SHA-256 of the dictionary. Then for
#: each document: id, whether it has one, ids before it in its range, and where its bytes begin; the same
#: once more for the end. Then the compressed documents.
HEAD = struct.Struct("<4sBxxxI32s")
MARK = b"TOK1"
ENTRY = np.dtype([("doc_id", "<i8"), ("named", "<i8"), ("start", "<i8"), ("offset", "<i8")])

SHARDS = "range int, shard int, first_id long, last_id long, documents long, tokens long, content binary"


def _with_end(batch: pa.RecordBatch, spec: StoreSpec) -> Iterator[bytes]:
    ids = byte_level_ids(spec.tokenizer)
    end = np.array([spec.end_id], ids.dtype).tobytes()
    return (blob + end for blob in column_ids(batch.column("text"), ids))


def fit_dictionary(docs: DataFrame, spec: StoreSpec) -> bytes:
    """A dictionary of serialised ids; of very few ids they are the dictionary themselves, of none it is empty."""
    import zstandard

    total = docs.count()
    if not total:
        return b""
    scale = 1 << 30
    place = F.pmod(F.xxhash64("doc_id", "text"), F.lit(scale))
    chosen = docs.where(place < max(1, min(scale, scale * spec.sample_documents // total)))

    def windows(batches):
        for batch in batches:
            out = []
            for text, place in zip(_with_end(batch, spec), batch.column("place").to_pylist()):
                width = byte_level_ids(spec.tokenizer).dtype.itemsize
                spare = len(text) // width - spec.sample_ids
                at = width * (place % (spare + 1)) if spare > 0 else 0
                out.append(text[at : at + width * spec.sample_ids])
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["ids"])

    rows = map_arrow(chosen.select("text", place.alias("place")), windows, "ids binary").collect()
    samples = sorted(bytes(r.ids) for r in rows)
    try:
        return zstandard.train_dictionary(spec.dictionary_bytes, samples, level=spec.level).as_bytes()
    except zstandard.ZstdError:  # too few or too uniform for training
        return b"".join(samples)[-spec.dictionary_bytes :]


def _dictionary(content: bytes):
    import zstandard

    return zstandard.ZstdCompressionDict(content) if content else None


def _pack_shard(entries: list[tuple], frames: list[bytes], start: int, width: int, digest: bytes) -> bytes:
    index = np.zeros(len(frames) + 1, ENTRY)
    base = HEAD.size + index.nbytes
    for i, (doc_id, before) in enumerate(entries):
        index[i] = (doc_id or 0, doc_id is not None, before, base)
        base += len(frames[i])
    index[-1] = (0, 0, start, base)
    return b"".join([HEAD.pack(MARK, width, len(frames), digest), index.tobytes(), *frames])


def _write(batches: Iterator[pa.RecordBatch], spec: StoreSpec, content: bytes) -> Iterator[pa.RecordBatch]:
    """The shards of one range, whose documents come in order."""
    import zstandard

    width, digest = byte_level_ids(spec.tokenizer).dtype.itemsize, hashlib.sha256(content).digest()
    compressor = zstandard.ZstdCompressor(level=spec.level, dict_data=_dictionary(content))
    here, shard, start, opened, size = TaskContext.get().partitionId(), 0, 0, 0, 0
    entries: list[tuple] = []
    frames: list[bytes] = []

    def close() -> pa.RecordBatch:
        ids = [d for d, _ in entries if d is not None]
        values = (
            here, shard, min(ids, default=None), max(ids, default=None), len(frames), start - opened,
            _pack_shard(entries, frames, start, width, digest),
        )
        types = [pa.int32(), pa.int32(), *[pa.int64()] * 4, pa.binary()]
        names = [field.split()[0] for field in SHARDS.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types)], names)

    for batch in batches:
        for doc_id, blob in zip(batch.column("doc_id").to_pylist(), _with_end(batch, spec)):
            entries.append((doc_id, start))
            frames.append(compressor.compress(blob))
            start += len(blob) // width
            size += len(frames[-1])
            if size >= spec.shard_bytes:
                yield close()
                shard, opened, size, entries, frames = shard + 1, start, 0, [], []
    if frames:
        yield close()


def write_tokens(
    docs: DataFrame, path: str, spec: StoreSpec | None = None, id_col: str = "doc_id", text_col: str = "text",
) -> None:
    """Write the ids of every text, the end id last, in ascending order of the documents' ids.

    Null texts count as empty, so they are the end id alone. Rows without an id come first; rows that
    share one follow each other by a hash of their text, each with its own entry. An empty table gives
    an empty store. Other columns are not read. A special token's string in a text is read as the
    tokenizer reads it by default.

    The texts are range-partitioned once, by id, text hash and row, so a repeated id spreads over tasks;
    encoding, compression and the shards of a range are one task's work, which a lost executor only
    repeats. Where a range begins in the whole is known from the ranges' counts afterwards.
    """
    spec, spark = spec or StoreSpec(), docs.sparkSession
    named = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    content = fit_dictionary(named, spec)
    row = [(hashlib.sha256(content).hexdigest(), bytearray(content))]
    spark.createDataFrame(row, "sha256 string, content binary").write.parquet(f"{path}/dictionary")

    order: list[Column] = [F.col("doc_id").asc_nulls_first(), F.col("_hash").asc(), F.col("_row").asc()]
    keyed = named.withColumns({"_hash": F.xxhash64("text"), "_row": F.monotonically_increasing_id()})
    ranged = keyed.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    shards = map_arrow(ranged, lambda batches: _write(batches, spec, content), SHARDS)
    shards.write.option("compression", "none").parquet(f"{path}/shards")  # nothing is left to compress

    ranges = spark.read.parquet(f"{path}/shards").groupBy("range").agg(F.sum("tokens").alias("tokens"))
    # One row for each task that wrote: few and narrow, whatever the size of the input.
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.withColumn("before", F.coalesce(F.sum("tokens").over(before), F.lit(0)))
    ranges.write.parquet(f"{path}/ranges")


def _dictionary_of(spark: SparkSession, path: str) -> bytes:
    row = spark.read.parquet(f"{path}/dictionary").first()
    content = bytes(row.content)
    if hashlib.sha256(content).hexdigest() != row.sha256:
        raise ValueError(f"the dictionary of {path} is damaged")
    return content


def open_shard(shard: bytes, content: bytes) -> tuple[np.ndarray, np.dtype]:
    """The index of a shard, whose last entry is its end, and the type of its ids."""
    mark, width, documents, digest = HEAD.unpack_from(shard)
    if mark != MARK or digest != hashlib.sha256(content).digest():
        raise ValueError("not a shard of this dictionary")
    return np.frombuffer(shard, ENTRY, documents + 1, HEAD.size), np.dtype(f"<u{width}")


def _read(batches: Iterator[pa.RecordBatch], content: bytes, wanted: set[int] | None, with_ids: bool):
    import zstandard

    expand = zstandard.ZstdDecompressor(dict_data=_dictionary(content)).decompress
    types = [*[pa.int64()] * 4, pa.binary()]
    names = ["doc_id", "start", "n_tokens", "ids_crc32", "ids"]
    for batch in batches:
        for i in range(batch.num_rows):
            shard = batch.column("content")[i].as_buffer()
            index, dtype = open_shard(shard, content)
            view, before = memoryview(shard), batch.column("before")[i].as_py()
            out: list[tuple] = []
            size = 0
            for here, after in zip(index[:-1].tolist(), index[1:].tolist()):
                doc_id = here[0] if here[1] else None
                if wanted is not None and doc_id not in wanted:
                    continue
                ids = np.frombuffer(expand(view[here[3] : after[3]]), dtype).astype("<u4")
                raw = ids.tobytes()
                out.append((doc_id, before + here[2], len(ids), zlib.crc32(raw), raw if with_ids else None))
                size += len(raw) * with_ids
                if size > 8 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)
                    out, size = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)


def read_tokens(
    spark: SparkSession, path: str, wanted: Iterable[int] | None = None, with_ids: bool = True,
) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32, ids``: documents as a store has them.

    ``start`` counts the ids of all documents before one; ``ids`` are little-endian 32-bit numbers.
    ``wanted`` is a list of ids, short enough for a filter: shards without any of them are skipped by
    the scan, and of the others only the wanted documents are decompressed. Raises if a shard was written
    with another dictionary.
    """
    content = _dictionary_of(spark, path)
    shards = spark.read.parquet(f"{path}/shards")
    some = None if wanted is None else {int(w) for w in wanted}
    if some is not None:
        near = F.lit(False)
        for w in sorted(some):
            near = near | ((F.col("first_id") <= w) & (F.col("last_id") >= w))
        shards = shards.where(near)
    # As many rows as tasks wrote, which the writer's number of shuffle partitions bounds.
    ranges = F.broadcast(spark.read.parquet(f"{path}/ranges").select("range", "before"))
    placed = shards.select("range", "content").join(ranges, "range").select("before", "content")
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long, ids binary"
    out = map_arrow(placed, lambda batches: _read(batches, content, some, with_ids), schema)
    return out if with_ids else out.drop("ids")
