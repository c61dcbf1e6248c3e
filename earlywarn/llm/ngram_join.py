"""Exact set-similarity join of documents on word n-grams, and the groups that its links make."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from earlywarn.llm.common import collect_garbage, discard, map_arrow, small_batches, stored, text_of, with_places
from earlywarn.llm.components import components
from earlywarn.llm.hashing import SequenceHashes


@dataclass(frozen=True)
class JoinSpec:
    """Texts are sets of ``words``-word shingles; two link at ``percent`` per cent of their union.

    ``buckets`` (a power of two) counts how often shingles occur, by hash: the order of rarity, and a
    table of so many bytes that every task gets. ``cells`` divide a set for the bound on overlaps, ``bits`` (a
    power of two) for the one on differences: a bit is the parity of the members that fall on it.
    ``broadcast_ids``: up to so many candidate ids are sent to all tasks, more are joined by shuffle.
    ``hub_rounds``: how often entries are compared with one of their bucket before all that are still
    apart are paired. In the first half of these turns the order of hubs is the same for all buckets, so that
    copies, which share most buckets, meet the same few; in the other half each bucket has its own.
    ``suffix_depth``: how often the suffix filter halves two sets before they are intersected.
    ``remembered``: so many shingles that stand before an entry tell whether two sets have met already.
    """

    words: int = 3
    percent: int = 90
    buckets: int = 1 << 18
    cells: int = 64
    bits: int = 512
    broadcast_ids: int = 500_000
    hub_rounds: int = 4
    suffix_depth: int = 4
    remembered: int = 4

    def required(self, a: Column, b: Column) -> Column:
        """Shared shingles that sets of these sizes need at least."""
        return F.ceil(F.lit(self.percent) * (a + b) / F.lit(100.0 + self.percent) - F.lit(1e-9))

    @property
    def few_members(self) -> int:
        """Sets of up to so many can differ in a quarter of the bits at most and still link: parities tell well."""
        return self.bits * (100 + self.percent) // (8 * (100 - self.percent)) if self.percent < 100 else 1 << 30


_SKETCH = (
    "doc_id long, file string, at long, n long, sig binary, cells array<int>, odd array<bigint>, bucket array<int>, "
    "seen array<int>"
)
_INDEX = "token long, sig binary, n int, pos int, early boolean"


def _sets(batch: pa.RecordBatch, spec: JoinSpec, hashes: SequenceHashes) -> Iterator[np.ndarray]:
    texts, some, held = batch.column("text"), [], 0
    for i in range(batch.num_rows):
        some.append(texts[i].as_buffer())
        held += len(some[-1])
        if held >= 1 << 20:
            yield from hashes.shingles(some, spec.words)
            some, held = [], 0
    if some:
        yield from hashes.shingles(some, spec.words)


def _bucket(members: np.ndarray, spec: JoinSpec) -> np.ndarray:
    return (members >> np.uint64(32)).astype("int64") & (spec.buckets - 1)


def _signature(members: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(members.tobytes())


def _parities(members: np.ndarray, spec: JoinSpec) -> np.ndarray:
    at = (members >> np.uint64(8)).astype("int64") & (spec.bits - 1)
    return np.packbits(np.bincount(at, minlength=spec.bits).astype("uint8") & 1).view("int64")


def _sketch(batches: Iterator[pa.RecordBatch], spec: JoinSpec) -> Iterator[pa.RecordBatch]:
    """A row for each document, and at the end how often this task saw each bucket."""
    hashes, counts = SequenceHashes(), np.zeros(spec.buckets, "int64")
    names = ["doc_id", "file", "at", "n", "sig", "cells", "odd", "bucket", "seen"]
    ints, longs = pa.list_(pa.int32()), pa.list_(pa.int64())
    for batch in batches:
        n, sigs, cells, odd = [], [], [], []
        for members in _sets(batch, spec, hashes):
            n.append(len(members))
            sigs.append(_signature(members))
            cells.append(np.bincount((members % np.uint64(spec.cells)).astype("int64"), minlength=spec.cells))
            odd.append(_parities(members, spec))
            np.add.at(counts, _bucket(members, spec), 1)
        none = pa.nulls(batch.num_rows, ints)
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(c) for c in names[:3]), pa.array(n, pa.int64()), pa.array(sigs, pa.binary()),
             pa.array(cells, ints), pa.array(odd, longs), none, none], names=names,
        )
    found = np.flatnonzero(counts)
    for at in range(0, len(found), 1 << 16):
        part = found[at : at + (1 << 16)]
        yield pa.RecordBatch.from_arrays(
            [pa.nulls(1, pa.int64()), pa.nulls(1, pa.string()), pa.nulls(1, pa.int64()), pa.array([-1], pa.int64()),
             pa.nulls(1, pa.binary()), pa.nulls(1, ints), pa.nulls(1, longs),
             pa.array([part], ints), pa.array([np.minimum(counts[part], 2**31 - 1)], ints)], names=names,
        )


def _index(batches: Iterator[pa.RecordBatch], spec: JoinSpec, levels: bytes) -> Iterator[pa.RecordBatch]:
    """The rarest shingles of each set: enough that two sets that link share one of them."""
    hashes, rank, done = SequenceHashes(), np.frombuffer(levels, "uint8"), set()
    t = spec.percent
    for batch in batches:
        out: list[list] = [[], [], [], [], []]
        for members in _sets(batch, spec, hashes):
            n, sig = len(members), _signature(members)
            if n == 0 or sig in done:
                continue
            if len(done) >= 200_000:
                done.clear()
            done.add(sig)
            long = n - -(-t * n // 100) + 1
            short = n - -(-2 * t * n // (100 + t)) + 1
            level = rank[_bucket(members, spec)]
            first = members[np.argsort(level, kind="stable")[:long]]
            out[0].append(first.view("int64"))
            out[1].extend([sig] * long)
            out[2].append(np.full(long, n, "int32"))
            out[3].append(np.arange(long, dtype="int32"))
            out[4].append(np.arange(long) < short)
        if out[0]:
            columns = [np.concatenate(c) if i != 1 else c for i, c in enumerate(out)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(columns[0]), pa.array(columns[1], pa.binary()), pa.array(columns[2]),
                 pa.array(columns[3]), pa.array(columns[4])], names=["token", "sig", "n", "pos", "early"],
            )


def _set_rows(batches: Iterator[pa.RecordBatch], spec: JoinSpec) -> Iterator[pa.RecordBatch]:
    hashes = SequenceHashes()
    for batch in batches:
        found = list(_sets(batch, spec, hashes))
        yield pa.RecordBatch.from_arrays(
            [pa.array([_signature(m) for m in found], pa.binary()), pa.array([m.tobytes() for m in found], pa.binary())],
            names=["sig", "members"],
        )


def apart_at_least(x: np.ndarray, y: np.ndarray, most: int, depth: int) -> int:
    """The suffix filter: a lower bound on how many members only one of two sorted sets has.

    The middle member of one set cuts both; what one part has more than its counterpart has no partner, and
    each pair of parts is cut again, ``depth`` times or until the bound is above ``most``.
    """
    if not depth or not len(x) or not len(y) or abs(len(x) - len(y)) > most:
        return abs(len(x) - len(y))
    half = len(y) // 2
    at = int(np.searchsorted(x, y[half]))
    lost = int(at == len(x) or x[at] != y[half])
    high_x, high_y = x[at + 1 - lost :], y[half + 1 :]
    high = abs(len(high_x) - len(high_y))
    low = apart_at_least(x[:at], y[:half], most - lost - high, depth - 1)
    if low + lost + high > most:
        return low + lost + high
    return low + lost + apart_at_least(high_x, high_y, most - low - lost, depth - 1)


def linked(x: np.ndarray, y: np.ndarray, percent: int, depth: int) -> bool:
    """Whether two sorted sets share ``percent`` per cent of their union; intersected if the suffix filter lets them."""
    total = len(x) + len(y)
    most = total - 2 * -(-percent * total // (100 + percent))
    if apart_at_least(x, y, most, depth) > most:
        return False
    shared = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * shared >= percent * (total - shared)


def _verify(batches: Iterator[pa.RecordBatch], spec: JoinSpec) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        links = []
        for i in range(batch.num_rows):
            x, y = (np.frombuffer(batch.column(c)[i].as_buffer(), "uint64") for c in ("left", "right"))
            links.append(linked(x, y, spec.percent, spec.suffix_depth))
        keep = pa.array(links, pa.bool_())
        yield pa.RecordBatch.from_arrays(
            [batch.column("a").filter(keep), batch.column("b").filter(keep)], names=["a", "b"]
        )


def _shared_cells(x: str, y: str) -> Column:
    """What two sets share at most, by how many members each has in every cell."""
    return F.aggregate(F.zip_with(x, y, lambda p, q: F.least(p, q)), F.lit(0), lambda s, v: s + v)


def _apart(x: str, y: str, longs: int) -> Column:
    """In how many members two sets differ at least: each turns one parity."""
    bits = [F.bit_count(F.get(x, F.lit(i)).bitwiseXOR(F.get(y, F.lit(i)))) for i in range(longs)]
    return sum(bits[1:], bits[0])


class _Join:
    """``placed``: ``docs`` has ``_file, _at``, which then go with its rows."""

    def __init__(self, docs: DataFrame, spec: JoinSpec, id_col: str, text_col: str, placed: bool = False):
        self.spec = spec
        self.texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
        file, at = (F.col("_file"), F.col("_at")) if placed else (F.lit(None).cast("string"), F.lit(None).cast("long"))
        texts = docs.select(
            F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"), file.alias("file"), at.alias("at")
        )
        rows = stored(map_arrow(texts, lambda b: _sketch(b, spec), _SKETCH), "sketches")
        self.rows = rows.where("n >= 0").select("doc_id", "n", "sig", "file", "at")
        each = rows.where("n > 0").groupBy("sig").agg(
            F.min("doc_id").alias("doc_id"), F.first("n").cast("int").alias("n"), F.first("cells").alias("cells"),
            F.first("odd").alias("odd"),
        )
        self.classes = stored(each, "classes")
        self.levels = self._levels(rows)
        self.buckets = self._buckets()
        self.sets: DataFrame | None = None
        self.compared: DataFrame | None = None
        self.turn_tables: list[DataFrame] = []

    def _turn(self, df: DataFrame, name: str) -> DataFrame:
        """A table that only this turn reads."""
        self.turn_tables.append(stored(df, name))
        return self.turn_tables[-1]

    def end_turn(self) -> None:
        discard(*self.turn_tables)
        self.turn_tables = []
        collect_garbage(self.texts.sparkSession)

    def _levels(self, rows: DataFrame) -> bytes:
        """An eighth of a doubling of a bucket's count is one level; one byte per bucket."""
        each = rows.where("n < 0").select(F.explode(F.arrays_zip("bucket", "seen")).alias("x"))
        sums = each.groupBy("x.bucket").agg(F.sum(F.col("x.seen").cast("long")).alias("seen")).toPandas()
        counts = np.zeros(self.spec.buckets)
        counts[sums["bucket"].to_numpy()] = sums["seen"].to_numpy()
        return np.minimum(8 * np.log2(counts + 1), 255).astype("uint8").tobytes()

    def _buckets(self) -> DataFrame:
        """The index entries of shingles that at least two different sets have among their rarest."""
        spec, levels = self.spec, self.levels
        index = stored(map_arrow(self.texts, lambda b: _index(b, spec, levels), _INDEX), "index")
        h = F.xxhash64("sig")
        shared = index.groupBy("token").agg(F.min(h).alias("lo"), F.max(h).alias("hi")).where("lo <> hi")
        shared = stored(shared.select("token"), "shared")
        collect_garbage(index.sparkSession)
        # Size, place and whether early as one number: most of these rows are shuffled only to find no partner.
        last = F.col("pos").cast("long") * 2 + F.col("early").cast("long")
        packed = index.select("token", "sig", F.shiftleft(F.col("n").cast("long"), 32).bitwiseOR(last).alias("packed"))
        entries = packed.join(shared.hint("merge"), "token").dropDuplicates(["token", "sig"])
        last = F.col("packed").bitwiseAND(F.lit((1 << 32) - 1))
        entries = entries.select(
            "token", "sig", F.shiftright("packed", 32).cast("int").alias("n"), F.shiftright(last, 1).cast("int").alias("pos"),
            (last.bitwiseAND(F.lit(1)) == 1).alias("early"),
        )
        # Only shared shingles can be common; how many of them stand before this one in the set.
        before = F.row_number().over(Window.partitionBy("sig").orderBy("pos")) - 1
        buckets = stored(entries.withColumn("before", before), "buckets")
        discard(index, shared)
        collect_garbage(index.sparkSession)
        return buckets

    def _sets_of(self, pairs: DataFrame) -> DataFrame:
        """Whole sets of the classes in ``pairs``; texts are read for those not met in an earlier turn."""
        wanted = pairs.select(F.col("a").alias("sig")).union(pairs.select("b")).distinct()
        if self.sets is not None:
            wanted = wanted.join(self.sets.select("sig").hint("merge"), "sig", "left_anti")
        wanted = self._turn(self.classes.join(wanted.hint("merge"), "sig").select("doc_id", "sig"), "wanted")
        if wanted.isEmpty() and self.sets is not None:
            return self.sets
        ids = wanted.select("doc_id").distinct()
        few = ids.count() <= self.spec.broadcast_ids
        ids = (F.broadcast(ids) if few else ids.hint("merge")).withColumnRenamed("doc_id", "wanted")
        # Texts without an id have sets too.
        texts = self.texts.join(ids, F.col("doc_id").eqNullSafe(F.col("wanted"))).select("text")
        spec = self.spec
        sets = map_arrow(texts, lambda b: _set_rows(b, spec), "sig binary, members binary")
        sets = sets.join(wanted.select("sig").distinct().hint("merge"), "sig").dropDuplicates(["sig"])
        sets = stored(sets, "sets")
        self.sets = sets if self.sets is None else self.sets.union(sets)
        return self.sets

    def _fits(self, x: str, y: str) -> Column:
        """Length, prefix and position filters for an entry of either side."""
        c = F.col
        nx, ny, px, py = c(f"{x}.n"), c(f"{y}.n"), c(f"{x}.pos"), c(f"{y}.pos")
        earlier = F.least(c(f"{x}.before"), c(f"{y}.before"))
        length = F.least(nx, ny) * 100 >= F.greatest(nx, ny) * self.spec.percent
        early = F.when(nx < ny, c(f"{x}.early")).when(ny < nx, c(f"{y}.early")).otherwise(
            c(f"{x}.early") | c(f"{y}.early")
        )
        most = earlier + F.least(nx - px, ny - py)
        return length & early & (most >= self.spec.required(nx, ny))

    def _may_link(self, x: str, y: str, sep: str) -> Column:
        """Bounds from the parities of both sets and, where carried, their cells; linking sets always pass."""
        nx, ny = F.col(f"{x}{sep}n").cast("long"), F.col(f"{y}{sep}n").cast("long")
        least = self.spec.required(nx, ny)
        apart = _apart(f"{x}{sep}odd", f"{y}{sep}odd", self.spec.bits // 64)
        cells = _shared_cells(f"{x}{sep}cells", f"{y}{sep}cells") >= least
        return (apart <= nx + ny - 2 * least) & F.coalesce(cells, F.lit(True))

    def named(self, roots: DataFrame | None) -> DataFrame:
        """The entries of buckets whose sets are not all in one group yet, with their groups."""
        if roots is None:
            return self.buckets.withColumn("root", F.col("sig"))
        entries = self.buckets.join(roots.withColumnRenamed("node", "sig").hint("merge"), "sig", "left")
        entries = self._turn(entries.withColumn("root", F.coalesce("root", "sig")), "named")
        h = F.xxhash64("root")
        mixed = entries.groupBy("token").agg(F.min(h).alias("lo"), F.max(h).alias("hi")).where("lo <> hi")
        entries = self._turn(entries.join(mixed.select("token").hint("merge"), "token"), "mixed")
        discard(self.turn_tables[-2])
        return entries

    def hub_pairs(self, entries: DataFrame, turn: int) -> DataFrame:
        """Every entry with one of its bucket from another group, another one in each turn."""
        parts = ("sig", "n", "pos", "early", "before", "root")
        own = ("token",) if 2 * turn >= self.spec.hub_rounds else ()
        entry = F.struct(F.xxhash64(*own, "sig", F.lit(turn)).alias("by"), *parts)
        hubs = self._turn(entries.groupBy("token").agg(F.min(entry).alias("hub")), "hubs")
        hubs = hubs.select("token", *[F.col(f"hub.{c}").alias(c) for c in parts])
        x, y = entries.alias("x"), hubs.hint("merge").alias("y")
        apart = (F.col("x.token") == F.col("y.token")) & (F.col("x.root") != F.col("y.root"))
        return self._distinct(x.join(y, apart & self._fits("x", "y")))

    def rest_pairs(self, entries: DataFrame) -> DataFrame:
        return self._distinct(self.met_once(entries))

    def met_once(self, entries: DataFrame) -> DataFrame:
        """Pairs of entries whose sets are not in one group; the bounds from parities and cells (carried by sets
        that are too large for the former) are part of the join, so that near copies which cannot link are not
        even written as pairs. Two sets are paired at the first
        shingle that both have among their rarest (where the filters allow most), not again at each of the
        next: entries carry up to ``remembered`` shingles that stand before them."""
        cells = F.when(F.col("n") > self.spec.few_members, F.col("cells")).alias("cells")
        sketches = self.classes.select("sig", "odd", cells).hint("merge")
        last = Window.partitionBy("sig").orderBy("pos").rowsBetween(-self.spec.remembered, -1)
        entries = entries.withColumn("passed", F.collect_list("token").over(last))
        entries = self._turn(entries.join(sketches, "sig"), "rest")
        x, y = entries.alias("x"), entries.hint("merge").alias("y")
        apart = (F.col("x.token") == F.col("y.token")) & (F.col("x.sig") < F.col("y.sig")) & (F.col("x.root") != F.col("y.root"))
        first = ~F.arrays_overlap("x.passed", "y.passed")
        return x.join(y, apart & self._fits("x", "y") & first & self._may_link("x", "y", "."))

    def _distinct(self, pairs: DataFrame) -> DataFrame:
        a, b = F.least("x.sig", "y.sig"), F.greatest("x.sig", "y.sig")
        pairs = pairs.select(a.alias("a"), b.alias("b")).distinct()
        return pairs if self.compared is None else pairs.join(self.compared.hint("merge"), ["a", "b"], "left_anti")

    def links(self, pairs: DataFrame) -> DataFrame:
        """The pairs that really link, each compared once in all turns, after bounds from sketches of both sets."""
        pairs = stored(pairs, "compared")
        self.end_turn()  # of the entries; what follows has tables of its own
        self.compared = pairs if self.compared is None else self.compared.union(pairs)
        of = self.classes.select("sig", "n", "cells", "odd")
        for side in ("a", "b"):
            names = (side, *[f"{side}_{c}" for c in of.columns[1:]])
            pairs = pairs.join(of.toDF(*names).hint("merge"), side)
        pairs = pairs.where(self._may_link("a", "b", "_")).select("a", "b")
        pairs = self._turn(pairs, "pairs")
        spec, sets = self.spec, self._sets_of(pairs)
        left, right = sets.toDF("a", "left").hint("merge"), sets.toDF("b", "right").hint("merge")
        both = pairs.join(left, "a").join(right, "b").select("a", "b", "left", "right")
        return map_arrow(both, lambda b: _verify(b, spec), "a binary, b binary")


def similar_groups(
    docs: DataFrame, spec: JoinSpec | None = None, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """One row per row: ``doc_id, n_shingles, component_id``, the smallest id reachable by links.

    Texts are lower-cased (A-Z) and cut at spaces; null and empty texts have no shingles and link with
    nothing; repeated rows and equal sets are one set throughout. Empty tables give no rows, null ids
    are never a component's id unless alone, other columns are not read.

    The join is exact. Shingles are ordered by how often their bucket occurs, rarest first; sets that
    link must share one of their rarest, at places and with sizes that leave room for the overlap.
    Buckets of the index are never expanded into all their pairs at once: in a few turns each entry is
    compared with one entry of its bucket (a different one for each shingle and turn) that is not in its
    group yet, which ties near copies together with as many comparisons as entries. Only entries that
    are then still in different groups are paired. Pairs are compared on whole sets, after bounds from
    parities, counts by cell and the suffix filter.
    """
    spec = spec or JoinSpec()
    with small_batches(docs.sparkSession):
        join = _Join(docs, spec, id_col, text_col)
        groups = _groups(join)
    out = join.rows.join(groups.hint("merge"), "sig", "left")
    return out.select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("group", "doc_id").alias("component_id")
    )


def _groups(join: _Join) -> DataFrame:
    """``sig, root, group``: for each distinct set, a set that stands for its group, and the group's smallest id."""
    links, roots = None, None
    for turn in range(join.spec.hub_rounds + 1):
        entries = join.named(roots)
        if roots is not None and entries.isEmpty():
            join.end_turn()
            break
        pairs = join.hub_pairs(entries, turn) if turn < join.spec.hub_rounds else join.rest_pairs(entries)
        found = stored(join.links(pairs), "links")
        if not found.isEmpty():
            links = found if links is None else links.union(found)
            last, roots = roots, stored(components(links), "roots")
            discard(last)
        join.end_turn()
    discard(join.buckets)
    if roots is None:
        roots = join.classes.select(F.col("sig").alias("node"), F.col("sig").alias("root")).limit(0)
    named = join.classes.join(roots.withColumnRenamed("node", "sig").hint("merge"), "sig")
    named = stored(named.select("sig", "root", "doc_id"), "members")
    least = named.groupBy("root").agg(F.min("doc_id").alias("least"))
    grouped = named.join(least.hint("merge"), "root").select("sig", "root", "least")
    # Equal sets without other links form a group too.
    own = join.classes.select("sig", F.col("doc_id").alias("own"))
    return stored(own.join(grouped.hint("merge"), "sig", "left").select(
        "sig", F.coalesce("root", "sig").alias("root"), F.coalesce("least", "own").alias("group")
    ), "groups")


def keep_one_per_group(
    docs: DataFrame, spec: JoinSpec | None = None, id_col: str = "doc_id", text_col: str = "text",
    from_files: bool = False,
) -> DataFrame:
    """``docs`` with one row of each group, that of the smallest id (null last); columns as they were.

    Groups are of texts, whatever ids their rows have: of rows with one id, those go whose text is near to
    another row's that stays. Rows without shingles all stay. ``from_files``: ``docs`` reads a table's files row by
    row; anything else is written first, so that rows have a place.
    """
    names = [f"_c{i}" for i in range(len(docs.columns))]
    named = dict(zip(docs.columns, names))
    placed = with_places(docs, names, from_files)
    with small_batches(docs.sparkSession):
        join = _Join(placed, spec or JoinSpec(), named[id_col], named[text_col], placed=True)
        groups = _groups(join)
    rows = join.rows.where("n > 0").join(groups.hint("merge"), "sig")
    order = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "sig", "file", "at")
    rows = stored(rows.select("root", order.alias("order")), "grouped")
    best = stored(rows.groupBy("root").agg(F.min("order").alias("best")), "best")
    gone = rows.join(best.hint("merge"), "root").where("order.file <> best.file OR order.at <> best.at")
    gone = stored(gone.select(F.col("order.file").alias("_file"), F.col("order.at").alias("_at")), "gone")
    kept = placed.join(gone, ["_file", "_at"], "left_anti")
    return kept.select(*[F.col(n).alias(c) for c, n in named.items()])
