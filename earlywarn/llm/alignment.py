"""Align the tokens of two vocabularies, and count which of their ids go together in a corpus."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from earlywarn.llm.byte_level import ByteLevelIds, portions
from earlywarn.llm.common import map_arrow, stored, text_of


@dataclass(frozen=True)
class AlignSpec:
    """Paths of a byte-level vocabulary A and a sentence-piece vocabulary B; null takes the environment's.

    ``cache_chunks``: distinct chunks whose alignment a worker remembers. ``hot_pairs``: the id pairs of
    most documents, at most so many, are sent to the tasks; all other pairs are joined.
    """

    byte_level: str | None = None
    sentence_piece: str | None = None
    cache_chunks: int = 250_000
    hot_pairs: int = 1 << 18


#: First bytes of white space, and of other characters that it does no harm to treat alike.
BLANK = frozenset(b"\t\n\v\f\r\x1c\x1d\x1e\x1f\xc2\xe1\xe2\xe3")


def chunks_of(text: bytes) -> list[bytes]:
    """The text cut at single spaces between a word and a word; each chunk stands after a space.

    In both vocabularies a token begins there, so chunks can be encoded and aligned on their own.
    """
    pieces = text.split(b" ")
    if not any(not p or p[0] in BLANK for p in pieces):
        return pieces
    out = pieces[:1]
    for piece in pieces[1:]:
        if not piece or piece[0] in BLANK or not out[-1] or out[-1].endswith(b" "):
            out[-1] += b" " + piece
        else:
            out.append(piece)
    return out


def byte_alphabet() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones for themselves,
    the others, in order, for the characters from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def group_labels(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Group numbers of A's and B's tokens, from where they end, and the number of rounds it took.

    Every token points to the token farthest to the right that overlaps it: the other vocabulary's one
    over its last byte, unless it ends last itself. Pointers are doubled until they rest; a group's
    tokens then all point to its last token, whose end both vocabularies share.
    """
    na = len(ends_a)
    over_a = np.searchsorted(ends_b, ends_a)
    over_b = np.searchsorted(ends_a, ends_b)
    farther = ends_a[over_b] > ends_b
    to = np.concatenate([na + over_a, np.where(farther, over_b, na + np.arange(len(ends_b)))])
    rounds = 0
    while True:
        further = to[to]
        if np.array_equal(further, to):
            break
        to, rounds = further, rounds + 1
    last = np.zeros(na + len(ends_b), "int64")
    last[to] = 1
    number = np.cumsum(last) - 1  # terminal tokens are B's, in order
    groups = number[to]
    return groups[:na], groups[na:], np.int64(rounds)


def _tally(groups: np.ndarray, ids: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct ids of each group and how often it has them: group, id, times."""
    both, times = np.unique(groups * size + ids, return_counts=True)
    return both // size, both % size, times


def _ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """start, start + 1, … for each start, as many as its count."""
    skip = np.repeat(np.cumsum(counts) - counts, counts)
    return np.repeat(starts, counts) + np.arange(int(counts.sum())) - skip


def _sum_by(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and the sums of their values."""
    if not len(keys):
        return keys, values
    order = np.argsort(keys, kind="stable")
    keys, values = keys[order], values[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(values, first)


@dataclass
class Aligned:
    """What units of text give, one after another.

    ``counts``: good, n_a, n_b, n_groups, n_links; a unit that either vocabulary does not give back byte
    for byte is not good and has zeros. ``texts``: its groups. ``sizes``: how many keys it has.
    """

    counts: np.ndarray
    texts: list[bytes]
    sizes: np.ndarray
    keys: np.ndarray
    times: np.ndarray


class Vocabularies:
    def __init__(self, spec: AlignSpec):
        import sentencepiece

        self.a = ByteLevelIds(spec.byte_level, plain_specials=True, limit=200_000)
        path = spec.sentence_piece
        if path is None:
            import public_tokenizers

            path = public_tokenizers.path("piece_bpe_32k.model")
        self.b = sentencepiece.SentencePieceProcessor(model_file=path)
        alphabet = byte_alphabet()
        words = sorted((i, w) for w, i in self.a.tokenizer.get_vocab(with_added_tokens=True).items())
        self.bytes_a = [b""] * (words[-1][0] + 1)
        for i, w in words:
            known = all(c in alphabet for c in w)
            self.bytes_a[i] = bytes(alphabet[c] for c in w) if known else w.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.vocab_size())]
        self.bytes_b = [
            bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode()
            for i, p in enumerate(pieces)
        ]
        self.size_b = len(pieces)
        self.length_a = np.array([len(w) for w in self.bytes_a], "int64")
        self.length_b = np.array([len(w) for w in self.bytes_b], "int64")
        #: Cutting at spaces is right only if no piece reaches over one.
        self.divides = self.a.divides and not any("▁" in p.lstrip("▁") for p in pieces)

    def align(self, units: list[bytes]) -> Aligned:
        """Units that each follow a space; ``chunks_of`` says what may be encoded together.

        If the bytes of a unit get lost, each is aligned on its own.
        """
        joined = b" ".join(units)
        ids_a = np.frombuffer(next(self.a.texts([b" " + joined])), self.a.dtype).astype("int64")
        ids_b = np.array(self.b.encode(joined.decode("utf-8", "replace"), num_threads=1), "int64")
        back = (b"".join(map(w.__getitem__, i.tolist())) for w, i in ((self.bytes_a, ids_a), (self.bytes_b, ids_b)))
        if any(b != b" " + joined for b in back):
            if len(units) == 1:
                none = np.zeros(0, "int64")
                return Aligned(np.zeros((1, 5), "int64"), [b""], np.zeros(1, "int64"), none, none)
            return together([self.align([u]) for u in units])
        ends_a, ends_b = np.cumsum(self.length_a[ids_a]), np.cumsum(self.length_b[ids_b])
        in_a, in_b, _ = group_labels(ends_a, ends_b)
        groups = int(in_b[-1]) + 1
        size_a, size_b = np.bincount(in_a, minlength=groups), np.bincount(in_b, minlength=groups)
        to_a, to_b = np.cumsum(size_a), np.cumsum(size_b)
        # A token of both ends with each unit, so groups lie inside units.
        ends = np.cumsum([len(u) + 1 for u in units])
        last = np.searchsorted(ends_b[to_b - 1], ends)
        first = np.concatenate([[0], last[:-1] + 1])
        shown = self._show(ids_a, ids_b, to_a, to_b)
        counts = [np.ones(len(units), "int64"), *[np.add.reduceat(x, first) for x in (size_a, size_b)]]
        counts += [last + 1 - first, np.add.reduceat(size_a * size_b, first)]
        owners = np.repeat(np.arange(len(units)), last + 1 - first)
        unit, keys, times = self._pairs(in_a, ids_a, in_b, ids_b, owners)
        return Aligned(
            np.stack(counts, axis=1), [";".join(shown[i:j]).encode() for i, j in zip(first.tolist(), (last + 1).tolist())],
            np.bincount(unit, minlength=len(units)), keys, times,
        )

    @staticmethod
    def _show(ids_a: np.ndarray, ids_b: np.ndarray, to_a: np.ndarray, to_b: np.ndarray) -> list[str]:
        """The ids of every group."""
        a, b = list(map(str, ids_a.tolist())), list(map(str, ids_b.tolist()))
        shown, a0, b0 = [], 0, 0
        for a1, b1 in zip(to_a.tolist(), to_b.tolist()):
            if a1 - a0 == 1 == b1 - b0:
                shown.append(f"{a[a0]}|{b[b0]}")
            else:
                shown.append(f"{','.join(a[a0:a1])}|{','.join(b[b0:b1])}")
            a0, b0 = a1, b1
        return shown

    def _pairs(self, in_a, ids_a, in_b, ids_b, units_of) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Unit, key and times of all links, by unit; repeated ids of a group are counted before they meet."""
        group_a, id_a, times_a = _tally(in_a, ids_a, len(self.bytes_a))
        group_b, id_b, times_b = _tally(in_b, ids_b, self.size_b)
        groups = np.arange(int(in_b[-1]) + 1)
        first_b = np.searchsorted(group_b, groups)
        kinds_b = np.bincount(group_b, minlength=len(groups))
        key_space = len(self.bytes_a) * self.size_b
        meets = kinds_b[group_a]
        found: list[tuple[np.ndarray, np.ndarray]] = []
        # As many as a few million pairs at a time.
        cuts = np.searchsorted(np.cumsum(meets), np.arange(0, int(meets.sum()), 4_000_000), side="right")
        for lo, hi in zip(cuts, [*cuts[1:], len(meets)]):
            n = meets[lo:hi]
            b = _ranges(first_b[group_a[lo:hi]], n)
            unit = np.repeat(units_of[group_a[lo:hi]], n)
            key = np.repeat(id_a[lo:hi], n) * self.size_b + id_b[b]
            found.append(_sum_by(unit * key_space + key, np.repeat(times_a[lo:hi], n) * times_b[b]))
        keys, times = _sum_by(*(np.concatenate(x) for x in zip(*found)))
        return keys // key_space, keys % key_space, times


def together(parts: list[Aligned]) -> Aligned:
    return Aligned(
        np.concatenate([p.counts for p in parts]), [t for p in parts for t in p.texts],
        *(np.concatenate([getattr(p, c) for p in parts]) for c in ("sizes", "keys", "times")),
    )


class ChunkMemory:
    """Alignments of chunks, learned as they come; ``limit`` of them, then memory starts anew."""

    def __init__(self, spec: AlignSpec):
        self.words = Vocabularies(spec)
        self.limit = spec.cache_chunks
        self.forget()

    def forget(self) -> None:
        self.codes: dict[bytes, int] = {}
        none = np.zeros(0, "int64")
        self.units = Aligned(np.zeros((0, 5), "int64"), [], none, none, none)
        self.ends = np.zeros(1, "int64")  # where each chunk's keys end, after a zero

    def learn(self, chunks: set[bytes]) -> None:
        if len(self.codes) > self.limit:
            self.forget()
        new = [c for c in chunks if c not in self.codes]
        # What opens or ends with a space or the like could reach over into its neighbours.
        alone = {c for c in new if not c or c[0] in BLANK or c.startswith(b" ") or c.endswith(b" ")}
        parts = [self.units]
        for some in [*portions([c for c in new if c not in alone], 1 << 19), *[[c] for c in alone]]:
            parts.append(self.words.align(some))
            self.codes.update(zip(some, range(len(self.codes), len(self.codes) + len(some))))
        if new:
            self.units = together(parts)
            self.ends = np.concatenate([[0], np.cumsum(self.units.sizes)])

    def align(self, texts: list[bytes]) -> Iterator[tuple[np.ndarray, str, np.ndarray, np.ndarray]]:
        """For each text: n_a, n_b, n_groups, n_links; the digest of its groups; its keys and their times."""
        none = np.zeros(0, "int64")
        cut = [chunks_of(t) if t and self.words.divides else [] for t in texts]
        self.learn(set().union(*cut))
        codes = [np.fromiter(map(self.codes.__getitem__, c), "int64", len(c)) for c in cut]
        units = self.units
        for text, own in zip(texts, codes):
            if len(own) and units.counts[own, 0].all():
                joined = b";".join(map(units.texts.__getitem__, own.tolist()))
                kinds, often = np.unique(own, return_counts=True)
                n = units.sizes[kinds]
                at = _ranges(self.ends[kinds], n)
                keys, times = _sum_by(units.keys[at], units.times[at] * np.repeat(often, n))
                yield units.counts[own, 1:].sum(axis=0), hashlib.sha256(joined).hexdigest(), keys, times
                continue
            # Bytes lost in a chunk are nearly always lost in the text; the text itself decides.
            one = self.words.align([text]) if text else None
            if one is not None and one.counts[0, 0]:
                yield one.counts[0, 1:], hashlib.sha256(one.texts[0]).hexdigest(), one.keys, one.times
            else:
                yield np.zeros(4, "int64"), "", none, none


@cache
def _memory(spec: AlignSpec) -> ChunkMemory:
    """One memory for each worker process."""
    return ChunkMemory(spec)


COUNTS = ("n_a", "n_b", "n_groups", "n_links")
DIGEST = f"row long, doc_id long, {', '.join(f'{c} long' for c in COUNTS)}, groups_sha256 string"
FOUND = f"{DIGEST}, a array<int>, b array<int>, times array<int>"


def _lists(parts: list[np.ndarray], kind: str) -> pa.ListArray:
    ends = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(parts).astype(kind)))


def _align(batches: Iterator[pa.RecordBatch], spec: AlignSpec) -> Iterator[pa.RecordBatch]:
    memory = _memory(spec)
    size_b = memory.words.size_b
    names = [f.split()[0] for f in FOUND.split(", ")]
    for batch in batches:
        column = batch.column("text")
        texts = [column[i].as_buffer().to_pybytes() for i in range(batch.num_rows)]
        at = 0
        for portion in portions(texts):
            counts, digests, keys, times = zip(*memory.align(portion))
            some = batch.slice(at, len(portion))
            at += len(portion)
            yield pa.RecordBatch.from_arrays([
                some.column("row"), some.column("doc_id"), *[pa.array([int(c[k]) for c in counts], pa.int64()) for k in range(4)],
                pa.array(digests, pa.string()), _lists([k // size_b for k in keys], "int32"),
                _lists([k % size_b for k in keys], "int32"), _lists(list(times), "int32"),
            ], names)


def _keys(batch: pa.RecordBatch, size_b: int) -> np.ndarray:
    flat = [batch.column(c).flatten().to_numpy(zero_copy_only=False).astype("int64") for c in "ab"]
    return flat[0] * size_b + flat[1]


def _documents_of(batches: Iterator[pa.RecordBatch], size_b: int) -> Iterator[pa.RecordBatch]:
    """Keys and in how many documents they are, summed over a few million at a time."""
    some: list[np.ndarray] = []

    def close() -> pa.RecordBatch:
        keys, docs = np.unique(np.concatenate(some), return_counts=True)
        some.clear()
        return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(docs.astype("int64"))], ["key", "docs"])

    for batch in batches:
        some.append(_keys(batch, size_b))
        if sum(map(len, some)) > 4_000_000:
            yield close()
    if some:
        yield close()


def _look_up(hot: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of keys among the sorted hot ones, and whether they are there."""
    at = np.searchsorted(hot, keys)
    at[at == len(hot)] = 0
    return at, (hot[at] == keys) if len(hot) else np.zeros(len(keys), bool)


def align_tokens(
    docs: DataFrame, spec: AlignSpec | None = None, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256``, a row for each document.

    Both vocabularies encode a space and the text. Offsets where tokens of both end cut them into groups,
    and all pairs of an A and a B token of a group are links. The count of an id pair is the number of
    documents (rows) that link it; ``n_best`` are a document's links whose count no other pair with the
    same A id exceeds, ``count_sum`` adds up the counts of all its links. Null and empty texts, and texts
    that either vocabulary doesn't give back byte for byte, have no tokens: zeros and an empty digest.
    Repeated rows and ids, null ids too, keep a row each. Empty tables give no rows; other columns are
    not read.

    Texts are aligned in one pass, each distinct chunk between spaces once per worker, and stored with
    their distinct pairs. Counting adds up keys in tasks before the one shuffle. The pairs of most
    documents, a bounded table, then go to the tasks; only the rarer ones are joined by key, none of
    which has many documents.
    """
    spec, spark = spec or AlignSpec(), docs.sparkSession
    texts = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"),
        text_of(text_col).alias("text"),
    )
    found = stored(map_arrow(texts, lambda batches: _align(batches, spec), FOUND), "aligned")
    size_b = _size_b(spec.sentence_piece)
    pairs = found.select("a", "b").where(F.size("a") > 0)
    parts = map_arrow(pairs, lambda batches: _documents_of(batches, size_b), "key long, docs long")
    counts = stored(parts.groupBy("key").agg(F.sum("docs").alias("docs")), "pair-counts")
    # One row for each id of A at most.
    a_id = F.expr(f"key div {size_b}").alias("a")
    best = F.broadcast(counts.groupBy(a_id).agg(F.max("docs").alias("most")))
    judged = counts.withColumn("a", a_id).join(best, "a").select("key", "docs", (F.col("docs") == F.col("most")).alias("best"))

    least = _hot_from(counts, spec.hot_pairs)
    hot = judged.where(F.col("docs") >= least).orderBy("key").toArrow()
    columns = [hot.column(c).to_numpy() for c in ("key", "docs", "best")]
    shared = spark.sparkContext.broadcast(columns)  # hot_pairs rows at most

    def sums(batches):
        keys_hot, docs_hot, best_hot = shared.value
        for batch in batches:
            keys = _keys(batch, size_b)
            times = batch.column("times").flatten().to_numpy(zero_copy_only=False).astype("int64")
            at, there = _look_up(keys_hot, keys)
            owner = np.repeat(np.arange(batch.num_rows), batch.column("a").value_lengths().to_numpy())
            worth, top = np.zeros(len(keys), "int64"), np.zeros(len(keys), "int64")
            worth[there], top[there] = docs_hot[at[there]], best_hot[at[there]]
            totals = np.zeros((2, batch.num_rows), "int64")
            np.add.at(totals[0], owner, times * top)
            np.add.at(totals[1], owner, times * worth)
            names = [f.split()[0] for f in DIGEST.split(", ")]
            out = [*[batch.column(c) for c in names], pa.array(totals[0]), pa.array(totals[1])]
            yield pa.RecordBatch.from_arrays(out, [*names, "n_best", "count_sum"])

    def rest(batches):
        for batch in batches:
            keys = _keys(batch, size_b)
            rare = ~_look_up(shared.value[0], keys)[1]
            rows = np.repeat(batch.column("row").to_numpy(), batch.column("a").value_lengths().to_numpy())
            times = batch.column("times").flatten().to_numpy(zero_copy_only=False).astype("int64")
            yield pa.RecordBatch.from_arrays([pa.array(x[rare]) for x in (rows, keys, times)], ["row", "key", "times"])

    rare = map_arrow(found.select("row", "a", "b", "times"), rest, "row long, key long, times long")
    rare = rare.join(judged.where(F.col("docs") < least), "key").groupBy("row").agg(
        F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("_best"),
        F.sum(F.col("times") * F.col("docs")).alias("_sum"),
    )
    known = map_arrow(found, sums, f"{DIGEST}, n_best long, count_sum long")
    return known.join(rare, "row", "left").select(
        "doc_id", *COUNTS, *[(F.col(c) + F.coalesce(F.col(r), F.lit(0))).alias(c) for c, r in (("n_best", "_best"), ("count_sum", "_sum"))],
        "groups_sha256",
    )


@cache
def _size_b(path: str | None) -> int:
    import sentencepiece

    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    return sentencepiece.SentencePieceProcessor(model_file=path).vocab_size()


def _hot_from(counts: DataFrame, most: int) -> int:
    """The smallest number of documents that at most ``most`` pairs reach, in steps of an eighth of an octave."""
    level = F.floor(F.log2("docs") * 8).alias("level")
    levels = counts.groupBy(level).agg(F.count(F.lit(1)).alias("n"), F.min("docs").alias("least")).collect()
    total, least = 0, 1 << 62
    for r in sorted(levels, key=lambda r: -r.level):  # eight for each doubling of the corpus
        total += r.n
        if total > most:
            break
        least = r.least
    return least
