"""Tokenise documents and pack them into fixed windows by context tier."""

from __future__ import annotations

import os
import re
import zlib
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from earlywarn.llm.common import map_arrow, stored, text_of, with_places, with_row_numbers


@dataclass(frozen=True)
class PackSpec:
    """``tokenizer`` is a path; null takes the public word-level vocabulary of the environment.

    ``tiers``: context sizes, the longest is the window. ``group_pieces``: pieces that one task packs
    together (a mean; pieces are dealt by hash). ``step_sequences``: sequences of a training step.
    ``cache_words``: distinct words whose ids a worker remembers before it starts anew.
    ``order_pieces``: where order counts, so many consecutive pieces fill sequences together, and
    ``order_steps``: so many consecutive steps share sequences by their costs.
    """

    tokenizer: str | None = None
    end_id: int = 2
    tiers: tuple[int, ...] = (4096, 2048, 1024, 512)
    group_pieces: int = 2048
    step_sequences: int = 16
    cache_words: int = 1_000_000
    order_pieces: int = 256
    order_steps: int = 2


_LOADED: dict[str, object] = {}
_WORD_IDS: dict[str, dict[bytes, bytes]] = {}
#: Which ids end a word; none in a vocabulary without such a mark.
_ENDS: dict[str, np.ndarray] = {}


def _tokenizer(path: str | None):
    """The tokenizer of this worker process, loaded once."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    if path not in _LOADED:
        _LOADED[path] = Tokenizer.from_file(path)
        _WORD_IDS[path] = {}
        words = _LOADED[path].get_vocab(with_added_tokens=True)
        _ENDS[path] = np.zeros(max(words.values()) + 1, bool)
        _ENDS[path][[i for w, i in words.items() if w.endswith("</w>")]] = True
    return _LOADED[path], path


#: Letters of ASCII and Latin-1, and the marks that are tokens of their own after a letter; a run of them
#: is one piece of text.
_LETTERS = rb"(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+"
_CORE = re.compile(rb"(" + _LETTERS + rb")([.,;:!?]*)")
_LOWER = re.compile(rb"(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+")


def _core(word: bytes) -> tuple[bytes, bytes] | None:
    """A word of letters in lower case, and the marks after it: the vocabulary ignores case and
    always divides there, so both are encoded apart and many spellings share a core."""
    found = _CORE.fullmatch(word)
    if found is None:
        return None
    core, marks = found.groups()
    return core.lower() if core.isascii() else core.decode().lower().encode(), marks


def token_blobs(texts: pa.Array, spec: PackSpec) -> Iterator[bytes]:
    """Each text's ids as little-endian 32-bit numbers, end id last.

    The vocabulary's rules never look across white space, so ids of words are remembered and joined.
    Texts are split and their words numbered by column operations, a few million bytes at a time, so
    that only the distinct words of each portion are looked up.
    """
    end = np.uint32(spec.end_id).astype("<u4").tobytes()
    sizes = np.cumsum(pc.binary_length(texts).to_numpy()) >> 22
    cuts = [0, *(np.flatnonzero(np.diff(sizes)) + 1).tolist(), len(texts)]
    for start, stop in zip(cuts, cuts[1:]):
        lists = pc.ascii_split_whitespace(texts.slice(start, stop - start))
        numbered = lists.flatten().dictionary_encode()
        blobs = _word_blobs(numbered.dictionary.cast(pa.binary()).to_pylist(), spec)
        flat = np.frombuffer(b"".join(blobs), "<u4")
        until = np.cumsum(np.fromiter(map(len, blobs), "int64", len(blobs))) // 4
        until = np.concatenate([[0], until])
        codes = numbered.indices.to_numpy()
        length = until[codes + 1] - until[codes]
        total = np.concatenate([[0], np.cumsum(length)])
        at = np.repeat((until[codes] - total[:-1]).astype("int32"), length)  # a portion has far fewer ids than 2^31
        at += np.arange(len(at), dtype="int32")
        content = flat.take(at, mode="clip").tobytes() if len(at) else b""
        offsets = lists.offsets.to_numpy()
        edges = (total[offsets - offsets[0]] * 4).tolist()
        for a, b in zip(edges, edges[1:]):
            yield content[a:b] + end


def _word_blobs(words: list[bytes], spec: PackSpec) -> list[bytes]:
    """The ids of distinct words; what is not remembered is encoded in one go."""
    tokenizer, path = _tokenizer(spec.tokenizer)
    known = _WORD_IDS[path]

    def encode(some: list[bytes]) -> list[bytes]:
        encoded = tokenizer.encode_batch_fast([w.decode("utf-8", "replace") for w in some], add_special_tokens=False)
        return [np.array(e.ids, "<u4").tobytes() for e in encoded]

    def encode_cores(some: list[bytes]) -> list[bytes]:
        """Letters alone are one piece, whose last token alone has the mark of a word's end: many go into
        one call and are told apart by it."""
        out: list[bytes] = []
        for blob in encode([b" ".join(some[i : i + 64]) for i in range(0, len(some), 64)]):
            last = (4 * (np.flatnonzero(_ENDS[path][np.frombuffer(blob, "<u4")]) + 1)).tolist()
            out += [blob[a:b] for a, b in zip([0, *last], last)]
        return out

    if len(known) > spec.cache_words:
        known.clear()
    known[b""] = b""
    parts = {w: _core(w) for w in words if w not in known}
    if parts:
        wanted = {part for w, core in parts.items() for part in (core or (w,)) if part and part not in known}
        cores = [w for w in wanted if _LOWER.fullmatch(w)] if _ENDS[path].any() else []
        others = list(wanted.difference(cores))
        for some, how in ((cores, encode_cores), (others, encode)):
            for at in range(0, len(some), 4096):
                known.update(zip(some[at : at + 4096], how(some[at : at + 4096])))
        for word, core in parts.items():
            if core:
                known[word] = known[core[0]] + (known[core[1]] if core[1] else b"")
    return list(map(known.__getitem__, words))


_PIECE = (
    "doc_id long, row long, start long, length long, ids_crc32 long, doc_tokens long, ids binary, file string, at long"
)
_PIECES = pa.schema([
    ("doc_id", pa.int64()), ("row", pa.int64()), ("start", pa.int64()), ("length", pa.int64()),
    ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("ids", pa.binary()),
    ("file", pa.string()), ("at", pa.int64()),
])


def _cut(batches: Iterator[pa.RecordBatch], spec: PackSpec, with_ids: bool) -> Iterator[pa.RecordBatch]:
    window = max(spec.tiers)
    for batch in batches:
        out: list[list] = [[] for _ in _PIECES]
        texts = batch.column("text")
        ids, rows = batch.column("doc_id").to_pylist(), batch.column("row").to_pylist()
        files, places = batch.column("file").to_pylist(), batch.column("at").to_pylist()
        for doc_id, row, file, at, blob in zip(ids, rows, files, places, token_blobs(texts, spec)):
            total = len(blob) // 4
            for start in range(0, total, window):
                piece = blob[4 * start : 4 * (start + window)]
                values = (
                    doc_id, row, start, len(piece) // 4, zlib.crc32(piece), total, piece if with_ids else None, file, at
                )
                for column, value in zip(out, values):
                    column.append(value)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, _PIECES.types)], schema=_PIECES)


def cut_documents(
    docs: DataFrame, spec: PackSpec, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False,
    in_order: bool = False,
) -> DataFrame:
    """Pieces of at most one window: ``doc_id, row, start, length, ids_crc32, doc_tokens, ids``, and
    ``file, at`` of their row if the order of the files matters."""
    file, at = F.lit(None).cast("string"), F.lit(None).cast("long")
    if in_order:
        names = [f"_c{i}" for i in range(len(docs.columns))]
        id_col, text_col = (names[docs.columns.index(c)] for c in (id_col, text_col))
        docs, file, at = with_places(docs, names, from_files=True), F.col("_file"), F.col("_at")
    texts = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"),
        F.monotonically_increasing_id().alias("row"), file.alias("file"), at.alias("at"),
    )
    return map_arrow(texts, lambda batches: _cut(batches, spec, with_ids), _PIECE)


class _Pool:
    """Pieces by length, to be taken one by one."""

    def __init__(self, lengths: list[int]):
        self.of: dict[int, list[int]] = {}
        for i, n in reversed(list(enumerate(lengths))):
            self.of.setdefault(n, []).append(i)
        self.lengths = sorted(self.of)

    def take(self, n: int) -> int:
        members = self.of[n]
        i = members.pop()
        if not members:
            del self.of[n]
            del self.lengths[bisect_left(self.lengths, n)]
        return i

    def give(self, n: int, i: int) -> None:
        if n not in self.of:
            self.of[n] = []
            insort(self.lengths, n)
        self.of[n].append(i)

    def fill(self, room: int, tries: int = 32) -> tuple[list[tuple[int, int]], int]:
        """Take pieces for a gap, and say what is left of it: one or two that fill it exactly if there are
        such, else the longest that fits and so on."""
        taken: list[tuple[int, int]] = []
        while room:
            top = bisect_right(self.lengths, room)
            if not top:
                break
            longest = self.lengths[top - 1]
            pair = [longest]
            if longest < room:
                for n in self.lengths[max(0, top - tries) : top][::-1]:
                    rest = room - n
                    if rest in self.of and (rest != n or len(self.of[n]) > 1):
                        pair = [n, rest]
                        break
            for n in pair:
                taken.append((n, self.take(n)))
                room -= n
        return taken, room


def fill_windows(lengths: list[int], tiers: Sequence[int]) -> list[tuple[int, list[int]]]:
    """``(context, pieces)`` for each sequence.

    A piece's tier is the smallest context that holds it. Pieces of the longest tier come first, each
    opening a long window, whose gap is filled from the shorter tiers. Then each shorter tier packs
    windows of its own size, opened by its longest pieces and filled from itself and the tiers below;
    such a window stands if nothing of it is left over, since a sequence of its own size needs no
    padding. Pieces that found no such company fill long windows in the end.
    """
    pool, sizes = _Pool(lengths), sorted(tiers)
    windows: list[tuple[int, list[int]]] = []

    def long_windows(least: int) -> None:
        while pool.lengths and pool.lengths[-1] > least:
            n = pool.lengths[-1]
            i = pool.take(n)
            taken, _ = pool.fill(sizes[-1] - n)
            windows.append((sizes[-1], [i, *[j for _, j in taken]]))

    long_windows(sizes[-2] if len(sizes) > 1 else 0)
    rest: list[tuple[int, int]] = []
    for below, size in list(zip([0, *sizes], sizes[:-1]))[::-1]:
        while pool.lengths and pool.lengths[-1] > below:
            n = pool.lengths[-1]
            i = pool.take(n)
            taken, left = pool.fill(size - n)
            if left:
                rest.append((n, i))
                for m, j in taken:
                    pool.give(m, j)
            else:
                windows.append((size, [i, *[j for _, j in taken]]))
    for n, i in rest:
        pool.give(n, i)
    long_windows(0)
    return windows


def fill_in_order(lengths: list[int], tiers: Sequence[int], at_once: int) -> list[tuple[int, list[int]]]:
    """:func:`fill_windows` for pieces in the order of training, so many at a time; sequences follow it.

    A window that a portion leaves with room to spare is taken apart and filled again with the next portion,
    once for a piece, so a sequence holds pieces of two neighbouring portions at most.
    """
    windows: list[tuple[int, list[int]]] = []
    waiting: list[int] = []
    for start in range(0, len(lengths), at_once):
        some = [*waiting, *range(start, min(start + at_once, len(lengths)))]
        found = [(size, [some[i] for i in w]) for size, w in fill_windows([lengths[i] for i in some], tiers)]
        found.sort(key=lambda w: (sum(w[1]) / len(w[1]), w[1]))
        waiting = []
        for size, members in found:
            spare = size - sum(lengths[i] for i in members)
            if spare * 32 > size and min(members) >= start and start + at_once < len(lengths):
                waiting += members
            else:
                windows.append((size, members))
    return windows


def _pack(pieces: pd.DataFrame, spec: PackSpec, in_order: bool = False) -> pd.DataFrame:
    """Sequences, offsets and steps for the pieces of one group."""
    pieces = pieces.sort_values(["place", "doc_id", "row", "start"], na_position="last", ignore_index=True)
    lengths = pieces["length"].tolist()
    group = int(pieces["group"].iloc[0])
    if in_order:
        windows = fill_in_order(lengths, spec.tiers, spec.order_pieces)
    else:
        windows = fill_windows(lengths, spec.tiers)
    # Attention costs grow with the square of a piece: deal the dearest sequences out first, to and fro.
    cost = [sum(lengths[i] ** 2 for i in w) for _, w in windows]
    step_of = [0] * len(windows)
    together = spec.order_steps * spec.step_sequences if in_order else len(windows)
    before = 0
    for start in range(0, len(windows), together):
        some = range(start, min(start + together, len(windows)))
        steps = -(-len(some) // spec.step_sequences)
        for place, k in enumerate(sorted(some, key=lambda k: (-cost[k], k))):
            lap, at = divmod(place, steps)
            step_of[k] = before + (at if lap % 2 == 0 else steps - 1 - at)
        before += steps
    sequence, offset, step, context = (np.zeros(len(pieces), "int64") for _ in range(4))
    for k, (size, members) in enumerate(windows):
        at = 0
        for i in members:
            sequence[i], offset[i], step[i] = group << 24 | k, at, group << 24 | step_of[k]
            context[i] = size
            at += lengths[i]
    return pieces[["row", "start", "place"]].assign(
        sequence_id=sequence, offset=offset, step=step, context=context.astype("int32")
    )


def pack_documents(
    docs: DataFrame, spec: PackSpec | None = None, id_col: str = "doc_id", text_col: str = "text",
    with_ids: bool = False, in_order: bool = False,
) -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids_crc32, doc_tokens, tier, sequence_id, offset, step, context``.

    A document's ids are those of its words and the end id; null counts as empty, so it is the end id
    alone. Documents are cut at full windows only. Every piece goes to the ``tier`` of the smallest
    context that holds it. Long windows open with pieces of the long tier, and their gaps are filled from
    the shorter tiers; each shorter tier then packs windows of its own size, of which the full ones stand
    (see :func:`fill_windows`). ``context`` is the size of a sequence; only those of the longest have
    padding. ``step`` numbers groups of sequences with balanced costs. Repeated rows and
    ids are packed once each, in any order; ``with_ids`` adds the ids themselves. Empty tables give no
    rows; other columns are not read.

    Tokenising is one pass without a shuffle, written once. Then only numbers move: pieces are dealt by
    hash into groups of about ``group_pieces``, so a group's size does not depend on the data, and one
    part-filled window per group is all the padding that splitting the work costs.

    With ``in_order`` the rows' order in their files is the order of training: pieces are numbered in it
    (``place``), each group is a range of numbers, and sequences and steps of a later range have higher
    numbers. Inside a group ``order_pieces`` consecutive pieces fill sequences together (see
    :func:`fill_in_order`), and costs are balanced between ``order_steps`` consecutive steps. ``copy`` is the place of the first piece of the same row, which tells repeats of a document
    apart. Part files go by their number, others by name.
    """
    spec = spec or PackSpec()
    pieces = stored(cut_documents(docs, spec, id_col, text_col, with_ids), "pieces")
    groups = max(1, -(-pieces.count() // spec.group_pieces))
    names = ("doc_id", "row", "start", "length")
    if in_order:
        part = F.regexp_extract("file", r"part-(\d+)[^/]*$", 1).try_cast("long")
        numbered = pieces.select(*names, "file", "at", part.alias("part"))
        numbered = with_row_numbers(
            numbered, [F.col("part").asc_nulls_last(), F.col("file"), F.col("at"), F.col("start")], "place"
        )
        group = F.expr(f"place div {spec.group_pieces}")
    else:
        numbered = pieces.withColumn("place", F.lit(0).cast("long"))
        group = F.pmod(F.xxhash64("row", "start"), F.lit(groups))
    placed = numbered.select(*names, "place", group.alias("group")).groupBy("group").applyInPandas(
        lambda pdf: _pack(pdf, spec, in_order),
        "row long, start long, place long, sequence_id long, offset long, step long, context int",
    )
    placed = stored(placed, "placed")
    tier = F.lit(max(spec.tiers))
    for size in sorted(spec.tiers, reverse=True):
        tier = F.when(F.col("length") <= size, size).otherwise(tier)
    # All pieces of a row but its last are full windows, and they stand side by side.
    copy = F.col("place") - F.expr(f"start div {max(spec.tiers)}")
    out = pieces.join(placed, ["row", "start"]).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", tier.alias("tier"), "sequence_id", "offset",
        "step", "context", *(["ids"] if with_ids else []), *(["place", copy.alias("copy")] if in_order else []),
    )
    return out
