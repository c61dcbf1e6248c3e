"""Passages that documents share: MinHash of sliding paragraphs, verified by Jaccard, one copy kept."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from earlywarn.llm.common import collect_garbage, discard, map_arrow, stored, text_of
from earlywarn.llm.components import components
from earlywarn.llm.hashing import MULTIPLIERS, WordHashes, mix


@dataclass(frozen=True)
class PassageSpec:
    """A paragraph is any run of ``paragraph`` words, wherever it starts.

    Its MinHash is the least hash among its runs of ``run`` words, one band of one row: paragraphs
    that are equal always collide. Of two with edits, one collides with the chance that their least
    run survives, and a longer passage has many paragraphs, so a single band finds passages well; more
    ``bands`` (other hashes) find more. Verified pairs agree in ``percent`` per cent of the union of
    their ``shingle``-word shingles.
    """

    paragraph: int = 35
    run: int = 8
    shingle: int = 5
    percent: int = 80
    bands: int = 1

    @property
    def span(self) -> int:
        return self.paragraph - self.run + 1

    @property
    def around(self) -> int:
        """Words of all paragraphs that a run can stand in."""
        return self.run + 2 * (self.span - 1)

    @property
    def slack(self) -> int:
        """Words at the ends of a paragraph that may differ; one further in costs ``shingle`` shingles."""
        each = self.paragraph - self.shingle + 1
        return min(each - -(-2 * each * self.percent // (100 + self.percent)), self.shingle - 1)


_ANCHOR = "doc_id long, tid long, pos int, band long"


def _anchors(words: list[bytes], spec: PassageSpec, hashes: WordHashes) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each band, where the least runs of all paragraphs stand, and their hashes."""
    if len(words) < spec.paragraph:
        return []
    h = hashes.of(words)
    n = len(words) - spec.run + 1
    total = h[:n] * MULTIPLIERS[0]
    for k in range(1, spec.run):
        total = total + h[k : k + n] * MULTIPLIERS[k]
    out = []
    for band in range(spec.bands):
        value = mix(total + np.uint64(band) * MULTIPLIERS[-1 - band])
        views = np.lib.stride_tricks.sliding_window_view(value, spec.span)
        least = np.empty(len(views), "int64")
        for at in range(0, len(views), 1 << 16):
            least[at : at + (1 << 16)] = views[at : at + (1 << 16)].argmin(axis=1)
        at = np.unique(least + np.arange(len(views)))
        out.append((at, value[at]))
    return out


def _anchor_rows(batches: Iterator[pa.RecordBatch], spec: PassageSpec) -> Iterator[pa.RecordBatch]:
    hashes = WordHashes()
    for batch in batches:
        texts, ids, tids = batch.column("text"), batch.column("doc_id").to_pylist(), batch.column("tid").to_pylist()
        rows = []
        for i in range(batch.num_rows):
            for at, value in _anchors(texts[i].as_buffer().to_pybytes().split(), spec, hashes):
                rows.append((np.full(len(at), ids[i], "int64"), np.full(len(at), tids[i], "int64"),
                             at.astype("int32"), value.view("int64")))
        if rows:
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(c)) for c in zip(*rows)], names=["doc_id", "tid", "pos", "band"]
            )


def _context_rows(batches: Iterator[pa.RecordBatch], spec: PassageSpec) -> Iterator[pa.RecordBatch]:
    """The words around each colliding run, as 32-bit hashes; zero where the text has ended."""
    hashes, pad = WordHashes(), spec.span - 1
    for batch in batches:
        texts, places = batch.column("text"), batch.column("places")
        out = []
        for i in range(batch.num_rows):
            h = (hashes.of(texts[i].as_buffer().to_pybytes().split()) >> np.uint64(32)).astype("uint32") | np.uint32(1)
            padded = np.concatenate([np.zeros(pad, "uint32"), h, np.zeros(pad, "uint32")])
            doc_id, tid = batch.column("doc_id")[i].as_py(), batch.column("tid")[i].as_py()
            led = set()
            for place in places[i].as_py():
                around = padded[place["pos"] : place["pos"] + spec.around]
                # A run that the text has again and again leads once.
                lead = place["lead"] and place["band"] not in led
                led.add(place["band"])
                out.append((place["band"], doc_id, tid, place["pos"], lead, place["low"], place["crowd"], around.tobytes()))
        if out:
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.bool_(), pa.bool_(), pa.binary())
            names = ["band", "doc_id", "tid", "pos", "lead", "low", "crowd", "around"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=names)


def _stretches_apart(
    band: np.ndarray, left: np.ndarray, right: np.ndarray, spec: PassageSpec,
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For rows of words around a run: row, first and end word, hash and fits of the stretches that paragraphs which
    agree have in common, without those that ``right`` has too.

    Paragraphs agree word by word if all but ``slack`` words at their ends are the same, so two places
    agree if and only if they have a hash and a bit of ``fits`` in common: bit a is set where the paragraph
    that begins a words before the stretch lies in the text. The outermost stretches also come with one to
    ``slack`` more words, which tell how far equal words go.
    """
    length, pad, slack = spec.paragraph - spec.slack, spec.span - 1, spec.slack
    factors, more = np.resize(MULTIPLIERS, spec.around), np.arange(1, slack + 1)
    starts = np.concatenate([np.arange(slack, pad + 1), slack - more, np.full(slack, pad)])
    stops = np.concatenate([np.arange(slack, pad + 1) + length, np.full(slack, spec.paragraph), pad + length + more])
    places = (starts * spec.around + stops).astype("uint64")

    def of(around: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sums = np.zeros((len(around), spec.around + 1), "uint64")
        np.cumsum(around * factors, axis=1, out=sums[:, 1:])
        key = mix(sums[:, stops] - sums[:, starts] + mix(band[:, None] + places))
        whole = (around[:, : pad + 1] != 0) & (around[:, spec.paragraph - 1 :] != 0)
        fits = np.zeros(key.shape, "int32")
        for a in range(slack + 1):
            at = np.flatnonzero((starts >= a) & (starts - a + spec.paragraph >= stops))
            fits[:, at] |= whole[:, starts[at] - a].astype("int32") << a
        return key, fits

    (key, fits), (other, theirs) = of(left), of(right)
    fits = np.where(key == other, fits & ~theirs, fits)
    row, at = np.nonzero(fits)
    return row, starts[at], stops[at], key[row, at], fits[row, at]


def _jaccard(a: np.ndarray, b: np.ndarray, size: int) -> float:
    sets = [{tuple(x[i : i + size]) for i in range(len(x) - size + 1)} for x in (a.tolist(), b.tolist())]
    return len(sets[0] & sets[1]) / len(sets[0] | sets[1])


def matching_spans(left: np.ndarray, right: np.ndarray, spec: PassageSpec) -> tuple[np.ndarray, np.ndarray]:
    """For rows of words around a shared run: first and end word of the paragraphs that agree, or -1.

    Words that stand at the same place are compared for all paragraphs at once, which gives a Jaccard
    that is never too high; where that does not decide, the best placed paragraphs are compared as sets.
    """
    same = (left == right) & (left != 0)
    shared = same[:, : -(spec.shingle - 1)].copy()
    for k in range(1, spec.shingle):
        shared &= same[:, k : same.shape[1] - spec.shingle + 1 + k]
    each = spec.paragraph - spec.shingle + 1
    sums = np.concatenate([np.zeros((len(same), 1), int), np.cumsum(shared, axis=1)], axis=1)
    hits = sums[:, each:] - sums[:, :-each]
    outside = np.cumsum(np.pad((left == 0) | (right == 0), ((0, 0), (1, 0))), axis=1)
    whole = outside[:, spec.paragraph :] == outside[:, : -spec.paragraph]
    agree = whole & (100 * hits >= spec.percent * (2 * each - hits))
    best = hits.argmax(axis=1)
    for i in np.flatnonzero(~agree.any(axis=1) & (hits.max(axis=1) * 3 >= each)):
        a, b = (x[i, best[i] : best[i] + spec.paragraph] for x in (left, right))
        if whole[i, best[i]] and 100 * _jaccard(a, b, spec.shingle) >= spec.percent:
            agree[i, best[i]] = True
    found = agree.any(axis=1)
    first = agree.argmax(axis=1)
    end = agree.shape[1] - 1 - agree[:, ::-1].argmax(axis=1) + spec.paragraph
    # The stretch begins and ends with a word that both texts have there.
    place = np.arange(same.shape[1])
    inside = same & (place >= first[:, None]) & (place < end[:, None])
    first, end = inside.argmax(axis=1), same.shape[1] - inside[:, ::-1].argmax(axis=1)
    return np.where(found, first, -1), np.where(found, end, -1)


_VERIFIED = pa.schema([
    ("doc_id", pa.int64()), ("tid", pa.int64()), ("hub", pa.int64()), ("start", pa.int64()), ("end", pa.int64()),
    ("band", pa.int64()), ("key", pa.int64()), ("fits", pa.int32()),
])


def _verify(batches: Iterator[pa.RecordBatch], spec: PassageSpec) -> Iterator[pa.RecordBatch]:
    """Spans that a place shares with a hub's, and (with a key) stretches of it that the smallest id lacks."""
    for batch in batches:
        left, right = (
            np.frombuffer(b"".join(batch.column(c).to_pylist()), "uint32").reshape(-1, spec.around) for c in ("x", "y")
        )
        doc_id, tid, hub, hub_tid, band = (
            batch.column(c).to_numpy() for c in ("doc_id", "tid", "hub", "hub_tid", "band")
        )
        at, hub_at = (batch.column(c).to_numpy().astype("int64") - (spec.span - 1) for c in ("pos", "hub_pos"))
        crowd = batch.column("low").to_numpy(zero_copy_only=False) & batch.column("crowd").to_numpy(zero_copy_only=False)
        first, end = matching_spans(left, right, spec)
        some = np.flatnonzero((first >= 0) & (doc_id != hub))
        # Of many that share with the smallest id, not all may share with the largest: its own span is kept apart.
        back = some[crowd[some]]
        apart = np.flatnonzero(crowd)
        row, start, stop, key, fits = _stretches_apart(band[apart].view("uint64"), left[apart], right[apart], spec)
        row = apart[row]
        found = [
            np.concatenate(c) for c in (
                (doc_id[some], hub[back], doc_id[row]), (tid[some], hub_tid[back], tid[row]),
                (hub[some], hub[back], doc_id[row]),
                ((at + first)[some], (hub_at + first)[back], at[row] + start),
                ((at + end)[some], (hub_at + end)[back], at[row] + stop),
            )
        ]
        spans = len(some) + len(back)
        last = [band[row], key.view("int64"), fits.astype("int32")]
        last = [pa.concat_arrays([pa.nulls(spans, t), pa.array(c, t)]) for c, t in zip(last, _VERIFIED.types[5:])]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in found] + last, schema=_VERIFIED)


def shared_spans(
    docs: DataFrame, spec: PassageSpec | None = None, id_col: str = "doc_id", text_col: str = "text",
) -> tuple[DataFrame, DataFrame]:
    """All rows (doc_id, tid), and ``doc_id, tid, hub, start, end``: words that document ``hub`` has too,
    or, where ``hub`` is the document itself, that some other has.

    First ``hub`` is the smallest or largest id of those that share a run, at its first place there. Where
    a run has more places, those with other words round it than the smallest id are grouped by these words
    (``_stretches_apart``), and each has the smallest and the largest id of its groups as hubs. So copies
    are compared with a few others and never all with one another; the rows of a hot passage are counts
    combined map-side and joins that adaptive execution can split.
    """
    spec = spec or PassageSpec()
    text = text_of(text_col)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("tid"), text.alias("text"))
    named = texts.where(F.col("doc_id").isNotNull())
    anchors = stored(map_arrow(named, lambda b: _anchor_rows(b, spec), _ANCHOR), "anchors")
    shared = anchors.groupBy("band").agg(
        F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), (F.count(F.lit(1)) > 2).alias("crowd")
    ).where("lo < hi")
    shared = stored(anchors.join(shared.hint("merge"), "band"), "shared")
    discard(anchors)
    lead = (F.col("doc_id") == F.col("lo")) | (F.col("doc_id") == F.col("hi"))
    places = shared.groupBy("doc_id", "tid").agg(
        F.sort_array(F.collect_set(F.struct(
            "pos", "band", lead.alias("lead"), (F.col("doc_id") == F.col("lo")).alias("low"), "crowd"
        ))).alias("places")
    )
    with_text = named.join(places.hint("merge"), ["doc_id", "tid"])
    context = map_arrow(
        with_text, lambda b: _context_rows(b, spec),
        "band long, doc_id long, tid long, pos int, lead boolean, low boolean, crowd boolean, around binary",
    )
    context = stored(context, "contexts")
    discard(shared)
    collect_garbage(docs.sparkSession)
    hubs = context.where("lead").select(
        "band", "low", F.col("doc_id").alias("hub"), F.col("tid").alias("hub_tid"), F.col("pos").alias("hub_pos"),
        F.col("around").alias("y"),
    )
    pairs = context.withColumnRenamed("around", "x").drop("lead", "low").join(hubs.hint("merge"), "band")
    pairs = pairs.where("doc_id <> hub OR (low AND crowd)")
    schema = "doc_id long, tid long, hub long, start long, end long, band long, key long, fits int"
    found = stored(map_arrow(pairs, lambda b: _verify(b, spec), schema), "verified")
    discard(context)
    collect_garbage(docs.sparkSession)
    spans = found.where("key IS NULL").select("doc_id", "tid", "hub", "start", "end")
    spans = spans.union(_same_surroundings(found.where("key IS NOT NULL"), spec))
    spans = stored(spans.distinct(), "spans")
    discard(found)
    return texts.select("doc_id", "tid"), spans


def _same_surroundings(stretches: DataFrame, spec: PassageSpec) -> DataFrame:
    """Stretches that other documents have round the same run, with the smallest and largest id of these."""
    fit = range(spec.slack + 1)
    has = [F.col("fits").bitwiseAND(F.lit(1 << a)) != 0 for a in fit]
    ends = stretches.groupBy("band", "key").agg(
        F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"),
        *[F.min(F.when(has[a], F.col("doc_id"))).alias(f"lo_{a}") for a in fit],
        *[F.max(F.when(has[a], F.col("doc_id"))).alias(f"hi_{a}") for a in fit],
    ).where("lo < hi").drop("lo", "hi")
    # Read again, so that adaptive execution can split the rows of a hot stretch.
    ends = stored(ends, "ends")
    hubs = F.array(*[F.when(has[a], F.col(f"{end}_{a}")) for a in fit for end in ("lo", "hi")])
    spans = stretches.drop("hub").join(ends.hint("merge"), ["band", "key"]).select(
        "doc_id", "tid", F.explode(F.array_distinct(hubs)).alias("hub"), "start", "end"
    )
    return spans.where("hub <> doc_id")


def repeated_passages(
    docs: DataFrame, spec: PassageSpec | None = None, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """One row per row: the passages a document shares with others, and which of them to remove.

    Returns ``doc_id``, ``component_id`` (smallest id reachable through shared passages, its own if
    none), ``n_links`` (documents it was found to share with), ``n_passages`` and ``shared_words`` for the
    joined stretches, and ``removed``: stretches as ``start:end`` in words that a document with a
    smaller id keeps. Null and empty texts and those shorter than a paragraph share nothing; exact
    repeats of at least a paragraph of words are always found; rows of one id share nothing with each
    other; empty tables give no rows; other columns are not read.
    """
    spec = spec or PassageSpec()
    rows, spans = shared_spans(docs, spec, id_col, text_col)
    # Both ends of a link have the passage; the far end is found from its own anchors.
    roots = components(spans.select(F.col("doc_id").alias("a"), F.col("hub").alias("b")))
    roots = stored(roots.select(F.col("node").alias("doc_id"), F.col("root").alias("component_id")), "roots")
    links = spans.where("hub <> doc_id").select("doc_id", F.col("hub").alias("other"))
    links = links.union(links.select("other", "doc_id")).distinct().groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n_links")
    )
    all_spans = _stretches(spans.select("doc_id", "tid", "start", "end")).groupBy("doc_id", "tid").agg(
        F.count(F.lit(1)).alias("n_passages"), F.sum(F.col("end") - F.col("start")).alias("shared_words")
    )
    gone = _stretches(spans.where("hub < doc_id").select("doc_id", "tid", "start", "end"))
    gone = gone.groupBy("doc_id", "tid").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("gone"))
    out = rows
    for side, keys in ((roots, ["doc_id"]), (links, ["doc_id"]), (all_spans, ["doc_id", "tid"]), (gone, ["doc_id", "tid"])):
        out = out.join(side.hint("merge"), keys, "left")
    none = F.array().cast("array<struct<start:bigint,end:bigint>>")
    text = F.transform(F.coalesce("gone", none), lambda s: F.concat_ws(":", s["start"], s["end"]))
    return out.select(
        "doc_id", F.coalesce("component_id", "doc_id").alias("component_id"),
        *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_links", "n_passages", "shared_words")],
        F.array_join(text, ",").alias("removed"),
    )


def _stretches(spans: DataFrame) -> DataFrame:
    """Overlapping and touching spans of one document as one."""
    order = Window.partitionBy("doc_id", "tid").orderBy("start", "end")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.when(F.col("start") <= reach, 0).otherwise(1)
    marked = spans.withColumn("fresh", fresh).withColumn(
        "stretch", F.sum("fresh").over(order.rowsBetween(Window.unboundedPreceding, 0))
    )
    return marked.groupBy("doc_id", "tid", "stretch").agg(F.min("start").alias("start"), F.max("end").alias("end"))
