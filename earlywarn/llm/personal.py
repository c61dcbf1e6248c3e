"""Personal data: fixed patterns, and terms that give a person away by what they stand next to."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from earlywarn.llm.common import NOT_SPACE, SPACE, split_words, stored, text_of

# Kinds in their order, what must be in the text for the pattern to be tried, and the
# pattern. A match starts where its first run of characters starts (or the last match ended), which
# finds the same leftmost matches as trying every character, in linear time.
_LOCAL = r"[A-Za-z0-9._%+-]"
KINDS = (
    ("email", r"@", rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"),
    ("ip", r"[0-9]\.[0-9]", r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"),
    ("card", r"[0-9][\x20-]?[0-9]", r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){15,}+"),
    ("phone", r"\+[0-9]", r"\+[0-9][\x20().0-9-]+[0-9]"),
)
TERM = "term"


@dataclass(frozen=True)
class DisclosureSpec:
    """When a term gives an entity away.

    ``window``: code points on either side of an entity whose whole words count as next to it.
    ``support``: different surroundings in which both must stand together. ``share``: of the documents
    with the term, how many have it next to the entity. ``bits``: how much more likely the entity
    becomes, as a power of two. From ``remove_share`` on a term is removed, below it is generalised.
    ``broadcast_rows`` bounds the term list that is sent to all executors; a longer one is joined.
    """

    window: int = 48
    support: int = 3
    share: float = 0.5
    bits: float = 4.0
    remove_share: float = 0.8
    broadcast_rows: int = 200_000


def _matches(kind: str, hint: str, pattern: str, window: int) -> Column:
    """What stands between matches, and the matches, as lengths, values and surroundings."""
    found = F.regexp_extract_all("text", F.lit(pattern), F.lit(0))
    gaps = F.split("text", pattern, -1)
    both = F.struct(found.alias("found"), gaps.alias("gaps"))
    each = F.transform(F.array(both), lambda b: F.transform(
        b["found"], lambda value, k: F.struct(
            F.lit(kind).alias("kind"), k.alias("nth"), F.char_length(F.get(b["gaps"], k)).alias("gap"),
            value.alias("value"), F.right(F.get(b["gaps"], k), F.lit(window)).alias("left"),
            F.left(F.get(b["gaps"], k + 1), F.lit(window)).alias("right"),
        )
    ))
    empty = F.array().cast(
        "array<struct<kind:string,nth:int,gap:int,value:string,left:string,right:string>>"
    )
    return F.when(F.col("text").rlike(hint), F.flatten(each)).otherwise(empty)


def _luhn(digits: Column) -> Column:
    total = F.aggregate(
        F.sequence(F.lit(1), F.char_length(digits)), F.lit(0),
        lambda acc, i: acc + _luhn_digit(F.substring(digits, -i, F.lit(1)).cast("int"), i),
    )
    return total % 10 == 0


def _luhn_digit(digit: Column, place: Column) -> Column:
    twice = digit * 2
    return F.when(place % 2 == 1, digit).when(twice > 9, twice - 9).otherwise(twice)


def _valid(kind: Column, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    count = F.char_length(digits)
    small = F.forall(
        F.split(value, r"\."),
        lambda p: (F.char_length(F.ltrim(p, F.lit("0"))) <= 3)
        & (F.coalesce(F.right(p, F.lit(3)).cast("int"), F.lit(0)) <= 255),
    )
    return (
        F.when(kind == "ip", small).when(kind == "card", count.between(16, 19) & _luhn(digits))
        .when(kind == "phone", count.between(8, 15)).otherwise(F.lit(True))
    )


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = text_of(text_col)
    return docs.select(F.col(id_col).alias("doc_id"), F.md5(text).alias("digest"), text.alias("text"))


def base_spans(docs: DataFrame, window: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """All rows (id, digest), and the spans of the fixed patterns with their surroundings."""
    texts = _texts(docs, id_col, text_col)
    digits = F.col("text").rlike("[0-9@]")
    found = F.when(digits, F.concat(*[_matches(*kind, window) for kind in KINDS]))
    rows = stored(texts.select("doc_id", "digest", found.alias("found")), "patterns")
    each = rows.where(F.size("found") > 0).dropDuplicates(["doc_id", "digest"])
    each = each.select("doc_id", "digest", F.inline("found"))
    order = Window.partitionBy("doc_id", "digest", "kind").orderBy("nth")
    length = F.char_length("value")
    end = F.sum(F.col("gap") + length).over(order.rowsBetween(Window.unboundedPreceding, 0))
    spans = each.withColumn("end", end).withColumn("start", F.col("end") - length)
    spans = spans.where(_valid(F.col("kind"), F.col("value")))
    return rows.select("doc_id", "digest"), stored(spans.drop("nth", "gap"), "spans")


def revealing_terms(docs: DataFrame, spans: DataFrame, spec: DisclosureSpec, id_col: str, text_col: str) -> DataFrame:
    """``term, share``: the terms whose company discloses an entity (see ``DisclosureSpec``)."""
    cut_left = F.char_length("left") == spec.window
    left, right = split_words(F.col("left")), split_words(F.col("right"))
    # A word that the window or the entity itself cuts is no whole word.
    left = F.when(cut_left, F.slice(left, F.lit(2), F.greatest(F.size(left) - 1, F.lit(0)))).otherwise(left)
    left = F.when(F.col("left").rlike(f"{NOT_SPACE}$"), F.slice(left, F.lit(1), F.greatest(F.size(left) - 1, F.lit(0)))).otherwise(left)
    right = F.when(F.char_length("right") == spec.window, F.slice(right, F.lit(1), F.greatest(F.size(right) - 1, F.lit(0)))).otherwise(right)
    right = F.when(F.col("right").rlike(f"^{NOT_SPACE}"), F.slice(right, F.lit(2), F.greatest(F.size(right) - 1, F.lit(0)))).otherwise(right)
    near = spans.select(
        "doc_id", "digest", F.concat_ws(":", "kind", "value").alias("entity"),
        F.md5(F.concat("left", F.lit("\n"), "right")).alias("around"),
        F.explode(F.array_distinct(F.concat(left, right))).alias("term"),
    )
    # Documents and surroundings are counted once each, in steps that all combine map-side.
    per_doc = near.groupBy("term", "entity", "doc_id", "digest").agg(F.min("around").alias("around"))
    docs_of = per_doc.groupBy("term", "entity").agg(F.count(F.lit(1)).alias("together"))
    kinds_of = near.select("term", "entity", "around").distinct().groupBy("term", "entity").agg(
        F.count(F.lit(1)).alias("support")
    ).where(F.col("support") >= spec.support)
    pairs = stored(docs_of.join(kinds_of, ["term", "entity"]), "pairs")
    entities = spans.select("doc_id", "digest", F.concat_ws(":", "kind", "value").alias("entity")).distinct()
    entities = entities.groupBy("entity").agg(F.count(F.lit(1)).alias("entity_docs"))
    terms = stored(pairs.select("term").distinct(), "terms")
    if terms.isEmpty():
        return terms.withColumn("share", F.lit(0.0))
    words = _texts(docs, id_col, text_col).select(
        F.explode(F.array_distinct(split_words(F.col("text")))).alias("term")
    )
    # Counted before they are joined: frequent words stay one row each, however many documents have them.
    counts = words.groupBy("term").agg(F.count(F.lit(1)).alias("docs")).join(terms.hint("merge"), "term")
    total = docs.count()
    share = F.col("together") / F.col("docs")
    bits = F.log2(share * total / F.col("entity_docs"))
    told = pairs.join(counts, "term").join(entities, "entity").where((share >= spec.share) & (bits >= spec.bits))
    return stored(told.groupBy("term").agg(F.max(share).alias("share")), "revealing")


def term_spans(docs: DataFrame, terms: DataFrame, spec: DisclosureSpec, id_col: str, text_col: str) -> DataFrame:
    """Where the revealing terms stand, as whole words, in any document."""
    texts = _texts(docs, id_col, text_col)
    words = texts.withColumn("term", F.explode(F.array_distinct(split_words(F.col("text")))))
    side = F.broadcast(terms) if terms.count() <= spec.broadcast_rows else terms
    quoted = F.concat(F.lit(r"\Q"), F.replace(F.col("term"), F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))
    pattern = F.concat(F.lit(f"(?<!{NOT_SPACE})"), quoted, F.lit(f"(?!{NOT_SPACE})"))
    gaps = F.transform(F.split("text", pattern, -1), lambda g: F.char_length(g))
    each = words.join(side, "term").select("doc_id", "digest", "term", "share", gaps.alias("gaps"))
    each = each.dropDuplicates(["doc_id", "digest", "term"]).select(
        "doc_id", "digest", "term", "share", F.size("gaps").alias("n"), F.posexplode("gaps").alias("nth", "gap")
    )
    order = Window.partitionBy("doc_id", "digest", "term").orderBy("nth")
    length = F.char_length("term")
    end = F.sum(F.col("gap") + length).over(order.rowsBetween(Window.unboundedPreceding, 0))
    each = each.withColumn("end", end).where(F.col("nth") < F.col("n") - 1)
    return each.select(
        "doc_id", "digest", F.lit(TERM).alias("kind"), F.col("term").alias("value"),
        (F.col("end") - length).alias("start"), "end",
        F.when(F.col("share") >= spec.remove_share, "remove").otherwise("generalise").alias("action"),
    )


def find_personal(
    docs: DataFrame, spec: DisclosureSpec | None = None, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """One row per input row: ``doc_id, digest, spans`` (kind, value, start, end, action; by kind, then start).

    Fixed patterns give spans of the kinds email, ip, card and phone. The corpus then says how strongly
    each word that stands near such entities points to one of them; words beyond the thresholds of
    ``spec`` become spans of kind term wherever they stand, to be removed or generalised. Offsets are
    code points, ends exclusive. Null and empty texts have no spans, empty tables give no rows, a
    repeated row gets the same spans each time, and no other column is read.

    Everything that is grouped is a count of short keys combined map-side, or the matches of one
    document; texts are not shuffled unless the term list outgrows ``broadcast_rows``.
    """
    spec = spec or DisclosureSpec()
    rows, spans = base_spans(docs, spec.window, id_col, text_col)
    terms = revealing_terms(docs, spans, spec, id_col, text_col)
    every = spans.select(
        "doc_id", "digest", "kind", "value", F.col("start").cast("long").alias("start"),
        F.col("end").cast("long").alias("end"), F.lit("mask").alias("action"),
    )
    if not terms.isEmpty():
        every = every.unionByName(term_spans(docs, terms, spec, id_col, text_col))
    names = [k for k, _, _ in KINDS] + [TERM]
    place = F.array_position(F.array(*[F.lit(k) for k in names]), F.col("kind"))
    grouped = every.groupBy("doc_id", "digest").agg(
        F.sort_array(F.collect_list(F.struct(place.alias("place"), "start", "end", "kind", "value", "action"))).alias("spans")
    )
    a, b = rows.alias("a"), stored(grouped, "grouped").alias("b")
    same = F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("a.digest") == F.col("b.digest"))
    empty = F.array().cast("array<struct<place:bigint,start:bigint,end:bigint,kind:string,value:string,action:string>>")
    return a.join(b, same, "left").select(
        F.col("a.doc_id").alias("doc_id"), F.col("a.digest").alias("digest"),
        F.coalesce(F.col("b.spans"), empty).alias("spans"),
    )


def sanitised(
    docs: DataFrame, spec: DisclosureSpec | None = None, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """``doc_id, text``: entities replaced by their kind, terms removed or cut to their first letter."""
    found = find_personal(docs, spec, id_col, text_col).where(F.size("spans") > 0).dropDuplicates(["doc_id", "digest"])
    a, b = _texts(docs, id_col, text_col).alias("a"), found.alias("b")
    same = F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("a.digest") == F.col("b.digest"))
    by_start = F.sort_array(F.transform("b.spans", lambda s: F.struct(s["start"], s["end"], s["kind"], s["value"], s["action"])))
    joined = a.join(b, same, "left").select("a.doc_id", "a.text", by_start.alias("spans"))
    before = lambda i: F.coalesce(F.get("spans", i - 1)["end"], F.lit(0))
    mask = lambda s: F.when(s["action"] == "remove", "").when(
        s["action"] == "generalise", F.concat(F.left(s["value"], F.lit(1)), F.lit("*"))
    ).otherwise(F.concat(F.lit("<"), s["kind"], F.lit(">")))
    parts = F.transform("spans", lambda s, i: F.concat(
        F.substring("text", (before(i) + 1).cast("int"), F.greatest(s["start"] - before(i), F.lit(0)).cast("int")),
        F.when(s["start"] >= before(i), mask(s)).otherwise(""),
    ))
    rest = F.substring("text", (F.element_at("spans", -1)["end"] + 1).cast("int"), F.char_length("text"))
    out = F.when(F.size("spans") > 0, F.concat(F.array_join(parts, ""), rest)).otherwise(F.col("text"))
    return joined.select("doc_id", out.alias("text"))
