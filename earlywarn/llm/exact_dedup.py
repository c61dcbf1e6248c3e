"""Exact duplicates: group by a 128-bit content hash, keep one row, compare bytes inside groups."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from earlywarn.llm.common import SPACE, stored, text_of


def md5_bytes(text: Column) -> Column:
    return F.unhex(F.md5(text))


def exact_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    content_hash: Callable[[Column], Column] = md5_bytes,
) -> DataFrame:
    """One row per input row with its duplicate group.

    Texts are equal when they agree after deleting spaces, tabs and line ends; null is the empty
    text. Of equal texts the longest original stays, then the smallest id (null ids last), then, for
    fully repeated rows, one of them. Returns ``doc_id, keep_id, group_size, kept, text_sha256``.
    Empty tables give empty results; other columns of ``docs`` are not read.

    Rows are grouped by ``content_hash``; only the rows of groups of two and more are then read
    again and compared byte by byte with the row that stays. Should a hash join different texts, its
    group is divided by the 256-bit digest. Signatures are counted map-side. The joins on the hash are
    merge joins at every size (the list of groups grows with the input, so it is not to be broadcast)
    with a plain exchange on either side, so adaptive execution splits a hot group.
    """
    text = text_of(text_col)
    plain = docs.select(
        F.col(id_col).alias("doc_id"), F.char_length(text).alias("chars"),
        F.regexp_replace(text, SPACE, "").alias("plain"),
    )
    hashed = plain.withColumn("key", content_hash(F.col("plain")))
    rows = stored(
        hashed.select(
            "doc_id", "chars", "key", F.sha2("plain", 256).alias("text_sha256"),
            F.monotonically_increasing_id().alias("row"),
        ),
        "signatures",
    )
    groups = stored(_first_of(rows, "key"), "groups")
    members = hashed.join(groups.select("key", "first").hint("merge"), "key")
    leads = members["doc_id"].eqNullSafe(F.col("first.doc_id")) & (F.col("chars") == F.col("first.chars"))
    members = stored(members.select("key", "plain", leads.alias("leads")), "members")
    lead = members.where("leads").groupBy("key").agg(F.first("plain").alias("lead"))
    odd = members.where("NOT leads").join(stored(lead, "leads").hint("merge"), "key").where("plain <> lead")
    odd = stored(odd.select("key").distinct().withColumn("collided", F.lit(True)), "collisions")
    if not odd.isEmpty():
        rows = rows.join(odd, "key", "left").withColumn(
            "key", F.when(F.col("collided"), F.concat("key", F.unhex("text_sha256"))).otherwise(F.col("key"))
        ).drop("collided")
        groups = stored(_first_of(rows, "key"), "groups")
    return rows.join(groups.hint("merge"), "key", "left").select(
        "doc_id",
        F.when(F.col("first").isNull(), F.col("doc_id")).otherwise(F.col("first.doc_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        (F.col("first").isNull() | (F.col("row") == F.col("first.row"))).alias("kept"),
        "text_sha256",
    )


def _first_of(rows: DataFrame, key: str) -> DataFrame:
    """Groups of two and more rows: how many, and which stays."""
    best = F.struct(
        (-F.col("chars")).alias("less"), F.col("doc_id").isNull().alias("no_id"), "doc_id", "row", "chars"
    )
    found = rows.groupBy(key).agg(F.count(F.lit(1)).alias("group_size"), F.min(best).alias("first"))
    return found.where("group_size > 1")


def drop_exact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows whose text an earlier or longer row has; columns as they were.

    A row that is repeated with the same id and text stays once.
    """
    copies = exact_groups(docs, id_col, text_col).where("group_size > 1")
    verdict = stored(
        copies.groupBy("doc_id", "text_sha256").agg(
            F.max("kept").alias("stays"), F.count(F.lit(1)).alias("rows")
        ),
        "verdicts",
    )
    digest = F.sha2(F.regexp_replace(text_of(text_col), SPACE, ""), 256)
    names = [F.col(f"d.`{c}`") for c in docs.columns]
    same = F.col(f"d.`{id_col}`").eqNullSafe(F.col("v.doc_id")) & (digest == F.col("v.text_sha256"))
    joined = docs.alias("d").join(verdict.alias("v"), same, "left")
    stay = joined.where("v.stays IS NULL OR (v.stays AND v.rows = 1)").select(*names)
    if verdict.where("stays AND rows > 1").isEmpty():
        return stay
    again = joined.where("v.stays AND v.rows > 1").select(F.col("v.text_sha256").alias("_text_key"), *names)
    return stay.union(again.dropDuplicates(["_text_key"]).drop("_text_key"))
