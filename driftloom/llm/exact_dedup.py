"""Exact duplicates by progressive refinement: length, then prefix hash, then full hash.

A text counts without differences in white space: each run of it is one space, null is empty.
The first scan keeps two numbers of every text, its length and the hash of its prefix.  Rows
whose length no other row has are settled by the lengths; of the others, those whose prefix no
row of the same length has are settled by the prefixes; only the rows that are left have their
content read again and hashed in full.  They are found by their place in the files (``Rows``),
so no step moves a text, at any size.

Defined cases: empty and null texts are one group; a null id counts as larger than any other;
of repeated rows (same id, same text) exactly one stays; an empty table gives no rows; extra
columns are ignored by ``exact_groups`` and returned unchanged by ``drop_copies``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftloom.llm.common import LISTED_ROWS, SPACE, Rows, join_checked, query, table, written

#: Code points of a text that the prefix hash covers.
PREFIX = 256


def normalised(text: Column) -> Column:
    """Each run of white space as one space, null as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " ")


def full_hash(text: Column) -> Column:
    return F.sha2(normalised(text).cast("binary"), 256)


def _shared(rows: DataFrame, *by: str) -> DataFrame:
    """The rows whose ``by`` another row has."""
    groups = written(rows.groupBy(*by).agg(F.count("*").alias("_c")).where("_c > 1").select(*by))
    return join_checked(rows, groups, list(by), "left_semi")


def _settled(docs: Rows, key: str, text: str, carry: dict[str, Column], prefix: int) -> DataFrame:
    """One row per row of ``docs``: ``_id``, ``_at``, ``_carry``, and for rows in groups ``_first`` and ``_c``."""
    body = F.col(f"_doc.`{text}`")
    columns = [c.alias(k) for k, c in carry.items()]
    plain = docs.numbered().select(F.col(f"_doc.`{key}`").alias("_id"), "_at", normalised(body).alias("_plain"), body.alias("_text"))
    rows = plain.select(
        "_id", "_at", F.length("_plain").alias("_n"), F.xxhash64(F.substring("_plain", 1, prefix)).alias("_p"), F.struct(F.lit(0).alias("_"), *columns).alias("_carry"))
    rows = written(rows)
    live = _shared(_shared(rows.select("_at", "_n", "_p"), "_n"), "_n", "_p").select("_at")
    full = written(docs.chosen(written(live), True, "_at", F.unhex(full_hash(body)).alias("_full")))
    both = rows.select("_id", "_at").join(full, "_at")
    first = F.min(F.struct(F.col("_id").isNull().alias("no"), F.col("_id").alias("id"), F.col("_at").alias("at"))).alias("_first")
    groups = written(both.groupBy("_full").agg(first, F.count("*").alias("_c")).where("_c > 1"))
    in_groups = written(full.join(groups, "_full").select("_at", "_first", "_c", "_full"))
    return join_checked(rows.select("_id", "_at", "_carry"), in_groups, ["_at"], "left")


def exact_groups(
    docs: DataFrame, key: str = "doc_id", text: str = "text", carry: dict[str, Column] | None = None, prefix: int = PREFIX, listed_rows: int = LISTED_ROWS,
) -> DataFrame:
    """One row per row of ``docs``: the key, ``keep_id``, ``group_size``, ``kept`` and the ``carry`` columns (of ``_text``)."""
    out = _settled(Rows(docs, listed_rows), key, text, carry or {}, prefix)
    alone = F.col("_first").isNull()
    return out.select(
        F.col("_id").alias(key),
        F.when(alone, F.col("_id")).otherwise(F.col("_first.id")).alias("keep_id"),
        F.coalesce(F.col("_c"), F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("_at") == F.col("_first.at"))).alias("kept"),
        *[F.col("_carry").getField(k).alias(k) for k in (carry or {})],
        F.col("_full").alias("content_hash"),
    )


def drop_copies(docs: DataFrame, key: str = "doc_id", text: str = "text", listed_rows: int = LISTED_ROWS) -> DataFrame:
    """``docs`` without the rows that ``exact_groups`` does not keep, all columns unchanged."""
    rows = Rows(docs, listed_rows)
    gone = written(_settled(rows, key, text, {}, PREFIX).where("_at <> _first.at").select("_at"))
    return rows.chosen(gone, False, "_doc.*")


ORACLE = r"""
WITH t AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = min(doc_id) OVER w AS kept, text_sha256
FROM t WINDOW w AS (PARTITION BY text_sha256)
"""


@query("op8_exact_dedup", ORACLE)
def op8_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    groups = exact_groups(table(spark, folder, "documents"), carry={"text_sha256": full_hash(F.col("_text"))})
    return groups.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")
