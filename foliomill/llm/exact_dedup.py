"""Exact deduplication with heavy hitters split off.

Texts are equal when they are identical without ASCII white space. Each row is reduced once to a
slim (doc_id, code points, SHA-256) table. A Misra-Gries pass (``freqItems``) names the digests that
may hold more than a ``support`` share of the rows; their exact counts and winners are verified, and
the at most 1/support winners are broadcast, so rows of hot groups are settled where they are read.
All other digests take an ordinary shuffle of slim rows.

Defined results: null texts count as empty, and all empty texts are one group; of equal texts the
one with the most code points stays, then the smallest doc_id (a null doc_id comes last); of rows
that repeat both doc_id and text exactly one is kept. An empty table gives an empty result. Columns
other than doc_id and text are not looked at, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliomill.llm.common import BLANKS, only_rows, text_or_empty, written

SUPPORT = 0.002


def text_digest(text: Column) -> Column:
    """SHA-256 (32 bytes) of the UTF-8 text without ASCII white space."""
    for blank in BLANKS:
        text = F.replace(text, F.lit(blank), F.lit(""))
    return F.unhex(F.sha2(text, 256))


def slim_rows(docs: DataFrame) -> DataFrame:
    text = text_or_empty()
    return docs.select("doc_id", F.length(text).cast("long").alias("points"), text_digest(text).alias("digest"))


def _winners(rows: DataFrame) -> DataFrame:
    """One row per digest: its size, and the points and doc_id of the row that stays."""
    best = F.max(F.struct(F.col("points"), F.bitwise_not("doc_id").alias("less"))).alias("best")  # ~id falls as id grows, without overflow
    return rows.groupBy("digest").agg(F.count("*").alias("group_size"), best).select(
        "digest", "group_size", F.col("best.points").alias("top_points"), F.bitwise_not("best.less").alias("keep_id")
    )


def frequent_digests(rows: DataFrame, support: float = SUPPORT) -> DataFrame:
    """Verified winners of the digests with more than a support share of all rows: at most 1/support.

    Misra-Gries over 64-bit hashes misses no such digest; false positives go in the exact count.
    """
    total = rows.count()
    found = rows.select(F.xxhash64("digest").alias("h")).freqItems(["h"], support).first()["h_freqItems"] if total else []
    suspects = rows.where(F.xxhash64("digest").isin([int(h) for h in found])) if found else rows.limit(0)
    return _winners(suspects).where(F.col("group_size") > F.lit(support * total))


def exact_groups(docs: DataFrame, support: float = SUPPORT) -> DataFrame:
    """Per row of docs: doc_id, keep_id, group_size, kept, text_sha256 and n_copies.

    n_copies counts the rows that repeat this row's doc_id and text.
    """
    rows = written(slim_rows(docs), "digests")
    heavy = written(frequent_digests(rows, support), "heavy")
    hot = rows.join(F.broadcast(heavy), "digest")
    rest = rows.join(F.broadcast(heavy.select("digest")), "digest", "left_anti")
    rest = rest.join(_winners(rest), "digest")
    every = hot.unionByName(rest).withColumn("top", F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("points") == F.col("top_points")))
    plain = every.where(~F.col("top")).select("digest", "doc_id", "keep_id", "group_size", F.lit(False).alias("kept"), F.lit(1).cast("long").alias("n_copies"))
    # rows that repeat the winner differ in nothing that is reported: count them, keep the first
    tops = every.where("top").groupBy("digest", "doc_id", "keep_id", "group_size").agg(F.count("*").alias("n_copies"))
    tops = tops.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n_copies"))))
    tops = tops.select("digest", "doc_id", "keep_id", "group_size", (F.col("copy") == 1).alias("kept"), "n_copies")
    return plain.unionByName(tops).select(
        "doc_id", "keep_id", F.col("group_size").cast("long").alias("group_size"), "kept", F.lower(F.hex("digest")).alias("text_sha256"), "n_copies"
    )


def keep_one_of_equals(docs: DataFrame, support: float = SUPPORT) -> DataFrame:
    """The rows of docs that stay, with all their columns, whatever their names."""
    kept = exact_groups(docs, support).where("kept").select("doc_id", F.unhex("text_sha256").alias("digest"), F.col("n_copies").alias("copies"))
    return only_rows(docs, text_digest(text_or_empty()), kept)
