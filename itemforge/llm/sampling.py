"""Bounded samples of rows by hash, without bringing a group's rows to one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_SPACE = 1 << 30


def remainder(by: int) -> Column:
    """crc32 of doc_id as text, modulo by; 0 for a null doc_id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % by, F.lit(0))


def smallest(rows: DataFrame, group: str, most: int) -> DataFrame:
    """doc_id, group of the most distinct rows of each group that have the smallest hash of doc_id.

    The counts of the groups, collected (a row for each group), give a bound for the hash that lets
    some more than so many rows through; only these are ranked.
    """
    own = rows.select("doc_id", group).distinct().withColumn("_hash", F.xxhash64("doc_id"))
    place = F.pmod("_hash", F.lit(_SPACE))
    counts = {r[0]: r["count"] for r in own.groupBy(group).count().collect()}
    bound = F.lit(0)
    for value, n in counts.items():
        # 6 standard deviations over the wanted number
        share = (most + 6 * most**0.5 + 20) / n
        bound = F.when(F.col(group) == F.lit(value), F.lit(int(min(1.0, share) * _SPACE))).otherwise(bound)
    few = own.where(place <= bound)
    rank = F.row_number().over(Window.partitionBy(group).orderBy(place, "_hash", "doc_id"))
    return few.withColumn("_rank", rank).where(F.col("_rank") <= most).drop("_rank", "_hash")


def with_texts(docs: DataFrame, chosen: DataFrame, group: str) -> DataFrame:
    """text, group of the chosen rows (doc_id, group: a bounded number), ordered; of rows that share doc_id and group one."""
    found = docs.select(F.col("doc_id").alias("_id"), "text").join(F.broadcast(chosen), F.col("_id").eqNullSafe(F.col("doc_id")))
    return found.groupBy("doc_id", group).agg(F.min("text").alias("text")).orderBy(group, F.xxhash64("doc_id"), "doc_id").select("text", group)
