"""Keyed stores as tables: what changes when new rows arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """name, article, changed, reason of each new result (name, article, ens_code, success, confidence)."""
    o = old.select(*[F.col(c).alias(f"o_{c}") for c in ("name", "article", "ens_code", "success", "confidence")], F.lit(True).alias("known"))
    both = new.join(o, new.name.eqNullSafe(F.col("o_name")) & new.article.eqNullSafe(F.col("o_article")), "left")
    differs = ~F.col("ens_code").eqNullSafe(F.col("o_ens_code")) | ~F.col("success").eqNullSafe(F.col("o_success")) | F.coalesce(F.abs(F.col("confidence") - F.col("o_confidence")) > 0.001, ~F.col("confidence").eqNullSafe(F.col("o_confidence")))
    reason = F.when(F.col("known").isNull(), "inserted").when(differs, "updated").otherwise("unchanged")
    return both.select("name", "article", (reason != "unchanged").alias("changed"), reason.alias("reason"))


def merge(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """All rows by key, a new one instead of the old one; null keys are equal."""
    fresh = new.dropDuplicates(keys)
    known = fresh.select(*[F.col(k).alias(f"n_{k}") for k in keys])
    on = [old[k].eqNullSafe(known[f"n_{k}"]) for k in keys]
    return old.join(known, on, "left_anti").unionByName(fresh, allowMissingColumns=True)


def latest(rows: DataFrame, keys: list[str], at: str, tie: list[str]) -> DataFrame:
    """The newest row of each key."""
    w = Window.partitionBy(*keys).orderBy(F.col(at).desc(), *[F.col(t).desc() for t in tie])
    return rows.withColumn("rank", F.row_number().over(w)).where("rank = 1").drop("rank")


def fresh(cache: DataFrame, now, days: int) -> DataFrame:  # noqa: ANN001  Column
    """Rows not older than so many days; without a readable time a row is fresh."""
    return cache.where(F.coalesce(F.try_to_timestamp(F.col("updated_at").cast("string")) > now - F.expr(f"interval {days} days"), F.lit(True)))


def pending(items: DataFrame, results: DataFrame, key: str) -> DataFrame:
    """Items without a completed or ignored result."""
    done = results.where(F.col("status").isin("completed", "ignored")).select(key)
    return items.join(done, key, "left_anti")


def search(results: DataFrame, text: str | None = None, equal: dict | None = None, least: float | None = None, most: float | None = None, order: str = "updated_at", limit: int | None = None, offset: int = 0) -> DataFrame:
    """A page of results, newest first."""
    if text:
        results = results.where(F.contains(F.lower("name"), F.lit(text.lower())))
    for c, v in (equal or {}).items():
        results = results.where(F.lower(F.col(c).cast("string")) == str(v).lower())
    if least is not None:
        results = results.where(F.coalesce("confidence", F.lit(0.0)) >= least)
    if most is not None:
        results = results.where(F.coalesce("confidence", F.lit(0.0)) <= most)
    out = results.orderBy(F.col(order).desc(), *[F.col(c) for c in results.columns if c != order])
    out = out.offset(offset) if offset else out
    return out.limit(limit) if limit is not None else out
