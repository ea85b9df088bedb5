"""Catalogue profiling on the long form (group, row, ord, field, value): which columns say something."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from itemforge.functions.text import value_visible

EMPTY = ["", " ", "0", "0.0", "None"]
RARE, REQUIRED, OPTIONAL = 0.01, 0.85, 0.05


def melt(wide: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """keys, field, value: one row for each field of a row."""
    rows = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields])
    return wide.select(*keys, F.inline(rows))


def filled(value: Column) -> Column:
    return value.isNotNull() & ~F.trim(value).isin(*[e.strip() for e in EMPTY])


def field_fill(long: DataFrame, group: list[str]) -> DataFrame:
    """Filled values of each field, percent and band; empty and rare flags; distinct values for constants."""
    g = long.groupBy(*group, "field").agg(F.count("*").alias("total"), F.count_if(filled(F.col("value"))).alias("filled"), F.countDistinct(F.when(filled(F.col("value")), F.trim("value"))).alias("n_values"))
    share = F.col("filled") / F.col("total")
    return g.select("*", (share * 100).alias("percent"), F.when(share >= 0.95, "full").when(share >= 0.5, "half").otherwise("low").alias("band"), (F.col("filled") == 0).alias("always_empty"), ((F.col("filled") > 0) & (share < RARE)).alias("rare"), (F.col("n_values") <= 1).alias("constant"))


def visible(long: DataFrame, group: list[str], name: str = "name") -> DataFrame:
    """visible_count, total_count of each field; needed: required, optional or rarely seen."""
    seen = value_visible(F.col("value"), F.col(name), F.col("field"))
    g = long.groupBy(*group, "field").agg(F.count_if(seen).alias("visible_count"), F.count("*").alias("total_count"))
    share = F.col("visible_count") / F.col("total_count")
    return g.withColumn("needed", F.when(share >= REQUIRED, "required").when(share >= OPTIONAL, "optional").otherwise("rarely"))


def same_values(long: DataFrame, group: list[str]) -> DataFrame:
    """Pairs of fields of a group with equal sets of values; sets meet by their hash."""
    values = long.where(filled(F.col("value"))).select(*group, "field", F.trim("value").alias("value")).distinct()
    sets = values.groupBy(*group, "field").agg(F.count("*").alias("n"), F.sum(F.xxhash64("value").cast("decimal(38,0)")).alias("h"), F.bit_xor(F.xxhash64("value", F.lit(1))).alias("x"))
    a, b = sets.withColumnRenamed("field", "field_a"), sets.withColumnRenamed("field", "field_b")
    return a.join(b, [*group, "n", "h", "x"]).where("field_a < field_b").select(*group, "field_a", "field_b")


def twin_pairs(long: DataFrame, group: list[str], row: list[str], threshold: float = 1.0) -> DataFrame:
    """Pairs of fields that agree in threshold of the rows of their group; rows in which both are empty don't count."""
    rows = long.groupBy(*group, *row).agg(F.collect_list(F.struct("field", F.coalesce("value", F.lit("")).alias("value"))).alias("f"))
    pairs = rows.select(*group, F.explode("f").alias("a"), "f").select(*group, "a", F.explode("f").alias("b")).where("a.field < b.field and not (a.value = '' and b.value = '')")
    out = pairs.groupBy(*group, F.col("a.field").alias("field_a"), F.col("b.field").alias("field_b")).agg(F.count("*").alias("rows"), F.count_if(F.col("a.value") == F.col("b.value")).alias("equal"))
    return out.where(F.col("equal") >= F.col("rows") * threshold)


def prune(long: DataFrame, group: list[str], keep: list[str], name: str = "name") -> tuple[DataFrame, DataFrame]:
    """(long without the columns that say nothing, why each left): empty, rare, constant and unseen, unseen."""
    facts = field_fill(long, group).join(visible(long, group, name), [*group, "field"])
    kept, unseen = F.col("field").isin(keep), F.col("visible_count") == 0
    reason = F.when(F.col("always_empty"), "empty").when(F.col("rare"), "rare").when(F.col("constant") & unseen & ~kept, "constant").when(unseen & ~kept, "invisible")
    reasons = facts.withColumn("reason", reason).where("reason is not null").select(*group, "field", "reason")
    return long.join(reasons.select(*group, "field"), [*group, "field"], "left_anti"), reasons


def large_groups(rows: DataFrame, group: list[str], least: int = 5) -> DataFrame:
    """rows of the groups with enough of them."""
    return rows.join(rows.groupBy(*group).count().where(F.col("count") >= least).select(*group), group, "left_semi")
