"""Masks: rules that turn a name into parameters, by standard and item type.

A mask table has id, standard, item_type, pattern (Java regex with numbered groups), params
(array, in group order), required (array), auto_score, is_active, created_at. It is small by its
nature (a rule for each kind of item), but joins leave the choice of strategy to the optimizer.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from itemforge.functions.text import canonical_standard, mask_hash

#: Masks with a known layout: (standard, item type, pattern, parameters, required).
SEEDS = [
    ("ОСТ 1 31133-80", "болт", r"^болт \((\d)\)-(\d+)-(\d+)-([\p{L}\p{N}_.]+)-ост 1 31133-80", ["исполнение", "диаметр", "длина", "покрытие"], ["диаметр", "длина"]),
    ("ГОСТ 17475-80", "винт", r"^винт [mм](\d+)[xх](\d+) гост 17475-80", ["диаметр", "длина"], ["диаметр", "длина"]),
    ("ОСТ 1 34505-80", "шайба", r"^шайба (\d+)-(\d+)-([\p{L}\p{N}_.]+)-ост ?1 34505-80", ["диаметр", "длина", "покрытие"], ["диаметр"]),
    ("ГОСТ 7795-70", "болт", r"^болт (\d)?[mм](\d+)(?:[xх]([\d,]+))?-([\d\p{L}]+)[xх]([\d,]+)\.(\d+) гост 7795-70", ["исполнение", "диаметр", "шаг", "допуск", "длина", "свойства"], ["диаметр", "длина"]),
]


def seed_masks(spark: SparkSession, seeds: list[tuple] = SEEDS) -> DataFrame:
    rows = [(i + 1, s, t, p, params, need, 1.0, True) for i, (s, t, p, params, need) in enumerate(seeds)]
    return spark.createDataFrame(rows, "id long, standard string, item_type string, pattern string, params array<string>, required array<string>, auto_score double, is_active boolean").withColumn("created_at", F.lit("2024-01-01").cast("timestamp"))


def translate_pattern(pattern: str) -> tuple[str, list[str]]:
    """A pattern with named groups as numbered groups and the names in order; groups without a name stop capturing."""
    names = re.findall(r"\(\?P<([^>]+)>", pattern)
    out = re.sub(r"(?<!\\)\((?!\?)", "(?:", pattern)
    return re.sub(r"\(\?P<[^>]+>", "(", out), names


def best_masks(masks: DataFrame, keys: list[str]) -> DataFrame:
    """The mask of each key with the highest score, the newest of equal ones."""
    w = Window.partitionBy(*keys).orderBy(F.col("auto_score").desc(), F.col("created_at").desc(), F.col("id"))
    return masks.withColumn("rank", F.row_number().over(w)).where("rank = 1").drop("rank")


def attach_masks(names: DataFrame, masks: DataFrame) -> DataFrame:
    """names (std, item_type, ...) with mask_id: by standard and upper-case type, by standard and type, by standard alone."""
    upper = best_masks(masks.withColumn("t", F.upper("item_type")), ["standard", "t"]).select(F.col("standard").alias("s1"), F.col("t").alias("t1"), F.col("id").alias("m1"))
    exact = best_masks(masks, ["standard", "item_type"]).select(F.col("standard").alias("s2"), F.col("item_type").alias("t2"), F.col("id").alias("m2"))
    any_ = best_masks(masks, ["standard"]).select(F.col("standard").alias("s3"), F.col("id").alias("m3"))
    out = names.join(upper, (names.std == F.col("s1")) & (F.upper("item_type") == F.col("t1")), "left")
    out = out.join(exact, (F.col("std") == F.col("s2")) & (F.col("item_type") == F.col("t2")), "left").join(any_, F.col("std") == F.col("s3"), "left")
    return out.withColumn("mask_id", F.coalesce("m1", "m2", "m3")).drop("s1", "t1", "m1", "s2", "t2", "m2", "s3", "m3")


def parse(names: DataFrame, masks: DataFrame, text: str = "text", into: str = "params") -> DataFrame:
    """names (with mask_id) with params (or the column into): array<struct<k, v>> of the groups that matched, null where the mask did not.

    One expression for each mask, as the number of groups must be constant; matching is anchored at
    the start and ignores case by lower-casing both.
    """
    rows = masks.select("id", "pattern", "params").orderBy("id").collect()  # a rule table, a row for each kind of item
    low = F.lower(F.col(text))
    out = F.lit(None).cast("array<struct<k: string, v: string>>")
    for r in rows:
        pattern = r.pattern if r.pattern.startswith("^") else f"^{r.pattern}"
        span = low.rlike(pattern)
        original = F.col(text)
        pairs = [F.struct(F.lit(k).alias("k"), F.trim(F.regexp_extract(original, f"(?iu){pattern}", i + 1)).alias("v")) for i, k in enumerate(r.params)]
        out = F.when((F.col("mask_id") == r.id) & span, F.filter(F.array(*pairs), lambda e: e.v != "")).otherwise(out)
    return names.withColumn(into, out)


def param_names(masks: DataFrame) -> list[str]:
    """All parameters of a rule table, in the order of their first mask."""
    return list(dict.fromkeys(k for r in masks.select("id", "params").orderBy("id").collect() for k in r.params))


def validate(rows: DataFrame) -> DataFrame:
    """mask_id, total, matched, mismatched, missing, score, band from rows (mask_id, params, expected: array<struct<k, v>>)."""
    got = F.transform(F.col("expected"), lambda e: F.struct(e.v.alias("v"), F.get(F.filter("params", lambda p: p.k == e.k), 0).v.alias("p")))
    checked = rows.withColumn("got", got)
    bad = F.exists("got", lambda g: g.p.isNotNull() & (g.p != g.v))
    lost = F.col("params").isNull() | F.exists("got", lambda g: g.p.isNull())
    counted = checked.select("mask_id", F.when(F.col("params").isNull(), "missing").when(bad, "mismatched").when(lost, "missing").otherwise("matched").alias("state"))
    out = counted.groupBy("mask_id").agg(F.count("*").alias("total"), *[F.count_if(F.col("state") == s).alias(s) for s in ("matched", "mismatched", "missing")])
    out = out.withColumn("score", F.col("matched") / F.col("total"))
    return out.withColumn("band", band(F.col("score")))


def band(score):  # noqa: ANN001, ANN201  Column
    """Quality gate of a mask."""
    return F.when(score >= 0.85, "active").when(score >= 0.5, "draft").otherwise("rejected")


def stats(masks: DataFrame) -> DataFrame:
    return masks.agg(F.count("*").alias("total"), F.count_if("is_active").alias("active"), F.count_if(~F.col("is_active")).alias("inactive"), F.coalesce(F.avg("auto_score"), F.lit(0.0)).alias("avg_score"))


def cleanup(masks: DataFrame, least: float = 0.5) -> DataFrame:
    """Without inactive masks of a low score."""
    return masks.where(~((F.col("auto_score") < least) & ~F.col("is_active")) | F.col("auto_score").isNull())


def save(masks: DataFrame, new: DataFrame, replace_existing: bool = False) -> DataFrame:
    """Upsert by the hash of (canonical standard, item type, pattern): a new row replaces the old one of its hash.

    replace_existing: a new row also replaces the newest mask of its standard and item type, and keeps its id. Of new rows with one hash
    (or, to replace, of one standard and type) the last created stays.
    """
    keyed = lambda df: df.withColumn("pattern_hash", mask_hash(F.col("standard"), F.col("item_type"), F.col("pattern")))
    newest = lambda df, *keys: df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("created_at").desc(), F.col("id").desc()))).where("_r = 1").drop("_r")
    fresh = keyed(new.withColumn("standard", canonical_standard(F.col("standard"))))
    fresh = newest(fresh, "standard", "item_type") if replace_existing else newest(fresh, "pattern_hash")
    if replace_existing:
        old = newest(masks, "standard", "item_type").select("standard", "item_type", F.col("id").alias("_id"))
        fresh = fresh.join(old, ["standard", "item_type"], "left").withColumn("id", F.coalesce("_id", "id"))
        masks = masks.join(fresh.where("_id is not null").select("id"), "id", "left_anti")
        fresh = fresh.drop("_id").select(*[c for c in new.columns], "pattern_hash")
    return keyed(masks).join(fresh.select("pattern_hash"), "pattern_hash", "left_anti").unionByName(fresh, allowMissingColumns=True)
