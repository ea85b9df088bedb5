"""Statistics over examples from which masks are made: how parameters stand in names."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BRACKETED, NEEDED = 0.9, 0.85


def kinds_of_fields(stats: DataFrame, group: list[str]) -> DataFrame:
    """group, required and optional fields from stored counts (field, visible_count, total_count)."""
    share = F.try_divide("visible_count", "total_count")
    pick = lambda test: F.sort_array(F.collect_list(F.when(test, F.col("field"))))
    return stats.groupBy(*group).agg(pick(share >= NEEDED).alias("required"), pick((share < NEEDED) & (F.col("visible_count") > 0)).alias("optional"))


def parentheses(rows: DataFrame, group: list[str]) -> DataFrame:
    """group, param, in parentheses, bare, verdict (paren, mixed, bare) of the values that occur in names (name, param, value)."""
    inside = F.contains("name", F.concat(F.lit("("), F.col("value"), F.lit(")")))
    seen = rows.where(F.contains("name", F.col("value")))
    out = seen.groupBy(*group, "param").agg(F.count_if(inside).alias("paren"), F.count_if(~inside).alias("bare"))
    share = F.col("paren") / (F.col("paren") + F.col("bare"))
    return out.withColumn("verdict", F.when(share >= BRACKETED, "paren").when(F.col("paren") == 0, "bare").otherwise("mixed"))


def letter_m(rows: DataFrame, group: list[str]) -> DataFrame:
    """group, as_prefix, as_coating: how often М stands before a digit and how often it is the coating."""
    return rows.groupBy(*group).agg(F.count_if(F.col("name").rlike(r"(?iu)(?<![\p{L}])[мm]\d")).alias("as_prefix"), F.count_if(F.lower("coating").isin("м", "m")).alias("as_coating"))


def displayed(rows: DataFrame) -> DataFrame:
    """name, shown (parameters by their place in the name), equal (keys whose values occur more than once), missing (keys whose value is not in the name); rows: name, params (array<struct<k, v>>)."""
    at = F.filter(F.transform("params", lambda e: F.struct(F.instr(F.lower("name"), F.lower(e.v)).alias("at"), e.k.alias("k"), e.v.alias("v"))), lambda e: e.at > 0)
    shown = F.transform(F.array_sort(at), lambda e: F.concat(e.k, F.lit("="), e.v))
    equal = F.transform(F.filter("params", lambda e: F.size(F.filter("params", lambda o: o.v == e.v)) > 1), lambda e: e.k)
    missing = F.transform(F.filter("params", lambda e: F.instr(F.lower("name"), F.lower(e.v)) == 0), lambda e: e.k)
    return rows.select("name", shown.alias("shown"), equal.alias("equal"), missing.alias("missing"))


def frequencies(rows: DataFrame) -> DataFrame:
    """param, n, from the most frequent on."""
    return rows.select(F.explode("params").alias("e")).groupBy(F.col("e.k").alias("param")).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "param")


def representative(rows: DataFrame, group: list[str], order: str, n: int = 20) -> DataFrame:
    """Up to n examples of a group: first, for each parameter, the earliest row that has it, from the rarest on; then those with the most parameters."""
    each = rows.select(*group, order, F.explode(F.transform("params", lambda e: e.k)).alias("param"))
    rare = each.groupBy(*group, "param").agg(F.count("*").alias("seen"), F.min(order).alias(order))
    lead = rare.groupBy(*group, order).agg(F.min("seen").alias("rarest"))
    w = Window.partitionBy(*group).orderBy(F.col("rarest").asc_nulls_last(), F.size("params").desc(), order)
    return rows.join(lead, [*group, order], "left").withColumn("place", F.row_number().over(w)).where(F.col("place") <= n).drop("rarest")


def training_examples(rows: DataFrame, least: int = 2) -> DataFrame:
    """name, entities (start, end, label of the first occurrence of each value) of rows with enough parameters that are not null."""
    enough = rows.where(F.size(F.filter("params", lambda e: e.v.isNotNull())) >= least)
    spans = F.transform("params", lambda e: F.struct((F.instr(F.lower("name"), F.lower(e.v)) - 1).alias("start"), (F.instr(F.lower("name"), F.lower(e.v)) - 1 + F.length(e.v)).alias("end"), e.k.alias("label")))
    return enough.select("name", F.array_sort(F.filter(spans, lambda s: s.start >= 0)).alias("entities"))


def restricted(rows: DataFrame) -> DataFrame:
    """Candidates with their visible fields alone: rows (ens_code, cand_name, attrs, visible)."""
    return rows.select("ens_code", "cand_name", F.filter("attrs", lambda e: F.array_contains("visible", e.k)).alias("attrs"))
