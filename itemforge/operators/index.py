"""The catalogue index: headers, fields of a group, twin fields, the stored index and its summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def number_headers(headers: list[str]) -> list[str]:
    """Repeated headers get _1, _2, ... from their second occurrence on."""
    seen: dict[str, int] = {}
    out = []
    for h in headers:
        n = seen.get(h, 0)
        seen[h] = n + 1
        out.append(f"{h}_{n}" if n else h)
    return out


def field_meta(visible: DataFrame, group: list[str], metadata: list[str]) -> DataFrame:
    """group, visible and metadata (sorted lists of fields), n_fields; visible as profile.visible gives it."""
    meta = F.col("field").isin(metadata)
    return visible.groupBy(*group).agg(
        F.sort_array(F.collect_list(F.when((F.col("visible_count") > 0) & ~meta, F.col("field")))).alias("visible"),
        F.sort_array(F.collect_list(F.when(meta, F.col("field")))).alias("metadata"),
        F.count("*").alias("n_fields"),
    )


def twin_groups(pairs: DataFrame, counts: DataFrame, group: list[str]) -> DataFrame:
    """group, canonical, members: connected twin fields, by visible_count from high to low, then by name.

    pairs: group, field_a, field_b; counts: group, field, visible_count. Fields of a group are few: labels settle in a few rounds.
    """
    links = pairs.select(*group, F.col("field_a").alias("a"), F.col("field_b").alias("b"))
    links = links.unionByName(links.select(*group, F.col("b").alias("a"), F.col("a").alias("b")))
    # all members of a chain: fields reached, until nothing is added
    reach = links.groupBy(*group, "a").agg(F.array_sort(F.array_distinct(F.concat(F.collect_list("b"), F.array("a")))).alias("r"))
    before = -1
    while (size := reach.agg(F.sum(F.size("r"))).first()[0] or 0) != before:
        before = size
        step = reach.select(*group, "a", F.explode("r").alias("x")).join(reach.select(*group, F.col("a").alias("x"), "r"), [*group, "x"])
        reach = step.groupBy(*group, "a").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("r")))).alias("r"))
    sets = reach.select(*group, F.col("r").alias("set")).distinct()
    members = sets.select(*group, "set", F.explode("set").alias("field")).join(counts.select(*group, "field", "visible_count"), [*group, "field"], "left")
    order = F.array_sort(F.collect_list(F.struct((-F.coalesce("visible_count", F.lit(0))).alias("c"), "field")))
    named = members.groupBy(*group, "set").agg(F.transform(order, lambda e: e.field).alias("members"))
    return named.select(*group, F.get("members", F.lit(0)).alias("canonical"), "members")


def resolve_twins(long: DataFrame, twins: DataFrame, group: list[str], row: list[str], order: str) -> DataFrame:
    """long (group, row, order, field, value) with twin fields under their canonical name; the first value that is not empty stays."""
    names = twins.select(*group, "canonical", F.explode("members").alias("field"))
    named = long.join(names, [*group, "field"], "left").withColumn("field", F.coalesce("canonical", "field"))
    told = (F.col("value").isNull() | (F.trim("value") == "")).cast("int")
    return named.groupBy(*group, *row, "field").agg(F.min_by("value", F.struct(told, order)).alias("value"))


def listed_twins(twins: list[list[str]], visible: Column) -> Column:
    """The lists of twins of a domain of which all fields are visible (an array of fields)."""
    rows = F.array(*[F.array(*map(F.lit, t)) for t in twins])
    return F.filter(rows, lambda t: F.size(F.array_except(t, visible)) == 0)


def build(catalogue: DataFrame, domain: str) -> DataFrame:
    """domain, std, item_type, examples (in catalogue order), n: the index by standard and type; null ones are left out."""
    rows = catalogue.where("std is not null and item_type is not null")
    example = F.struct("cand_ord", "ens_code", "cand_name", "attrs")
    return rows.groupBy("std", "item_type").agg(F.array_sort(F.collect_list(example)).alias("examples"), F.count("*").alias("n")).withColumn("domain", F.lit(domain))


def write_index(index: DataFrame, path: str) -> None:
    """One folder for each domain."""
    index.write.mode("overwrite").partitionBy("domain").parquet(path)


def read_index(spark: SparkSession, path: str, domains: list[str] | None = None) -> DataFrame:
    """catalogue rows of all domains, or of those that are named."""
    index = spark.read.parquet(path)
    index = index.where(F.col("domain").isin(domains)) if domains else index
    return index.select("domain", "std", "item_type", F.inline("examples"))


def first_examples(catalogue: DataFrame, n: int) -> DataFrame:
    """The first n rows of each standard and type."""
    from pyspark.sql import Window

    w = Window.partitionBy("std", "item_type").orderBy("cand_ord")
    return catalogue.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def info(catalogue: DataFrame, top: int = 10) -> DataFrame:
    """std, n_types, n_examples of the standards with the most types, then rows."""
    per = catalogue.groupBy("std").agg(F.countDistinct("item_type").alias("n_types"), F.count("*").alias("n_examples"))
    return per.orderBy(F.col("n_types").desc(), F.col("n_examples").desc(), "std").limit(top)


def summary(catalogue: DataFrame) -> DataFrame:
    """pairs, examples, per_pair (whole number) of an index."""
    per = catalogue.groupBy("std", "item_type").count()
    return per.agg(F.count("*").alias("pairs"), F.sum("count").alias("examples"), F.floor(F.try_divide(F.sum("count"), F.count("*"))).alias("per_pair"))


def fill_bars(fill: DataFrame, width: int = 20) -> DataFrame:
    """fill (field, percent) with a bar of so many signs at 100 percent."""
    n = F.floor(F.col("percent") * width / 100).cast("int")
    return fill.withColumn("bar", F.concat(F.repeat(F.lit("█"), n), F.repeat(F.lit("░"), F.lit(width) - n)))


def samples(rows: DataFrame, order: str, most_columns: int = 20, longest: int = 50) -> DataFrame:
    """column, sample: the first value that is not null of each of the first columns, cut."""
    some = rows.columns[:most_columns]
    first = rows.agg(*[F.min_by(F.col(c).cast("string"), F.when(F.col(c).isNotNull(), F.col(order))).alias(f"v{i}") for i, c in enumerate(some)])
    each = F.array(*[F.struct(F.lit(c).alias("column"), F.substring(F.col(f"v{i}"), 1, longest).alias("sample")) for i, c in enumerate(some)])
    return first.select(F.inline(each))
