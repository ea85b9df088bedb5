"""Reports: quality by item type and standard, statuses, indexes, fills."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

UNKNOWN = "(не определен)"


def quality(results: DataFrame) -> DataFrame:
    """Counts and percentages by (item_type, standard) with a total row; rows: item_type, std, has_code, has_params, has_ens_params."""
    keyed = results.select(F.coalesce("item_type", F.lit(UNKNOWN)).alias("item_type"), F.coalesce("std", F.lit(UNKNOWN)).alias("std"), "has_code", "has_params", "has_ens_params")
    return keyed.sparkSession.sql(
        """
        SELECT CASE WHEN grouping(item_type) = 1 THEN 'ИТОГО' ELSE item_type END AS item_type, CASE WHEN grouping(std) = 1 THEN '' ELSE std END AS std,
          count(*) AS total, count_if(has_code) AS code_found, count_if(has_params) AS params_parsed, count_if(has_ens_params) AS ens_params_parsed,
          count_if(has_code AND has_params) AS both_found, count_if(has_code) * 100.0D / count(*) AS code_percent, count_if(has_params) * 100.0D / count(*) AS params_percent
        FROM {rows} GROUP BY GROUPING SETS ((item_type, std), ())""",
        rows=keyed,
    )


def status_counts(rows: DataFrame, keys: list[str]) -> DataFrame:
    """kind, value, n: all rows, then by each key; a null key value is left out."""
    each = F.array(F.struct(F.lit("total").alias("kind"), F.lit("").alias("value")), *[F.struct(F.lit(k).alias("kind"), F.col(k).cast("string").alias("value")) for k in keys])
    return rows.select(F.inline(each)).where("value is not null").groupBy("kind", "value").agg(F.count("*").alias("n"))


def duplicates(rows: DataFrame, key: str) -> DataFrame:
    """Every row whose key occurs more than once."""
    many = rows.groupBy(key).count().where("count > 1").select(key)
    return rows.join(many, key, "left_semi")


def file_statistics(rows: DataFrame, key: str, name: str) -> DataFrame:
    return rows.agg(F.count("*").alias("n_rows"), F.countDistinct(key).alias("n_keys"), F.count_if(F.col(key).isNull()).alias("null_keys"), F.countDistinct(name).alias("n_names"))
