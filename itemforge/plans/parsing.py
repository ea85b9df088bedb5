"""Queries of the parsers that need no mask, each with its DuckDB oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from itemforge.operators import ladder, parsers
from itemforge.plans.matching import SQL_PARSED, _distinct, _parsed


def cascade_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _distinct(spark, sf_dir).select("name", parsers.cascade(F.col("name")).alias("c"))
    return rows.select("name", "c.level", "c.confidence", "c.accepted", "c.status", F.array_join(F.transform("c.params", lambda e: F.concat(e.k, F.lit("="), e.v)), ";").alias("params"))


def token_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ladder.extract(_distinct(spark, sf_dir)).where("item_type = 'болт'")
    bag = parsers.by_position(F.col("clean"), F.col("std"), "болт", ["исполнение", "диаметр", "длина", "покрытие"], {"исполнение"})
    return names.select("name", F.inline(bag)).withColumnsRenamed({"k": "param", "v": "value"})


def described_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parsed(spark, sf_dir).select("name", F.inline(parsers.described(F.col("params")))).groupBy("unit").agg(F.count("*").alias("n"))


def separators(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parsers.separators(_parsed(spark, sf_dir).where("params is not null and item_type = 'болт'").select("name", "params")).where("param in ('исполнение', 'покрытие')")


def ambiguous_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _parsed(spark, sf_dir).where("params is not null")
    return rows.groupBy(parsers.ambiguous(F.col("params")).alias("ambiguous")).agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (cascade_parse, token_parse, described_params, separators, ambiguous_names)}
ORACLES = {
    "cascade_parse": SQL_PARSED
    + """ SELECT d.name, CASE WHEN kind = 0 OR d.name LIKE 'Гайка%' THEN 'regex' ELSE 'failed' END AS level, CASE WHEN kind = 0 THEN 0.95 WHEN d.name LIKE 'Гайка%' THEN 0.7 ELSE 0.0 END::double AS confidence,
      kind IS NOT DISTINCT FROM 0 AS accepted, CASE WHEN kind = 0 OR d.name LIKE 'Гайка%' THEN 'completed' ELSE 'error' END AS status,
      CASE WHEN kind = 0 THEN concat('тип=Болт;исполнение=', execution, ';диаметр=', size, ';длина=', length, ';покрытие=Кадмирование;стандарт=ОСТ 1 31133-80') WHEN d.name LIKE 'Гайка%' THEN concat('тип=Гайка;покрытие=БП;код=', regexp_extract(d.name, 'Гайка ([A-Za-z0-9_.]+)', 1)) END AS params FROM d LEFT JOIN p ON p.name = d.name""",
    "token_parse": SQL_PARSED + " SELECT name, 'исполнение' AS param, execution AS value FROM p WHERE kind = 0 UNION ALL SELECT name, 'диаметр', size FROM p WHERE kind = 0 UNION ALL SELECT name, 'длина', length FROM p WHERE kind = 0 UNION ALL SELECT name, 'покрытие', coating FROM p WHERE kind = 0",
    "described_params": SQL_PARSED + " SELECT 'мм' AS unit, 2 * count(*) AS n FROM p WHERE kind IS NOT NULL UNION ALL SELECT '', count_if(kind = 0) * 2 + count_if(kind = 2) FROM p",
    "separators": SQL_PARSED + " SELECT 'исполнение' AS param, 'paren' AS separator, count(*) AS n, true AS dominant FROM p WHERE kind = 0 UNION ALL SELECT 'покрытие', 'dash', count(*), true FROM p WHERE kind = 0",
    "ambiguous_names": SQL_PARSED + " SELECT size = length OR coalesce(execution = size OR execution = length, false) AS ambiguous, count(*) AS n FROM p WHERE kind IS NOT NULL GROUP BY 1",
}
