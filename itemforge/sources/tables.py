"""Inputs: Parquet tables, item lists in any column layout, and the item names synthesised from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from itemforge.functions.collections import bag

NAME_WORDS = ["краткое наименование", "наименование", "номенклатура", "наименов", "наим.", "name"]

#: Item names of the rows of lineitem and part; equal text in Spark and DuckDB.
NAMES = """
SELECT l_orderkey, l_linenumber, p_partkey, CASE l_linenumber % 4
  WHEN 0 THEN concat('Болт (', CAST(p_size % 3 + 1 AS string), ')-', CAST(p_size AS string), '-', CAST(CAST(l_quantity AS int) AS string), '-Кд-ОСТ 1 31133-80')
  WHEN 1 THEN concat('Винт М', CAST(p_size AS string), 'х', CAST(CAST(l_quantity AS int) AS string), ' ГОСТ 17475-80')
  WHEN 2 THEN concat('Шайба ', CAST(p_size AS string), '-', CAST(CAST(l_quantity AS int) AS string), '-Кд.фос-ОСТ1 34505-80,')
  ELSE concat('Гайка ', p_brand) END AS name
FROM {lineitem} JOIN {part} ON l_partkey = p_partkey"""

#: A catalogue of all parts, three kinds of items in turn.
CATALOGUE = """
SELECT p_partkey AS ens_code, p_size AS size, p_size % 3 + 1 AS execution, CAST(floor(p_retailprice) AS bigint) % 50 + 1 AS length, p_partkey % 3 AS kind, CASE p_partkey % 3
  WHEN 0 THEN concat('Болт (', CAST(p_size % 3 + 1 AS string), ')-', CAST(p_size AS string), '-', CAST(CAST(floor(p_retailprice) AS bigint) % 50 + 1 AS string), '-Кд-ОСТ 1 31133-80')
  WHEN 1 THEN concat('Винт М', CAST(p_size AS string), 'х', CAST(CAST(floor(p_retailprice) AS bigint) % 50 + 1 AS string), ' ГОСТ 17475-80')
  ELSE concat('Шайба ', CAST(p_size AS string), '-', CAST(CAST(floor(p_retailprice) AS bigint) % 50 + 1 AS string), '-Кд.фос-ОСТ 1 34505-80') END AS cand_name
FROM {part}"""

#: A catalogue of one standard with many fields: decimal commas, four coatings and three materials, fields that only the name holds.
WIDE_CATALOGUE = """
SELECT ens_code, size, step, length, coating, material, class, mass, packing, maker, brand, concat('Болт ', own_size, 'х', step, '-', own_length, '-', coating, '-ОСТ 1 31102-80') AS cand_name FROM (
  SELECT p_partkey AS ens_code, CAST(p_size AS string) AS own_size, CASE WHEN p_partkey % 11 > 0 THEN CAST(p_size AS string) END AS size,
    CAST(CAST(floor(p_retailprice) AS bigint) % 50 + 1 AS string) AS own_length, CASE WHEN p_partkey % 7 > 0 THEN CAST(CAST(floor(p_retailprice) AS bigint) % 50 + 1 AS string) END AS length,
    CASE p_size % 3 WHEN 0 THEN '1,5' WHEN 1 THEN '1,25' ELSE '2' END AS step,
    CASE p_partkey % 4 WHEN 0 THEN 'Ан.Окс' WHEN 1 THEN 'Кд' WHEN 2 THEN 'Н.Кд' ELSE 'Кд9.фос.окс' END AS coating,
    CASE p_partkey % 4 WHEN 0 THEN 'д1п' WHEN 2 THEN '12Х18Н10Т' ELSE '30ХГСА' END AS material,
    'B' AS class, CAST(p_size % 9 AS string) AS mass, p_type AS packing, p_name AS maker, p_brand AS brand
  FROM {part}) w"""

#: Names that ask for them: as they are, with another separator, with another coating, with a point and another length, without the step, of another standard.
WIDE_ASKED = """
  SELECT p_partkey AS ens_code, p_partkey % 6 AS kind, CAST(p_size AS string) AS size,
    CASE WHEN p_partkey % 6 = 4 THEN NULL WHEN p_partkey % 6 = 3 THEN CASE p_size % 3 WHEN 0 THEN '1.5' WHEN 1 THEN '1.25' ELSE '2' END ELSE CASE p_size % 3 WHEN 0 THEN '1,5' WHEN 1 THEN '1,25' ELSE '2' END END AS step,
    CAST(CAST(floor(p_retailprice) AS bigint) % 50 + CASE p_partkey % 6 WHEN 3 THEN 2 ELSE 1 END AS string) AS length,
    CASE WHEN p_partkey % 6 = 2 THEN 'Кд' ELSE CASE p_partkey % 4 WHEN 0 THEN 'Ан.Окс' WHEN 1 THEN 'Кд' WHEN 2 THEN 'Н.Кд' ELSE 'Кд9.фос.окс' END END AS coating
  FROM {part}"""
_WIDE_NAME = """concat('Болт ', size, CASE WHEN step IS NULL THEN '' ELSE concat('х', step) END, CASE kind WHEN 1 THEN 'х' ELSE '-' END, length, '-', coating, CASE kind WHEN 5 THEN '-ОСТ 1 39999-80' ELSE '-ОСТ 1 31102-80' END)"""
WIDE_NAMES = f"SELECT DISTINCT kind, size, step, length, coating, {_WIDE_NAME} AS name FROM ({WIDE_ASKED}) w"
#: The same with the catalogue row that each was made from.
WIDE_EXAMPLES = f"SELECT ens_code, kind, size, step, length, coating, {_WIDE_NAME} AS name FROM ({WIDE_ASKED}) w"
WIDE_MASK = ("ОСТ 1 31102-80", "болт", r"^болт (\d+)(?:[xх]([\d.,]+))?[-х](\d+)-([\p{L}\d.]+)-ост 1 31102-80", ["диаметр", "шаг_резьбы", "длина", "покрытие"], ["диаметр", "длина"])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def item_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(NAMES, lineitem=table(spark, sf_dir, "lineitem"), part=table(spark, sf_dir, "part"))


def catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """std, item_type, ens_code, cand_name, cand_ord, attrs."""
    rows = spark.sql(CATALOGUE, part=table(spark, sf_dir, "part"))
    kind = F.col("kind")
    return rows.select(
        F.when(kind == 0, "ОСТ 1 31133-80").when(kind == 1, "ГОСТ 17475-80").otherwise("ОСТ 1 34505-80").alias("std"),
        F.when(kind == 0, "болт").when(kind == 1, "винт").otherwise("шайба").alias("item_type"),
        "ens_code",
        "cand_name",
        F.col("ens_code").alias("cand_ord"),
        bag(**{"исполнение": F.when(kind == 0, F.col("execution")), "диаметр": F.col("size"), "длина": F.col("length"), "покрытие": F.when(kind == 0, "Кд").when(kind == 2, "Кд.фос")}).alias("attrs"),
    )


def wide_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As catalogue, with ten fields a row."""
    rows = spark.sql(WIDE_CATALOGUE, part=table(spark, sf_dir, "part"))
    names = {"диаметр": "size", "шаг_резьбы": "step", "длина": "length", "покрытие": "coating", "марка_материала": "material", "класс_точности": "class", "масса": "mass", "упаковка": "packing", "изготовитель": "maker", "товарный_знак": "brand"}
    return rows.select(F.lit("ОСТ 1 31102-80").alias("std"), F.lit("болт").alias("item_type"), "ens_code", "cand_name", F.col("ens_code").alias("cand_ord"), bag(**{k: F.col(c) for k, c in names.items()}).alias("attrs"))


def wide_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(WIDE_NAMES, part=table(spark, sf_dir, "part"))


def find_column(columns: list[str], words: list[str]) -> str | None:
    """The first column whose header holds one of the words."""
    return next((c for c in columns if any(w in c.lower() for w in words)), None)


def load_items(rows: DataFrame, clean: bool = True) -> DataFrame:
    """article, name, guid of a strict item list; cleaned: trimmed, rows without an article or a name left out."""
    need = ["артикул", "Краткое наименование", "GUID"]
    missing = [c for c in need if c not in rows.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    names = list(zip(need, ("article", "name", "guid"), strict=True))
    if not clean:
        return rows.select(*[F.col(f"`{c}`").cast("string").alias(n) for c, n in names])
    trimmed = rows.select(*[F.trim(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))).alias(n) for c, n in names])
    return trimmed.where("article <> '' and name <> ''")


def preview(rows: DataFrame, n: int = 10) -> DataFrame:
    return rows.limit(n)


def report_name_column(columns: list[str]) -> str | None:
    """The name column of a report: one of the usual headers, else the first that holds наимен or name."""
    usual = {"наименование", "name", "краткое наименование", "исходное наименование"}
    return next((c for c in columns if c.strip().lower() in usual), None) or find_column(columns, ["наимен", "name"])


def load_named(rows: DataFrame) -> DataFrame:
    """rows with text taken from the first column that looks like a name."""
    found = find_column(rows.columns, NAME_WORDS)
    if found is None:
        raise ValueError("no column of names")
    return rows.withColumn("text", F.col(f"`{found}`").cast("string"))
