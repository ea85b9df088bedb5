"""Parsers on literals."""

import pytest
from pyspark.sql import functions as F

from itemforge.operators import parsers

ORDER = ["исполнение", "диаметр", "длина", "покрытие"]


@pytest.mark.parametrize(
    ("text", "std", "kind", "order", "optional", "want"),
    [
        ("Винт (1)-6-14-Кд-ОСТ 1 31503-80", "ОСТ 1 31503-80", "винт", ORDER, {"исполнение"}, {"исполнение": "1", "диаметр": "6", "длина": "14", "покрытие": "Кд"}),
        ("Винт 1-6-14", "ОСТ 1 31503-80", "винт", ORDER, {"исполнение"}, {"исполнение": "1", "диаметр": "6", "длина": "14"}),
        ("Винт 5-10", "ОСТ 1 31503-80", "винт", ORDER, {"исполнение"}, {"диаметр": "5", "длина": "10"}),
        ("Болт 14x1.5-30", "ОСТ 1 31503-80", "болт", ["диаметр", "шаг", "длина"], {"шаг"}, {"диаметр": "14", "шаг": "1.5", "длина": "30"}),
        ("Винт 2,5-24", "ОСТ 1 31503-80", "винт", ["диаметр", "длина"], set(), {"диаметр": "2.5", "длина": "24"}),
    ],
)
def test_by_position(spark, text, std, kind, order, optional, want):
    bag = parsers.by_position(F.lit(text), F.lit(std), kind, order, optional)
    assert {e.k: e.v for e in spark.range(1).select(bag.alias("b")).first().b} == want


def test_cascade(spark):
    rows = spark.createDataFrame([("Болт (2)-12-44-Окс.Фос.ЭФП-ОСТ 1 31133-80",), ("Гайка 3401A",), ("Труба 20",), (None,)], "t string").select(parsers.cascade(F.col("t")).alias("c")).collect()
    first = {e.k: e.v for e in rows[0].c.params}
    assert first["покрытие"] == "Оксидирование фосфатное с ЭФП" and (first["исполнение"], first["диаметр"], first["длина"]) == ("2", "12", "44") and rows[0].c.confidence == 0.95
    assert {e.k: e.v for e in rows[1].c.params}["код"] == "3401A" and rows[1].c.confidence == 0.7 and not rows[1].c.accepted
    assert [r.c.level for r in rows] == ["regex", "regex", "failed", "failed"] and rows[2].c.status == "error"
