"""Result columns, cascade statistics and saved masks, by literals."""

from pyspark.sql import functions as F

from itemforge.functions.collections import cells
from itemforge.operators import masks, output, parsers

BAG = "array<struct<k: string, v: string>>"


def test_cells(spark):
    bags = [[(f"k{i}", str(i)) for i in range(n)] for n in (0, 19, 20, 25)]
    got = [r.c for r in spark.createDataFrame([(i, b) for i, b in enumerate(bags)], f"i int, b {BAG}").orderBy("i").select(cells(F.col("b")).alias("c")).collect()]
    twenty = "\n".join(f"k{i}={i}" for i in range(20))
    assert got == ["", "\n".join(f"k{i}={i}" for i in range(19)), f"{twenty}\n... (20 всего)", f"{twenty}\n... (25 всего)"]


def test_checked(spark):
    cases = [
        ({}, {}, {}, ("∅ Пропущено", "Оба пустые — нет данных для сверки")),
        ({"a": "1,5", "b": "x-Y"}, {"a": "1.50", "b": "X y"}, {}, ("✓ Полное совпадение", "")),
        ({"a": "1"}, {"a": "1.0004", "код": "7", "_x": "1"}, None, ("✓ Полное совпадение", "")),
        ({"a": "1"}, {"a": ""}, {"a": "2"}, ("✗ Несовпадение параметров", "a: params=1, ens=2")),
        ({"a": "1"}, {"a": "1", "c": "3", "b": "2"}, {}, ("⚠ Не хватает параметров в проверяемом", "Отсутствуют: b=2; c=3")),
        ({"c": "1", "a": "2"}, {"c": "1"}, {}, ("⚠ Не хватает параметров в ЕНС", "Отсутствуют: a=2")),
        ({"a": "1"}, {"b": "2"}, {}, ("✗ Несовпадение параметров", "Уникальные в params: a; Уникальные в ЕНС: b")),
        ({"покрытие": "кд.хр"}, {"покрытие": "Кд"}, {}, ("✓ Полное совпадение", "")),
        ({"покрытие": "Окс.Фос"}, {"покрытие": "фос.окс"}, {}, ("✓ Полное совпадение", "")),
        ({"покрытие": "Кд"}, {"покрытие": "Ц"}, {}, ("✗ Несовпадение параметров", "покрытие: params=Кд, ens=Ц")),
        (None, {"a": "1"}, {}, ("⚠ Не хватает параметров в проверяемом", "Отсутствуют: a=1")),
    ]
    bag = lambda d: None if d is None else list(d.items())
    df = spark.createDataFrame([(i, *map(bag, c[:3])) for i, c in enumerate(cases)], f"i int, p {BAG}, h {BAG}, r {BAG}")
    got = [tuple(r.c) for r in df.orderBy("i").select(output.checked(F.col("p"), F.col("h"), F.col("r")).alias("c")).collect()]
    assert got == [c[3] for c in cases]


def test_cascade_stats(spark):
    rows = spark.createDataFrame([(x,) for x in ("regex", "regex_partial", "llm", "failed", "failed", "failed")], "level string")
    assert parsers.cascade_stats(rows).first().asDict() == {"total": 6, "regex": 2, "llm": 1, "failed": 3, "regex_pct": 33.33, "llm_pct": 16.67, "failed_pct": 50.0}
    assert parsers.cascade_stats(rows.limit(0)).first().regex_pct is None


def test_saved_masks(spark):
    schema = "id long, standard string, item_type string, pattern string, params array<string>, required array<string>, auto_score double, is_active boolean, created_at timestamp"
    from datetime import datetime

    row = lambda i, std, pattern, day: (i, std, "болт", pattern, ["d"], ["d"], 1.0, True, datetime(2024, 1, day))
    old = spark.createDataFrame([row(1, "ОСТ 1 5-80", "^a", 1), row(2, "ОСТ 1 5-80", "^b", 2), row(3, "ГОСТ 7-80", "^c", 1)], schema)
    new = spark.createDataFrame([row(9, "ОСТ1 5-80", "^d", 5), row(10, "ОСТ 1 5-80", "^e", 6), row(11, "ГОСТ 8-80", "^f", 1)], schema)
    told = lambda df: {(r.id, r.standard, r.pattern) for r in df.collect()}
    assert told(masks.save(old, new)) == {(1, "ОСТ 1 5-80", "^a"), (2, "ОСТ 1 5-80", "^b"), (3, "ГОСТ 7-80", "^c"), (9, "ОСТ 1 5-80", "^d"), (10, "ОСТ 1 5-80", "^e"), (11, "ГОСТ 8-80", "^f")}
    assert told(masks.save(old, new, replace_existing=True)) == {(1, "ОСТ 1 5-80", "^a"), (2, "ОСТ 1 5-80", "^e"), (3, "ГОСТ 7-80", "^c"), (11, "ГОСТ 8-80", "^f")}
    again = spark.createDataFrame([row(20, "ОСТ 1 5-80", "^a", 9)], schema)
    assert told(masks.save(old, again)) == {(20, "ОСТ 1 5-80", "^a"), (2, "ОСТ 1 5-80", "^b"), (3, "ГОСТ 7-80", "^c")}


def test_coatings_by_reference(spark):
    from itemforge.functions import coating

    reference = spark.createDataFrame([("Кд.хр", "Кадмирование", "Кд-осн"), ("Окс.Фос.ЭФП", None, None), ("Ц", "Цинкование", "Кадмирование"), ("", "пусто", None)], "ens string, gost string, ost string")
    cases = {"Кд.хр": "Кд.хр", " Кд.хр. ": "Кд.хр", "Кадмирование": "Кд.хр", "Кд-осн": "Кд.хр", "Фос.Окс.ЭФП": "Окс.Фос.ЭФП", "Кд3.хр": "Кд.хр", "КД9-ХР": "Кд.хр", "ц6": "Ц", "нет": None, "": None, None: None}
    rows = spark.createDataFrame([(c,) for c in [*cases, "Ц", "Ц"]], "coating string")
    got = coating.by_reference(rows, reference).collect()
    assert len(got) == len(cases) + 2 and {r.coating: r.ens_coating for r in got} == cases | {"Ц": "Ц"}


def test_implicit_types(spark):
    from itemforge.operators import routing

    rows = spark.createDataFrame([("Шайба 5", None), (None, "Болт М6"), (None, None), ("", "Труба 10")], "full_name string, name string")
    got = routing.implicit_types(rows, ["full_name", "name"]).collect()
    assert [(r.detected_kind, r.implicit_type) for r in got][2] == (None, None)
    assert got[1].implicit_type == "крепеж" and got[3].implicit_type == "прокат" and 0 < got[1].detection_confidence <= 1
