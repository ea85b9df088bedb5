"""Scalar functions on literals."""

import pytest
from pyspark.sql import functions as F

from itemforge.functions import coating, collections, numbers, text
from itemforge.operators import masks, routing, scoring

L = F.lit


def values(spark, *columns):
    row = spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first()
    return [x.asDict(recursive=True) if hasattr(x, "asDict") else x for x in row]


def test_standards(spark):
    names = ["Болт М12х50 ГОСТ 7798-70", "Болт (2)-12-44-Окс.Фос.ЭФП-ОСТ 1 31133-80", "Болт ГОСТ Р 52644-2006", "Болт DIN EN ISO 4014:2011", "Болт DIN 933", "Лист ТУ 14-1-5228", "Гайка РАМ.123.456", "Шайба 0,5-4-8-Кд-ОСТ 1 34505/34507-80,"]
    got = values(spark, *[text.standard(L(n)) for n in names])
    assert [g and (g["type"], g["number"], g["year"]) for g in got] == [("ГОСТ", "7798", "70"), ("ОСТ", "1 31133", "80"), ("ГОСТ", "52644", "2006"), ("ISO", "4014", "2011"), ("DIN", "933", None), ("ТУ", "14-1-5228", None), ("РАМ", "123.456", None), None]
    assert values(spark, text.standard(L(None).cast("string"))) == [None]


@pytest.mark.parametrize(("raw", "fixed", "legacy"), [("ОСТ1 34505-80", "ОСТ 1 34505-80", "ОСТ 1 34505-80"), ("ОСТ  1   31133-80", "ОСТ 1 31133-80", "ОСТ 1 31133-80"), ("ОСТ134505-80", "ОСТ 1 34505-80", "ОСТ 1 4505-80"), ("ГОСТ17475-80", "ГОСТ17475-80", "ГОСТ 1 475-80"), (None, "", "")])
def test_canonical(spark, raw, fixed, legacy):
    c = L(raw).cast("string")
    assert values(spark, text.canonical_standard(c), text.canonical_standard(c, legacy=True)) == [fixed, legacy]


def test_types_and_cleaning(spark):
    assert values(spark, *[text.item_type(L(x)) for x in ("Болт М6", "БОЛТ М6", "Болты М6", "Труба 20")]) == ["болт", "болт", None, None]
    assert values(spark, text.item_type(text.clean_input(L("Заклёпка 3х8"))), text.clean_input(L("Болт М12х50 ГОСТ 7798-70,"))) == ["заклепка", "Болт M12х50 ГОСТ 7798-70"]
    assert values(spark, text.field_name(L("Класс (поле) допуска")), text.field_name(L("Наружный диаметр (диаметр вписанного круга), сторона квадрата (стороны поперечного сечения)"))) == ["класс_допуска", "наружный_аметр_сторона_квадрат"]
    assert values(spark, text.parenthesised(L("Винт 4-5"), L("4")), text.strip_standard(L("Винт 4-5-ОСТ 1 3-80"), L("ОСТ 1 3-80")), text.strip_controls(L("a\x01b\n"))) == ["Винт (4)-5", "Винт 4-5", "ab\n"]


def test_similarity_and_visibility(spark):
    pairs = [("Кд", "Кд", 1.0), ("Окс.Фос.ЭФП", "Фос.Окс.ЭФП", 1.0), ("Кд9.хр", "Кд", 0.5), ("Н.Кд", "Кд", 0.5), ("Кд", "Ц9.фос.окс", 0.0), ("029", "02", 0.0), ("", "Кд", 0.0)]
    assert values(spark, *[text.token_similarity(L(a), L(b)) for a, b, _ in pairs]) == [p[2] for p in pairs]
    cases = [("9", "Болт (2)-9-36-Кд-ОСТ 1 31133-80", "диаметр", True), ("Кд3.фос.окс", "Болт-Кд.фос.окс-ОСТ 1 31133-80", "покрытие", True), ("36.0", "Болт 9-36-ОСТ 1 31133-80", "длина", True), ("80", "Болт 8-20-ОСТ 1 31133-80", "длина", False), ("Ст", "Болт Ст", "марка_материала", False)]
    assert values(spark, *[text.value_visible(L(v), L(n), L(k)) for v, n, k, _ in cases]) == [c[3] for c in cases]


def test_numbers(spark):
    assert values(spark, numbers.lenient_equal(L("1,25"), L("1.25")), numbers.lenient_equal(L("6g"), L("6g")), numbers.lenient_equal(L("6"), L("6g")), numbers.lenient_equal(L("6d"), L("6.0"))) == [True, True, False, False]
    cases = [("Ц", "Ц9.хр", "покрытие", True), ("2.5", "5", "", False), ("7", "7.0", "", True), ("6", "6g", "", False), ("12", "1.2", "", False), ("46", "4.6", "", False), ("Кд.фос.окс", "Кд.окс.фос", "", True)]
    assert values(spark, *[numbers.values_match(L(a), L(b), L(k)) for a, b, k, _ in cases]) == [c[3] for c in cases]
    m = lambda **kv: F.create_map(*[L(x) for p in kv.items() for x in p])
    got = values(spark, *[numbers.normalized(p, L(s)) for p, s in ((m(покрытие="029"), "x"), (m(покрытие="Ц6Х"), "x"), (m(покрытие="A2J"), "x"), (m(группа_прочности="8,8"), "x"), (m(свойства="46"), "ГОСТ 7795-70"), (m(свойства="46"), "ГОСТ 7798-70"), (m(исполнение="3"), "x"))])
    assert got == [{"покрытие": "02", "толщина_покрытия": "9"}, {"покрытие": "Ц", "толщина_покрытия": "6Х"}, {"покрытие": "A2J"}, {"группа_прочности": "8", "толщина_покрытия": "8"}, {"группа_прочности": "4.6"}, {"свойства": "46"}, {"исполнение": "3.0"}]


def test_coatings(spark):
    assert values(spark, *[coating.canonical(L(x).cast("string")) for x in (None, "", "-", "без покрытия", "Кд.хр", "НКд", "xyz", "Кд9.хр")]) == ["Бп", "Бп", "Бп", "Бп", "Кд", "Н.Кд", "xyz", "Кд"]
    assert values(spark, *[coating.normalize(L(x)) for x in ("Кд", "Кадмирование", "Анодирование", "Фос.Окс.ЭФП", "Кд3", "Кд3.хр", "xyz")]) == ["Кд", "Кд", "Ан", "Окс.Фос.ЭФП", "Кд", "Кд.Хр", None]
    assert values(spark, F.size(coating.variants(L("Кд"))), coating.substituted(L("14Х17Н2"), L("Кд")), coating.substituted(L("Д1П"), L("Кд")), coating.substituted(L("30ХГСА"), L("Кд")), coating.admitted(L("Д1П"), L("Кд"))) == [8, "Н.Кд", "Ан.Окс", None, False]


def test_field_value_ladder(spark):
    attrs = F.array(*[F.struct(L(k).alias("k"), L(v).cast("string").alias("v")) for k, v in (("Код", "1"), ("длина_резьбы", "2"), ("диа_метр", "3"), ("шаг", None), ("_шаг_резьбы", "9"))])
    assert values(spark, *[collections.field_value(attrs, L(k)) for k in ("код", "длина", "диаметр", "длина_резьбы_полная", "вес")]) == ["1", "2", "3", "2", None]


def test_scores(spark):
    bag = lambda **kv: collections.bag(**{k: L(v) for k, v in kv.items()})
    params = bag(исполнение="2", диаметр="12", длина="44", покрытие="Кд")
    keys = ["исполнение", "диаметр", "длина", "покрытие"]
    for value, length, score, exact in (("Кд", "44", 1.004, 4), ("Кд9.хр", "44", 0.804, 3), ("Ц9.фос.окс", "44", 0.802, 3), ("Кд", "46", 0.804, 3)):
        row = spark.range(1).select(params.alias("params"), bag(исполнение="2", диаметр="12", длина=length, покрытие=value).alias("attrs"), text.name_forms(L("Болт (2)-12")).alias("forms"))
        row = scoring.text_scores(row.withColumn("p", scoring.flat_params(keys)).withColumn("c", scoring.flat_attrs(keys)).withColumn("full", scoring.weight_sums(keys)[0]).withColumns({"wanted": scoring.number_keys("p", keys), "held": scoring.number_keys("c", keys), "low": scoring.name_keys("p", keys)}), keys)
        got = scoring.score_pairs(row, 3).first()
        assert (round(got.score, 6), got.exact_count) == (score, exact)


def test_routes_and_masks(spark):
    names = {"болт": "hardware", "БОЛТ": "hardware", "шайба": "hardware", "шайбы": "hardware_washer", "труба": "rolledMetal", "уголок стальной": "rolledMetal", "ст.сорт.нерж.12х18н10т": "rolledMetal", "ст.констр.калибр.20": "rolledMetal", "нечто": "hardware"}
    assert values(spark, *[routing.route(L(n), routing.PROMPTS) for n in names]) == list(names.values())
    assert masks.translate_pattern(r"(?P<a>\d)(x|y)(?P<b>\w)") == (r"(\d)(?:x|y)(\w)", ["a", "b"])
    m = masks.seed_masks(spark)
    assert masks.save(m, m.limit(1)).count() == m.count()


def test_check_status(spark):
    m = lambda **kv: F.create_map(*[L(x) for p in kv.items() for x in p]).cast("map<string,string>")
    cases = [({}, {}, "both_empty"), ({"д": "44"}, {"д": "44.0"}, "full_match"), ({"д": "44"}, {"д": "44", "п": "Кд"}, "missing_in_input"), ({"д": "44", "ш": "1"}, {"д": "44"}, "missing_in_catalogue"), ({"д": "44"}, {"д": "46"}, "mismatch"), ({"д": "44", "ш": "1"}, {"д": "44", "п": "Кд"}, "mismatch")]
    assert values(spark, *[scoring.check_status(m(**a), m(**b)) for a, b, _ in cases]) == [c[2] for c in cases]
