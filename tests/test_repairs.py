"""Replies, patterns, settings and headers: literals."""

import re

import pytest
from pyspark.sql import functions as F

from itemforge.operators import index, ladder, masks, maskstats, output, patterns, replies, scoring, store
from itemforge.sources import config, tables


def test_reply_json():
    fence = "```"
    assert replies.reply_json('{"a": 1}') == {"a": 1}
    assert replies.reply_json(f'Here:\n{fence}json\n{{"a": [1, 2]}}\n{fence}\nDone') == {"a": [1, 2]}
    assert replies.reply_json('I think {"a": "}{", "b": {"c": 2}} fits {"z": 1}') == {"a": "}{", "b": {"c": 2}}
    assert replies.reply_json("{'a': None}") == {"a": None}
    assert [replies.reply_json(x) for x in (None, "", "no { braces", "12")] == [None] * 4


def test_mask_reply():
    found = replies.mask_reply('{"pattern": "^болт (?P<диаметр>\\\\d+)(?P<покрытие>-кд)?$"}')
    assert found["params"] == ["диаметр", "покрытие"] and found["required"] == ["диаметр"]
    assert replies.mask_reply("pattern: '^a(?P<x>b)$'\nparams: [x]")["params"] == ["x"]
    assert replies.mask_reply('"pattern" = ^a(?P<x>b)$')["pattern"] == "^a(?P<x>b)$"
    assert replies.mask_reply('{"pattern": "^a("}') is replies.mask_reply('{"pattern": "abc"}') is replies.mask_reply("nothing") is None


def test_other_replies():
    assert replies.item_reply('[{"code": 5}]') == {"status": "completed", "code": 5}
    assert replies.item_reply('{"status": "ignored"}')["status"] == "ignored" and replies.item_reply("?")["status"] == "error"
    assert replies.coating_reply('[{"material": "Д16", "coatings": ["Ан.Окс"]}]') == {"Д16": ["Ан.Окс"]}
    assert replies.coating_reply('{"30": "Кд, Бп"}') == {"30": ["Кд", "Бп"]} and replies.coating_reply("-") == {}


def test_client_is_asked_once(spark):
    rows = spark.createDataFrame([("a", "болт 5"), ("b", "болт 5"), ("c", None)], "name string, prompt string")
    got = {r.name: r.reply for r in replies.completed(rows, lambda p: p.upper()).collect()}
    assert got == {"a": "БОЛТ 5", "b": "БОЛТ 5", "c": None}
    similar = spark.createDataFrame([("болт 1", f"e{i}", i / 10) for i in range(5)], "id string, example string, similarity double")
    said = replies.normalised(spark.createDataFrame([("болт 1",), ("x",)], "name string"), similar, lambda p: '{"n": "' + p.replace("\n", " ") + '"}' if "e4" in p else "no", "{name}:{examples}")
    assert {r.name: (r.params, r.confidence) for r in said.collect()} == {"болт 1": ('{"n": "болт 1:e4 e3 e2", "покрытие": "БП"}', 0.85), "x": (None, 0.0)}


def test_patterns():
    assert patterns.groups(r"^болт (?P<a>\d)?[m(](?P<b>\d+)(?:x(?P<c>[\d)]+))?(?P<d>-\(x\))$") == [("a", True), ("b", False), ("c", True), ("d", False)]
    assert patterns.numbered_groups("(?P<a>x)(?P<a>y)(?P<b>z)(?P<a>w)") == "(?P<a>x)(?P<a_2>y)(?P<b>z)(?P<a_3>w)"
    assert patterns.merged_groups({"a": None, "a_2": "5", "a_3": "6", "b": "1"}) == {"a": "5", "b": "1"}
    assert patterns.unescaped(r"\\d+\\.x") == r"\d+\.x"
    fixed = patterns.repaired(r"болт (?P<d>\\d+)(?P<d>x)? (?P<стандарт>ГОСТ)$")
    assert re.match(fixed, "болт 12 ГОСТ, цинк").groupdict() == {"d": "12", "d_2": None} and patterns.repaired("a(") is None
    assert patterns.longest_prefix(r"^болт (\d+)-z", "болт 12-q") == len(r"^болт (\d+)-")
    assert patterns.skipped(["Марка стали"], ["тип"]) == [*patterns.ALWAYS_SKIPPED, "марка_стали"]
    assert patterns.required(["a", "b"], ["b"]) == ["a"]


def test_pattern_columns(spark):
    one = spark.range(1)
    keys = F.array(*map(F.lit, ["длина_резьбы", "dlina", "диаметр_"]))
    got = one.select(*[patterns.expected_key(keys, F.lit(k)).alias(k) for k in ("длина", "диаметр", "шаг", "длинарезьбы")]).first()
    assert tuple(got) == ("длина_резьбы", "диаметр_", None, "длина_резьбы")
    d = one.select(patterns.diagnosis(F.lit("Болт (2)-5 ГОСТ 1"), r"^болт \((\d)\)-(\d)$", "болт", "ГОСТ 1").alias("d")).first().d
    assert tuple(d) == (False, True, True, True, True)
    rows = spark.createDataFrame([(1, [("a", "1"), ("b", "2")], [("a", "1,0"), ("c", "3")]), (2, None, [("a", "5")])], "example int, params array<struct<k: string, v: string>>, expected array<struct<k: string, v: string>>")
    table = {r.example: (r.a, r.b, r.c) for r in patterns.matrix(rows, ["a", "b", "c"], []).collect()}
    assert table == {1: ("=", "~", "∅"), 2: ("∅", None, None)}


def test_config(spark):
    s = config.settings("success_threshold: 0.8\nnot_known: 1", {"api_key": "k\n"})
    assert (s.success_threshold, s.api_key, s.workers) == (0.8, "k", 4)
    m = config.column_mapping("columns: {length: ['^длина', '('], size: диам}", {})
    assert config.mapped("Длина, мм", m) == "length" and config.mapped("Наружный диаметр", m) == "size" and config.mapped("x", m) is None
    assert config.mapping_for({"a": [1]}, {"c": {"a": [2]}}, "c") == {"a": [2]}
    assert config.generated_mapping(["Шаг резьбы", "Код", "Щит"], ["Код"], {}) == {"Шаг резьбы": "shag_rezby", "Щит": "shchit"}
    d = config.domain("index: {skip: 'a, b', meta: [c]}\nretain: [b]")
    assert config.technical_fields(d, ["z"]) == ["z", "a", "b", "c"] and config.is_numeric("Шаг резьбы, мм") and not config.is_numeric("Код")
    wide = spark.createDataFrame([("Болт М6", "5", "x"), ("", "6", "y")], "`Полное имя` string, `Длина, мм` string, `Длина, м` string")
    got = config.adapted(wide, m, "крепёж", "f.xlsx", {"Полное имя": "full_name"})
    assert [c for c in got.columns if not c.startswith("_")] == ["full_name", "length", "length_1"] and got.count() == 1 and got.first()._source_file == "f.xlsx"
    cat = spark.createDataFrame([(i, "болт и гайка") for i in range(12)], "o int, t string")
    assert config.category_of(cat, "o", {"прокат": ["лист"], "метиз": ["болт"]}).first().kind == "метиз"
    ref = config.coating_table(spark.createDataFrame([("1", "Кд", "x", "Ц.хр", "Кад"), ("2", None, "", "", "")], "n string, a string, b string, `по ГОСТ` string, e string")).collect()
    assert [tuple(r) for r in ref] == [("Кд", "Ц.хр", "Кад")]


def test_index_headers(spark, tmp_path):
    assert index.number_headers(["a", "b", "a", "a"]) == ["a", "b", "a_1", "a_2"]
    cat = spark.createDataFrame([("S", "болт", i, f"n{i}", i, [("k", str(i))]) for i in range(7)], "std string, item_type string, ens_code int, cand_name string, cand_ord int, attrs array<struct<k: string, v: string>>")
    index.write_index(index.build(cat, "a").unionByName(index.build(cat, "b")), str(tmp_path / "ix"))
    assert index.read_index(spark, str(tmp_path / "ix")).count() == 14 and index.read_index(spark, str(tmp_path / "ix"), ["b"]).count() == 7
    got = spark.range(1).select(index.listed_twins([["a", "b"], ["a", "z"]], F.array(F.lit("a"), F.lit("b"))).alias("t")).first().t
    assert got == [["a", "b"]]
    assert index.fill_bars(spark.createDataFrame([("f", 50.0)], "field string, percent double"), 4).first().bar == "██░░"


def test_store_checks(spark):
    with pytest.raises(ValueError, match="confirm"):
        store.clear(spark.range(1))
    rows = spark.createDataFrame([("a", '{"x": 1}'), ("b", "text"), ("c", None)], "name string, j string")
    assert [r.j for r in store.parsed_json(rows, ["j"]).orderBy("name").collect()] == ['{"x":1}', '"text"', None]
    legacy = spark.createDataFrame([("1", "p", "completed"), ("2", "p", "error")], "article string, prompt_id string, status string")
    items = spark.createDataFrame([("1", "p"), ("2", "p"), ("3", "p")], "article string, prompt_id string")
    assert {r.article: r.served for r in store.served(items, legacy).collect()} == {"1": True, "2": False, "3": False}
    assert store.delete(rows, rows.where("name = 'a'")).count() == 2 and store.result_of(rows, "b").count() == 1
    odd = spark.createDataFrame([(float("nan"), float("inf"), 1.5)], "a double, b double, c double")
    assert tuple(output.finite(odd).first()) == (None, None, 1.5)
    keep = spark.range(1).select(F.map_keys(output.compared(F.create_map(F.lit("Код"), F.lit("1"), F.lit("длина"), F.lit("5")))).alias("k")).first().k
    assert keep == ["длина"]


def test_examples(spark):
    rows = spark.createDataFrame([("g", i, [("a", "1")] + ([("rare", "2")] if i == 9 else [("b", "3")] if i > 5 else [])) for i in range(12)], "grp string, ord int, params array<struct<k: string, v: string>>")
    got = [r.ord for r in maskstats.representative(rows, ["grp"], "ord", 3).orderBy("place").collect()]
    assert got == [9, 6, 0]
    stats = spark.createDataFrame([("g", "x", 9, 10), ("g", "y", 1, 10), ("g", "z", 0, 10)], "grp string, field string, visible_count int, total_count int")
    assert tuple(maskstats.kinds_of_fields(stats, ["grp"]).first())[1:] == (["x"], ["y"])


LADDER = [
    # code, name, std, type, attributes
    (1, "Болт (1)-6-30-Кд-ОСТ 1 31133-80", "ОСТ 1 31133-80", "болт", {"исполнение": "1", "диаметр": "6", "длина": "30", "покрытие": "Кд"}),
    (2, "Болт 31133 особый", "ОСТ 1 31133-80", "болт", {"исполнение": "2", "диаметр": "8", "длина": "40", "покрытие": "Кд"}),
    (3, "Болт из Д1П", "ОСТ 1 31133-80", "болт", {"исполнение": "3", "диаметр": "10", "длина": "55", "покрытие": "Ан.Окс", "марка_материала": "Д1П"}),
    (4, "Винт М5х20 ГОСТ 17475-80", "ГОСТ 17475-80", "винт", {"диаметр": "5", "длина": "21", "шаг_резьбы": "0,8"}),
]


def test_every_step_of_the_ladder(spark):
    bag = lambda d: [(k, v) for k, v in d.items()]
    cat = spark.createDataFrame([(c, n, s, t, bag(a), c) for c, n, s, t, a in LADDER], "ens_code int, cand_name string, std string, item_type string, attrs array<struct<k: string, v: string>>, cand_ord int")
    names = ["Болт (1)-6-30-Кд-ОСТ 1 31133-80", "Болт (2)-8-40-Кд-ОСТ 1 31133-80", "Болт (3)-10-55-Кд-ОСТ 1 31133-80", "Болт (2)-8-43-Кд-ОСТ 1 31133-80", "Винт М5х20 ГОСТ 17475-80", "Винт М5х21 ГОСТ 17475-80", "Гайка неясная", "Шайба 5-10-Кд-ОСТ 1 34505-80"]
    got = {r.name: r for r in ladder.match(spark.createDataFrame([(n,) for n in names], "name string"), masks.seed_masks(spark), cat).collect()}
    told = {n: (got[n].match_type, got[n].ens_code, got[n].success) for n in names}
    assert told[names[0]] == ("exact_name", 1, True)
    assert told[names[1]] == ("exact", 2, True) and got[names[1]].confidence == 1.0
    assert told[names[2]] == ("exact_substitution", 3, True) or told[names[2]] == ("exact", 3, True)
    assert (got[names[2]].original, got[names[2]].corrected, got[names[2]].material) == ("Кд", "Ан.Окс", "Д1П")
    assert told[names[3]] == ("fuzzy", 2, True)  # the length is tolerated
    assert told[names[4]] == ("exact_name", 4, False)  # the pitch is in the catalogue only; the length differs
    assert told[names[5]] == ("fuzzy", 4, False)
    assert told[names[6]] == (None, None, False) and got[names[6]].level == "llm_direct" and told[names[7]][0] == "tfidf" and got[names[7]].level == "tfidf" and not told[names[7]][2]
    assert {e.k: e.v for e in got[names[5]].ens_params} == {"диаметр": "5", "длина": "21", "шаг_резьбы": "0,8"}
    detail = cat.where("ens_code = 4").select(scoring.exact_detail(F.array(F.struct(F.lit("длина").alias("k"), F.lit("21,0").alias("v")), F.struct(F.lit("шаг").alias("k"), F.lit("1").alias("v")), F.struct(F.lit("вес").alias("k"), F.lit("1").alias("v"))), F.col("attrs")).alias("d")).first().d
    assert [(e.k, e.status) for e in detail] == [("длина", "exact"), ("шаг", "mismatched"), ("вес", "no_ens_value")]


def test_nearest_block(spark):
    cat = spark.createDataFrame([("ГОСТ 7798-70", "Болт", 2), ("ОСТ 1 31133-80", "болт", 1)], "std string, item_type string, cand_ord int")
    names = spark.createDataFrame([("a", "ГОСТ 7798", "болт"), ("b", "ОСТ 1 31133-80", "болт"), ("c", "ISO 1", "болт"), ("d", None, "болт")], "name string, std string, item_type string")
    got = {r.name: (r.block_std, r.block_type) for r in ladder.blocks(names, cat).collect()}
    assert got == {"a": ("ГОСТ 7798-70", "Болт"), "b": ("ОСТ 1 31133-80", "болт"), "c": (None, None), "d": (None, None)}


def test_visible_match(spark):
    pairs = spark.createDataFrame([("n", 1, [("a", "1"), ("b", "2")], [("a", "1")], ["a", "b"]), ("n", 2, [("a", "1"), ("b", "2")], [("a", "1,0"), ("b", "2")], ["a", "b"]), ("m", 1, [("a", "7")], [("a", "1")], ["a"])], "name string, cand_ord int, params array<struct<k: string, v: string>>, attrs array<struct<k: string, v: string>>, visible array<string>")
    assert [tuple(r) for r in scoring.visible_match(pairs).collect()] == [("n", 2, 1.0)]


def test_loaders(spark):
    rows = spark.createDataFrame([("1", " Болт ", "g"), ("", "x", "g")], "`артикул` string, `Краткое наименование` string, GUID string")
    assert [tuple(r) for r in tables.load_items(rows).collect()] == [("1", "Болт", "g")]
    assert tables.load_items(rows, clean=False).count() == 2 and tables.preview(rows, 1).count() == 1
    assert tables.report_name_column(["x", "Наименование"]) == "Наименование" and tables.report_name_column(["a", "Полное Name"]) == "Полное Name" and tables.report_name_column(["a"]) is None
