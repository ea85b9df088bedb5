"""Masks against examples, and the steps of a name, by literals."""

from pyspark.sql import functions as F

from itemforge.operators import patterns, validation

BAG = "array<struct<k: string, v: string>>"
PATTERN = r"^винт \((\d)\)-(\d+)-(\d+)(?:-([\p{L}.]+))?-ост 1 31502-80"
PARAMS, REQUIRED, STD = ["исполнение", "диаметр", "длина", "покрытие"], ["диаметр", "длина"], "ОСТ 1 31502-80"


def checked(spark, rows, **more):
    df = spark.createDataFrame([(i, t, list(a.items())) for i, (t, a) in enumerate(rows)], f"i int, text string, attrs {BAG}")
    got = validation.check(df, PATTERN, PARAMS, REQUIRED, STD, "винт", **more)
    return [(r.stage, r.success, {e.param: e.status for e in r.results}) for r in got.orderBy("i").collect()], got


def test_check(spark):
    full = {"исполнение": "1", "диаметр": "6", "длина": "14", "покрытие": "Кд"}
    rows = [
        ("Винт 1-6-14-Кд-ОСТ 1 31502-80", full),  # the execution gets its parentheses
        ("Винт (1)-6-15-Кд-ОСТ 1 31502-80", full),
        ("Винт (1)-6-14-ОСТ 1 31502-80", full),  # the catalogue has a coating
        ("Винт (1)-6-14-Кд-ОСТ 1 31502-80", {"диаметр": "6,0"}),  # what the catalogue lacks is no fault
        ("Винт 8-20-ОСТ 1 31502-80", {"диаметр": "8"}),  # by tokens
        ("", full),
        (None, full),
    ]
    got, df = checked(spark, rows)
    ok = dict.fromkeys(PARAMS, "ok")
    assert got[0] == ("pattern", True, ok)
    assert got[1] == ("pattern", False, ok | {"длина": "mismatch"})
    assert got[2] == ("pattern", False, ok | {"покрытие": "mismatch"})
    assert got[3] == ("pattern", True, ok)
    assert got[4][:2] == ("tokens", True) and got[4][2]["диаметр"] == got[4][2]["длина"] == "found"
    assert got[5] == got[6] == ("none", False, {"диаметр": "unread", "длина": "unread"})
    told = validation.summary(df).first()
    assert (told.total, told.matched, told.by_pattern, told.by_tokens, told.mismatched, told.missing) == (7, 3, 4, 1, 2, 0)
    assert validation.summary(df.limit(0)).first().score == 0.0
    assert checked(spark, rows[1:2], skip=["длина"])[0][0][1]


def test_missing_and_twins(spark):
    rows = [("Винт (1)-6-14-Кд-ОСТ 1 31502-80", {"диаметр": "6", "длина": "14", "вид": "Ц"})]
    assert checked(spark, rows)[0][0][1]
    assert checked(spark, rows, twins=[["покрытие", "вид"]])[0][0][2]["покрытие"] == "mismatch"


def test_expected_keys(spark):
    keys = lambda *k: F.array(*map(F.lit, k))
    find = lambda name, *k: patterns.expected_key(keys(*k), F.lit(name))
    row = spark.range(1).select(
        find("стандарт", "стандарт_изделия", "нтд").alias("a"),
        find("свойства", "группа_прочности", "x").alias("b"),
        find("длина", "_длина", "длина_общая", "длина_л").alias("c"),
        find("группа_прочности", "свойства", "группапрочности").alias("d"),
        find("вес", "масса").alias("e"),
    ).first()
    assert tuple(row) == ("нтд", "группа_прочности", "длина_л", "группапрочности", None)


def test_diagnosis(spark):
    masks = spark.createDataFrame([(1, r"^винт (\d+)-(\d+)$", ["диаметр", "длина"]), (2, "^(", ["x"])], "id long, pattern string, params array<string>")
    names = [("Винт 6-14", 1), ("Винт 6-14 хвост", 1), ("иное", 1), ("a", 2), ("b", None), (None, 1)]
    df = spark.createDataFrame([(n, "s", "t", m) for n, m in names], "name string, std string, item_type string, mask_id long")
    got = {}
    for r in validation.diagnosed(df, masks).collect():
        got.setdefault(r.name, []).append((r.stage, r.key, r.value))
    assert set(got["Винт 6-14"][-2:]) == {("match", "диаметр", "6"), ("match", "длина", "14")}
    assert got["Винт 6-14 хвост"][-2:] == [("prefix", "length", "9"), ("prefix", "rest", " хвост")]
    assert got["иное"][-2:] == [("prefix", "length", "0"), ("prefix", "rest", "иное")]
    assert got["a"][-1][:2] == ("mask", "error") and got["b"][-1] == ("mask", "id", None) and len(got[None]) == 3
    assert {(r.stage, r.key): r.n for r in validation.stages_of(validation.diagnosed(df, masks)).collect()}[("extract", "standard")] == 6
