"""Replies of any shape, patterns of any kind, stored rows that occur twice."""

import time

import pytest
from pyspark.sql import functions as F

from itemforge.operators import patterns, replies, store
from itemforge.sources import config


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ('{"rules": {"30": 5}}', {"30": ["5"]}),
        ('[{"material": ["a"], "coatings": ["x"]}, {"material": "b", "coatings": "x, y"}]', {"b": ["x", "y"]}),
        ('{"m": null, "n": [1, null, {"a": 2}, "z"], "o": {"p": 1}, "": ["q"], "t": true}', {"m": [], "n": ["1", "z"], "o": [], "t": []}),
        ('{"rules": 7}', {}),
        ("[1, [2], null]", {}),
        ("no json", {}),
        (None, {}),
    ],
)
def test_coating_replies(text, want):
    assert replies.coating_reply(text) == want


@pytest.mark.parametrize(("params", "want"), [('["a", "b"]', ["a", "b"]), ("5", ["d"]), ('{"a": 1}', ["a"]), ('[["a"], "b", null, 3]', ["b", "3"]), ("null", ["d"]), ('""', ["d"])])
def test_mask_replies(params, want):
    got = replies.mask_reply('{"pattern": "^x (?P<d>[0-9]+)$", "params": ' + params + "}")
    assert got == {"pattern": "^x (?P<d>[0-9]+)$", "params": want, "required": want}


def test_any_value_is_no_crash():
    for text in ("{", "[}", '{"pattern": 5}', '{"pattern": "^("}', '{"pattern": "^$", "required": 3}', "```json\n[1]\n```", "{{{{", '"', "\\"):
        for read in (replies.reply_json, replies.mask_reply, replies.item_reply, replies.coating_reply):
            read(text)


def test_balanced_runs():
    found = lambda t: list(replies._balanced(t))
    assert found('x {"a": "}"} [1, {"b": 2}]') == ['{"a": "}"}', '[1, {"b": 2}]', '{"b": 2}']
    assert found("{ open {1}") == ["{1}"] and found('it\'s 5" long {"a": 1}') == ['{"a": 1}'] and found('{"a\\"}": 1}') == ['{"a\\"}": 1}']
    began = time.time()
    assert replies.reply_json("{" * 200_000) is None and replies.reply_json("{[" * 50_000 + '{"a": 1}') == {"a": 1}
    assert time.time() - began < 20


def test_groups_that_may_be_absent():
    assert patterns.groups(r"^(?P<a>x){0,1}(?P<b>y)(?:(?P<c>1)|(?P<d>2))(?P<e>z){2}$") == [("a", True), ("b", False), ("c", True), ("d", True), ("e", False)]
    assert patterns.groups("(?P<a>x)|(?P<b>y)") == [("a", True), ("b", True)] and patterns.groups("(?P<a>x|y)") == [("a", False)]
    assert patterns.merged_groups({"d": None, "d_2": "5", "d_10": "6", "x_10": "7"}) == {"d": "5", "x": "7"}
    assert "стандарт" not in patterns.repaired(r"^(?P<стандарт>a) (?P<стандарт>b) (?P<d>c) (?P<d>e)$")


def test_newest_of_stored_rows(spark):
    items = spark.createDataFrame([("a", None)], "name string, article string")
    rows = spark.createDataFrame([("a", None, f"c{i}", f"2024-01-0{i}") for i in (2, 9, 1)], "name string, article string, ens_code string, updated_at string")
    assert store.cached(items, rows, F.lit("2024-01-10").cast("timestamp"), 30).first().ens_code == "c9"
    legacy = spark.createDataFrame([("a", "p", "error", "2024-01-01"), ("a", "p", "completed", "2024-01-02")], "article string, prompt_id string, status string, updated_at string")
    assert store.served(legacy.select("article", "prompt_id").distinct(), legacy).first().served


def test_latin_names():
    assert config.latin_snake("Длина общая (мм), шт/уп.") == "dlina_obshchaya_mm_sht_up"
    assert config.latin_snake("Ёмкость хц й-1") == "yomkost_khc_j-1" and config.latin_snake("ГОСТ.2") == "gost_2"
