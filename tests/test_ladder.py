"""The ladder's rules by literals; the inverted indices against scoring every pair."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from itemforge.functions import coating, numbers, text
from itemforge.operators import ladder, masks, scoring, tfidf
from itemforge.operators.cut import cut, scope

BAG = "array<struct<k: string, v: string>>"
CATALOGUE = f"ens_code long, cand_name string, std string, item_type string, attrs {BAG}, cand_ord long"


def one(spark, *columns):
    return list(spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first())


def test_rounding_of_the_exact_value(spark):
    rng = random.Random(1)
    values = [2.675, 0.0625, 0.1875, 1.0005, 0.6995, 0.69949999, 2.5, -2.675, 0.0, 1e300, *[round(rng.random() * 3, 4) for _ in range(400)], *[rng.randrange(4000) / 2000 for _ in range(300)]]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for digits in (2, 3):
        assert [r[0] for r in df.select(numbers.rounded(F.col("v"), digits)).collect()] == [round(v, digits) for v in values]
    assert one(spark, numbers.rounded(F.lit(None).cast("double"), 3)) == [None]


@pytest.mark.parametrize(
    ("value", "name", "want"),
    [("1,5", "Болт М8х1,5-40", True), ("5", "Болт М8х1,5-40", False), ("1.5", "Болт М8х1,5-40", True), ("40", "Болт М8-40 ГОСТ 40-70", True), ("70", "Болт М8-40 ГОСТ 40-70", False), ("6g", "Болт М8-6g-40", True), ("6g", "Болт М8-16g", False), ("Хим.Пас", "Винт 8-40 хим.пас", True), ("Хим.Пас", "Винт 8-40.хим.пас", False), ("", "Болт", False), ("8", None, None), ("3", "Болт 3.3", False), ("A.2", "x-a.2/1", True), ("\\E8", "x \\E8 y", True)],
)
def test_value_in_a_name(spark, value, name, want):
    assert one(spark, text.shown_in(text.shown_key(F.lit(value)), text.name_forms(F.lit(name).cast("string")))) == [want]


def test_tolerance_is_a_part_of_the_catalogues_length(spark):
    tolerated = lambda a, b: scoring.length_tolerated(F.lit(a), F.lit(b).cast("string"))
    assert one(spark, tolerated("110,5", "100"), tolerated("109,5", "100"), tolerated("0", "0"), tolerated("1", "0"), tolerated("300", "320"), tolerated("x", "1"), tolerated("1", None)) == [False, True, True, False, False, False, False]


def test_rules_of_coatings_ignore_case(spark):
    rule = lambda m, c: coating.substituted(F.lit(m), F.lit(c))
    assert one(spark, rule("д1п", "Кд"), rule("12х18н10т", "Кд"), rule("Д1ПТ", "Кд"), rule("Д1П", "Ц")) == ["Ан.Окс", "Н.Кд", None, None]
    assert one(spark, coating.replaceable(F.lit("Кд.фос")), coating.replaceable(F.lit("Ц")), coating.replaceable(F.lit(None).cast("string"))) == [True, False, False]


def test_signature_counts_the_fields_asked_for(spark):
    wide = {"диаметр": "8", "длина": "40", "покрытие": "Кд", "исполнение": "1", **{f"поле{i}": str(i) for i in range(8)}}
    cat = spark.createDataFrame([(1, "x", "s", "t", list(wide.items()), 1), (2, "y", "s", "t", [(k, v) for k, v in wide.items() if k != "длина"], 0)], CATALOGUE)
    asked = [(k, wide[k]) for k in ("диаметр", "длина", "покрытие", "исполнение")]
    names = spark.createDataFrame([("a", "s", "t", asked), ("b", "s", "t", asked[:3])], f"name string, std string, item_type string, params {BAG}")
    assert [(r.name, r.ens_code) for r in ladder.signatures(names, cat).collect()] == [("a", 1)]


def brute_scores(params, rows):
    """[(score, exact_count, cand_ord)] of candidates (attrs, name, cand_ord), every pair scored."""
    import re

    def tokens(s):
        return {t for t in (re.sub("[0-9]", "", x) for x in re.findall("[a-zа-я0-9]+", s.lower())) if t}

    def alike(a, b):
        spelled = [a, "Кд6", "Кд9", "Кд6.фос", "Кд9.фос", "Кд6.фос.окс", "Кд9.фос.окс", "Кд.фос.окс"] if a.lower() == "кд" else [a]
        return max((len(tokens(s) & tokens(b)) / len(tokens(s) | tokens(b)) if tokens(s) and tokens(b) else 0.0) for s in spelled) if b else 0.0

    def num(s):
        try:
            return float(s.replace(",", "."))
        except (ValueError, AttributeError):
            return None

    out = []
    for attrs, name, at in rows:
        total = gain = 0.0
        exact = 0
        for k, v in params:
            held = attrs.get(k)
            if k == "покрытие":
                s = alike(v, held)
                total += 2
                gain += (2 * s if s >= 0.5 else 0) + (0.01 if s >= 0.5 else 0) + (0.01 if held and held.lower().startswith(v.lower()) else 0)
                exact += s >= 0.99
                continue
            total += 1
            if (num(v) is not None and num(v) == num(held)) or ((num(v) is None or num(held) is None) and held is not None and v.strip() == held.strip()):
                gain += 1
                exact += 1
            elif re.search(rf"(?<![0-9.]){re.escape(v.lower().replace(',', '.'))}(?![0-9.])", name.lower().replace(",", ".")):
                gain += 0.5
        out.append((gain / total, exact, at))
    return out


@pytest.mark.parametrize("n", [1, 5])
def test_index_against_all_pairs(spark, n):
    rng = random.Random(n)
    hot = lambda xs: xs[0] if rng.random() < 0.4 else rng.choice(xs)  # noqa: E731  a value that many share
    coats, sizes, steps, tols = ["Кд", "Ц.хр", "Кд9.хр", "Ан.Окс", "Кд6.фос.окс"], [str(i) for i in range(1, 9)], ["1,5", "1.50", "2", "0,75"], ["6g", "6h", "a"]
    rows = []
    for i in range(150):
        attrs = {"диаметр": hot(sizes), "шаг": hot(steps), "допуск": hot(tols), "длина": hot(sizes), "покрытие": hot(coats)}
        name = "-".join([f"М{attrs['диаметр']}х{attrs['шаг']}", attrs["допуск"], attrs["длина"], attrs["покрытие"]]) + " " + "".join(chr(97 + int(d)) for d in str(i))  # equal rows are one candidate
        rows.append(({k: v for k, v in attrs.items() if rng.random() < 0.8}, name, 1000 - i))
    cat = spark.createDataFrame([(at, name, "s", "t", list(attrs.items()), at) for attrs, name, at in rows], CATALOGUE)
    bags = {f"n{i}": [(k, v) for k, v in (("диаметр", hot([*sizes, "77"])), ("шаг", hot(steps)), ("допуск", hot(tols)), ("длина", hot([*sizes, "88"])), ("покрытие", hot([*coats, "Ник"]))) if rng.random() < 0.75] for i in range(120)}
    bags = {k: v for k, v in bags.items() if v}
    names = spark.createDataFrame([(k, "s", "t", v) for k, v in bags.items()], f"name string, std string, item_type string, params {BAG}")
    with scope(spark):
        index = ladder.Index(cat, ["диаметр", "шаг", "допуск", "длина", "покрытие"])
        got = {}
        for r in ladder.best_candidates(names, index, n).collect():
            got.setdefault(r.name, []).append((r["rank"], r.cand_ord, round(r.score, 9), r.exact_count))
        for name, params in bags.items():
            every = [x for x in brute_scores(params, rows) if x[0] > 0]
            order = (lambda x: (-x[0], -x[1], x[2])) if n == 1 else (lambda x: (-round(x[0], 3), -x[1], x[2]))
            # sums of the same gains in another order may differ in the last digit
            best = sorted(((round(s, 12), e, at) for s, e, at in every), key=order)[:n]
            assert [(at, s, e) for _, at, s, e in sorted(got.get(name, []))] == [(at, round(s, 9), e) for s, e, at in best], params


def test_nearest_texts_against_all_pairs(spark):
    rng = random.Random(5)
    words = ["болт", "винт", "гост", "м8", "м10", "кд", "ц", "шайба"]
    texts = list(dict.fromkeys(" ".join(rng.choice(words) for _ in range(rng.randint(1, 6))) + f" {rng.randint(1, 60)}" for _ in range(160)))
    asked = ["болт м8 кд 12", "нечто", "", "гост", "болт винт гост м8 м10 кд ц шайба 60", "q"]
    grams = lambda s: [s.lower()[i : i + n] for n in (2, 3, 4) for i in range(len(s) - n + 1)]
    vocabulary = sorted({g for t in texts for g in grams(t)})
    at = {g: i for i, g in enumerate(vocabulary)}
    count = lambda t: np.bincount([at[g] for g in grams(t) if g in at], minlength=len(at)).astype(float)
    m = np.array([count(t) for t in texts])
    idf = np.log((1 + len(texts)) / (1 + (m > 0).sum(axis=0))) + 1
    unit = lambda x: x / (np.linalg.norm(x) or 1)
    vectors = np.array([unit(x * idf) for x in m])
    with scope(spark):
        got = {}
        corpus = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
        for r in tfidf.neighbours(spark.createDataFrame([(q, q) for q in asked], "id string, text string"), corpus, 4).collect():
            got.setdefault(r.id, []).append((r["rank"], r.other, round(r.similarity, 6)))
        for q in asked:
            s = vectors @ unit(count(q) * idf)
            best = [(i, s[i]) for i in sorted(range(len(texts)), key=lambda i: (-round(s[i], 9), i))[:4] if s[i] > 0.1]
            assert sorted(got.get(q, [])) == [(r + 1, i, round(v, 6)) for r, (i, v) in enumerate(best)]


def test_what_the_mask_reads_in_the_catalogues_name(spark):
    cat = spark.createDataFrame([(1, "Болт (1)-6-30-Кд-ОСТ 1 31133-80", "ОСТ 1 31133-80", "болт", [("диаметр", "6"), ("длина", ""), ("марка", "Ст3"), ("статус", "да")], 1)], CATALOGUE)
    got = ladder.match(spark.createDataFrame([("Болт (1)-6-31-Кд-ОСТ 1 31133-80",)], "name string"), masks.seed_masks(spark), cat).first()
    assert {e.k: e.v for e in got.ens_params} == {"диаметр": "6", "марка": "Ст3", "исполнение": "1", "длина": "30", "покрытие": "Кд"}
    assert {e.k: e.v for e in got.ens_params_mask} == {"исполнение": "1", "диаметр": "6", "длина": "30", "покрытие": "Кд"}


def test_tables_go_with_their_scope(spark):
    with scope(spark):
        table = cut(spark.range(3), "kept")
        with scope(spark):
            inner = cut(table, "gone")
            assert inner.count() == 3
        assert table.count() == 3
        with pytest.raises(Exception, match="FAILED_READ_FILE|does not exist|PATH_NOT_FOUND"):
            inner.count()


def test_threshold_is_a_parameter(spark):
    row = spark.createDataFrame([(0.6996,), (0.6994,)], "score double").select("*", F.lit("fuzzy").alias("match_type"), *[F.array().cast(BAG).alias(c) for c in ("params", "attrs")], F.array().cast("array<struct<k: string, v: string, value: string, status: string>>").alias("detail"), F.lit(False).alias("substituted"))
    assert [r.success for r in scoring.decide(row).orderBy("score").collect()] == [False, True]
    assert [r.success for r in scoring.decide(row, 0.6).collect()] == [True, True]
    assert list(itertools.chain(*[[r.confidence] for r in scoring.decide(row).orderBy("score").collect()])) == [0.699, 0.7]
