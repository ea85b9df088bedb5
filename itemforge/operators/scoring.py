"""Scores of a parameter bag against catalogue candidates, and the decision on the best.

What a comparison needs of parameters and attributes (numbers, token sets) is prepared before the
join of names and candidates, not in it. Everything is an expression over one row; only the choice of the best
candidate needs the rows of a name together, and the window keeps one row for each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from itemforge.functions.coating import canonical, variants
from itemforge.functions.collections import field_value, let
from itemforge.functions.numbers import lenient_equal, number, rounded
from itemforge.functions.text import jaccard, shown_in, shown_key, tokens

TEXT_FIELDS = ["покрытие", "материал", "марка_материала", "марка_стали"]
COATING, LENGTH = "покрытие", "длина"
SIMILAR, EXACT = 0.5, 0.99
SUCCESS = 0.7
ONLY_IN_CATALOGUE = ["шаг_резьбы", "исполнение"]


def asked(params: Column) -> Column:
    """Parameters that are not empty with what a comparison needs: number, whether text, tokens of each spelling. Once for each name."""

    def one(e: Column) -> Column:
        is_text = e.k.isin(TEXT_FIELDS)
        spellings = F.when(e.k == COATING, variants(e.v)).otherwise(F.array(e.v))
        return F.struct(e.k.alias("k"), e.v.alias("v"), shown_key(e.v).alias("low"), number(e.v).alias("number"), is_text.alias("is_text"), F.when(is_text, F.transform(spellings, tokens)).alias("spellings"))

    return F.transform(F.filter(params, lambda e: e.v.isNotNull() & (e.v != "")), one)


def offered(attrs: Column) -> Column:
    """Attributes with number and tokens. Once for each candidate."""
    return F.transform(attrs, lambda e: F.struct(e.k.alias("k"), F.struct(e.v.alias("v"), F.trim(e.v).alias("plain"), number(e.v).alias("number"), tokens(e.v).alias("tokens")).alias("v")))


def compare(params: Column, attrs: Column, forms: Column) -> Column:
    """array<struct<k, v, value, weight, gain, status>>; params as asked(), attrs as offered() and forms as text.name_forms() give them."""

    def one(e: Column) -> Column:
        weight = F.when(e.is_text, 2.0).otherwise(1.0)

        def scored(c: Column) -> Column:
            sim = F.coalesce(F.array_max(F.transform(e.spellings, lambda s: jaccard(s, c.tokens))), F.lit(0.0))
            same = F.coalesce(e.number == c.number, F.trim(e.v) == c.plain, F.lit(False))
            named = F.coalesce(shown_in(e.low, forms), F.lit(False))

            def result(x: Column) -> Column:
                status = F.when(e.is_text, F.when(x >= EXACT, "exact").when(x >= SIMILAR, "token_matched").otherwise("mismatched")).when(same, "exact").when(named, "exact (in name)").otherwise("mismatched")
                gain = F.when(e.is_text, F.when(x >= SIMILAR, weight * x).otherwise(0.0)).when(same, weight).when(named, weight * 0.5).otherwise(0.0)
                return F.struct(e.k.alias("k"), e.v.alias("v"), c.v.alias("value"), weight.alias("weight"), gain.alias("gain"), status.alias("status"))

            return let(F.when(e.is_text, sim).otherwise(0.0), result)

        return let(field_value(attrs, e.k), scored)

    return F.transform(params, one)


def _similarity(spellings: Column, value: Column, own: Column, held: Column) -> Column:
    """Of the nearest spelling; equal texts need no token sets."""
    near = F.coalesce(F.array_max(F.transform(spellings, lambda s: jaccard(s, held))), F.lit(0.0))
    return F.when((own == value) & (F.size(held) > 0), 1.0).otherwise(near)


def flat_params(keys: list[str]) -> Column:
    """struct of each key's value, number and spellings in the column params; fields p0, p1, ... by place in keys."""

    def one(k: str) -> Column:
        return let(F.get(F.filter("params", lambda e: (e.k == k) & (e.v != "")), 0).v, lambda v: F.struct(v.alias("v"), shown_key(v).alias("low"), number(v).alias("number"), (F.transform(variants(v) if k == COATING else F.array(v), tokens) if k in TEXT_FIELDS else F.lit(None).cast("array<array<string>>")).alias("spellings")))

    return F.struct(*[one(k).alias(f"p{i}") for i, k in enumerate(keys)])


def flat_attrs(keys: list[str]) -> Column:
    """struct of what the candidate's column attrs has for each key."""
    one = lambda k: let(field_value(F.col("attrs"), F.lit(k)), lambda v: F.struct(v.alias("v"), F.trim(v).alias("plain"), number(v).alias("number"), tokens(v).alias("tokens")))
    return F.struct(*[one(k).alias(f"p{i}") for i, k in enumerate(keys)])


def _text_columns(keys: list[str]) -> dict[str, Column]:
    """text_gain and text_exact of p (flat_params) and c (flat_attrs): what the text fields add."""
    gain, exact, bonus = F.lit(0.0), F.lit(0), F.lit(0.0)
    for i, k in enumerate(keys):
        p, c = F.col(f"p.p{i}"), F.col(f"c.p{i}")
        if k in TEXT_FIELDS:
            present, sim = p.v.isNotNull(), F.coalesce(_similarity(p.spellings, c.v, p.v, c.tokens), F.lit(0.0))
            gain = gain + F.when(present & (sim >= SIMILAR), sim * 2.0).otherwise(0.0)
            exact = exact + (present & (sim >= EXACT)).cast("int")
            if k == COATING:
                begins = F.coalesce(F.startswith(F.lower(F.trim(c.v)), F.lower(F.trim(p.v))), F.lit(False))
                bonus = F.when(present & (sim >= SIMILAR), 0.01).otherwise(0.0) + F.when(present & begins, 0.01).otherwise(0.0)
    return {"text_gain": gain + bonus, "text_exact": exact}


def _number_fields(struct: str, keys: list[str]) -> list[Column]:
    return [F.col(f"{struct}.p{i}") for i, k in enumerate(keys) if k not in TEXT_FIELDS]


def number_keys(struct: str, keys: list[str]) -> Column:
    """Of the number fields of a flat struct one text for values that are equal: as numbers, else as they stand; null where there is none."""
    return F.array(*[F.coalesce((p.number + 0.0).cast("string"), F.concat(F.lit("="), F.trim(p.v))) for p in _number_fields(struct, keys)]).cast("array<string>")


def name_keys(struct: str, keys: list[str]) -> Column:
    """Of the number fields of flat parameters the text that a name would hold."""
    return F.array(*[p.low for p in _number_fields(struct, keys)]).cast("array<string>")


def weight_sums(keys: list[str]) -> tuple[Column, Column]:
    """Of p (flat_params): the weights of all fields, and the most that its text fields can add."""
    total, of_text = F.lit(0.0), F.lit(0.0)
    for i, k in enumerate(keys):
        weight = F.when(F.col(f"p.p{i}.v").isNotNull(), 2.0 if k in TEXT_FIELDS else 1.0).otherwise(0.0)
        total = total + weight
        if k in TEXT_FIELDS:
            of_text = of_text + weight + (F.when(F.col(f"p.p{i}.v").isNotNull(), 0.02).otherwise(0.0) if k == COATING else 0.0)
    return total, of_text


def text_scores(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """pairs (p, c) with what their text fields add instead of them. For distinct texts of both sides, so a few rows."""
    return pairs.withColumns(_text_columns(keys)).drop("p", "c")


def text_key(struct: str, keys: list[str]) -> Column:
    """Hash of the text fields of a flat struct."""
    return F.xxhash64(*[F.col(f"{struct}.p{i}.v") for i, k in enumerate(keys) if k in TEXT_FIELDS], F.lit(0))


def number_fits(fields: int) -> Column:
    """array<tinyint>: for each number field of a pair (wanted, held: number_keys of both sides; low: name_keys; forms: text.name_forms) 2 if the values are equal, 1 if the name has it, else 0."""

    def one(i: Column) -> Column:
        own = F.get("wanted", i)
        same = F.coalesce(own == F.get("held", i), F.lit(False))
        named = F.coalesce(shown_in(F.get("low", i), F.col("forms")), F.lit(False))
        return F.when(own.isNull(), 0).when(same, 2).when(named, 1).otherwise(0).cast("tinyint")

    return F.array(*[one(F.lit(i)) for i in range(fields)]).cast("array<tinyint>")


def score_fits(pairs: DataFrame, fields: int) -> DataFrame:
    """pairs (fits: number_fits; text_gain, text_exact, full: sum of weights) with score and exact_count."""
    gain, exact = F.col("text_gain"), F.col("text_exact")
    for i in range(fields):
        fit = F.get("fits", F.lit(i))
        gain, exact = gain + fit / 2.0, exact + (fit == 2).cast("int")
    return pairs.withColumns({"score": F.coalesce(F.try_divide(gain, F.col("full")), F.lit(0.0)), "exact_count": exact})


def score_pairs(pairs: DataFrame, fields: int) -> DataFrame:
    """pairs with what number_fits and score_fits read, with score and exact_count.

    The loop over pairs compares short texts only; the comparison of each parameter in detail is made for the pairs that win.
    """
    return score_fits(pairs.withColumn("fits", number_fits(fields)), fields).drop("fits")


def best(scored: DataFrame, key: str = "name", n: int = 1, shown: bool = True) -> DataFrame:
    """The n best candidates of each name with a score over 0: by score (in a list of several as it is shown, with three digits), number of exact parameters, order in the catalogue."""
    order = rounded(F.col("score"), 3) if shown and n > 1 else F.col("score")
    w = Window.partitionBy(key).orderBy(order.desc(), F.col("exact_count").desc(), F.col("cand_ord"))
    # the score is tested behind the window: in front of it, it would be computed twice
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n).where("score > 0")


def length_tolerated(a: Column, b: Column) -> Column:
    """Lengths that differ by less than 20 and less than a tenth of the catalogue's, b."""
    x, y = number(a), number(b)
    near = (F.abs(x - y) < 20) & (F.try_divide(F.abs(x - y), F.abs(y)) < 0.10)
    return F.coalesce(F.when(y == 0, x == 0).otherwise(near), F.lit(False))


def decide(winners: DataFrame, least: float = SUCCESS) -> DataFrame:
    """winners (match_type, score, params, attrs, detail, substituted) with confidence and success; least: the confidence of a success. TF-IDF only proposes."""
    exact = F.col("match_type").isin("exact_name", "exact", "exact_substitution")
    shown = F.least(rounded(F.col("score"), 3), F.lit(1.0))
    raw = F.when(exact, 1.0).when(F.col("match_type") == "fuzzy_coating_variant", shown * 0.95).otherwise(shown)
    has = lambda k: F.exists("params", lambda e: (e.k == k) & (e.v != ""))
    missing = F.lit(False)
    for k in ONLY_IN_CATALOGUE:
        missing = missing | (~has(k) & field_value(F.col("attrs"), F.lit(k)).isNotNull())
    wrong = F.exists("detail", lambda e: (e.status == "mismatched") & (e.k != COATING) & ~((e.k == LENGTH) & length_tolerated(e.v, e.value)))
    other = F.exists("detail", lambda e: (e.status == "exact (in name)") & (e.k != COATING) & ~((e.k == LENGTH) & length_tolerated(e.v, e.value)))
    no_params = (F.col("match_type") == "exact_name") & (F.coalesce(F.size("params"), F.lit(0)) == 0)
    good = (raw >= least) & ~no_params & ~missing & ((F.col("match_type") == "exact") | (~wrong & ~other)) & (F.col("match_type") != "tfidf")
    sure = F.when(F.col("match_type").isNull(), 0.0).when(F.col("substituted"), F.greatest(raw, F.lit(least))).otherwise(raw)
    out = winners.withColumn("confidence", rounded(sure, 3))
    return out.withColumn("success", F.when(F.col("match_type").isNull(), False).when(F.col("substituted"), True).otherwise(F.coalesce(good, F.lit(False))))


# Fields of a catalogue row that are no parameters.
TECHNICAL = [
    "код", "mdm_key", "id", "_meta", "автор_последнего_изменения", "дата_последнего_изменения", "наименование", "полное_наименование",
    "стандарт", "тип_изделия", "нтд", "нтд_1", "нтд_2", "статус",
]


def catalogue_params(params: Column, attrs: Column, parsed: Column | None = None) -> Column:
    """Parameters of a candidate: the values of the keys that were asked for, its other fields that are not technical, and for what is missing or blank what its name says (parsed)."""
    held = F.filter(F.transform(params, lambda e: F.struct(e.k.alias("k"), field_value(attrs, e.k).alias("v"))), lambda e: F.trim(e.v) != "")
    more = lambda base, other: F.concat(base, F.filter(other, lambda e: (F.trim(e.v) != "") & ~F.exists(base, lambda b: b.k == e.k)))
    rest = F.filter(attrs, lambda e: ~F.startswith(e.k, F.lit("_")) & ~F.lower(e.k).isin(TECHNICAL) & ~F.exists(params, lambda p: p.k == e.k))
    own = let(held, lambda h: more(h, rest))
    return own if parsed is None else let(own, lambda o: more(o, F.coalesce(parsed, F.array().cast("array<struct<k: string, v: string>>"))))


def same_coating(a: Column, b: Column) -> Column:
    """Equal by catalogue code, or by the set of the code's parts between points."""
    parts = lambda c: F.array_sort(F.array_distinct(F.filter(F.transform(F.split(F.lower(c), r"\."), F.trim), lambda t: t != "")))
    return let(canonical(F.trim(a)), lambda x: let(canonical(F.trim(b)), lambda y: (x == y) | ((F.size(parts(x)) > 0) & (parts(x) == parts(y)))))


def exact_detail(params: Column, attrs: Column) -> Column:
    """What compare gives, for a name that is equal to the catalogue's: exact, mismatched or no_ens_value; coatings also by code."""

    def one(e: Column) -> Column:
        def told(c: Column) -> Column:
            same = lenient_equal(e.v, c) | ((e.k == COATING) & same_coating(e.v, c))
            status = F.when(c.isNull() | (F.trim(c) == ""), "no_ens_value").when(F.coalesce(same, F.lit(False)), "exact").otherwise("mismatched")
            return F.struct(e.k.alias("k"), e.v.alias("v"), c.alias("value"), F.lit(1.0).alias("weight"), F.when(status == "exact", 1.0).otherwise(0.0).alias("gain"), status.alias("status"))

        return let(field_value(attrs, e.k), told)

    return F.transform(F.filter(params, lambda e: e.v.isNotNull() & (e.v != "")), one)


def visible_match(pairs: DataFrame) -> DataFrame:
    """name, cand_ord, score of the best candidate by equal visible fields alone: pairs (name, cand_ord, params, attrs, visible: array of keys); the first of equal ones."""
    mine = F.filter("params", lambda e: F.array_contains("visible", e.k) & (e.v != ""))
    equal = F.size(F.filter(mine, lambda e: F.coalesce(lenient_equal(e.v, field_value(F.col("attrs"), e.k)), F.lit(False))))
    rows = pairs.select("name", "cand_ord", F.coalesce(F.try_divide(equal, F.size(mine)), F.lit(0.0)).alias("score"))
    return rows.where("score > 0").groupBy("name").agg(F.min_by(F.struct("cand_ord", "score"), F.struct(-F.col("score"), F.col("cand_ord"))).alias("b")).select("name", "b.*")


def check_status(left: Column, right: Column) -> Column:
    """Five statuses of two parameter maps: both_empty, full_match, missing_in_input, missing_in_catalogue, mismatch."""
    a, b = F.map_keys(left), F.map_keys(right)
    only_a, only_b = F.size(F.array_except(a, b)) > 0, F.size(F.array_except(b, a)) > 0
    differ = F.exists(F.array_intersect(a, b), lambda k: ~F.coalesce(lenient_equal(F.element_at(left, k), F.element_at(right, k)), F.lit(False)))
    return (
        F.when((F.size(a) == 0) & (F.size(b) == 0), "both_empty")
        .when(differ | (only_a & only_b), "mismatch")
        .when(only_b, "missing_in_input")
        .when(only_a, "missing_in_catalogue")
        .otherwise("full_match")
    )
