"""Numbers that live as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from itemforge.functions.collections import let

NUMBER = r"^[+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)$"
TENTH_STANDARDS = ["7795-70", "7796-70", "7805-70", "7808-70"]
#: Prefixes that a standard's number is freed from, in this order, wherever they stand.
PREFIXES = ["ГОСТ", "GOST", "ОСТ", "OST", "DIN", "NAS", "MS", "AN", "ISO"]
#: Parameters whose decimal comma becomes a point.
DECIMAL_FIELDS = ["диаметр", "длина", "шаг", "шаг_резьбы", "толщина", "ширина", "высота", "группа_прочности", "диаметр_внутр", "диаметр_наружн"]


def number(text: Column) -> Column:
    """Double of text with a decimal comma or point; null otherwise (Spark alone would read '6d' as 6)."""
    plain = F.translate(F.trim(text), ",", ".")
    return F.when(plain.rlike(NUMBER), plain.try_cast("double"))


def rounded(value: Column, digits: int) -> Column:
    """The decimal with so many digits that is nearest to the double's exact value; of two the even one. 2.675 is below its decimal and gives 2.67.

    Twice the scaled value is an odd whole number exactly at a tie; the error of that product, from
    halves of 26 bits, tells on which side of the tie the double lies.
    """
    scale = float(2 * 10**digits)
    split = lambda c: let(c * 134217729.0, lambda t: t - (t - c))
    high = scale * 134217729.0 - (scale * 134217729.0 - scale)

    def near(p: Column) -> Column:
        error = let(split(value), lambda h: ((h * high - p) + h * (scale - high) + (value - h) * high) + (value - h) * (scale - high))
        below, tie = (p - 1) / 2, (p == F.rint(p)) & (F.abs(p % 2) == 1)
        even = F.when(F.abs(below % 2) == 0, below).otherwise(below + 1)
        return F.when(tie, F.when(error > 0, below + 1).when(error < 0, below).otherwise(even)).otherwise(F.rint(p / 2))

    return F.when(F.abs(value) * scale < float(1 << 52), let(value * scale, near) / (scale / 2)).otherwise(value)


def lenient_equal(a: Column, b: Column) -> Column:
    """Equal as numbers, or as trimmed texts where one of them is no number."""
    return F.coalesce(number(a) == number(b), F.trim(a) == F.trim(b))


def first_number(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, r"[0-9]+[.]?[0-9]*", 0), F.lit(""))


def coerced(text: Column) -> Column:
    """struct<kind, value>: bool for yes and no words (also '1', '0', ''), int, float, else text."""
    low = F.lower(F.trim(text))
    plain = F.translate(F.trim(text), ",", ".")
    kind = (
        F.when(low.isin("да", "yes", "true", "1", "нет", "no", "false", "0", ""), "bool")
        .when(plain.rlike(r"^[+-]?[0-9]+$"), "int")
        .when(plain.rlike(NUMBER), "float")
        .otherwise("text")
    )
    value = F.when(kind == "bool", low.isin("да", "yes", "true", "1").cast("string")).when(kind.isin("int", "float"), plain).otherwise(text)
    return F.struct(kind.alias("kind"), value.alias("value"))


def clean_standard_number(std: Column) -> Column:
    out = F.upper(F.coalesce(std, F.lit("")))
    for p in PREFIXES:
        out = F.replace(out, F.lit(p), F.lit(""))
    return F.replace(F.trim(out), F.lit(" "), F.lit(""))


def one_decimal(text: Column) -> Column:
    return F.format_string("%.1f", number(text))


def normalized(params: Column, std: Column) -> Column:
    """A parameter map in catalogue form.

    In this order: decimal commas; strength 'a.b' gives the group a and, if there is none, the
    coating thickness b; coating of three digits or of Cyrillic letters and digits gives coating and
    thickness; properties are a tenth of the strength for four standards; execution has one decimal.
    """
    points = F.transform_values(params, lambda k, v: F.when(k.isin(DECIMAL_FIELDS), F.translate(v, ",", ".")).otherwise(v))

    def put(m: Column, when: Column, drop: list[str], **new: Column) -> Column:
        kept = F.map_filter(m, lambda k, v: ~k.isin([*new, *drop]))
        return F.when(F.coalesce(when, F.lit(False)), F.map_concat(kept, F.create_map(*[x for k, v in new.items() for x in (F.lit(k), v)]))).otherwise(m)

    get = lambda m, k: F.element_at(m, F.lit(k))

    def strength(m: Column) -> Column:
        v = get(m, "группа_прочности")
        a, b = F.regexp_extract(v, r"^(\d+)\.(\d+)$", 1), F.regexp_extract(v, r"^(\d+)\.(\d+)$", 2)
        return put(m, a != "", [], **{"группа_прочности": a, "толщина_покрытия": F.coalesce(get(m, "толщина_покрытия"), b)})

    def coating(m: Column) -> Column:
        v = get(m, "покрытие")
        both = lambda p: (F.regexp_extract(v, p, 1), F.regexp_extract(v, p, 2))
        a, b = both(r"^(\d\d)(\d)$")
        c, d = both(r"^([А-Яа-я]+)(\d+.*)$")
        m2 = put(m, a != "", [], **{"покрытие": a, "толщина_покрытия": b})
        return F.when(F.coalesce(a, F.lit("")) != "", m2).otherwise(put(m, c != "", [], **{"покрытие": c, "толщина_покрытия": d}))

    def properties(m: Column) -> Column:
        v = get(m, "свойства")
        tenth = F.format_string("%.1f", number(v) / 10)
        return put(m, v.rlike(r"^\d+$") & clean_standard_number(std).isin(TENTH_STANDARDS), ["свойства"], **{"группа_прочности": tenth})

    def execution(m: Column) -> Column:
        v = get(m, "исполнение")
        return put(m, number(v).isNotNull(), [], **{"исполнение": one_decimal(v)})

    return let(points, lambda m: let(strength(m), lambda m: let(coating(m), lambda m: let(properties(m), execution))))


def composite_equal(a: Column, b: Column) -> Column:
    """Equal, equal in the first dotted part, or one a prefix of the other."""
    x, y = F.trim(a), F.trim(b)
    head = lambda c: F.substring_index(c, ".", 1)
    prefix = F.startswith(x, y) | F.startswith(y, x)
    return (x == y) | ((head(x) == head(y)) & F.contains(x, F.lit(".")) & F.contains(y, F.lit("."))) | prefix


def values_match(a: Column, b: Column, param: Column) -> Column:
    """Equality of a parsed value and a catalogue value.

    Equal comparison texts; for coatings also one inside the other; where one contains the other
    only a remainder of zeros or equal numbers; equal numbers; two digits against 'd.d'; dotted
    tokens most of which agree; equal leading letters.
    """
    plain = lambda c: F.translate(F.translate(F.lower(F.trim(c)), " -_", ""), ",", ".")

    def test(x: Column, y: Column) -> Column:
        inside = F.contains(x, y) | F.contains(y, x)
        longer = F.when(F.length(y) > F.length(x), y).otherwise(x)
        shorter = F.when(F.length(y) > F.length(x), x).otherwise(y)
        at = F.instr(longer, shorter)
        rest = F.concat(F.substring(longer, F.lit(1), at - 1), F.substring(longer, at + F.length(shorter), F.length(longer)))
        near = (number(shorter) != 0) & (F.abs(number(longer) - number(shorter)) < F.abs(number(shorter)) * 0.001)
        two = lambda p, q: p.rlike(r"^\d\d$") & q.rlike(r"^\d\.\d+$") & (p == F.substring(q, F.lit(1), F.length(q) - 2))
        s, t = (F.array_distinct(F.split(c, r"\.")) for c in (x, y))
        common = F.size(F.array_intersect(s, t))
        tokens = (
            (common >= F.greatest(F.lit(1), F.size(F.array_union(s, t)) - 2))
            | ((F.size(F.array_except(s, t)) <= 1) & (common >= F.size(s) * 0.5))
            | ((F.size(F.array_except(t, s)) <= 1) & (common >= F.size(t) * 0.5))
        )
        head = lambda c: F.regexp_extract(c, "^([a-zA-Zа-яА-Я]+)", 1)
        letters = (head(x) != "") & (head(x) == head(y))
        return (
            F.when(x == y, True)
            .when(F.contains(param, F.lit("покрытие")) & inside, True)
            .when(inside, F.coalesce(rest.isin(".0", ".00") | near, F.lit(False)))
            .when(number(x).isNotNull() & number(y).isNotNull(), F.abs(number(x) - number(y)) < 0.001)
            .otherwise(two(x, y) | two(y, x) | tokens | letters)
        )

    return let(plain(a), lambda x: let(plain(b), lambda y: test(x, y)))
