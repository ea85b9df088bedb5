"""Parsers that need no mask: fixed families of names, and tokens by position."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from itemforge.functions.collections import let
from itemforge.functions.numbers import number
from itemforge.functions.text import strip_standard

_COAT = r"([\p{L}\p{N}_.]+)"
_SIZES = ["исполнение", "диаметр", "длина", "покрытие", "стандарт"]
_RING = ["толщина", "диаметр_внутр", "диаметр_наружн", "покрытие", "стандарт"]
# Families of names in the order in which they are tried: (type, pattern, parameters, base confidence).
FAMILIES = [
    ("Болт", rf"болт\s*\((\d)\)-(\d+)-(\d+)-{_COAT}-(ост\s*1\s*31133-80)", _SIZES, 0.95),
    ("Винт", rf"винт\s*\((\d)\)-(\d+)-(\d+)-{_COAT}-(ост\s*1\s*31502-80)", _SIZES, 0.95),
    ("Винт", rf"винт\s*\((\d)\)-(\d+)-(\d+)-{_COAT}-(ост\s*1\s*31503-80)", _SIZES, 0.95),
    ("Шайба", rf"шайба\s+([\d,]+)-(\d+)-(\d+)-{_COAT}-(ост\s*1\s*34505-80)", _RING, 0.95),
    ("Шайба", rf"шайба\s+([\d,]+)-(\d+)-(\d+)-{_COAT}-(ост\s*1\s*34507-80)", _RING, 0.95),
    ("Болт", r"болт\s+(\d)?m([\d,]+)(?:x([\d,]+))?-([\dgx]+)\.([\d,]+)\.(\d+)?\s*(гост\s*7795-70)", ["исполнение", "диаметр", "шаг", "допуск", "длина", "материал", "стандарт"], 0.90),
    ("Болт", r"болт\s+(\d)?m?([\d,]+)(?:x([\d,]+))?-?([\d,]+)\s*(гост\s*7798-70)", ["исполнение", "диаметр", "шаг", "длина", "стандарт"], 0.90),
    ("Гайка", r"гайка\s+([\p{L}\p{N}_.]+)", ["код"], 0.70),
]
# Parameters whose absence takes 0.1 of the confidence.
REQUIRED = {"Болт": ["диаметр", "длина"], "Винт": ["диаметр", "длина"], "Шайба": ["толщина", "диаметр_внутр"], "Гайка": []}
NUMERIC = ["исполнение", "диаметр", "длина", "шаг", "толщина", "диаметр_внутр", "диаметр_наружн", "материал"]
# Long names of coatings.
COATING_NAMES = {"Кд": "Кадмирование", "Окс": "Оксидирование", "Окс.Фос": "Оксидирование фосфатное", "Окс.Фос.ЭФП": "Оксидирование фосфатное с ЭФП", "Хим.Пас": "Химическое пассивирование", "БП": "Без покрытия"}
# Units of parameters.
UNITS = {"диаметр": "мм", "длина": "мм", "толщина": "мм", "шаг": "мм", "толщина_покрытия": "мкм"}
ACCEPTED, FAILED = 0.85, 0.5
TEXT_PARAMS = ["покрытие", "тип_шлица"]


def _numeric(v: Column) -> Column:
    """Text of a number with a point and, without one, without leading zeros."""
    plain = F.translate(v, ",", ".")
    return F.when(F.contains(plain, F.lit(".")), F.coalesce(number(v).cast("string"), v)).otherwise(F.coalesce(plain.try_cast("long").cast("string"), v))


def cascade(text: Column) -> Column:
    """struct<params: array<struct<k, v>>, confidence, level, status> of the first family that fits the beginning; params is null and the level failed without one."""
    names = F.create_map(*[F.lit(x) for kv in COATING_NAMES.items() for x in kv])

    def family(t: Column, kind: str, pattern: str, keys: list[str], base: float) -> Column:
        full = f"(?iu)^{pattern}"
        get = lambda k: F.nullif(F.regexp_extract(t, full, keys.index(k) + 1), F.lit(""))
        coat = get("покрытие") if "покрытие" in keys else F.lit(None).cast("string")
        cells = [("тип", F.lit(kind)), *[(k, _numeric(get(k))) for k in NUMERIC if k in keys], ("покрытие", F.coalesce(F.element_at(names, coat), coat, F.lit("БП")))]
        cells += [(k, F.trim(get(k))) for k in ("стандарт", "допуск", "код") if k in keys]
        params = F.filter(F.array(*[F.struct(F.lit(k).alias("k"), v.alias("v")) for k, v in cells]), lambda e: e.v.isNotNull())
        lost = sum((get(k).isNull().cast("int") for k in REQUIRED[kind]), F.lit(0))
        return F.when(t.rlike(full), F.struct(params.alias("params"), F.greatest(F.lit(0.3), F.lit(base) - lost * 0.1).alias("confidence"), coat.isNull().alias("implicit_coating")))

    def leveled(f: Column) -> Column:
        level = F.when(f.isNull(), "failed").otherwise("regex")
        sure = F.coalesce(f.confidence, F.lit(0.0))
        return F.struct(f.params.alias("params"), sure.alias("confidence"), level.alias("level"), (sure >= ACCEPTED).alias("accepted"), F.coalesce(f.implicit_coating, F.lit(False)).alias("implicit_coating"), F.when((level == "failed") | (sure < FAILED), "error").otherwise("completed").alias("status"))

    return let(F.trim(text), lambda t: let(F.coalesce(*[family(t, *f) for f in FAMILIES]), leveled))


def cascade_stats(parsed: DataFrame) -> DataFrame:
    """total, and how many of a cascade's rows (level) each way read, with percentages; without rows they are null."""
    ways = {"regex": F.col("level").like("regex%"), "llm": F.col("level").like("llm%"), "failed": F.col("level") == "failed"}
    share = lambda w: F.round(F.try_divide(F.count_if(w) * 100.0, F.count("*")), 2)
    return parsed.agg(F.count("*").alias("total"), *[F.count_if(w).alias(n) for n, w in ways.items()], *[share(w).alias(f"{n}_pct") for n, w in ways.items()])


def described(params: Column) -> Column:
    """array<struct<name, value, unit>> of a bag."""
    units = F.create_map(*[F.lit(x) for kv in UNITS.items() for x in kv])
    return F.transform(params, lambda e: F.struct(e.k.alias("name"), e.v.alias("value"), F.coalesce(F.element_at(units, F.lower(e.k)), F.lit("")).alias("unit")))


def by_position(text: Column, std: Column, kind: str, order: list[str], optional: set[str]) -> Column:
    """Bag of the parameters in order, taken from the tokens of the text without standard and item type.

    (n) is the execution; AxB are two tokens; numbers fill the numeric parameters in order, optional
    ones only as far as there are more numbers than required ones; other tokens fill the text ones.
    """
    numeric = [p for p in order if p not in TEXT_PARAMS]
    required, free = [p for p in numeric if p not in optional], [p for p in numeric if p in optional]
    is_number = lambda t: t.rlike(r"^\d+(?:[.,]\d+)?$")

    def fill(execution: Column, tokens: Column) -> Column:
        numbers = F.transform(F.filter(tokens, is_number), lambda t: F.translate(t, ",", "."))
        words = F.filter(tokens, lambda t: ~is_number(t) & (t != ""))

        def assign(n: Column) -> Column:
            budget = F.lit(len(free)) - (F.when(execution.isNotNull(), 1).otherwise(0) if "исполнение" in free else F.lit(0))
            left, at, cells, word = F.least(F.greatest(F.size(n) - len(required), F.lit(0)), budget), F.lit(0), [], 0
            for p in order:
                if p in TEXT_PARAMS:
                    cells.append((p, F.get(words, F.lit(word))))
                    word += 1
                    continue
                may = (left > 0) if p in free else F.lit(True)
                value = F.when(may, F.get(n, at))
                if p == "исполнение":
                    value, may = F.coalesce(execution, value if p in free else F.lit(None).cast("string")), execution.isNull() & may
                    may = may if p in free else F.lit(False)
                used = (may & (at < F.size(n))).cast("int")
                cells.append((p, value))
                at, left = at + used, left - (used if p in free else F.lit(0))
            return F.filter(F.array(*[F.struct(F.lit(p).alias("k"), v.alias("v")) for p, v in cells]), lambda e: e.v.isNotNull())

        return let(numbers, assign)

    def split(rest: Column) -> Column:
        execution = F.nullif(F.regexp_extract(rest, r"\((\d+)\)", 1), F.lit(""))
        bare = F.regexp_replace(rest, r"^(.*?)\(\d+\)", "$1")
        pairs = F.transform(F.split(bare, r"[-\s]+"), lambda t: F.when(t.rlike(r"^\d+(?:[.,]\d+)?[xXхХ×]\d+(?:[.,]\d+)?$"), F.split(t, "[xXхХ×]")).otherwise(F.array(F.trim(t, F.lit("()")))))
        return let(execution, lambda e: let(F.flatten(pairs), lambda t: fill(e, t)))

    rest = F.regexp_replace(strip_standard(text, std), rf"(?iu)^(.*?)(?<![\p{{L}}\p{{N}}_]){kind}(?![\p{{L}}\p{{N}}_])", "$1")
    return let(rest, split)


def ambiguous(params: Column) -> Column:
    """Whether two parameters of a bag have the same comparison text, so that a name can't tell them apart."""
    from itemforge.functions.text import comparison_text

    values = F.transform(params, lambda e: comparison_text(e.v))
    return F.size(values) != F.size(F.array_distinct(values))


def separators(rows: DataFrame, share: float = 0.8) -> DataFrame:
    """param, n, separator, dominant: the kind of character before each value in its name (rows: name, params)."""
    each = rows.select("name", F.inline("params"))
    at = F.instr("name", F.col("v"))
    before = F.substring("name", at - 1, F.lit(1))
    kind = F.when(before == "-", "dash").when(before.rlike(r"[\s ]"), "space").when(before == "(", "paren").when(before.rlike(r"[\p{L}]"), "letter").otherwise("other")
    counts = each.where(at > 1).groupBy(F.col("k").alias("param"), kind.alias("separator")).agg(F.count("*").alias("n"))
    total = counts.groupBy("param").agg(F.sum("n").alias("total"), F.max_by("separator", F.struct("n", "separator")).alias("separator"), F.max("n").alias("n"))
    return total.select("param", "separator", "n", (F.col("n") >= F.col("total") * share).alias("dominant"))
