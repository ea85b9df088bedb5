"""Routing of texts by keywords."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Keywords by prompt, prompts in order.
PROMPTS = {
    "hardware": ["болт", "гайка", "шуруп", "винт", "заклепка", "шпилька", "гвоздь", "штифт", "хомут", "анкер", "саморез", "шайба"],
    "hardware_washer": ["шайбы"],
    "rolledMetal": ["труба", "швеллер", "уголок", "балка", "профиль", "лист", "плита", "рулон", "круг", "квадрат", "шестигранник", "лента", "полоса", "пруток", "прутки", r"regex:^ст\.сорт\.нерж\.|ст\.констр\.калибр\.|ст\.сорт\.|ст\.констр\.|ст\.КАЧ\."],
}


def hit(text: Column, keyword: str) -> Column:
    """regex: and re: are patterns on the text as it is, * and ? wildcards, all else a part of the text; case is ignored."""
    for p in ("regex:", "re:"):
        if keyword.startswith(p):
            return text.rlike(f"(?iu){keyword.removeprefix(p)}")
    if "*" in keyword or "?" in keyword:
        pattern = "".join({"*": ".*", "?": "."}.get(c, c if c.isalnum() or c.isspace() else f"\\{c}") for c in keyword.lower())
        return F.lower(text).rlike(pattern)
    return F.contains(F.lower(text), F.lit(keyword.lower()))


def matches(text: Column, prompts: dict[str, list[str]]) -> Column:
    """Array of the prompts of which a keyword hits, in order."""
    found = F.array(*[F.when(reduce(Column.__or__, [hit(text, k) for k in words]), F.lit(p)) for p, words in prompts.items()])
    return F.array_compact(found)


def route(text: Column, prompts: dict[str, list[str]], default: str | None = "hardware") -> Column:
    return F.coalesce(F.get(matches(text, prompts), 0), F.lit(default))


def points(text: Column, keyword: str) -> Column:
    """3 for a pattern, 2 for wildcards, 1 for a part of the text and one more at its beginning."""
    kind = 3 if keyword.startswith(("regex:", "re:")) else 2 if "*" in keyword or "?" in keyword else 1
    more = F.when(F.startswith(F.lower(text), F.lit(keyword.lower())), 1).otherwise(0) if kind == 1 else F.lit(0)
    return F.when(hit(text, keyword), F.lit(kind) + more).otherwise(F.lit(0))


def detect(text: Column, prompts: dict[str, list[str]]) -> Column:
    """struct<kind, score, confidence> of the first prompt with the most points; kind is null without any."""
    scored = F.array(*[F.struct(reduce(Column.__add__, [points(text, k) for k in words]).alias("score"), F.lit(-i).alias("at"), F.lit(p).alias("kind")) for i, (p, words) in enumerate(prompts.items())])
    top = F.array_max(scored)
    return F.struct(F.when(top.score > 0, top.kind).alias("kind"), top.score.alias("score"), F.least(top.score / 5.0, F.lit(1.0)).alias("confidence"))


def tasks(items: DataFrame, prompts: dict[str, list[str]]) -> DataFrame:
    """A row for each item and prompt that matches."""
    return items.withColumn("prompt", F.explode(matches(F.col("text"), prompts)))

# Item types that a category implies; another category is its own type.
IMPLIED = {"hardware": "крепеж", "hardware_washer": "шайба", "rolledmetal": "прокат", "eri": "эри", "ekb": "экб"}


def implicit_types(rows: DataFrame, names: list[str], prompts: dict[str, list[str]] = PROMPTS) -> DataFrame:
    """rows with detected_kind, detection_confidence and implicit_type by the first name that is not blank; null without a name or a keyword."""
    name = F.coalesce(*[F.when(F.trim(n) != "", F.col(n)) for n in names])
    found = detect(name, prompts)
    kind = F.when(name.isNotNull(), found.kind)
    table = F.create_map(*[F.lit(x) for kv in IMPLIED.items() for x in kv])
    return rows.withColumns({"detected_kind": kind, "detection_confidence": F.when(kind.isNotNull(), found.confidence), "implicit_type": F.coalesce(F.element_at(table, F.lower(kind)), kind)})
