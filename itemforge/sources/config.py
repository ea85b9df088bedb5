"""Settings, column mappings, domains and coating tables from YAML or tables, and headers without a mapping."""

from __future__ import annotations

import re
from dataclasses import dataclass, field, fields

import yaml
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from itemforge.operators.routing import detect

# Latin letters of the Cyrillic ones.
LATIN = {
    "а": "a", "б": "b", "в": "v", "г": "g", "д": "d", "е": "e", "ё": "yo", "ж": "zh", "з": "z", "и": "i", "й": "j", "к": "k", "л": "l", "м": "m", "н": "n", "о": "o",
    "п": "p", "р": "r", "с": "s", "т": "t", "у": "u", "ф": "f", "х": "kh", "ц": "c", "ч": "ch", "ш": "sh", "щ": "shch", "ъ": "", "ы": "y", "ь": "", "э": "e", "ю": "yu", "я": "ya",
}
# Words of headers whose columns hold numbers.
NUMERIC_WORDS = ["длина", "диаметр", "толщина", "ширина", "шаг", "масса"]


@dataclass
class Settings:
    """What a run can be told; unknown keys of a file are left out."""

    success_threshold: float = 0.7
    cache_days: int = 7
    workers: int = 4
    model: str = ""
    api_key: str = ""
    paths: dict = field(default_factory=dict)


def settings(text: str, secrets: dict[str, str] | None = None) -> Settings:
    """From YAML; secrets: texts of key files by field."""
    known = {f.name for f in fields(Settings)}
    found = {k: v for k, v in (yaml.safe_load(text) or {}).items() if k in known}
    return Settings(**found | {k: v.strip() for k, v in (secrets or {}).items() if k in known})


def column_mapping(text: str | None, default: dict[str, list[str]]) -> dict[str, list[re.Pattern]]:
    """field -> patterns of headers, from YAML or else the default; patterns that don't compile are left out."""
    raw = (yaml.safe_load(text) or {}).get("columns", {}) if text else default
    out: dict[str, list[re.Pattern]] = {}
    for name, patterns in raw.items():
        for p in [patterns] if isinstance(patterns, str) else patterns:
            try:
                out.setdefault(name, []).append(re.compile(p, re.I))
            except re.error:
                continue
    return out


def mapping_for(base: dict[str, list], by_category: dict[str, dict[str, list]], category: str) -> dict[str, list]:
    """The mapping of a category: its own entries over the common ones."""
    return {**base, **by_category.get(category, {})}


def mapped(header: str, mapping: dict[str, list[re.Pattern]]) -> str | None:
    """The first field of which a pattern is in the header."""
    return next((name for name, patterns in mapping.items() if any(p.search(header) for p in patterns)), None)


def transliterated(text: str) -> str:
    return "".join(LATIN.get(c, c) for c in text.lower())


def latin_snake(text: str) -> str:
    """Latin field name of a header: brackets, commas, slashes and spaces part words, points are underscores, other signs stay."""
    words = re.split(r"[\s(),/]+", text.replace(".", "_").strip())
    return re.sub("_+", "_", transliterated("_".join(words))).strip("_")


def transliterated_column(text: Column) -> Column:
    """The same as a column."""
    return F.array_join(F.transform(F.split(F.lower(text), ""), lambda c: F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in LATIN.items() for x in kv]), c), c)), "")


def generated_mapping(headers: list[str], skip: list[str], existing: dict[str, str]) -> dict[str, str]:
    """header -> Latin field name of the headers that are neither skipped nor mapped."""
    return {h: latin_snake(h) for h in headers if h not in skip and h not in existing}


def adapted(rows: DataFrame, mapping: dict[str, list[re.Pattern]], category: str, source: str, explicit: dict[str, str] | None = None) -> DataFrame:
    """A catalogue in any layout: each header by the explicit names, then the patterns, then in snake case, its text kept as _original_; rows without a name are left out."""
    from itemforge.operators.index import number_headers

    names = [(explicit or {}).get(h) or mapped(h, mapping) or re.sub(r"\W+", "_", h.lower()).strip("_") for h in rows.columns]
    names = number_headers(names)
    out = rows.select(*[F.col(f"`{h}`").alias(n) for h, n in zip(rows.columns, names, strict=True)], *[F.col(f"`{h}`").cast("string").alias(f"_original_{n}") for h, n in zip(rows.columns, names, strict=True)])
    present = [F.nullif(F.trim(F.col(n).cast("string")), F.lit("")) for n in ("full_name", "name") if n in names]
    out = out.withColumns({"_ens_category": F.lit(category), "_source_file": F.lit(source)})
    return out.where(F.coalesce(*present).isNotNull()) if present else out.where("false")


def category_of(rows: DataFrame, order: str, keywords: dict[str, list[str]]) -> DataFrame:
    """kind, score, confidence of a catalogue by the text of its first ten rows, 1000 characters of it."""
    text = F.concat_ws(" ", *[F.col(f"`{c}`").cast("string") for c in rows.columns if c != order])
    ten = rows.select(F.col(order).alias("_o"), text.alias("_t")).orderBy("_o").limit(10)
    whole = ten.agg(F.array_sort(F.collect_list(F.struct("_o", "_t"))).alias("r")).select(F.substring(F.array_join(F.transform("r", lambda e: e._t), " "), 1, 1000).alias("t"))
    return whole.select(detect(F.col("t"), keywords).alias("d")).select("d.*")


def domain(text: str) -> dict[str, list[str]]:
    """Lists of a domain (skip, meta, retain, loose, ...): those of its index section, else of the root; a text with commas is a list."""
    root = yaml.safe_load(text) or {}
    found = {**root, **(root.get("index") or {})}
    split = lambda v: [x.strip() for x in v.split(",") if x.strip()] if isinstance(v, str) else list(v or [])
    return {k: split(v) for k, v in found.items() if isinstance(v, (str, list))}


def technical_fields(domain_: dict[str, list[str]], always: list[str]) -> list[str]:
    """All fields that say nothing about an item, once each."""
    return list(dict.fromkeys([*always, *(f for k in ("skip", "meta", "retain", "technical") for f in domain_.get(k, []))]))


def is_numeric(header: str) -> bool:
    return any(w in header.lower() for w in NUMERIC_WORDS)


def coating_table(rows: DataFrame) -> DataFrame:
    """ens, gost, ost of a reference of coatings in any layout: by words of the headers, else the second, fourth and fifth column."""
    from itemforge.sources.tables import find_column

    place = {"ens": (["енс", "ens"], 1), "gost": (["гост"], 3), "ost": (["ост"], 4)}
    chosen, taken = {}, set()
    for name, (words, at) in place.items():
        free = [c for c in rows.columns if c not in taken]
        chosen[name] = find_column(free, words) or (rows.columns[at] if at < len(rows.columns) else None)
        taken.add(chosen[name])
    text = lambda c: F.nullif(F.trim(F.col(f"`{c}`").cast("string")), F.lit("")) if c else F.lit(None).cast("string")
    return rows.select(*[text(c).alias(n) for n, c in chosen.items()]).where("ens is not null")


def material(attrs: Column) -> Column:
    """The first of the three material fields that is not blank."""
    pick = lambda k: F.get(F.filter(attrs, lambda e: (e.k == k) & (F.trim(e.v) != "")), 0).v
    return F.coalesce(*[pick(k) for k in ("марка_материала", "марка_стали", "материал")])


def coating(value: Column) -> Column:
    """Null for blanks and words for no coating."""
    return F.when(~F.lower(F.trim(value)).isin("", "-", "бп", "без покрытия", "нет"), F.trim(value))
