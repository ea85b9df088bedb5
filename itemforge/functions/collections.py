"""Parameter bags: ordered arrays of struct<k, v> and maps."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def bag(**values: Column) -> Column:
    """Ordered parameters, empty ones left out."""
    every = F.array(*[F.struct(F.lit(k).alias("k"), v.cast("string").alias("v")) for k, v in values.items()])
    return F.filter(every, lambda e: e.v.isNotNull() & (e.v != ""))


def field_value(attrs: Column, name: Column) -> Column:
    """Value of a field: equal key, equal but for case, equal but for underscores, the first key that contains the name, the first that the name contains. Keys with a leading underscore count for the first two only."""
    pick = lambda test: F.get(F.filter(attrs, lambda e: e.v.isNotNull() & test(e)), 0).v
    open_ = lambda e: ~F.startswith(e.k, F.lit("_"))
    plain = lambda c: F.replace(c, F.lit("_"), F.lit(""))
    return F.coalesce(
        pick(lambda e: e.k == name),
        pick(lambda e: F.lower(e.k) == F.lower(name)),
        pick(lambda e: open_(e) & (plain(e.k) == plain(name))),
        pick(lambda e: open_(e) & F.contains(e.k, name)),
        pick(lambda e: open_(e) & F.contains(name, e.k)),
    )


def meta_value(attrs: Column, name: Column, default: Column) -> Column:
    """Value of a field without regard to case; '', None and null as text are missing."""
    found = F.trim(F.get(F.filter(attrs, lambda e: F.lower(e.k) == F.lower(name)), 0).v)
    return F.coalesce(F.when(~found.isin("", "None", "null"), found), default)


def merged(base: Column, more: Column) -> Column:
    """Map with base's values, blank or missing ones from more."""
    return F.map_zip_with(base, more, lambda k, a, b: F.coalesce(F.nullif(F.trim(a), F.lit("")), b, a))


def trimmed(params: Column) -> Column:
    """Map without null values, the rest trimmed."""
    return F.transform_values(F.map_filter(params, lambda k, v: v.isNotNull()), lambda k, v: F.trim(v))


def as_map(entries: Column) -> Column:
    """Map of an array of struct<k, v>; the last of equal keys stays."""
    last = F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, F.size(entries)), lambda o: o.k == e.k))
    return F.map_from_entries(F.transform(last, lambda e: F.struct(e.k, e.v)))


def list_field(text: Column) -> Column:
    """A list from JSON text, or else from text with commas."""
    return F.coalesce(F.from_json(F.when(F.startswith(F.trim(text), F.lit("[")), text), "array<string>"), F.filter(F.transform(F.split(text, ","), F.trim), lambda x: x != ""))


def cells(params: Column, most: int = 20) -> Column:
    """Multi-line text of a bag; with most entries or more, these and a line with the number of all."""
    lines = F.transform(F.slice(params, 1, most), lambda e: F.concat(e.k, F.lit("="), e.v))
    return F.when(F.size(params) >= most, F.concat(F.array_join(lines, "\n"), F.lit("\n... ("), F.size(params).cast("string"), F.lit(" всего)"))).otherwise(F.array_join(lines, "\n"))
