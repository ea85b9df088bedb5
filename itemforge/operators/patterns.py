"""Work on the patterns of masks, at the driver when a mask is loaded, and what they say about names."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from itemforge.functions.collections import let
from itemforge.functions.numbers import lenient_equal

#: Parameters that no example can be checked by.
ALWAYS_SKIPPED = ["стандарт", "тип", "код", "наименование"]


def groups(pattern: str) -> list[tuple[str, bool]]:
    """Named groups in order, and whether each may be absent: it, or a group around it, is followed by ?, * or {0,n}, or stands in one of several alternatives."""
    out, stack, i, split = [], [], 0, False
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            i += 2
            continue
        if c == "[":
            i = pattern.index("]", i + 2 if pattern[i + 1 : i + 2] in ("]", "^") else i + 1)
        elif c == "(":
            named = re.match(r"\(\?P?<([^>=!]+)>", pattern[i:])
            out += [[named[1], False]] if named else []
            stack.append([len(out) - 1 if named else None, len(out), False])
        elif c == "|" and stack:
            stack[-1][2] = True
        elif c == "|":
            split = True
        elif c == ")":
            own, since, alternatives = stack.pop()
            absent = re.match(r"\?|\*|\{0*,|\{0+[,}]", pattern[i + 1 :])
            for g in out[since if own is None or not absent else own :] if absent or alternatives else []:
                g[1] = True
        i += 1
    return [(name, absent or split) for name, absent in out]


def unescaped(pattern: str) -> str:
    """A pattern typed in a shell: doubled backslashes before a letter or sign are single."""
    return re.sub(r"\\\\(?=[\w().\[\]{}+*?|^$/-])", r"\\", pattern)


def numbered_groups(pattern: str) -> str:
    """Repeated group names get _2, _3, ..."""
    seen: dict[str, int] = {}

    def name(m: re.Match) -> str:
        seen[m[1]] = seen.get(m[1], 0) + 1
        return f"(?P<{m[1]}_{seen[m[1]]}>" if seen[m[1]] > 1 else f"(?P<{m[1]}>"

    return re.sub(r"\(\?P<(\w+)>", name, pattern)


def merged_groups(found: dict[str, str | None]) -> dict[str, str]:
    """Values of numbered groups under their plain name; the first that matched stays."""
    out: dict[str, str] = {}
    for k, v in found.items():
        if v is not None:
            out.setdefault(re.sub(r"_(?:[2-9]|[1-9][0-9]+)$", "", k), v)
    return out


def repaired(pattern: str, forbidden: tuple[str, ...] = ("стандарт",)) -> str | None:
    """A proposed pattern that can be stored: single backslashes, one name for each group, no captures of forbidden names, anchored, text allowed behind the standard; None if it does not compile."""
    out = unescaped(pattern.strip())
    for name in forbidden:
        out = re.sub(rf"\(\?P<{re.escape(name)}(?:_[0-9]+)?>", "(?:", out)
    out = numbered_groups(out)
    out = out if out.startswith("^") else f"^{out}"
    out = out if not out.endswith("$") or out.endswith("\\$") else out[:-1] + r"(?:[\s,;.].*)?$"
    try:
        re.compile(out)
    except re.error:
        return None
    return out


def longest_prefix(pattern: str, text: str) -> int:
    """Length of the longest beginning of the pattern that compiles and matches the text's beginning."""
    for n in range(len(pattern), 0, -1):
        try:
            if re.match(pattern[:n], text, re.I):
                return n
        except re.error:
            continue
    return 0


def diagnosis(text: Column, pattern: str, item_type: str, std: str) -> Column:
    """Why a mask may not fit: whether the pattern fits without its end, the type begins the text, the standard ends it, and parentheses agree."""
    bare = pattern.rstrip("$")
    return F.struct(
        text.rlike(f"(?iu){pattern}").alias("matches"),
        text.rlike(f"(?iu){bare}").alias("matches_without_end"),
        F.startswith(F.lower(text), F.lit(item_type.lower())).alias("begins_with_type"),
        F.endswith(F.rtrim(text), F.lit(std)).alias("ends_with_standard"),
        (F.contains(text, F.lit("(")) == F.lit(r"\(" in pattern)).alias("parentheses_agree"),
    )


def skipped(*lists: list[str]) -> list[str]:
    """Parameters that are not checked: the fixed ones and all lists, normalised, once each."""
    plain = lambda p: re.sub(r"\W+", "_", p.strip().lower()).strip("_")
    return list(dict.fromkeys([*ALWAYS_SKIPPED, *(plain(p) for one in lists for p in one)]))


def required(params: list[str], optional: list[str]) -> list[str]:
    return [p for p in params if p not in optional]


# Names of parameters, and the fields that stand for them in this order.
STAND_INS = {
    ("нтд1", "стандарт", "standard"): ["стандарт", "нтд", "нтд_1", "standard"],
    ("типизделия", "наименованиетипа"): ["наименование_типа", "тип_изделия", "тип"],
    ("свойства", "группапрочности"): ["группа_прочности", "свойства", "группапрочности"],
}


def expected_key(keys: Column, name: Column, twins: list[list[str]] = ()) -> Column:
    """The key of a catalogue row for a parameter: equal but for underscores, else a field that stands for it, else one of its twins
    (lists of a parameter and its fields), else the one that holds it or is held by it with the nearest length; null without one.
    """
    plain = lambda c: F.replace(F.lower(c), F.lit("_"), F.lit(""))
    open_ = F.filter(keys, lambda k: ~F.startswith(k, F.lit("_")))
    equal = lambda w, same: F.get(F.filter(open_, lambda k: same(k, F.lit(w))), 0)
    first = lambda wanted, same: F.get(F.filter(F.array(*[equal(w, same) for w in wanted]), lambda k: k.isNotNull()), 0)
    ratio = lambda a, b: F.least(F.length(a), F.length(b)) / F.greatest(F.length(a), F.length(b))

    def find(p: Column) -> Column:
        rows = F.transform(open_, lambda k, i: F.struct(F.when(plain(k) == p, 2.0).when(F.contains(plain(k), p) | F.contains(p, plain(k)), ratio(plain(k), p)).otherwise(0.0).alias("r"), (-i).alias("at"), k.alias("k")))
        near = let(F.array_max(rows), lambda m: F.when(m.r > 0, F.struct(m.r.alias("r"), m.k.alias("k"))))
        chosen = [F.when(p.isin(*of), first(fields, lambda k, w: k == w)) for of, fields in STAND_INS.items()]
        chosen += [F.when(p == plain(F.lit(one)), first(fields, lambda k, w: plain(k) == plain(w))) for one, *fields in twins]
        return let(near, lambda m: F.coalesce(F.when(m.r == 2.0, m.k), *chosen, m.k))

    return let(plain(name), find)


def remapped(params: Column, names: dict[str, list[str]]) -> Column:
    """params (array<struct<k, v>>) under other names; one name may go to several, of equal new names the last stays."""
    table = F.create_map(*[x for k, vs in names.items() for x in (F.lit(k), F.array(*map(F.lit, vs)))])
    each = F.flatten(F.transform(params, lambda e: F.transform(F.coalesce(F.element_at(table, e.k), F.array(e.k)), lambda k: F.struct(k.alias("k"), e.v.alias("v")))))
    return let(each, lambda all_: F.filter(all_, lambda e, i: ~F.exists(F.slice(all_, i + 2, F.size(all_)), lambda o: o.k == e.k)))


def cells(rows: DataFrame, skip: list[str]) -> DataFrame:
    """rows (params, expected: array<struct<k, v>>, one for each example) as example, param, cell: =, ≠, ∅ (not found) or ~ (not in the catalogue)."""
    both = rows.withColumn("_k", F.explode(F.array_distinct(F.concat(F.transform("expected", lambda e: e.k), F.transform(F.coalesce("params", F.array().cast("array<struct<k: string, v: string>>")), lambda e: e.k)))))
    value = lambda c: F.get(F.filter(F.col(c), lambda e: e.k == F.col("_k")), 0).v
    told = both.where(~F.col("_k").isin(skip)).select("example", F.col("_k").alias("param"), value("params").alias("got"), value("expected").alias("want"))
    return told.withColumn("cell", F.when(F.col("got").isNull(), "∅").when(F.col("want").isNull(), "~").when(F.coalesce(lenient_equal(F.col("got"), F.col("want")), F.lit(False)), "=").otherwise("≠"))


def matrix(rows: DataFrame, params: list[str], skip: list[str]) -> DataFrame:
    """A row for each example, a column for each parameter in pattern order."""
    return cells(rows, skip).groupBy("example").pivot("param", params).agg(F.first("cell"))
