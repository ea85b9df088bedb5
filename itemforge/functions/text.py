"""String functions on item names: Column in, Column out.

Texts mix Cyrillic and Latin, so patterns name their classes and carry (?iu) where case is ignored.
Functions of a null text give null unless they say otherwise.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from itemforge.functions.collections import let

# Spellings of standards, in the order in which they are tried.
STANDARDS = [
    ("ГОСТ", r"ГОСТ\s*(\d+)-(\d+)", "{1}", 2),
    ("ГОСТ", r"ГОСТ\s*[РR]?\s*(\d+)-(\d+)", "{1}", 2),
    ("ГОСТ", r"ГОСТ\s*ISO\s*(\d+)-(\d+)", "{1}", 2),
    ("ОСТ", r"ОСТ\s*(\d+)\s*(\d+)-(\d+)", "{1} {2}", 3),
    ("ТУ", r"ТУ\s*(\d+-\d+-\d+)", "{1}", 0),
    ("ISO", r"ISO\s*(\d+):?(\d+)?", "{1}", 2),
    ("DIN", r"DIN\s*(\d+)", "{1}", 0),
    ("DIN", r"DIN\s*EN\s*ISO\s*(\d+):?(\d+)?", "{1}", 2),
    ("РАМ", r"РАМ\.(\d+)\.(\d+)", "{1}.{2}", 0),
    ("РАМ", r"РАМ\s+(\d+)\s+(\d+)", "{1}.{2}", 0),
]
ITEM_TYPES = ["болт", "винт", "гайка", "шайба", "шуруп", "шпилька", "заклепка", "штифт", "хомут", "анкер", "саморез", "гвоздь"]
#: Parameters that a name never shows.
UNSEEN = ["марка_материала", "толщина_покрытия", "наличие_бп", "автор_последнего_изменения", "дата_последнего_изменения"]
TRAILING = ",.;: "
LETTERS = "a-zA-Zа-яА-Я"


def _trimmed(text: Column) -> Column:
    return F.rtrim(F.trim(text), F.lit(TRAILING))


def _group(text: Column, pattern: str, i: int) -> Column:
    return F.nullif(F.regexp_extract(text, f"(?iu){pattern}", i), F.lit(""))


def standard(text: Column) -> Column:
    """struct<type, number, year, full_name, start> of the first pattern that occurs (start from 0); null if none does."""

    def one(t: Column, kind: str, pattern: str, number: str, year: int) -> Column:
        groups = {"{1}": [1], "{1} {2}": [1, " ", 2], "{1}.{2}": [1, ".", 2]}[number]
        parts = [_group(t, pattern, g) if isinstance(g, int) else F.lit(g) for g in groups]
        return F.when(
            t.rlike(f"(?iu){pattern}"),
            F.struct(
                F.lit(kind).alias("type"),
                F.concat(*parts).alias("number"),
                (_group(t, pattern, year) if year else F.lit(None).cast("string")).alias("year"),
                F.regexp_extract(t, f"(?iu){pattern}", 0).alias("full_name"),
                (F.instr(t, F.regexp_extract(t, f"(?iu){pattern}", 0)) - 1).alias("start"),
            ),
        )

    return let(_trimmed(text), lambda t: F.coalesce(*[one(t, *s) for s in STANDARDS]))


def item_type(text: Column) -> Column:
    """First item type, in their fixed order, that stands in the text as a word of its own."""
    found = let(F.lower(text), lambda t: F.coalesce(*[F.when(t.rlike(rf"(?<![\p{{L}}\p{{N}}_]){k}(?![\p{{L}}\p{{N}}_])"), F.lit(k)) for k in ITEM_TYPES]))
    return found


def canonical_standard(text: Column, legacy: bool = False) -> Column:
    """One spelling for each standard; '' for null. legacy: drops the digit after a glued ОСТ1, in ГОСТ1 too."""
    glued = (r"ОСТ\s*1(\d)", "ОСТ 1 ") if legacy else (r"(?<!Г)ОСТ\s*1\s*(?=\d)", "ОСТ 1 ")
    out = F.trim(F.coalesce(text, F.lit("")))
    out = F.regexp_replace(F.regexp_replace(out, *glued), r"(?<!Г)ОСТ\s*1\s+", "ОСТ 1 ")
    return F.regexp_replace(out, r"[\s ]+", " ")


# Spellings of foreign and shop standards, in the order in which they are tried.
OTHER_STANDARDS = [
    r"ГОСТ\s*(?:Р\s*)?(?:ИСО\s*)?\d+(?:\.\d+)?(?:-\d+)+",
    r"ОСТ\s*(?:1\s+|3-|4\.\d+\s+|92-|26\.\d+\s*)?\d+[\s-]*\d+",
    r"DIN\s*\d+(?:\s*-\s*\d+)?",
    r"NAS\d+[A-Z]?",
    r"MS\d+[A-Z]?",
    r"AN\d+[A-Z]?",
    r"ISO\s*\d+",
    r"\d+[А-ЯA-Z]+",
]


def other_standard(text: Column) -> Column:
    """The first standard in a wider list of spellings; '' if there is none."""
    return F.coalesce(*[_group(text, p, 0) for p in OTHER_STANDARDS], F.lit(""))


def clean_input(text: Column) -> Column:
    """Trimmed, ё as е, and a Cyrillic М before a digit and not after a letter as Latin M."""
    return F.regexp_replace(F.translate(_trimmed(text), "ёЁ", "еЕ"), r"(?<![\p{L}])М(?=\d)", "M")


def name_key(text: Column) -> Column:
    """Key of the exact name: lower case without spaces and no-break spaces."""
    return F.translate(F.lower(text), "  ", "")


def comparison_text(text: Column) -> Column:
    return F.regexp_replace(F.translate(F.translate(F.lower(F.trim(text)), " -_", ""), ",", "."), r"\.0$", "")


def tokens(text: Column) -> Column:
    """Distinct tokens of letters in lower case, digits removed."""
    raw = F.regexp_extract_all(F.lower(text), F.lit(f"([{LETTERS}0-9]+)"), 1)
    return F.array_distinct(F.filter(F.transform(raw, lambda t: F.regexp_replace(t, "[0-9]", "")), lambda t: t != ""))


def jaccard(a: Column, b: Column) -> Column:
    """Of two token arrays; 0 if either is empty."""
    return F.coalesce(F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))), F.lit(0.0))


def token_similarity(a: Column, b: Column) -> Column:
    return let(tokens(a), lambda x: let(tokens(b), lambda y: jaccard(x, y)))


def without_standard(name: Column) -> Column:
    return F.regexp_replace(name, r"(?iu)(?:гост|ост|ту)\s*[0-9][0-9 .\-]*", " ")


def number_tokens(name: Column) -> Column:
    """Maximal runs of digits and dots of a name without its standard: what a value must equal to be in the name."""
    return F.filter(F.split(F.lower(without_standard(name)), "[^0-9.]+"), lambda t: t != "")


def name_forms(name: Column) -> Column:
    """struct<whole, bare, runs> of a catalogue name for shown_in: lower case with decimal points, the same without standards, the maximal runs of digits and points that both have."""
    runs = lambda c: F.split(c, "[^0-9.]+")
    whole = F.translate(F.lower(name), ",", ".")
    bare = lambda w: F.regexp_replace(w, r"(?:гост|ост|ту)\s*[0-9][0-9\s.\-]*(?:-[0-9]+)?", "")
    both = lambda w, b: F.struct(w.alias("whole"), b.alias("bare"), F.filter(F.array_intersect(runs(w), runs(b)), lambda t: t != "").alias("runs"))
    return let(whole, lambda w: let(bare(w), lambda b: both(w, b)))


def shown_key(value: Column) -> Column:
    """A value as shown_in takes it."""
    return F.translate(F.lower(F.trim(value)), ",", ".")


def shown_in(key: Column, forms: Column) -> Column:
    """Whether a value stands in a name, with and without its standard, and no digit or point beside it."""
    quoted = F.concat(F.lit(r"(?<![0-9.])\Q"), F.replace(key, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit(r"\E(?![0-9.])"))
    written = F.contains(forms.bare, key) & F.regexp_like(forms.whole, quoted) & F.regexp_like(forms.bare, quoted)
    return (key != "") & F.when(F.regexp_like(key, F.lit("^[0-9.]+$")), F.array_contains(forms.runs, key)).otherwise(written)


def value_visible(value: Column, name: Column, param: Column, has_standard: bool = True) -> Column:
    """Whether a catalogue value can be read off a name: as it stands, by one of its letter tokens, by its leading letters, as N for N.0, or without a leading м."""
    shown = F.regexp_replace(name, r"(?iu)ОСТ\s*\d+\s*\d+-\d+|ГОСТ\s*\d+-\d+", "") if has_standard else name
    plain = lambda c: F.translate(F.lower(c), ",", ".")
    inside = lambda n, v: F.contains(n, v)

    def test(v: Column, n: Column) -> Column:
        parts = F.filter(F.split(v, r"[.\\-]"), lambda t: t.rlike(f"[{LETTERS}]"))
        prefix = F.regexp_extract(v, f"^([{LETTERS}]+)", 1)
        whole = F.regexp_extract(v, r"^(.+)\.0$", 1)
        metric = F.regexp_extract(v, r"^[мm](\d+(?:[.,]\d+)?)$", 1)
        return (
            inside(n, v)
            | F.exists(parts, lambda t: inside(n, t))
            | ((prefix != "") & inside(n, prefix))
            | ((whole != "") & F.array_contains(F.split(n, "[^0-9]+"), whole))
            | ((metric != "") & inside(n, metric))
        )

    seen = let(plain(F.trim(value)), lambda v: let(plain(shown), lambda n: test(v, n)))
    return F.coalesce((value != "") & (name != "") & ~param.isin(UNSEEN) & seen, F.lit(False))


def field_name(header: Column, longest: int = 30) -> Column:
    """Canonical field name of a header."""
    out = F.lower(F.trim(F.regexp_replace(header, r"\s*\([^)]*\)", "")))
    out = F.trim(F.regexp_replace(F.translate(out, " ,", "__"), "_+", "_"), F.lit("_"))
    short = reduce(lambda c, part: F.replace(c, F.lit(part), F.lit("")), ["ди", "de", "la", "le", "et", "du"], out)
    return F.when(F.length(out) > longest, F.trim(F.substring(short, 1, longest), F.lit("_"))).otherwise(out)


def snake_case(header: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.trim(header)), r"[^\p{L}\p{N}]+", "_"), F.lit("_"))


def normal_field(name: Column) -> Column:
    """Field name for comparison: only letters, digits, nothing between them."""
    return F.regexp_replace(F.lower(F.trim(name)), r"[^\p{L}\p{N}]", "")


def strip_controls(text: Column, longest: int = 1000) -> Column:
    return F.substring(F.regexp_replace(text, r"[\x00-\x08\x0b\x0c\x0e-\x1f]", ""), 1, longest)


def snippet(text: Column, value: Column, around: int = 3) -> Column:
    """The value in the text with some characters on either side; null if it isn't there."""
    at = F.instr(F.lower(text), F.lower(value))
    begin = F.greatest(F.lit(1), at - around)
    return F.when(at > 0, F.substring(text, begin, at - begin + F.length(value) + around))


def mask_hash(std: Column, kind: Column, pattern: Column) -> Column:
    return F.md5(F.concat_ws(":", std, kind, pattern))


def strip_standard(text: Column, std: Column) -> Column:
    """The text before a standard at its end."""
    return F.trim(F.regexp_replace(text, F.concat(F.lit(r"(?iu)[-\s]*\Q"), std, F.lit(r"\E\s*$")), F.lit("")))


def parenthesised(text: Column, value: Column) -> Column:
    """The first bare value in parentheses; unchanged if it isn't there or has them."""
    at = F.instr(text, value)
    return F.when((at > 0) & ~F.contains(text, F.concat(F.lit("("), value, F.lit(")"))), F.concat(F.substring(text, F.lit(1), at - 1), F.lit("("), value, F.lit(")"), F.substring(text, at + F.length(value), F.length(text)))).otherwise(text)
