"""Outputs of a batch: result columns, JSON rows, totals, exports of a store."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from itemforge.functions.coating import reason
from itemforge.functions.collections import cells, let
from itemforge.functions.numbers import number, rounded
from itemforge.functions.text import strip_controls
from itemforge.operators.scoring import COATING, same_coating

# Names of the match types in outputs.
MATCH_NAMES = {
    "exact_name": "Точное совпадение по наименованию",
    "exact": "Точное совпадение (V2 generic)",
    "fuzzy": "Нечеткое совпадение",
    "fuzzy_coating_variant": "Нечеткое совпадение (вариант покрытия)",
    "exact_substitution": "Точное совпадение (после замены покрытия)",
    "tfidf": "TF-IDF fallback",
}
# Outcomes of the check of parameters against the catalogue's, and words of their details.
SKIPPED, FULL, FEWER, MORE, DIFFERENT = "∅ Пропущено", "✓ Полное совпадение", "⚠ Не хватает параметров в проверяемом", "⚠ Не хватает параметров в ЕНС", "✗ Несовпадение параметров"
BOTH_EMPTY, ABSENT, OWN_ONLY, HELD_ONLY = "Оба пустые — нет данных для сверки", "Отсутствуют: ", "Уникальные в params: ", "Уникальные в ЕНС: "
NOT_CHECKED = ["код", "mdm_key", "id", "наименование", "полное_наименование", "стандарт", "тип_изделия"]
YES, NO, UNDEFINED = "Да", "Нет", "Не определено"
#: Parameters that are left out of a comparison with the catalogue.
NOT_COMPARED = ["код", "наименование", "полное_наименование", "mdm_key", "стандарт", "тип", "guid"]


def compared(params: Column) -> Column:
    """A map without keys of technical parameters."""
    return F.map_filter(params, lambda k, v: ~F.lower(k).isin(NOT_COMPARED))


def finite(df: DataFrame) -> DataFrame:
    """df with NaN and infinite numbers as null."""
    kinds = {f.name for f in df.schema if f.dataType.simpleString() in ("double", "float")}
    clean = lambda c: F.when(~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))), F.col(c)).alias(c)
    return df.select(*[clean(c) if c in kinds else F.col(f"`{c}`") for c in df.columns])


def mismatched(detail: Column) -> Column:
    """JSON of the parameters that did not fit; null without any."""
    wrong = F.transform(F.filter(detail, lambda e: e.status.isin("mismatched", "exact (in name)")), lambda e: F.struct(e.k.alias("param"), e.v.alias("value"), e.value.alias("ens_value"), e.status.alias("status")))
    return F.when(F.size(wrong) > 0, F.to_json(wrong))


def checked(params: Column, held: Column, read: Column) -> Column:
    """struct<status, details>: parameters of a name against those of the candidate, held in its fields and else read in its name (bags).

    Values are equal as texts without spaces, dashes and underscores, as numbers within 0.001, or as
    coatings. Details name what differs in the order of params, or what one side alone has in the order of the names.
    """
    bag = "array<struct<k: string, v: string>>"
    given = lambda b: F.filter(F.coalesce(b, F.array().cast(bag)), lambda e: F.trim(e.v) != "")
    fields = F.filter(given(held), lambda e: ~F.startswith(e.k, F.lit("_")) & ~F.lower(e.k).isin(NOT_CHECKED))
    plain = lambda c: F.translate(F.translate(F.lower(c), " -_", ""), ",", ".")

    def same(k: Column, a: Column, b: Column) -> Column:
        alike = (plain(a) == plain(b)) | (F.contains(k, F.lit(COATING)) & same_coating(a, b)) | (F.abs(number(plain(a)) - number(plain(b))) < 0.001)
        return F.coalesce(alike, F.lit(False))

    def told(p: Column, e: Column) -> Column:
        of = lambda b, k: F.get(F.filter(b, lambda x: x.k == k), 0).v
        has = lambda b, k: F.exists(b, lambda x: x.k == k)
        wrong = F.filter(p, lambda x: has(e, x.k) & ~same(x.k, x.v, of(e, x.k)))
        only_p, only_e = (F.array_sort(_without(a, b)) for a, b in ((p, e), (e, p)))
        listed = lambda b: F.array_join(F.transform(b, lambda x: F.concat(x.k, F.lit("="), x.v)), "; ")
        named = lambda b: F.array_join(F.transform(b, lambda x: x.k), ", ")
        both = lambda s, d: F.struct(F.lit(s).alias("status"), d.alias("details"))
        differing = F.array_join(F.transform(wrong, lambda x: F.concat(x.k, F.lit(": params="), x.v, F.lit(", ens="), of(e, x.k))), "; ")
        return (
            F.when((F.size(p) == 0) & (F.size(e) == 0), both(SKIPPED, F.lit(BOTH_EMPTY)))
            .when(F.size(wrong) > 0, both(DIFFERENT, differing))
            .when((F.size(only_p) == 0) & (F.size(only_e) == 0), both(FULL, F.lit("")))
            .when(F.size(only_p) == 0, both(FEWER, F.concat(F.lit(ABSENT), listed(only_e))))
            .when(F.size(only_e) == 0, both(MORE, F.concat(F.lit(ABSENT), listed(only_p))))
            .otherwise(both(DIFFERENT, F.concat(F.lit(OWN_ONLY), named(only_p), F.lit("; " + HELD_ONLY), named(only_e))))
        )

    own = F.coalesce(params, F.array().cast(bag))
    return let(own, lambda p: let(let(fields, lambda f: F.concat(f, _without(given(read), f))), lambda e: told(p, e)))


def _without(a: Column, b: Column) -> Column:
    """Entries of a bag whose keys the other one does not have."""
    return F.filter(a, lambda x: ~F.exists(b, lambda y: y.k == x.k))


def result_rows(items: DataFrame, matched: DataFrame, masks: DataFrame, name: str = "name") -> DataFrame:
    """items with the result columns of each row; matched as ladder.match gives it, a row for each distinct name.

    Every text is cut at 1000 characters, the code at 50 and the name at 500.
    """
    patterns = masks.groupBy(F.col("id").alias("mask_id")).agg(F.max("pattern").alias("mask_pattern"))
    have = masks.select(F.col("standard").alias("m_std"), F.lower("item_type").alias("m_type")).distinct().withColumn("has_mask", F.lit(True))
    facts = matched.withColumnRenamed("name", "_name").join(patterns, "mask_id", "left").join(have, (F.col("std") == F.col("m_std")) & (F.lower("item_type") == F.col("m_type")), "left")
    text = lambda c: F.coalesce(strip_controls(c.cast("string")), F.lit(""))
    names = F.create_map(*[F.lit(x) for kv in MATCH_NAMES.items() for x in kv])
    replaced = F.to_json(F.struct("original", "corrected", "material", reason(F.col("material"), F.col("original")).alias("reason")))
    verdict = checked(F.col("params"), F.col("ens_params"), F.col("ens_params_mask"))
    flat = F.array_join(F.transform("ens_params_mask", lambda e: F.concat(e.k, F.lit("="), e.v)), ", ")
    columns = {
        "ens_code_out": F.substring(text(F.col("ens_code")), 1, 50),
        "ens_name_out": F.substring(text(F.col("ens_name")), 1, 500),
        "level_out": text(F.col("level")),
        "recognised": F.when(F.col("success"), YES).otherwise(NO),
        "confidence_out": rounded(F.coalesce("confidence", F.lit(0.0)), 3),
        "match_kind": F.coalesce(F.element_at(names, F.col("match_type")), F.lit(UNDEFINED)),
        "substitution": F.when(F.col("corrected").isNotNull(), replaced),
        "mismatches": mismatched(F.col("detail")),
        "mask_text": text(F.col("mask_pattern")),
        "params_cell": cells(F.col("params")),
        "ens_params_cell": cells(F.col("ens_params")),
        "ens_params_mask_cell": F.coalesce(cells(F.col("ens_params_mask")), F.lit("")),
        "check_status": verdict.status,
        "check_details": F.substring(verdict.details, 1, 1000),
        "mask_params": text(flat),
        "std_out": text(F.col("std")),
        "type_out": text(F.col("item_type")),
        "mask_known": F.when(F.col("has_mask"), YES).otherwise(NO),
        "details": text(F.to_json(F.struct("match_type", "mask_id", "detail", "near"))),
    }
    joined = items.join(facts, items[name].eqNullSafe(F.col("_name")), "left")
    return joined.select(*[items[c] for c in items.columns], *[v.alias(k) for k, v in columns.items()])


def json_rows(matched: DataFrame) -> DataFrame:
    """name, json of every result; numbers that JSON can't hold are null, Cyrillic stays as it is."""
    return finite(matched).select("name", F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("json"))


def totals(matched: DataFrame, success_only: bool = False) -> DataFrame:
    """total, success, failed, written, success_percent of a batch; written: rows of the output."""
    good = F.count_if("success")
    share = F.round(F.coalesce(F.try_divide(good * 100.0, F.count("*")), F.lit(0.0)), 2)
    return matched.agg(F.count("*").alias("total"), good.alias("success"), (F.count("*") - good).alias("failed"), (good if success_only else F.count("*")).alias("written"), share.alias("success_percent"))


def successful(matched: DataFrame) -> DataFrame:
    return matched.where("success")


def exported(results: DataFrame, structure: str) -> DataFrame:
    """key, json of a store (article, prompt_id, category, data: text) flat, by_code, by_category or by_prompt."""
    own = F.struct("article", "prompt_id", "category", "data")
    if structure == "flat":
        return results.select(F.concat_ws(":", "article", "prompt_id").alias("key"), F.to_json(own).alias("json"))
    key = {"by_code": "article", "by_category": "category", "by_prompt": "prompt_id"}[structure]
    return results.groupBy(F.coalesce(F.col(key), F.lit("")).alias("key")).agg(F.to_json(F.array_sort(F.collect_list(own))).alias("json"))


def candidates(ranked: DataFrame) -> DataFrame:
    """name, candidates (rank, ens_code, score) of ranked candidates, best first."""
    return ranked.groupBy("name").agg(F.array_sort(F.collect_list(F.struct("rank", "ens_code", rounded(F.col("score"), 3).alias("score")))).alias("candidates"))
