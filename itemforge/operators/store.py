"""The result store beside upserts: reads, deletions, verification, caches, checks of what is stored."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from itemforge.functions.text import canonical_standard


def result_of(results: DataFrame, name: str, article: str | None = None) -> DataFrame:
    """The result of a name; with an article, of both."""
    found = results.where(F.col("name") == name)
    return found if article is None else found.where(F.col("article") == article)


def delete(results: DataFrame, names: DataFrame) -> DataFrame:
    return results.join(names.select("name"), "name", "left_anti")


def clear(results: DataFrame, confirm: bool = False) -> DataFrame:
    if not confirm:
        raise ValueError("clearing a store needs confirm=True")
    return results.where("false")


def migrate_standards(rows: DataFrame, column: str = "standard") -> DataFrame:
    """rows with canonical standards and whether each was changed."""
    new = F.coalesce(canonical_standard(F.col(column)), F.col(column))
    return rows.withColumn("changed", ~new.eqNullSafe(F.col(column))).withColumn(column, new)


def usage(masks: DataFrame, hits: DataFrame) -> DataFrame:
    """masks with usage_count and last_used from hits (mask_id, at)."""
    seen = hits.groupBy(F.col("mask_id").alias("id")).agg(F.count("*").alias("usage_count"), F.max("at").alias("last_used"))
    return masks.join(seen, "id", "left").withColumn("usage_count", F.coalesce("usage_count", F.lit(0).cast("long")))


def verified(results: DataFrame, chosen: DataFrame) -> DataFrame:
    """results (name, ens_code, match_type, success, confidence) with the codes chosen by hand (name, ens_code) written in."""
    by = chosen.select("name", F.col("ens_code").alias("_code")).dropDuplicates(["name"])
    out = results.join(by, "name", "left").withColumn("verified", F.col("_code").isNotNull())
    pick = lambda c, v: F.when(F.col("verified"), v).otherwise(F.col(c)).alias(c)
    return out.select("name", pick("ens_code", F.col("_code")), pick("match_type", F.lit("manual_verification")), pick("success", F.lit(True)), "confidence", "verified")


def cached(items: DataFrame, store: DataFrame, now: Column, days: int = 7) -> DataFrame:
    """items (name, article) with hit and the newest stored ens_code where a result is not older than so many days; nulls are equal."""
    age = F.try_to_timestamp(F.col("updated_at").cast("string"))
    live = store.where(F.coalesce(age > now - F.expr(f"interval {days} days"), F.lit(True))).groupBy(F.col("name").alias("_n"), F.col("article").alias("_a")).agg(F.max_by("ens_code", F.struct(age, "ens_code")).alias("ens_code")).withColumn("hit", F.lit(True))
    on = items.name.eqNullSafe(F.col("_n")) & items.article.eqNullSafe(F.col("_a"))
    return items.join(live, on, "left").drop("_n", "_a").withColumn("hit", F.coalesce("hit", F.lit(False)))


def cache_stats(looked: DataFrame) -> DataFrame:
    """hits, misses, hit_rate in percent."""
    hits = F.count_if("hit")
    return looked.agg(hits.alias("hits"), (F.count("*") - hits).alias("misses"), F.round(F.coalesce(F.try_divide(hits * 100.0, F.count("*")), F.lit(0.0)), 2).alias("hit_rate"))


def served(items: DataFrame, legacy: DataFrame) -> DataFrame:
    """items (article, prompt_id) with the stored status, and whether it is served: only what is completed; errors and ignored ones are done again."""
    newest = F.col("updated_at").cast("string") if "updated_at" in legacy.columns else F.lit(None).cast("string")
    status = legacy.groupBy("article", "prompt_id").agg(F.max_by("status", F.struct(newest, "status")).alias("status"))
    return items.join(status, ["article", "prompt_id"], "left").withColumn("served", F.coalesce(F.col("status") == "completed", F.lit(False)))


def by_code(codes: DataFrame, catalogue: DataFrame) -> DataFrame:
    """code, cand_ord: the first catalogue row (code, mdm_key, cand_ord) with the code in either column."""
    either = catalogue.select("code", "cand_ord").unionByName(catalogue.select(F.col("mdm_key").alias("code"), "cand_ord")).where("code is not null")
    return codes.join(either, "code").groupBy("code").agg(F.min("cand_ord").alias("cand_ord"))


def checked_extraction(item_type: Column, std: Column, types: list[str], patterns: list[str]) -> tuple[Column, Column]:
    """Type in the spelling of the list, else with a capital; standard if it fits a pattern, else null."""
    known = F.create_map(*[x for t in types for x in (F.lit(t.lower()), F.lit(t))])
    capital = F.concat(F.upper(F.substring(item_type, 1, 1)), F.lower(F.substring(item_type, 2, 1 << 20)))
    fits = F.lit(False)
    for p in patterns:
        fits = fits | std.rlike(f"(?iu){p}")
    return F.coalesce(F.element_at(known, F.lower(item_type)), capital), F.when(fits, std)


def errors(rows: DataFrame, order: str, n: int = 20) -> DataFrame:
    """The first n failed rows."""
    return rows.where("not success").orderBy(order).limit(n)


def first_pairs(rows: DataFrame, n: int) -> DataFrame:
    """The first n distinct (std, item_type)."""
    return rows.select("std", "item_type").where("std is not null and item_type is not null").distinct().orderBy("std", "item_type").limit(n)


def parsed_json(rows: DataFrame, columns: list[str]) -> DataFrame:
    """rows with the JSON texts of columns as compact JSON; what is no JSON stays as it is, as a JSON text."""
    value = lambda c: F.coalesce(F.to_json(F.try_parse_json(F.col(c))), F.to_json(F.array(c)).substr(F.lit(2), F.length(F.to_json(F.array(c))) - 2))
    return rows.withColumns({c: F.when(F.col(c).isNotNull(), value(c)) for c in columns})


def properties(results: DataFrame) -> DataFrame:
    """results with code and title as text or null; match params only with a code."""
    code = F.nullif(F.trim(F.col("ens_code").cast("string")), F.lit(""))
    return results.withColumns({"code": code, "title": F.nullif(F.trim("ens_name"), F.lit("")), "match_params": F.when(code.isNotNull(), F.col("ens_params"))})


def audit(rows: DataFrame, prompt: Column, model: str) -> DataFrame:
    """rows with the record of their request as JSON."""
    return rows.withColumn("request", F.to_json(F.struct(F.lit(model).alias("model"), prompt.alias("prompt"), F.md5(prompt).alias("prompt_hash"))))


def registry_choice(text: Column, registries: dict[str, list[str]]) -> Column:
    """The registry with the most keywords in the text; the first of equal ones, also without any."""
    low = F.lower(text)
    scored = F.array(*[F.struct(sum((F.contains(low, F.lit(w.lower())).cast("int") for w in words), F.lit(0)).alias("n"), F.lit(-i).alias("at"), F.lit(name).alias("name")) for i, (name, words) in enumerate(registries.items())])
    return F.array_max(scored).getField("name")
