"""Queries of outputs, the index, the result store, replies and mask statistics, each with its DuckDB oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from itemforge.operators import index, ladder, masks, maskstats, output, patterns, profile, replies, store
from itemforge.plans import matching
from itemforge.plans import store as profiled
from itemforge.sources import config
from itemforge.sources.tables import catalogue, table


def _matched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ladder.match(matching._distinct(spark, sf_dir), masks.seed_masks(spark), catalogue(spark, sf_dir))


def _params(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching._parsed(spark, sf_dir).where("params is not null")


def batch_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = output.result_rows(matching._distinct(spark, sf_dir), _matched(spark, sf_dir), masks.seed_masks(spark))
    return rows.select("name", "ens_code_out", "recognised", "confidence_out", "match_kind", "level_out", "mask_known")


def batch_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = output.json_rows(_matched(spark, sf_dir).select("name", "match_type", "success", "score"))
    return rows.select("name", F.get_json_object("json", "$.match_type").alias("match_type"), F.get_json_object("json", "$.success").alias("success"))


def batch_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return output.totals(_matched(spark, sf_dir), success_only=True)


def result_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("article"), F.col("event_type").alias("prompt_id"), F.col("event_type").alias("category"), F.col("props").alias("data"))
    every = [output.exported(rows, s).select(F.lit(s).alias("structure"), "key", F.coalesce(F.json_array_length("json"), F.lit(1)).cast("long").alias("n")) for s in ("by_code", "by_category", "by_prompt")]
    return every[0].unionByName(every[1]).unionByName(every[2])


def verified_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("event_id").cast("string").alias("name"), F.col("event_type").alias("ens_code"), F.lit("fuzzy").alias("match_type"), (F.col("value") > 50).alias("success"), F.col("value").alias("confidence"))
    chosen = e.where("name like '%7'").select("name", F.concat(F.lit("code-"), "name").alias("ens_code"))
    return store.verified(e, chosen)


def cached_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    kept = e.where("event_type <> 'click'").groupBy(F.col("user_id").alias("name"), F.col("event_type").alias("article")).agg(F.max("ts").alias("updated_at"), F.max("event_id").alias("ens_code"))
    items = e.select(F.col("user_id").alias("name"), F.col("event_type").alias("article")).distinct()
    return store.cache_stats(store.cached(items, kept, F.lit("2024-01-20 00:00:00").cast("timestamp"), 7))


def codes_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("code"), F.col("p_size").cast("string").alias("mdm_key"), F.col("p_partkey").alias("cand_ord"))
    return store.by_code(table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("code")).distinct(), rows)


def index_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.summary(catalogue(spark, sf_dir))


def index_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    built = index.build(catalogue(spark, sf_dir), "крепёж")
    return index.info(built.select("std", "item_type", F.inline("examples")), 10)


def first_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.first_examples(catalogue(spark, sf_dir), 5).select("std", "ens_code", F.col("rank").cast("long").alias("rank"))


def twin_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copies of the status of orders and of the priority; their values are not in the clerk's name."""
    wide = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", F.col("o_orderstatus").alias("copy_a"), F.col("o_orderstatus").alias("copy_b"), "o_orderpriority", F.col("o_orderpriority").alias("zz"))
    long = profile.melt(wide, ["o_orderkey"], wide.columns[1:]).withColumn("grp", F.lit("orders"))
    counts = long.groupBy("grp", "field").agg(F.count_if(F.col("value") == "F").alias("visible_count"))
    found = index.twin_groups(profile.twin_pairs(long, ["grp"], ["o_orderkey"]), counts, ["grp"])
    return found.select("canonical", F.array_join("members", ",").alias("members"))


def resolved_twins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statuses of which a twin field alone has some, under one name."""
    wide = table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderstatus")).alias("a"), F.upper("o_orderpriority").alias("b"))
    long = profile.melt(wide, ["o_orderkey"], ["a", "b"]).withColumn("grp", F.lit(1)).withColumn("ord", F.when(F.col("field") == "a", 0).otherwise(1))
    twins = spark.range(1).select(F.lit(1).alias("grp"), F.lit("a").alias("canonical"), F.array(F.lit("a"), F.lit("b")).alias("members"))
    return index.resolve_twins(long, twins, ["grp"], ["o_orderkey"], "ord").select("o_orderkey", "field", "value")


def field_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = profile.visible(profiled._long(spark, sf_dir), ["grp"])
    return index.field_meta(seen, ["grp"], ["p_brand"]).select("grp", F.array_join("visible", ",").alias("visible"), F.array_join("metadata", ",").alias("metadata"), "n_fields")


def remapped_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    renamed = patterns.remapped(F.col("params"), {"длина": ["length", "l"], "диаметр": ["d"], "исполнение": ["d"]})
    return _params(spark, sf_dir).select("name", F.inline(renamed)).withColumnsRenamed({"k": "param", "v": "value"})


def validation_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalogue's names against its attributes, the execution taken away from some."""
    rules, cat = masks.seed_masks(spark), catalogue(spark, sf_dir)
    rows = masks.parse(masks.attach_masks(cat, rules), rules, "cand_name")
    fewer = F.filter("attrs", lambda e: ~((e.k == "исполнение") & (F.col("ens_code") % 2 == 0)))
    found = patterns.cells(rows.select(F.col("ens_code").alias("example"), "params", fewer.alias("expected")), ["покрытие"])
    return found.groupBy("param", "cell").agg(F.count("*").alias("n"))


def paren_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _params(spark, sf_dir).select("name", "std", F.inline("params")).withColumnsRenamed({"k": "param", "v": "value"})
    return maskstats.parentheses(rows.where("param = 'исполнение'"), ["std"])


def letter_m(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = matching._distinct(spark, sf_dir).withColumn("coating", F.when(F.contains("name", F.lit("Brand#1")), "М"))
    return maskstats.letter_m(rows.withColumn("kind", F.substring("name", 1, 4)), ["kind"])


def shown_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = maskstats.displayed(_params(spark, sf_dir).select("name", "params"))
    return found.select("name", F.array_join("shown", ";").alias("shown"), F.size("equal").cast("long").alias("n_equal"), F.size("missing").cast("long").alias("n_missing"))


def param_frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maskstats.frequencies(_params(spark, sf_dir))


def training_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = maskstats.training_examples(_params(spark, sf_dir).select("name", "params"), 3)
    return found.select("name", F.size("entities").cast("long").alias("n"), F.get("entities", F.lit(0)).label.alias("first_label"))


def error_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", "event_type", (F.col("event_type") != "error").alias("success"))
    return store.errors(e, "event_id", 20).select("event_id", "event_type")


def extraction_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ladder.extract(matching._distinct(spark, sf_dir))
    kind, std = store.checked_extraction(F.col("item_type"), F.col("std"), ["БОЛТ", "Шайба"], [r"^ОСТ\s*1\s*\d+-\d+$"])
    return found.select("name", kind.alias("item_type"), std.alias("std"))


def latin_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    word = F.substring_index("name", " ", 1)
    return matching._distinct(spark, sf_dir).groupBy(config.transliterated_column(word).alias("latin")).agg(F.count("*").alias("n"))


def prompt_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", replies.fill(F.lit("Item {name}, size {size}{note}."), {"name": F.col("p_name"), "size": F.col("p_size"), "note": F.lit(None).cast("string")}).alias("prompt"))


def mask_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = masks.attach_masks(ladder.extract(matching._distinct(spark, sf_dir)), masks.seed_masks(spark)).select("mask_id", F.lit("2024-02-01").cast("timestamp").alias("at"))
    return store.usage(masks.seed_masks(spark), hits).select("id", "usage_count", F.col("last_used").isNotNull().alias("used"))


def reply_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Properties of events as replies: fenced, in a sentence, as they are, and without JSON."""
    told = F.when(F.col("event_id") % 4 == 0, F.concat(F.lit("Here:\n```json\n"), "props", F.lit("\n```\nDone."))).when(F.col("event_id") % 4 == 1, F.concat(F.lit("It is "), "props", F.lit(" as asked."))).when(F.col("event_id") % 4 == 2, F.col("props")).otherwise(F.lit("I can't say."))
    found = replies.parsed(table(spark, sf_dir, "events").select("event_id", told.alias("reply")))
    return found.select("event_id", F.size(F.json_object_keys("json")).cast("long").alias("n_keys")).where("n_keys > 0")


def registry_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    registries = {"metal": ["steel", "copper"], "light": ["light", "pale", "white"]}
    return table(spark, sf_dir, "part").groupBy(store.registry_choice(F.col("p_name"), registries).alias("registry")).agg(F.count("*").alias("n"))


def top_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = matching.fuzzy_top5(spark, sf_dir)
    found = output.candidates(ranked)
    return found.select("name", F.size("candidates").cast("long").alias("n"), F.get("candidates", F.lit(0)).ens_code.alias("ens_code"))


def sample_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.samples(table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey"), "n_nationkey")


def migrated_standards(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = ladder.extract(matching._distinct(spark, sf_dir)).groupBy("std").count().select(F.regexp_replace("std", "^ОСТ 1 ", "ОСТ1 ").alias("standard")).where("standard is not null")
    return store.migrate_standards(raw)


QUERIES = {
    f.__name__: f
    for f in (
        batch_output, batch_json, batch_totals, result_export, verified_results, cached_results, codes_lookup, index_summary, index_top, first_examples, twin_groups, resolved_twins, field_meta, remapped_params,
        validation_cells, paren_stats, letter_m, shown_params, param_frequencies, training_spans, error_report, extraction_checks, latin_words, prompt_texts, mask_usage, reply_texts, registry_choice, top_candidates,
        sample_columns, migrated_standards,
    )
}

_MATCH = f"({matching.ORACLES['match_ladder']}) m"
_NAMES, _PARSED, _CATALOGUE = matching.SQL_NAMES, matching.SQL_PARSED, matching.SQL_CATALOGUE
_PARAMS = """SELECT name, 0 AS i, 'исполнение' AS k, execution AS v FROM p WHERE execution IS NOT NULL UNION ALL SELECT name, 1, 'диаметр', size FROM p WHERE kind IS NOT NULL
  UNION ALL SELECT name, 2, 'длина', length FROM p WHERE kind IS NOT NULL UNION ALL SELECT name, 3, 'покрытие', coating FROM p WHERE coating IS NOT NULL"""
ORACLES = {
    "batch_output": f"""SELECT name, coalesce(CAST(ens_code AS string), '') AS ens_code_out, CASE WHEN success THEN 'Да' ELSE 'Нет' END AS recognised, round(confidence, 3) AS confidence_out,
      CASE match_type WHEN 'exact_name' THEN 'Точное совпадение по наименованию' WHEN 'fuzzy' THEN 'Нечеткое совпадение' ELSE 'Не определено' END AS match_kind,
      CASE WHEN name LIKE 'Гайка%' THEN 'llm_direct' ELSE 'catalogue' END AS level_out, CASE WHEN name LIKE 'Гайка%' THEN 'Нет' ELSE 'Да' END AS mask_known FROM {_MATCH}""",
    "batch_json": f"SELECT name, match_type, CAST(success AS string) AS success FROM {_MATCH}",
    "batch_totals": f"SELECT count(*) AS total, count_if(success)::bigint AS success, count_if(NOT success)::bigint AS failed, count_if(success)::bigint AS written, round(count_if(success) * 100.0::double / count(*), 2) AS success_percent FROM {_MATCH}",
    "result_export": "SELECT 'by_code' AS structure, CAST(user_id AS string) AS key, count(*) AS n FROM events GROUP BY ALL UNION ALL SELECT 'by_category', event_type, count(*) FROM events GROUP BY ALL UNION ALL SELECT 'by_prompt', event_type, count(*) FROM events GROUP BY ALL",
    "verified_results": """SELECT CAST(event_id AS string) AS name, CASE WHEN event_id % 10 = 7 THEN concat('code-', event_id) ELSE event_type END AS ens_code, CASE WHEN event_id % 10 = 7 THEN 'manual_verification' ELSE 'fuzzy' END AS match_type,
      event_id % 10 = 7 OR value > 50 AS success, value AS confidence, event_id % 10 = 7 AS verified FROM events""",
    "cached_results": """WITH i AS (SELECT DISTINCT user_id, event_type FROM events), k AS (SELECT user_id, event_type, max(ts) AS t FROM events WHERE event_type <> 'click' GROUP BY ALL),
      h AS (SELECT i.user_id, coalesce(k.t > TIMESTAMP '2024-01-13 00:00:00', false) AS hit FROM i LEFT JOIN k USING (user_id, event_type))
      SELECT count_if(hit)::bigint AS hits, count_if(NOT hit)::bigint AS misses, round(count_if(hit) * 100.0::double / count(*), 2) AS hit_rate FROM h""",
    "codes_lookup": """WITH c AS (SELECT CAST(p_partkey AS string) AS code, p_partkey AS o FROM part UNION ALL SELECT CAST(p_size AS string), p_partkey FROM part)
      SELECT code, min(o) AS cand_ord FROM c WHERE code IN (SELECT CAST(o_orderkey AS string) FROM orders) GROUP BY code""",
    "index_summary": f"WITH cat AS ({_CATALOGUE}) SELECT count(DISTINCT kind) AS pairs, count(*) AS examples, (count(*) // count(DISTINCT kind))::bigint AS per_pair FROM cat",
    "index_top": f"WITH cat AS ({_CATALOGUE}) SELECT CASE kind WHEN 0 THEN 'ОСТ 1 31133-80' WHEN 1 THEN 'ГОСТ 17475-80' ELSE 'ОСТ 1 34505-80' END AS std, 1::bigint AS n_types, count(*) AS n_examples FROM cat GROUP BY kind",
    "first_examples": f"WITH cat AS ({_CATALOGUE}), r AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY ens_code) AS rank FROM cat) SELECT CASE kind WHEN 0 THEN 'ОСТ 1 31133-80' WHEN 1 THEN 'ГОСТ 17475-80' ELSE 'ОСТ 1 34505-80' END AS std, ens_code, rank FROM r WHERE rank <= 5",
    "twin_groups": "SELECT * FROM (VALUES ('copy_a', 'copy_a,copy_b,o_orderstatus'), ('o_orderpriority', 'o_orderpriority,zz')) t(canonical, members) WHERE EXISTS (SELECT 1 FROM orders)",
    "resolved_twins": "SELECT o_orderkey, 'a' AS field, CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus ELSE upper(o_orderpriority) END AS value FROM orders",
    "field_meta": profiled._VISIBLE
    + " SELECT grp, coalesce(string_agg(field, ',' ORDER BY field) FILTER (visible_count > 0 AND field <> 'p_brand'), '') AS visible, coalesce(string_agg(field, ',' ORDER BY field) FILTER (field = 'p_brand'), '') AS metadata, count(*) AS n_fields FROM g GROUP BY grp",
    "remapped_params": _PARSED
    + f""", a AS ({_PARAMS}), b AS (SELECT name, i, CASE k WHEN 'исполнение' THEN ['d'] WHEN 'диаметр' THEN ['d'] WHEN 'длина' THEN ['length', 'l'] ELSE [k] END AS ks, v FROM a), u AS (SELECT name, i, unnest(ks) AS param, v FROM b)
      SELECT name, param, arg_max(v, i) AS value FROM u GROUP BY ALL""",
    "validation_cells": f"""WITH cat AS ({_CATALOGUE}) SELECT 'диаметр' AS param, '=' AS cell, count(*) AS n FROM cat UNION ALL SELECT 'длина', '=', count(*) FROM cat
      UNION ALL SELECT 'исполнение', CASE WHEN ens_code % 2 = 0 THEN '~' ELSE '=' END, count(*) FROM cat WHERE kind = 0 GROUP BY 2""",
    "paren_stats": _PARSED
    + """ SELECT 'ОСТ 1 31133-80' AS std, 'исполнение' AS param, count_if(contains(name, concat('(', execution, ')')))::bigint AS paren, count_if(NOT contains(name, concat('(', execution, ')')))::bigint AS bare, 'paren' AS verdict FROM p WHERE execution IS NOT NULL""",
    "letter_m": _NAMES + r" SELECT substr(name, 1, 4) AS kind, count_if(regexp_matches(name, ' М\d'))::bigint AS as_prefix, count_if(contains(name, 'Brand#1'))::bigint AS as_coating FROM d GROUP BY 1",
    "shown_params": _PARSED
    + f""", a AS ({_PARAMS}), b AS (SELECT name, i, k, v, instr(lower(name), lower(v)) AS spot, count(*) OVER (PARTITION BY name, v) AS same FROM a)
      SELECT name, string_agg(concat(k, '=', v), ';' ORDER BY spot, k) FILTER (spot > 0) AS shown, count_if(same > 1)::bigint AS n_equal, count_if(spot = 0)::bigint AS n_missing FROM b GROUP BY name""",
    "param_frequencies": _PARSED + f", a AS ({_PARAMS}) SELECT k AS param, count(*) AS n FROM a GROUP BY 1",
    "training_spans": _PARSED
    + f""", a AS ({_PARAMS}), b AS (SELECT name, k, instr(lower(name), lower(v)) - 1 AS spot, instr(lower(name), lower(v)) - 1 + length(v) AS to_ FROM a)
      SELECT name, count(*) AS n, arg_min(k, (spot, to_, k)) AS first_label FROM b GROUP BY name HAVING count(*) >= 3""",
    "error_report": "SELECT event_id, event_type FROM events WHERE event_type = 'error' ORDER BY event_id LIMIT 20",
    "extraction_checks": _NAMES
    + """ SELECT name, CASE WHEN name LIKE 'Болт%' THEN 'БОЛТ' WHEN name LIKE 'Винт%' THEN 'Винт' WHEN name LIKE 'Шайба%' THEN 'Шайба' ELSE 'Гайка' END AS item_type,
      CASE WHEN name LIKE 'Болт%' THEN 'ОСТ 1 31133-80' WHEN name LIKE 'Шайба%' THEN 'ОСТ 1 34505-80' END AS std FROM d""",
    "latin_words": _NAMES + " SELECT CASE substr(name, 1, 4) WHEN 'Болт' THEN 'bolt' WHEN 'Винт' THEN 'vint' WHEN 'Шайб' THEN 'shajba' ELSE 'gajka' END AS latin, count(*) AS n FROM d GROUP BY 1",
    "prompt_texts": "SELECT p_partkey, concat('Item ', p_name, ', size ', p_size, '.') AS prompt FROM part",
    "mask_usage": _NAMES
    + ", h AS (SELECT CASE WHEN name LIKE 'Болт%' THEN 1 WHEN name LIKE 'Винт%' THEN 2 WHEN name LIKE 'Шайба%' THEN 3 END AS id FROM d) SELECT t.id::bigint AS id, count(h.id) AS usage_count, count(h.id) > 0 AS used FROM (VALUES (1), (2), (3), (4)) t(id) LEFT JOIN h ON h.id = t.id GROUP BY t.id",
    "reply_texts": "SELECT event_id, len(json_keys(props))::bigint AS n_keys FROM events WHERE event_id % 4 <> 3 AND len(json_keys(props)) > 0",
    "registry_choice": """WITH s AS (SELECT contains(p_name, 'steel')::int + contains(p_name, 'copper')::int AS m, contains(p_name, 'light')::int + contains(p_name, 'pale')::int + contains(p_name, 'white')::int AS l FROM part)
      SELECT CASE WHEN l > m THEN 'light' ELSE 'metal' END AS registry, count(*) AS n FROM s GROUP BY 1""",
    "top_candidates": _PARSED + " SELECT name, count(*) AS n, arg_min(ens_code, rank) AS ens_code FROM r WHERE rank <= 5 GROUP BY name",
    "sample_columns": "SELECT 'n_nationkey' AS \"column\", CAST(min(n_nationkey) AS string) AS sample FROM nation UNION ALL SELECT 'n_name', arg_min(n_name, n_nationkey) FROM nation UNION ALL SELECT 'n_regionkey', CAST(arg_min(n_regionkey, n_nationkey) AS string) FROM nation",
    "migrated_standards": _NAMES + " SELECT DISTINCT CASE WHEN name LIKE 'Болт%' THEN 'ОСТ 1 31133-80' WHEN name LIKE 'Винт%' THEN 'ГОСТ 17475-80' ELSE 'ОСТ 1 34505-80' END AS standard, name NOT LIKE 'Винт%' AS changed FROM d WHERE name NOT LIKE 'Гайка%'",
}
