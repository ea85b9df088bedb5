"""Queries of profiling, stores, routing and reports, each with its DuckDB oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from itemforge.functions import coating
from itemforge.operators import profile, reports, routing, tfidf, upsert
from itemforge.sources.tables import catalogue, table

PART_FIELDS = ["p_name", "p_brand", "p_type", "p_size"]


def _long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts in long form; the name shows brand and size, the group is the type."""
    wide = table(spark, sf_dir, "part").withColumn("name", F.concat_ws(" ", "p_name", "p_brand", F.col("p_size").cast("string")))
    return profile.melt(wide, ["p_type", "p_partkey", "name"], PART_FIELDS).withColumnRenamed("p_type", "grp")


def field_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = profile.field_fill(_long(spark, sf_dir), ["grp"])
    return found.select("grp", "field", "total", "filled", "n_values", "percent", "band", "always_empty", "rare", "constant")


def visible_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.visible(_long(spark, sf_dir), ["grp"]).select("grp", "field", "visible_count", "total_count", "needed")


def pruned_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.prune(_long(spark, sf_dir), ["grp"], keep=["p_name"])[1]


def twin_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority", F.col("o_orderstatus").alias("status_copy"))
    long = profile.melt(wide, ["o_orderkey"], ["o_orderstatus", "o_orderpriority", "status_copy"]).withColumn("grp", F.lit("orders"))
    return profile.twin_pairs(long, ["grp"], ["o_orderkey"])


def same_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", F.upper("o_orderstatus").alias("upper_status"), "o_orderpriority")
    long = profile.melt(wide, ["o_orderkey"], ["o_orderstatus", "upper_status", "o_orderpriority"]).withColumn("grp", F.lit("orders"))
    return profile.same_values(long, ["grp"])


def min_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.large_groups(table(spark, sf_dir, "part"), ["p_brand", "p_type"], 5).groupBy("p_brand", "p_type").agg(F.count("*").alias("n"))


def index_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalogue(spark, sf_dir).groupBy("std").agg(F.countDistinct("item_type").alias("n_types"), F.count("*").alias("n_examples"))


def legacy_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.status_counts(table(spark, sf_dir, "events"), ["event_type", "user_id"])


def batch_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.agg(F.count("*").alias("total"), F.count_if(F.col("event_type") != "error").alias("success"), F.count_if(F.col("event_type") == "error").alias("failed"))


def upsert_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest event of each user and type against the oldest."""
    e = table(spark, sf_dir, "events")
    row = lambda at: e.groupBy(F.col("user_id").cast("string").alias("name"), F.col("event_type").alias("article")).agg(at("event_type", F.struct("ts", "event_id")).alias("ens_code"), at(F.col("value") > 50, F.struct("ts", "event_id")).alias("success"), at("value", F.struct("ts", "event_id")).alias("confidence"))
    return upsert.changes(row(F.min_by).where("article <> 'signup'"), row(F.max_by))


def merged_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.max("value").alias("value"))
    return upsert.merge(e.where("event_type <> 'click'"), e.where("event_type in ('click', 'view')").withColumn("value", F.col("value") + 1), ["user_id", "event_type"])


def latest_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return upsert.latest(table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "ts", "value"), ["user_id", "event_type"], "ts", ["event_id"]).select("user_id", "event_type", "event_id", "value")


def ttl_fresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    cache = table(spark, sf_dir, "events").select("event_id", F.col("ts").alias("updated_at"))
    return upsert.fresh(cache, F.lit("2024-01-20 00:00:00").cast("timestamp"), 7).select("event_id")


def pending_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    done = e.where("event_type = 'purchase'").select("user_id", F.lit("completed").alias("status"))
    return upsert.pending(e.select("user_id").distinct(), done, "user_id")


def search_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("name"), F.col("o_orderstatus").alias("status"), (F.col("o_totalprice") / 500000.0).alias("confidence"), F.col("o_orderkey").alias("updated_at"))
    return upsert.search(rows, text="1", equal={"status": "f"}, least=0.1, most=0.9, limit=20, offset=5)


def duplicate_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.duplicates(table(spark, sf_dir, "orders"), "o_custkey").select("o_orderkey", "o_custkey")


def file_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.file_statistics(table(spark, sf_dir, "orders"), "o_custkey", "o_orderpriority")


def json_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", F.from_json("props", "map<string, bigint>").alias("params"))
    return e.select("event_id", F.explode("params").alias("key", "value"))


def json_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of each conversation as one nested row."""
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("turns"))
    return c.select("conv_id", F.array_join(F.transform("turns", lambda t: F.concat(t.turn.cast("string"), F.lit(":"), t.role)), ",").alias("turns"), F.size("turns").cast("long").alias("n"))


def coating_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers' nations as materials, the last letter of the name as coating; merged with a fixed map."""
    rows = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").cast("string").alias("material"), F.expr("right(s_name, 1)").alias("coating"))
    fixed = spark.range(1).select(F.lit("0").alias("material"), F.array(F.lit("Бп")).alias("coatings"))
    return coating.merge_maps(coating.coating_map(rows).select("material", "coatings"), fixed).select("material", F.array_join("coatings", ",").alias("coatings"))


def tfidf_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "part").select(F.col("p_name").alias("id"), F.col("p_name").alias("text")).distinct()
    return tfidf.nearest(names).select("id", "other", F.round("similarity", 6).alias("similarity"))


def prompt_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    prompts = {"light": ["light", "pale", "re:^w.*e"], "metal": ["*steel*", "copper", "?tin"], "other": ["r"]}
    items = table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("text"))
    return routing.tasks(items, prompts).groupBy("prompt").agg(F.count("*").alias("n"))


QUERIES = {
    f.__name__: f
    for f in (
        field_fill, visible_fields, pruned_fields, twin_pairs, same_values, min_examples, index_info, legacy_stats, batch_stats, upsert_changes, merged_store,
        latest_per_key, ttl_fresh, pending_items, search_page, duplicate_keys, file_stats, json_params, json_export, coating_rules, tfidf_nearest, prompt_tasks,
    )
}

_LONG = """WITH w AS (SELECT p_type AS grp, p_partkey, concat_ws(' ', p_name, p_brand, CAST(p_size AS string)) AS name, p_name, p_brand, p_type, CAST(p_size AS string) AS p_size FROM part),
l AS (SELECT grp, p_partkey, name, 'p_name' AS field, p_name AS value FROM w UNION ALL SELECT grp, p_partkey, name, 'p_brand', p_brand FROM w UNION ALL SELECT grp, p_partkey, name, 'p_type', p_type FROM w UNION ALL SELECT grp, p_partkey, name, 'p_size', p_size FROM w)"""
_VISIBLE = (
    _LONG
    + r""", v AS (SELECT grp, field, contains(lower(name), lower(value)) OR len(list_filter(string_split_regex(lower(value), '[.\\-]'), lambda t: regexp_matches(t, '[a-zа-я]') AND contains(lower(name), t))) > 0
   OR (regexp_matches(lower(value), '^[a-zа-я]') AND contains(lower(name), regexp_extract(lower(value), '^([a-zа-я]+)', 1))) AS seen FROM l),
g AS (SELECT grp, field, count_if(seen)::bigint AS visible_count, count(*) AS total_count FROM v GROUP BY ALL)"""
)
_FIRST = "SELECT CAST(user_id AS string) AS name, event_type AS article, {f}(event_type, {{'t': ts, 'i': event_id}}) AS ens_code, {f}(value > 50, {{'t': ts, 'i': event_id}}) AS success, {f}(value, {{'t': ts, 'i': event_id}}) AS confidence FROM events GROUP BY 1, 2"
ORACLES = {
    "field_fill": _LONG
    + """ SELECT grp, field, count(*) AS total, count_if(value NOT IN ('', '0', '0.0', 'None'))::bigint AS filled, count(DISTINCT value) AS n_values, 100.0::double AS percent, 'full' AS band, false AS always_empty, false AS rare, count(DISTINCT value) <= 1 AS constant FROM l GROUP BY grp, field""",
    "visible_fields": _VISIBLE + " SELECT *, CASE WHEN visible_count / total_count >= 0.85 THEN 'required' WHEN visible_count / total_count >= 0.05 THEN 'optional' ELSE 'rarely' END AS needed FROM g",
    "pruned_fields": _VISIBLE
    + ", c AS (SELECT grp, field, count(DISTINCT value) AS n FROM l GROUP BY ALL) SELECT grp, field, CASE WHEN n <= 1 THEN 'constant' ELSE 'invisible' END AS reason FROM g JOIN c USING (grp, field) WHERE visible_count = 0 AND field <> 'p_name'",
    "twin_pairs": "SELECT 'orders' AS grp, 'o_orderstatus' AS field_a, 'status_copy' AS field_b, count(*) AS rows, count(*) AS equal FROM orders",
    "same_values": "SELECT 'orders' AS grp, 'o_orderstatus' AS field_a, 'upper_status' AS field_b",
    "min_examples": "SELECT p_brand, p_type, count(*) AS n FROM part GROUP BY ALL HAVING count(*) >= 5",
    "index_info": "SELECT CASE p_partkey % 3 WHEN 0 THEN 'ОСТ 1 31133-80' WHEN 1 THEN 'ГОСТ 17475-80' ELSE 'ОСТ 1 34505-80' END AS std, 1::bigint AS n_types, count(*) AS n_examples FROM part GROUP BY 1",
    "legacy_stats": "SELECT 'total' AS kind, '' AS value, count(*) AS n FROM events UNION ALL SELECT 'event_type', event_type, count(*) FROM events WHERE event_type IS NOT NULL GROUP BY 2 UNION ALL SELECT 'user_id', CAST(user_id AS string), count(*) FROM events WHERE user_id IS NOT NULL GROUP BY 2",
    "batch_stats": "SELECT count(*) AS total, count_if(event_type <> 'error')::bigint AS success, count_if(event_type = 'error')::bigint AS failed FROM events",
    "upsert_changes": f"""WITH o AS ({_FIRST.format(f="min_by")}), n AS ({_FIRST.format(f="max_by")}), b AS (SELECT n.*, o.ens_code AS c, o.success AS s, o.confidence AS f FROM n LEFT JOIN (SELECT * FROM o WHERE article <> 'signup') o ON n.name = o.name AND n.article = o.article),
      r AS (SELECT name, article, CASE WHEN c IS NULL THEN 'inserted' WHEN ens_code <> c OR success <> s OR abs(confidence - f) > 0.001 THEN 'updated' ELSE 'unchanged' END AS reason FROM b) SELECT name, article, reason <> 'unchanged' AS changed, reason FROM r""",
    "merged_store": "SELECT user_id, event_type, max(value + CASE WHEN event_type IN ('click', 'view') THEN 1 ELSE 0 END) AS value FROM events GROUP BY ALL",
    "latest_per_key": "SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1",
    "ttl_fresh": "SELECT event_id FROM events WHERE ts > TIMESTAMP '2024-01-20' - INTERVAL 7 DAY",
    "pending_items": "SELECT DISTINCT user_id FROM events WHERE user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'purchase')",
    "search_page": "SELECT CAST(o_orderkey AS string) AS name, o_orderstatus AS status, o_totalprice / 500000.0::double AS confidence, o_orderkey AS updated_at FROM orders WHERE contains(CAST(o_orderkey AS string), '1') AND lower(o_orderstatus) = 'f' AND o_totalprice / 500000.0::double BETWEEN 0.1 AND 0.9 ORDER BY o_orderkey DESC LIMIT 20 OFFSET 5",
    "duplicate_keys": "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT o_custkey FROM orders GROUP BY 1 HAVING count(*) > 1)",
    "file_stats": "SELECT count(*) AS n_rows, count(DISTINCT o_custkey) AS n_keys, count_if(o_custkey IS NULL)::bigint AS null_keys, count(DISTINCT o_orderpriority) AS n_names FROM orders",
    "json_params": "SELECT event_id, k AS key, CAST(json_extract(props, '$.' || k) AS bigint) AS value FROM (SELECT event_id, props, unnest(json_keys(props)) AS k FROM events)",
    "json_export": "SELECT conv_id, string_agg(concat(CAST(turn AS string), ':', role), ',' ORDER BY turn, role) AS turns, count(*) AS n FROM conversations GROUP BY 1",
    "coating_rules": "SELECT material, string_agg(c, ',' ORDER BY c) AS coatings FROM (SELECT DISTINCT CAST(s_nationkey AS string) AS material, right(s_name, 1) AS c FROM supplier UNION SELECT '0', 'Бп') GROUP BY 1",
    "tfidf_nearest": """WITH t AS (SELECT DISTINCT p_name AS id, lower(p_name) AS text FROM part), g AS (SELECT id, substr(text, i, n) AS gram FROM t, range(1, 40) a(i), range(2, 5) b(n) WHERE i + n - 1 <= length(text)),
      tf AS (SELECT id, gram, count(*) AS tf FROM g GROUP BY ALL), df AS (SELECT gram, count(*) AS df FROM tf GROUP BY 1), w AS (SELECT id, gram, tf * (ln((1 + (SELECT count(*) FROM t)) / (1 + df)) + 1) AS w FROM tf JOIN df USING (gram)),
      x AS (SELECT id, gram, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS w FROM w), p AS (SELECT a.id, b.id AS other, sum(a.w * b.w) AS s FROM x a JOIN x b ON a.gram = b.gram AND a.id <> b.id GROUP BY 1, 2),
      r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY round(s, 9) DESC, other) AS k FROM p) SELECT id, other, round(s, 6) AS similarity FROM r WHERE k <= 3 AND s > 0.1""",
    "prompt_tasks": """WITH h AS (SELECT p_name, contains(p_name, 'light') OR contains(p_name, 'pale') OR regexp_matches(p_name, '^w.*e') AS a, contains(p_name, 'steel') OR contains(p_name, 'copper') OR regexp_matches(p_name, '.tin') AS b, contains(p_name, 'r') AS c FROM (SELECT lower(p_name) AS p_name FROM part))
      SELECT prompt, n FROM (SELECT 'light' AS prompt, count_if(a)::bigint AS n FROM h UNION ALL SELECT 'metal', count_if(b)::bigint FROM h UNION ALL SELECT 'other', count_if(c)::bigint FROM h) WHERE n > 0""",
}
