"""Queries of the matching side: extraction, masks, scores, the ladder. Each has its DuckDB oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from itemforge.functions import coating, numbers, text
from itemforge.functions.collections import as_map, cells, merged
from itemforge.operators import ladder, masks, reports, routing, scoring
from itemforge.operators.cut import cut
from itemforge.sources.tables import CATALOGUE, NAMES, catalogue, item_names

SQL_NAMES = f"WITH names AS ({NAMES.format(lineitem='lineitem', part='part')}), d AS (SELECT DISTINCT name FROM names)"
SQL_CATALOGUE = CATALOGUE.format(part="part")
#: Parsed names: kind as in the catalogue, values of the masks' groups.
SQL_PARSED = (
    SQL_NAMES
    + r""", p AS (SELECT name, CASE WHEN name LIKE 'Болт%' THEN 0 WHEN name LIKE 'Винт%' THEN 1 WHEN name LIKE 'Шайба%' THEN 2 END AS kind,
  nullif(regexp_extract(name, '^Болт \((\d)\)', 1), '') AS execution,
  CASE WHEN name LIKE 'Болт%' THEN regexp_extract(name, '^Болт \(\d\)-(\d+)', 1) WHEN name LIKE 'Винт%' THEN regexp_extract(name, '^Винт М(\d+)', 1) WHEN name LIKE 'Шайба%' THEN regexp_extract(name, '^Шайба (\d+)', 1) END AS size,
  CASE WHEN name LIKE 'Болт%' THEN regexp_extract(name, '^Болт \(\d\)-\d+-(\d+)', 1) WHEN name LIKE 'Винт%' THEN regexp_extract(name, '^Винт М\d+х(\d+)', 1) WHEN name LIKE 'Шайба%' THEN regexp_extract(name, '^Шайба \d+-(\d+)', 1) END AS length,
  CASE WHEN name LIKE 'Болт%' THEN 'Кд' WHEN name LIKE 'Шайба%' THEN 'Кд.фос' END AS coating FROM d),
cat AS ("""
    + SQL_CATALOGUE
    + """), c AS (SELECT kind, CASE WHEN kind = 0 THEN execution END AS execution, size, length, min(ens_code) AS ens_code, min_by(cand_name, ens_code) AS cand_name FROM cat GROUP BY ALL),
s AS (SELECT p.name, c.ens_code, c.cand_name, p.size AS p_size, c.size AS c_size, p.length AS p_length, c.length AS c_length,
  (0.0 + CASE WHEN p.kind <> 0 THEN 0.0 WHEN p.execution = CAST(c.execution AS string) THEN 1.0 WHEN p.execution IN (CAST(c.size AS string), CAST(c.length AS string)) THEN 0.5 ELSE 0.0 END
   + CASE WHEN p.size = CAST(c.size AS string) THEN 1.0 WHEN p.size IN (CAST(c.execution AS string), CAST(c.length AS string)) THEN 0.5 ELSE 0.0 END
   + CASE WHEN p.length = CAST(c.length AS string) THEN 1.0 WHEN p.length IN (CAST(c.execution AS string), CAST(c.size AS string)) THEN 0.5 ELSE 0.0 END
   + CASE WHEN p.kind = 1 THEN 0.0 ELSE 2.0 END)::double AS gain,
  CASE WHEN p.kind = 1 THEN 0.0 ELSE 0.02 END::double AS bonus, CASE p.kind WHEN 0 THEN 5.0 WHEN 1 THEN 2.0 ELSE 4.0 END::double AS total,
  CAST(CASE WHEN p.kind = 0 AND p.execution = CAST(c.execution AS string) THEN 1 ELSE 0 END + CASE WHEN p.size = CAST(c.size AS string) THEN 1 ELSE 0 END + CASE WHEN p.length = CAST(c.length AS string) THEN 1 ELSE 0 END + CASE WHEN p.kind = 1 THEN 0 ELSE 1 END AS int) AS exact_count
  FROM p JOIN c ON p.kind = c.kind),
r AS (SELECT *, (gain + bonus) / total AS score, row_number() OVER (PARTITION BY name ORDER BY (gain + bonus) / total DESC, exact_count DESC, ens_code) AS rank FROM s WHERE gain + bonus > 0)
"""
)


def _distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return item_names(spark, sf_dir).select("name").distinct()


def _parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = masks.seed_masks(spark)
    return masks.parse(masks.attach_masks(ladder.extract(cut(_distinct(spark, sf_dir), "names")), rules), rules, "clean")


def std_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _distinct(spark, sf_dir).select("name", text.standard(F.col("name")).alias("s"))
    return found.select("name", F.col("s.type").alias("std_type"), F.col("s.number").alias("std_number"), F.col("s.year").alias("std_year"), F.col("s.start").cast("long").alias("std_start"))


def item_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return item_names(spark, sf_dir).groupBy("name").count().select(text.item_type(F.col("name")).alias("item_type"), "count").groupBy("item_type").agg(F.sum("count").alias("n"))


def std_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ladder.extract(_distinct(spark, sf_dir)).groupBy("std").agg(F.count("*").alias("n"))


def std_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = item_names(spark, sf_dir).groupBy("name").count().select(text.standard(F.col("name")).type.alias("kind"), "count")
    return per.groupBy("kind").agg(F.sum("count").alias("n"))


def clean_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    clean = text.clean_input(F.col("name"))
    return _distinct(spark, sf_dir).select("name", clean.alias("clean"), text.name_key(clean).alias("key"), F.md5(clean).alias("hash"))


def mask_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return masks.attach_masks(ladder.extract(_distinct(spark, sf_dir)), masks.seed_masks(spark)).groupBy("mask_id").agg(F.count("*").alias("n"))


def mask_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parsed(spark, sf_dir).select("name", F.inline("params")).withColumnsRenamed({"k": "param", "v": "value"})


def mask_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules, cat = masks.seed_masks(spark), catalogue(spark, sf_dir)
    rows = masks.parse(masks.attach_masks(cat, rules), rules, "cand_name").select("mask_id", "params", F.col("attrs").alias("expected"))
    return masks.validate(rows).select("mask_id", "total", "matched", "score", "band")


def mask_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return masks.stats(masks.cleanup(masks.seed_masks(spark)))


def exact_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ladder.exact_names(ladder.extract(_distinct(spark, sf_dir)), catalogue(spark, sf_dir)).select("name", "ens_code", F.col("cand_name").alias("ens_name"))


def _best(spark: SparkSession, sf_dir: str, n: int = 1) -> DataFrame:
    keys = masks.param_names(masks.seed_masks(spark))
    return ladder.best_candidates(_parsed(spark, sf_dir).where("params is not null").select("name", "std", "item_type", "params"), ladder.Index(catalogue(spark, sf_dir), keys, n), n)


def fuzzy_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _best(spark, sf_dir).select("name", "ens_code", "score", "exact_count")


def fuzzy_top5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _best(spark, sf_dir, 5).select("name", "ens_code", F.col("rank").cast("long").alias("rank"), "score")


def match_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ladder.match(_distinct(spark, sf_dir), masks.seed_masks(spark), catalogue(spark, sf_dir))
    return found.select("name", "match_type", "ens_code", "confidence", "success")


def quality_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = item_names(spark, sf_dir).groupBy("name").count()
    found = ladder.exact_names(ladder.extract(rows.select("name")), catalogue(spark, sf_dir)).select("name", "ens_code", F.col("attrs").alias("ens"))
    facts = _parsed(spark, sf_dir).join(found, "name", "left").select("name", "item_type", "std", F.col("ens_code").isNotNull().alias("has_code"), (F.coalesce(F.size("params"), F.lit(0)) > 0).alias("has_params"), F.col("ens").isNotNull().alias("has_ens_params"))
    return reports.quality(item_names(spark, sf_dir).join(facts, "name"))


def coating_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = F.col("coating")
    rows = _parsed(spark, sf_dir).select(F.get(F.filter("params", lambda e: e.k == "покрытие"), 0).v.alias("coating")).distinct()
    return rows.select("coating", coating.canonical(value).alias("canonical"), coating.normalize(value).alias("normalized"), text.token_similarity(value, F.lit("Кд")).alias("similarity"), F.size(coating.variants(value)).cast("long").alias("n_variants"), coating.substituted(F.lit("Д1П"), value).alias("substituted"))


def param_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _best(spark, sf_dir).groupBy(scoring.check_status(as_map(F.col("params")), as_map(F.col("attrs"))).alias("status")).agg(F.count("*").alias("n"))


def normalizer(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _parsed(spark, sf_dir).where("params is not null").select("name", F.explode(numbers.normalized(as_map(F.col("params")), F.col("std"))).alias("param", "value"))
    return rows


def param_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    more = F.create_map(F.lit("покрытие"), F.lit("Бп"))
    rows = _parsed(spark, sf_dir).where("params is not null")
    return rows.select("name", cells(F.col("params")).alias("cell"), F.element_at(merged(as_map(F.col("params")), more), "покрытие").alias("coating"))


def keyword_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = routing.detect(F.col("name"), routing.PROMPTS)
    return _distinct(spark, sf_dir).select("name", routing.route(F.col("name"), routing.PROMPTS).alias("prompt"), F.size(routing.matches(F.col("name"), routing.PROMPTS)).cast("long").alias("n_prompts"), found.kind.alias("kind"), found.score.cast("long").alias("points"), found.confidence.alias("confidence"))


def number_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.col("name")
    return _distinct(spark, sf_dir).select("name", text.without_standard(name).isNotNull().alias("named"), numbers.first_number(name).alias("first_number"), F.size(text.number_tokens(name)).cast("long").alias("n_numbers"), text.snippet(name, F.lit("кд")).alias("snippet"))


def values_equal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes of parts against catalogue lengths, as texts."""
    rows = catalogue(spark, sf_dir).select(F.get("attrs", F.size("attrs") - 2).v.alias("a"), F.get("attrs", 0).v.alias("b")).distinct()
    return rows.select("a", "b", numbers.lenient_equal(F.col("a"), F.concat("b", F.lit(",0"))).alias("lenient"), numbers.composite_equal(F.col("a"), F.col("b")).alias("composite"))


QUERIES = {f.__name__: f for f in (std_extract, item_types, std_canonical, std_coverage, clean_names, mask_lookup, mask_parse, mask_validate, mask_stats, exact_name, fuzzy_best, fuzzy_top5, match_ladder, quality_report, coating_forms, param_check, normalizer, param_cells, keyword_route, number_values, values_equal)}

_KIND = "CASE WHEN name LIKE 'Болт%' THEN 'болт' WHEN name LIKE 'Винт%' THEN 'винт' WHEN name LIKE 'Шайба%' THEN 'шайба' ELSE 'гайка' END"
_STD = "CASE WHEN name LIKE 'Болт%' THEN 'ОСТ 1 31133-80' WHEN name LIKE 'Винт%' THEN 'ГОСТ 17475-80' WHEN name LIKE 'Шайба%' THEN 'ОСТ 1 34505-80' END"
_EXACT = SQL_PARSED + ", e AS (SELECT p.name, c.ens_code, c.cand_name FROM p JOIN c ON p.kind = c.kind AND (p.kind <> 0 OR p.execution = CAST(c.execution AS string)) AND p.size = CAST(c.size AS string) AND p.length = CAST(c.length AS string))"
ORACLES = {
    "std_extract": SQL_NAMES
    + r""" SELECT name, CASE WHEN name LIKE '%ГОСТ%' THEN 'ГОСТ' WHEN name LIKE '%ОСТ%' THEN 'ОСТ' END AS std_type,
      CASE WHEN name LIKE '%ГОСТ%' THEN regexp_extract(name, 'ГОСТ\s*(\d+)-(\d+)', 1) WHEN name LIKE '%ОСТ%' THEN concat(regexp_extract(name, 'ОСТ\s*(\d+)\s*(\d+)-(\d+)', 1), ' ', regexp_extract(name, 'ОСТ\s*(\d+)\s*(\d+)-(\d+)', 2)) END AS std_number,
      CASE WHEN name LIKE '%ОСТ%' THEN regexp_extract(name, '-(\d+),?$', 1) END AS std_year,
      CASE WHEN name LIKE '%ГОСТ%' THEN instr(name, 'ГОСТ') - 1 WHEN name LIKE '%ОСТ%' THEN instr(name, 'ОСТ') - 1 END::bigint AS std_start FROM d""",
    "item_types": SQL_NAMES + f" SELECT {_KIND} AS item_type, count(*) AS n FROM names GROUP BY 1",
    "std_canonical": SQL_NAMES + f" SELECT {_STD} AS std, count(*) AS n FROM d GROUP BY 1",
    "std_coverage": SQL_NAMES + " SELECT CASE WHEN name LIKE '%ГОСТ%' THEN 'ГОСТ' WHEN name LIKE '%ОСТ%' THEN 'ОСТ' END AS kind, count(*) AS n FROM names GROUP BY 1",
    "clean_names": SQL_NAMES
    + r""", k AS (SELECT name, regexp_replace(rtrim(name, ',.;: '), '(^|[^\p{L}])М([0-9])', '\1M\2') AS clean FROM d)
      SELECT name, clean, replace(lower(clean), ' ', '') AS key, md5(clean) AS hash FROM k""",
    "mask_lookup": SQL_NAMES + " SELECT CASE WHEN name LIKE 'Болт%' THEN 1 WHEN name LIKE 'Винт%' THEN 2 WHEN name LIKE 'Шайба%' THEN 3 END::bigint AS mask_id, count(*) AS n FROM d GROUP BY 1",
    "mask_parse": SQL_PARSED
    + """ SELECT name, 'исполнение' AS param, execution AS value FROM p WHERE execution IS NOT NULL UNION ALL SELECT name, 'диаметр', size FROM p WHERE kind IS NOT NULL
      UNION ALL SELECT name, 'длина', length FROM p WHERE kind IS NOT NULL UNION ALL SELECT name, 'покрытие', coating FROM p WHERE coating IS NOT NULL""",
    "mask_validate": f"WITH cat AS ({SQL_CATALOGUE}) SELECT (kind + 1)::bigint AS mask_id, count(*) AS total, count(*) AS matched, 1.0::double AS score, 'active' AS band FROM cat GROUP BY kind",
    "mask_stats": "SELECT 4::bigint AS total, 4::bigint AS active, 0::bigint AS inactive, 1.0::double AS avg_score",
    "exact_name": _EXACT + " SELECT name, ens_code, cand_name AS ens_name FROM e",
    "fuzzy_best": SQL_PARSED + " SELECT name, ens_code, score, exact_count FROM r WHERE rank = 1",
    "fuzzy_top5": SQL_PARSED + " SELECT name, ens_code, rank, score FROM r WHERE rank <= 5",
    "match_ladder": _EXACT
    + """, l AS (SELECT r.*, p.kind, p.execution AS p_execution, p.size AS a, p.length AS b, abs(p.length::double - c_length::double) AS diff, c_length::double AS most FROM r JOIN p USING (name) WHERE rank = 1)
      SELECT d.name, CASE WHEN e.name IS NOT NULL THEN 'exact_name' WHEN l.name IS NOT NULL THEN 'fuzzy' END AS match_type, coalesce(e.ens_code, l.ens_code) AS ens_code,
        CASE WHEN e.name IS NOT NULL THEN 1.0 WHEN l.name IS NOT NULL THEN least(round_even(l.score, 3), 1.0) ELSE 0.0 END::double AS confidence,
        CASE WHEN e.name IS NOT NULL THEN true WHEN l.name IS NULL THEN false ELSE round_even(l.score, 3) >= 0.7 AND l.p_size = CAST(l.c_size AS string) AND (l.p_length = CAST(l.c_length AS string) OR (diff < 20 AND diff / most < 0.10))
          AND (l.kind <> 0 OR l.p_execution = regexp_extract(l.cand_name, '\\((\\d)\\)', 1)) END AS success
      FROM d LEFT JOIN e ON e.name = d.name LEFT JOIN l ON l.name = d.name""".replace("\\\\", "\\"),
    "quality_report": _EXACT
    + f""", f AS (SELECT n.name, {_KIND.replace("name", "n.name")} AS item_type, coalesce({_STD.replace("name", "n.name")}, '(не определен)') AS std, e.name IS NOT NULL AS has_code, n.name NOT LIKE 'Гайка%' AS has_params FROM names n LEFT JOIN e ON e.name = n.name)
      SELECT CASE WHEN grouping(item_type) = 1 THEN 'ИТОГО' ELSE item_type END AS item_type, CASE WHEN grouping(std) = 1 THEN '' ELSE std END AS std, count(*) AS total, count_if(has_code)::bigint AS code_found, count_if(has_params)::bigint AS params_parsed,
        count_if(has_code)::bigint AS ens_params_parsed, count_if(has_code AND has_params)::bigint AS both_found, count_if(has_code) * 100.0::double / count(*) AS code_percent, count_if(has_params) * 100.0::double / count(*) AS params_percent
      FROM f GROUP BY GROUPING SETS ((item_type, std), ())""",
    "coating_forms": """SELECT * FROM (VALUES (NULL, 'Бп', NULL, 0.0::double, 1::bigint, NULL), ('Кд', 'Кд', 'Кд', 1.0::double, 8::bigint, 'Ан.Окс'), ('Кд.фос', 'Кд.фос', NULL, 0.5::double, 1::bigint, 'Ан.Окс')) t(coating, canonical, normalized, similarity, n_variants, substituted)""",
    "param_check": _EXACT + " SELECT CASE WHEN e.name IS NOT NULL THEN 'full_match' ELSE 'mismatch' END AS status, count(*) AS n FROM r LEFT JOIN e ON e.name = r.name WHERE r.rank = 1 GROUP BY 1",
    "normalizer": SQL_PARSED
    + """ SELECT name, 'исполнение' AS param, concat(execution, '.0') AS value FROM p WHERE execution IS NOT NULL UNION ALL SELECT name, 'диаметр', size FROM p WHERE kind IS NOT NULL
      UNION ALL SELECT name, 'длина', length FROM p WHERE kind IS NOT NULL UNION ALL SELECT name, 'покрытие', coating FROM p WHERE coating IS NOT NULL""",
    "param_cells": SQL_PARSED
    + r""" SELECT name, concat_ws(chr(10), CASE WHEN execution IS NOT NULL THEN concat('исполнение=', execution) END, concat('диаметр=', size), concat('длина=', length), CASE WHEN coating IS NOT NULL THEN concat('покрытие=', coating) END) AS cell,
      coalesce(coating, 'Бп') AS coating FROM p WHERE kind IS NOT NULL""",
    "keyword_route": SQL_NAMES + " SELECT name, 'hardware' AS prompt, 1::bigint AS n_prompts, 'hardware' AS kind, 2::bigint AS points, 0.4::double AS confidence FROM d",
    "number_values": SQL_NAMES
    + r""" SELECT name, true AS named, nullif(regexp_extract(name, '[0-9]+[.]?[0-9]*'), '') AS first_number,
      len(list_filter(string_split_regex(regexp_replace(lower(name), '(гост|ост)\s*[0-9][0-9 .\-]*', ' '), '[^0-9.]+'), lambda x: x <> ''))::bigint AS n_numbers,
      CASE WHEN instr(lower(name), 'кд') > 0 THEN substr(name, greatest(1, instr(lower(name), 'кд') - 3), instr(lower(name), 'кд') - greatest(1, instr(lower(name), 'кд') - 3) + 5) END AS snippet FROM d""",
    "values_equal": f"""WITH cat AS ({SQL_CATALOGUE}), v AS (SELECT DISTINCT CASE kind WHEN 0 THEN CAST(size AS string) WHEN 1 THEN CAST(size AS string) ELSE CAST(size AS string) END AS x, CAST(length AS string) AS y, CAST(execution AS string) AS z, kind FROM cat),
      w AS (SELECT DISTINCT CASE kind WHEN 0 THEN y WHEN 1 THEN x ELSE y END AS a, CASE kind WHEN 0 THEN z ELSE x END AS b FROM v) SELECT a, b, a = b AS lenient, starts_with(a, b) OR starts_with(b, a) AS composite FROM w""",
}
