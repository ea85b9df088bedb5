"""Queries over a catalogue with many fields: every step of the ladder, each checked by scoring all pairs in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from itemforge.operators import ladder, masks, output, validation
from itemforge.operators.cut import merged
from itemforge.sources.tables import WIDE_CATALOGUE, WIDE_EXAMPLES, WIDE_MASK, WIDE_NAMES, table, wide_catalogue, wide_names


def _matched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ladder.match(wide_names(spark, sf_dir).select("name"), masks.seed_masks(spark, [WIDE_MASK]), wide_catalogue(spark, sf_dir))


def match_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _matched(spark, sf_dir).select("name", "level", "match_type", "ens_code", "confidence", "success", "original", "corrected", "material")


def match_statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How each parameter of each name compares with the candidate found."""
    return _matched(spark, sf_dir).select("name", F.inline("detail")).select("name", F.col("k").alias("param"), F.col("v").alias("asked"), F.col("value").alias("held"), "status")


def match_proposals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest names for names of a standard that the catalogue does not have."""
    found = ladder.proposals(wide_names(spark, sf_dir).where("kind = 5"), wide_catalogue(spark, sf_dir))
    return found.select("name", F.inline("near")).select("name", F.col("rank").cast("long").alias("rank"), "ens_code", "similarity")


def _checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names against the catalogue rows that they were made from."""
    asked = spark.sql(WIDE_EXAMPLES, part=table(spark, sf_dir, "part")).select("ens_code", F.col("name").alias("text"))
    rows = asked.join(merged(wide_catalogue(spark, sf_dir).select("ens_code", "attrs")), "ens_code")
    std, item_type, pattern, params, required = WIDE_MASK
    return validation.check(rows, pattern, params, required, std, item_type)


def mask_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validation.each_result(_checked(spark, sf_dir), "ens_code", "stage", "success")


def mask_check_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validation.summary(_checked(spark, sf_dir))


def mask_diagnosis(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = masks.seed_masks(spark, [WIDE_MASK])
    names = ladder.extract(wide_names(spark, sf_dir).select("name").distinct())
    # every name meets the mask, also those of another standard
    return validation.diagnosed(names.withColumn("mask_id", F.lit(1).cast("long")), rules)


def batch_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The check of each name's parameters in the result rows, with what differs."""
    names = wide_names(spark, sf_dir).select("name").distinct()
    rows = output.result_rows(names, _matched(spark, sf_dir), masks.seed_masks(spark, [WIDE_MASK]))
    return rows.select("name", "check_status", F.when(F.col("check_status") == output.DIFFERENT, F.col("check_details")).alias("differing"), "mask_known", F.get_json_object("substitution", "$.reason").alias("reason"))


QUERIES = {f.__name__: f for f in (match_types, match_statuses, match_proposals, mask_checks, mask_check_summary, mask_diagnosis, batch_check)}

_TOKENS = "list_distinct(list_filter(list_transform(regexp_extract_all(lower({c}), '[a-zа-я0-9]+'), lambda t: regexp_replace(t, '[0-9]', '', 'g')), lambda t: t <> ''))"
_SIM = "(len(list_intersect({a}, {b}))::double / len(list_distinct(list_concat({a}, {b}))))"
_NEAR = """, gn AS (SELECT ens_code AS id, cand_name AS text FROM (SELECT cand_name, min(ens_code) AS ens_code FROM c GROUP BY 1)),
  qn AS (SELECT name AS id, name AS text FROM n WHERE kind = 5),
  gg AS (SELECT id, substr(lower(text), i, b) AS gram, count(*) AS tf FROM gn, range(1, 60) a(i), range(2, 5) b(b) WHERE i + b - 1 <= length(text) GROUP BY ALL),
  idf AS (SELECT gram, ln((1 + (SELECT count(*) FROM gn)) / (1 + count(*))) + 1 AS idf FROM gg GROUP BY gram),
  gw AS (SELECT id, gram, tf * idf / sqrt(sum((tf * idf) ** 2) OVER (PARTITION BY id)) AS w FROM gg JOIN idf USING (gram)),
  qg AS (SELECT id, substr(lower(text), i, b) AS gram, count(*) AS tf FROM qn, range(1, 60) a(i), range(2, 5) b(b) WHERE i + b - 1 <= length(text) GROUP BY ALL),
  qw AS (SELECT id, gram, tf * idf / sqrt(sum((tf * idf) ** 2) OVER (PARTITION BY id)) AS w FROM qg JOIN idf USING (gram)),
  sims AS (SELECT qw.id AS name, gw.id AS ens_code, sum(qw.w * gw.w) AS sim FROM qw JOIN gw USING (gram) GROUP BY ALL),
  near AS (SELECT name, ens_code, sim, row_number() OVER (PARTITION BY name ORDER BY round(sim, 9) DESC, ens_code) AS rank FROM sims QUALIFY rank <= 3 AND sim > 0.1)"""
_BASE = f"""WITH c AS ({WIDE_CATALOGUE.format(part="part")}), n AS (SELECT min(kind) AS kind, size, step, length, coating, name FROM ({WIDE_NAMES.format(part="part")}) GROUP BY 2, 3, 4, 5, 6),
  coats AS (SELECT DISTINCT coating FROM (SELECT coating FROM c UNION ALL SELECT coating FROM n UNION ALL SELECT unnest(['Ан.Окс', 'Н.Кд']))),
  spelled AS (SELECT coating, unnest(CASE WHEN coating = 'Кд' THEN ['Кд', 'Кд6', 'Кд9', 'Кд6.фос', 'Кд9.фос', 'Кд6.фос.окс', 'Кд9.фос.окс', 'Кд.фос.окс'] ELSE [coating] END) AS spelling FROM coats),
  tx AS (SELECT s.coating AS asked, h.coating AS held, max({_SIM.format(a=_TOKENS.format(c="spelling"), b=_TOKENS.format(c="h.coating"))}) AS sim FROM spelled s, coats h GROUP BY ALL),
  tg AS (SELECT asked, held, sim, CASE WHEN sim >= 0.5 THEN sim * 2.0 ELSE 0.0 END + (CASE WHEN sim >= 0.5 THEN 0.01 ELSE 0.0 END + CASE WHEN starts_with(lower(held), lower(asked)) THEN 0.01 ELSE 0.0 END) AS gain, CASE WHEN sim >= 0.99 THEN 1 ELSE 0 END AS same FROM tx),
  cr AS (SELECT *, list_filter(string_split_regex(regexp_replace(replace(lower(cand_name), ',', '.'), '(гост|ост|ту)\\s*[0-9][0-9\\s.\\-]*(-[0-9]+)?', '', 'g'), '[^0-9.]+'), lambda t: t <> '') AS runs FROM c),
  ex AS (SELECT n.name, min(c.ens_code) AS ens_code FROM n JOIN c ON n.name = c.cand_name WHERE kind <> 5 GROUP BY 1),
  rest AS (SELECT name, size, step, length, coating FROM n WHERE kind <> 5 AND name NOT IN (SELECT name FROM ex)),
"""


def _best(name: str, rows: str) -> str:
    num = lambda c: f"replace({c}, ',', '.')::double"
    gain = lambda c: f"CASE WHEN r.{c} IS NULL THEN 0.0 WHEN {num(f'r.{c}')} = {num(f'k.{c}')} THEN 1.0 WHEN list_contains(k.runs, replace(r.{c}, ',', '.')) THEN 0.5 ELSE 0.0 END"
    same = lambda c: f"CASE WHEN {num(f'r.{c}')} = {num(f'k.{c}')} THEN 1 ELSE 0 END"
    return f"""{name}_s AS (SELECT r.name, k.ens_code, k.material, (tg.gain + {gain("size")} + {gain("step")} + {gain("length")})::double / (CASE WHEN r.step IS NULL THEN 4.0 ELSE 5.0 END) AS score,
    tg.same + {same("size")} + {same("step")} + {same("length")} AS exact_count FROM {rows} r CROSS JOIN cr k JOIN tg ON tg.asked = r.coating AND tg.held = k.coating),
  {name} AS (SELECT * FROM {name}_s WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY name ORDER BY score DESC, exact_count DESC, ens_code) = 1),
"""


_LADDER = (
    _BASE
    + _best("trial", "rest")
    + f"""rule AS (SELECT t.name, t.material, CASE WHEN t.material = '12Х18Н10Т' THEN 'Н.Кд' ELSE 'Ан.Окс' END AS corrected FROM trial t JOIN rest r ON r.name = t.name
    WHERE t.material IN ('12Х18Н10Т', 'д1п') AND {_SIM.format(a=_TOKENS.format(c="r.coating"), b="['кд']")} >= 0.5),
  fixed AS (SELECT r.name, r.size, r.step, r.length, coalesce(rule.corrected, r.coating) AS coating, rule.corrected, rule.material, CASE WHEN rule.corrected IS NOT NULL THEN r.coating END AS original FROM rest r LEFT JOIN rule ON rule.name = r.name),
  sig AS (SELECT f.name, min(c.ens_code) AS ens_code FROM fixed f JOIN c ON f.size = c.size AND f.step = c.step AND f.length = c.length AND f.coating = c.coating GROUP BY 1),
"""
    + _best("fz", "fixed")
    + """found AS (
    SELECT name, ens_code, 'exact_name' AS match_type, 1.0::double AS score FROM ex
    UNION ALL SELECT name, ens_code, 'exact', 1.0 FROM sig
    UNION ALL SELECT fz.name, fz.ens_code, CASE WHEN f.corrected IS NULL THEN 'fuzzy' ELSE 'exact_substitution' END, CASE WHEN f.corrected IS NULL THEN least(round_even(score, 3), 1.0) ELSE 1.0 END FROM fz JOIN fixed f ON f.name = fz.name WHERE fz.name NOT IN (SELECT name FROM sig)),
  used AS (SELECT n.name, n.kind, n.size, n.step, n.length, coalesce(f.coating, n.coating) AS coating, f.original, f.corrected, CASE WHEN f.corrected IS NOT NULL THEN f.material END AS material FROM n LEFT JOIN fixed f ON f.name = n.name),
  st AS (SELECT u.name, fd.match_type, v.param, v.asked, v.held, CASE
      WHEN fd.match_type = 'exact_name' THEN CASE WHEN v.held IS NULL THEN 'no_ens_value' WHEN v.asked = v.held THEN 'exact' ELSE 'mismatched' END
      WHEN v.param = 'покрытие' THEN (SELECT CASE WHEN sim >= 0.99 THEN 'exact' WHEN sim >= 0.5 THEN 'token_matched' ELSE 'mismatched' END FROM tg WHERE tg.asked = v.asked AND tg.held = v.held)
      WHEN replace(v.asked, ',', '.')::double = replace(v.held, ',', '.')::double THEN 'exact'
      WHEN list_contains(k.runs, replace(v.asked, ',', '.')) THEN 'exact (in name)' ELSE 'mismatched' END AS status
    FROM used u JOIN found fd ON fd.name = u.name JOIN cr k ON k.ens_code = fd.ens_code, LATERAL (VALUES ('диаметр', u.size, k.size), ('шаг_резьбы', u.step, k.step), ('длина', u.length, k.length), ('покрытие', u.coating, k.coating)) v(param, asked, held)
    WHERE v.asked IS NOT NULL AND fd.match_type <> 'exact'),
  bad AS (SELECT DISTINCT name FROM st WHERE param <> 'покрытие' AND status IN ('mismatched', 'exact (in name)')
    AND NOT (param = 'длина' AND held IS NOT NULL AND abs(asked::double - held::double) < 20 AND abs(asked::double - held::double) / held::double < 0.1))"""
)
_CHECKS = f"""WITH c AS ({WIDE_CATALOGUE.format(part="part")}), e AS ({WIDE_EXAMPLES.format(part="part")}),
  v AS (SELECT e.ens_code, kind, x.param, x.got, x.want, x.need FROM e JOIN c USING (ens_code), LATERAL (VALUES ('диаметр', e.size, c.size, true), ('шаг_резьбы', replace(e.step, ',', '.'), c.step, false), ('длина', e.length, c.length, true), ('покрытие', CASE WHEN kind <> 5 AND e.coating = 'Кд9.фос.окс' THEN 'Кд' ELSE e.coating END, c.coating, false)) x(param, got, want, need)),
  r AS (SELECT ens_code, CASE kind WHEN 5 THEN 'tokens' ELSE 'pattern' END AS stage, param, got, want AS expected, CASE WHEN kind = 5 THEN 'found' WHEN want IS NULL THEN 'ok' WHEN got IS NULL THEN CASE WHEN need THEN 'missing' ELSE 'mismatch' END
    WHEN param = 'покрытие' THEN CASE WHEN got = want OR contains(lower(want), lower(got)) OR contains(lower(got), lower(want)) THEN 'ok' ELSE 'mismatch' END WHEN replace(got, ',', '.') = replace(want, ',', '.') THEN 'ok' ELSE 'mismatch' END AS status FROM v),
  t AS (SELECT ens_code, stage, stage = 'tokens' OR count(*) FILTER (status <> 'ok') = 0 AS success, count(*) FILTER (status = 'missing') > 0 AS lost, count(*) FILTER (status = 'mismatch') > 0 AS wrong FROM r GROUP BY 1, 2)"""
ORACLES = {
    "mask_checks": _CHECKS + " SELECT r.ens_code, r.stage, success, param, status, got, expected FROM r JOIN t USING (ens_code)",
    "mask_check_summary": _CHECKS
    + " SELECT count(*) AS total, count(*) FILTER (success) AS matched, count(*) FILTER (success) / count(*)::double AS score, count(*) FILTER (stage = 'pattern') AS by_pattern, count(*) FILTER (stage = 'tokens') AS by_tokens, count(*) FILTER (lost) AS missing, count(*) FILTER (wrong) AS mismatched FROM t",
    "mask_diagnosis": f"""WITH n AS (SELECT min(kind) AS kind, size, step, length, coating, name FROM ({WIDE_NAMES.format(part="part")}) GROUP BY 2, 3, 4, 5, 6)
      SELECT name, 'extract' AS stage, 'standard' AS key, CASE kind WHEN 5 THEN 'ОСТ 1 39999-80' ELSE 'ОСТ 1 31102-80' END AS value FROM n UNION ALL SELECT name, 'extract', 'item_type', 'болт' FROM n UNION ALL SELECT name, 'mask', 'id', '1' FROM n
      UNION ALL SELECT name, 'match', k, v FROM n, LATERAL (VALUES ('диаметр', size), ('шаг_резьбы', step), ('длина', length), ('покрытие', coating)) x(k, v) WHERE kind <> 5
      UNION ALL SELECT name, 'prefix', k, v FROM n, LATERAL (VALUES ('length', '0'), ('rest', name)) x(k, v) WHERE kind = 5""",
    "match_types": _LADDER
    + _NEAR
    + """ SELECT u.name, CASE kind WHEN 5 THEN 'tfidf' ELSE 'catalogue' END AS level, coalesce(fd.match_type, CASE WHEN nr.name IS NOT NULL THEN 'tfidf' END) AS match_type, coalesce(fd.ens_code, nr.ens_code) AS ens_code,
      coalesce(fd.score, least(round_even(round(nr.sim, 6), 3), 1.0), 0.0) AS confidence,
      CASE WHEN fd.name IS NULL THEN false WHEN corrected IS NOT NULL THEN true ELSE fd.score >= 0.7 AND u.step IS NOT NULL AND (fd.match_type = 'exact' OR u.name NOT IN (SELECT name FROM bad)) END AS success, original, corrected, material
    FROM used u LEFT JOIN found fd ON fd.name = u.name LEFT JOIN near nr ON nr.name = u.name AND nr.rank = 1""",
    "batch_check": _LADDER
    + """, k AS (SELECT u.name, v.i, v.param, v.asked, v.held, CASE WHEN v.param = 'покрытие' THEN v.asked <> v.held ELSE replace(v.asked, ',', '.')::double <> replace(v.held, ',', '.')::double END AS wrong
      FROM used u JOIN found fd ON fd.name = u.name JOIN c ON c.ens_code = fd.ens_code, LATERAL (VALUES (0, 'диаметр', u.size, coalesce(c.size, regexp_extract(c.cand_name, '^Болт ([0-9]+)', 1))), (1, 'шаг_резьбы', u.step, c.step), (2, 'длина', u.length, coalesce(c.length, regexp_extract(c.cand_name, '-([0-9]+)-', 1))), (3, 'покрытие', u.coating, c.coating)) v(i, param, asked, held)
      WHERE v.asked IS NOT NULL),
    w AS (SELECT name, string_agg(param || ': params=' || asked || ', ens=' || held, '; ' ORDER BY i) AS differing FROM k WHERE wrong GROUP BY name)
    SELECT u.name, CASE WHEN w.name IS NULL THEN '⚠ Не хватает параметров в проверяемом' ELSE '✗ Несовпадение параметров' END AS check_status, w.differing, CASE kind WHEN 5 THEN 'Нет' ELSE 'Да' END AS mask_known,
      CASE corrected WHEN 'Н.Кд' THEN 'Для коррозионно-стойкой стали Кд заменяется на Н.Кд' WHEN 'Ан.Окс' THEN 'Для сплава Д1П покрытие Кд не допускается, применяется Ан.Окс' END AS reason FROM used u LEFT JOIN w ON w.name = u.name""",
    "match_statuses": _LADDER + " SELECT name, param, asked, held, status FROM st",
    "match_proposals": _BASE.rstrip().rstrip(",") + _NEAR + " SELECT name, rank, ens_code, round(sim, 6) AS similarity FROM near",
}
