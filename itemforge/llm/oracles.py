"""DuckDB SQL for the queries whose whole result SQL can express."""

from __future__ import annotations

#: Operator 13. Path rules by ends and starts of strings, patterns by regular expressions of their own.
URL_FILTERS = """
WITH u AS (
  SELECT page_id, url, position('://' IN coalesce(url, '')) AS place FROM pages
), t AS (
  SELECT page_id, url, CASE WHEN place > 0 THEN substr(url, place + 3) ELSE '' END AS rest FROM u
), h AS (
  SELECT page_id, url, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM t
), p AS (
  SELECT page_id, translate(url, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low,
         translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path
  FROM h
), r(action, rule_host, rule_path) AS (
  VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')
), f AS (
  SELECT p.*, (SELECT max({'n': length(rule_host || rule_path), 'rule': rule_host || rule_path, 'action': action}) FROM r
               WHERE (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)) AS best
  FROM p
), m AS (
  SELECT *, CASE
    WHEN best IS NOT NULL THEN NULL
    WHEN regexp_matches(low, '^[^:/?#]*://([^/?#]*[.])?docs[.].*/search[?]') THEN '||docs.*/search?'
    WHEN regexp_matches(low, '^[^:/?#]*://([^/?#]*[.])?blog[.].*/feed/$') THEN '||blog.*/feed/|'
    WHEN regexp_matches(low, '[.]pdf$') THEN '.pdf|'
    WHEN regexp_matches(low, '[.]zip$') THEN '.zip|'
    WHEN regexp_matches(low, '/cart([^a-z0-9_%.-]|$)') THEN '/cart^'
    WHEN ends_with(low, '/feed/') THEN '/feed/|'
    WHEN regexp_matches(low, '/login([^a-z0-9_%.-]|$)') THEN '/login^'
    WHEN contains(low, '/search?') THEN '/search?'
    WHEN regexp_matches(low, '/tag/.*[?]page=') THEN '/tag/*?page='
    WHEN regexp_matches(low, '^[^:/?#]*://([^/?#]*[.])?ads[.]') THEN '||ads.'
    WHEN regexp_matches(low, '^[^:/?#]*://([^/?#]*[.])?casino-') THEN '||casino-'
    WHEN regexp_matches(low, '^[^:/?#]*://([^/?#]*[.])?cheap-pills[.]') THEN '||cheap-pills.'
    WHEN regexp_matches(low, '^[^:/?#]*://([^/?#]*[.])?spam-farm[.]') THEN '||spam-farm.'
  END AS pattern FROM f
)
SELECT page_id, host, path, best.rule AS rule, pattern,
       CASE WHEN best IS NOT NULL THEN best.action WHEN pattern IS NULL OR pattern IN ('||docs.*/search?', '||blog.*/feed/|') THEN 'allow' ELSE 'block' END AS verdict
FROM m
"""


def _field(value: str) -> str:
    return f"coalesce(strlen(CAST({value} AS VARCHAR)) || ':' || CAST({value} AS VARCHAR), '-')"


def _leaf(text: str) -> str:
    return "sha256(" + " || ".join(_field(v) for v in ("doc_id", "source", "lang", "n_chars", text)) + ")"


#: Unsigned crc32 of doc_id as text, bit by bit: each byte is followed by seven zeros, so that each element is one shift.
_CRC32 = """xor(list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(range(1, length(CAST(doc_id AS VARCHAR)) + 1),
  lambda i: [ascii(substr(CAST(doc_id AS VARCHAR), i::INT, 1))::BIGINT, 0, 0, 0, 0, 0, 0, 0]))),
  lambda c, e: xor(xor(c, e) >> 1, 3988292384 * (xor(c, e) & 1))), 4294967295)"""


def _levels(name: str, key: str, count: int) -> list[str]:
    """Tables {name}0 to {name}{count} of nodes, from {name}0 (key, place, size, digest), and the runs {name}r of each level."""
    out = []
    for k in range(count):
        out.append(f"{name}r{k} AS MATERIALIZED (SELECT {key}, place // 3 AS up, max(size) AS size, list(digest ORDER BY place) AS ds FROM {name}{k} GROUP BY {key}, place // 3)")
        out.append(f"{name}{k + 1} AS MATERIALIZED (SELECT {key}, up AS place, (size + 2) // 3 AS size, CASE WHEN size = 1 THEN ds[1] ELSE sha256(array_to_string(ds, '')) END AS digest FROM {name}r{k})")
    return out


def _folds(name: str, trees: str, key: str, count: int) -> list[str]:
    """Tables {name}0 to {name}{count} of leaves that meet one level's siblings each."""
    out = []
    for k in range(count):
        split = "r.ds[1:p.place % 3]", "r.ds[p.place % 3 + 2:]"
        out.append(
            f"{name}{k + 1} AS MATERIALIZED (SELECT p.* EXCLUDE (place, digest, proof), p.place // 3 AS place, "
            f"CASE WHEN r.size = 1 THEN p.digest ELSE sha256(array_to_string({split[0]}, '') || p.digest || array_to_string({split[1]}, '')) END AS digest, "
            f"p.proof || CASE WHEN r.size = 1 THEN '' ELSE array_to_string({split[0]}, '') || array_to_string({split[1]}, '') END AS proof "
            f"FROM {name}{k} p JOIN {trees}r{k} r ON r.{key} IS NOT DISTINCT FROM p.{key} AND r.up = p.place // 3)"
        )
    return out


def merkle_manifest(levels: int = 16) -> str:
    """Operator 12 with so many levels for each source and for all sources: 3 ^ levels leaves at most."""
    parts = [
        f"leaves AS MATERIALIZED (SELECT doc_id, source, {_leaf('text')} AS leaf, {_leaf(f'CASE WHEN {_CRC32} % 2 = 0 THEN replace(text, chr(10), {chr(39) * 2}) ELSE text END')} AS arrived FROM documents)",
        "placed AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place, count(*) OVER (PARTITION BY source) AS size FROM leaves)",
        "t0 AS MATERIALIZED (SELECT source, place, size, leaf AS digest FROM placed)",
        *_levels("t", "source", levels),
        f"s0 AS MATERIALIZED (SELECT 0 AS tree, source, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS place, count(*) OVER () AS size, digest FROM t{levels})",
        *_levels("s", "tree", levels),
        "p0 AS (SELECT doc_id, source, leaf, place, arrived AS digest, '' AS proof FROM placed)",
        *_folds("p", "t", "source", levels),
        f"q0 AS (SELECT p.doc_id, p.leaf, s.digest AS subroot, s.tree, s.place, p.digest, p.proof FROM p{levels} p JOIN s0 s ON s.source IS NOT DISTINCT FROM p.source)",
        *_folds("q", "s", "tree", levels),
    ]
    return "WITH " + ",\n".join(parts) + f"\nSELECT q.doc_id, q.leaf, q.subroot, r.digest AS root, sha256(q.proof) AS proof_sha256, q.digest AS folded_root, q.digest = r.digest AS verified FROM q{levels} q, s{levels} r"
