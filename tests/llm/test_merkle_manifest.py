"""Operator 12 against a plain recomputation of every hash, and against its SQL."""

import hashlib
import zlib

import oracle
import pytest
from pyspark.sql import functions as F

from itemforge.llm import merkle_manifest, registry

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def h(*digests):
    return hashlib.sha256("".join(digests).encode()).hexdigest()


def leaf(row):
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def tree(digests):
    """The root, and for each leaf (place, siblings) of each level."""
    steps, level = [[] for _ in digests], [(d, [i]) for i, d in enumerate(digests)]
    while len(level) > 1:
        above = []
        for i in range(0, len(level), 3):
            run = level[i : i + 3]
            for j, (_, under) in enumerate(run):
                for x in under:
                    steps[x].append((j, [d for q, (d, _) in enumerate(run) if q != j]))
            above.append((h(*[d for d, _ in run]), [x for _, under in run for x in under]))
        level = above
    return level[0][0], steps


def brute(rows):
    by_source = {}
    for r in rows:
        by_source.setdefault(r[1], []).append((r[0] is not None, r[0] or 0, leaf(r), r))
    sources = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees = [tree([x[2] for x in sorted(by_source[s], key=lambda x: x[:3])]) for s in sources]
    root, above = tree([t[0] for t in trees])
    out = []
    for s, (subroot, steps), rest in zip(sources, trees, above, strict=True):
        for (_, _, own, r), path in zip(sorted(by_source[s], key=lambda x: x[:3]), steps, strict=True):
            path = path + rest
            cut = r[0] is not None and r[4] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0
            d = leaf((*r[:4], r[4].replace("\n", ""))) if cut else own
            for j, siblings in path:
                d = h(*siblings[:j], d, *siblings[j:])
            out.append((r[0], own, subroot, root, h(*[d for _, siblings in path for d in siblings]), d, d == root))
    return sorted(out, key=repr)


CASES = {
    "one": [(1, "a", None, 3, "a\nb")],
    "lone sources": [(i, s, "x", i, "t\n") for i, s in enumerate(["b", None, "é", "a", ""])],
    "repeated and null": [(None, None, None, None, None)] * 4 + [(5, "é", "x", 1, "q\n\n")] * 7 + [(None, "é", "x", 1, "q\n")],
    "uneven": [(i, "b" * (i % 3 // 2), None, i, f"{i}\n" * (i % 4)) for i in range(85)],
    "long": [(i, "s", None, 0, "x\n" * 300_000 if i == 2 else "") for i in range(10)],
}


@pytest.mark.parametrize("name", CASES)
def test_brute(spark, name):
    df = spark.createDataFrame(CASES[name], SCHEMA).repartition(3)
    assert sorted(map(tuple, merkle_manifest.manifest(df).collect()), key=repr) == brute(CASES[name])


def test_extra_columns_and_empty(spark):
    rows = CASES["uneven"]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(1) for c in ("leaf", "root", "place", "tree", "size", "range", "row")})
    assert sorted(map(tuple, merkle_manifest.manifest(df).collect()), key=repr) == brute(rows)
    none = merkle_manifest.manifest(spark.createDataFrame([], SCHEMA))
    assert none.count() == 0 and none.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def test_other_tampering(spark):
    """Whatever is changed is found, and nothing else."""
    rows = [(i, f"s{i % 2}", None, 1, f"text {i}") for i in range(40)]
    got = merkle_manifest.manifest(spark.createDataFrame(rows, SCHEMA), lambda doc_id, text: F.when(doc_id == 17, "other").otherwise(text)).collect()
    assert [r.doc_id for r in got if not r.verified] == [17]


def test_query_and_sql(spark):
    query, sql = registry.queries()["op12_merkle_manifest"], registry.oracle_sql()["op12_merkle_manifest"]
    want = oracle.rows_of_duckdb(oracle.connect(), sql)
    assert oracle.rows_of_spark(query(spark, oracle.DATA)) == want
    docs = spark.read.parquet(f"{oracle.DATA}/documents.parquet").select("doc_id", "source", "lang", "n_chars", "text")
    plain = [dict(zip(want[0], r, strict=True)) for r in want[1]]
    assert sorted(((r["doc_id"], r["leaf"], r["subroot"], r["root"], r["proof_sha256"], r["folded_root"], r["verified"]) for r in plain), key=repr) == brute([tuple(r) for r in docs.collect()])
