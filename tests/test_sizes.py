"""Plans that hold for large tables."""

import oracle
from pyspark.sql import functions as F

from itemforge.operators import ladder, tfidf
from itemforge.operators.cut import cut, scope
from itemforge.plans import wide


def test_cut_tables_are_not_broadcast_by_the_size_of_their_files(spark):
    """A table of equal long texts has a small file, though its rows are many megabytes."""
    with scope(spark):
        large = cut(spark.range(400_000).select("id", F.lit("болт " * 20).alias("name"), F.array(F.lit("a")).alias("l")), "large")
        small = cut(spark.range(10).withColumn("name", F.lit("a")), "small")
        plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
        assert "Broadcast" not in plan(large.join(large.groupBy("id").agg(F.max("name").alias("m")), "id"))
        assert "Broadcast" not in plan(spark.range(400_000).join(large.select("id"), "id", "left_anti"))
        assert "BroadcastHashJoin" in plan(spark.range(400_000).join(small, "id"))
        assert large.count() == 400_000


def test_mask_checks_search_each_text_once(spark):
    """The pattern stands in the plan once for the search and twice (nullif) for each group; rows go to many tasks."""
    df = wide.mask_checks(spark, oracle.DATA)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("(?iu)^болт") == 1 + 2 * len(wide.WIDE_MASK[3])
    assert "Repartition" in plan and "Generate inline" in plan


def test_equal_candidates_are_one_class(spark):
    """Rows that differ in fields that no mask asks for are scored and filed once, and the first of them is found."""
    bag = "array<struct<k: string, v: string>>"
    attrs = F.array(*[F.struct(F.lit(k).alias("k"), v.cast("string").alias("v")) for k, v in (("диаметр", F.col("id") % 2), ("покрытие", F.lit("Кд")), ("масса", F.col("id")))])
    cat = spark.range(600).select(F.col("id").alias("ens_code"), F.concat(F.lit("Болт М"), (F.col("id") % 2).cast("string")).alias("cand_name"), F.lit("s").alias("std"), F.lit("t").alias("item_type"), attrs.alias("attrs"), (F.lit(600) - F.col("id")).alias("cand_ord"))
    names = spark.createDataFrame([("a", "s", "t", [("диаметр", "1"), ("покрытие", "Кд")]), ("b", "s", "t", [("диаметр", "1"), ("покрытие", "Кд6")])], f"name string, std string, item_type string, params {bag}")
    with scope(spark):
        index = ladder.Index(cat, ["диаметр", "покрытие"], 3)
        assert index.postings.count() == 2 * 3 and index.rows.count() == 2 * 3
        assert {(r.name, r["rank"], r.ens_code) for r in ladder.best_candidates(names, index, 3).collect()} == {(n, i, 601 - 2 * i) for n in "ab" for i in (1, 2, 3)}
        found = ladder.scored(names, index)
        assert found.count() == 2  # a class for each bag, not 300 candidates


def test_nearest_texts_of_many_blocks(spark, monkeypatch):
    """Blocks of a few texts give what one block gives, and no row for each two texts that share a gram."""
    texts = spark.range(90).select("id", F.concat(F.lit("болт м"), (F.col("id") % 10).cast("string"), F.lit("х"), F.col("id").cast("string")).alias("text"))
    rows = lambda: {(r.id, r.other, r["rank"], round(r.similarity, 9)) for r in tfidf.nearest(texts, 4).collect()}
    with scope(spark):
        whole = rows()
        monkeypatch.setattr(tfidf, "QUERIES", 20)
        monkeypatch.setattr(tfidf, "TEXTS", 7)
        assert rows() == whole and len(whole) == 360
        plan = tfidf.nearest(texts, 4)._jdf.queryExecution().executedPlan().toString()
        assert "FlatMapCoGroupsInArrow" in plan and "Join" not in plan
