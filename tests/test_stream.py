"""The incremental path gives what the batch path gives, and a repeated run changes nothing."""

import oracle

from itemforge.operators import ladder, masks
from itemforge.sources.tables import catalogue, item_names, load_items
from itemforge.streaming.incremental import VersionedStore, match_stream


def test_stream_equals_batch(spark, tmp_path):
    names = item_names(spark, oracle.DATA).select("name").distinct().where("name like 'Болт (1)%' or name like 'Гайка%'")
    names.write.parquet(f"{tmp_path}/in")
    store = VersionedStore(spark, f"{tmp_path}/store", ["name"])
    told = []
    for _ in range(2):
        source = spark.readStream.schema("name string").parquet(f"{tmp_path}/in")
        match_stream(source, masks.seed_masks(spark), catalogue(spark, oracle.DATA), store, f"{tmp_path}/check", lambda number, counts: told.append((number, counts))).awaitTermination()
    got = sorted(map(tuple, store.read().select("name", "ens_code", "match_type").collect()), key=repr)
    want = ladder.match(names, masks.seed_masks(spark), catalogue(spark, oracle.DATA)).select("name", "ens_code", "match_type")
    assert got == sorted(map(tuple, want.collect()), key=repr)
    good = store.read().where("success").count()
    assert told == [(0, {"names": len(got), "success": good, "failed": len(got) - good, "proposed": 0})]


def test_load_items(spark):
    rows = spark.createDataFrame([("1", " Болт ", None), (None, "x", "g"), ("2", "", "g")], "`артикул` string, `Краткое наименование` string, GUID string")
    assert [tuple(r) for r in load_items(rows).collect()] == [("1", "Болт", "")]
