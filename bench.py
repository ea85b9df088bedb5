"""Headline queries at BENCH_SF_DIR on local[BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from itemforge.plans import matching, store
from itemforge.session import local_session
from itemforge.sources.tables import item_names

HEADLINE = {
    "match_ladder": matching.match_ladder,
    "fuzzy_best": matching.fuzzy_best,
    "exact_name": matching.exact_name,
    "std_extract": matching.std_extract,
    "mask_parse": matching.mask_parse,
    "quality_report": matching.quality_report,
    "field_fill": store.field_fill,
    "visible_fields": store.visible_fields,
    "twin_pairs": store.twin_pairs,
    "upsert_changes": store.upsert_changes,
    "json_export": store.json_export,
}


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session("bench", cores=cpus, shuffle=int(cpus))
    spark.sparkContext.setLogLevel("ERROR")
    n = item_names(spark, sf).count()  # also starts the session
    took = {}
    for name, query in HEADLINE.items():
        began = time.time()
        query(spark, sf).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)
    total = round(sum(took.values()), 3)
    print(json.dumps({"metric": "headline_seconds", "value": total, "unit": "sec", "queries": took, "sf": sf, "names": n, "names_per_second_full_ladder": round(n / took["match_ladder"], 1), "cores": int(cpus)}))


if __name__ == "__main__":
    main()
