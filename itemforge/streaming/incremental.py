"""New item names matched against a static catalogue as they arrive, results upserted by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from itemforge.operators import ladder, upsert
from itemforge.operators.cut import cut, scope


class VersionedStore:
    """A keyed table in numbered Parquet versions under one folder of the cluster's file system.

    A version is complete when its marker column file exists, as Spark writes _SUCCESS last; a batch
    that is run again writes the same version number again.
    """

    def __init__(self, spark: SparkSession, path: str, keys: list[str]):
        self.spark, self.path, self.keys = spark, path.rstrip("/"), keys

    def _fs(self):  # noqa: ANN202
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        path, fs = self._fs()
        if not fs.exists(path):
            return []
        found = [s.getPath() for s in fs.listStatus(path)]
        new = self.spark._jvm.org.apache.hadoop.fs.Path
        return sorted(int(p.getName()[1:]) for p in found if p.getName().startswith("v") and fs.exists(new(p, "_SUCCESS")))

    def read(self, before: int | None = None) -> DataFrame | None:
        known = [v for v in self.versions() if before is None or v < before]
        return self.spark.read.parquet(f"{self.path}/v{known[-1]}") if known else None

    def write(self, rows: DataFrame, version: int) -> None:
        old = self.read(version)
        out = rows.dropDuplicates(self.keys) if old is None else upsert.merge(old, rows, self.keys)
        out.write.mode("overwrite").parquet(f"{self.path}/v{version}")


def observed(found: DataFrame, name: str) -> tuple[DataFrame, Observation]:
    """found with counts that are taken while it is written, without a pass of their own: names, success, failed, proposed."""
    seen = Observation(name)
    good = F.count_if("success")
    return found.observe(seen, F.count("*").alias("names"), good.alias("success"), (F.count("*") - good).alias("failed"), F.count_if(F.col("match_type") == "tfidf").alias("proposed")), seen


def match_stream(names: DataFrame, masks: DataFrame, catalogue: DataFrame, store: VersionedStore, checkpoint: str, progress: Callable[[int, dict[str, int]], None] | None = None) -> StreamingQuery:
    """Matches each batch of names (streaming, column name) and upserts the results; ends when all input is read.

    progress is told the number and the counts of each batch when its results are stored. A batch that is run again is told again.
    """

    def step(batch: DataFrame, number: int) -> None:
        with scope(batch.sparkSession):
            found = ladder.match(batch, masks, catalogue).select("name", F.lit(None).cast("string").alias("article"), "ens_code", "match_type", "confidence", "success")
            counted, seen = observed(found, f"batch-{number}")
            store.write(cut(counted, "results"), number)
            if progress is not None:
                progress(number, seen.get)

    return names.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
