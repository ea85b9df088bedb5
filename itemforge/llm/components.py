"""Connected components of a table of links, by minimum labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from itemforge.llm.storage import delete, materialise, scope


def components(links: DataFrame) -> DataFrame:
    """links: a, b (long). Returns id, label (the smallest id that links reach) for every linked id.

    Each round takes the least label among the neighbours, then the label of that label, so that
    long chains need a number of rounds in the order of their length's logarithm. Labels never
    leave the executors; the driver learns only whether any of them changed. A round's table is deleted
    when the next one is written. Links with a null end or between an id and itself add nothing; no
    links give an empty result.
    """
    with scope(links.sparkSession) as outer:
        return _rounds(links, outer)


def _rounds(links: DataFrame, outer: list[str]) -> DataFrame:
    spark = links.sparkSession
    both = materialise(links.where("a <> b").select("a", "b").union(links.where("a <> b").select("b", "a")).distinct(), "links")
    last: list[str] = []
    labels = materialise(both.groupBy(F.col("a").alias("id")).agg(F.least(F.col("a"), F.min("b")).alias("label")), "labels", last)
    while True:
        near = both.join(labels, both.b == labels.id).groupBy("a").agg(F.min("label").alias("near"))
        step = labels.join(near, labels.id == near.a, "left").select("id", F.col("label").alias("old"), F.least("label", F.coalesce("near", "label")).alias("label"))
        up = labels.select(F.col("id").alias("up"), F.col("label").alias("further"))
        new = step.join(up, step.label == up.up, "left").select("id", "old", F.least("label", F.coalesce("further", "label")).alias("label"))
        made: list[str] = []
        new = materialise(new, "labels", made)
        delete(spark, last)
        last = made
        changed = new.where("label <> old").limit(1).count()
        labels = new.select("id", "label")
        if not changed:
            outer.extend(last)
            return labels
