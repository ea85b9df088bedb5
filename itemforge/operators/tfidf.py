"""TF-IDF over character n-grams, cosine similarity and the nearest texts.

Queries and texts are dealt into blocks, and each block of queries meets each block of texts in a task of its own.
There an inverted index of the block adds up the products of weights gram by gram, for all its texts at once,
and the nearest of each query go on; the nearest of all blocks are the nearest of all texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from itemforge.operators.cut import cut

LOW, HIGH = 2, 4
#: About how many queries and texts a block has.
QUERIES, TEXTS = 512, 4096
#: Similarities that differ by less are equal.
EQUAL = 1e-9


def grams(text: Column) -> Column:
    """All character runs of LOW to HIGH characters of the lower-case text."""
    each = lambda n: F.when(F.length(text) >= n, F.transform(F.sequence(F.lit(1), F.length(text) - n + 1), lambda i: F.substring(F.lower(text), i, F.lit(n)))).otherwise(F.array().cast("array<string>"))
    return F.concat(*[each(n) for n in range(LOW, HIGH + 1)])


def _counts(texts: DataFrame) -> DataFrame:
    """id, gram, tf."""
    return texts.select("id", F.explode(grams(F.col("text"))).alias("gram")).groupBy("id", "gram").agg(F.count("*").alias("tf"))


def _normal(raw: DataFrame) -> DataFrame:
    norm = raw.groupBy("id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return raw.join(norm, "id").withColumn("w", F.col("w") / F.col("norm")).drop("norm")


def inverse_frequencies(texts: DataFrame, counts: DataFrame) -> DataFrame:
    """gram, df, idf = ln((1 + n) / (1 + df)) + 1."""
    n = texts.count()
    return counts.groupBy("gram").agg(F.count("*").alias("df")).withColumn("idf", F.log((1 + F.lit(n)) / (1 + F.col("df"))) + 1)


def weights(texts: DataFrame) -> DataFrame:
    """id, gram, w: L2-normalised tf * idf."""
    counts = _counts(texts)
    return _normal(counts.join(inverse_frequencies(texts, counts), "gram").select("id", "gram", (F.col("tf") * F.col("idf")).alias("w")))


def _blocks(weighted: DataFrame, size: int, name: str) -> tuple[DataFrame, int]:
    """id, block, grams (g, w) of each text of rows id, g, w, and the number of blocks."""
    vectors = cut(weighted.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("g", "w"))).alias("grams")), name)
    n = max(1, -(-vectors.count() // size))
    return vectors.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")), n


def _nearest_of_blocks(k: int, least: float):  # noqa: ANN202
    """A function of two Arrow tables (id, grams), queries and texts: id, other, similarity of the k nearest and of those that come within EQUAL of them."""

    def flat(column):  # noqa: ANN001, ANN202
        parts = column.combine_chunks()
        return parts.value_lengths().to_numpy(), parts.flatten().field("g").to_numpy(), parts.flatten().field("w").to_numpy()

    def meet(asked, held):  # noqa: ANN001, ANN202
        import numpy as np
        import pyarrow as pa

        sizes, g, w = flat(held["grams"]) if held.num_rows else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))
        order = np.argsort(g, kind="stable")
        of, w, (known, start) = np.repeat(np.arange(len(sizes)), sizes)[order], w[order], np.unique(g[order], return_index=True)
        end = np.append(start[1:], len(g))
        rows, others, found = [], [], []
        lengths, mine, weight = flat(asked["grams"]) if asked.num_rows and len(known) else (np.zeros(0, int), known, w)
        ends = np.cumsum(lengths)
        for q, (begin, stop) in enumerate(zip(ends - lengths, ends, strict=True)):
            total = np.zeros(len(sizes))
            at = np.minimum(np.searchsorted(known, mine[begin:stop]), len(known) - 1)
            for i, v in zip(at[known[at] == mine[begin:stop]], weight[begin:stop][known[at] == mine[begin:stop]], strict=True):
                # a text has a gram once: no index occurs twice
                total[of[start[i] : end[i]]] += v * w[start[i] : end[i]]
            best = np.flatnonzero(total > least)
            if len(best) > k:
                best = best[total[best] >= np.partition(total[best], -k)[-k] - 2 * EQUAL]
            rows.append(np.full(len(best), q))
            others.append(best)
            found.append(total[best])
        take = lambda table, places: table["id"].take(pa.array(np.concatenate([np.zeros(0, int), *places]).astype(np.int64)))
        return pa.table({"id": take(asked, rows), "other": take(held, others), "similarity": np.concatenate([np.zeros(0), *found])})

    return meet


def neighbours(queries: DataFrame, texts: DataFrame, k: int = 3, least: float = 0.1, others_only: bool = False) -> DataFrame:
    """id, other, similarity, rank: the k texts (id, text) nearest to each query (id, text), then those over the least similarity.

    Frequencies are those of texts; grams that no text has don't count. Of equally near texts those with the smaller id.
    Ids are distinct; others_only: a text isn't its own neighbour.
    """
    spark = texts.sparkSession
    counts = cut(_counts(texts), "grams")
    idf = cut(inverse_frequencies(texts, counts).withColumn("g", F.monotonically_increasing_id()), "idf")
    weigh = lambda c: _normal(c.join(idf, "gram").select("id", "g", (F.col("tf") * F.col("idf")).alias("w")))
    held, slices = _blocks(weigh(counts), TEXTS, "vectors")
    asked, batches = _blocks(weigh(_counts(queries)), QUERIES, "asked")
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism, 1)
    # each block of one side meets all of the other; a fixed number of partitions, as the work is more than the bytes
    meets = lambda df, mine, other, n: df.select("id", "grams", F.col("block").alias(mine), F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(other)).select("batch", "slice", "id", "grams").repartition(tasks, "batch", "slice").groupBy("batch", "slice")
    schema = f"id {asked.schema['id'].dataType.simpleString()}, other {held.schema['id'].dataType.simpleString()}, similarity double"
    pairs = meets(asked, "batch", "slice", slices).cogroup(meets(held, "slice", "batch", batches)).applyInArrow(_nearest_of_blocks(k + others_only, least), schema)
    pairs = pairs.where("id <> other") if others_only else pairs
    w = Window.partitionBy("id").orderBy(F.round("similarity", 9).desc(), "other")
    return pairs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).where(F.col("similarity") > least)


def nearest(texts: DataFrame, k: int = 3, least: float = 0.1) -> DataFrame:
    """id, other, similarity, rank: the k nearest other texts of each, then those over the least similarity."""
    return neighbours(texts, texts, k, least, others_only=True)
