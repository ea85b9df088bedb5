"""Operator 1: K-d tree sharding with distributed weighted medians. DataFrame functions only.

The unit of placement is a group of rows with equal texts (its weight is the sum of the rows'
sizes). A node of the tree is split along its widest metadata dimension (range over the range of
the whole table) at the weighted median; a node that still holds several shards is split on. A
median is found by histograms: one aggregation gives the weight of every bin of every open node,
only the bin that holds the median is divided again, so the driver sees bins, never rows.

Defined cases: a null text has size 1, crc32 0 and forms a group with other null texts; empty
texts form a group; a null lang or source has coordinate 0; repeated rows keep a row each; an
empty table gives an empty result. Only the columns doc_id, text, lang and source are read, so
extra columns, whatever their names, do not matter; lang and source may be missing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from itemforge.llm.storage import materialise

DIMS = ("size", "lang", "source")
#: Bins of all open nodes together that one aggregation returns.
BINS = 1 << 14
#: A cut may miss its target by this share of its node's weight.
TOLERANCE = 0.0005
ROWS_PER_BUCKET = 20_000


def _local(spark: SparkSession, rows: list[tuple], names: list[str]) -> DataFrame:
    """A few driver rows (a bounded number: one for each open node) as a local relation."""
    value = lambda v: f"'{v}'" if isinstance(v, str) else f"{v}L" if abs(v) >= 1 << 31 else str(v)
    body = ", ".join(f"({', '.join(map(value, r))})" for r in rows)
    return spark.sql(f"SELECT * FROM VALUES {body} AS t({', '.join(names)})")


def _bytes(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1


def _coordinate(dim: str, columns: list[str]) -> Column:
    """31 bits of metadata over 32 bits of content hash: an order without large ties."""
    if dim == "size":
        high = F.least(F.col("size"), F.lit((1 << 31) - 1))
    else:
        high = F.shiftright(F.coalesce(F.crc32(F.col(dim).cast("string")), F.lit(0)), 1) if dim in columns else F.lit(0)
    return (high.cast("long") * F.lit(1 << 32) + F.col("digest").bitwiseAND(F.lit((1 << 32) - 1))).alias(f"key_{dim}")


def rows_of(docs: DataFrame) -> DataFrame:
    """One small row per document: no text travels."""
    own = [c for c in ("lang", "source") if c in docs.columns]
    return docs.select("doc_id", "text", *own).select(
        "doc_id",
        _bytes(F.col("text")).alias("size"),
        F.coalesce(F.crc32(F.col("text")), F.lit(0)).cast("long").alias("text_crc32"),
        F.when(F.col("text").isNull(), F.lit(0)).otherwise(F.xxhash64("text")).alias("digest"),
        *own,
    )


def _cuts(open_nodes: dict[int, tuple[float, str, int, int]], groups: DataFrame) -> dict[int, int]:
    """node -> largest key of its left part. open_nodes: node -> (target weight, dimension, lowest and highest key)."""
    spark, found = groups.sparkSession, {}
    before = dict.fromkeys(open_nodes, 0.0)
    left = dict(open_nodes)
    allowed = {n: TOLERANCE * 2 * t for n, (t, *_) in open_nodes.items()}
    while left:
        bins = max(16, BINS // len(left))
        plan = _local(spark, [(n, d, lo, max(1, -(-(hi - lo + 1) // bins)), hi) for n, (_, d, lo, hi) in left.items()], ["node", "dim", "lo", "width", "hi"])
        key = F.coalesce(*[F.when(F.col("dim") == d, F.col(f"key_{d}")) for d in DIMS])
        got = (
            groups.join(F.broadcast(plan), "node")
            .withColumn("key", key)
            .where(F.col("key").between(F.col("lo"), F.col("hi")))
            .groupBy("node", F.expr("(key - lo) div width").alias("bin"))
            .agg(F.sum("weight").alias("weight"), F.min("key").alias("lo"), F.max("key").alias("hi"))
            .orderBy("node", "bin")
            .collect()
        )
        for n in list(left):
            target, dim, *_ = left[n]
            total = before[n]
            for r in (r for r in got if r.node == n):
                if total + r.weight >= target:
                    if r.lo == r.hi or r.weight <= allowed[n]:
                        nearer = total + r.weight - target <= target - total
                        found[n] = r.hi if nearer else r.lo - 1
                        del left[n]
                    else:
                        left[n], before[n] = (target, dim, r.lo, r.hi), total
                    break
                total += r.weight
            else:
                found[n] = left.pop(n)[3]
    return found


def kd_assign(rows: DataFrame, shards: int | None = None, target_bytes: int | None = None) -> DataFrame:
    """digest, size, shard (0 to shards - 1) of every group of equal texts."""
    grouped = rows.groupBy("digest", "size").agg(F.sum("size").alias("weight"), *[F.min(c).alias(c) for c in ("lang", "source") if c in rows.columns])
    groups = materialise(grouped.select("digest", "size", "weight", *[_coordinate(d, grouped.columns) for d in DIMS]), "kd-groups").withColumn("node", F.lit(1))
    if shards is None:
        total = groups.agg(F.sum("weight")).first()[0] or 0
        shards = max(1, -(-total // (target_bytes or 1 << 27)))
    todo, first, whole = {1: shards}, {1: 0}, None
    leaves: dict[int, int] = {}
    while todo:
        for n in [n for n, k in todo.items() if k == 1]:
            leaves[n] = first[n]
            del todo[n]
        if not todo:
            break
        stats = {
            r.node: r
            for r in groups.groupBy("node").agg(F.sum("weight").alias("weight"), *[f(f"key_{d}").alias(f"{x}_{d}") for d in DIMS for f, x in ((F.min, "lo"), (F.max, "hi"))]).collect()
        }
        whole = whole or {d: max(1, stats[1][f"hi_{d}"] - stats[1][f"lo_{d}"]) if 1 in stats else 1 for d in DIMS}
        wanted = {}
        for n, k in todo.items():
            if n in stats:
                r = stats[n]
                dim = max(DIMS, key=lambda d: ((r[f"hi_{d}"] - r[f"lo_{d}"]) / whole[d], -DIMS.index(d)))
                wanted[n] = (r.weight * (k // 2) / k, dim, r[f"lo_{dim}"], r[f"hi_{dim}"])
        cuts = _cuts(wanted, groups)
        nodes = []
        for n, k in todo.items():
            nodes.append((n, wanted[n][1] if n in wanted else DIMS[0], cuts.get(n, 0)))
            first[2 * n], first[2 * n + 1] = first[n], first[n] + k // 2
        plan = _local(groups.sparkSession, nodes, ["node", "dim", "cut"])
        key = F.coalesce(*[F.when(F.col("dim") == d, F.col(f"key_{d}")) for d in DIMS])
        groups = (
            groups.join(F.broadcast(plan), "node", "left")
            .withColumn("node", F.when(F.col("cut").isNull(), F.col("node")).otherwise(F.col("node") * 2 + (key > F.col("cut")).cast("int")))
            .drop("dim", "cut")
        )
        todo = {m: c for n, k in todo.items() for m, c in ((2 * n, k // 2), (2 * n + 1, k - k // 2))}
    names = _local(groups.sparkSession, list(leaves.items()), ["node", "shard"])
    return groups.join(F.broadcast(names), "node").select("digest", "size", "shard")


def numbered(placed: DataFrame, n_rows: int) -> DataFrame:
    """Adds slot, gapless from 0 within each shard, without sorting a shard in one task."""
    buckets = max(16, n_rows // ROWS_PER_BUCKET)
    placed = placed.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(buckets)))
    counts = placed.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    starts = counts.select("shard", "bucket", (F.sum("n").over(Window.partitionBy("shard").orderBy("bucket")) - F.col("n")).alias("start"))
    own = Window.partitionBy("shard", "bucket").orderBy("doc_id", "text_crc32", "size")
    ranked = placed.withColumn("rank", F.row_number().over(own))
    return ranked.join(starts, ["shard", "bucket"]).withColumn("slot", (F.col("start") + F.col("rank") - 1).cast("long")).drop("bucket", "rank", "start")


def shard_documents(docs: DataFrame, shards: int = 8) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard; law 'bytes': the shards' bytes are near equal."""
    rows = materialise(rows_of(docs), "kd-rows")
    placed = rows.join(kd_assign(rows, shards), ["digest", "size"])
    placed = materialise(placed.select("doc_id", "size", "text_crc32", "shard"), "kd-placed")
    return numbered(placed, placed.count()).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
