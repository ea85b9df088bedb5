"""Operator 12: Merkle manifest of a dataset, by Pregel-style supersteps over RDDs.

A row's leaf is the hash of its fields; the leaves of a source, by ascending doc_id, are the bottom of
a tree in which every three consecutive nodes have a parent; the roots of the sources, ordered by
source, are the bottom of a last tree, whose root is the manifest's. Hashes are SHA-256 over the hex
digests of the children.

Leaves are hashed and placed by DataFrame functions: sorted by ranges of (source, doc_id, leaf) and
numbered from the counts of each range and source, so that a source with any share of the rows is
spread over as many ranges. Texts don't leave the task that reads them.

The supersteps: a node sends its digest to its parent, (tree, place div 3). A parent has all its
children's messages after one superstep, hashes them and sends on; a tree with one node left halts and
waits as a subroot. Messages go by shuffle until the level has ONE_TASK nodes or fewer; such a level is one task's. A level has a third of the rows of the one below, and is written to the shared folder, so that
a lost executor costs one level. Then the reverse supersteps: the root sends an empty path, and each
parent sends to each child its own path with the child's siblings before it. At the bottom a run of up
to three leaves has its path, from which each leaf's proof, subroot and root are folded.

A path is bytes: for each level, upwards, one byte that holds the child's place and the number of its
siblings, and their digests. Its length is that of the tree's height.

Defined cases: a null doc_id comes first and is not tampered with; rows with equal doc_id follow by
their leaf, equal rows are leaves of their own; a null text has no characters to delete; a null source
is a source of its own and comes first; a lone leaf is the subroot, a lone source's subroot the root,
and the proof of no siblings is the hash of nothing; an empty table gives an empty result; texts of any
length are one leaf; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator

from pyspark import RDD
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from itemforge.llm.storage import materialise, new_path, scope

ARITY = 3
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Tree of the sources' subroots.
TOP = -1
DIGEST = 32
ROWS_PER_PART = 200_000
#: Levels of so many nodes at most are one task's, without a shuffle.
ONE_TASK = 20_000
SCHEMA = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def leaf_of(fields: list[Column]) -> Column:
    """Hash of the fields: `-` for null, else byte count, `:` and value."""
    texts = [c.cast("string") for c in fields]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t), F.lit(":"), t), F.lit("-")) for t in texts]), 256)


def tampered_text(doc_id: Column, text: Column) -> Column:
    """The text that arrives: without line feeds where crc32 of the doc_id is even."""
    return F.when(F.crc32(doc_id.cast("string")) % 2 == 0, F.replace(text, F.lit("\n"), F.lit(""))).otherwise(text)


def leaves_of(docs: DataFrame, tampered: Callable[[Column, Column], Column] = tampered_text) -> DataFrame:
    """tree (rank of the source), place (in its tree), size (of its tree), trees, doc_id, leaf, arrived (the leaf of what arrives, null if it is the same)."""
    doc_id, text = F.col("doc_id"), F.col("text")
    of = lambda t: F.unhex(leaf_of([t if f == "text" else F.col(f) for f in FIELDS]))
    came = tampered(doc_id, text)
    hashed = docs.select("source", doc_id.cast("long").alias("doc_id"), of(text).alias("leaf"), F.when(~came.eqNullSafe(text), of(came)).alias("arrived"))
    # the last column tells equal rows apart, so that any number of them can be split
    hashed = materialise(hashed.withColumn("tie", F.monotonically_increasing_id()), "merkle-hashed")
    order = ["source", "doc_id", "leaf", "tie"]
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), hashed.count() // ROWS_PER_PART)
    ranged = hashed.repartitionByRange(parts, *order).sortWithinPartitions(*order).drop("tie")
    # a row's number within its range is written with it, and so is the same for all that read it
    rows = materialise(ranged.select("*", F.spark_partition_id().alias("range"), F.monotonically_increasing_id().alias("row")), "merkle-leaves")
    held = rows.groupBy("range", "source").agg(F.min("row").alias("first"), F.count("*").alias("n"))
    # a source has a row for each range at most
    of_source = Window.partitionBy("source").orderBy("range")
    held = held.select("*", F.coalesce(F.sum("n").over(of_source.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"), F.sum("n").over(Window.partitionBy("source")).alias("size"))
    held = materialise(held, "merkle-sources")
    # sources that start in earlier ranges: a row for each range
    begun = held.where("before = 0").groupBy("range").agg(F.count("*").alias("begun"))
    begun = begun.select("range", (F.sum("begun").over(Window.orderBy("range")) - F.col("begun")).alias("earlier"))
    ranks = held.where("before = 0").join(begun, "range").select("source", (F.col("earlier") + F.row_number().over(Window.partitionBy("range").orderBy("first")) - 1).alias("tree"))
    placed = held.alias("h").join(ranks.alias("r"), F.expr("h.source <=> r.source")).select("h.*", "tree")
    found = rows.alias("l").join(placed.alias("p"), F.expr("l.range = p.range and l.source <=> p.source"))
    return found.select("tree", (F.col("before") + F.col("row") - F.col("first")).alias("place"), "size", "doc_id", "leaf", "arrived")


def _h(digests: Iterable[bytes]) -> bytes:
    return hashlib.sha256(b"".join(d.hex().encode() for d in digests)).digest()


def _height(size: int) -> int:
    """Levels above the bottom of a tree."""
    n = 0
    while size > 1:
        size, n = -(-size // ARITY), n + 1
    return n


class Supersteps:
    """Levels of a forest of trees in the shared folder, bottom first. What a result still reads outlives the scope in which it is made."""

    def __init__(self, spark: SparkSession, outer: list[str]):
        self.spark, self.outer = spark, outer
        self.least = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[RDD] = []
        self.parts: list[int] = []

    def keep(self, rdd: RDD, name: str, last: bool = False) -> RDD:
        path = new_path(self.spark, f"merkle-{name}", self.outer if last else None)
        rdd.saveAsPickleFile(path, 1000)
        return self.spark.sparkContext.pickleFile(path)

    def up(self, nodes: RDD, rows: int, height: int) -> RDD:
        """nodes: ((tree, place), (size of the tree's level, over 1; digest, ...)). Gives (tree, height, digest) of every tree's last node."""
        ended = []
        for level in range(1, height + 1):
            rows = rows // ARITY + 1
            parts = 1 if rows * ARITY <= ONE_TASK else max(2, min(self.least, rows // 1000), rows // ROWS_PER_PART)
            sent = (nodes.filter(lambda x: x[1][0] > 1) if level > 1 else nodes).map(lambda x: ((x[0][0], x[0][1] // ARITY), (x[0][1], x[1])))
            runs = _grouped(sent, parts).mapValues(lambda c: [v for _, v in sorted(c, key=lambda m: m[0])])
            runs = self.keep(runs, f"level-{level}", level == 1)
            self.levels.append(runs)
            self.parts.append(parts)
            nodes = runs.map(lambda x: (x[0], (-(-x[1][0][0] // ARITY), _h(c[1] for c in x[1]))))
            ended.append(nodes.filter(lambda x: x[1][0] == 1).map(lambda x, level=level: (x[0][0], level, x[1][1])))
        return self.spark.sparkContext.union(ended) if ended else self.spark.sparkContext.parallelize([], 1)

    def down(self, begun: Callable[[int], RDD]) -> RDD:
        """((tree, place), path) of the bottom's runs. begun(level): ((tree, 0), path) of the trees of that height."""
        own = begun(len(self.levels))
        for level in range(len(self.levels), 1, -1):
            sent = _met(self.levels[level - 1], own, self.parts[level - 1]).flatMap(lambda x: [((x[0][0], x[0][1] * ARITY + i), p) for i, p in enumerate(_paths([c[1] for c in x[1][0]], x[1][1]))])
            own = self.keep(sent.union(begun(level - 1)), f"paths-{level - 1}", level == 2)
        return own


def _grouped(messages: RDD, parts: int) -> RDD:
    """(key, values) of (key, value)."""
    if parts > 1:
        return messages.groupByKey(parts)

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        held: dict = {}
        for k, v in rows:
            held.setdefault(k, []).append(v)
        return iter(held.items())

    return messages.coalesce(1).mapPartitions(run)


def _met(runs: RDD, paths: RDD, parts: int) -> RDD:
    """(key, (run, path)) of the keys that both have."""
    both = _grouped(runs.mapValues(lambda v: (0, v)).union(paths.mapValues(lambda v: (1, v))), parts)
    return both.mapValues(lambda c: [v for _, v in sorted(c, key=lambda m: m[0])]).filter(lambda x: len(x[1]) == 2).mapValues(tuple)


def _paths(children: list[bytes], path: bytes) -> list[bytes]:
    """The path of each child: its place and the number of its siblings, these, and its parent's path."""
    return [bytes([i * ARITY + len(children) - 1]) + b"".join(children[:i] + children[i + 1 :]) + path for i in range(len(children))]


def steps_of(path: bytes) -> Iterator[tuple[int, list[bytes]]]:
    at = 0
    while at < len(path):
        place, n = divmod(path[at], ARITY)
        end = at + 1 + n * DIGEST
        yield place, [path[i : i + DIGEST] for i in range(at + 1, end, DIGEST)]
        at = end


def fold(digest: bytes, path: bytes) -> list[bytes]:
    """The nodes that the leaf and the siblings of its path give, the leaf first and the root last."""
    out = [digest]
    for place, siblings in steps_of(path):
        out.append(_h([*siblings[:place], out[-1], *siblings[place:]]))
    return out


def proven(leaf: tuple, path: bytes, height: int, root: bytes) -> tuple:
    """A row of the result; leaf: size, digest, doc_id, digest of what arrives or None."""
    _, digest, doc_id, arrived = leaf
    own = fold(digest, path)
    folded = own[-1] if arrived is None else fold(arrived, path)[-1]
    proof = _h(s for _, siblings in steps_of(path) for s in siblings)
    return doc_id, digest.hex(), own[height].hex(), root.hex(), proof.hex(), folded.hex(), folded == root


def manifest(docs: DataFrame, tampered: Callable[[Column, Column], Column] = tampered_text) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of every row of docs (FIELDS)."""
    spark = docs.sparkSession
    sc = spark.sparkContext
    with scope(spark) as outer:
        leaves = materialise(leaves_of(docs, tampered), "merkle-placed", outer)
        shape = leaves.agg(F.count("*").alias("rows"), F.max("size").alias("size"), (F.max("tree") + 1).alias("trees")).first()
        if not shape.rows:
            return spark.createDataFrame([], SCHEMA)
        node = lambda r: ((r[0], r[1]), (r[2], bytes(r[3]), r[4], None if r[5] is None else bytes(r[5])))
        some = lambda rows: leaves.where(rows).select("tree", "place", "size", "leaf", "doc_id", "arrived").rdd.map(node)
        lone = some("size = 1")
        trees, top = Supersteps(spark, outer), Supersteps(spark, outer)
        ended = lone.map(lambda x: (x[0][0], 0, x[1][1])).union(trees.up(some("size > 1"), shape.rows, _height(shape.size)))
        ended = trees.keep(ended, "subroots")
        subroots = ended.map(lambda x, n=shape.trees: ((TOP, x[0]), (n, x[2])))
        last = top.up(subroots, shape.trees, _height(shape.trees)) if shape.trees > 1 else ended
        root = last.first()[2]  # one digest
        paths = sc.parallelize([(0, b"")], 1)
        if top.levels:
            first = top.down(lambda level: sc.parallelize([((TOP, 0), b"")] if level == len(top.levels) else [], 1))
            paths = _met(top.levels[0], first, top.parts[0]).flatMap(lambda x: [(x[0][1] * ARITY + i, p) for i, p in enumerate(_paths([c[1] for c in x[1][0]], x[1][1]))])
        heights = ended.map(lambda x: (x[0], x[1]))
        seeds = trees.keep(_met(heights, paths, top.parts[0] if top.parts else 1), "seeds", True)  # (tree, (height, path))
        begun = lambda level: seeds.filter(lambda x: x[1][0] == level).map(lambda x: ((x[0], 0), x[1][1]))
        rows = _met(lone, begun(0), top.parts[0] if top.parts else 1).map(lambda x: proven(*x[1], 0, root))
        if trees.levels:
            met = _met(trees.levels[0], trees.down(begun), trees.parts[0])
            rows = met.flatMap(lambda x: [proven(c, p, _height(c[0]), root) for c, p in zip(x[1][0], _paths([c[1] for c in x[1][0]], x[1][1]), strict=True)]).union(rows)
        return spark.createDataFrame(rows, SCHEMA, verifySchema=False)
