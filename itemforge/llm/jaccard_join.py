"""Operator 4: n-gram Jaccard join through a token-group matrix; exact.

Two sets link when their Jaccard coefficient is t = NUM/DEN at least. Equal sets are one class, named
by a 64-bit hash of the set, and a class counts once, whatever the number of its rows.

1. Every class sends 40 bits of its token hashes to the partitions of the token space. A token that
   no other set has can't be common to two, so a set needs ceil(t n) tokens that others have; sets
   with fewer leave here. Where two tokens of a set agree in the 40 bits, the set counts the second
   one as shared without asking (`lost`), so shortening can only make a set stay; links are verified
   on 64 bits.
2. The rest is partitioned into groups: MinHash proposes one partner for each set, the one whose
   tokens are spread most widely, as copies are nearer to their origin than to each other; the link
   is verified exactly, and verified links make the groups, each connected in itself.
3. The token-group matrix: the tokens of all sets are ordered from rare to common. The overlap of
   sets that link is t (n_a + n_b) / (1 + t) at least: t n_a or more of the larger one, 2 t / (1 + t)
   n_b or more of the smaller one. The smaller one is indexed by so many of its first shared tokens
   that fewer than that are left, the larger one asks by so many of its own; they have one of these
   in common. A row of the matrix is a token with the groups of all sets that are indexed by it. A
   query set meets the groups in its rows: one row for each query and group, not for each token.
4. Each met group is stored in blocks of a bounded size with the union of its tokens. The number of a
   query's tokens in the union bounds its overlap with any member from above; only groups that reach
   the least overlap are opened. In an opened group members of a fitting size are compared by parity
   sketches (the bits that differ are never more than the tokens that differ, so no link is lost);
   those that pass are verified exactly, the nearest first, up to the first link: the members of a
   group are connected, so one link joins the query to all of them.
5. Components over all verified links.

Within a group nothing is compared any more and links are one for each query and group, so a group of
thousands of near copies makes rows in proportion to its size. What remains quadratic is the
comparison of sketches between a large group and the sets that come near to it without a link; it is
dealt in blocks of queries and members, and gives no rows. No link between different components can
be lost, so components are exact.

Defined cases: null and empty texts have an empty set, size 0, and their own id as component; texts
with fewer than K words are one shingle of all words; very long texts are hashed whole, a slice of
SLICE bytes or one text at a time; rows that share a doc_id each keep their own set, and their
component is the smallest doc_id that it reaches; a row with a null doc_id takes part, and gets a
null component where only null ids are reached; equal shares of a MinHash vote fall to the smaller
class name; an empty table gives an empty result; columns other than doc_id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from itemforge.llm.components import components
from itemforge.llm.storage import materialise
from itemforge.llm.words import U, binary, mix, shingle_sets, slices

K, NUM, DEN = 5, 75, 100
MINHASHES = 8
#: MinHash values that a proposed partner shares at least.
AGREE = 3
FLUSH_TOKENS = 1_000_000
TOKENS_PER_PART = 2_000_000
SLICE = 1 << 20
#: Bytes of token hashes of the members, and of the queries, that one task compares.
BLOCK_BYTES = 4 << 20
#: Widest parity sketch in bits.
SKETCH = 4096
_SEEDS = mix(np.arange(1, MINHASHES + 1, dtype=np.uint64) * U(0xA0761D6478BD642F))


def _sets(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    for batch in batches:
        for part in slices(batch, limit=SLICE):
            yield part, shingle_sets(part.column("text"), k)


def _class(tokens: np.ndarray) -> int:
    """Name of the class of equal sets."""
    return int(mix(tokens).sum(dtype=np.uint64).view(np.int64))


def signatures(docs: DataFrame, k: int = K) -> DataFrame:
    """doc_id, n (size of the set), class, check (together 128 bits that tell sets apart)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, sets in _sets(batches, k):
            check = np.array([np.bitwise_xor.reduce(mix(s + U(0x1234567))) if len(s) else 0 for s in sets], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array([_class(s) for s in sets], pa.int64()), pa.array(check)], names=["doc_id", "n", "class", "check"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, class long, check long")


def shared_tokens(docs: DataFrame, parts: int, k: int, num: int = NUM, den: int = DEN) -> DataFrame:
    """class, n, r, tokens (spread: how many classes have each; token; rare ones first) of the classes that share enough tokens with others.

    Tokens meet by token, and what is left of them by class; both times packed, a row for each pair of partitions.
    """

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names: dict[int, tuple[int, int]] = {}
        held: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            whole = np.concatenate(held)
            doc = np.repeat(np.arange(len(held), dtype=np.int64), [len(x) for x in held])
            tokens, part = (whole >> U(24)).astype(np.int64), ((mix(whole ^ U(0x6A09E667F3BCC909)) & U(0xFFFFFF)) % U(parts)).astype(np.int64)
            order = np.lexsort((tokens, part))
            cut = np.searchsorted(part[order], np.arange(parts + 1))
            table = np.array([(c, n, lost) for c, (n, lost) in names.items()], np.int64)
            blobs, at = [], []
            for p in range(parts):
                rows = order[cut[p] : cut[p + 1]]
                if len(rows):
                    own, local = np.unique(doc[rows], return_inverse=True)
                    steps = np.diff(tokens[rows], prepend=0)
                    wide = int(steps.max() >= 1 << 32)
                    head = np.array([len(own), len(rows), wide], np.int64)
                    blobs.append(head.tobytes() + table[own].tobytes() + steps.astype(np.uint64 if wide else np.uint32).tobytes() + local.astype(np.uint32 if len(own) > 65535 else np.uint16).tobytes())
                    at.append(p)
            names.clear()
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(blobs, pa.binary())], names=["part", "blob"])

        count = 0
        for _, sets in _sets(batches, k):
            for s in sets:
                if len(s) and (own := _class(s)) not in names:  # copies near each other are sent once
                    short = s >> U(24)
                    names[own] = len(s), int((short[1:] == short[:-1]).sum())
                    held.append(s)
                    count += len(s)
            if count >= FLUSH_TOKENS:
                yield flush()
                count = 0
        if held:
            yield flush()

    def meet(table: pa.Table) -> pa.Table:
        tokens, classes, sizes = [], [], []
        for x in table.column("blob").to_pylist():
            n_docs, n, wide = np.frombuffer(x, np.int64, 3).tolist()
            own = np.frombuffer(x, np.int64, 3 * n_docs, 24).reshape(-1, 3)
            at = 24 + 24 * n_docs
            tokens.append(np.cumsum(np.frombuffer(x, np.uint64 if wide else np.uint32, n, at), dtype=np.int64))
            local = np.frombuffer(x, np.uint32 if n_docs > 65535 else np.uint16, n, at + (8 if wide else 4) * n)
            classes.append(own[local, 0])
            sizes.append((own[local, 1] << 32 | own[local, 2]).astype(np.int64))
        t = np.concatenate(tokens)
        tokens.clear()
        order = np.argsort(t, kind="stable")
        same = t[order[1:]] == t[order[:-1]]
        rows = order[np.append(same, False) | np.append(False, same)]  # tokens that came more than once
        del order, same
        t, c, n = t[rows], np.concatenate(classes)[rows], np.concatenate(sizes)[rows]
        classes.clear()
        order = np.lexsort((c, t))
        t, c, n = t[order], c[order], n[order]
        first = np.ones(len(t), bool)
        first[1:] = (t[1:] != t[:-1]) | (c[1:] != c[:-1])
        t, c, n = t[first], c[first], n[first]
        begin = np.flatnonzero(np.append(True, t[1:] != t[:-1])) if len(t) else np.zeros(0, int)
        spread = np.repeat(np.diff(np.append(begin, len(t))), np.diff(np.append(begin, len(t))))
        rows = np.flatnonzero(spread > 1)
        name = np.int64(table.column("part")[0].as_py() if len(table) else 0) << 40
        t, c, n, spread = t[rows] | name, c[rows], n[rows], spread[rows].astype(np.int32)
        to = (mix(c.view(np.uint64) ^ U(0x3C6EF372FE94F82B)) % U(parts)).astype(np.int64)
        order = np.argsort(to, kind="stable")
        cut = np.searchsorted(to[order], np.arange(parts + 1))
        at, blobs = [], []
        for p in np.flatnonzero(np.diff(cut)).tolist():
            rows = order[cut[p] : cut[p + 1]]
            own, first, local = np.unique(c[rows], return_index=True, return_inverse=True)
            head = np.array([len(own), len(rows)], np.int64)
            blobs.append(b"".join(x.tobytes() for x in (head, own, n[rows][first], t[rows], spread[rows], local.astype(np.int32))))
            at.append(p)
        return pa.table({"part": pa.array(at, pa.int32()), "blob": pa.array(blobs, pa.binary())})

    def gather(table: pa.Table) -> pa.Table:
        cols: list[list[np.ndarray]] = [[] for _ in range(4)]
        for x in table.column("blob").to_pylist():
            n_own, n = np.frombuffer(x, np.int64, 2).tolist()
            own, sizes = np.frombuffer(x, np.int64, 2 * n_own, 16).reshape(2, -1)
            at = 16 + 16 * n_own
            local = np.frombuffer(x, np.int32, n, at + 12 * n)
            for to, value in zip(cols, (own[local], sizes[local], np.frombuffer(x, np.int64, n, at), np.frombuffer(x, np.int32, n, at + 8 * n)), strict=True):
                to.append(value)
        c, n, t, spread = (np.concatenate(x) for x in cols)
        cols.clear()
        order = np.argsort(c, kind="stable")
        start = np.flatnonzero(np.append(True, c[order][1:] != c[order][:-1]))
        held = np.diff(np.append(start, len(c)))
        size, lost = n[order][start] >> 32, n[order][start] & 0xFFFFFFFF
        enough = held + lost >= (num * size + den - 1) // den
        order = order[np.repeat(enough, held)]
        order = order[np.lexsort((t[order], spread[order], c[order]))]
        held, size, lost = held[enough], size[enough], lost[enough]
        offsets = np.append(0, np.cumsum(held)).astype(np.int32)
        pairs = pa.StructArray.from_arrays([pa.array(spread[order]), pa.array(t[order])], names=["spread", "token"])
        return pa.table({"class": c[order][offsets[:-1]], "n": size, "r": held + lost, "tokens": pa.ListArray.from_arrays(pa.array(offsets), pairs)})

    sent = docs.select("text").mapInArrow(send, "part int, blob binary")
    met = sent.groupBy("part").applyInArrow(meet, "part int, blob binary")
    return met.groupBy("part").applyInArrow(gather, "class long, n long, r long, tokens array<struct<spread: int, token: long>>")


def _needed(n: str, num: int, den: int) -> str:
    """Least overlap of a set of size n with any partner."""
    return f"(({num} * {n} + {den - 1}) div {den})"


def _overlap(a: str, b: str, num: int, den: int) -> str:
    """Least overlap of sets of these sizes that link."""
    return f"(({num} * ({a} + {b}) + {num + den - 1}) div {num + den})"


def _verified(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs a, b whose whole sets have a Jaccard coefficient of num / den at least."""

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("set_a"), batch.column("set_b"), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                keep.append(linked(x, y, num, den))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    own = sets.select("class", "tokens")
    full = pairs.join(own.toDF("a", "set_a"), "a").join(own.toDF("b", "set_b"), "b")
    return full.select("a", "b", "set_a", "set_b").mapInArrow(test, "a long, b long")


def linked(x: np.ndarray, y: np.ndarray, num: int, den: int) -> bool:
    """Whether two sorted sets have a Jaccard coefficient of num / den at least."""
    both = np.concatenate((x, y))
    both.sort(kind="stable")
    common = int((both[1:] == both[:-1]).sum())
    return den * common >= num * (len(x) + len(y) - common)


def sketches(sets: list[np.ndarray], bits: int) -> np.ndarray:
    """For each set bits / 64 words: a bit says whether the number of tokens that fall on it is odd."""
    out = np.zeros(len(sets) * (bits >> 6), np.uint64)
    owner = np.repeat(np.arange(len(sets), dtype=np.int64), [len(s) for s in sets])
    place, times = np.unique(owner * bits + (mix(np.concatenate(sets)) & U(bits - 1)).astype(np.int64), return_counts=True)
    place = place[times % 2 == 1]
    if len(place):
        word = place >> 6
        start = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
        out[word[start]] = np.bitwise_or.reduceat(U(1) << (place & 63).astype(np.uint64), start)
    return out.reshape(len(sets), -1)


def witnesses(members: list[np.ndarray], queries: list[np.ndarray], needs: list[int], num: int, den: int) -> Iterator[tuple[int, int]]:
    """(query, member): one link for each query that has any with the members, which are connected among themselves."""
    union = np.unique(np.concatenate(members))
    sizes = np.array([len(m) for m in members])
    bits = 512
    while bits < SKETCH and bits < 4 * np.median(sizes):
        bits *= 2
    marks = None
    for q, (x, need) in enumerate(zip(queries, needs, strict=True)):
        at = np.minimum(np.searchsorted(union, x), len(union) - 1)
        if int((union[at] == x).sum()) < need:
            continue
        if marks is None:
            marks, asked = sketches(members, bits), sketches(queries, bits)
        fits = np.flatnonzero((num * sizes <= den * len(x)) & (num * len(x) <= den * sizes))
        differ = np.bitwise_count(marks[fits] ^ asked[q]).sum(axis=1, dtype=np.int64)
        near = (num + den) * differ <= (den - num) * (sizes[fits] + len(x))
        fits = fits[near][np.argsort(differ[near], kind="stable")]
        found = next((m for m in fits.tolist() if linked(x, members[m], num, den)), None)
        if found is not None:
            yield q, found


def _opened(met: DataFrame, held: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """a, b: verified links of the queries of met (a, n_a, other, need) with members of the group other, in blocks of both."""
    blocks = lambda n: F.greatest(F.lit(1), F.ceil(F.sum(n) * 8 / BLOCK_BYTES)).cast("int")
    shape = met.groupBy("other").agg(blocks("n_a").alias("rows")).join(held.groupBy(F.col("group").alias("other")).agg(blocks("n").alias("columns")), "other")
    block = lambda key, n: F.pmod(F.xxhash64(key), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = sets.select("class", "tokens")
    left = held.select("class", F.col("group").alias("other")).join(shape, "other").join(own, "class").select("other", block("class", "columns").alias("c"), every("rows").alias("r"), "class", "tokens")
    right = met.select(F.col("a").alias("class"), "other", "need").join(shape, "other").join(own, "class").select("other", block("class", "rows").alias("r"), every("columns").alias("c"), F.col("class").alias("a"), "need", F.col("tokens").alias("asked"))

    def find(key: tuple, members: pa.Table, queries: pa.Table) -> pa.Table:
        a, b = [], []
        if len(members) and len(queries):
            opened = lambda c: [np.frombuffer(x.as_buffer(), np.uint64) for x in c]
            mine, theirs = queries.column("a").to_pylist(), members.column("class").to_pylist()
            for q, m in witnesses(opened(members.column("tokens")), opened(queries.column("asked")), queries.column("need").to_pylist(), num, den):
                a.append(mine[q])
                b.append(theirs[m])
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return left.groupBy("other", "c", "r").cogroup(right.groupBy("other", "c", "r")).applyInArrow(find, "a long, b long")


def near_links(docs: DataFrame, classes: DataFrame, total: int, k: int = K, num: int = NUM, den: int = DEN) -> DataFrame:
    """id, label: the component of every class that has a link. classes: class, rep (a doc_id of it); total: tokens of all sets."""
    spark = docs.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), total // TOKENS_PER_PART)
    live = materialise(shared_tokens(docs, parts, k, num, den), "jaccard-live")

    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, sets in _sets(batches, k):
            sets = [s for s in sets if len(s)]
            low = np.array([[mix(s ^ x).min() for x in _SEEDS] for s in sets], np.uint64).reshape(-1, MINHASHES)
            yield pa.RecordBatch.from_arrays([pa.array([_class(s) for s in sets], pa.int64()), pa.array(list(low.view(np.int64)), pa.list_(pa.int64())), binary(sets)], names=["class", "low", "tokens"])

    reps = classes.join(live.select("class"), "class", "left_semi").select("rep").distinct()
    texts = docs.select("doc_id", "text").join(reps, F.col("doc_id").eqNullSafe(F.col("rep")), "left_semi").select("text")
    texts = texts.mapInArrow(sets_of, "class long, low array<long>, tokens binary").join(live.select("class"), "class", "left_semi")
    sets = materialise(texts.dropDuplicates(["class"]), "jaccard-sets")

    central = live.select("class", F.struct((F.aggregate("tokens", F.lit(0).cast("long"), lambda x, e: x + e.spread) / F.col("n")).alias("spread"), (-F.col("class")).alias("old")).alias("rank"))
    low = sets.join(central, "class").select("class", "rank", F.posexplode("low").alias("i", "value"))
    lead = low.groupBy("i", "value").agg(F.max_by("class", "rank").alias("b"), F.max("rank").alias("top"), F.count("*").alias("size")).where("size > 1").drop("size")
    votes = low.join(lead, ["i", "value"]).where("rank < top").groupBy(F.col("class").alias("a"), "b").agg(F.count("*").alias("votes")).where(F.col("votes") >= AGREE)
    first = votes.groupBy("a").agg(F.max_by("b", F.struct("votes", -F.col("b"))).alias("b"))
    near = materialise(_verified(first, sets, num, den), "jaccard-links")
    groups = components(near)

    held = live.join(groups, live["class"] == groups.id, "left").select("class", "n", "r", F.coalesce("label", "class").alias("group"), F.transform("tokens", lambda e: e.token).alias("tokens"))
    held = materialise(held, "jaccard-held")
    ranked = held.select("class", "n", "r", "group", F.posexplode(F.expr(f"slice(tokens, 1, cast(r - {_needed('n', num, den)} + 1 as int))")).alias("place", "token"))
    # the larger set of a pair asks, by the tokens above; the smaller one is indexed by fewer, as their overlap is 2 t / (1 + t) of it at least
    indexed = ranked.withColumn("indexed", F.expr(f"place <= r - {_overlap('n', 'n', num, den)}"))
    several = indexed.groupBy("token").agg(F.min("group").alias("least"), F.max("group").alias("most"), F.max("indexed").alias("any")).where("least < most and any").select("token")
    index = materialise(indexed.join(several, "token").drop("place"), "jaccard-index")
    matrix = index.where("indexed").groupBy("token", F.col("group").alias("other")).agg(F.min("n").alias("low"), F.max("n").alias("high"))
    met = index.join(matrix, "token").where("group <> other and low <= n").where(f"n * {num} <= high * {den}")
    met = met.withColumn("need", F.expr(_overlap("n", f"greatest(low, {_needed('n', num, den)})", num, den))).where("need <= r")
    met = materialise(met.groupBy(F.col("class").alias("a"), F.col("n").alias("n_a"), "other").agg(F.min("need").alias("need")), "jaccard-met")
    far = materialise(_opened(met, held.select("class", "n", "group"), sets, num, den), "jaccard-links")
    return components(near.union(far)) if far.limit(1).count() else groups


def jaccard_components(docs: DataFrame, k: int = K, num: int = NUM, den: int = DEN) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of docs (doc_id, text)."""
    rows = materialise(signatures(docs, k), "jaccard-rows")
    total = rows.agg(F.sum("n")).first()[0] or 0
    classes = rows.where("n > 0").groupBy("n", "class", "check").agg(F.min("doc_id").alias("rep"))
    labels = near_links(docs, classes.select("class", "rep"), total, k, num, den)
    classes = classes.join(labels, classes["class"] == labels.id, "left").select("n", "class", "check", "rep", "label")
    least = classes.where("label is not null").groupBy("label").agg(F.min("rep").alias("least"))
    classes = classes.join(least, "label", "left").select("n", "class", "check", F.coalesce("least", "rep").alias("component"))
    return rows.join(classes, ["n", "class", "check"], "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))
