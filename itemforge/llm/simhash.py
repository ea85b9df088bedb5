"""Operator 8: SimHash fingerprints and permuted block tables. DataFrame functions only.

A text's terms are its pairs of neighbouring words (A-Z as a-z; the last word stands alone), each
with a weight of 1 to 3 that grows with the first word's length. A term's 128 hash bits vote with
that weight; a fingerprint bit is set if more than half of the weight votes for it. Votes are sums
of two 32-bit lanes in a long, so that all of them are plain sums in generated code.

Permuted block tables find all fingerprints within a Hamming radius: the bits are cut in radius + 2
blocks, of which two at least are equal in such a pair, and there is a table for each choice of two
blocks, keyed by them. near_pairs gives the pairs. near_classes gives what they connect, without all the
pairs of a large group: of each key one fingerprint is compared with all others, ROUNDS times with another
one, and then only fingerprints that share a key and are not connected yet are compared with each other.
RADIUS is 6 of 128 bits: about one term in a hundred of a text may change.

The next document in descending order of doc_id comes from a window over ranges of doc_id; only
the first document of each range is joined to the range before it.

Defined cases: null texts count as empty; a text without words has the fingerprint 0; a null doc_id
comes last, and no class has its name; rows with equal doc_id follow by the hash of their text; of a single row the next
document is itself; an empty table gives an empty result; columns other than doc_id and text are
not read.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from itemforge.llm.columns import let
from itemforge.llm.components import components
from itemforge.llm.storage import materialise, scope

ROWS_PER_RANGE = 4000
RADIUS, ROUNDS = 6, 3
LANES = (1 << 32) | 1
OWN, EDITED, HEAD = 0, 1, 2


def _terms(text: Column, kind: int) -> Column:
    """One long for each term: 60 bits of hash, 2 of kind, 2 of weight; a text without words gives one term of weight 0."""
    tagged = lambda h, w: F.shiftleft(h, 4).bitwiseOR(F.lit(kind * 4)).bitwiseOR(w)
    clean = F.lower(F.trim(text, F.lit(" \t\n\r\x0b\x0c")))
    weight = lambda w: F.least(F.lit(3), F.length(w).cast("int") / 4 + 1).cast("int")
    terms = let(F.split(clean, "[ \\t-\\r]+"), lambda ws: F.transform(ws, lambda w, i: tagged(F.xxhash64(w, F.get(ws, i + 1)), weight(w).cast("long"))))
    return F.when(clean == "", F.array(F.lit(kind * 4).cast("long"))).otherwise(terms)


def votes(texts: DataFrame, keys: list[str], arrays: Column) -> DataFrame:
    """keys, kind, bits_a, bits_b: the fingerprint of every kind of text in a row."""
    each = texts.select(*keys, F.explode(arrays).alias("e"))
    each = each.select(*keys, F.shiftright("e", 2).bitwiseAND(F.lit(3)).alias("kind"), F.col("e").bitwiseAND(F.lit(3)).alias("w"), F.xxhash64(F.shiftright("e", 4)).alias("a"), F.xxhash64(F.shiftright("e", 4), F.lit(1)).alias("b"))
    lane = lambda c, i: F.sum(F.shiftrightunsigned(c, i).bitwiseAND(F.lit(LANES)) * F.col("w")).alias(f"{c}{i}")
    sums = each.groupBy(*keys, "kind").agg(F.sum("w").alias("all"), *[lane(c, i) for c in "ab" for i in range(32)])
    bit = lambda v, at: F.when(v * 2 > F.col("all"), F.lit(1 << at if at < 63 else -(1 << 63))).otherwise(F.lit(0))
    both = lambda c: [bit(F.col(f"{c}{i}").bitwiseAND(F.lit((1 << 32) - 1)), i) for i in range(32)] + [bit(F.shiftrightunsigned(f"{c}{i}", 32), i + 32) for i in range(32)]
    return sums.select(*keys, "kind", *[reduce(Column.bitwiseOR, both(c)).alias(f"bits_{c}") for c in "ab"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, bits_a, bits_b (128 bits) of every row of docs (doc_id, text)."""
    rows = docs.select("doc_id", F.monotonically_increasing_id().alias("row"), F.coalesce("text", F.lit("")).alias("text"))
    return votes(rows, ["doc_id", "row"], _terms(F.col("text"), OWN)).select("doc_id", "bits_a", "bits_b")


def likeness(a: tuple[Column, Column], b: tuple[Column, Column]) -> Column:
    """Share of equal bits."""
    return 1 - (F.bit_count(a[0].bitwiseXOR(b[0])) + F.bit_count(a[1].bitwiseXOR(b[1]))) / 128.0


def _tables(prints: DataFrame, radius: int) -> DataFrame:
    """prints with key, once for each choice of two blocks of bits_a and bits_b."""
    n = radius + 2
    edges = [128 * i // n for i in range(n + 1)]

    def block(i: int) -> Column:
        lo, hi = edges[i], edges[i + 1]
        parts = []
        for c, base in (("bits_a", 0), ("bits_b", 64)):
            s, e = max(lo, base), min(hi, base + 64)
            if s < e:
                parts.append(F.shiftrightunsigned(c, s - base).bitwiseAND(F.lit((1 << (e - s)) - 1 if e - s < 64 else -1)))
        return F.xxhash64(*parts)

    return prints.withColumn("key", F.explode(F.array(*[F.xxhash64(F.lit(t), block(i), block(j)) for t, (i, j) in enumerate(combinations(range(n), 2))])))


def _distance(a: str, b: str) -> Column:
    return F.bit_count(F.col(f"{a}bits_a").bitwiseXOR(F.col(f"{b}bits_a"))) + F.bit_count(F.col(f"{a}bits_b").bitwiseXOR(F.col(f"{b}bits_b")))


def near_pairs(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """a_bits_a, a_bits_b, b_bits_a, b_bits_b, distance: pairs of different fingerprints within the radius, each once."""
    keyed = _tables(prints.select("bits_a", "bits_b").distinct(), radius)
    a, b = (keyed.select("key", F.col("bits_a").alias(f"{x}_bits_a"), F.col("bits_b").alias(f"{x}_bits_b")) for x in "ab")
    pairs = a.join(b, "key").where("a_bits_a < b_bits_a or (a_bits_a = b_bits_a and a_bits_b < b_bits_b)")
    return pairs.withColumn("distance", _distance("a_", "b_")).where(F.col("distance") <= radius).drop("key").distinct()


def near_classes(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """bits_a, bits_b, label of every different fingerprint of prints: equal labels for those that pairs within the radius connect."""
    with scope(prints.sparkSession) as outer:
        own = prints.select("bits_a", "bits_b").distinct().withColumn("id", F.monotonically_increasing_id())
        own = materialise(own, "simhash-prints", outer)
        keyed = _tables(own, radius)
        shared = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
        index = materialise(keyed.join(shared, "key"), "simhash-index")
        links, labels = None, own.select("id", F.col("id").alias("label"))
        for i in range(ROUNDS + 1):
            labelled = index.join(labels, "id")
            split = labelled.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high").select("key")
            open_ = materialise(labelled.join(split, "key"), "simhash-open")
            if not open_.limit(1).count():
                break
            if i < ROUNDS:
                lead = open_.groupBy("key").agg(F.min_by(F.struct("id", "label", "bits_a", "bits_b"), F.xxhash64("id", F.lit(i))).alias("o")).select("key", *[F.col(f"o.{c}").alias(f"o_{c}") for c in ("id", "label", "bits_a", "bits_b")])
                met = open_.join(lead, "key").where("label <> o_label")
            else:
                met = open_.join(open_.select("key", *[F.col(c).alias(f"o_{c}") for c in ("id", "label", "bits_a", "bits_b")]), "key").where("label < o_label")
            found = materialise(met.where(_distance("", "o_") <= radius).select(F.col("id").alias("a"), F.col("o_id").alias("b")).distinct(), "simhash-links")
            links = found if links is None else links.unionByName(found)
            reached = components(links)
            labels = materialise(own.select("id").join(reached, "id", "left").select("id", F.coalesce("label", "id").alias("label")), "simhash-labels", outer)
        return own.join(labels, "id").select("bits_a", "bits_b", "label")


def _with_next(docs: DataFrame) -> DataFrame:
    """range, place (from 1, in descending order), doc_id, text, next, last (the next text comes from another range)."""
    bounds = docs.agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.count("*").alias("n")).first()
    low, high = bounds.low or 0, bounds.high or 0
    width = (high - low) // max(1, bounds.n // ROWS_PER_RANGE) + 1
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.expr(f"(doc_id - {low}L) div {width}L"), F.lit(-1)).alias("range"))
    order = Window.partitionBy("range").orderBy(F.col("doc_id").desc_nulls_last(), F.xxhash64("text"))
    placed = rows.select("range", "doc_id", "text", F.row_number().over(order).alias("place"), F.lead("text").over(order).alias("next"))
    ids = rows.groupBy("range").agg(F.max("doc_id").alias("head"))
    heads = ids.alias("i").join(rows.alias("r"), F.expr("i.range = r.range and i.head <=> r.doc_id")).groupBy("i.range").agg(F.min_by("r.text", F.xxhash64("r.text")).alias("head_text"))
    ring = Window.orderBy(F.col("range").desc())  # a row for each range only
    after = ids.select("range", F.coalesce(F.lead("range").over(ring), F.first("range").over(ring)).alias("following"))
    following = after.join(heads.withColumnRenamed("range", "following"), "following").select("range", "head_text")
    return placed.join(following, "range").select("range", "place", "doc_id", "text", F.coalesce("next", "head_text").alias("next"), F.col("next").isNull().alias("last"))


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every row.

    Also class_id: the smallest doc_id that fingerprints within RADIUS bits of each other connect it with, itself included.
    """
    rows = _with_next(docs.select("doc_id", "text")).withColumn("n_chars", F.char_length("text").cast("long"))
    third = F.expr("cast(n_chars div 3 as int)")
    edited = F.concat(F.substring("text", F.lit(1), F.col("n_chars").cast("int") - third), F.substring("next", F.lit(1), third))
    rows = rows.withColumn("edited", edited)
    none = F.array().cast("array<long>")
    arrays = F.concat(_terms(F.col("text"), OWN), _terms(F.col("edited"), EDITED), F.when(F.col("last"), _terms(F.col("next"), HEAD)).otherwise(none))
    keys = ["range", "place", "doc_id", "n_chars", "edited_sha256"]
    kinds = votes(rows.withColumn("edited_sha256", F.sha2("edited", 256)), keys, arrays)
    pick = lambda c, kind: F.max(F.when(F.col("kind") == kind, F.col(f"bits_{c}")))
    prints = kinds.groupBy(*keys).agg(*[pick(c, k).alias(f"{n}_{c}") for k, n in ((OWN, "own"), (EDITED, "edited"), (HEAD, "head")) for c in "ab"])
    order = Window.partitionBy("range").orderBy("place")
    prints = prints.select("*", *[F.coalesce(f"head_{c}", F.lead(f"own_{c}").over(order)).alias(f"next_{c}") for c in "ab"])
    of = lambda n: (F.col(f"{n}_a"), F.col(f"{n}_b"))
    text = lambda n: F.concat(*[F.lpad(F.lower(F.hex(c)), 16, "0") for c in of(n)])
    out = prints.select("doc_id", "n_chars", "edited_sha256", text("own").alias("fingerprint"), text("edited").alias("edited_fingerprint"), likeness(of("own"), of("edited")).alias("near_edited"), likeness(of("own"), of("next")).alias("near_next"), F.col("own_a").alias("bits_a"), F.col("own_b").alias("bits_b"))
    out = materialise(out, "simhash-rows")
    first = out.groupBy("bits_a", "bits_b").agg(F.min("doc_id").alias("first"))
    classes = near_classes(first).join(first, ["bits_a", "bits_b"])
    least = classes.groupBy("label").agg(F.min("first").alias("class_id"))
    return out.join(classes.join(least, "label").select("bits_a", "bits_b", "class_id"), ["bits_a", "bits_b"]).drop("bits_a", "bits_b")
