"""The matching ladder: exact name, coating substitution, parameter signature, weighted score, coating variants.

Distinct names are matched once and joined back by whoever holds the rows. A name that one step
solves does not reach the next, and scored pairs exist once for each distinct set of attributes in a
block (standard, item type). Names whose block the catalogue does not have take the first block, in
its order, with the same type whose standard holds theirs or the other way round.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from itemforge.functions import coating, text
from itemforge.functions.collections import field_value
from itemforge.operators import masks as M
from itemforge.operators import scoring, tfidf
from itemforge.operators.cut import cut, merged

SIGNATURE_LEAST, SIGNATURE_RATIO = 4, 0.70
#: Field number of the runs of digits in a name.
IN_NAME = -1
#: Most classes in a slice of a list of postings, about: a task reads some slices.
SLICE = 1024
#: Scores that differ by less are equal, as they are and with three digits.
SLACK, ROUNDED = 1e-9, 1.1e-3


def extract(names: DataFrame) -> DataFrame:
    """names (name) with std (canonical) and item_type."""
    clean = text.clean_input(F.col("name"))
    found = names.withColumn("clean", clean).withColumn("found", text.standard(F.col("clean")))
    return found.withColumn("std", F.when(F.col("found").isNotNull(), text.canonical_standard(F.col("found.full_name")))).withColumn("item_type", text.item_type(F.col("clean"))).drop("found")


def _never_null(*names: str) -> list[Column]:
    """Join keys that are never null: the optimizer then has no null test to push below a distinct, where an extraction would run again on every row."""
    return [F.coalesce(F.col(n), F.lit("")).alias(f"_{n}") for n in names]


def exact_names(names: DataFrame, catalogue: DataFrame) -> DataFrame:
    """names joined to the first catalogue row of their block with the same key."""
    keyed = catalogue.withColumn("key", text.name_key(text.clean_input(F.col("cand_name")))).where("std is not null and item_type is not null and key is not null")
    keyed = keyed.groupBy("std", "item_type", "key").agg(F.min_by(F.struct("ens_code", "cand_name", "attrs", "cand_ord"), "cand_ord").alias("c"))
    right = keyed.select(*_never_null("std", "item_type", "key"), "c")
    left = names.withColumn("key", text.name_key(F.col("clean"))).select("*", *_never_null("std", "item_type", "key"))
    return left.join(right, ["_std", "_item_type", "_key"]).select(*[F.col(c) for c in names.columns], "c.*")


def signatures(names: DataFrame, catalogue: DataFrame) -> DataFrame:
    """names whose parameter values in the order of their keys, at least four of them, read like those of a named candidate.

    Only the candidate's values of the keys that were asked for count, at least four as well, and the
    name must have 0.7 of them. The lists of keys that occur are few, one for each kind of mask: each
    candidate is read once by each list of its block, and names meet candidates by list and values.
    """
    enough = names.withColumn("sorted", F.filter(F.array_sort("params"), lambda e: F.trim(e.v) != "")).where(F.size("sorted") >= SIGNATURE_LEAST)
    enough = enough.withColumn("keys", F.transform("sorted", lambda e: e.k)).withColumn("values", F.array_join(F.transform("sorted", lambda e: F.trim(e.v)), " ")).drop("sorted")
    lists = enough.select("std", "item_type", "keys").distinct()
    offered = lists.join(_distinct(catalogue).where("trim(cand_name) <> ''"), ["std", "item_type"])
    offered = offered.withColumn("theirs", F.filter(F.transform("keys", lambda k: F.trim(field_value(F.col("attrs"), k))), lambda v: v != ""))
    held = F.size("theirs")
    offered = offered.where((held >= SIGNATURE_LEAST) & (F.size("keys") >= SIGNATURE_RATIO * held)).withColumn("values", F.array_join("theirs", " "))
    first = offered.groupBy("std", "item_type", "keys", "values").agg(F.min_by(F.struct("cand_ord", "ens_code", "cand_name", "attrs", "forms"), "cand_ord").alias("c"))
    return enough.join(first, ["std", "item_type", "keys", "values"]).select(*[F.col(c) for c in names.columns], "c.*")


def blocks(names: DataFrame, catalogue: DataFrame) -> DataFrame:
    """names (std, item_type) with block_std and block_type, the block of the catalogue that they are compared with.

    Blocks are as many as standards and types, not as rows.
    """
    have = catalogue.groupBy("std", "item_type").agg(F.min("cand_ord").alias("ord")).toDF("block_std", "block_type", "ord").where("block_std is not null and block_type is not null")
    asked = names.select("std", "item_type").distinct().where("std is not null and item_type is not null")
    near = asked.join(have, F.lower("item_type") == F.lower("block_type")).where("contains(block_std, std) or contains(std, block_std)")
    rank = F.struct((F.col("std") != F.col("block_std")) | (F.col("item_type") != F.col("block_type")), "ord")
    found = near.groupBy("std", "item_type").agg(F.min_by(F.struct("block_std", "block_type"), rank).alias("b")).select(*_never_null("std", "item_type"), "b.*")
    return names.select("*", *_never_null("std", "item_type")).join(found, ["_std", "_item_type"], "left").drop("_std", "_item_type")


def _distinct(catalogue: DataFrame) -> DataFrame:
    """The first row of each distinct set of attributes and forms of the name in a block: no other can be better."""
    with_forms = catalogue.withColumn("forms", text.name_forms(F.col("cand_name")))
    return with_forms.groupBy("std", "item_type", "attrs", "forms").agg(F.min("cand_ord").alias("cand_ord"), F.min_by("ens_code", "cand_ord").alias("ens_code"), F.min_by("cand_name", "cand_ord").alias("cand_name"))


def _bag_key() -> Column:
    return F.md5(F.to_json(F.struct("std", "item_type", "params")))


def _posting(field: int, key: Column) -> Column:
    return F.struct(F.lit(field).alias("field"), key.alias("key"))


class Index:
    """Candidates of a catalogue by what they can share with a bag of parameters; made once, asked often.

    Candidates that are equal in the fields of keys and in the forms of their names score alike whatever is asked,
    so that the first of them stands for a class; no list of n best needs more than the first n of a class.
    rows: the distinct candidates (cid: their class, nth in it), the first n of each class if n is given.
    classes: what a comparison needs of each field of keys.
    postings: each class under its value of each number field, and under the runs of digits of its
    name, which a value that stands in the name must share; all are under the empty run. Long lists are in slices.
    """

    def __init__(self, catalogue: DataFrame, keys: list[str], n: int | None = None):
        self.keys = keys
        self.fields = [k for k in keys if k not in scoring.TEXT_FIELDS]
        own = _distinct(catalogue).withColumn("values", F.array(*[field_value(F.col("attrs"), F.lit(k)) for k in keys]).cast("array<string>"))
        alike = Window.partitionBy("std", "item_type", "values", "forms").orderBy("cand_ord")
        own = own.withColumn("own_id", F.monotonically_increasing_id()).withColumn("nth", F.row_number().over(alike))
        own = own.where(F.col("nth") <= n) if n else own
        self.rows = cut(own.withColumn("cid", F.first("own_id").over(alike)).drop("own_id", "values"), "offered")
        heads = self.rows.where("nth = 1").withColumn("c", scoring.flat_attrs(keys)).withColumn("block", F.xxhash64("std", "item_type"))
        heads = heads.select("cid", "block", "cand_ord", "forms", "c", scoring.text_key("c", keys).alias("theirs"), scoring.number_keys("c", keys).alias("held"))
        self.classes = cut(heads, "classes")
        listed = F.transform("held", lambda v, i: F.when(v.isNotNull(), F.struct(i.cast("int").alias("field"), v.alias("key"))))
        runs = F.transform(F.array_append(F.coalesce("forms.runs", F.array().cast("array<string>")), ""), lambda r: _posting(IN_NAME, r))
        every = F.array_distinct(F.filter(F.concat(listed, runs), lambda x: x.isNotNull()))
        filed = self.classes.select("block", "cid", "cand_ord", "theirs", "held", "forms", F.inline(every))
        self.sizes = cut(filed.groupBy("block", "field", "key").agg(F.count("*").alias("size")), "sizes")
        part = F.pmod(F.hash("cid"), _slices()).alias("part")
        self.postings = cut(filed.join(self.sizes, ["block", "field", "key"]).select(*filed.columns, part), "postings")


def _slices() -> Column:
    """Slices of a list of postings by its size."""
    return F.ceil(F.col("size") / SLICE).cast("int")


def scored(names: DataFrame, index: Index, n: int = 1) -> DataFrame:
    """bag, cid, cand_ord, score, exact_count: for each distinct bag of parameters, classes of its block that hold its n best.

    Bags with equal numbers meet the postings together, and of the classes with equal texts that fit in the same
    fields only the first n go on to the bags. Number fields are taken rarest first. The first one's classes, with the first
    classes of the best texts, give a score that a winner must reach; further fields are taken only while what
    the fields not taken yet can add, with all of the texts, still reaches it. Who shares no field that
    was taken and wins all the same can only owe it to its texts, and is then among the first of them.
    """
    keys, classes, spark = index.keys, index.classes, names.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    full, of_text = scoring.weight_sums(keys)
    asked = names.select("std", "item_type", "params").distinct().select(_bag_key().alias("bag"), F.xxhash64("std", "item_type").alias("block"), scoring.flat_params(keys).alias("p"))
    asked = asked.select("*", scoring.text_key("p", keys).alias("mine"), scoring.number_keys("p", keys).alias("wanted"), scoring.name_keys("p", keys).alias("low"), full.alias("full"), of_text.alias("of_text"))
    asked = cut(asked.withColumn("numbers", F.md5(F.to_json(F.struct("block", "wanted", "low")))), "asked")

    # what the texts add, once for each two that occur in a block; the first classes of the best texts
    some = lambda df, key, side: df.groupBy("block", key).agg(F.first(side).alias(side))  # noqa: E731  equal texts by key
    texts = cut(scoring.text_scores(some(asked, "mine", "p").join(some(classes, "theirs", "c"), "block"), keys), "texts")
    first_of = Window.partitionBy("block", "theirs").orderBy("cand_ord")
    leaders = classes.select("block", "theirs", "cid", "cand_ord", F.row_number().over(first_of).alias("r")).where(F.col("r") <= n)
    leaders = texts.where("text_gain > 0").join(leaders, ["block", "theirs"])
    if n == 1:
        by_text = Window.partitionBy("block", "mine").orderBy(F.col("text_gain").desc(), F.col("text_exact").desc(), "cand_ord")
        leaders = leaders.withColumn("r", F.row_number().over(by_text)).where("r = 1")
    by_texts = asked.select("numbers", "wanted", "low", "block", "mine").join(leaders.select("block", "mine", "cid"), ["block", "mine"])
    by_texts = by_texts.dropDuplicates(["numbers", "cid"]).join(classes.select("cid", "cand_ord", "theirs", "held", "forms"), "cid")

    # the number fields, rarest first; a value that stands in a name is sought by its longest run of digits
    run = lambda low: F.coalesce(F.array_max(F.transform(F.filter(F.split(low, "[^0-9.]+"), lambda t: t != ""), lambda t: F.struct(F.length(t), t.alias("t")))).t, F.lit(""))
    each = asked.dropDuplicates(["numbers"]).select("numbers", "wanted", "low", "block", F.posexplode(F.arrays_zip("wanted", "low")).alias("of", "v")).where("v.wanted is not null")
    each = each.select("numbers", "wanted", "low", "block", "of", F.inline(F.array(F.struct(F.col("of").alias("field"), F.col("v.wanted").alias("key")), _posting(IN_NAME, run(F.col("v.low"))))))
    looked = each.join(index.sizes, ["block", "field", "key"])
    by_size = Window.partitionBy("numbers").orderBy("total", "of")
    per_field = looked.groupBy("numbers", "wanted", "low", "block", "of").agg(F.sum("size").alias("total"), F.collect_list(F.struct("field", "key", "size")).alias("lists"))
    per_field = per_field.select("numbers", "wanted", "low", "block", F.row_number().over(by_size).alias("place"), F.count("*").over(by_size.rowsBetween(Window.currentRow, Window.unboundedFollowing)).alias("left"), F.inline("lists"))
    looked = cut(per_field, "fields")

    def met(taken: DataFrame) -> DataFrame:
        at = ["block", "field", "key", "part"]
        sliced = taken.select("numbers", "wanted", "low", "block", "field", "key", F.explode(F.sequence(F.lit(0), _slices() - 1)).alias("part"))
        # a fixed number of partitions: pairs are many and dear where the rows that they come from are few and small
        return sliced.repartition(tasks, *at).join(index.postings.repartition(tasks, *at), at)

    def kept(pairs: DataFrame) -> DataFrame:
        """Of classes with equal texts that fit the same numbers in the same fields the first n: they score alike."""
        like = ["numbers", "theirs", "fits"]
        fits = pairs.select("numbers", "theirs", scoring.number_fits(len(index.fields)).alias("fits"), "cand_ord", "cid")
        if n == 1:
            return fits.groupBy(*like).agg(F.min(F.struct("cand_ord", "cid")).alias("c")).select(*like, "c.*")
        return fits.distinct().withColumn("r", F.row_number().over(Window.partitionBy(*like).orderBy("cand_ord", "cid"))).where(F.col("r") <= n).drop("r")

    def judged(found: DataFrame) -> DataFrame:
        both = asked.select("bag", "numbers", "block", "mine", "full").join(found, "numbers").join(texts, ["block", "mine", "theirs"])
        return scoring.score_fits(both, len(index.fields)).select("bag", "cid", "cand_ord", "score", "exact_count").where("score > 0")

    columns = ["numbers", "wanted", "low", "cid", "cand_ord", "theirs", "held", "forms"]
    first = cut(kept(met(looked.where("place = 1")).select(*columns).unionByName(by_texts.select(*columns))), "first")
    slack = SLACK if n == 1 else ROUNDED  # lists of several go by rounded scores
    reached = scoring.best(judged(first), "bag", n, shown=False).groupBy("bag").agg(F.count("*").alias("n"), F.min("score").alias("last"))
    least = F.when(F.col("n") == n, (F.col("last") - slack) * F.col("full")).otherwise(0.0)
    needed = asked.select("bag", "numbers", "full", "of_text").join(reached, "bag", "left").groupBy("numbers").agg(F.min(least - F.col("of_text")).alias("needed"))
    taken = looked.where("place > 1").join(needed, "numbers").where(F.col("left") >= F.col("needed"))
    return judged(first.unionByName(kept(met(taken).select(*columns))).dropDuplicates(["numbers", "cid"]))


def best_candidates(names: DataFrame, index: Index, n: int = 1) -> DataFrame:
    """names with the n best candidates each: cand columns, score, exact_count, rank."""
    top = scoring.best(scored(names, index, n), "bag", n).drop("cand_ord", "rank")
    held = index.rows.where(F.col("nth") <= n).select("cid", "cand_ord", "ens_code", "cand_name", "attrs", "forms")
    top = scoring.best(top.join(held, "cid"), "bag", n)
    return names.withColumn("bag", _bag_key()).join(top, "bag").drop("bag", "cid")


def _coating(params: Column) -> Column:
    return F.get(F.filter(params, lambda e: e.k == scoring.COATING), 0).v


def _with_coating(value: Column) -> Column:
    return F.transform("params", lambda e: F.struct(e.k.alias("k"), F.when(e.k == scoring.COATING, value).otherwise(e.v).alias("v")))


def substitutions(best: DataFrame) -> DataFrame:
    """best (params, attrs of the best candidate by the parameters as they are) with corrected and material where a rule replaces the coating."""
    own = lambda k: F.get(F.filter("attrs", lambda e: (e.k == k) & (e.v != "")), 0).v
    material = F.coalesce(own("марка_материала"), own("марка_стали"))
    return best.withColumn("corrected", coating.substituted(material, _coating(F.col("params")))).withColumn("material", F.when(F.col("corrected").isNotNull(), material))


def by_variants(names: DataFrame, index: Index) -> DataFrame:
    """names without a scored candidate by the first other spelling of their coating that has one."""
    spelled = names.select("*", F.posexplode(coating.variants(_coating(F.col("params")))).alias("spelling", "v")).where("spelling > 0")
    spelled = spelled.withColumn("params", _with_coating(F.col("v"))).drop("v")
    found = best_candidates(spelled, index)
    w = Window.partitionBy("name").orderBy("spelling")
    return found.withColumn("_first", F.row_number().over(w)).where("_first = 1").drop("_first", "spelling")


def proposals(names: DataFrame, catalogue: DataFrame, n: int = 3) -> DataFrame:
    """name, near: array of the n catalogue rows (similarity, ens_code, cand_name, attrs) whose names are nearest by TF-IDF, best first."""
    rows = catalogue.where("cand_name is not null").groupBy("cand_name").agg(F.min("cand_ord").alias("id"), F.min_by(F.struct("ens_code", "cand_name", "attrs"), "cand_ord").alias("row"))
    near = tfidf.neighbours(names.select(F.col("name").alias("id"), F.col("name").alias("text")), rows.select("id", F.col("cand_name").alias("text")), n)
    near = near.withColumnRenamed("id", "name").join(rows.withColumnRenamed("id", "other"), "other")
    return near.groupBy("name").agg(F.array_sort(F.collect_list(F.struct("rank", F.round("similarity", 6).alias("similarity"), "row.*"))).alias("near"))


def _no_proposals(catalogue: DataFrame) -> DataFrame:
    row = catalogue.select("ens_code", "cand_name", "attrs").schema.simpleString().removeprefix("struct<").removesuffix(">")
    return catalogue.sparkSession.createDataFrame([], f"name string, near array<struct<rank: int, similarity: double, {row}>>")


def _in_words(names: DataFrame, catalogue: DataFrame, masks: DataFrame, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """The steps over names that have a block and a mask: what was found (columns), and those left over."""
    none = [F.lit(None).cast("string").alias(c) for c in ("corrected", "material")]
    exact = exact_names(names, catalogue).withColumn("match_type", F.lit("exact_name")).withColumn("score", F.lit(1.0)).select(*columns[:-2], *none)
    exact = cut(exact, "exact")
    rest = cut(names.join(exact.select("name"), "name", "left_anti"), "rest")
    index = Index(catalogue, M.param_names(masks), 1)
    plain = [c for c in columns if c != "match_type"]
    # only a coating that some rule replaces needs the best candidate's material before the next step
    doubtful = rest.where((F.size("params") > 0) & coating.replaceable(_coating(F.col("params"))))
    trial = cut(substitutions(best_candidates(doubtful, index)).select(*plain), "trial")
    replaced = trial.where("corrected is not null")
    changed = rest.join(replaced.select("name", "corrected", "material"), "name").withColumn("params", _with_coating(F.col("corrected")))
    rest = cut(rest.select("*", *none).join(replaced.select("name"), "name", "left_anti").unionByName(changed), "rest")
    same = cut(signatures(rest, catalogue).withColumn("match_type", F.lit("exact")).withColumn("score", F.lit(1.0)).select(*columns), "same")
    rest = cut(rest.join(same.select("name"), "name", "left_anti"), "rest")
    known = trial.where("corrected is null").join(rest.select("name"), "name", "left_semi")
    others = rest.where(F.size("params") > 0).join(trial.where("corrected is null").select("name"), "name", "left_anti")
    fuzzy = cut(known.unionByName(best_candidates(others, index).select(*plain)).withColumn("match_type", F.lit("fuzzy")), "fuzzy")
    rest = cut(rest.join(fuzzy.select("name"), "name", "left_anti"), "rest")
    near, spelled = fuzzy.select(*columns), rest.where(F.size("params") > 0)
    if spelled.limit(1).count():
        variant = by_variants(spelled, index).withColumn("match_type", F.lit("fuzzy_coating_variant")).withColumn("score", F.lit(0.8))
        near = near.unionByName(variant.select(*columns))
    swapped = F.col("corrected").isNotNull()
    near = near.withColumn("match_type", F.when(swapped, "exact_substitution").otherwise(F.col("match_type"))).withColumn("score", F.when(swapped, 1.0).otherwise(F.col("score")))
    return cut(exact.unionByName(same).unionByName(near.select(*columns)), "found"), rest


def match(names: DataFrame, masks: DataFrame, catalogue: DataFrame, success_threshold: float = scoring.SUCCESS) -> DataFrame:
    """One row for every distinct name: its extraction, the candidate found, how, and whether that is enough.

    name, std, item_type, mask_id, level, params, ens_code, ens_name, ens_attrs, ens_params, ens_params_mask, match_type,
    score, confidence, success, original, corrected, material (of a replaced coating), detail, near.

    Names without a standard or an item type are for a language model (level llm_direct). Those without a
    mask or a block of the catalogue get the nearest names by TF-IDF as proposals (level tfidf, near), never as a success.
    """
    bag, catalogue = "array<struct<k: string, v: string>>", merged(catalogue)
    # tables: else a condition on what is extracted moves below the distinct, to every row
    distinct = cut(names.select("name").distinct(), "names")
    parsed = M.parse(M.attach_masks(extract(distinct), masks), masks, "clean")
    parsed = cut(parsed.select("name", "clean", "std", "item_type", "mask_id", F.coalesce("params", F.array().cast(bag)).alias("params")), "read")
    parsed = blocks(parsed, catalogue).select("name", "clean", F.struct("std", "item_type").alias("own"), "mask_id", "params", F.col("block_std").alias("std"), F.col("block_type").alias("item_type"))
    level = F.when(F.col("own.std").isNull() | F.col("own.item_type").isNull(), "llm_direct").when(F.col("std").isNull() | F.col("mask_id").isNull(), "tfidf").otherwise("catalogue")
    parsed = cut(parsed.withColumn("level", level), "parsed")  # all steps read it
    columns = ["name", "params", "ens_code", "cand_name", "attrs", "match_type", "score", "corrected", "material"]
    found, _ = _in_words(parsed.where("level = 'catalogue'").drop("level"), catalogue, masks, columns)
    unplaced = parsed.where("level = 'tfidf'")
    near = cut(proposals(unplaced, catalogue), "near") if unplaced.limit(1).count() else _no_proposals(catalogue)
    first = F.get("near", 0)
    text_of = lambda c: F.lit(None).cast("string").alias(c)
    proposed = near.select("name", F.array().cast(bag).alias("params"), first.ens_code.alias("ens_code"), first.cand_name.alias("cand_name"), first.attrs.alias("attrs"), F.lit("tfidf").alias("match_type"), first.similarity.alias("score"), text_of("corrected"), text_of("material"))
    # what the mask reads in the candidate's name
    read = M.parse(found.unionByName(proposed).join(parsed.select("name", "mask_id"), "name"), masks, "cand_name", "ens_params_mask")
    read = read.withColumnRenamed("params", "used").drop("mask_id")
    swapped = F.col("corrected").isNotNull()
    joined = parsed.join(read, "name", "left").join(near, "name", "left").withColumn("original", F.when(swapped, _coating(F.col("params"))))
    joined = joined.withColumn("params", F.when(F.col("level") == "catalogue", F.coalesce("used", "params")).otherwise(F.array().cast(bag))).withColumn("substituted", swapped)
    compared = scoring.compare(scoring.asked(F.col("params")), scoring.offered(F.col("attrs")), text.name_forms(F.col("cand_name")))
    by_name = scoring.exact_detail(F.col("params"), F.col("attrs"))
    joined = joined.withColumn("detail", F.when(F.col("match_type") == "exact_name", by_name).when(F.col("match_type") != "exact", compared).otherwise(F.slice(by_name, 1, 0)))
    out = scoring.decide(joined, success_threshold)
    # an equal name of which the mask reads nothing has what it reads in the catalogue's
    empty = (F.col("match_type") == "exact_name") & (F.size("params") == 0) & F.col("ens_params_mask").isNotNull()
    out = out.withColumn("params", F.when(empty, F.col("ens_params_mask")).otherwise(F.col("params")))
    values = scoring.catalogue_params(F.col("params"), F.col("attrs"), F.col("ens_params_mask"))
    return out.select("name", "own.std", "own.item_type", "mask_id", "level", "params", "ens_code", F.col("cand_name").alias("ens_name"), F.col("attrs").alias("ens_attrs"), values.alias("ens_params"), "ens_params_mask", "match_type", "score", "confidence", "success", "original", "corrected", "material", "detail", "near")
