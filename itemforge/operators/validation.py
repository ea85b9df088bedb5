"""Masks against rows of the catalogue: every parameter of every example, and what a name goes through step by step."""

from __future__ import annotations


from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from itemforge.functions.collections import as_map, let
from itemforge.functions.numbers import normalized, values_match
from itemforge.operators.parsers import by_position
from itemforge.operators.patterns import expected_key

# Fields that say nothing about an example, however they are listed.
META_ONLY = ["код", "mdm_key", "id", "автор_последнего_изменения", "дата_последнего_изменения"]
EXECUTION = "исполнение"


def with_execution(text: Column, attrs: Column) -> Column:
    """The text with the first bare execution of the example, ' 1-', in parentheses."""
    value = F.trim(F.get(F.filter(attrs, lambda e: (e.k == EXECUTION) & (F.trim(e.v) != "")), 0).v)
    bare, at = F.concat(F.lit(" "), value, F.lit("-")), F.instr(text, F.concat(F.lit(" "), value, F.lit("-")))
    there = F.contains(text, F.concat(F.lit("("), value, F.lit(")")))
    changed = F.concat(F.substring(text, F.lit(1), at - 1), F.lit(" ("), value, F.lit(")-"), F.substring(text, at + F.length(bare), F.length(text)))
    return F.when(value.isNull() | there | (at == 0), text).otherwise(changed)


def spread(rows: DataFrame) -> DataFrame:
    """rows over the tasks of a shuffle: the work on a row is dear, and a table of a few megabytes would be one task's."""
    spark = rows.sparkSession
    return rows.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism))


def each_result(checked: DataFrame, *columns: str) -> DataFrame:
    """columns with param, status, got, expected of each result.

    Outer: a plain inline has the optimizer test the results for emptiness below, with all that they are made of computed again.
    """
    return checked.select(*columns, F.inline_outer("results")).where("param is not null")


def check(rows: DataFrame, pattern: str, params: list[str], required: list[str], std: str, item_type: str, skip: list[str] = (), twins: list[list[str]] = ()) -> DataFrame:
    """rows (text, attrs: array<struct<k, v>>) with stage, success and results: array<struct<param, status, got, expected>>.

    pattern is searched for in the text without regard to case; its numbered groups are params. Where it
    is not found, the text is read token by token; whatever that gives is a success, its statuses are found and absent. What a found
    pattern reads is brought to the catalogue's form first. Required parameters are missing if only the catalogue has
    them, optional ones mismatched; where the catalogue has none, all is ok. Without either reading or without
    a text the stage is none; results then hold what the catalogue has for the required ones.
    """
    checked = [p for p in params if p not in skip]
    optional = [p for p in params if p not in required and p not in META_ONLY]
    text, keys = F.col("_text"), F.transform("attrs", lambda e: e.k)

    def expected(p: str) -> Column:
        return let(expected_key(keys, F.lit(p), twins), lambda key: F.get(F.filter("attrs", lambda e: e.k == key), 0).v)

    found = text.rlike(f"(?iu){pattern}")
    groups = F.filter(F.array(*[F.struct(F.lit(p).alias("k"), F.nullif(F.trim(F.regexp_extract(text, f"(?iu){pattern}", i + 1)), F.lit("")).alias("v")) for i, p in enumerate(params)]), lambda e: e.v.isNotNull())
    read = let(groups, lambda g: normalized(as_map(g), F.lit(std)))
    tokens = by_position(text, F.lit(std), item_type, params, set(params) - set(required))
    every = [p for p in checked if p in required or p in optional]
    # each step is a column of its own, computed once; only the reading that the stage needs
    staged = spread(rows).withColumn("_text", with_execution(F.trim(F.col("text")), F.col("attrs"))).withColumn("_found", F.coalesce(found, F.lit(False)))
    staged = staged.withColumns({"_read": F.when(F.col("_found"), read), "_tokens": F.when(~F.col("_found"), tokens), "_wanted": F.array(*map(expected, every)).cast("array<string>")})
    stage = F.when(F.col("_found"), "pattern").when(F.coalesce(F.size("_tokens"), F.lit(0)) > 0, "tokens").otherwise("none")
    staged = staged.withColumn("stage", F.when(F.trim("text") != "", stage).otherwise("none"))

    def result(i: int, p: str) -> Column:
        got, want = F.element_at("_read", p), F.get("_wanted", F.lit(i))
        blank = lambda c: F.coalesce(F.trim(c) == "", F.lit(True))
        lost, wrong = ("missing" if p in required else "mismatch"), ~F.coalesce(values_match(got, want, F.lit(p)), F.lit(False))
        by_pattern = F.when(blank(want), "ok").when(blank(got), lost).when(wrong, "mismatch").otherwise("ok")
        by_token = F.get(F.filter("_tokens", lambda e: e.k == p), 0).v
        told = F.when(F.col("stage") == "pattern", by_pattern).when(F.col("stage") == "tokens", F.when(by_token.isNotNull(), "found").otherwise("absent")).otherwise("unread")
        return F.struct(F.lit(p).alias("param"), told.alias("status"), F.when(F.col("stage") == "pattern", got).when(F.col("stage") == "tokens", by_token).alias("got"), want.alias("expected"))

    results = F.array(*[result(i, p) for i, p in enumerate(every)]) if every else F.array().cast("array<struct<param: string, status: string, got: string, expected: string>>")
    shown = F.filter(results, lambda r: (F.col("stage") != "none") | r.param.isin([p for p in checked if p in required]))
    out = staged.withColumn("results", shown).drop("_text", "_found", "_read", "_tokens", "_wanted")
    return out.withColumn("success", (F.col("stage") == "tokens") | ((F.col("stage") == "pattern") & ~F.exists("results", lambda r: r.status != "ok")))


def summary(checked: DataFrame) -> DataFrame:
    """total, matched, score, by_pattern, by_tokens, missing, mismatched of checked examples."""
    lost = lambda s: F.count_if(F.exists("results", lambda r: r.status == s))
    stage = lambda s: F.count_if(F.col("stage") == s)
    score = F.coalesce(F.try_divide(F.count_if("success"), F.count("*")), F.lit(0.0))
    return checked.agg(F.count("*").alias("total"), F.count_if("success").alias("matched"), score.alias("score"), stage("pattern").alias("by_pattern"), stage("tokens").alias("by_tokens"), lost("missing").alias("missing"), lost("mismatch").alias("mismatched"))


class Diagnosis:
    """Table function over the names of one mask (PARTITION BY mask_id): its pattern is compiled once for all of them.

    Rows name, stage, key, value in the order of the steps: extraction, mask, then the groups of a match or, without one, the longest
    beginning of the name in which the pattern is found, and what follows it.
    """

    def __init__(self) -> None:
        self.of, self.pattern = None, None

    def eval(self, row):  # noqa: ANN001, ANN201  Row of name, std, item_type, mask_id, pattern, params
        import regex

        name = row["name"]
        yield name, "extract", "standard", row["std"]
        yield name, "extract", "item_type", row["item_type"]
        yield name, "mask", "id", None if row["mask_id"] is None else str(row["mask_id"])
        if row["pattern"] is None or name is None:
            return
        if self.of != row["pattern"]:
            self.of = row["pattern"]
            try:
                self.pattern = regex.compile(self.of, regex.I)
            except regex.error as e:
                self.pattern = str(e)
        if isinstance(self.pattern, str):
            yield name, "mask", "error", self.pattern
            return
        found = self.pattern.search(name)
        if found:
            for key, value in zip(row["params"], found.groups(), strict=False):
                yield name, "match", key, value
            return
        # found in a beginning only where the pattern has an end; then in all shorter ones up to the match's
        n = next((i for i in range(len(name) - 1, 0, -1) if self.pattern.search(name[:i])), 0)
        yield name, "prefix", "length", str(n)
        yield name, "prefix", "rest", name[n:]


def diagnosed(names: DataFrame, masks: DataFrame) -> DataFrame:
    """name, stage, key, value: what happens to each name (name, std, item_type, mask_id)."""
    spark = names.sparkSession
    spark.udtf.register("itemforge_diagnosis", F.udtf(Diagnosis, returnType="name string, stage string, key string, value string"))
    rules = masks.select(F.col("id").alias("_id"), "pattern", "params")
    rows = names.select("name", "std", "item_type", "mask_id").join(rules, F.col("mask_id") == F.col("_id"), "left").drop("_id")
    return spark.sql("SELECT * FROM itemforge_diagnosis(TABLE(SELECT * FROM {rows}) PARTITION BY (mask_id, pmod(xxhash64(name), 64)))", rows=rows)


def stages_of(told: DataFrame) -> DataFrame:
    """stage, key, n: how many names have what in a diagnosis."""
    return told.groupBy("stage", "key").agg(F.count("*").alias("n"))


