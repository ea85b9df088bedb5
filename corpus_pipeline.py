"""Corpus pipeline: language ID, near-duplicate removal, repeated spans, decontamination, tokens.

Each stage is a function (spark, docs, sf_dir) -> DataFrame; all but the last return the columns of
documents. Each stage sees all that the one before it kept, through a Parquet table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from itemforge.llm import decontamination, jaccard_join, language_id, piece_sampling, sentence_spans
from itemforge.llm.storage import delete, materialise, scope

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Least probability of the predicted language; with four languages a guess has 0.25.
LEAST_SCORE = 0.3


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts without letters and those whose language is hardly likelier than another. The prediction replaces lang."""
    found = language_id.identify(docs.select(*COLUMNS), language_id.train(docs))
    kept = found.where((F.col("lang_pred") != language_id.UNKNOWN) & (F.col("score") >= LEAST_SCORE))
    return kept.withColumn("lang", F.col("lang_pred")).select(*COLUMNS)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest doc_id of each component; documents without words are no duplicates of anything."""
    found = jaccard_join.jaccard_components(docs.select("doc_id", "text"))
    gone = found.where("doc_id <> component_id").select("doc_id").distinct()
    return docs.select(*COLUMNS).join(gone, "doc_id", "left_anti")


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes repeated sentence spans; a document of which no word is left goes."""
    cut = sentence_spans.deduplicate(docs.select(*COLUMNS))
    kept = cut.where((F.col("n_removed") == 0) | (F.trim("text") != ""))
    return kept.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item."""
    return decontamination.decontaminate(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, ids: sampled pieces that decode to the text."""
    return piece_sampling.encode(docs.select("doc_id", "text", "lang", "source"), piece_sampling.load_vocabulary()).drop("text")


STAGES = [
    ("language_id", language_stage),
    ("jaccard_join", near_duplicate_stage),
    ("sentence_spans", substring_stage),
    ("decontamination", decontamination_stage),
    ("piece_sampling", token_stage),
]

#: The stages hold trained models and sampling, which SQL can't express; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over the whole documents table; of the tables between, only the last stage's input is kept."""
    docs, read = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in STAGES[:-1]:
        made: list[str] = []
        with scope(spark):  # what the stage made for itself goes when its result is written
            docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}", made)
        delete(spark, read)
        read = made
    return STAGES[-1][1](spark, docs, sf_dir)
