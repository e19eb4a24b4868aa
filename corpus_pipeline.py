"""Corpus pipeline: language, toxicity, near duplicates, repeated passages, packing.

Every stage takes (spark, docs, sf_dir), works on all that its predecessor kept and, but for the last, returns the
columns of ``documents``. Models are learnt from the tables in ``sf_dir``, never from the stage's input.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wakeline.llm import language_id, minhash_dedup, packing, suffix_dedup, toxicity
from wakeline.llm.common import table
from wakeline.session import work_path

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: A document whose language is predicted with a lower score is rejected.
LEAST_LANGUAGE_SCORE = 0.5
#: The pipeline's near duplicates: words in a shingle.
SHINGLE = 5
#: Rows handed to a Python worker at once. Whole texts travel, held by the JVM and by the worker, which the stages share.
BATCH_ROWS = 1000

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def in_small_batches(stage: Stage) -> Stage:
    """``stage``, with at most ``BATCH_ROWS`` rows in an Arrow batch of the session from then on."""

    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
        return stage(spark, docs, sf_dir)

    return run_stage


@in_small_batches
def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents of a known language and names it in ``lang``; texts without letters and unsure ones go."""
    model = language_id.train(table(spark, sf_dir, "documents"))
    found = language_id.predict(docs.select(*COLUMNS), model, ("doc_id", "text", "source", "n_chars"))
    sure = (F.col("lang_pred") != language_id.UNKNOWN) & (F.col("score") >= LEAST_LANGUAGE_SCORE)
    return found.where(sure).withColumnRenamed("lang_pred", "lang").select(*COLUMNS)


@in_small_batches
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that the grammar does not predict as toxic."""
    grammar = toxicity.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return toxicity.scored(docs.select(*COLUMNS), grammar, COLUMNS).where("predicted = 0").select(*COLUMNS)


@in_small_batches
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates, the one of least id."""
    found = minhash_dedup.near_duplicates(docs, shingle=SHINGLE).where("kept").select(F.col("doc_id").alias("kept_id")).distinct()
    return docs.select(*COLUMNS).join(found, F.col("doc_id").eqNullSafe(F.col("kept_id")), "left_semi")


@in_small_batches
def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages that also stand earlier; documents of which nothing is left go."""
    cut = suffix_dedup.remove_repeats(docs, carry=("lang", "source"))
    left = cut.select("doc_id", F.col("kept_text").alias("text"), "lang", "source", F.char_length("kept_text").cast("long").alias("n_chars"))
    return left.where(F.length(F.trim("text")) > 0).select(*COLUMNS)


@in_small_batches
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in the packed sequences."""
    return packing.pack(docs)


STAGES = [
    ("language", identify_language),
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("repeats", cut_repeats),
    ("packing", pack),
]

#: Trained models, hashing and tokenisation have no SQL. The operators have tests of their own; of the stages only counts and columns are tested.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = work_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
