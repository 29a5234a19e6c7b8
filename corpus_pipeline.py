"""A corpus pipeline over documents: language, recurring lines, near copies, benchmark leaks, pieces.

Every stage reads what the one before it wrote as Parquet in the shared folder.

Defined cases, in every stage: a null or empty text is a document without language and goes
in the first; rows with a null doc_id are never near copies, and come before all others where the first of equal lines
stays; repeated rows are one document to line dedup, and stay or go together as near copies; ties are broken as
the operators say; texts of any length are read whole by one task at a time; an empty table gives an empty one;
further columns, whatever their names, are carried along.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import language_kernel, line_templates, order_minhash, phrase_index, piece_sampling
from tidemark.llm.queries import vocabulary
from tidemark.llm.shared import new_folder

MIN_SCORE = 0.5
LINE_DOCS = 10
"""A template must stand in so many documents; fewer copies are left whole to the stage for near copies."""
PASSAGE_DOCS = 2
"""Once near copies are gone, a template must stand in so many documents: each class of near copies counts once."""
PIECES = "piece_bpe_32k.model"


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known: not ``und`` and a score of MIN_SCORE or more; without any labelled text none is known."""
    judged = language_kernel.identify(docs, language_kernel.learn(docs))
    return judged.where((F.col("lang_pred") != "und") & (F.col("score") >= MIN_SCORE)).select(*docs.columns)


def without_recurring_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines whose recurring template an earlier document has; n_chars is counted anew.

    A document that loses all its text goes: every line of it stands in an earlier one.
    """
    return _without_lines(docs, LINE_DOCS)


def _without_lines(docs: DataFrame, min_docs: int) -> DataFrame:
    cleaned = line_templates.drop_recurring(docs, min_docs=min_docs)
    cleaned = cleaned.where((F.col("n_dropped") == 0) | F.col("text").rlike(r"\S"))
    if "n_chars" in docs.columns:
        cleaned = cleaned.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return cleaned.select(*docs.columns)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies, that with the smallest doc_id, without lines whose template an earlier one of these has."""
    return _without_lines(order_minhash.drop_near_copies(docs), PASSAGE_DOCS)


def without_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item; an empty benchmark leaves all."""
    judged = phrase_index.contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return judged.where("n_hit = 0").select(*docs.columns)


def in_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with sampled ``piece_ids``, the text ``decoded`` from them, and whether it is the same (null for null)."""
    back = piece_sampling.encode(docs, vocabulary(PIECES), decoded=True)
    return back.withColumn("lossless", F.col("decoded").eqNullSafe(F.col("text")))


STAGES = [
    ("language_id", identified),
    ("line_dedup", without_recurring_lines),
    ("near_dedup", without_near_copies),
    ("decontamination", without_leaks),
    ("pieces", in_pieces),
]

# language scores, sketches and sampled pieces have no form in SQL
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        folder = new_folder(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(folder)
        docs = spark.read.parquet(folder)
    return STAGES[-1][1](spark, docs, sf_dir)
