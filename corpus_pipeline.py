"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read
again as the next stage's docs; all but the last return the columns of ``docs``. Null texts, empty
tables and repeated rows behave as each operator's docstring says.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from dupeframe.llm.jaccard_join import jaccard_components
from dupeframe.llm.mixing import SCHEDULES, WEIGHTS, assign_positions, training_order
from dupeframe.llm.ordinal import grade_documents, rated, train
from dupeframe.llm.packing import digests, pack_in_order
from dupeframe.llm.quality_rules import clean_lines
from dupeframe.staging import stage

TOKENIZER = "word_bpe_49k.json"


def _with_text(docs: DataFrame, text: Column, columns: list[str]) -> DataFrame:
    """``columns`` with the given text, and n_chars to match where there is such a column."""
    changed = docs.withColumn("text", text)
    if "n_chars" in columns:
        changed = changed.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return changed.select(*[f"`{c}`" for c in columns])


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Failed lines go, and documents that fail the base rules or lose too much text."""
    kept = clean_lines(docs).where("_quality.kept")
    return _with_text(kept, F.col("_quality.cleaned"), docs.columns)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go whose probability of the highest grade is under one half."""
    model = train(docs, rated(spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return grade_documents(docs, model).where("_grade.kept").select(*[f"`{c}`" for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each component stays; wordless documents all stay."""
    found = jaccard_components(docs)
    grouped = found.where("n_shingles > 0").groupBy("component").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "text_hash")).alias("first"))
    keys = grouped.select("first.doc_id", "first.text_hash", F.lit(False).alias("wordless")).unionByName(
        found.where("n_shingles = 0").select("doc_id", "text_hash", F.lit(True).alias("wordless")).distinct())
    keys = keys.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), "wordless").withColumnRenamed(
        "wordless", "_wordless")
    rows = docs.select(
        F.struct(*[f"`{c}`" for c in docs.columns]).alias("_row"), F.xxhash64("text").alias("_text_hash"),
        F.col("doc_id").cast("long").alias("_doc_id"))
    joined = rows.join(keys, F.col("_doc_id").eqNullSafe(F.col("_id")) & (F.col("_text_hash") == F.col("_hash")))
    # equal rows of one id are one document, unless they have no words
    once = joined.withColumn("_own", F.when(F.col("_wordless"), F.monotonically_increasing_id()).otherwise(-1))
    return once.dropDuplicates(["_id", "_hash", "_own"]).select("_row.*")


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per copy that the curriculum takes, sorted by training position."""
    copies = training_order(assign_positions(docs, WEIGHTS, 1.5, 2, SCHEDULES))
    return _with_text(copies, F.col("text"), docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of packed sequences, in the order in which the rows were written (or, for docs
    that were not read from files, of ids)."""
    from public_tokenizers import path

    try:
        ordered = docs.select("doc_id", "text", F.col("_metadata.file_name").alias("_file"),
                              F.col("_metadata.row_index").alias("_row"))
        order = ["_file", "_row"]
    except AnalysisException:
        ordered, order = docs, ["doc_id"]
    return digests(pack_in_order(ordered, path(TOKENIZER), order_by=order))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("quality_classifier", quality_classifier),
    ("near_duplicates", near_duplicates),
    ("mixing", mixing),
    ("packing", packing),
]

#: SQL cannot express the classifier, so the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
