"""A training-data pipeline over ``documents``: language ID, near-duplicate removal, benchmark
decontamination, removal of personal data, packing into windows.

Every stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept; ``run``
writes each stage's result as Parquet in the shared folder and reads it back for the next. All
stages but the last return the columns of ``docs``, extra columns included. Texts that a stage
changes get their new ``n_chars`` where ``docs`` has that column. Stages find the columns they
need by name (``doc_id``, ``text``, ``lang``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelgrove.llm import decontamination, language, near_duplicates, packing, pii
from panelgrove.llm.common import settle, table


def _with_length(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without a recognisable language (no text, or no letter in it); rows are judged one by one, whole,
    whatever their length, and repeated ones alike. Empty tables give empty ones."""
    model = language.learn(docs)
    if model is None:  # nothing to learn from: only texts without a letter go
        return docs.filter(F.rlike("text", F.lit(r"\p{L}")))
    row = docs.select(F.struct(*docs.columns).alias("__row"), F.col("text").alias("__text"))
    found = language.identify(row, model, text="__text", keep=["__row"])
    return found.filter("lang_pred <> 'und'").select("__row.*")


def remove_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group. Rows without an id stay. Of rows that share a kept id one of each
    different text stays, so no text is lost; rows that differ in other columns only count as repeated. Empty
    tables give empty ones, texts are compared whole, of equal texts the smallest id stays."""
    groups = near_duplicates.near_duplicates(docs)
    gone = groups.filter("not kept").select(F.col("doc_id").alias("__gone")).distinct()
    left = docs.join(gone, docs["doc_id"] == gone["__gone"], "left_anti")
    repeated = docs.where("doc_id is not null").groupBy("doc_id").count().filter("count > 1").select("doc_id")
    if repeated.limit(1).count():
        once = left.join(repeated, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
        left = left.join(repeated, "doc_id", "left_anti").unionByName(once)
    return left


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut passages of test items out; drop documents that are mostly such passages. Null texts stay null, rows are
    judged one by one; without items, or without documents, nothing changes."""
    names = docs.columns
    row = docs.select(F.struct(*names).alias("__row"), "text")
    found = decontamination.find_contamination(row, table(spark, sf_dir, "benchmark"), cut=True)
    clean = decontamination.mostly_clean(found).select("__row", F.col("text").alias("__text"), (F.size("hit_spans") > 0).alias("__cut"))
    out = clean.select("__row.*", "__text", "__cut").withColumn("text", F.when(F.col("__cut"), F.col("__text")).otherwise(F.col("text")))
    return _with_length(out).select(*names)


def remove_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Put the kind's name in place of each span found; null texts stay null, all rows stay, repeated ones alike."""
    names = docs.columns
    row = docs.select(F.struct(*names).alias("__row"), "text")
    found = pii.redact(pii.find_spans(row, pii.learn(docs.select("text"))))
    out = found.select("__row.*", F.col("text").alias("__text")).withColumn("text", F.col("__text"))
    return _with_length(out).select(*names)


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their token ids."""
    return packing.pack(docs)


STAGES = [
    ("language", identify_language),
    ("near_duplicates", remove_near_duplicates),
    ("decontamination", remove_benchmark),
    ("pii", remove_personal_data),
    ("packing", pack_windows),
]

#: The stages learn models and hash; tests hold each against small cases and the operators against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
