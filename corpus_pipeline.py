"""The corpus pipeline: quality rules, near duplicates, personal data, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and reread as the next one's docs;
all but the last return the columns of documents. Stages decide about rows: a null or repeated doc_id changes nothing, rows
that repeat an id are judged, masked and mixed one by one, and of rows that are copies of each other one stays. An empty
table stays empty; extra columns are carried along, whatever they are called.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyline.llm import cost_packing, cube_mixing, jaccard_join, pii, quality_forest
from tallyline.llm.common import free_name, table, written


def _keyed(docs: DataFrame, name: str) -> tuple[DataFrame, str]:
    """``docs``, written with a number of its own for each row, and that column's name (none that docs has)."""
    key = free_name(docs, "row_key")
    return written(docs.withColumn(key, F.monotonically_increasing_id()), name), key


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows that rules and isolation forests keep."""
    return quality_forest.kept_rows(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row (the smallest doc_id, null last) of each class of 5-word shingle sets with a Jaccard similarity of 0.8 or more."""
    keyed, key = _keyed(docs, "pipeline-keyed")
    classes = jaccard_join.jaccard_components(keyed.select(F.col(key).alias("doc_id"), "text"), k=5, percent=80).select(F.col("doc_id").alias("k"), "component_id")
    names = keyed.select(F.col(key).alias("k"), F.col("doc_id").cast("long").alias("id"))
    # keys grow with the documents: all joins are shuffled, none broadcast
    first = classes.join(names.hint("shuffle_hash"), "k").groupBy("component_id").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "k")).alias("first"))
    kept = written(first.select(F.col("first.k").alias(key)), "pipeline-kept")
    return keyed.join(kept.hint("shuffle_hash"), key, "left_semi").select(*docs.columns)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, with personal data replaced by its kind."""
    found = pii.masked(docs)
    if "n_chars" not in docs.columns:
        return found
    return found.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As many copies of each row as the mix takes."""
    keyed, key = _keyed(docs, "pipeline-keyed")
    copies, number = free_name(keyed, "copies"), free_name(keyed, "copy_number")
    taken = cube_mixing.mixed(keyed.select("doc_id", "text", "source", F.col(key).alias("k")), also="k").where("copies > 0")
    both = keyed.join(taken.select(F.col("k").alias(key), F.col("copies").cast("int").alias(copies)).hint("shuffle_hash"), key)
    return both.withColumn(number, F.explode(F.sequence(F.lit(1), F.col(copies)))).select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the training sequences."""
    return cost_packing.packed(docs)


STAGES = [("quality rules", quality_rules), ("near duplicates", near_duplicates), ("personal data", personal_data), ("mixing", mixing), ("packing", packing)]

#: The forests, the tagger and the tokenizer are not SQL; tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
