"""From raw documents to a training mixture, in five stages.

Each stage takes ``(spark, docs, sf_dir)``; its result is written and read
again as the next one's documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.llm._registry import keep, table
from foliospark.llm.op2_ngram_join import classes
from foliospark.llm.op3_quality import learn_from_tables, score_quality
from foliospark.llm.op6_decontaminate import drop_leaks
from foliospark.llm.op7_pseudonyms import pseudonymise
from foliospark.llm.op10_mixing import mixed_documents


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject; a text without words goes."""
    scored = score_quality(docs, learn_from_tables(spark, sf_dir, docs))
    return scored.filter("predicted = 1").select(*docs.columns)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the row with the smallest id, null last; rows of one id are told apart.

    Among equal ids the source and then a hash of the whole row decide, so
    the same rows give the same result whatever numbers they get here.
    """
    rows = keep(docs.withColumn("_row", F.monotonically_increasing_id()), "pipeline-rows")
    group = classes(rows.select(F.col("_row").alias("doc_id"), "text")).select(F.col("doc_id").alias("_row"), "component_id")
    order = F.struct(
        F.col("doc_id").isNull().alias("none"), "doc_id", "source", F.xxhash64(*docs.columns).alias("hash"), "_row"
    )
    first = rows.select("_row", order.alias("order")).join(group, "_row").groupBy("component_id").agg(
        F.min("order")["_row"].alias("_row")
    )
    return rows.join(first, "_row", "left_semi").select(*docs.columns)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item occurs."""
    return drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def without_personal_values(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal values replaced; ``n_chars`` follows the text."""
    done = pseudonymise(docs)
    return done.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else done


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as often as the mixture takes them, with the number of the copy."""
    return mixed_documents(docs)


STAGES = [
    ("quality", good_quality),
    ("near_duplicates", one_of_each_group),
    ("decontamination", without_benchmark),
    ("personal_values", without_personal_values),
    ("mixture", mixture),
]
#: SQL expresses neither the classifier nor the join; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = keep(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
