"""A training-text pipeline: each stage reads what its predecessor wrote and applies one operator of ``tessera.llm``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontaminate, jaccard, langid, mixing, token_files
from tessera.llm.common import ascii_lower, bound_batches, given, saved
from tessera.session import ship_package


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that have a letter. All others are ``und``, and so is every text if no training row has a language.

    The model learns from the labelled documents of ``docs`` that are not held out.
    """
    ship_package(spark)
    bound_batches(spark)
    known = langid.identify(docs, langid.train_on_documents(docs))
    return known.where((F.col("lang_pred") != "und") | F.col("text").rlike(r"\p{L}")).select(docs.columns)


def _one_of_each(docs: DataFrame, into: str) -> DataFrame:
    """One row for each id and word sequence, the smallest, numbered ``into`` by id (NULL last) and sequence."""
    words = F.array_remove(F.split(ascii_lower(F.coalesce("text", F.lit(""))), r"[\x20\x09-\x0D]+", -1), "")
    digest = F.sha2(F.array_join(words, " "), 256).alias("_words")
    rest = F.struct("text", *[c for c in docs.columns if c not in ("doc_id", "text")])
    one = docs.groupBy("doc_id", digest).agg(F.min(rest).alias("_row"))
    one = one.orderBy(F.col("doc_id").asc_nulls_last(), "_words").withColumn(into, F.monotonically_increasing_id())
    own = [F.col(c) if c == "doc_id" else F.col(f"_row.{c}").alias(c) for c in docs.columns]
    return saved(one.select(*own, into), "distinct")  # the numbers are fixed from here on


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the smallest id.

    Rows of one id, or without an id, are one row only if they have the same words. Where an id comes more than once,
    each of its texts is compared as a document of its own, and a NULL id is above all others.
    """
    ship_package(spark)
    bound_batches(spark)
    node = "doc_id"
    if docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).count():
        node = "_node"
        columns, docs = docs.columns, _one_of_each(docs, node)
    else:
        columns = docs.columns
    groups = jaccard.near_duplicates(docs, id_col=node)
    copies = groups.where(~F.col(node).eqNullSafe(F.col("component_id"))).select(F.col(node).alias("_copy"))
    copies = saved(copies, "copies")
    return docs.join(copies, docs[node].eqNullSafe(F.col("_copy")), "left_anti").select(columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the benchmark doesn't contaminate."""
    ship_package(spark)
    bound_batches(spark)
    found = decontaminate.contamination(docs, given(spark, sf_dir, "benchmark"))
    return found.where(~decontaminate.contaminated()).select(docs.columns)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target weight asks for, in mixed order."""
    ship_package(spark)
    bound_batches(spark)
    return mixing.mix(docs).select(docs.columns)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of all documents; a row for each, read back from the files."""
    ship_package(spark)
    bound_batches(spark)
    return token_files.tokens_of(spark, docs)


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("source_mixing", source_mixing),
    ("token_output", token_output),
]

#: The tokenizer's merges are beyond SQL; ``tests/llm/test_pipeline.py`` has the brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written and read again."""
    ship_package(spark)
    docs = given(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir), name)
    return docs
