"""The corpus pipeline: quality model, quality rules, near copies, repeated passages, packing.

Every stage is (spark, docs, sf_dir) -> DataFrame; its result is written as Parquet
and read again as the next stage's ``docs``.  All stages but the last return the
columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from creditscope.llm import jaccard_join, packing, quality_lm, quality_rules, suffix_dedup
from creditscope.llm.tables import free_name, shipped, stored


def quality_model(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: perplexity within the language's quantile of trusted texts."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    judged = quality_lm.classify(docs, quality_lm.trusted_documents(docs, labels),
                                 order=quality_lm.ACROSS_ORDER, across=True)
    return judged.where("out.kept").select("row.*")


def line_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4.  Its line model is fitted on labelled texts of the input table, as
    the stage before has already removed most texts that show what to reject."""
    labelled = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = quality_rules.learn(labelled, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality_rules.label_documents(docs, model).where("out.kept").select("row.*")


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: of each class of linked documents the one with the least id stays,
    and of repeated rows one."""
    name = free_name(docs, "spare")
    spare = jaccard_join.classes(docs).where("component_id <> doc_id").select(F.col("doc_id").alias(name))
    kept = docs.join(spare, F.col("doc_id") == F.col(name), "left_anti")
    return kept.dropDuplicates(["doc_id", "text"]).select(*[F.col(f"`{c}`") for c in docs.columns])


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: passages that a document with a smaller id has are cut out."""
    cut = suffix_dedup.remove_repeats(docs, as_text=True)
    changed = {"text": F.col("out.kept"), "n_chars": F.length("out.kept").cast("long")}
    return cut.select(*[changed.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1."""
    return packing.pack(docs)


STAGES = [(name, shipped(stage)) for name, stage in (
    ("quality model", quality_model), ("quality rules", line_rules), ("near copies", near_copies),
    ("repeated passages", passages), ("packing", pack))]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)


#: Not expressible: trained models decide in the first two stages.
ORACLE_SQL = None
