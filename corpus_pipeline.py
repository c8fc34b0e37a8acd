"""A training corpus from raw documents: five stages, each over all that the one before has kept."""

from pyspark.sql import DataFrame, SparkSession, functions as F

from postloom.llm import decontaminate, lines, neardup, pieces, quality
from postloom.llm.queries import VOCABULARY, table
from postloom.session import work_path


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores at 0.5 or more."""
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs, model, "_llm_score").where("_llm_score >= 0.5").drop("_llm_score")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines that an earlier line equals or nearly equals; documents left without a word go."""
    return lines.dedup_lines(docs, drop_emptied=True, least=1)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return neardup.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids and their number."""
    coded = pieces.encode(docs.select("doc_id", "text"), pieces.Vocabulary.load(VOCABULARY))
    return coded.select("doc_id", F.size("ids").alias("n_ids"), "ids")


STAGES = [
    ("quality_classifier", quality_classifier),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("encoding", encoding),
]

# Trained scores, fingerprints and path search have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = work_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
