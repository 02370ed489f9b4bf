"""From raw documents to a training mix: filter, deduplicate, decontaminate, mix.

Every stage takes the documents that the one before kept and returns documents with the same
columns; the last adds how the mix takes them. Each stage's result is written and read again.
"""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logsieve.llm import columns, decontam, linededup, mixing, near, quality
from logsieve.sources import store

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
#: No SQL: most stages hash and compare texts in ways that SQL can't express.
ORACLE_SQL = None


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that importance resampling towards the good labelled ones keeps."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without repeated runs of lines; documents of which nothing is left go."""
    own = ("doc_id", "text", "n_chars")
    out = linededup.dedup(docs.select("doc_id", "text", columns.pack(docs, *own)))
    out = out.where((F.col("removed_chunks") == 0) | F.col("text").rlike("[^\\x20\\x09-\\x0D]"))
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*columns.unpack(docs.columns, *own))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that shares 80 % of its five-word shingles."""
    return near.keep_one(docs, n=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontam.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: one row for each repetition of a document, with its number and its source's target."""
    return mixing.repeated(mixing.mix(docs))


STAGES: list[tuple[str, Stage]] = [
    ("quality_classifier", quality_classifier),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mix),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        done = store.materialize(stage(spark, docs, sf_dir), name)
        store.release(docs)
        docs = done
    return docs
