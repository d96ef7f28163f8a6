"""The corpus pipeline: quality, line dedup, near dedup, decontamination, encoding.

Each stage takes (spark, docs, sf_dir) and works on all documents its predecessor kept; between
stages the documents are written as Parquet to the shared folder and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tableprobe.llm.common import staged
from tableprobe.llm.decontaminate import decontaminate
from tableprobe.llm.lines import deduplicate_lines
from tableprobe.llm.pieces import load, segmented
from tableprobe.llm.quality import score_quality, train_quality
from tableprobe.llm.queries import tokenizer
from tableprobe.llm.simhash import deduplicate_near

#: Words of a shingle, and most differing bits of two linked fingerprints.
SHINGLE, DISTANCE = 4, 4


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learned from all labels, gives 0.5 or more."""
    model = train_quality(docs, table(spark, sf_dir, "labels"))
    return score_quality(docs, model).where(F.col("quality_score") >= 0.5).select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that an earlier line repeats."""
    return deduplicate_lines(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group linked by fingerprints of four-word shingles, at 4 or fewer
    differing bits. Null and empty texts have one fingerprint and form one group."""
    return deduplicate_near(docs, shingle=SHINGLE, distance=DISTANCE)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by the benchmark."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with the piece ids of their best segmentation, the scores of the four best, and
    whether the ids give the text back."""
    return segmented(docs, load(tokenizer("piece_bpe_32k.model")))


STAGES = [
    ("quality classifier", quality),
    ("line dedup", line_dedup),
    ("SimHash near dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("SentencePiece encoding", encoding),
]

#: The classifier, the fingerprints and the segmentation can't be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir))
    return docs
