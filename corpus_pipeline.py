"""The training-data pipeline: five stages from documents to a mixed sample.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept;
what it returns is written as Parquet and read again.  All but the last return
the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storyloom.llm.common import cut, load
from storyloom.llm.decontaminate import clean
from storyloom.llm.jaccard import keep_one
from storyloom.llm.mixing import mix_sources
from storyloom.llm.pii import sanitise
from storyloom.llm.quality import good
from storyloom.llm.queries import MIX
from storyloom.session import configure


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weak-label classifier rejects go."""
    return good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    return keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a phrase of a benchmark item go."""
    return clean(docs, load(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and the terms that disclose it are generalised; n_chars follows the text."""
    clean_text = sanitise(docs)
    return clean_text.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample with raked source, language and topic shares, with topic, n_tokens and probability."""
    packed = docs.select(F.struct("*").alias("row"), "doc_id", "text", "source", "lang")
    added = [c for c in ("topic", "n_tokens", "probability") if c not in docs.columns]
    return mix_sources(packed, **MIX).select("row.*", *added)


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("mixing", mixing),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(configure(spark), sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = cut(docs)
    return docs


QUERIES = {"pipeline": run}
ORACLE: dict[str, str] = {}
