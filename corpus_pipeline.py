"""The corpus pipeline: quality classifier, line dedup, near-duplicates, secret scan, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept. All but the last return
the columns of documents.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lineweave.llm.common import saved, table, unused
from lineweave.llm.line_dedup import line_dedup
from lineweave.llm.packing import pack, word_count
from lineweave.llm.quality import KEEP_AT, quality_model, score
from lineweave.llm.secrets import fit, scan
from lineweave.llm.similar import first_of_similar

#: A stage is not expressible in SQL (trained models, fingerprints), so there is no twin; tests hold the stages
#: against brute force. Columns of documents that begin with two underscores, as the operators' own do, are set aside
#: while a stage works.
ORACLE_SQL = None


def aside(stage):
    """The stage on docs whose columns that begin with __ have other names meanwhile."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        names = {c: new for c in docs.columns if c.startswith("__") for new in unused(docs, f"aside{c}")}
        out = stage(spark, docs.withColumnsRenamed(names), sf_dir)
        return out.withColumnsRenamed({new: c for c, new in names.items()})

    return run


def with_length(docs: DataFrame, columns: list[str]) -> DataFrame:
    """docs in these columns, n_chars (where there is one) made that of the text again."""
    if "n_chars" in columns:
        docs = docs.withColumn("n_chars", F.coalesce(F.char_length("text"), F.lit(0)).cast("long"))
    return docs.select(*columns)


@aside
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score reaches KEEP_AT; the classifier learns from the labelled ones not held out."""
    scored = score(docs, quality_model(docs, table(spark, sf_dir, "labels")))
    return scored.filter(F.col("__score") >= KEEP_AT).select(*docs.columns)


@aside
def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that three or more of them repeat."""
    return with_length(line_dedup(docs), docs.columns)


@aside
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies one row: that of the smallest id, rows without an id last."""
    return first_of_similar(docs)


@aside
def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, each secret in them replaced by [SECRET]."""
    return with_length(scan(docs, fit(docs), redact="[SECRET]"), docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The batch and slot of each document."""
    return pack(docs, word_count(F.col("text")), content=F.col("text"))


STAGES = [("quality", quality), ("lines", lines), ("near_duplicates", near_duplicates), ("secrets", secrets), ("packing", packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
