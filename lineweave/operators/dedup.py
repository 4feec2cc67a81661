"""Duplicates and best rows per key (F06, A19, A20, U03, W05): aggregates with map-side sums, no windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def first_of_equal(rows: DataFrame, key: list[str], order: str) -> DataFrame:
    """(order, copies): the first row of each group of equal keys, and the group's size."""
    return rows.groupBy(*key).agg(F.min(order).alias(order), F.count("*").alias("copies")).select(order, "copies")


def best_per_key(rows: DataFrame, key: list[str], score: Column, tie: list[str]) -> DataFrame:
    """The row of the largest score for each key; of equals the first by tie. A key's rows never meet: each task
    sends one."""
    rest = [c for c in rows.columns if c not in key]
    ranked = rows.withColumn("_rank", F.struct((-score).alias("s"), *tie))
    return ranked.groupBy(*key).agg(F.min_by(F.struct(*rest), "_rank").alias("r")).select(*key, "r.*")
