"""Sinks (K01-K04, K06, K08)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_lines(rows: DataFrame, path: str, order: str = "line_no", column: str = "text", mode: str = "overwrite") -> None:
    """One line a row in order (K01). Part files are ranges of the order, so they follow each other by name."""
    rows.repartitionByRange(order).sortWithinPartitions(order).select(F.col(column).alias("value")).write.mode(mode).text(path)


def padded(rows: DataFrame, spine: DataFrame, key: str, column: str) -> DataFrame:
    """A row for each key of the spine, empty where rows has none."""
    return spine.select(key).join(rows.select(key, column), key, "left").withColumn(column, F.coalesce(column, F.lit("")))


def write_splits(rows: DataFrame, path: str, mode: str = "overwrite") -> None:
    """A folder for each split, language pair and side."""
    rows.write.partitionBy("split", "src_iso", "trg_iso", "side").mode(mode).parquet(path)


def score_table(rows: DataFrame, digits: dict[str, int]) -> DataFrame:
    """Scores as text with fixed digits."""
    return rows.select(*(F.format_string(f"%.{digits[c]}f", F.col(c).cast("double")).alias(c) if c in digits else F.col(c) for c in rows.columns))


def write_lexicon(lexicon: DataFrame, path: str) -> None:
    """src, trg, prob to 8 digits, by src, falling prob and trg."""
    ordered = lexicon.orderBy("src", F.desc("prob"), "trg").select("src", "trg", F.format_string("%.8f", "prob"))
    ordered.write.mode("overwrite").csv(path, sep="\t", quote="")


def upserted(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """new over old by key (K06): write the result beside old, then swap."""
    return old.join(new.select(*key).distinct(), key, "left_anti").unionByName(new)


def confidence_tables(tokens: DataFrame) -> dict[str, DataFrame]:
    """Geometric mean confidence by verse, chapter and book of rows (book, chapter, verse, log_prob)."""
    score = F.exp(F.avg("log_prob")).alias("confidence")
    return {g: tokens.groupBy(*keys).agg(score) for g, keys in (("verses", ["book", "chapter", "verse"]), ("chapters", ["book", "chapter"]), ("books", ["book"]))}


def write_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)
