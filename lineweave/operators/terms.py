"""Key terms (J02, J03, X03): joins of renderings and glosses."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def term_pairs(src: DataFrame, trg: DataFrame) -> DataFrame:
    """(id, src, trg): renderings of a term in both languages, each with each, once (J02). Columns: id, renderings."""
    a = src.select("id", F.explode("renderings").alias("src")).distinct()
    b = trg.select("id", F.explode("renderings").alias("trg")).distinct()
    return a.join(b, "id").select("id", "src", "trg").distinct()


def gloss_pairs(terms: DataFrame) -> DataFrame:
    """(id, word, gloss): each rendering with each gloss of its own term, once."""
    return terms.select("id", F.explode("renderings").alias("word"), "glosses").select("id", "word", F.explode("glosses").alias("gloss")).distinct()


def dictionary_rows(pairs: DataFrame, src: str = "src", trg: str = "trg") -> DataFrame:
    """Two variants of each pair, as written and with its first letters capitalised."""
    variants = F.array(F.struct(src, trg), F.struct(F.initcap(src).alias(src), F.initcap(trg).alias(trg)))
    return pairs.select("id", F.explode(F.array_distinct(variants)).alias("v")).select("id", "v.*")
