"""Sketches that are kept by part and merged when they are read (A22): distinct counts, quantiles and frequent keys.

A part's sketch is a row (or, for counts by key, a bounded number of rows) that can be stored, and any set of parts is answered from
these rows alone; a new part adds rows and touches no other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Of distinct counts: 2**LG_K registers; the standard error is 1.04 / sqrt(2**LG_K), 1.6 %.
LG_K = 12
#: Of quantiles: the normalised rank error is about 1.65 % at k = 200 and falls as 1 / k.
KLL_K = 400
#: Of counts by key: DEPTH hashes into WIDTH counters each. A count is never too small, and with a probability of 1 - e**-DEPTH
#: at most e / WIDTH of all rows too large.
DEPTH, WIDTH = 5, 4096


def distinct_sketches(rows: DataFrame, by: list[str], column: str) -> DataFrame:
    """(by, sketch) of the distinct values of each part; nulls are no value."""
    return rows.groupBy(*by).agg(F.hll_sketch_agg(column, F.lit(LG_K)).alias("sketch"))


def distinct_estimates(sketches: DataFrame, by: list[str]) -> DataFrame:
    """(by, estimate) over all parts that by leaves together."""
    merged = F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("estimate")
    return sketches.groupBy(*by).agg(merged) if by else sketches.agg(merged)


def quantile_sketches(rows: DataFrame, by: list[str], column: str) -> DataFrame:
    """(by, sketch) of the values' distribution in each part; nulls are left out, a part without values has no row."""
    return rows.filter(F.col(column).isNotNull()).groupBy(*by).agg(F.kll_sketch_agg_double(F.col(column).cast("double"), F.lit(KLL_K)).alias("sketch"))


def quantile_estimates(sketches: DataFrame, by: list[str], shares: list[float]) -> DataFrame:
    """(by, share, value): quantiles over all parts that by leaves together."""
    merged = F.kll_merge_agg_double("sketch", F.lit(KLL_K)).alias("_s")
    whole = sketches.groupBy(*by).agg(merged) if by else sketches.agg(merged)
    at = lambda x: F.struct(F.lit(x).alias("share"), F.kll_sketch_get_quantile_double("_s", F.lit(x)).alias("value"))
    return whole.select(*by, F.explode(F.array(*map(at, shares))).alias("q")).select(*by, "q.*")


def _bucket(key: Column, row: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(row), key), F.lit(WIDTH)).cast("int")


def count_sketches(rows: DataFrame, by: list[str], column: str) -> DataFrame:
    """(by, row, bucket, n): count-min counters of each part, DEPTH * WIDTH at most. Null keys count like any other."""
    key = F.coalesce(F.col(column).cast("string"), F.lit("\0"))
    spread = rows.select(*by, F.explode(F.array(*(F.struct(F.lit(k).alias("row"), _bucket(key, k).alias("bucket")) for k in range(DEPTH)))).alias("c"))
    return spread.groupBy(*by, "c.row", "c.bucket").agg(F.count("*").alias("n"))


def count_estimates(sketches: DataFrame, keys: DataFrame, column: str) -> DataFrame:
    """keys with estimate: how often each key of `column` comes in all parts of the sketches together."""
    whole = sketches.groupBy("row", "bucket").agg(F.sum("n").alias("n"))
    key = F.coalesce(F.col(column).cast("string"), F.lit("\0"))
    asked = keys.select(column).distinct().select(column, F.explode(F.array(*(F.struct(F.lit(k).alias("row"), _bucket(key, k).alias("bucket")) for k in range(DEPTH)))).alias("c"))
    met = asked.select(column, "c.row", "c.bucket").join(whole, ["row", "bucket"], "left").groupBy(F.col(column).alias("_k")).agg(F.min(F.coalesce("n", F.lit(0))).alias("estimate"))
    return keys.join(met, keys[column].eqNullSafe(met["_k"]), "left").drop("_k")
