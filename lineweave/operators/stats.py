"""Distributions, regression and quality labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lineweave.functions.text import uniform


def summary(c: str, name: str, least: int = 200) -> list[Column]:
    """Least, most, median, mean, sample deviation (rounded half up to 3) and how many reach `least`."""
    return [
        F.min(c).cast("bigint").alias(f"{name}_min"),
        F.max(c).cast("bigint").alias(f"{name}_max"),
        F.median(c).alias(f"{name}_median"),
        F.round(F.avg(c), 3).alias(f"{name}_mean"),
        F.round(F.stddev_samp(c), 3).alias(f"{name}_std"),
        F.count_if(F.col(c) >= least).alias(f"{name}_long"),
    ]


def histogram(rows: DataFrame, c: str, width: float, by: list[str]) -> DataFrame:
    return rows.groupBy(*by, F.floor(F.col(c) / width).alias("bin")).agg(F.count("*").alias("n"))


def geometric_mean(c: Column | str) -> Column:
    return F.exp(F.avg(F.ln(c)))


def rollup_means(rows: DataFrame, keys: list[str], score: str) -> DataFrame:
    """Mean and count at every grain from the rows themselves, not from means of means."""
    return rows.rollup(*keys).agg(F.avg(score).alias("mean"), F.count("*").alias("n"), F.grouping_id().cast("bigint").alias("grain"))


def progression(rows: DataFrame, part: str, order: str, metric: str) -> DataFrame:
    """The metric's change against the row before and against the first."""
    by = Window.partitionBy(part).orderBy(order)
    return rows.withColumn("vs_previous", F.col(metric) - F.lag(metric).over(by)).withColumn("vs_first", F.col(metric) - F.first(metric).over(by))


def metric_table(rows: DataFrame, index: str, column: str, metric: str, columns: list[str]) -> DataFrame:
    """A row per index, a column for each of these columns' mean metric."""
    return rows.groupBy(index).pivot(column, columns).agg(F.avg(metric))


def demeaned(rows: DataFrame, score: str, column: str, group: str) -> DataFrame:
    """Mean of each group after each column's own mean is taken off; -1 is no score."""
    real = rows.filter(F.col(score) != -1)
    means = real.groupBy(column).agg(F.avg(score).alias("m"))
    return real.join(means, column).groupBy(group).agg(F.round(F.avg(F.col(score) - F.col("m")), 6).alias("mean"))


def simple_regression(rows: DataFrame, x: str, y: str, by: list[str]) -> DataFrame:
    """Least squares, rounded to 4 (Q01)."""
    fits = [F.round(F.regr_slope(y, x), 4).alias("slope"), F.round(F.regr_intercept(y, x), 4).alias("intercept")]
    return rows.groupBy(*by).agg(*fits) if by else rows.agg(*fits)


def weighted_regression(rows: DataFrame, x: str, y: str, by: list[str], buckets: int = 100, high: float = 100.0) -> DataFrame:
    """Least squares with weights 1 / (density * n + 1e-6), density over equal buckets of y in [0, high] (Q02)."""
    place = F.least(F.floor(F.col(y) * buckets / high), F.lit(buckets - 1))
    binned = rows.withColumn("_b", place)
    counts = binned.groupBy(*by, "_b").agg(F.count("*").alias("_c"))  # density * n is the bucket's count * buckets / high
    joined = binned.join(counts, [*by, "_b"]).withColumn("_w", 1 / (F.col("_c") * F.lit(buckets / high) + F.lit(1e-6)))
    w = F.col("_w")
    s = joined.groupBy(*by).agg(F.sum(w).alias("w"), F.sum(w * F.col(x)).alias("x"), F.sum(w * F.col(y)).alias("y"), F.sum(w * F.col(x) * F.col(x)).alias("xx"), F.sum(w * F.col(x) * F.col(y)).alias("xy"))
    slope = F.try_divide(F.col("w") * F.col("xy") - F.col("x") * F.col("y"), F.col("w") * F.col("xx") - F.col("x") * F.col("x"))
    return s.select(*by, F.round(slope, 4).alias("slope"), F.round((F.col("y") - slope * F.col("x")) / F.col("w"), 4).alias("intercept"))


def bootstrap_regression(points: DataFrame, x: str, y: str, n: int, samples: int, seed: str, top: float = 0.9) -> DataFrame:
    """Mean slope and intercept of the resamples whose slope reaches the `top` quantile (Q03).

    points: place (0 .. n - 1), x, y. Draw i of resample b takes the point at floor(uniform(seed, b, i) * n); a
    resample is a group of its own, so the work spreads over all of them.
    """
    draws = points.sparkSession.range(samples).select(F.col("id").alias("b"), F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("i"))
    draws = draws.select("b", F.floor(uniform(F.lit(seed), F.col("b"), F.col("i")) * n).alias("place"))
    fits = draws.join(points, "place").groupBy("b").agg(F.round(F.regr_slope(y, x), 4).alias("slope"), F.round(F.regr_intercept(y, x), 4).alias("intercept"))
    cut = fits.agg(F.percentile("slope", F.lit(top)).alias("cut"))
    best = fits.crossJoin(F.broadcast(cut)).filter("slope >= cut")  # one row
    return best.agg(F.round(F.avg("slope"), 4).alias("slope"), F.round(F.avg("intercept"), 4).alias("intercept"))


def quality_label(score: Column) -> Column:
    """Green from 53, yellow from 44.5, else red (Q04)."""
    return F.when(score >= 53, "Green").when(score >= 44.5, "Yellow").otherwise("Red")


def projected(rows: DataFrame, confidence: str, slope: float, intercept: float) -> DataFrame:
    score = F.col(confidence) * slope + intercept
    return rows.withColumn("projected", F.round(score, 6)).withColumn("label", quality_label(score))


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column | str, b: Column | str) -> Column:
    """Cosine of two vectors; 0 if one has no length."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm == 0, 0.0).otherwise(dot(a, b) / norm)


def pair_similarity(scores: DataFrame, a: str, b: str, score: str) -> DataFrame:
    """Median score of each unordered pair over the largest median + 0.01."""
    pairs = scores.groupBy(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).agg(F.median(score).alias("m"))
    most = pairs.agg((F.max("m") + 0.01).alias("most"))
    return pairs.crossJoin(F.broadcast(most)).select("a", "b", F.round(F.col("m") / F.col("most"), 6).alias("similarity"))  # one row
