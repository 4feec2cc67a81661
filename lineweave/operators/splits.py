"""Seeded splits, samples and noise (T05-T09, C10): the md5 of seed and key stands for a random draw."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lineweave.functions.text import seeded_order, uniform
from lineweave.session import written


def numbered(rows: DataFrame, part: list[str], order: list[Column | str], out: str = "_r") -> DataFrame:
    """rows with their place (from 1) in the order of their part, and _n, the size of the part.

    Rows are dealt out by ranges of part and order, sorted, and written with a running number; the counts of parts in
    ranges (a row each) then tell how many come before. So a part that holds a third of all rows, or all of
    them, is spread over as many tasks as its rows ask for.
    """
    keys = rows.withColumns({f"_o{k}": F.col(c) if isinstance(c, str) else c for k, c in enumerate(order)})
    by = [F.col(c) for c in (*part, *(f"_o{k}" for k in range(len(order))))]
    dealt = keys.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_at", F.monotonically_increasing_id())
    dealt = written(dealt.drop(*(f"_o{k}" for k in range(len(order)))), "numbered").withColumn("_range", F.shiftright("_at", 33))
    counts = dealt.groupBy(*part, "_range").agg(F.min("_at").alias("_low"), F.count("*").alias("_m"))
    whole = Window.partitionBy(*part) if part else Window.partitionBy(F.lit(0))
    before = F.sum("_m").over(whole.orderBy("_range").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_m")
    counts = counts.select(*part, "_range", (before - F.col("_low") + 1).alias("_shift"), F.sum("_m").over(whole).alias("_n"))
    return dealt.join(counts, [*part, "_range"]).withColumn(out, F.col("_at") + F.col("_shift")).drop("_at", "_range", "_shift")


def quantiles(rows: DataFrame, part: list[str], score: str, qs: list[float]) -> DataFrame:
    """(part, cuts): exact quantiles of each part, linear between neighbours. Nulls do not count."""
    placed = numbered(rows.filter(F.col(score).isNotNull()).select(*part, score), part, [score])
    at = F.array(*(F.lit(float(q)) for q in qs))
    want = F.transform(at, lambda q, i: F.struct(i.alias("i"), (q * (F.col("_n") - 1)).alias("h")))
    near = placed.select(*part, F.col(score).cast("double").alias("v"), (F.col("_r") - 1).alias("k"), F.explode(want).alias("w")).select(*part, "v", "k", "w.*")
    near = near.filter((F.col("k") == F.floor("h")) | (F.col("k") == F.ceil("h")))
    low, high = F.max(F.when(F.col("k") == F.floor("h"), F.col("v"))), F.max(F.when(F.col("k") == F.ceil("h"), F.col("v")))
    each = near.groupBy(*part, "i").agg((low + (high - low) * (F.max("h") - F.floor(F.max("h")))).alias("cut"))
    return each.groupBy(*part).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "cut"))), lambda x: x["cut"]).alias("cuts"))


def split_bands(rows: DataFrame, key: list[str], part: list[str], bands: list[tuple[str, float]], seed: str, rest: str = "train") -> DataFrame:
    """A split for each row: bands in turn take their fraction (below 1) or number of each part in seeded order,
    what is left is `rest`. Disjoint and exhaustive (T05-T07)."""
    ranked = numbered(rows, part, [seeded_order(seed, *map(F.col, key)), *key])
    out, upto = None, F.lit(0)
    for name, size in bands:
        upto = upto + (F.floor(F.col("_n") * size) if size < 1 else F.lit(int(size)))
        out = F.when(F.col("_r") <= upto, name) if out is None else out.when(F.col("_r") <= upto, name)
    return ranked.withColumn("split", out.otherwise(rest)).drop("_r", "_n")


def quantile_bins(rows: DataFrame, score: str, size: int, out: str = "bin") -> DataFrame:
    """rows with the quantile bin of their score (T08): as many bins as a sample of `size` rows asks for, at most 10 below
    1000 rows and 20 above, no more than distinct scores. Bins between equal edges are one."""
    n, distinct = rows.agg(F.count(score), F.count_distinct(score)).first()
    q = min(max(size // 10, 4), 10 if n < 1000 else 20, distinct)
    if q < 2:
        return rows.withColumn(out, F.lit(0))
    cuts = sorted(set(quantiles(rows, [], score, [i / q for i in range(1, q)]).first().cuts))  # 19 at most
    return rows.withColumn(out, F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c < F.col(score))))


def stratified(rows: DataFrame, stratum: str, size: int, key: list[str], seed: str) -> DataFrame:
    """`size` rows, dealt to strata in proportion with largest remainders (ties: the smaller stratum), seeded."""
    counts = rows.groupBy(stratum).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    want = counts.crossJoin(F.broadcast(total)).select(stratum, (F.col("n") * F.lit(float(size)) / F.col("total")).alias("want"))  # one row
    base = want.select(stratum, F.floor("want").alias("base"), (F.col("want") - F.floor("want")).alias("over"))
    everything = Window.partitionBy(F.lit(0))  # the strata: a few rows
    place = base.withColumn("place", F.row_number().over(everything.orderBy(F.desc("over"), stratum))).withColumn("rest", size - F.sum("base").over(everything))
    take = place.select(stratum, (F.col("base") + (F.col("place") <= F.col("rest")).cast("int")).alias("take"))
    nth = F.row_number().over(Window.partitionBy(stratum).orderBy(seeded_order(seed, *map(F.col, key)), *key))
    return rows.withColumn("_nth", nth).filter(F.col("_nth") <= size).join(F.broadcast(take), stratum).filter(F.col("_nth") <= F.col("take")).drop("_nth", "take")


def drop_tokens(words: Column, p: float, seed: str, *key: Column) -> Column:
    """Each token goes with probability p."""
    return F.filter(words, lambda _, i: uniform(F.lit(seed), *key, i) >= p)


def replace_tokens(words: Column, p: float, seed: str, *key: Column, blank: str = "<blank>") -> Column:
    return F.transform(words, lambda w, i: F.when(uniform(F.lit(seed), *key, i) < p, blank).otherwise(w))


def permute_tokens(words: Column, distance: int, seed: str, *key: Column) -> Column:
    """Tokens sorted by their place plus a draw from [0, distance + 1): none moves far."""
    placed = F.transform(words, lambda w, i: F.struct((i + uniform(F.lit(seed), *key, i) * (distance + 1)).alias("at"), i.alias("i"), w.alias("w")))
    return F.transform(F.array_sort(placed), lambda x: x["w"])
