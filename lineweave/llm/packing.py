"""Packing by length: optimal buckets, then batches of a token budget inside each bucket.

One pass counts each text's tokens and writes the counts; all else works on those. Their global histogram has a
bar for every length, and dynamic programming over it chooses the bucket boundaries with the least padding of all;
a convex hull of lines makes each round linear in the histogram. Batches then fill up inside buckets: a bucket of
many rows is dealt to shards by hash, as many as its exact count asks for.

The driver holds the histogram: two integers for each length that occurs. K different lengths take K * K / 2 tokens
at least, so there are few: a corpus of 10**13 tokens has 4.5 million at most.
"""

from __future__ import annotations

from bisect import bisect_left

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lineweave.llm.common import saved, table

BUCKETS, TOKEN_BUDGET = 16, 65536
#: Full batches of a shard: the share of batches that stay part full is at most one in so many.
SHARD_BATCHES = 256


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def length_bars(lengths: DataFrame) -> list[tuple[int, int, int]]:
    """(length, rows, sum of lengths) of each length in column n, ascending."""
    bars = lengths.groupBy("n").count().toArrow()
    return sorted((n, c, n * c) for n, c in zip(bars.column(0).to_pylist(), bars.column(1).to_pylist(), strict=True))


def best_bounds(bars: list[tuple[int, int, int]], buckets: int) -> list[int]:
    """The upper bounds of at most `buckets` buckets with the least padding: the sum of bound - length over all rows.

    f_k(j) = min over i < j of f_(k-1)(i) + bound_j * (count_j - count_i) - (sum_j - sum_i): for each i a line in
    bound_j, with slopes that fall as i grows, so the lower hull is kept as a queue.
    """
    if not bars:
        return []
    counts, sums = [0], [0]
    for _, c, s in bars:
        counts.append(counts[-1] + c)
        sums.append(sums[-1] + s)
    n = len(bars)
    cost: list[int | None] = [0] + [None] * n
    back: list[list[int]] = []
    for _ in range(min(buckets, n)):
        new: list[int | None] = [None] * (n + 1)
        came = [0] * (n + 1)
        hull: list[tuple[int, int, int]] = []  # slope, intercept, i
        head = 0
        for j in range(1, n + 1):
            i = j - 1
            if cost[i] is not None:
                line = (-counts[i], cost[i] + sums[i], i)
                while len(hull) - head >= 2:
                    (m1, b1, _), (m2, b2, _), (m3, b3, _) = hull[-2], hull[-1], line
                    if (b3 - b1) * (m1 - m2) <= (b2 - b1) * (m1 - m3):
                        hull.pop()
                    else:
                        break
                hull.append(line)
            x = bars[j - 1][0]
            while len(hull) - head >= 2 and hull[head + 1][0] * x + hull[head + 1][1] <= hull[head][0] * x + hull[head][1]:
                head += 1
            if len(hull) > head:
                m, b, i = hull[head]
                new[j], came[j] = x * counts[j] - sums[j] + m * x + b, i
        back.append(came)
        if cost[n] is not None and new[n] is not None and new[n] >= cost[n]:
            back.pop()
            break
        cost = new
    bounds, j = [], n
    for came in reversed(back):
        if j == 0:
            break
        bounds.append(bars[j - 1][0])
        j = came[j]
    return bounds[::-1]


def pack(docs: DataFrame, length: Column, id_col: str = "doc_id", buckets: int = BUCKETS, budget: int = TOKEN_BUDGET, content: Column | None = None) -> DataFrame:
    """(doc_id, n_tokens, bucket, bucket_len, batch_id, slot): a row per document.

    A batch holds up to budget // bucket_len documents of one bucket, so it stays within the budget when all
    are padded to bucket_len; a document longer than the budget is a batch of its own. Every document is in
    one batch, the empty and the null text (length 0) included. slot counts from 0 within the batch; order is
    by the hash of id and content, so rows that share an id, or have none, are dealt out too, and repeated rows sit
    side by side. content: what tells rows of an id apart (all columns unless given). Other columns are not returned.
    """
    told = F.xxhash64(F.col(id_col).cast("long"), content if content is not None else F.to_json(F.struct(*docs.columns)))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(length.cast("long"), F.lit(0)).alias("n"), told.alias("h"))
    rows = saved(rows, "lengths")
    bars = length_bars(rows)
    bounds = best_bounds(bars, buckets) or [0]
    sizes = [0] * len(bounds)
    for n, c, _ in bars:
        sizes[bisect_left(bounds, n)] += c
    room = [max(1, budget // max(b, 1)) for b in bounds]
    shards = [max(1, -(-size // (r * SHARD_BATCHES))) for size, r in zip(sizes, room, strict=True)]

    def of(values: list[int]) -> Column:
        return F.element_at(F.array(*(F.lit(v).cast("long") for v in values)), F.col("bucket") + 1)

    bucket = F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b < F.col("n")))
    placed = rows.withColumn("bucket", bucket).withColumn("shard", F.pmod("h", of(shards)))
    nth = F.row_number().over(Window.partitionBy("bucket", "shard").orderBy("h", "doc_id", "n")).cast("long") - 1
    placed = placed.withColumn("nth", nth).withColumn("room", of(room))
    batch = F.concat_ws("-", "bucket", "shard", F.expr("nth div room"))
    return placed.select(
        "doc_id", F.col("n").alias("n_tokens"), "bucket", of(bounds).alias("bucket_len"), batch.alias("batch_id"), (F.col("nth") % F.col("room")).cast("int").alias("slot")
    )


def op6_packing(spark, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), word_count(F.col("text")), content=F.col("text"))
