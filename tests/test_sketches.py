"""Kept sketches against exact answers, within the bounds that they state."""

import random
from collections import Counter

from lineweave.operators import sketches as K


def made(spark):
    draw = random.Random(2)
    rows = [(k % 4, f"u{int(draw.paretovariate(0.7)) % 3000}", draw.gauss(10, 4)) for k in range(20_000)] + [(9, None, None)]
    return rows, spark.createDataFrame(rows, "part int, user string, value double")


def test_merged_parts_answer_for_the_whole(spark, tmp_path):
    rows, df = made(spark)
    K.distinct_sketches(df, ["part"], "user").write.parquet(str(tmp_path / "d"))
    kept = spark.read.parquet(str(tmp_path / "d"))
    for parts in ([0], [0, 1, 2, 3, 9], [9]):
        exact = len({u for p, u, _ in rows if p in parts and u is not None})
        got = K.distinct_estimates(kept.filter(kept.part.isin(parts)), []).first().estimate
        assert abs(got - exact) <= 3 * 0.01625 * exact
    K.quantile_sketches(df, ["part"], "value").write.parquet(str(tmp_path / "q"))
    kept = spark.read.parquet(str(tmp_path / "q"))
    assert kept.count() == 4
    for r in K.quantile_estimates(kept, [], [0.05, 0.5, 0.99]).collect():
        rank = sum(v <= r.value for *_, v in rows if v is not None) / 20_000
        assert abs(rank - r.share) <= 0.0165


def test_counts_are_never_too_small(spark):
    rows, df = made(spark)
    kept = K.count_sketches(df, ["part"], "user")
    assert kept.groupBy("part").count().filter(f"count > {K.DEPTH * K.WIDTH}").count() == 0
    exact = Counter(u for _, u, _ in rows)
    keys = spark.createDataFrame([(u,) for u in exact] + [("nobody",)], "user string")
    got = {r.user: r.estimate for r in K.count_estimates(kept, keys, "user").collect()}
    assert got.keys() == exact.keys() | {"nobody"}
    over = [got[u] - exact[u] for u in got]
    assert min(over) >= 0 and sum(x > 2.72 / K.WIDTH * len(rows) for x in over) <= 0.02 * len(over)


def test_no_rows(spark):
    _, df = made(spark)
    none = df.limit(0)
    assert K.distinct_estimates(K.distinct_sketches(none, ["part"], "user"), ["part"]).count() == 0
    assert K.quantile_estimates(K.quantile_sketches(none, ["part"], "value"), ["part"], [0.5]).count() == 0
    assert K.count_estimates(K.count_sketches(none, ["part"], "user"), df.select("user").limit(3).distinct(), "user").filter("estimate <> 0").count() == 0
