"""Steps whose cost must grow with their input and no faster."""

import random
from collections import Counter

import pyarrow as pa
from pyspark.sql import functions as F

from lineweave.operators import lexicon as L
from lineweave.operators import mtmetrics as MT
from lineweave.operators import segmentation as G
from lineweave.operators import sentences as N


def test_rows_of_runs_are_short_and_routed_by_their_borders(spark):
    from lineweave.llm import collocations as C

    keys = sorted((draw.choice(["de", "en"]), f"w{draw.randrange(500)} x ") for draw in [random.Random(1)] for _ in range(3000))
    part = pa.record_batch([pa.array([k[0] for k in keys]), pa.array([k[1] for k in keys]), pa.array(range(3000))], ["lang", "phrase", "n"])
    runs = list(C.run_of(part, C.RUN_ROWS))
    assert sum(r.num_rows for r in runs) > 40 and max(len(x) for r in runs for x in r.column(2).to_pylist()) <= 64
    assert [n for r in runs for x in r.column(2).to_pylist() for n in x] == list(range(3000))
    rows = spark.createDataFrame(pa.concat_tables([pa.Table.from_batches(runs)] * 2).to_pandas(), C.RUN).coalesce(1)
    cuts = [keys[700], keys[1500], keys[2500]]
    got = C.routed(rows, cuts).select(F.spark_partition_id().alias("p"), F.explode(F.arrays_zip("lang", "phrase", "n")).alias("x")).select("p", "x.*").collect()
    assert Counter(r.n for r in got) == {n: 2 for n in range(3000)}
    assert all(r.p == sum((r.lang, r.phrase) >= c for c in cuts) for r in got)


def test_nist_shuffles_each_ngram_of_a_reference_once(spark):
    rows = spark.createDataFrame([("a b a b".split(), "a b a".split()), (None, ["a"]), (["b"], None)], "h array<string>, r array<string>").coalesce(1)
    got = {tuple(r.g.split("\0")[:-1]): (r.n, r.b, r.hit, r.begun) for r in MT.reference_grams(rows, 3).collect()}
    assert got == {("a",): (1, 3, 2, 1), ("b",): (1, 1, 1, 1), ("a", "b"): (2, 1, 1, 1), ("b", "a"): (2, 1, 1, 0), ("a", "b", "a"): (3, 1, 1, 0)}
    plan = MT.nist(rows.withColumn("k", F.lit(1)), ["k"])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") <= 2 and "Generate explode(flatten" not in plan


def test_candidates_meet_by_group(spark, tmp_path):
    from lineweave.plans.data_queries import candidate_selection

    spark.createDataFrame([(n % 5, n) for n in range(40)], "s_nationkey int, s_suppkey long").write.parquet(f"{tmp_path}/supplier.parquet")
    spark.createDataFrame([(n % 6, n) for n in range(90)], "c_nationkey int, c_custkey long").write.parquet(f"{tmp_path}/customer.parquet")
    met = {}
    for s in range(40):
        for c in range(90):
            if s % 7 == c % 7 and 3 in (s % 5, c % 6):
                met.setdefault((s % 5, c % 6), []).append(c)
    best = {}
    for (a, b), cs in met.items():
        k = a if b == 3 else b
        best[k] = (max(best.get(k, (0, 0))[0], len(cs)), max(best.get(k, (0, 0))[1], float(max(cs))))
    found = candidate_selection(spark, str(tmp_path))
    assert {r.candidate: (r.parallel, r.score) for r in found.collect()} == {k: v for k, v in best.items() if v[0] >= 2 and v[1] >= 50}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan[plan.index("Join") :].count("Aggregate") == 2


def test_abbreviations_take_distinct_writings_apart(spark):
    texts = spark.createDataFrame([("The u.s. (U.S.) and 3, 4.5. end! end.",), (None,), ("",), ("u.s. end.",)], "text string")
    want = {(r.kind, r.stop): r.n for r in N.tokens(texts, []).groupBy("kind", "stop").agg(F.count("*").alias("n")).collect()}
    got = N.counted(texts)
    assert {(r.kind, r.stop): r.n for r in got.groupBy("kind", "stop").agg(F.sum("n").alias("n")).collect()} == want
    score = lambda toks: sorted(map(tuple, N.abbreviation_scores(toks).collect()))
    assert score(got) == score(N.tokens(texts, []))


def test_links_are_dealt_before_they_are_counted(spark, monkeypatch):
    monkeypatch.setattr(L, "LINKS", 10)
    draw = random.Random(3)
    rows = [(run, k, draw.randrange(4), draw.randrange(4)) for run in (1, 2, 3) for k in range(40) for _ in range(6)]
    held = L.majority_links(spark.createDataFrame(rows, "run int, k int, i int, j int"), ["k"], 3)
    seen = Counter(r[1:] for r in set(rows))
    assert {tuple(r) for r in held.collect()} == {x for x, n in seen.items() if n > 1}
    assert held.rdd.getNumPartitions() >= len(rows) // 10


def test_break_scores_equal_each_break_by_itself(spark):
    draw = random.Random(9)
    words = ["a", "B", "Ⅷ", ".", '"', "ß1", "ǅ", "", None]
    rows = []
    for k in range(80):
        s, t = ([draw.choice(words) for _ in range(draw.randrange(2, 14))] for _ in range(2))
        links = [(draw.randrange(16), draw.randrange(16)) for _ in range(draw.randrange(12))]
        rows.append((f"p{k}", s, t, links, [draw.randrange(16) for _ in range(draw.randrange(4))] + [None] * (k % 9 == 0)))
    passages = spark.createDataFrame(rows, "passage string, src array<string>, trg array<string>, links array<struct<i: int, j: int>>, breaks array<int>")
    each = passages.select("*", F.explode("breaks").alias("at")).select("*", F.explode(F.sequence(F.lit(1), F.size("trg") - 1)).alias("to"))
    want = Counter(tuple(r) for r in each.select("passage", "at", "to", G.break_score(F.col("at"), F.col("to")).alias("score")).collect())
    assert Counter(tuple(r) for r in G.break_scores(passages).collect()) == want and len(want) > 500


def test_rows_that_are_long_in_work_are_dealt_to_all_cores(spark):
    from lineweave.plans.metric_queries import shifted

    rows = shifted(spark, "/root/testdata/sf0.001")
    assert rows.rdd.getNumPartitions() >= 4 * spark.sparkContext.defaultParallelism


def test_ibm1_writes_a_pair_of_words_once_a_block(spark, monkeypatch):
    import math

    monkeypatch.setattr(L, "HELD", 40)
    draw = random.Random(4)
    rows = [(k, [draw.choice("abcd") for _ in range(draw.randrange(6))], [draw.choice("wxyz") for _ in range(draw.randrange(6))]) for k in range(60)] + [(90, None, ["w"]), (91, ["a"], None)]
    written, kept = L.written, {}
    monkeypatch.setattr(L, "written", lambda df, name: kept.setdefault(name, written(df, name)) if name == "cells" else written(df, name))
    got = {(r.src, r.trg): r.prob for r in L.ibm1(spark.createDataFrame(rows, "k int, src array<string>, trg array<string>"), ["k"], 3).collect()}
    pairs = [(["NULL", *s], t) for _, s, t in rows if s is not None and t]
    table = {(a, b): 1 / 4 for s, t in pairs for a in s for b in t}
    for _ in range(3):
        counts = Counter()
        for s, t in pairs:
            for b in t:
                for a in s:
                    counts[a, b] += table[a, b] / sum(table[x, b] for x in s)
        sums = Counter()
        for (a, _), n in counts.items():
            sums[a] += n
        table = {(a, b): n / sums[a] for (a, b), n in counts.items()}
    assert got.keys() == table.keys() and all(math.isclose(got[c], table[c], rel_tol=1e-9) for c in table)
    cells = kept["cells"].groupBy("block", "src", "trg").count()
    assert cells.filter("count > 1").count() == 0 and kept["cells"].count() < sum(len(set(s)) * len(set(t)) for s, t in pairs)


def test_rounds_of_aligners_shuffle_lists_of_distinct_pairs(spark, monkeypatch):
    from lineweave.operators import aligners as al
    from lineweave.operators import blocks as B

    monkeypatch.setattr(B, "HELD", 200)
    draw = random.Random(8)
    rows = [(k, [draw.choice("abcde") for _ in range(draw.randrange(6))], [draw.choice("vwxyz") for _ in range(draw.randrange(6))]) for k in range(120)]
    sents, tasks = B.dealt(spark.createDataFrame(rows, "k int, s array<string>, t array<string>"), ["k"], ["k"])
    cells = B.numbered(sents)
    blocks = sents.select("block").distinct().count()
    count = lambda prob: (prob, prob.sum(keepdims=True).ravel())
    told = al.expected(sents, cells.select("block", "place", "pair", F.lit(1.0).alias("n")), tasks, lambda cells, n: n[: cells.sources], count)
    want = Counter((a, b) for _, s, t in rows for a in ["NULL", *s] for b in t)
    assert {(r.src, r.trg): r.n for r in al.counted(cells, told).filter("trg IS NOT NULL").collect()} == want
    assert blocks > 1 and told.count() <= blocks * (tasks + 1) < sum(want.values()) and al.summed(told)[0] == sum(want.values())
    sums = B.unpacked(B.met(told)).distinct().collect()
    assert len({r.pair for r in sums}) == len(sums) and sum(r.n for r in sums) == 2 * sum(want.values())


def test_orders_meet_shared_pairs_once_before_the_search(spark, monkeypatch):
    from lineweave.operators import blocks as B
    from lineweave.operators import orders as O

    monkeypatch.setattr(O, "HELD", 100)
    draw = random.Random(6)
    rows = []
    for k in range(90):
        own, book = f"own{k % 3}", "ABC"[k % 3]
        rows.append((k, book, ["NULL", *(draw.choice(["a", "b", "c", own]) for _ in range(draw.randrange(1, 6)))], [draw.choice(["x", "y", own]) for _ in range(draw.randrange(1, 9))]))
    sents, books, blocks = O.dealt(O.shared(spark.createDataFrame(rows, "at long, book string, s array<string>, t array<string>")))
    numbers = {n for r in sents.collect() for n in [*r.s, *r.t]}
    assert books == ["A", "B", "C"] and blocks > 6 and numbers == set(range(1, 7))  # a, b, c, NULL, x, y
    lists, cells = O.told(sents, blocks), sum(len(s) * len(t) for _, _, s, t in rows)
    told = lists.toArrow()
    assert told.num_rows <= blocks * blocks and len(B.values(told, "pair")) < cells / 2
    known = O.met(lists, 3).toArrow()
    held = {(p >> O.BITS, p & (1 << O.BITS) - 1) for p in B.values(known, "pair").tolist()}
    assert len(held) <= 4 * (2 + 1)  # pairs of shared words, and the sum of each source word
    known = spark.createDataFrame(known.to_pandas(), "block long, pair binary, book binary, n binary")
    plan = O.wider(sents, known, 2 * blocks, books, [["A"], ["B"]])._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "Join" not in plan
