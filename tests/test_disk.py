"""What rounds and shuffles leave on disk."""

import os
import random
import time

from pyspark.sql import functions as F

from lineweave import session as S


def files_of(df):
    return os.path.exists(df.written_to.removeprefix("file://"))


def test_written_leaves_no_shuffle_files_and_keeps_the_setting(spark):
    tops = [d.getAbsolutePath() for d in spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]
    shuffles = lambda: {f for top in tops for _, _, names in os.walk(top) for f in names if f.startswith("shuffle_") and f.endswith(".data")}
    before = shuffles()
    assert spark.conf.get(S.CLEANUP) == "false"
    table = S.written(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count().repartition(3), "table")
    assert spark.conf.get(S.CLEANUP) == "false"
    for _ in range(100):  # files go a little later
        if not shuffles() - before:
            break
        time.sleep(0.1)
    assert not shuffles() - before and table.count() == 7
    S.forget(table)
    assert not files_of(table)


def test_rounds_of_aligners_replace_each_other(spark, monkeypatch):
    from lineweave.operators import aligners as al
    from lineweave.operators import blocks as B

    made, most = [], []

    def written(df, name):
        out = S.written(df, name)
        made.append((name, out))
        most.append(sum(files_of(x) for n, x in made if n == "round"))
        return out

    monkeypatch.setattr(al, "written", written)
    monkeypatch.setattr(B, "written", written)
    draw = random.Random(2)
    rows = spark.createDataFrame([(k, [draw.choice("abcde") for _ in range(4)], [draw.choice("vwxyz") for _ in range(4)]) for k in range(30)], "k int, s array<string>, t array<string>")
    for run, rounds in ((al.hmm, 7), (al.fast_align, 5)):
        made.clear()
        assert run(rows, ["k"]).count() > 0
        tables = [x for n, x in made if n == "round"]
        assert len(tables) == rounds and max(most) == 2
        assert {"pair", "place", "src"}.isdisjoint(c for x in tables for c in x.columns)
        assert sum(files_of(x) for n, x in made if n in ("sentences", "words")) == 0
    made.clear()
    al.eflomal(rows, ["k"], (1, 1, 3)).count()
    assert not any("marginals" in x.columns for _, x in made)


def test_rounds_of_ibm1_tell_sums_of_source_words_alone(spark, monkeypatch):
    from lineweave.operators import lexicon as L

    made = []
    monkeypatch.setattr(L, "HELD", 60)
    monkeypatch.setattr(L, "written", lambda df, name: made.append((name, (out := S.written(df, name)), out.count(), sorted(out.columns))) or out)
    draw = random.Random(3)
    rows = [(k, [draw.choice("abcdef") for _ in range(5)], [draw.choice("uvwxyz") for _ in range(5)]) for k in range(60)]
    table = L.ibm1(spark.createDataFrame(rows, "k int, src array<string>, trg array<string>"), ["k"], 3)
    assert table.count() == len({(a, b) for _, s, t in rows for a in [*s, "NULL"] for b in t})
    blocks = next(n for name, _, n, _ in made if name == "cells")
    assert blocks > 1 and [name for name, *_ in made] == ["sentences", "cells", *["told", "sums"] * 3]
    assert all(n <= blocks * 7 and "trg" not in columns for name, _, n, columns in made if name in ("told", "sums"))
    assert not any(files_of(x) for name, x, *_ in made if name in ("sentences", "told"))


def test_known_counts_of_book_orders_are_squeezed(spark):
    from lineweave.operators import orders as O

    draw = random.Random(6)
    rows = [(k, "ABC"[k % 3], ["NULL", *(f"w{draw.randrange(60)}" for _ in range(8))], [f"x{draw.randrange(60)}" for _ in range(8)]) for k in range(150)]
    sents, books, blocks = O.dealt(O.shared(spark.createDataFrame(rows, "at long, book string, s array<string>, t array<string>")))
    plain = O.met(O.told(sents, blocks), len(books))
    lists = {}
    for kind, table in (("plain", plain), ("squeezed", O.squeezed(O.met(O.squeezed(O.told(sents, blocks)), len(books))))):
        found = table.toArrow()
        lists[kind] = sorted(zip(found.column("block").to_pylist(), *([x.tolist() for x in O.numbers(found, c)] for c in ("pair", "book", "n"))))
        lists[kind, "bytes"] = sum(len(x) for c in ("pair", "book", "n") for x in found.column(c).to_pylist())
    assert lists["plain"] == lists["squeezed"] and lists["squeezed", "bytes"] < lists["plain", "bytes"] / 2
    assert O.squeezed(plain.limit(0)).count() == 0
