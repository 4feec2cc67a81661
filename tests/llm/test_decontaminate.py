"""Benchmark decontamination against brute force over all windows and all places."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lineweave.llm import decontaminate as dec

DOCS, ITEMS = "doc_id long, text string, items int", "item_id long, text string"


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, window):
    out = []
    for i, text, *_ in docs:
        own, hit, found = words(text), set(), set()
        for item, t in items:
            test = words(t)
            k = min(len(test), window)
            for s in range(len(test) - k + 1 if k else 0):
                for p in range(len(own) - k + 1):
                    if own[p : p + k] == test[s : s + k]:
                        hit |= set(range(p, p + k))
                        found |= {str(item)} if item is not None else set()
        out.append((i, len(own), sorted(hit), sorted(found)))
    return sorted(out, key=repr)


def told(df):
    rows = []
    for r in df.collect():
        h = r["__hits"]
        rows.append((r.doc_id, h.n_words, [k for s in h.spans for k in range(s.start, s.end)], h["items"]))
    return sorted(rows, key=repr)


def draws(seed, n, letters="ab", most=60):
    draw = random.Random(seed)
    return [" ".join(draw.choice(letters) * draw.choice([1, 1, 2]) for _ in range(draw.randrange(most))) for _ in range(n)]


DOC_ROWS = [(i, t, 7) for i, t in enumerate(draws(1, 25, "abcx"))] + [
    (100, None, 7), (101, "", 7), (102, " \n-- !", 7), (103, "Ünï-Code A.B 1+2", 7), (103, "Ünï-Code A.B 1+2", 7), (None, "aa b aa b", 7),
    (104, "zz " * 500 + "a b c " * 40, 7), (105, "q\x00r s", 7),
]
ITEM_ROWS = [(i, t) for i, t in enumerate(draws(2, 12, "abc", 30))] + [(50, None), (51, "?!"), (52, "ünï CODE"), (52, "b 1"), (53, "A b c a b c a b c a b c a b c"), (None, "q r"), (54, "aa"), (54, "aa")]


@pytest.mark.parametrize("window", [3, 10])
def test_hits_equal_brute_force(spark, window):
    docs, items = spark.createDataFrame(DOC_ROWS, DOCS), spark.createDataFrame(ITEM_ROWS, ITEMS)
    found = dec.contamination(docs, items, window=window)
    assert found.columns == ["doc_id", "text", "items", "__hits"]
    want = brute(DOC_ROWS, ITEM_ROWS, window)
    assert told(found) == want
    kept = dec.decontaminate(docs.withColumn("__hits", F.lit(1)), items, window=window)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == sorted((i for i, _, hit, _ in want if not hit), key=repr)


def test_blocks_and_pieces_change_nothing(spark, monkeypatch):
    docs, items = spark.createDataFrame(DOC_ROWS, DOCS), spark.createDataFrame(ITEM_ROWS, ITEMS)
    monkeypatch.setattr(dec, "BLOCK_BYTES", 120)
    monkeypatch.setattr(dec, "PIECE_WORDS", 11)
    assert len(list(dec.bench_blocks(items, "item_id", "text", 4))) > 2
    assert told(dec.contamination(docs, items, window=4)) == brute(DOC_ROWS, ITEM_ROWS, 4)


def test_longest_matches_equal_brute_force(spark):
    docs, items = spark.createDataFrame(DOC_ROWS, DOCS), spark.createDataFrame(ITEM_ROWS, ITEMS)
    want = {}
    for item, t in ITEM_ROWS:
        test = words(t)
        for i, text, _ in DOC_ROWS:
            own = words(text)
            for s in range(len(test)):
                for p in range(len(own)):
                    n = 0
                    while s + n < len(test) and p + n < len(own) and test[s + n] == own[p + n]:
                        n += 1
                    if n:
                        key = (-n, s, i is not None, i or 0, p)
                        name = None if item is None else str(item)
                        want[name] = min(want.get(name, key), key)
    got = {r.item_id: (-r.words, r.item_at, r.doc_id is not None, r.doc_id or 0, r.doc_at) for r in dec.longest_matches(docs, items).collect()}
    assert got == want


def test_suffix_array_is_sorted_to_the_depth_asked_for():
    draw = np.random.default_rng(3)
    for bits, top in ((1, 1), (2, 3), (9, 300), (20, 3)):
        ids = draw.integers(0, top + 1, 400) * (draw.random(400) < 0.97)
        text = dec.Packed(ids.astype(np.int32), bits)
        sa = dec.suffix_array(text, 200)
        told_ = [ids[p : p + text.run[p]].tolist() for p in sa]
        assert told_ == sorted(told_) and sorted(sa.tolist()) == np.flatnonzero(ids).tolist()


def test_empty_tables(spark):
    docs, items = spark.createDataFrame(DOC_ROWS, DOCS), spark.createDataFrame(ITEM_ROWS, ITEMS)
    assert dec.contamination(docs.limit(0), items).count() == 0
    assert all(not hit and not found for _, _, hit, found in told(dec.contamination(docs, items.limit(0))))
    assert dec.longest_matches(docs, items.limit(0)).count() == 0
    shard = dec.Shard(pa.array([None, ""]), dec.Bench(["1"], [0], [["a"]], 10))
    assert shard.matches(dec.Bench(["1"], [0], [["a"]], 10)).tolist() == [0]
