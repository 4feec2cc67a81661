"""Collocations against brute force over all phrases of all pieces."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from lineweave.llm import collocations as col

SCHEMA = "text string, lang string, rank int"


def pieces(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [re.findall(r"[^ \t]+", p) for p in re.split(r"[.,;:!?\n\x0b\x0c\r]", low)]


def ranked(counts, totals, min_count, cover_pct, top):
    """counts: {(lang, words): f}. The contract, word for word, with Python's integers."""
    out = []
    for lang, n in totals.items():
        own = {p: f for (of, p), f in counts.items() if of == lang}
        candidates = {p: f for p, f in own.items() if len(p) > 1 and f >= min_count}
        longer = Counter()
        for p, f in candidates.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    longer[p[i : i + k]] = max(longer[p[i : i + k]], f)
        rows = []
        for p, a in candidates.items():
            score, k = min((1000 * a * n // (own[p[:k]] * own[p[k:]]), k) for k in range(1, len(p)))
            if p not in longer or 100 * longer[p] < cover_pct * a:
                rows.append((-score, -a, " ".join(p).encode(), " ".join(p), own[p[:k]], own[p[k:]]))
        rows.sort()
        out += [(lang, i + 1, p, -a, l, r, n, -score) for i, (score, a, _, p, l, r) in enumerate(rows[:top])]
    return sorted(out)


def brute(rows, min_count, longest, cover_pct, top):
    counts, totals = Counter(), Counter()
    for text, lang, *_ in rows:
        lang = "und" if lang is None else lang
        for words in pieces(text):
            totals[lang] += len(words)
            for i in range(len(words)):
                for k in range(1, min(longest, len(words) - i) + 1):
                    counts[lang, tuple(words[i : i + k])] += 1
    return ranked(counts, totals, min_count, cover_pct, top)


def made(seed, n=60):
    draw = random.Random(seed)
    words = ["a", "B", "b\x01", "É", "the", "xx", "42", "a-b", "\x00", "é"]
    glue = [" ", " ", " ", "\t", "  ", ". ", ",", "\n", "? "]
    rows = []
    for _ in range(n):
        text = "".join(draw.choice(words[: draw.choice([3, 10])]) + draw.choice(glue) for _ in range(draw.randrange(60)))
        rows.append((text, draw.choice(["de", "de", "en", None, "und", ""]), 1))
    return rows + [(None, "de", 1), ("", None, 1), (" .\t,", "en", 1), ("one", "fr", 1), ("hot pair again " * 300, "en", 1), ("x y", "en", 1), ("x y", "en", 1)]


def told(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize(("seed", "min_count", "longest", "cover_pct", "top", "range_rows"), [(1, 3, 5, 100, 2000, 1 << 20), (2, 2, 5, 90, 7, 30), (3, 5, 3, 100, 2000, 10), (4, 300, 5, 100, 5, 40)])
def test_equals_brute_force(spark, monkeypatch, seed, min_count, longest, cover_pct, top, range_rows):
    monkeypatch.setattr(col, "RANGE_ROWS", range_rows)  # so few rows a range that phrases reach over many of them
    monkeypatch.setattr(col, "SPACING", 2)
    rows = made(seed)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    found = col.collocations(df, min_count=min_count, longest=longest, cover_pct=cover_pct, top=top)
    assert found.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert told(found) == brute(rows, min_count, longest, cover_pct, top)


def test_products_past_64_bits(spark, monkeypatch):
    counts = {("en", ("a",)): 4 * 10**12, ("en", ("b",)): 3 * 10**12, ("en", ("c",)): 10**11 + 7, ("en", ("a", "b")): 10**12 + 1, ("en", ("b", "c")): 10**11, ("en", ("a", "b", "c")): 99}
    totals = {"en": sum(f for (_, p), f in counts.items() if len(p) == 1)}
    words = spark.createDataFrame([(of, p[0], f) for (of, p), f in counts.items() if len(p) == 1], "lang string, word string, n long")
    phrases = spark.createDataFrame([(of, " ".join(p), f) for (of, p), f in counts.items() if len(p) > 1 and f > 99], "lang string, phrase string, n long")
    monkeypatch.setattr(col, "phrase_counts", lambda *_: (words, phrases))
    assert told(col.collocations(words)) == ranked(counts, totals, 100, 100, 2000)


def test_multikey_counts_equal_plain_counts():
    draw = np.random.default_rng(5)
    for n, top in ((1, 2), (50, 2), (3000, 4), (3000, 60)):
        rows = draw.integers(1, top + 1, (n, 6)) * (np.arange(6) < draw.integers(1, 7, (n, 1)))
        weights = draw.integers(1, 5, n)
        want = Counter()
        for row, w in zip(rows.tolist(), weights.tolist(), strict=True):
            for d in range(1, 7):
                if row[d - 1]:
                    want[tuple(row[:d])] += w
        got = {tuple(rows[p, :d].tolist()): t for ptr, depth, total in col.multikey_counts(rows, weights, 9) for p, d, t in zip(ptr.tolist(), depth.tolist(), total.tolist(), strict=True)}
        assert got == {p: t for p, t in want.items() if t >= 9}
    assert col.multikey_counts(np.zeros((0, 6), np.int32), np.zeros(0, np.int64), 1) == []


def test_empty_table(spark):
    df = spark.createDataFrame(made(1)[:3], SCHEMA)
    assert col.collocations(df.limit(0)).count() == 0
    assert col.collocations(df.filter("text = 'no such text'"), min_count=1).count() == 0
