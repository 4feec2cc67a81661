"""Sentence splitting against a plain program of the same definitions, and on a text with planted abbreviations."""

import math
import random
from collections import Counter

from pyspark.sql import functions as F

from lineweave.operators import sentences as S

SCHEMA = "k int, text string"


def planted(seed=3, n=250):
    """Texts with abbreviations before names and numbers; the gold sentences."""
    draw = random.Random(seed)
    nouns = [f"{a}{b}" for a in ("tree", "river", "stone", "house", "field") for b in ("", "s", "let", "man", "side")]
    names = ["Miller", "Baker", "Cooper"]
    rows, gold = [], []
    for k in range(n):
        said = []
        for _ in range(draw.randrange(1, 5)):
            words = [draw.choice(["The", "A", "Every"]), *(draw.choice(nouns) for _ in range(draw.randrange(2, 6)))]
            if draw.random() < 0.5:
                words[draw.randrange(1, len(words)) :] = ["met", draw.choice(["dr.", "prof."]), draw.choice(names), draw.choice(["today", "here", "there"])]
            if draw.random() < 0.3:
                words += ["see", "p.", str(draw.randrange(9, 99)), "of", "it"]
            words[-1] += draw.choice([".", ".", "!", "?"])
            said.append(" ".join(words))
        rows.append((k, " ".join(said)))
        gold += [(k, i, s) for i, s in enumerate(said)]
    return rows, gold


def test_planted_abbreviations_are_found(spark):
    rows, gold = planted()
    texts = spark.createDataFrame(rows, SCHEMA)
    model = S.learned(texts)
    assert {"dr", "prof", "p"} <= {r.kind for r in model["abbreviations"].collect()}
    assert {"the", "a", "every"} <= {r.kind for r in model["starters"].collect()}
    got = {tuple(r) for r in S.sentences(texts, ["k"], model=model).collect()}
    assert len(got & set(gold)) / len(gold) > 0.99 and len(got) <= 1.01 * len(gold)


def log_likelihood(k, n, p):
    p = min(max(p, 0.0), 1.0)
    return (k * math.log(max(p, 1e-300)) if k > 0 else 0.0) + ((n - k) * math.log(max(1 - p, 1e-300)) if n > k else 0.0)


def test_scores_equal_plain_counts(spark):
    rows, _ = planted(4, 60)
    rows += [(900, "U.S.A. is e.g. big. 3.5 of 7."), (901, None), (902, ""), (903, "...")]
    with_, without = Counter(), Counter()
    for _, text in rows:
        for w in (text or "").split():
            w = w.strip("'\"()")
            stop = w[-1] if w and w[-1] in ".!?" else ""
            kind = (w[:-1] if stop == "." else w.rstrip(".!?,;:")).lower()
            kind = S.NUMBER if kind.replace(".", "").replace(",", "").isdigit() and kind[0].isdigit() else kind
            (with_ if stop == "." else without)[kind] += 1
    stops, total = sum(with_.values()), sum(with_.values()) + sum(without.values())
    got = {r.kind: (r.with_period, r.without, r.score) for r in S.abbreviation_scores(S.tokens(spark.createDataFrame(rows, SCHEMA), ["k"])).collect()}
    assert got.keys() == with_.keys()
    for kind, (k, rest, score) in got.items():
        assert (k, rest) == (with_[kind], without[kind])
        length = len(kind.replace(".", ""))
        want = -2 * (log_likelihood(k, k + rest, stops / total) - log_likelihood(k, k + rest, 0.99)) * math.exp(-length) * (kind.count(".") + 1) * max(length, 1) ** -rest
        assert math.isclose(score, want if any(c.isalpha() for c in kind) else 0.0, rel_tol=1e-9, abs_tol=1e-12)


def test_pair_ratio_equals_the_four_cell_table(spark):
    """Dunning's ratio is twice the sum of observed log (observed / expected) over the four cells."""
    cases = [(5, 10, 20, 1000), (1, 1, 1, 50), (30, 30, 40, 500), (2, 50, 3, 400)]
    df = spark.createDataFrame(cases, "a int, b int, c int, n int")
    for (a, b, c, n), r in zip(cases, df.select(S.bound(F.col("a"), F.col("b"), F.col("c"), F.col("n"))).collect()):
        cells = [(a, b * c / n), (b - a, b * (n - c) / n), (c - a, (n - b) * c / n), (n - b - c + a, (n - b) * (n - c) / n)]
        assert math.isclose(r[0], 2 * sum(o * math.log(o / e) for o, e in cells if o), rel_tol=1e-9, abs_tol=1e-9)


def test_edges(spark):
    texts = spark.createDataFrame([(1, None), (2, ""), (3, " \n"), (4, "One"), (5, "Stop! Go? Yes (so.) \"End.\" More"), (6, "a\nb.  C")], SCHEMA)
    got = sorted(tuple(r) for r in S.sentences(texts, ["k"]).collect())
    assert [r for r in got if r[0] == 4] == [(4, 0, "One")]
    assert [s for k, _, s in got if k == 5][:2] == ["Stop!", "Go?"] and " ".join(s for k, _, s in got if k == 5) == 'Stop! Go? Yes (so.) "End." More'
    assert {k for k, *_ in got} == {4, 5, 6}
    assert S.sentences(texts.limit(0), ["k"]).count() == 0
