import math
import random

import pytest
from pyspark.sql import functions as F

from lineweave.functions import text as X
from lineweave.functions import udfs as U
from lineweave.operators import corpus as C
from lineweave.operators import datasets as D
from lineweave.operators import filters as R
from lineweave.operators import lexicon as L
from lineweave.operators import misc as M
from lineweave.operators import segmentation as G
from lineweave.operators import splits as S
from lineweave.operators import vocabulary as V


def values(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_range_fold(spark):
    rows = [(1, 1, "a", "x"), (1, 2, "<range>", "y"), (1, 3, "", "<range>"), (1, 4, "d", ""), (2, 1, "<range>", "q"), (2, 2, "e", "z")]
    df = spark.createDataFrame(rows, "p int, n int, src string, trg string")
    got = values(C.fold_ranges(df, ["p"], "n").select("p", "grp", "n", "src", "trg"), "p", "n")
    assert got == [(1, 1, 1, "a", "x y"), (1, 2, 4, "d", ""), (2, 0, 1, "", "q"), (2, 1, 2, "e", "z")]
    assert C.fold_ranges(df.limit(0), ["p"], "n").count() == 0


def test_empty_sides(spark):
    df = spark.createDataFrame([(1, "", "..."), (2, "a", "..."), (3, "a", "b")], "n int, src string, trg string")
    assert values(C.drop_empty(df), "n") == [(3, "a", "b")]
    assert values(C.keep_one_sided(df), "n") == [(2, "a", ""), (3, "a", "b")]


def test_joins_and_unions(spark):
    a = spark.createDataFrame([(1, "x", None), (2, None, "q")], "k int, v string, w string")
    b = spark.createDataFrame([(2, "y", 5), (3, "z", 6)], "k int, v string, u int")
    assert values(C.combine_first(a, b, ["k"]), "k") == [(1, "x", None, None), (2, "y", "q", 5), (3, "z", None, 6)]
    assert values(C.keyed_overwrite(a.select("k", "v"), b.select("k", "v"), ["k"]), "k") == [(1, "x"), (2, "y"), (3, "z")]
    files = spark.createDataFrame([(0, "a"), (1, "b")], "position int, s string")
    assert C.expand_pairs(files, files.withColumnRenamed("s", "t"), False).count() == 2
    assert C.expand_pairs(files.drop("position"), files.select(F.col("s").alias("t")), True).count() == 4


@pytest.mark.parametrize(
    ("line", "reason"),
    [("", "blank"), ("one two", "word_count"), ("a/b/c/d/e/f/g is one two three", "specific_punct"), ("w " * 5 + "x" * 151, "word_length"), ("a b c d", "word_length"),
     ("well... yes, no! why? oh: hm; (a) [bb]", "punctuation"), ("some <b>bold words</b> here", "html"), ("four plain words here", None), ("see https://x.org for more words", "html"), ("ends in \\x00 some words", "special_char")],
)
def test_line_rules(spark, line, reason):
    assert R.cascade(spark.createDataFrame([(line,)], "line string"), R.line_rules()).first().reason == reason


def test_cascade_report_adds_up(spark):
    df = spark.createDataFrame([("en", ""), ("en", "four plain words here"), ("fr", "x")], "lang string, line string")
    got = {(r.lang, r.reason): (r.n, r.share) for r in R.report(R.cascade(df, R.line_rules()), ["lang"]).collect()}
    assert got == {("en", "blank"): (1, 0.5), ("en", "kept"): (1, 0.5), ("fr", "word_count"): (1, 1.0)}


def test_clean_rows(spark):
    df = spark.createDataFrame([(" ab ", "c\nd", "TEST"), ("a", "bb", None), ("aa", "bb", "odd")], "src string, trg string, split string")
    assert values(R.clean_rows(df, ["src", "trg"]), "src") == [("aa", "bb", "train", False), ("ab", "c d", "test", True)]
    terms = spark.createDataFrame([("god; lord",), ("tree",)], "t string")
    assert values(R.drop_common_terms(terms, "t", ["lord"]), "t") == [("tree",)]


def test_splits_are_disjoint_and_whole(spark):
    rows = spark.range(1000).select(F.col("id").alias("k"), (F.col("id") % 3).alias("p"))
    got = S.split_bands(rows, ["k"], ["p"], [("test", 0.1), ("val", 20)], "s")
    assert got.count() == 1000 and got.select("k").distinct().count() == 1000
    assert {(r.p, r.split): r["count"] for r in got.groupBy("p", "split").count().collect()}[(0, "val")] == 20
    sample = S.stratified(rows, "p", 100, ["k"], "s")
    assert sample.count() == 100 and sorted(r["count"] for r in sample.groupBy("p").count().collect()) == [33, 33, 34]


def test_noise(spark):
    df = spark.createDataFrame([("a b c d e f g h",)], "t string").select(X.tokens("t").alias("w"))
    words = df.first().w
    assert set(df.select(S.drop_tokens(F.col("w"), 0.5, "s")).first()[0]) <= set(words)
    assert df.select(S.drop_tokens(F.col("w"), 0.0, "s")).first()[0] == words
    assert df.select(S.replace_tokens(F.col("w"), 1.1, "s")).first()[0] == ["<blank>"] * 8
    moved = df.select(S.permute_tokens(F.col("w"), 2, "s")).first()[0]
    assert sorted(moved) == words and all(abs(moved.index(x) - i) <= 3 for i, x in enumerate(words))


@pytest.mark.parametrize(
    ("text", "want"),
    [("  a ,b  . c ", "a, b. c"), ("( a )", "(a)"), ("one-two", "one - two"), ("and / or", "and / or"), ("(a)", "(a)"), ("x(a )y", "x (a) y"), ("<b> c", "<b> c"), ("a , . b", "a , . b"), ("a , . b  c", "a , . b c"), ("he said  'hi", "he said 'hi"),
     ("hi'  he", "hi' he"), ("it's", "it's"), ("a  '  b", "a ' b"), ("' hi", "'hi"), ("hi '", "hi'"), ("- x -", "- x -"), ("a\u00a0. b", "a. b"), ("...", "..."), (".", "."), ("wait ... what", "wait ... what"), ("tab\tand  blank", "tab and blank"), ("", ""), ("a?", "a?")],
)
def test_punctuation(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(X.normalise_punctuation("t")).first()[0] == want


def test_rule_validation():
    for bad in ({"ab": "before"}, {" ": "before"}, {".": "sideways"}, [(".", "before"), (".", "after")]):
        with pytest.raises(ValueError):
            X.validate_rules(bad)


def test_text_columns(spark):
    df = spark.createDataFrame([("▁Hel lo ▁wor ld", "a 1,000 and 22", "“Word,”", "İ x")], "p string, d string, m string, u string")
    row = df.select(X.decode_pieces("p"), X.numbers("d"), X.strip_punct("m"), X.strip_html(F.lit("<b>a</b> http://x y"))).first()
    assert tuple(row) == ("Hello world", ["1,000", "22"], "Word", "a  y")


def test_lexicon_algebra(spark):
    links = spark.createDataFrame([("a", "x"), ("a", "x"), ("a", "y"), ("b", "y")], "src string, trg string")
    lex = L.normalise(L.build(links))
    assert values(lex.withColumn("prob", F.round("prob", 3)), "src", "trg") == [("a", "x", 0.667), ("a", "y", 0.333), ("b", "y", 1.0)]
    back = L.normalise(L.build(links.select(F.col("trg").alias("src"), F.col("src").alias("trg"))))
    assert values(L.symmetrise(lex, back).withColumn("prob", F.round("prob", 3)), "src", "trg") == [("a", "x", 0.8), ("a", "y", 0.2), ("b", "y", 1.0)]
    gold = spark.createDataFrame([("a", "x"), ("c", "z")], "src string, trg string")
    got = L.precision_recall_at_k(lex, gold, 1).first()
    assert got.precision == 0.5 and got.recall == 0.5
    assert L.mean_average_precision(lex, gold).first().map == 0.25
    empty = L.precision_recall_at_k(lex.limit(0), gold.limit(0), 1).first()
    assert empty.precision == 1.0 and empty.recall == 1.0


def test_alignment_metrics(spark):
    system = spark.createDataFrame([(1, 0, 0), (1, 1, 2)], "k int, i int, j int")
    gold = spark.createDataFrame([(1, 0, 0, True), (1, 1, 1, True), (1, 1, 2, False)], "k int, i int, j int, sure boolean")
    got = L.alignment_metrics(system, gold, ["k"], ["k"]).first()
    assert (got.aer, got.precision, got.recall) == (0.25, 1.0, 0.5)


def test_ibm1_finds_the_translation(spark):
    rows = [(1, ["la", "maison"], ["the", "house"]), (2, ["la", "fleur"], ["the", "flower"]), (3, ["fleur"], ["flower"])]
    pairs = spark.createDataFrame(rows, "k int, src array<string>, trg array<string>")
    table = {(r.src, r.trg): r.prob for r in L.ibm1(pairs, ["k"], 6).collect()}
    assert table["fleur", "flower"] > 0.9 and table["la", "the"] > 0.8 and table["maison", "house"] > 0.7
    sums = {}
    for (s, _), p in table.items():
        sums[s] = sums.get(s, 0) + p
    assert all(math.isclose(x, 1.0) for x in sums.values())


def test_rank_biased_overlap():
    assert U.rbo_ext([], []) == 1.0 and U.rbo_ext(["a"], []) == 0.0
    assert math.isclose(U.rbo_ext(["a", "b", "c"], ["a", "b", "c"]), 1.0)
    assert math.isclose(U.rbo_ext(["a", "b"], ["c", "d"]), 0.0)
    assert 0 < U.rbo_ext(["a", "b", "c"], ["c", "a", "b"]) < 1
    assert math.isclose(U.rbo_ext([{"a", "b"}, "c"], [{"b", "a"}, "c"]), 1.0)


def all_shifts_ter(hyp, ref):
    best, shifts = U.edit_counts(hyp, ref), 0
    while best:
        tried = []
        for i in range(len(hyp)):
            for j in range(len(ref)):
                for n in range(1, 11):
                    if i != j and abs(i - j) <= 50 and i + n <= len(hyp) and hyp[i : i + n] == ref[j : j + n]:
                        rest = hyp[:i] + hyp[i + n :]
                        tried.append(rest[:j] + hyp[i : i + n] + rest[j:])
        costs = [U.edit_counts(m, ref) for m in tried]
        if not costs or min(costs) + 1 >= best:
            break
        best, hyp, shifts = min(costs), tried[costs.index(min(costs))], shifts + 1
    return best + shifts


def test_ter_tries_every_shift():
    draw = random.Random(4)
    for _ in range(120):
        ref = [str(draw.randrange(30)) for _ in range(16)]
        hyp = [w for w in ref if draw.random() > 0.1]
        for _ in range(2):
            i, n = draw.randrange(len(hyp)), draw.randrange(1, 6)
            part, hyp = hyp[i : i + n], hyp[:i] + hyp[i + n :]
            at = draw.randrange(len(hyp) + 1)
            hyp = hyp[:at] + part + hyp[at:]
        assert U.ter_edits(hyp, ref) == all_shifts_ter(hyp, ref)


def test_edit_functions():
    assert U.edit_counts(list("abcd"), list("acbd"), True) == 1 and U.edit_counts(list("abcd"), list("acbd")) == 2
    assert U.quick_edits(list("kitten"), list("sitting")) == 3 and U.quick_edits([], list("ab")) == 2
    assert math.isclose(U.jaro_similarity("MARTHA", "MARHTA"), 0.944444, abs_tol=1e-5) and U.jaro_similarity([], []) == 1.0
    assert U.ter_edits("b c a".split(), "a b c".split()) == 1 and U.ter_edits([], ["a"]) == 1
    assert U.word_diff("a b c", "a x c")[1] == "replace\tb\tx"
    assert U.gloss_list("tree (big), bush; [plant]/tree 1.2") == ["tree", "bush"] and U.gloss_list("[tree, wood?] x") == ["tree", "wood"]
    assert U.without_parens("tree (of life, big") == "tree (of life, big" and U.without_parens("a (b (c) d") == "a (b  d" and U.without_parens("a (b) c) d") == "a (b) c) d"
    assert U.common_length(list("abcbdab"), list("bdcaba")) == 4 and U.common_length([], ["a"]) == 0
    assert U.unicode_details("é") == "U+00E9 LATIN SMALL LETTER E WITH ACUTE"
    assert U.grow_diag_final({(0, 0), (1, 1)}, {(0, 0), (1, 2)}) == [(0, 0), (1, 1), (1, 2)]


def test_segmentation(spark):
    links = [(i, i) for i in range(8)]
    row = ("p", "In the beginning. And he saw it.".split(), "Au commencement donc. Et il a vu.".split(), links, [3])
    df = spark.createDataFrame([row], "passage string, src array<string>, trg array<string>, links array<struct<i: int, j: int>>, breaks array<int>")
    scores = {(r["at"], r.to): r.score for r in G.break_scores(df).collect()}
    known = G.Links(row[1], row[2], links)
    assert scores == {(3, t): known.score(3, t) for t in range(1, 7)} and max(scores, key=scores.get) == (3, 3)
    assert values(G.place_breaks(df), "at") == [("p", 3, 3)]
    parts = G.split_passages(df.withColumn("breaks", F.array(F.lit(8)))).orderBy("part").collect()
    assert [w for r in parts for w in r.src] == row[1] and [w for r in parts for w in r.trg] == row[2]
    cut = df.select(G.segments(F.col("trg"), F.array(F.lit(3)))).first()[0]
    assert cut == ["Au commencement donc.", "Et il a vu."]
    assert spark.range(1).select(G.repair_edges(F.array(F.lit("one"), F.lit(", two")))).first()[0] == ["one,", " two"]
    gold = spark.createDataFrame([("p", 1, "ab"), ("p", 2, "cd")], "passage string, verse int, text string")
    other = spark.createDataFrame([("p", 1, "abc"), ("p", 2, "d")], "passage string, verse int, text string")
    assert tuple(G.segmentation_report(gold, other).first()) == (0.0, 1.0)
    back = G.passages_from_json(G.passage_json(gold.select("passage", "text")), "text string")
    assert sorted(r.text for r in back.collect()) == ["ab", "cd"]


def test_datasets(spark):
    pairs = spark.createDataFrame([("f", i, f"s{i}", "" if i == 3 else f"t{i}") for i in range(30)], "file string, n int, src string, trg string")
    built = D.build_dataset(pairs, D.CorpusPair(("a",), ("b",), test_size=0.1, val_size=5), ["file"], "n", ["fr"], "x", mirrored=True)
    counts = {(r.split, r.mirrored): r["count"] for r in built.groupBy("split", "mirrored").count().collect()}
    assert counts == {("test", False): 2, ("val", False): 5, ("train", False): 22, ("train", True): 22}
    routed = D.route_rows(pairs, ["n"], ["file"], {0, 3}, {3, 4})
    assert {r.place: r.split for r in routed.filter("place < 5").collect()} == {0: "test", 1: "train", 2: "train", 3: "test", 4: "val"}
    assert D.batches(pairs, ["file"], ["n"], 8).agg(F.max("batch")).first()[0] == 3
    for bad in ({"src": ("a",), "trg": ()}, {"src": ("a", "b"), "trg": ("c",)}, {"src": ("a",), "trg": ("b",), "kinds": frozenset({"x"})}):
        with pytest.raises(ValueError):
            D.CorpusPair(**bad)
    assert D.CorpusPair(("a", "b"), ("c",), many_to_many=True).files() == [("a", "c"), ("b", "c")]


def test_drafts_prompts_and_planning(spark):
    rows = spark.createDataFrame([(1, ["a", "b"])], "k int, d array<string>")
    assert values(D.transpose_drafts(rows, ["k"], "d"), "draft") == [(1, 0, "a"), (1, 1, "b")]
    parts = spark.createDataFrame([(1, 0, 1, "x", 0.0), (1, 0, 0, "w", -2.0), (2, 0, 0, "y", None)], "k int, draft int, o int, text string, log_score double")
    got = values(D.rejoin_drafts(parts, ["k"], "o"), "k")
    assert got[0][:3] == (1, 0, "w x") and math.isclose(got[0][3], math.exp(-1)) and got[1][3] is None
    row = spark.range(1).select(D.chat_prompt(F.lit("a"), F.lit("b"), "sys"), D.chat_prompt(F.lit("a"), F.lit("b"), "sys", True), D.without_echo(F.lit("ab  c"), F.lit("ab"))).first()
    assert [m.role for m in row[0]] == ["system", "user", "assistant"] and row[1][0].content == "sys\n\na" and row[2] == "c"
    names = spark.createDataFrame([("checkpoint-500",), ("checkpoint-1500",), ("other",)], "name string")
    assert tuple(D.checkpoints(names).first()) == (500, 1500)
    ends = spark.createDataFrame([("p", "GEN", 31, 55), ("q", "GEN", 31, 54)], "project string, book string, chapter int, verse int")
    assert values(D.versification(ends, [("Original", {("GEN", 31): 54}), ("English", {("GEN", 31): 55})]), "project") == [("p", "English"), ("q", "Original")]
    stats = spark.createDataFrame([("a", "t", 3000, 0.5), ("t", "b", 2500, 0.6), ("c", "t", 10, 0.9)], "src string, trg string, parallel int, score double")
    best = D.select_candidates(stats, "t")
    assert [r.candidate for r in best.collect()] == ["b", "a"] and values(D.candidate_pairs(best, 2), "first") == [("a", "b")]
    assert D.stable_size(lambda n: [1.0, 1.0 if n >= 30 else 0.0], [1.0, 1.0]) == 30
    found = D.beam_search(["x", "y", "z"], 2, lambda ps: {p: (-float("zyx".index(p[0])), len(p)) for p in ps})
    assert found[0][0][0] == "z" and len(found) == 2
    marked = spark.createDataFrame([("v", 1, "t"), ("rem", 1, "x"), ("s", 1, "One. " * 60), ("v", 2, "u")], "marker string, chapter int, text string")
    assert D.needed_rows(marked, [1]).count() == 61


def test_verse_matrix_totals_books_outside_the_list(spark):
    counts = spark.createDataFrame([("en", "a", 2), ("en", "z", 5), ("de", "z", 1)], "lang string, book string, verses long")
    assert values(V.verse_matrix(counts, "lang", "book", ["a", "b"]), "lang") == [("de", 0, 0, 1, 1), ("en", 2, 0, 5, 7)]


def brute_breaks(src, trg, links, at, to):
    score = -20 * sum((i < at) != (j < to) for i, j in links)
    for i, j in links:
        if at - 5 <= i <= at + 5 and to - 5 <= j <= to + 5:
            score += abs(j - to)
    bare = lambda w: not any(c.isalpha() for c in w)
    score += 5 * (at > 0 and to > 0 and bare(src[at - 1]) and bare(trg[to - 1]))
    if at < len(src) - 1 and to < len(trg) - 1:
        score += 5 * (bare(src[at + 1]) and bare(trg[to + 1])) + 5 * (src[at + 1][0].isupper() and trg[to + 1][0].isupper())
    return score


def test_break_scores_equal_brute_force(spark):
    draw = random.Random(4)
    word = lambda: draw.choice(["a", "Bc", ".", "d", '"', "E"])
    rows = []
    for k in range(20):
        src, trg = [word() for _ in range(draw.randint(2, 12))], [word() for _ in range(draw.randint(2, 12))]
        links = sorted({(draw.randrange(len(src)), draw.randrange(len(trg))) for _ in range(8)})
        rows.append((str(k), src, trg, links, sorted({draw.randrange(1, len(src)) for _ in range(3)})))
    df = spark.createDataFrame(rows, "passage string, src array<string>, trg array<string>, links array<struct<i: int, j: int>>, breaks array<int>")
    got = {(r.passage, r["at"], r.to): r.score for r in G.break_scores(df).collect()}
    assert got == {(p, at, to): brute_breaks(s, t, ls, at, to) for p, s, t, ls, bs in rows for at in bs for to in range(1, len(t))}
    placed = {}
    for r in G.place_breaks(df).collect():
        placed.setdefault(r.passage, []).append((r["at"], r.to))
    for p, s, t, ls, bs in rows:
        own = sorted(placed.get(p, []))
        assert [to for _, to in own] == sorted(to for _, to in own) and {at for at, _ in own} <= set(bs)
        assert own == G.placed_breaks(G.Links(s, t, ls), bs)


def test_placement_keeps_punctuation_on_its_side():
    src, trg = "He came . Then left".split(), "Il vint . Puis partit".split()
    assert G.placed_breaks(G.Links(src, trg, [(i, i) for i in range(5)]), [3]) == [(3, 3)]


def test_normaliser_warnings():
    told = lambda t: sorted((w["code"], w["pos"], w["slice"]) for w in U.normaliser_warnings(t, X.CLINGING))
    assert told("Hi there, . How are you?") == [("consecutive", 8, ", .")]
    assert told("Sam-the one") == [("bordered", 3, "-")] and told("a % b_c") == [("undefined", 2, "%"), ("undefined", 5, "_")]
    assert told("  ) hi") == [("starting", 2, ")")] and told("hi (  ") == [("ending", 3, "(")] and told("she said ' hi") == [("apart", 9, "'")]
    assert told("") == [] and told("plain words, here.") == []


def test_row_matches_equal_brute_force():
    from collections import Counter

    import pyarrow as pa

    from lineweave.operators import mtmetrics as MT

    draw = random.Random(2)
    rows = [([draw.choice("abc") for _ in range(draw.randint(0, 9))], [draw.choice("abc") for _ in range(draw.randint(0, 9))]) for _ in range(60)]
    grams = lambda x, n: Counter(tuple(x[i : i + n]) for i in range(len(x) - n + 1))
    lists = MT.row_matches(pa.array([h for h, _ in rows], pa.list_(pa.string())), pa.array([r for _, r in rows], pa.list_(pa.string())), 4, False)
    texts = MT.row_matches(pa.array(["".join(h) for h, _ in rows]), pa.array(["".join(r) for _, r in rows]), 4, True)
    assert (lists == texts).all()
    for k, (h, r) in enumerate(rows):
        for n in range(1, 5):
            a, b = grams(h, n), grams(r, n)
            assert lists[:, k, n - 1].tolist() == [sum((a & b).values()), sum(a.values()), sum(b.values())]


def test_rouge_l_nist_and_longest_common_subsequence(spark):
    from lineweave.operators import mtmetrics as MT

    def brute(a, b):
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        return best[-1][-1]

    draw = random.Random(3)
    for _ in range(200):
        a, b = ([draw.choice("abcd") for _ in range(draw.randint(0, 12))] for _ in range(2))
        assert U.common_length(a, b) == brute(a, b)
    rows = spark.createDataFrame([(1, "a b c".split(), "a b d".split()), (2, "a".split(), "a".split())], "k int, h array<string>, r array<string>")
    assert MT.overlaps(rows, ["k"]).orderBy("k").first().rouge_l == round(2 / 3, 6)
    assert MT.nist(rows, ["k"]).first().nist == round((2 * 1 + 2 + 0) / 4 + 1 / 2 * 1, 4)


def test_numbered_and_quantiles(spark):
    import numpy as np

    draw = random.Random(5)
    rows = [(draw.choice("aab"), draw.choice([None, 1.0, 2.5, draw.random()]), i) for i in range(500)]
    df = spark.createDataFrame(rows, "p string, v double, i int").repartition(5)
    got = S.numbered(df, ["p"], ["v", "i"]).collect()
    for p in "ab":
        own = sorted(((r.v is not None, r.v or 0.0, r.i), r._r, r._n) for r in got if r.p == p)
        assert [r for _, r, _ in own] == list(range(1, len(own) + 1)) and {n for *_, n in own} == {len(own)}
    for r in S.quantiles(df, ["p"], "v", [0.0, 0.3, 0.9, 1.0]).collect():
        own = [v for p, v, _ in rows if p == r.p and v is not None]
        assert np.allclose(r.cuts, np.quantile(own, [0.0, 0.3, 0.9, 1.0]))
    bins = S.quantile_bins(df.filter("v IS NOT NULL"), "v", 60)
    assert 1 < bins.select("bin").distinct().count() <= 6
    same = spark.createDataFrame([(1.0,)] * 5, "v double")
    assert S.quantile_bins(same, "v", 60).select("bin").distinct().count() == 1 and S.numbered(df.limit(0), ["p"], ["v"]).count() == 0


def test_surface_patterns_of_other_scripts(spark):
    verses = spark.createDataFrame([(1, "мирный день мирной, мир"), (2, "do good and true work")], "ref int, text string")
    terms = spark.createDataFrame([("a", "мир*", [1]), ("b", "do ** work", [2])], "id string, rendering string, refs array<int>")
    assert values(M.surface_forms(terms, verses), "id", "form") == [("a", "мир"), ("a", "мирной"), ("a", "мирный"), ("b", "do good and true work")]


def test_aligners_and_scores(spark):
    assert set(L.ALIGNERS) == {"place", "word", "ibm1", "hmm", "fast_align", "eflomal"}
    with pytest.raises(ValueError, match="no aligner"):
        L.get_aligner("other")
    pairs = spark.createDataFrame([(1, ["a", "b", "a"], ["a", "x", "a"]), (2, ["c"], [])], "k int, s array<string>, t array<string>")
    assert values(L.get_aligner("word")(pairs, ["k"]).select("k", "i", "j"), "i") == [(1, 0, 0), (1, 2, 2)]
    likely = L.get_aligner("ibm1")(pairs, ["k"]).select("k", "j", "src")
    assert likely.count() == 3
    links, empty = L.same_place(pairs, ["k"]), spark.createDataFrame([], "src string, trg string, prob double")
    scores = {r.k: r.score for r in L.corpus_scores(pairs, links, empty, empty, ["k"]).collect()}
    assert scores == {1: 0.0, 2: -1.0}
    none = L.corpus_scores(pairs.filter("k = 2"), links.limit(0), empty, empty, ["k"])
    assert none.first().score == 0.0
    stated = L.sentence_scores(links.withColumn("p", F.lit(0.5)), spark.createDataFrame([], "k int, side string, at int, word string"), empty, empty, ["k"])
    assert stated.first().score == 0.5


def test_functions_in_sql(spark):
    U.register(spark)
    got = spark.sql("SELECT lw_nfc('e\u0301') AS a, lw_glosses('tree (big), oak') AS b, lw_common_subsequence(array('a', 'b'), array('b')) AS c").first()
    assert (got.a, got.b, got.c) == ("\u00e9", ["tree", "oak"], 1)
    assert len(U.SQL_NAMES) == 9


def test_passages_of_unequal_length_are_cut_where_the_verses_end():
    """Each source word has two target words; the windows lie where the target's length puts them."""
    src = [f"w{i}" if i % 10 < 8 else "." if i % 10 == 8 else f"W{i}" for i in range(40)]
    trg = [x for w in src for x in ([w, w] if w != "." else ["x", "."])]
    links = [(i, 2 * i) for i in range(40)]
    known = G.Links(src, trg, links)
    assert known.grid.tolist() == [[brute_breaks(src, trg, links, at, to) for to in range(81)] for at in range(41)]
    cuts = G.splits(known, [10, 20, 30, 40], least=-100)
    assert len(cuts) == 4
    for (at, to), begin, end in zip(cuts, [0, 10, 20, 30], [10, 20, 30, 40]):
        assert begin < at < end and 1.5 * begin <= to <= 2.5 * end
        low = max(int(1.5 * begin), 1 + max((t for a, t in cuts if a < at), default=0))
        want = max(((known.score(a, t), -a, -t) for a in range(begin + 1, end) for t in range(low, min(int(2.5 * end), 79) + 1)))
        assert (want[0], -want[1], -want[2]) == (known.score(at, to), at, to)
    assert all(abs(to - 2 * at) <= 10 for at, to in cuts)


def test_several_references_equal_brute_force(spark):
    from collections import Counter

    from lineweave.operators import mtmetrics as MT

    draw = random.Random(9)
    rows = []
    for k in range(30):
        sent = lambda: [draw.choice("abcd") for _ in range(draw.randrange(0, 9))]
        rows.append((k % 3, sent(), [sent() for _ in range(draw.randrange(1, 4))]))
    rows += [(0, ["a", "a"], [None, ["a"]]), (1, ["a"], [])]
    df = spark.createDataFrame(rows, "g int, h array<string>, r array<array<string>>")
    got = {r.g: r for r in MT.bleu(df, ["g"], many=True).collect()}
    for g in range(3):
        own = [(h, [r for r in refs if r is not None]) for k, h, refs in rows if k == g]
        assert got[g].sys_len == sum(len(h) for h, _ in own)
        assert got[g].ref_len == sum(min(((abs(len(r) - len(h)), len(r)) for r in refs), default=(0, 0))[1] for h, refs in own)
        logs, zeros = 0.0, 0
        for n in range(1, 5):
            grams = lambda w: Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1))  # noqa: E731, B023
            most = [(grams(h), [grams(r) for r in refs]) for h, refs in own]
            hit = sum(min(c, max((r[x] for r in rs), default=0)) for h, rs in most for x, c in h.items())
            of = sum(sum(h.values()) for h, _ in most)
            zeros += hit == 0
            p = hit / of if hit else 1 / (2**zeros * of)
            assert math.isclose(got[g][f"p{n}"], 100 * p, abs_tol=1e-4)
            logs += math.log(p)
        bp = min(1.0, math.exp(1 - got[g].ref_len / got[g].sys_len))
        assert math.isclose(got[g].bleu, 100 * bp * math.exp(logs / 4), abs_tol=1e-3)
    texts = df.select("g", F.monotonically_increasing_id().alias("id"), F.array_join("h", " ").alias("hyp"), F.transform(F.filter("r", lambda x: x.isNotNull()), lambda r: F.array_join(r, " ")).alias("refs"))
    best = {tuple(r)[:2]: r.chrf for r in MT.chrf_many(texts, ["g", "id"], ["g", "id"]).collect()}
    alone = {}
    for r in MT.chrf(texts.select("g", "id", "hyp", F.posexplode("refs").alias("k", "ref")), ["g", "id", "k"]).collect():
        alone[r.g, r.id] = max(alone.get((r.g, r.id), 0.0), r.chrf)
    assert best == alone and len(MT.chrf_many(texts, ["g"], ["g", "id"]).collect()) == 3


def test_meteor_equals_exhaustive_matching(spark):
    import itertools

    from lineweave.functions import meteor as E

    draw = random.Random(12)

    def best(hyp, ref, given):
        """All one-to-one matchings of equal words: the most matches, then the fewest chunks."""
        free_h, free_r = [i for i in range(len(hyp)) if i not in given], [j for j in range(len(ref)) if j not in given.values()]
        out = None
        for picks in itertools.product(*([-1, *(j for j in free_r if ref[j] == hyp[i])] for i in free_h)):
            used = [j for j in picks if j >= 0]
            if len(set(used)) == len(used):
                m = given | {i: j for i, j in zip(free_h, picks) if j >= 0}
                chunks = sum(m.get(i - 1, -2) != j - 1 for i, j in m.items())
                out = min(out or (1, 0), (-len(m), chunks))
        return out

    for _ in range(150):
        hyp, ref = [[draw.choice("abc") for _ in range(draw.randrange(0, 6))] for _ in range(2)]
        for given in ({}, {0: 0} if hyp and ref else {}):
            m = E.matching(hyp, ref, given, beam=10_000)
            assert (-len(m), sum(m.get(i - 1, -2) != j - 1 for i, j in m.items())) == best(hyp, ref, given)
            assert len(E.matching(hyp, ref, given, beam=1)) == len(m)
    same = "the cat sat on the mat".split()
    assert math.isclose(E.meteor_score(same, same, same, same), 1 - 0.5 * (1 / 6) ** 3)
    df = spark.createDataFrame([(same, same), (["x"], ["y"]), ([], []), (["walked"], ["walking"]), (None, ["a"])], "h array<string>, r array<string>")
    got = [r[0] for r in df.select(E.meteor(F.col("h"), F.col("r"), lambda w: F.substring(w, 1, 4))).collect()]
    assert got[1:] == [0.0, 0.0, 0.5, None] and got[0] > 0.99
