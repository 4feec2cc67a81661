import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from lineweave.llm import simhash, similar
from lineweave.llm.components import star_components


def brute_print(text, words):
    tokens = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not tokens:
        return 0
    grams = [b" ".join(tokens[i : i + words]) for i in range(max(1, len(tokens) - words + 1))]
    hashes = [xxhash.xxh64(g, seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps, bits):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(fps):
        for j in range(i):
            if (a ^ fps[j]).bit_count() <= bits:
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return [find(i) for i in range(len(fps))]


@pytest.mark.parametrize("text", ["", " \t\n", "One", "a b c", "A b C d", "a b a b a b a b", "É é x y z w", "w " * 3000])
def test_fingerprint_equals_brute_force(text):
    assert simhash.fingerprint(text.encode(), 4) == [brute_print(text, 4)]


@pytest.mark.parametrize("tile", [8, 16384])
def test_links_equal_brute_force(spark, monkeypatch, tile):
    monkeypatch.setattr(simhash, "TILE", tile)
    monkeypatch.setattr(simhash, "GROUP", 64)
    draw = np.random.default_rng(7)
    base = draw.integers(0, 2**64, 40, np.uint64)
    fps = {0}
    for x in base.tolist():
        for _ in range(12):
            fps.add(x)
            x ^= sum(1 << int(b) for b in set(draw.integers(0, 64, draw.integers(1, 7)).tolist()))
    fps = sorted(fps)
    df = spark.createDataFrame([(simhash.signed(x), simhash.signed(x)) for x in fps], "node long, fp long")
    stars = {r.node: r.root for r in star_components(simhash.near_links(df, 4)).collect()}
    groups = {}
    for x, want in zip(fps, brute_components(fps, 4), strict=True):
        groups.setdefault(want, set()).add(stars.get(simhash.signed(x), simhash.signed(x)))
    assert all(len(g) == 1 for g in groups.values())
    assert len(set.union(*groups.values())) == len(groups)


def test_near_duplicates_edges_of_input(spark):
    text = "the quick brown fox jumps over the lazy dog again and again"
    rows = [(5, text, 1), (3, text.upper(), 2), (9, None, 3), (7, "", 4), (None, " ", 5), (8, "other words entirely here now", 6), (8, "other words entirely here now", 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp int")
    got = sorted((r.doc_id or -1, r.component_id) for r in simhash.near_duplicates(docs, 4, 4).collect())
    assert got == [(-1, 7), (3, 3), (5, 3), (7, 7), (8, 8), (8, 8), (9, 7)]
    assert simhash.near_duplicates(docs.limit(0), 4, 4).count() == 0


def test_long_chain_is_one_component(spark):
    edges = spark.range(24).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    got = star_components(edges).collect()
    assert len(got) == 25 and {r.root for r in got} == {0}
    assert star_components(edges.limit(0)).count() == 0


def test_similar_documents_takes_edited_copies_and_leaves_others(spark):
    draw = np.random.default_rng(3)
    vocabulary = ["".join(map(chr, draw.integers(97, 123, 6))) for _ in range(400)]
    texts = [" ".join(draw.choice(vocabulary, 300)) for _ in range(12)]
    rows = list(enumerate(texts))
    for i in (0, 1, 2):
        tokens = texts[i].split()
        tokens[50], tokens[150] = "edited", "again"
        rows += [(100 + i, " ".join(tokens)), (200 + i, texts[i].upper())]
    got = dict(similar.similar_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == {i: i % 100 for i, _ in rows}


def near_copies(draw):
    """Zipf texts and copies of them: a block appended or replaced, scattered words replaced, and short texts."""
    vocabulary = np.array(["".join(map(chr, draw.integers(97, 123, 5))) for _ in range(3000)])
    chance = 1 / np.arange(1, 3001)
    words = lambda n: draw.choice(vocabulary, n, p=chance / chance.sum()).tolist()
    texts = []
    for n in [3, 6, 12, 40, 40, 40, 100, 100, 100, 100, 300, 300, 300]:
        base = words(n)
        texts.append(base)
        for share in (0.05, 0.1, 0.15, 0.2, 0.22, 0.24, 0.26, 0.3):
            k = max(1, int(n * share))
            texts += [base + words(k), words(k) + base]
            at = int(draw.integers(0, n - k + 1))
            texts.append(base[:at] + words(k // 2 + 1) + base[at + k // 2 + 1 :])
            edited = list(base)
            for at in draw.integers(0, n, max(1, int(n * share / 8))).tolist():
                edited[at] = "edited"
            texts.append(edited)
    return [" ".join(t) for t in texts]


def brute_similar(texts, words=5):
    grams = []
    for text in texts:
        tokens = text.lower().split()
        grams.append({tuple(tokens[i : i + words]) for i in range(max(1, len(tokens) - words + 1))})
    root = list(range(len(texts)))
    for i, a in enumerate(grams):
        for j in range(i):
            if 5 * len(a & grams[j]) >= 4 * len(a | grams[j]):
                x, y = sorted((root[i], root[j]))
                root = [x if r == y else r for r in root]
    return dict(enumerate(root))


@pytest.mark.parametrize("tile", [16, 8192])
def test_similar_documents_equal_brute_force_jaccard(spark, monkeypatch, tile):
    """Copies by blocks, whose single words differ much, link at 0.8 and more, and no pair below does."""
    monkeypatch.setattr(similar, "TILE", tile)
    monkeypatch.setattr(similar, "PAIRS", 50 * tile)
    texts = near_copies(np.random.default_rng(11))
    got = dict(similar.similar_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect())
    assert got == brute_similar(texts)


def test_candidates_hold_all_pairs_of_the_threshold():
    t, none = similar.Fraction("0.8"), np.zeros(0, np.uint64)
    raw = [x.encode() for x in near_copies(np.random.default_rng(5))]
    text, hashes = similar.sets(raw, 5, none, none)
    whole = similar.long_sketches(text, hashes, np.bincount(text))
    own = [hashes[text == i] for i in range(len(raw))]
    n, sketch = np.array([len(x) for x in own]), similar.sketches(text, hashes, len(raw)).view(np.uint64)
    heads = [dict(zip(x[: len(x) + 1 - -(-4 * len(x) // 5)].tolist(), range(len(x)), strict=False)) for x in own]
    true = 0
    for i, a in enumerate(own):
        for j in range(i):
            same = len(np.intersect1d(a, own[j]))
            if 5 * same >= 4 * (n[i] + n[j] - same):
                true += 1
                meet = heads[i].keys() & heads[j].keys()
                at = np.zeros(len(raw), np.int64)
                assert meet
                assert similar.bits_apart(whole[i], whole[j]) <= n[i] + n[j] - 2 * same
                for s in meet:
                    at[i], at[j] = heads[i][s], heads[j][s]
                    assert len(similar.may_link(n, at, sketch, np.array([i]), np.array([j]), t)) == 1
    assert true > 100
