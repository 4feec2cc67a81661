"""Edges of every operator: nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import hashlib
import itertools
import math
import os
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lineweave.llm import chat, line_dedup, packing, quality, sampling, tokens, topk, url_rules
from lineweave.llm import tokens as tokens_


# line dedup
def brute_lines(rows, least=20, docs=3):
    key = lambda s: "".join(c.lower() if "A" <= c <= "Z" else c for c in s.strip(" \t\n\x0b\x0c\r"))
    held = {}
    for i, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= least:
                held.setdefault(key(line), set()).add(-(2**63) if i is None else i)
    out = []
    for i, t in rows:
        own = -(2**63) if i is None else i
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (len(held.get(key(x), ())) >= docs and own != max(held[key(x)]))]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


LONG = "This line is long enough to count É"


def line_rows():
    rows = [(1, f"{LONG}\nshort\n  {LONG.upper().replace('É', 'É')}  "), (2, f"a\n{LONG}\n"), (3, f"{LONG}"), (None, LONG), (5, None), (6, ""), (7, "\n\n"), (8, "x\r\n" + LONG + "\t"), (8, "x\r\n" + LONG + "\t")]
    draw = random.Random(4)
    pool = [f"shared line number {i} of the small pool" for i in range(8)]
    return rows + [(100 + i, "\n".join(draw.choice([*pool, f"own line of document {i} here", "tiny"]) for _ in range(12))) for i in range(40)]


@pytest.mark.parametrize("least", [1, 5, 256])
def test_line_dedup_equals_brute_force(spark, monkeypatch, least):
    """With every key hot, with some, and with none."""
    monkeypatch.setattr(line_dedup, "LEAST_HOT", least)
    docs = spark.createDataFrame([(i, t, "a", 1) for i, t in line_rows()], "doc_id long, text string, runs string, d int")
    got = line_dedup.line_dedup(docs)
    assert got.columns == ["doc_id", "text", "runs", "d", "__n_lines", "__n_dropped"]
    told = sorted(map(repr, ((r.doc_id, r["__n_lines"], r["__n_dropped"], r.text) for r in got.collect())))
    assert told == sorted(map(repr, brute_lines(line_rows())))
    assert line_dedup.line_dedup(docs.limit(0)).count() == 0


def test_hot_keys(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "LEAST_HOT", 5)
    docs = spark.createDataFrame([(i, LONG + ("\n" + LONG if i == 3 else "")) for i in range(4)] + [(i, "a line of only four documents") for i in range(5, 9)], "doc_id long, text string")
    lines = line_dedup.line_rows(docs, "doc_id", "text", 20)
    got = line_dedup.hot_keys(lines).collect()
    assert [(r.hot_docs, r.hot_last) for r in got] == [(4, 3)]
    monkeypatch.setattr(line_dedup, "LEAST_HOT", 6)
    assert line_dedup.hot_keys(lines) is None


def test_line_columns_that_clash_are_replaced(spark):
    docs = spark.createDataFrame([(1, LONG, "x", 7, [1])], "doc_id long, text string, __t string, __n_lines int, __runs array<int>")
    got = line_dedup.line_dedup(docs)
    assert got.columns == ["doc_id", "text", "__n_lines", "__n_dropped"] and got.first()["__n_lines"] == 1


def test_keep_bitmap_runs(spark):
    docs = spark.createDataFrame([(i, "\n".join(["own %d" % i, LONG, LONG, "mid", LONG])) for i in range(3)], "doc_id long, text string")
    got = {r.d: (r.runs, r.n_dropped) for r in line_dedup.keep_bitmaps(docs).collect()}
    assert got == {0: ([1, 2, 1, 1], 3), 1: ([1, 2, 1, 1], 3)}


# quality
def test_quality_learns_and_holds_out(spark):
    draw = random.Random(1)
    word = lambda: "".join(draw.choice("abcdefgh") for _ in range(5))
    good = [(i, " ".join(word() for _ in range(60)), 1) for i in range(120)]
    bad = [(i + 500, " ".join(word() + "!!" for _ in range(60)), 0) for i in range(120)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in good + bad] + [(900, None), (901, ""), (None, "a b")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in good + bad] + [(None, 1), (77, None)], "doc_id long, quality int")
    weights = quality.quality_model(docs, labels)
    scored = {r.doc_id: r["__score"] for r in quality.score(docs, weights).collect()}
    assert all(scored[i] > 0.5 for i, _, y in good if i % 3) and all(scored[i] < 0.5 for i, *_ in bad)
    assert scored[900] == scored[901] and 0 <= scored[900] <= 1
    again = quality.quality_model(docs.repartition(3), labels.repartition(2))
    assert np.array_equal(weights, again)
    assert quality.score(docs.limit(0), weights).count() == 0
    assert set(np.unique(quality.quality_model(docs, labels.limit(0)))) == {0.0}


def test_quality_equals_plain_training(spark):
    """The whole path against features and FTRL-proximal updates written with dicts, a feature at a time."""
    draw = random.Random(8)
    texts = {i: " ".join(draw.choice(["ab", "Cd", "e!!", "9", "f-g"]) for _ in range(draw.randint(0, 12))) for i in range(30)}
    given = {i: i % 2 for i in range(0, 30, 2)} | {5: 1, 7: 0, 9: 1}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    weights = quality.fit(docs, spark.createDataFrame(list(given.items()), "doc_id long, quality int"))

    def plain(text):
        tokens = [tokens_.hashed([t.encode()], True)[0][0] for t in __import__("re").findall(r"[A-Za-z0-9]+|[^A-Za-z0-9\s]+", text)]
        pairs = [tokens_.mixed(np.array([a * np.uint64(3) + b], np.uint64))[0] for a, b in zip(tokens, tokens[1:], strict=False)]
        counts = Counter(int(x >> np.uint64(64 - quality.BUCKET_BITS)) for x in [*tokens, *pairs])
        norm = sum(v * v for v in counts.values()) ** 0.5
        return {k: float(np.float32(v / norm)) for k, v in counts.items()} | {"bias": 1.0}

    with np.errstate(over="ignore"):
        rows = {i: plain(t) for i, t in texts.items()}
    z, n = Counter(), Counter()

    def weight(k):
        if abs(z[k]) <= quality.L1:
            return 0.0
        return ((1 if z[k] > 0 else -1) * quality.L1 - z[k]) / ((quality.BETA + n[k] ** 0.5) / quality.ALPHA + quality.L2)

    order = sorted(given, key=lambda i: int(tokens_.mixed(np.array([i], np.uint64))[0]))
    for _ in range(quality.EPOCHS):
        for i in order:
            w = {k: weight(k) for k in rows[i]}
            p = 1 / (1 + np.exp(-sum(w[k] * x for k, x in rows[i].items())))
            for k, x in rows[i].items():
                g = (p - given[i]) * x
                z[k] += g - ((n[k] + g * g) ** 0.5 - n[k] ** 0.5) / quality.ALPHA * w[k]
                n[k] += g * g
    got = {r.doc_id: r["__score"] for r in quality.score(docs, weights).collect()}
    for i, row in rows.items():
        assert abs(got[i] - 1 / (1 + np.exp(-sum(weight(k) * x for k, x in row.items())))) < 1e-4


def test_quality_bounds_and_clashing_columns(spark):
    docs = spark.createDataFrame([(i, f"word{i} " * (i + 1), "x") for i in range(20)] + [(3, None, "y"), (50, "long " * 200_000, "z")], "doc_id long, text string, __score string")
    labels = spark.createDataFrame([(i, i % 2) for i in [*range(20), 50]], "doc_id long, quality int")
    few, all_ = quality.fit(docs, labels, max_features=4), quality.fit(docs, labels)
    assert 0 < np.count_nonzero(few) < np.count_nonzero(all_)
    got = quality.score(docs, all_)
    assert got.columns == ["doc_id", "text", "__score"] and got.count() == 22 and all(0 <= r["__score"] <= 1 for r in got.collect())


def test_span_hashes_do_not_depend_on_place(monkeypatch):
    texts = [b"alpha beta", b"", b"beta  alpha\n" * 30, "é ü".encode(), b"x" * 5000]
    whole, at = tokens.hashed(texts, False)
    monkeypatch.setattr(tokens, "CHUNK", 7)
    parts, at2 = tokens.hashed(texts, False)
    assert np.array_equal(whole, parts) and np.array_equal(at, at2)
    assert whole[0] == whole[at[2] + 1] and len(set(whole[:2])) == 2 and at[1] == at[2]
    assert len({tokens.hashed([w.encode()], False)[0][0] for w in itertools.islice(map("".join, itertools.product("abc", repeat=5)), 243)}) == 243


# url rules
URLS = [None, "", "no scheme", "http://", "http://net/", "http://net", "https://A.Example.NET/en/x?q", "http://example.net/enx", "http://xexample.com/de/", "http://a.example.com/de/x#y", "http://x.org/fr/", "http://x.org/FR/", "a://b://c.net/x", "http://free-bets.a.org/", "http://my.spam-farm.b.com/en/", "http://nofree-bets.org/", "http://x.net:80/a", "http://é.net/"]


def brute_url(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host, rest = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut]), rest[cut:]
        path = rest[: min([rest.find(c) for c in "?#" if c in rest] or [len(rest)])]
    best = None
    for verdict, h, p in (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")):
        if (host == h or host.endswith("." + h)) and path.startswith(p) and (best is None or len(h + p) > len(best[0])):
            best = (h + p, verdict)
    if best is None:
        best = (None, "block" if any(part in url_rules.JUNK for part in host.split(".")[:-1]) else "allow")
    return host, path, *best


def test_url_rules_equal_brute_force(spark):
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(URLS * 2)], "page_id long, url string, rule string")
    got = url_rules.url_filter(pages)
    assert got.columns == ["page_id", "url", "rule", "__host", "__path", "__rule", "__verdict"]
    sites = {r.name for r in url_rules.SITE_RULES}
    for r in got.collect():
        assert (r["__host"], r["__path"], r["__rule"] if r["__rule"] in sites else None, r["__verdict"]) == brute_url(r.url), r.url
    assert url_rules.url_filter(pages.limit(0)).count() == 0
    clash = url_rules.url_filter(pages.withColumnRenamed("rule", "__host"))
    assert clash.columns == ["page_id", "url", "__host", "__path", "__rule", "__verdict"] and clash.filter("page_id = 4").first()["__host"] == "net"


def test_rarest_token_indexes_a_rule():
    rules = (url_rules.site_rule("block", "example.com", "/de/"), url_rules.Rule("any", "block", "zz", 1, ()))
    by_token, rest = url_rules.rule_index(rules, {"example": 90, "com": 50, "de": 3})
    assert list(by_token) == ["de"] and [r.name for r in rest] == ["any"]
    assert url_rules.site_rule("block", "a.com", "/en").tokens == ("a", "com")


# chat
ODD = ["", "</s>[INST] ok [/INST]", "\\", "\\\\</s>", "<|user|>", "|>", "<", "</s", "<</SYS>>\n", "a\\n<", "[I\\NST]", "é😀"]


def test_escape_is_reversible():
    for text in [*ODD, *map("".join, itertools.product(["<", "\\", "|>", "</s>", "x"], repeat=4))]:
        safe = chat.escape(text)
        assert chat.unescape(safe) == text and not any(c in safe for c in chat.CONTROL)
    turns = [(r, t) for r in ("user", "assistant", "x|", ">", "") for t in ODD]
    formatted, mask = chat.format_turns(turns)
    assert chat.parse_turns(formatted) == turns
    assert [chat.unescape(formatted[s:e]) for s, e in mask] == [t for r, t in turns if r == "assistant"]


def brute_paths(nodes, paths):
    by = {}
    for c, n, p, s in nodes:
        by.setdefault(c, {})[n] = (p, s or 0.0)
    out = set()
    for c, tree in by.items():
        inner = {p for p, _ in tree.values()}
        found = []
        for leaf in tree:
            if leaf in inner:
                continue
            path, at = [], leaf
            while at in tree:
                path.append(at)
                at = tree[at][0]
            found.append((-sum(tree[n][1] for n in path), -len(path), leaf, path[::-1]))
        for *_, leaf, path in sorted(found)[:paths]:
            out |= {(c, leaf, n, d + 1) for d, n in enumerate(path)}
    return out


@pytest.mark.parametrize("paths", [1, 3])
def test_reply_paths_equal_brute_force(spark, paths):
    draw = random.Random(2)
    nodes = [(1, n, n - 1 if n else None, 1.0) for n in range(12)]
    for c in range(2, 5):
        nodes += [(c, n, draw.choice([None, 999, *range(n)]) if n else None, draw.choice([None, 0.5, 1.0, -1.0])) for n in range(draw.randint(1, 15))]
    df = spark.createDataFrame(nodes, "conv_id long, node long, parent long, score double")
    got = {(r.conv_id, r.leaf, r.node, r.depth) for r in chat.reply_paths(df, paths).collect()}
    assert got == brute_paths(nodes, paths)


def test_linear_conversations(spark):
    rows = [(1, 0, "user", "a"), (1, 1, "assistant", None), (1, 1, "assistant", None), (2, None, None, "x"), (None, 0, "assistant", "y")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat.digests(chat.format_conversations(chat.linear_tree(df))).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert got[1].n_turns == 3 and got[1].turns_sha256 == sha("user\na\nassistant\n\nassistant\n\n") and got[1].loss_chars == 0
    assert got[2].turns_sha256 == sha("\nx\n") and got[None].loss_sha256 == sha("y")
    assert chat.format_conversations(chat.linear_tree(df.limit(0))).count() == 0


def test_circles_have_no_path_and_hold_nothing_up(spark):
    rows = [(1, 1, 2, 0.0), (1, 2, 1, 0.0), (1, 3, 2, 0.0), (1, 4, None, 0.0), (1, 5, 4, 0.0), (2, 1, 1, 0.0)] + [(3, n, n - 1, 0.0) for n in range(1, 40)]
    df = spark.createDataFrame(rows, "conv_id long, node long, parent long, score double")
    got = sorted(tuple(r) for r in chat.reply_paths(df, 2).collect())
    assert got == [(1, 5, 4, 1), (1, 5, 5, 2)] + [(3, 39, n, n) for n in range(1, 40)]


def test_messages_without_conversation_stay_apart(spark):
    rows = [(None, i, "user", f"t{i}") for i in range(200)] + [(1, 0, "user", "a"), (1, 0, "user", "a")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = chat.digests(chat.format_conversations(chat.linear_tree(df))).collect()
    assert Counter((r.conv_id, r.n_turns) for r in got) == {(None, 1): 200, (1, 2): 1}
    assert len({r.turns_sha256 for r in got}) == 201


# packing
def test_best_bounds_equal_brute_force():
    draw = random.Random(1)

    def padding(bars, bounds):
        return sum(min(b for b in bounds if b >= top) * c - s for top, c, s in bars)

    for _ in range(200):
        tops = sorted(draw.sample(range(50), draw.randint(1, 8)))
        bars = [(x, c := draw.randint(1, 9), x * c) for x in tops]
        k = draw.randint(1, 5)
        best = min(padding(bars, [*inner, tops[-1]]) for n in range(min(k, len(bars))) for inner in itertools.combinations(tops[:-1], n))
        got = packing.best_bounds(bars, k)
        assert len(got) <= k and padding(bars, got) == best
    assert packing.best_bounds([], 3) == []


def test_pack_has_the_least_padding_of_all_bounds(spark):
    """The whole operator, over lengths far beyond a thousand, against quadratic dynamic programming."""
    draw = random.Random(6)
    lengths = [int(draw.lognormvariate(6, 1.5)) for _ in range(400)] + [0, 0, 70_000]
    df = spark.createDataFrame([(i, n) for i, n in enumerate(lengths)], "doc_id long, n long")
    got = packing.pack(df, F.col("n"), buckets=6).collect()
    tops = sorted(set(lengths))
    count = Counter(lengths)
    below = list(itertools.accumulate((count[t] for t in tops), initial=0))
    best = [0] + [float("inf")] * len(tops)
    for _ in range(6):
        best = [0] + [min([best[j], *(best[i] + tops[j - 1] * (below[j] - below[i]) for i in range(j))]) for j in range(1, len(tops) + 1)]
    assert sum(r.bucket_len for r in got) == best[-1] and {r.n_tokens for r in got} == set(lengths)


def test_pack_fills_batches_within_budget(spark, monkeypatch):
    monkeypatch.setattr(packing, "SHARD_BATCHES", 2)
    lengths = [0, 1, 1, 2, 5000, 9, 9, 9, 40, 41, 1500] * 7
    rows = [(i, " ".join(["w"] * n) if n else None, "c") for i, n in enumerate(lengths)] + [(3, " ".join(["w"] * 2), "c"), (None, "", "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, bucket string")
    got = packing.pack(docs, packing.word_count(F.col("text")), buckets=4, budget=100).collect()
    assert len(got) == len(rows)
    groups = {}
    for r in got:
        assert r.n_tokens <= r.bucket_len
        groups.setdefault(r.batch_id, []).append(r)
    for g in groups.values():
        assert sorted(r.slot for r in g) == list(range(len(g))) and len({r.bucket for r in g}) == 1
        assert len(g) == 1 or len(g) * g[0].bucket_len <= 100
    assert packing.pack(docs.limit(0), F.lit(1)).count() == 0


# top-k
def brute_topk(vectors, k):
    fit = lambda x: max(-(2**63), min(2**63 - 1, x))
    whole = lambda x: fit(math.floor(x * 64)) if math.isfinite(x * 64) else fit(int(math.copysign(2**70, x)))
    usable = [(i, list(map(whole, v))) for i, v in vectors if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    dot = lambda a, b: int(sum(x * y for x, y in zip(a, b)))  # noqa: E731, B905
    out = set()
    for a, (q, x) in enumerate(usable):
        if q % 20 == 0:
            best = sorted((-dot(x, y), i) for b, (i, y) in enumerate(usable) if b != a)[:k]
            out |= {(q, r + 1, i, fit(-s)) for r, (s, i) in enumerate(best)}
    return out


@pytest.mark.parametrize("block", [7, 1 << 15])
def test_topk_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(topk, "BLOCK", block)
    monkeypatch.setattr(topk, "QUERIES", 3)
    draw = np.random.default_rng(3)
    rows = [(i, draw.normal(size=6).round(2).tolist()) for i in range(-40, 60)]
    rows += [(i, rows[0][1]) for i in range(200, 230)] + [(300, None), (320, [1.0, None]), (340, [float("nan")]), (360, [float("inf")]), (380, []), (400, [2.0, -1.0]), (None, [1.0]), (420, [0.0] * 6)]
    rows += [(500, [1e30, 1.0]), (520, [-1e30, 1e15]), (540, [1e308] * 6), (560, [-1e308] * 6), (580, [1e17, -1e17, 3.0]), (501, [1e18]), (502, [-1e18, 5.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = topk.top_k(df.union(df.filter("vec_id = 20")), 5)
    assert {tuple(r) for r in got.collect()} == brute_topk(rows + [r for r in rows if r[0] == 20], 5)
    assert topk.top_k(df.limit(0)).count() == 0 and topk.top_k(df.filter("vec_id = 20")).count() == 0


# sampling
def jaccard(a, b):
    a, b = Counter(a.encode().lower().split()), Counter(b.encode().lower().split())
    keys = a.keys() | b.keys()
    return sum(min(a[k], b[k]) for k in keys) / max(1, sum(max(a[k], b[k]) for k in keys))


def test_collision_rate_is_the_jaccard_similarity():
    draw = random.Random(5)
    words = [f"w{i}" for i in range(60)]
    errors = []
    for _ in range(60):
        a = " ".join(draw.choices(words, k=80))
        b = " ".join(a.split()[: draw.randint(0, 80)] + draw.choices(words, k=draw.randint(0, 60)))
        x, y = sampling.signatures([a.encode(), b.encode()])
        errors.append(sampling.likeness(x, y) - jaccard(a, b))
    assert abs(np.mean(errors)) < 0.02 and np.max(np.abs(errors)) < 0.2


def test_fingerprint_does_not_depend_on_company():
    texts = [f"some words of text {i} and more words".encode() for i in range(50)]
    alone = np.concatenate([sampling.signatures([t]) for t in texts])
    assert np.array_equal(alone, sampling.signatures(texts))
    assert not sampling.signatures([b"", b" \n"]).any() and sampling.signatures([]).shape == (0, sampling.SAMPLES)


def test_fingerprint_does_not_depend_on_how_work_is_cut(monkeypatch):
    texts = [f"{'word ' * (i % 5)} some words of text {i} and more words".encode() for i in range(60)] + [b""]
    whole = sampling.signatures(texts)
    for name, value in (("GROUP", 7), ("CHUNK", 3), ("DRAWS", 1)):
        monkeypatch.setattr(sampling, name, value)
    assert np.array_equal(whole, sampling.signatures(texts))


def plain_ioffe(text):
    """A sample at a time, a term at a time."""
    counts = Counter(text.lower().encode().split())
    out = []
    for k in range(sampling.SAMPLES):
        best = None
        for word, weight in counts.items():
            term = tokens_.hashed([word], False)[0]
            r, c, b = (x[0, 0] for x in sampling.draws(term, k, 1))
            t = np.floor(np.log(np.float32(weight)) / r + b)
            key = c - r * (t - b) - r
            if best is None or key < best[0]:
                best = key, int(term[0]), int(t)
        mark = 0
        if best:
            mark = max(1, int(tokens_.mixed(np.array([(best[1] + best[2] * 0xA0761D6478BD642F) % 2**64], np.uint64))[0]) >> 48)
        out.append(mark)
    return out


def test_signatures_equal_a_plain_loop():
    draw = random.Random(9)
    texts = [" ".join(draw.choices(["a", "Bb", "cé", "d", "e"], k=n)) for n in (0, 1, 2, 5, 9, 30)]
    assert sampling.signatures([t.encode() for t in texts]).tolist() == [plain_ioffe(t) for t in texts]


def brute_next(rows):
    """(id, n_chars, edited sha, own, edited and next text) of each row."""
    by = {}
    for i, t in rows:
        by.setdefault(sampling.NO_ID if i is None else i, []).append(t or "")
    ids, out = sorted(by), []
    for k, i in enumerate(ids):
        heads = by[ids[(k + 1) % len(ids)]]
        assert len(set(heads)) == 1 or len(ids) == 1, "brute force knows no hash"
        for own in by[i]:
            half = len(own) // 2
            new = own[: len(own) - half] + heads[0][:half]
            out.append((None if i == sampling.NO_ID else i, len(own), hashlib.sha256(new.encode()).hexdigest(), own, new, heads[0]))
    return out


@pytest.mark.parametrize("partitions", [1, 4, 9])
def test_compare_with_next(spark, partitions):
    rows = [(5, "the last one here"), (1, "first text é😀"), (2, None), (3, "third words"), (None, "no id"), (3, "third words")]
    rows += [(40 + i, f"text {i} of some words") for i in range(30)] + [(50, "text 10 of some words")] * 40
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, part int").repartition(3)
    was = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        got = sampling.compare_with_next(df).collect()
        lone = sampling.compare_with_next(df.filter("doc_id = 1")).collect()
        same = sampling.compare_with_next(df.filter("doc_id = 50")).collect()
        assert sampling.compare_with_next(df.limit(0)).count() == 0
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)
    want = []
    for i, n, sha, *texts in brute_next(rows):
        a, b, c = sampling.signatures([t.encode() for t in texts])
        want.append((i, n, sha, sampling.printed(a), sampling.printed(b), float(sampling.likeness(a, b)), float(sampling.likeness(a, c))))
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    assert len(lone) == 1 and lone[0].near_next == 1.0 and len(same) == 41 and {r.near_next for r in same} == {1.0}


def test_many_rows_without_id(spark):
    """A third of all rows share one id: each gets its row, and none of them are held together."""
    rows = spark.range(100_000).select(F.when(F.col("id") % 3 == 0, None).otherwise(F.col("id")).alias("doc_id"), F.concat(F.lit("text "), F.col("id") % 7).alias("text"))
    was = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", 16)
    try:
        got = sampling.compare_with_next(rows)
        assert got.count() == 100_000 and got.filter("doc_id IS NULL").count() == 33_334
        parts = sampling.beside_next(rows, "doc_id", "text").filter("lead = 1").groupBy("part").count().collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)
    assert max(r["count"] for r in parts) < 16_000 and len(parts) > 12


# pipeline
@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no tables here")
def test_pipeline_stages(spark):
    import corpus_pipeline as P

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").cache()
    ids = lambda df: Counter(r.doc_id for r in df.select("doc_id").collect())
    good = P.quality(spark, docs, sf)
    assert good.columns == docs.columns and not ids(good) - ids(docs)
    cut = P.lines(spark, docs, sf)
    want = {i: t for i, _, _, t in brute_lines([(r.doc_id, r.text) for r in docs.collect()])}
    assert {r.doc_id: r.text for r in cut.collect()} == want and cut.columns == docs.columns
    alone = P.near_duplicates(spark, docs, sf)
    texts = [r.text for r in alone.collect()]
    assert len(texts) == len(set(texts)) and alone.columns == docs.columns
    safe = P.secrets(spark, docs, sf)
    assert ids(safe) == ids(docs) and safe.filter(F.col("text").rlike("[0-9a-f]{16}")).count() == 0
    assert ids(P.packing(spark, docs, sf)) == ids(docs)
    assert P.run(spark, sf).count() > 0


# rows that share an id, and columns with the names of the operators' own
def test_topk_rows_of_one_id(spark):
    rows = [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (1, [0.5, 2.0]), (2, [1.0, 1.0]), (3, None)]
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), k=2, query_every=1).collect())
    ints = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if v]
    want = []
    for a, (q, x) in enumerate(ints):
        others = sorted((-sum(p * r for p, r in zip(x, y)), i) for b, (i, y) in enumerate(ints) if b != a)
        want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(others[:2])]
    assert got == sorted(want)


def test_quality_learns_from_an_id_once(spark):
    docs = [(1, "good words here")] * 400 + [(1, "good words")] + [(2, "bad words here")]
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")
    once = quality.fit(spark.createDataFrame(list(dict.fromkeys(docs)), "doc_id long, text string"), labels)
    assert np.array_equal(quality.fit(spark.createDataFrame(docs, "doc_id long, text string"), labels), once)


def test_last_hash_equals_a_running_sum(spark):
    from lineweave.llm import secrets

    draw = random.Random(8)
    for most in (1 << 62, 1 << 20, 40):
        lines = sorted({draw.randrange(most): draw.randrange(1, 9) for _ in range(60)}.items())
        df = spark.createDataFrame(lines, "h long, n int")
        for limit in (0, 5, 100, 10_000):
            fits = [h for k, (h, _) in enumerate(lines) if sum(n for _, n in lines[: k + 1]) <= limit] or [lines[0][0]]
            last = secrets.last_hash(df, limit)
            assert [h for h, _ in lines if h <= last] == [h for h, _ in lines if h <= fits[-1]]
    assert secrets.last_hash(df.limit(0), 5) == -1


def test_pipeline_stages_keep_clashing_columns(spark):
    import corpus_pipeline as pipe

    names = ["__d", "__t", "__runs", "__mask", "__n_lines", "__n_dropped", "__id", "__n", "__rows", "__node", "__score", "__spans"]
    docs = spark.createDataFrame([(1, "A text of some words, long enough.\n" * 2), (2, "Another one"), (2, "Another one")], "doc_id long, text string")
    docs = docs.withColumns({c: F.lit(f"own {c}") for c in names})
    for stage in (pipe.lines, pipe.near_duplicates, pipe.secrets):
        out = stage(spark, docs, "")
        assert out.columns == docs.columns
        assert {tuple(r[c] for c in names) for r in out.collect()} == {tuple(f"own {c}" for c in names)}
    assert pipe.near_duplicates(spark, docs, "").count() == 2
