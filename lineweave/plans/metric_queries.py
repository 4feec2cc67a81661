"""Queries over lexicons, alignments and translation metrics."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lineweave.functions import meteor as E
from lineweave.functions import text as X
from lineweave.functions import udfs as U
from lineweave.operators import lexicon as L
from lineweave.operators import mtmetrics as M
from lineweave.operators import splits as S
from lineweave.plans import sqltext as Q
from lineweave.plans.line_queries import pairs

QUERIES, ORACLES = {}, {}
KEY = ["conv_id", "turn"]


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def words(spark, d):
    return pairs(spark, d).select(*KEY, X.tokens(F.lower("src")).alias("s"), X.tokens(F.lower("trg")).alias("t"))


def links(spark, d):
    """Words at the same place stand for aligned words."""
    return L.same_place(words(spark, d), KEY)


_W = f"w AS (SELECT conv_id, turn, {Q.toks('lower(src)')} AS s, {Q.toks('lower(trg)')} AS t FROM ({Q.PAIRS}))"
_L = f"{_W}, l AS (SELECT conv_id, turn, i::INTEGER AS i, i::INTEGER AS j, s[i + 1] AS src, t[i + 1] AS trg FROM (SELECT *, unnest(range(least(len(s), len(t)))) AS i FROM w))"
_B = f"{_L}, b AS (SELECT src, trg, count(*)::BIGINT AS n FROM l GROUP BY ALL)"
_D = f"{_B}, d AS (SELECT src, trg, n::DOUBLE / sum(n) OVER (PARTITION BY src) AS prob FROM b), v AS (SELECT trg AS src, src AS trg, n::DOUBLE / sum(n) OVER (PARTITION BY trg) AS prob FROM b)"


def lexicons(spark, d):
    direct = L.build(links(spark, d))
    return L.normalise(direct), L.normalise(direct.select(F.col("trg").alias("src"), F.col("src").alias("trg"), "n"))


@query(f"WITH {_B} SELECT src, trg, n FROM b")
def lexicon_build(spark, d):
    return L.build(links(spark, d))


@query(f"WITH {_D} SELECT src, trg, round(prob, 6) AS prob FROM d")
def lexicon_normalise(spark, d):
    return lexicons(spark, d)[0].withColumn("prob", F.round("prob", 6))


_S = f"{_D}, m AS (SELECT d.src, d.trg, d.prob * v.prob AS n FROM d JOIN v ON v.src = d.trg AND v.trg = d.src), y AS (SELECT src, trg, n / sum(n) OVER (PARTITION BY src) AS prob FROM m)"


@query(f"WITH {_S} SELECT src, trg, round(prob, 6) AS prob FROM y")
def lexicon_symmetrise(spark, d):
    return L.symmetrise(*lexicons(spark, d)).withColumn("prob", F.round("prob", 6))


@query(f"WITH {_D} SELECT src, trg, place FROM (SELECT src, trg, row_number() OVER (PARTITION BY src ORDER BY prob DESC, trg)::INTEGER AS place FROM d) WHERE place <= 3")
def lexicon_top_targets(spark, d):
    return L.top_targets(lexicons(spark, d)[0], 3).select("src", "trg", "place")


@query(
    f"""WITH {_D}, k AS (SELECT src, trg, prob, dense_rank() OVER (PARTITION BY src ORDER BY prob DESC) AS r FROM d), g AS (SELECT src, r, string_agg(trg, ',' ORDER BY trg) AS s FROM k GROUP BY ALL)
SELECT src, string_agg(s, '|' ORDER BY r) AS ranks FROM g GROUP BY src"""
)
def lexicon_tied_ranks(spark, d):
    ranks = L.ranked_groups(lexicons(spark, d)[0])
    return ranks.select("src", F.array_join(F.transform("ranks", lambda s: F.array_join(s, ",")), "|").alias("ranks"))


@query(
    f"""WITH {_D}, p AS (SELECT conv_id, turn, greatest(coalesce(d.prob, 1e-9), coalesce(v.prob, 1e-9), 1e-9)::DOUBLE AS p FROM l LEFT JOIN d USING (src, trg) LEFT JOIN v ON v.src = l.trg AND v.trg = l.src
UNION ALL SELECT conv_id, turn, 1e-9::DOUBLE FROM (SELECT conv_id, turn, unnest(range(abs(len(s) - len(t)))) FROM w)) SELECT conv_id, turn, round(avg(p), 6) AS score FROM p GROUP BY ALL"""
)
def alignment_sentence_score(spark, d):
    w = words(spark, d)
    tokens = w.select(*KEY, F.lit("src").alias("side"), F.posexplode("s").alias("at", "word")).union(w.select(*KEY, F.lit("trg"), F.posexplode("t")))
    return L.sentence_scores(links(spark, d), tokens, *lexicons(spark, d), KEY)


_CS = f"""{_D}, p AS (SELECT conv_id, turn, greatest(coalesce(d.prob, 1e-9), coalesce(v.prob, 1e-9), 1e-9)::DOUBLE AS p FROM l LEFT JOIN d USING (src, trg) LEFT JOIN v ON v.src = l.trg AND v.trg = l.src
UNION ALL SELECT conv_id, turn, 1e-9::DOUBLE FROM (SELECT conv_id, turn, unnest(range(abs(len(s) - len(t)))) FROM w WHERE len(s) > 0 AND len(t) > 0)),
q AS (SELECT conv_id, turn, round(avg(p), 6) AS score FROM p GROUP BY ALL), sc AS (SELECT conv_id, turn, CASE WHEN len(s) = 0 OR len(t) = 0 THEN -1 ELSE score END AS score FROM w LEFT JOIN q USING (conv_id, turn))"""
_HOLEY = _CS.replace(Q.PAIRS, f"SELECT conv_id, turn, CASE WHEN turn % 6 = 2 THEN '' ELSE src END AS src, trg FROM ({Q.PAIRS})")


def holey(spark, d):
    return words(spark, d).withColumn("s", F.when(F.col("turn") % 6 == 2, F.array().cast("array<string>")).otherwise(F.col("s")))


def scored(spark, d):
    w = holey(spark, d)
    own = L.same_place(w, KEY)
    direct = L.build(own)
    back = L.normalise(direct.select(F.col("trg").alias("src"), F.col("src").alias("trg"), "n"))
    return L.corpus_scores(w, own, L.normalise(direct), back, KEY)


@query(f"WITH {_HOLEY} SELECT conv_id, turn, score FROM sc")
def corpus_alignment_scores(spark, d):
    return scored(spark, d)


@query(f"WITH {_HOLEY} SELECT conv_id, turn, CASE WHEN conv_id % 2 = 0 THEN 0.5 ELSE score END AS score FROM sc")
def cached_scores(spark, d):
    rows = pairs(spark, d).select(*KEY)
    cached = rows.filter("conv_id % 2 = 0").withColumn("score", F.lit(0.5))
    return L.with_scores(rows, cached, scored(spark, d), KEY)


@query(
    f"""WITH {_HOLEY}, r AS (SELECT conv_id % 7 AS project, len(s) > 0 AS s, len(t) > 0 AS t, score FROM w JOIN sc USING (conv_id, turn))
SELECT project, count(*)::BIGINT AS count, count(*) FILTER (s AND NOT t)::BIGINT AS src_only, count(*) FILTER (t AND NOT s)::BIGINT AS trg_only, count(*) FILTER (s AND t)::BIGINT AS parallel,
round(avg(score) FILTER (s AND t), 4) AS align_score, count(*) FILTER (s AND t AND score <= 0.3)::BIGINT AS filtered_count, round(avg(score) FILTER (s AND t AND score > 0.3), 4) AS filtered_align_score FROM r GROUP BY 1"""
)
def pair_coverage(spark, d):
    rows = holey(spark, d).join(scored(spark, d), KEY)
    rows = rows.select((F.col("conv_id") % 7).alias("project"), F.array_join("s", " ").alias("src"), F.array_join("t", " ").alias("trg"), "score")
    return L.pair_coverage(rows, ["project"], 0.3)


@query(
    f"""WITH {_L}, g AS (SELECT conv_id, turn, i, j, length(src) % 2 = 0 AS sure FROM l WHERE (length(src) + length(trg)) % 3 <> 0 UNION ALL SELECT conv_id, turn, i, j + 1, true FROM l WHERE length(src) > 8),
t AS (SELECT conv_id, turn, i, j, max(sure::INT) AS sure FROM g GROUP BY ALL), b AS (SELECT conv_id, l.i IS NOT NULL AS mine, t.sure FROM l FULL JOIN t USING (conv_id, turn, i, j)),
c AS (SELECT conv_id, count(*) FILTER (mine) AS a, coalesce(sum(sure), 0) AS s, count(*) FILTER (mine AND sure IS NOT NULL) AS pa, count(*) FILTER (mine AND sure = 1) AS sa FROM b GROUP BY 1),
m AS (SELECT *, CASE WHEN a = 0 THEN 1 ELSE pa::DOUBLE / a END AS p, CASE WHEN s = 0 THEN 1 ELSE sa::DOUBLE / s END AS r FROM c)
SELECT conv_id, round(CASE WHEN s + a = 0 THEN 0 ELSE 1 - (pa + sa)::DOUBLE / (s + a) END, 6) AS aer, round(p, 6) AS precision, round(r, 6) AS recall,
 round(CASE WHEN p = 0 OR r = 0 THEN NULL ELSE 1 / (0.5::DOUBLE / p + 0.5::DOUBLE / r) END, 6) AS f FROM m"""
)
def alignment_aer_prf(spark, d):
    own = links(spark, d)
    gold = own.filter((F.char_length("src") + F.char_length("trg")) % 3 != 0).select(*KEY, "i", "j", (F.char_length("src") % 2 == 0).alias("sure"))
    gold = gold.union(own.filter(F.char_length("src") > 8).select(*KEY, "i", F.col("j") + 1, F.lit(True)))
    return L.alignment_metrics(own, gold, KEY, ["conv_id"])


@query(f"WITH {_L} SELECT conv_id, turn, i, j FROM l WHERE (length(src) % 2 = 0) OR (length(trg) % 2 = 0)")
def link_majority_vote(spark, d):
    own = links(spark, d)
    runs = own.select(F.lit(1).alias("run"), *KEY, "i", "j").union(own.filter(F.char_length("src") % 2 == 0).select(F.lit(2), *KEY, "i", "j"))
    runs = runs.union(own.filter(F.char_length("trg") % 2 == 0).select(F.lit(3), *KEY, "i", "j"))
    return L.majority_links(runs, KEY, 3)


_X = f"{_L}, x AS (SELECT conv_id, turn, i, ((i * 7) % count(*) OVER (PARTITION BY conv_id, turn))::INTEGER AS j FROM l)"


@query(f"WITH {_X} SELECT a.conv_id, a.turn, a.i, a.j, count(*) FILTER ((a.i - b.i) * (a.j - b.j) < 0)::BIGINT AS crossings FROM x a JOIN x b USING (conv_id, turn) GROUP BY ALL")
def crossing_counts(spark, d):
    return L.crossing_counts(scattered(spark, d), KEY)


@query(f"WITH {_X}, k AS (SELECT DISTINCT conv_id, turn, unnest([2, 5]) AS at, unnest([3, 4]) AS \"to\" FROM w) SELECT k.conv_id, k.turn, k.at, k.to, count(*) FILTER ((x.i < k.at) <> (x.j < k.to))::BIGINT AS crossed FROM k LEFT JOIN x USING (conv_id, turn) GROUP BY ALL")
def break_crossings(spark, d):
    places = F.explode(F.array(*(F.struct(F.lit(a).alias("at"), F.lit(b).alias("to")) for a, b in ((2, 3), (5, 4)))))
    breaks = words(spark, d).select(*KEY, places.alias("b")).select(*KEY, "b.*")
    return L.crossing_breaks(scattered(spark, d), breaks, KEY)


@query(f"WITH {_X} SELECT conv_id, turn, i, j FROM (SELECT l.conv_id, l.turn, l.i, l.j, count(*) FILTER ((x.i < l.i) <> (x.j < l.j)) AS c FROM l LEFT JOIN x USING (conv_id, turn) GROUP BY ALL) WHERE c < 4")
def links_without_crossing(spark, d):
    return L.without_crossing(links(spark, d), scattered(spark, d), KEY, 4)


def scattered(spark, d):
    own = links(spark, d)
    sizes = own.groupBy(*KEY).agg(F.count("*").alias("n"))
    return own.join(sizes, KEY).select(*KEY, "i", ((F.col("i") * 7) % F.col("n")).cast("int").alias("j"))


@query(f"WITH {_X} SELECT conv_id, turn, i, j FROM l JOIN x USING (conv_id, turn, i, j)")
def links_intersection(spark, d):
    return L.symmetric_links(links(spark, d), scattered(spark, d), KEY)


@query()
def links_grow_diag_final(spark, d):
    own = links(spark, d)
    forward = own.groupBy(*KEY).agg(F.collect_list(F.struct("i", "j")).alias("f"), F.collect_list(F.struct("i", (F.col("j") + F.char_length("src") % 2).alias("j"))).alias("b"))
    grown = forward.select(*KEY, F.explode(U.grow_diag("f", "b")).alias("x"))
    return grown.select(*KEY, "x.i", "x.j")


def halves(spark, d):
    """A system lexicon from part of the conversations, a gold one from the others, told apart by hash."""
    half = S.seeded_order("half", F.col("conv_id")) < "8"
    own = links(spark, d)
    return L.normalise(L.build(own.filter(half))), L.normalise(L.build(own.filter(~half)))


_HALF = "md5('half:' || conv_id) < '8'"
_HALVES = f"""{_L}, sys AS (SELECT src, trg, n::DOUBLE / sum(n) OVER (PARTITION BY src) AS prob FROM (SELECT src, trg, count(*) AS n FROM l WHERE {_HALF} GROUP BY ALL)),
gold AS (SELECT src, trg, n::DOUBLE / sum(n) OVER (PARTITION BY src) AS prob FROM (SELECT src, trg, count(*) AS n FROM l WHERE NOT {_HALF} GROUP BY ALL)),
top AS (SELECT src, trg, row_number() OVER (PARTITION BY src ORDER BY prob DESC, trg) AS place FROM sys), gtop AS (SELECT src, trg, row_number() OVER (PARTITION BY src ORDER BY prob DESC, trg) AS place FROM gold)"""


@query(
    f"""WITH {_HALVES}, h AS (SELECT count(g.src) AS hits, count(*) AS shown FROM top t LEFT JOIN gold g USING (src, trg) WHERE place <= 3),
wt AS (SELECT sum(least(n, 3)) AS wanted FROM (SELECT count(*) AS n FROM gold GROUP BY src)), m AS (SELECT hits::DOUBLE / shown AS precision, hits::DOUBLE / wanted AS recall FROM h, wt)
SELECT precision, recall, 2 * precision * recall / (precision + recall) AS f FROM m"""
)
def lexicon_p_r_f_at_k(spark, d):
    return L.precision_recall_at_k(*halves(spark, d), 3)


@query(
    f"""WITH {_HALVES}, m AS (SELECT t.src, place, (g.src IS NOT NULL)::INT AS hit FROM top t LEFT JOIN gold g USING (src, trg)),
p AS (SELECT src, CASE WHEN hit = 1 THEN sum(hit) OVER (PARTITION BY src ORDER BY place)::DOUBLE / place ELSE 0 END AS p FROM m)
SELECT round(avg(ap), 6) AS map FROM (SELECT src, sum(p) / count(*) AS ap FROM p GROUP BY src)"""
)
def lexicon_map(spark, d):
    return L.mean_average_precision(*halves(spark, d))


@query(
    f"""WITH {_HALVES}, a AS (SELECT src, list(trg ORDER BY place) AS s FROM top WHERE place <= 5 GROUP BY 1), b AS (SELECT src, list(trg ORDER BY place) AS t FROM gtop WHERE place <= 5 GROUP BY 1),
o AS (SELECT src, list_sum(list_transform(range(1, 6), lambda d: 2.0::DOUBLE * len(list_intersect(s[1:d], t[1:d])) / (len(s[1:d]) + len(t[1:d])))) / 5 AS ao FROM a JOIN b USING (src))
SELECT round(avg(ao), 6) AS average_overlap FROM o"""
)
def average_overlap(spark, d):
    return L.average_overlap(*halves(spark, d), 5)


@query()
def rank_biased_overlap(spark, d):
    system, gold = (L.ranked_groups(x) for x in halves(spark, d))
    both = system.join(gold.withColumnRenamed("ranks", "gold"), "src")
    return both.select("src", F.round(U.rbo("ranks", "gold"), 6).alias("rbo"))


def _em() -> str:
    steps = [f"WITH {_W}, c AS (SELECT conv_id, turn, src, trg, n, m FROM (SELECT conv_id, turn, src, count(*) AS n FROM (SELECT conv_id, turn, unnest(list_append(s, 'NULL')) AS src FROM w) GROUP BY ALL) JOIN (SELECT conv_id, turn, trg, count(*) AS m FROM (SELECT conv_id, turn, unnest(t) AS trg FROM w) GROUP BY ALL) USING (conv_id, turn)), t0 AS (SELECT src, trg, 1.0::DOUBLE / (SELECT count(DISTINCT trg) FROM c) AS prob FROM (SELECT DISTINCT src, trg FROM c))"]
    for k in range(3):
        steps.append(
            f"z{k} AS (SELECT *, n * prob AS u, sum(n * prob) OVER (PARTITION BY conv_id, turn, trg) AS z FROM c JOIN t{k} USING (src, trg)), n{k} AS (SELECT src, trg, sum(m * u / z) AS n FROM z{k} GROUP BY ALL), t{k + 1} AS (SELECT src, trg, n / sum(n) OVER (PARTITION BY src) AS prob FROM n{k})"
        )
    # the logarithm of a ratio never lies midway between two roundings
    return ", ".join(steps) + " SELECT src, trg, round(ln(prob), 6) AS log_prob FROM t3"


@query(_em())
def ibm1_em_3iter(spark, d):
    w = words(spark, d).select(*KEY, F.col("s").alias("src"), F.col("t").alias("trg"))
    return L.ibm1(w, KEY, 3).select("src", "trg", F.round(F.ln("prob"), 6).alias("log_prob"))


def drafts(spark, d):
    """The reply is the reference; a draft lacks a fifth of its words."""
    tokens = pairs(spark, d).select(*KEY, X.tokenize_13a("trg").alias("r"))
    return tokens.withColumn("h", S.drop_tokens(F.col("r"), 0.2, "draft", F.col("conv_id"), F.col("turn")))


def _13a(c: str) -> str:
    out = f"(' ' || lower(replace({c}, chr(10), ' ')) || ' ')"
    for a, b in ((r"([\{-\~\[-\` -\&\(-\+\:-\@\/])", r" \1 "), (r"([^0-9])([\.,])", r"\1 \2 "), (r"([\.,])([^0-9])", r" \1 \2"), (r"([0-9])(-)", r"\1 \2 ")):
        out = f"regexp_replace({out}, '{a}', '{b}', 'g')"
    return Q.toks(out)


_T = f"r AS (SELECT conv_id, turn, {_13a('trg')} AS r FROM ({Q.PAIRS})), t AS (SELECT conv_id, turn, (turn // 2 % 3)::INTEGER AS draft, r, list_filter(r, lambda x, i: {Q.uniform(chr(39) + 'draft' + chr(39), 'conv_id', 'turn', '(i - 1)')} >= 0.2) AS h FROM r)"


def _grams(h: str, r: str, orders: int, sep: str, key: str = "conv_id, turn", rel: str = "t") -> str:
    of = lambda c, out: f"SELECT {key}, n, array_to_string({c}[i:i + n - 1], '{sep}') AS g, count(*) AS {out} FROM (SELECT {key}, {c}, n, unnest(range(1, len({c}) - n + 2)) AS i FROM {rel}, range(1, {orders + 1}) o(n)) GROUP BY ALL"
    return f"SELECT {key}, n, sum(least(coalesce(a, 0), coalesce(b, 0))) AS hit, sum(coalesce(a, 0)) AS hyp, sum(coalesce(b, 0)) AS ref FROM ({of(h, 'a')}) FULL JOIN ({of(r, 'b')}) USING ({key}, n, g) GROUP BY ALL"


def _bleu(by: str, effective: bool = False, rel: str = _T) -> str:
    key = "conv_id, turn, draft" if by == "draft" else "conv_id, turn"
    group = f"GROUP BY {by}" if by else ""
    lead = f"{by}, " if by else ""
    hits = ", ".join(f"coalesce(sum(hit) FILTER (n = {n}), 0)::DOUBLE AS h{n}, coalesce(sum(hyp) FILTER (n = {n}), 0)::DOUBLE AS t{n}" for n in range(1, 5))
    zeros = lambda n: " + ".join(f"(t{k} > 0 AND h{k} = 0)::INT" for k in range(1, n + 1))
    ps = ", ".join(f"CASE WHEN t{n} = 0 THEN 0.0 WHEN h{n} = 0 THEN 100.0::DOUBLE / (pow(2.0, {zeros(n)}) * t{n}) ELSE h{n} * 100.0::DOUBLE / t{n} END AS q{n}" for n in range(1, 5))
    used = " + ".join(f"(t{n} > 0)::INT" for n in range(1, 5))
    logs = " + ".join(f"CASE WHEN t{n} > 0 THEN ln(q{n}) ELSE 0 END" for n in range(1, 5))
    join = f"LEFT JOIN g USING ({by})" if by else "CROSS JOIN g"
    return f"""WITH {rel}, m AS ({_grams('h', 'r', 4, ' ', key)}), g AS (SELECT {lead}{hits} FROM m {group}), s AS (SELECT {lead}sum(len(h))::BIGINT AS sys_len, sum(len(r))::BIGINT AS ref_len FROM t {group}),
j AS (SELECT {lead}sys_len, ref_len, {", ".join(f"coalesce({x}{n}, 0) AS {x}{n}" for n in range(1, 5) for x in "ht")} FROM s {join}),
q AS (SELECT *, {ps}, {used} AS used, CASE WHEN sys_len = 0 THEN 0 WHEN sys_len >= ref_len THEN 1 ELSE exp(1 - ref_len::DOUBLE / sys_len) END AS bp0 FROM j)
SELECT {lead}round(CASE WHEN h1 > 0 AND used {'> 0' if effective else '= 4'} THEN bp0 * exp(({logs}) / {'used' if effective else '4'}) ELSE 0 END, 4) AS bleu, {", ".join(f"round(q{n}, 4) AS p{n}" for n in range(1, 5))}, round(bp0, 6) AS bp, sys_len, ref_len FROM q"""


@query(_bleu(""))
def bleu_corpus(spark, d):
    return M.bleu(drafts(spark, d), [])


@query(_bleu("conv_id"))
def bleu_by_book(spark, d):
    return M.bleu(drafts(spark, d), ["conv_id"])


@query(_bleu("conv_id, turn", True))
def bleu_sentence(spark, d):
    return M.bleu(drafts(spark, d), KEY, effective=True)


@query(f"SELECT round(avg(bleu), 3) AS m_bleu FROM ({_bleu('conv_id, turn', True)})")
def bleu_mean(spark, d):
    return bleu_sentence(spark, d).agg(F.round(F.avg("bleu"), 3).alias("m_bleu"))


def two_references(spark, d):
    """drafts with two references, the reply and one that lacks other words, and what a report goes by."""
    second = S.drop_tokens(F.col("r"), 0.3, "second", F.col("conv_id"), F.col("turn"))
    meta = [(F.col("turn") % 4 * 500).alias("step"), F.concat(F.lit("en-"), F.col("conv_id") % 3).alias("pair"), (F.col("conv_id") % 5).alias("book"), (F.floor(F.col("turn") / 2) % 3).cast("int").alias("draft")]
    return drafts(spark, d).select(*KEY, "h", F.array("r", second).alias("r"), *meta)


def _bleu_sets(sets: list[list[str]]) -> str:
    """BLEU against two references over grouping sets of step, pair, book and draft."""
    of = lambda rel, c, out: f"SELECT conv_id, turn, n, array_to_string({c}[i:i + n - 1], ' ') AS g, count(*) AS {out} FROM (SELECT conv_id, turn, {c}, n, unnest(range(1, len({c}) - n + 2)) AS i FROM {rel}, range(1, 5) o(n)) GROUP BY ALL"
    refs = f"SELECT conv_id, turn, n, g, max(b) AS b FROM ({of('u', 'r', 'b')} UNION ALL {of('u', 'r2', 'b')}) GROUP BY ALL"
    hits = ", ".join(f"coalesce(sum(least(a, coalesce(b, 0))) FILTER (n = {n}), 0)::DOUBLE AS h{n}, coalesce(sum(a) FILTER (n = {n}), 0)::DOUBLE AS t{n}" for n in range(1, 5))
    zeros = lambda n: " + ".join(f"(t{k} > 0 AND h{k} = 0)::INT" for k in range(1, n + 1))
    ps = ", ".join(f"CASE WHEN t{n} = 0 THEN 0.0 WHEN h{n} = 0 THEN 100.0::DOUBLE / (pow(2.0, {zeros(n)}) * t{n}) ELSE h{n} * 100.0::DOUBLE / t{n} END AS q{n}" for n in range(1, 5))
    cols = ["step", "pair", "book", "draft"]
    sums = ", ".join(f"coalesce(sum({x}{n}), 0) AS {x}{n}" for n in range(1, 5) for x in "ht")
    grain = " ".join(f"WHEN {sum(1 << k for k, c in enumerate(reversed(cols)) if c not in s)} THEN '{'+'.join(s) or 'all'}'" for s in sets)
    return f"""WITH {_T}, u AS (SELECT conv_id, turn, h, r, list_filter(r, lambda x, i: {Q.uniform("'second'", 'conv_id', 'turn', '(i - 1)')} >= 0.3) AS r2,
 turn % 4 * 500 AS step, 'en-' || conv_id % 3 AS pair, conv_id % 5 AS book, draft FROM t),
w AS (SELECT conv_id, turn, {hits} FROM ({of('u', 'h', 'a')}) LEFT JOIN ({refs}) USING (conv_id, turn, n, g) GROUP BY ALL),
z AS (SELECT step, pair, book, draft, grouping(step, pair, book, draft) AS g, sum(len(h))::BIGINT AS sys_len, sum(CASE WHEN (abs(len(r2) - len(h)), len(r2)) < (abs(len(r) - len(h)), len(r)) THEN len(r2) ELSE len(r) END)::BIGINT AS ref_len, {sums}
 FROM u LEFT JOIN w USING (conv_id, turn) GROUP BY GROUPING SETS ({", ".join("(" + ", ".join(s) + ")" for s in sets)})),
q AS (SELECT *, {ps}, CASE WHEN sys_len = 0 THEN 0 WHEN sys_len >= ref_len THEN 1 ELSE exp(1 - ref_len::DOUBLE / sys_len) END AS bp0 FROM z)
SELECT CASE g {grain} END AS grain, step, pair, book, draft, round(CASE WHEN h1 > 0 AND t1 > 0 AND t2 > 0 AND t3 > 0 AND t4 > 0 THEN bp0 * exp((ln(q1) + ln(q2) + ln(q3) + ln(q4)) / 4) ELSE 0 END, 4) AS bleu,
 {", ".join(f"round(q{n}, 4) AS p{n}" for n in range(1, 5))}, round(bp0, 6) AS bp, sys_len, ref_len FROM q"""


_SETS = [["step", "pair", "book", "draft"], ["step", "pair", "book"], ["step", "pair"], ["step"], ["book", "draft"], []]


@query(_bleu_sets(_SETS))
def bleu_report(spark, d):
    """Two references, all grains of a report in one pass."""
    return M.bleu_report(two_references(spark, d), ["step", "pair", "book", "draft"], _SETS, many=True)


@query(f"SELECT book, bleu, bp, sys_len, ref_len FROM ({_bleu_sets([_SETS[0], ['book']])}) WHERE grain = 'book'")
def bleu_two_references(spark, d):
    return M.bleu(two_references(spark, d), ["book"], many=True).select("book", "bleu", "bp", "sys_len", "ref_len")


@query()
def chrf_two_references(spark, d):
    rows = two_references(spark, d).select(*KEY, "book", F.array_join("h", " ").alias("hyp"), F.transform("r", lambda r: F.array_join(r, " ")).alias("refs"))
    return M.chrf_many(rows, ["book"], ["book", *KEY])


def texts(spark, d):
    return drafts(spark, d).select(*KEY, F.array_join("h", " ").alias("hyp"), F.array_join("r", " ").alias("ref"))


_CHARS = "c AS (SELECT conv_id, turn, list_filter(string_split(array_to_string(h, ''), ''), lambda x: x <> '') AS h, list_filter(string_split(array_to_string(r, ''), ''), lambda x: x <> '') AS r FROM t)"


@query(
    f"""WITH {_T}, {_CHARS}, m AS ({_grams('h', 'r', 6, '', rel='c')}), s AS (SELECT conv_id, n, sum(hit)::DOUBLE AS hit, sum(hyp) AS hyp, sum(ref) AS ref FROM m GROUP BY ALL),
a AS (SELECT conv_id, avg(hit / hyp) AS p, avg(hit / ref) AS r FROM s WHERE hyp > 0 AND ref > 0 GROUP BY 1) SELECT conv_id, round(100 * CASE WHEN 9 * p + r = 0 THEN 0 ELSE 10 * p * r / (9 * p + r) END, 4) AS chrf FROM a"""
)
def chrf3(spark, d):
    return M.chrf(texts(spark, d), ["conv_id"])


_APART = lambda c: Q.toks(f"regexp_replace(array_to_string({c}, ' '), '({Q.PUNCT})', ' \\1 ', 'g')")


def _chrf_words(k: int) -> str:
    return f"""WITH {_T}, {_CHARS}, p AS (SELECT conv_id, turn, {_APART('h')} AS h, {_APART('r')} AS r FROM t),
m AS ({_grams('h', 'r', 6, '', rel='c')} UNION ALL SELECT conv_id, turn, n + 6, hit, hyp, ref FROM ({_grams('h', 'r', k, ' ', rel='p')})),
s AS (SELECT conv_id, n, sum(hit)::DOUBLE AS hit, sum(hyp) AS hyp, sum(ref) AS ref FROM m GROUP BY ALL), k AS (SELECT conv_id, CASE WHEN hyp > 0 THEN hit / hyp ELSE 0 END AS p, CASE WHEN ref > 0 THEN hit / ref ELSE 0 END AS r FROM s)
SELECT conv_id, round(100 * sum(CASE WHEN 9 * p + r = 0 THEN 0 ELSE 10 * p * r / (9 * p + r) END) / {6 + k}, 4) AS chrf FROM k GROUP BY conv_id"""


@query(_chrf_words(1))
def chrf3p(spark, d):
    return M.chrf(texts(spark, d), ["conv_id"], word_order=1)


@query(_chrf_words(2))
def chrf3pp(spark, d):
    return M.chrf(texts(spark, d), ["conv_id"], word_order=2)


@query(f"SELECT draft, * EXCLUDE draft FROM ({_bleu('draft')}) UNION ALL SELECT NULL::INTEGER AS draft, * FROM ({_bleu('')})")
def bleu_by_draft(spark, d):
    """Each draft, and a row of all of them."""
    return M.bleu_by_draft(drafts(spark, d).withColumn("draft", F.expr("cast(turn div 2 % 3 AS int)")), "draft")


@query(_bleu("", rel=f"t AS (SELECT conv_id, turn, {_13a('src')} AS h, {_13a('trg')} AS r FROM ({Q.PAIRS}) WHERE {Q.strip('src')} <> '' AND {Q.strip('trg')} <> '')"))
def compare_translations(spark, d):
    """Two projects aligned by their keys, rows without a side left out."""
    rows = pairs(spark, d).filter((X.strip("src") != "") & (X.strip("trg") != ""))
    return M.bleu(rows.select(X.tokenize_13a("src").alias("h"), X.tokenize_13a("trg").alias("r")), [])


@query(
    f"""WITH {_T}, m AS ({_grams('h', 'r', 4, ' ')}), s AS (SELECT conv_id, turn, sum(hit) AS hit, sum(hyp) AS hyp, sum(ref) AS ref, {", ".join(f"coalesce(sum({c}) FILTER (n = {n}), 0) AS {c}{n}" for c in ("hit", "hyp", "ref") for n in (1, 2))} FROM m GROUP BY ALL),
e AS (SELECT conv_id, coalesce(hit::DOUBLE / greatest(hyp, ref), 0) AS gleu, {", ".join(f"coalesce(2.0::DOUBLE * hit{n} / nullif(hyp{n} + ref{n}, 0), 0) AS rouge{n}" for n in (1, 2))},
 coalesce(len(list_intersect(h, r))::DOUBLE / nullif(len(list_distinct(h)), 0), 0) AS set_precision, coalesce(len(list_intersect(h, r))::DOUBLE / nullif(len(list_distinct(r)), 0), 0) AS set_recall FROM t LEFT JOIN s USING (conv_id, turn))
SELECT conv_id, {", ".join(f"round(avg(coalesce({c}, 0)), 6) AS {c}" for c in ("gleu", "rouge1", "rouge2", "set_precision", "set_recall"))} FROM e GROUP BY 1"""
)
def overlap_scores(spark, d):
    return M.overlaps(drafts(spark, d), ["conv_id"]).drop("rouge_l")


@query()
def rouge_l(spark, d):
    return M.overlaps(drafts(spark, d), ["conv_id"]).select("conv_id", "rouge_l")


_NG = lambda c, out: f"SELECT conv_id, turn, n, g, count(*) AS {out} FROM (SELECT conv_id, turn, n, {c}[i:i + n - 1] AS g FROM (SELECT conv_id, turn, {c}, n, unnest(range(1, len({c}) - n + 2)) AS i FROM t, range(1, 6) o(n))) GROUP BY ALL"


@query(
    f"""WITH {_T}, a AS ({_NG('h', 'a')}), b AS ({_NG('r', 'b')}), z AS (SELECT sum(len(h)) AS hl, sum(len(r)) AS rl FROM t), seen AS (SELECT n, g, sum(b) AS seen FROM b GROUP BY ALL),
w AS (SELECT s.n, s.g, log2(coalesce(p.seen, (SELECT rl FROM z))::DOUBLE / s.seen) AS w FROM seen s LEFT JOIN seen p ON p.n = s.n - 1 AND p.g = s.g[1:s.n - 1]),
h AS (SELECT n, g, sum(least(a, b)) AS hit FROM a JOIN b USING (conv_id, turn, n, g) GROUP BY ALL), g AS (SELECT n, sum(hit * w) AS gain FROM h JOIN w USING (n, g) GROUP BY 1),
s AS (SELECT sum(coalesce(gain / shown, 0)) AS score FROM (SELECT n, sum(a)::DOUBLE AS shown FROM a GROUP BY 1) LEFT JOIN g USING (n))
SELECT round(score * exp(ln(0.5::DOUBLE) / pow(ln(1.5::DOUBLE), 2) * pow(ln(least(hl::DOUBLE / rl, 1.0)), 2)), 4) AS nist FROM s, z"""
)
def nist(spark, d):
    return M.nist(drafts(spark, d), KEY)


@query(
    f"""WITH {_L}, sw AS (SELECT conv_id, turn, i, j, a.w AS src, a.w AS trg FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, turn, w ORDER BY i) AS k FROM (SELECT conv_id, turn, (generate_subscripts(s, 1) - 1)::INTEGER AS i, unnest(s) AS w FROM w)) a
JOIN (SELECT *, row_number() OVER (PARTITION BY conv_id, turn, w ORDER BY j) AS k FROM (SELECT conv_id, turn, (generate_subscripts(t, 1) - 1)::INTEGER AS j, unnest(t) AS w FROM w)) b USING (conv_id, turn, w, k)),
y AS (SELECT 'place' AS model, * FROM l UNION ALL SELECT 'word', conv_id, turn, i, j, src, trg FROM sw), gl AS (SELECT conv_id, turn, i, j, (length(src) % 2 = 0)::INT AS sure, src, trg FROM l WHERE (length(src) + length(trg)) % 3 <> 0),
bk AS (SELECT model, b.* FROM (SELECT DISTINCT model FROM y), (SELECT conv_id, turn, conv_id::VARCHAR AS book FROM w UNION ALL SELECT conv_id, turn, 'ALL' FROM w) b),
f AS (SELECT bk.model, bk.book, y.i IS NOT NULL AS mine, sure FROM (SELECT model, conv_id, turn, i, j FROM y UNION SELECT m.model, conv_id, turn, i, j FROM gl, (SELECT DISTINCT model FROM y) m) k JOIN bk USING (model, conv_id, turn) LEFT JOIN y USING (model, conv_id, turn, i, j) LEFT JOIN gl USING (conv_id, turn, i, j)),
c AS (SELECT model, book, count(*) FILTER (mine) AS a, coalesce(sum(sure), 0) AS s, count(*) FILTER (mine AND sure IS NOT NULL) AS pa, count(*) FILTER (mine AND sure = 1) AS sa FROM f GROUP BY ALL),
m AS (SELECT *, CASE WHEN a = 0 THEN 1 ELSE pa::DOUBLE / a END AS p, CASE WHEN s = 0 THEN 1 ELSE sa::DOUBLE / s END AS r FROM c),
lx AS (SELECT model, src, trg, n::DOUBLE / sum(n) OVER (PARTITION BY model, src) AS prob FROM (SELECT model, src, trg, count(*) AS n FROM y GROUP BY ALL)), top AS (SELECT model, src, trg, row_number() OVER (PARTITION BY model, src ORDER BY prob DESC, trg) AS place FROM lx),
gd AS (SELECT DISTINCT src, trg FROM gl), hs AS (SELECT model, count(gd.src) AS hits, count(*) AS shown FROM top LEFT JOIN gd USING (src, trg) WHERE place <= 3 GROUP BY 1), wt AS (SELECT sum(least(n, 3)) AS wanted FROM (SELECT src, count(*) AS n FROM gd GROUP BY 1)),
lm AS (SELECT model, 'ALL' AS book, hits::DOUBLE / shown AS pk, hits::DOUBLE / wanted AS rk FROM hs, wt)
SELECT m.book, m.model, round(CASE WHEN s + a = 0 THEN 0 ELSE 1 - (pa + sa)::DOUBLE / (s + a) END, 6) AS aer, round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN p = 0 OR r = 0 THEN NULL ELSE 1 / (0.5::DOUBLE / p + 0.5::DOUBLE / r) END, 6) AS f,
 round(pk, 6) AS precision_at_3, round(rk, 6) AS recall_at_3, round(CASE WHEN pk + rk = 0 THEN NULL ELSE 2 * pk * rk / (pk + rk) END, 6) AS f_at_3 FROM m LEFT JOIN lm USING (model, book)"""
)
def alignment_experiment(spark, d):
    """Two aligners against one gold standard, by conversation and altogether."""
    w = words(spark, d)
    own = links(spark, d).filter((F.char_length("src") + F.char_length("trg")) % 3 != 0)
    gold = own.select(*KEY, "i", "j", (F.char_length("src") % 2 == 0).alias("sure"))
    found = L.experiment(["place", "word"], w, gold, own.select("src", "trg"), KEY, "conv_id")
    return found.withColumns({c: F.round(c, 6) for c in ("precision_at_3", "recall_at_3", "f_at_3")})


def shifted(spark, d):
    """drafts with some of their words moved, dealt to all cores: a row is long in work and short in bytes, so Spark's sizes of partitions
    would leave all rows to a few tasks."""
    rows = drafts(spark, d).select(*KEY, S.permute_tokens(F.col("h"), 2, "shift", F.col("conv_id"), F.col("turn")).alias("h"), "r")
    return rows.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism), *KEY)


@query()
def ter(spark, d):
    """TER per conversation: edits with shifts over reference words; whole replies, one row each."""
    moved = shifted(spark, d)
    edits = moved.select("conv_id", U.ter_edit_count("h", "r").alias("e"), F.size("r").alias("n"))
    return edits.groupBy("conv_id").agg(F.round(100.0 * F.sum("e") / F.sum("n"), 4).alias("ter"))


@query()
def token_edit_distance(spark, d):
    rows = drafts(spark, d)
    return rows.select(*KEY, U.token_edits("h", "r").alias("edits"), F.round(U.jaro("h", "r"), 6).alias("jaro"))


@query()
def word_diff(spark, d):
    each = texts(spark, d).select(*KEY, F.posexplode(U.diff("ref", "hyp")).alias("step", "change"))
    return each.filter(~F.col("change").startswith("equal"))


@query(f"SELECT conv_id, turn, md5(array_to_string(regexp_extract_all(nfc_normalize(lower(src)), '[\\p{{L}}\\p{{M}}\\p{{N}}'']+|[^\\s\\p{{L}}\\p{{M}}\\p{{N}}]'), ' ')) AS tokens_md5 FROM ({Q.PAIRS})")
def corpus_tokenise(spark, d):
    return pairs(spark, d).select(*KEY, F.md5(F.array_join(X.words_and_marks(U.nfc("src")), " ").cast("binary")).alias("tokens_md5"))


@query()
def meteor(spark, d):
    """METEOR of each draft against its reply, and its mean by conversation."""
    scored = shifted(spark, d).select("conv_id", "turn", E.meteor(F.col("h"), F.col("r")).alias("m"))
    mean = F.avg("m").over(Window.partitionBy("conv_id"))  # a conversation's replies are few, and no text goes with them
    return scored.select("conv_id", "turn", F.round("m", 6).alias("meteor"), F.round(mean, 6).alias("conv_meteor"))
