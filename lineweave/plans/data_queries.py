"""Queries over data set building, planning, segmentation and the operators' remaining families (A03, A18, A22, C02-C21, F19-F24,
J06-J09, M02-M09, Q05, T04, T08, V02-V06, W08, X01-X10)."""

from __future__ import annotations

from pyspark.sql import functions as F

from lineweave.functions import text as X
from lineweave.functions import udfs as U
from lineweave.operators import corpus as C
from lineweave.operators import datasets as D
from lineweave.operators import filters as R
from lineweave.operators import misc as M
from lineweave.operators import segmentation as G
from lineweave.operators import sentences as N
from lineweave.operators import splits as S
from lineweave.operators import stats as T
from lineweave.operators import terms as E
from lineweave.operators import vocabulary as V
from lineweave.plans import sqltext as Q
from lineweave.plans.line_queries import lines, pairs
from lineweave.plans.metric_queries import KEY, _L, links, words
from lineweave.plans.stat_queries import _COUNTS
from lineweave.sources.tables import load

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# texts and terms
@query()
def normaliser_warnings(spark, d):
    found = lines(spark, d).select("doc_id", "line_no", F.explode(U.warnings_of(X.CLINGING)("line")).alias("w"))
    return found.select("doc_id", "line_no", "w.*")


@query("SELECT p_partkey, p_name || '|' || p_brand AS glosses FROM part")
def gloss_cleaning(spark, d):
    """A cell of two glosses with brackets, nested and not, numbering and question marks around them."""
    cell = F.concat(F.lit(" "), "p_name", F.lit(" (as (in) "), "p_type", F.lit(")? ; "), "p_brand", F.lit(" [x], "), "p_name", F.lit(" 1.2"))
    return load(spark, d, "part").select("p_partkey", F.array_join(U.glosses(cell), "|").alias("glosses"))


@query("SELECT item_id, md5(text) AS text_md5 FROM benchmark")
def language_code_strip(spark, d):
    coded = F.concat("text", F.when(F.col("item_id") % 2 == 0, " </s> eng_Latn").otherwise("</s>fra_Latn"))
    return load(spark, d, "benchmark").select("item_id", F.md5(X.strip_language_code(coded).cast("binary")).alias("text_md5"))


@query(f"SELECT conv_id, turn, len(list_filter(t, lambda x: regexp_matches(x, '\\p{{L}}')))::INTEGER AS letters, len(list_filter(t, lambda x: regexp_matches(x, '^\\p{{Lu}}')))::INTEGER AS capitals FROM (SELECT conv_id, turn, {Q.toks('src')} AS t FROM ({Q.PAIRS}))")
def letter_tests(spark, d):
    rows = pairs(spark, d).select(*KEY, X.tokens("src").alias("t"))
    return rows.select(*KEY, F.size(F.filter("t", X.contains_letter)).alias("letters"), F.size(F.filter("t", X.starts_with_capital)).alias("capitals"))


@query("SELECT n_nationkey, string_agg('U+' || lpad(upper(to_hex(unicode(c))), 4, '0'), ' ' ORDER BY i) AS points FROM (SELECT n_nationkey, unnest(string_split(n_name, '')) AS c, generate_subscripts(string_split(n_name, ''), 1) AS i FROM nation) GROUP BY 1")
def unicode_details(spark, d):
    """The names are checked against the character database by the tests."""
    points = F.array_join(F.regexp_extract_all(U.details("n_name"), F.lit(r"(U\+[0-9A-F]+)"), F.lit(1)), " ")
    return load(spark, d, "nation").select("n_nationkey", points.alias("points"))


@query("SELECT DISTINCT p_partkey AS id, unnest([p_name, upper(left(p_name, 1)) || regexp_extract(p_name, '^.([^ ]*)', 1) || ' ' || upper(substr(split_part(p_name, ' ', 2), 1, 1)) || substr(split_part(p_name, ' ', 2), 2)]) AS src, unnest([lower(p_type), upper(left(p_type, 1)) || lower(substr(p_type, 2))]) AS trg FROM part")
def dictionary_variants(spark, d):
    return E.dictionary_rows(load(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("src"), F.lower("p_type").alias("trg")))


@query("SELECT p_partkey, p_name FROM part WHERE NOT list_has_any(string_split(p_name, ' '), ['red', 'bolt'])")
def common_term_filter(spark, d):
    return R.drop_common_terms(load(spark, d, "part").select("p_partkey", "p_name"), "p_name", ["red", "bolt"], " ")


# joins, sets and aggregates
@query("WITH n AS (SELECT s_nationkey AS a, c_nationkey AS b, count(*)::BIGINT AS n FROM supplier JOIN customer ON s_suppkey = c_custkey WHERE s_nationkey < c_nationkey GROUP BY ALL), p AS (SELECT DISTINCT s_nationkey AS a, c_nationkey AS b FROM supplier JOIN customer ON s_suppkey = c_custkey) SELECT p.a, p.b, coalesce(x.n, y.n) AS n FROM p LEFT JOIN n x ON x.a = p.a AND x.b = p.b LEFT JOIN n y ON y.a = p.b AND y.b = p.a")
def lookup_either_way(spark, d):
    both = load(spark, d, "supplier").join(load(spark, d, "customer"), F.col("s_suppkey") == F.col("c_custkey")).select(F.col("s_nationkey").alias("a"), F.col("c_nationkey").alias("b"))
    return M.lookup_pairs(both.distinct(), both.filter("a < b").groupBy("a", "b").agg(F.count("*").alias("n")), "a", "b", "n")


@query("SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def frame_join(spark, d):
    return load(spark, d, "nation").join(load(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_name", "r_name")


@query("SELECT a.n_name AS src, b.r_name AS trg FROM nation a, region b")
def file_pairs(spark, d):
    return C.expand_pairs(load(spark, d, "nation").select(F.col("n_name").alias("src")), load(spark, d, "region").select(F.col("r_name").alias("trg")), True)


@query(f"SELECT lang, t AS testament, count(*)::BIGINT AS books, sum(verses)::BIGINT AS verses FROM (SELECT *, CASE WHEN right(source, 1) < '5' THEN 'OT' ELSE 'NT' END AS t FROM ({_COUNTS})) GROUP BY GROUPING SETS ((lang, t), (lang))")
def verse_totals(spark, d):
    counts = V.verse_counts(lines(spark, d), "lang", "source", "line")
    return V.verse_totals(counts, "lang", F.when(F.right("source", F.lit(1)) < "5", "OT").otherwise("NT"))


@query("SELECT l_returnflag, avg(l_linenumber) FILTER (l_linestatus = 'F') AS F, avg(l_linenumber) FILTER (l_linestatus = 'O') AS O FROM lineitem GROUP BY 1")
def metric_pivot(spark, d):
    return T.metric_table(load(spark, d, "lineitem"), "l_returnflag", "l_linestatus", "l_linenumber", ["F", "O"])


@query("SELECT event_type, count(DISTINCT user_id)::BIGINT AS users, true AS near FROM events GROUP BY 1")
def approximate_users(spark, d):
    """A sketch's count (5 % deviation wanted) beside the exact one: within 15 % of it."""
    counts = load(spark, d, "events").groupBy("event_type").agg(F.count_distinct("user_id").alias("users"), F.approx_count_distinct("user_id", 0.05).alias("about"))
    return counts.select("event_type", "users", (F.abs(F.col("about") - F.col("users")) <= F.col("users") * 0.15).alias("near"))


@query("SELECT user_id, (epoch_us(max(ts)) - epoch_us(min(ts)))::BIGINT AS micros FROM events GROUP BY 1")
def session_durations(spark, d):
    spans = M.durations(load(spark, d, "events"), ["user_id"], "ts", "ts")
    return spans.select("user_id", (F.unix_micros(F.lit("2000-01-01").cast("timestamp") + F.col("duration")) - F.unix_micros(F.lit("2000-01-01").cast("timestamp"))).alias("micros"))


_BINS = """v AS (SELECT list(value ORDER BY value) AS v, least(12, CASE WHEN count(*) < 1000 THEN 10 ELSE 20 END, count(DISTINCT value)) AS q FROM events), h AS (SELECT v, (len(v) - 1) * i::DOUBLE / q AS h FROM v, range(1, q) t(i)),
e AS (SELECT list(DISTINCT v[floor(h)::BIGINT + 1] + (v[ceil(h)::BIGINT + 1] - v[floor(h)::BIGINT + 1]) * (h - floor(h))) AS e FROM h), b AS (SELECT event_id, len(list_filter(e, lambda x: x < value))::INTEGER AS bin FROM events, e)"""


@query(
    f"""WITH {_BINS}, c AS (SELECT bin, count(*) * 120.0::DOUBLE / (SELECT count(*) FROM b) AS want FROM b GROUP BY 1),
f AS (SELECT bin, floor(want)::BIGINT AS base, row_number() OVER (ORDER BY want - floor(want) DESC, bin) AS place, 120 - sum(floor(want)::BIGINT) OVER () AS rest FROM c)
SELECT event_id, bin FROM (SELECT b.*, base + (place <= rest)::BIGINT AS take, row_number() OVER (PARTITION BY b.bin ORDER BY md5('bins:' || event_id), event_id) AS r FROM b JOIN f USING (bin)) WHERE r <= take"""
)
def quantile_sample(spark, d):
    """120 events, dealt to quantile bins of their value in proportion."""
    binned = S.quantile_bins(load(spark, d, "events").select("event_id", "value"), "value", 120)
    return S.stratified(binned.select("event_id", "bin"), "bin", 120, ["event_id"], "bins")


# rows and files
@query("SELECT doc_id, trim(lang) AS src, CASE WHEN doc_id % 3 = 0 THEN 'val' WHEN doc_id % 3 = 1 THEN 'train' ELSE 'test' END AS split, doc_id % 2 = 0 AS changed FROM documents WHERE doc_id % 5 <> 0")
def row_cleaning(spark, d):
    """Padded cells, cells of one character, and unknown split names."""
    i = F.col("doc_id")
    raw = F.when(i % 5 == 0, " x ").when(i % 2 == 0, F.concat(F.lit(" "), "lang")).otherwise(F.col("lang"))
    rows = load(spark, d, "documents").select("doc_id", raw.alias("src"), F.when(i % 3 == 0, "VAL").when(i % 3 == 1, "other").otherwise("test").alias("split"))
    return R.clean_rows(rows, ["src"])


@query("SELECT conv_id, turn, text FROM (SELECT conv_id, turn, unnest(CASE WHEN role = 'user' AND length(t) > 200 THEN string_split(t, '. ') ELSE [t] END) AS text FROM (SELECT *, regexp_replace(replace(trim(text, ' \t\n\x0B\f\r'), '.', ''), '[!?]', '', 'g') AS t FROM conversations WHERE conv_id % 2 = 0 AND turn <> 3))".replace("\n", "' || chr(10) || '").replace("\t", "' || chr(9) || '").replace("\x0b", "' || chr(11) || '").replace("\x0c", "' || chr(12) || '").replace("\r", "' || chr(13) || '"))
def needed_rows(spark, d):
    """Chapters 0 of turns by a marker that is no remark; texts without stops stay whole."""
    plain = F.regexp_replace(F.replace(X.strip("text"), F.lit("."), F.lit("")), "[!?]", "")
    rows = load(spark, d, "conversations").select("conv_id", "turn", plain.alias("text"), F.when(F.col("turn") == 3, "rem").when(F.col("role") == "user", "s").otherwise("v").alias("marker"), (F.col("conv_id") % 2).cast("int").alias("chapter"))
    return D.needed_rows(rows, [0]).select("conv_id", "turn", F.col("piece").alias("text"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'R' THEN 'protected' WHEN l_shipdate < TIMESTAMP '1998-01-01' - INTERVAL 24 MONTH THEN 'age' ELSE 'fresh' END AS rule, l_returnflag = 'R' OR l_shipdate >= TIMESTAMP '1998-01-01' - INTERVAL 24 MONTH AS keep FROM lineitem")
def keep_or_delete(spark, d):
    files = load(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_returnflag").alias("name"), F.col("l_shipdate").cast("date").alias("modified"))
    return M.keep_or_delete(files, F.lit("1998-01-01").cast("date"), 24, "^R$").drop("name", "modified")


@query("SELECT min(p_partkey)::BIGINT AS min_step, max(p_partkey)::BIGINT AS max_step FROM part")
def checkpoint_steps(spark, d):
    return D.checkpoints(load(spark, d, "part").select(F.concat(F.lit("checkpoint-"), "p_partkey").alias("name")))


@query("SELECT conv_id, string_agg(text, ' ' ORDER BY turn) AS text, CASE WHEN conv_id % 3 <> 0 THEN round(exp(avg(-turn::DOUBLE)), 6) END AS confidence FROM conversations GROUP BY conv_id")
def rejoined_drafts(spark, d):
    rows = load(spark, d, "conversations").select("conv_id", F.lit(0).alias("draft"), "turn", "text", F.when(F.col("conv_id") % 3 != 0, -F.col("turn").cast("double")).alias("log_score"))
    return D.rejoin_drafts(rows, ["conv_id"], "turn").select("conv_id", "text", F.round("confidence", 6).alias("confidence"))


@query(f"SELECT conv_id, turn, CASE WHEN len(t) >= 2 THEN [array_to_string(t, ' ')] ELSE [array_to_string(t, ' ')] END AS kept FROM (SELECT conv_id, turn, {Q.toks('src')} AS t FROM ({Q.PAIRS})) WHERE len(t) > 1")
def sublist_pruning(spark, d):
    """A text's words and their first and second half: only the whole is left."""
    rows = pairs(spark, d).select(*KEY, X.tokens("src").alias("t")).filter(F.size("t") > 1)
    half = F.floor(F.size("t") / 2).cast("int")
    lists = F.array("t", F.slice("t", F.lit(1), half), F.slice("t", half + 1, F.size("t") - half))
    return rows.select(*KEY, F.transform(M.without_sublists(lists), lambda x: F.array_join(x, " ")).alias("kept"))


@query("SELECT c_custkey, gap FROM (SELECT c_custkey::VARCHAR AS c_custkey, pow(c_nationkey - 10, 2) + pow(c_custkey % 90 - 45, 2) AS gap FROM customer) ORDER BY gap, c_custkey LIMIT 30")
def nearest_points(spark, d):
    points = load(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("name"), F.col("c_nationkey").cast("double").alias("lat"), (F.col("c_custkey") % 90).cast("double").alias("lon"))
    return M.nearest(points, 10.0, 45.0).select(F.col("name").alias("c_custkey"), "gap")


# planning
@query(
    f"""WITH p AS (SELECT conv_id, turn, src, trg, md5(concat_ws(':', 'plan', conv_id, turn)) AS o FROM ({Q.PAIRS}) WHERE src NOT IN ('', '...') AND trg NOT IN ('', '...')), r AS (SELECT *, row_number() OVER (ORDER BY o, conv_id, turn) AS r, count(*) OVER () AS n FROM p),
s AS (SELECT *, CASE WHEN r <= floor(n * 0.1) THEN 'test' WHEN r <= floor(n * 0.1) + 20 THEN 'val' ELSE 'train' END AS split FROM r)
SELECT conv_id, turn, split, false AS mirrored, md5('<fr> ' || src) AS src_md5 FROM s UNION ALL SELECT conv_id, turn, split, true, md5('<fr> ' || trg) FROM s WHERE split = 'train'"""
)
def dataset_build(spark, d):
    plan = D.CorpusPair(("a",), ("b",), test_size=0.1, val_size=20)
    built = D.build_dataset(pairs(spark, d), plan, ["conv_id"], "turn", ["fr"], "plan", mirrored=True)
    return built.select("conv_id", "turn", "split", "mirrored", F.md5(F.col("src").cast("binary")).alias("src_md5"))


@query("SELECT lang AS project, CASE WHEN max(n_chars) FILTER (source = 'src1') > 1000 AND max(n_chars) FILTER (source = 'src2') > 1000 THEN 'long' ELSE 'Unknown' END AS versification FROM (SELECT lang, source, CASE WHEN n_chars > 1000 THEN 1001 ELSE 0 END AS n_chars FROM documents) GROUP BY 1")
def versification(spark, d):
    ends = load(spark, d, "documents").select(F.col("lang").alias("project"), F.col("source").alias("book"), F.lit(1).alias("chapter"), F.when(F.col("n_chars") > 1000, 1001).otherwise(0).alias("verse"))
    return D.versification(ends, [("long", {("src1", 1): 1001, ("src2", 1): 1001})])


@query("SELECT candidate, parallel, score FROM (SELECT CASE WHEN s_nationkey = 3 THEN c_nationkey ELSE s_nationkey END AS candidate, max(parallel) AS parallel, max(score) AS score FROM (SELECT s_nationkey, c_nationkey, count(*)::BIGINT AS parallel, max(c_custkey)::DOUBLE AS score FROM supplier, customer WHERE s_suppkey % 7 = c_custkey % 7 GROUP BY ALL) WHERE 3 IN (s_nationkey, c_nationkey) GROUP BY 1) WHERE parallel >= 2 AND score >= 50")
def candidate_selection(spark, d):
    # rows that meet are counted on either side first, so a pair of groups meets once and not a row for each pair of its rows
    supplier = load(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("src"), (F.col("s_suppkey") % 7).alias("m")).agg(F.count("*").alias("_a"))
    customer = load(spark, d, "customer").groupBy(F.col("c_nationkey").alias("trg"), (F.col("c_custkey") % 7).alias("m")).agg(F.count("*").alias("_b"), F.max("c_custkey").alias("_top"))
    stats = supplier.join(customer, "m").groupBy("src", "trg").agg(F.sum(F.col("_a") * F.col("_b")).alias("parallel"), F.max("_top").cast("double").alias("score"))
    return D.select_candidates(stats, 3, 2, 50.0)


# segmentation
def passages(spark, d):
    """Pairs as passages: words at the same place are linked, verses start at every fifth word."""
    rows = words(spark, d).filter((F.size("s") > 6) & (F.size("t") > 6))
    raw = pairs(spark, d).select(*KEY, X.tokens("src").alias("src"), X.tokens("trg").alias("trg")).join(rows.select(*KEY), KEY)
    own = links(spark, d).groupBy(*KEY).agg(F.collect_list(F.struct("i", "j")).alias("links"))
    key = F.concat_ws(":", *KEY).alias("passage")
    return raw.join(own, KEY).select(key, "src", "trg", "links", F.sequence(F.lit(5), F.size("src") - 1, F.lit(5)).alias("breaks"))


@query(
    f"""WITH {_L}, w2 AS (SELECT conv_id || ':' || turn AS passage, {Q.toks('src')} AS s, {Q.toks('trg')} AS t FROM ({Q.PAIRS})), g AS (SELECT passage, s, t, unnest(range(5, len(s), 5)) AS "at" FROM w2 WHERE len(s) > 6 AND len(t) > 6),
h AS (SELECT passage, s, t, "at", unnest(range(1, len(t))) AS "to" FROM g),
k AS (SELECT *, list_filter(range(least(len(s), len(t))), lambda i: (i < "at") <> (i < "to")) AS c, list_filter(range(least(len(s), len(t))), lambda i: abs(i - "at") <= 5 AND abs(i - "to") <= 5) AS n FROM h)
SELECT passage, "at"::INTEGER AS "at", "to"::INTEGER AS "to", (-20 * len(c) + coalesce(list_sum(list_transform(n, lambda i: abs(i - "to"))), 0)
 + 5 * coalesce((NOT regexp_matches(s["at"], '\\p{{L}}') AND NOT regexp_matches(t["to"], '\\p{{L}}'))::INT, 0) + 5 * coalesce((NOT regexp_matches(s["at" + 2], '\\p{{L}}') AND NOT regexp_matches(t["to" + 2], '\\p{{L}}'))::INT, 0)
 + 5 * coalesce((regexp_matches(s["at" + 2], '^\\p{{Lu}}') AND regexp_matches(t["to" + 2], '^\\p{{Lu}}'))::INT, 0))::BIGINT AS score FROM k"""
)
def break_scoring(spark, d):
    return G.break_scores(passages(spark, d))


@query()
def break_placement(spark, d):
    return G.place_breaks(passages(spark, d))


@query()
def passage_splitting(spark, d):
    parts = G.split_passages(passages(spark, d))
    return parts.select("passage", "part", F.array_join("src", " ").alias("src"), F.array_join("trg", " ").alias("trg"), F.array_join("breaks", ",").alias("breaks"))


@query(f"SELECT conv_id, turn, [src || ').', 'and ' || trg] AS parts FROM ({Q.PAIRS})")
def edge_repair(spark, d):
    parts = F.array("src", F.concat(F.lit(").and "), "trg"))
    return pairs(spark, d).select(*KEY, G.repair_edges(parts).alias("parts"))


@query(f"SELECT conv_id || ':' || turn AS passage, src, trg FROM ({Q.PAIRS})")
def passage_container(spark, d):
    rows = pairs(spark, d).select(F.concat_ws(":", *KEY).alias("passage"), "src", "trg")
    return G.passages_from_json(G.passage_json(rows), "src string, trg string")


# sentences
_BODY = r"""regexp_replace(regexp_replace(raw, '^[\p{Ps}\p{Pi}"''`¿¡-]+', ''), '[\p{Pe}\p{Pf}"''`]+$', '')"""
_KINDS = f"""w AS (SELECT unnest({Q.toks('text')}) AS raw FROM documents), b AS (SELECT {_BODY} AS body FROM w), s AS (SELECT body, regexp_extract(body, '([.!?])$', 1) AS stop FROM b),
p AS (SELECT stop, lower(CASE WHEN stop = '.' THEN substr(body, 1, length(body) - 1) ELSE regexp_replace(body, '[.!?,;:]+$', '') END) AS plain FROM s),
k AS (SELECT stop, CASE WHEN regexp_matches(plain, '^[-+]?[0-9][0-9.,]*$') THEN '{N.NUMBER}' ELSE plain END AS kind FROM p)"""


@query(
    f"""WITH {_KINDS}, c AS (SELECT kind, count(*) FILTER (stop = '.') AS with_period, count(*) FILTER (stop <> '.') AS without FROM k GROUP BY 1),
a AS (SELECT sum(with_period)::DOUBLE / sum(with_period + without) AS p FROM c), n AS (SELECT kind, with_period, without, p, length(replace(kind, '.', ''))::DOUBLE AS size FROM c, a WHERE with_period > 0 AND regexp_matches(kind, '\\p{{L}}')),
r AS (SELECT *, -2 * (with_period * ln(p) + without * ln(1 - p) - with_period * ln({N.CERTAIN}) - without * ln(1 - {N.CERTAIN}::DOUBLE)) AS ratio FROM n)
SELECT kind, with_period, without, round(ratio * exp(-size) * (length(kind) - size + 1) * pow(greatest(size, 1), -without), 3) AS score FROM r
WHERE ratio * exp(-size) * (length(kind) - size + 1) * pow(greatest(size, 1), -without) >= {N.ABBREVIATION}"""
)
def abbreviations(spark, d):
    """Types whose period is their own, over whole documents."""
    found = N.abbreviation_scores(N.counted(load(spark, d, "documents")))
    return found.filter(F.col("score") >= N.ABBREVIATION).withColumn("score", F.round("score", 3))


@query()
def sentence_split(spark, d):
    """The sentences of the conversations, whose texts keep their stops; learned from the same texts."""
    said = load(spark, d, "conversations").select(*KEY, "text")
    return N.sentences(said, KEY)


@query(
    f"""SELECT conv_id, turn, len({Q.toks('text')})::BIGINT AS words FROM conversations WHERE len({Q.toks('text')}) > 0"""
)
def sentence_words(spark, d):
    """No word is lost or doubled by the split."""
    each = N.sentences(load(spark, d, "conversations").select(*KEY, "text"), KEY)
    return each.groupBy(*KEY).agg(F.sum(F.size(X.tokens("sentence"))).alias("words"))
