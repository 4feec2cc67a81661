"""Queries over vocabularies, coverage, distributions, regression and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from lineweave.functions import text as X
from lineweave.operators import corpus as C
from lineweave.operators import misc as M
from lineweave.operators import segmentation as G
from lineweave.operators import sketches as K
from lineweave.operators import stats as T
from lineweave.operators import vocabulary as V
from lineweave.plans import sqltext as Q
from lineweave.plans.line_queries import lines, pairs
from lineweave.session import written
from lineweave.sources.tables import load

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


_MARKS = X.MARKS.replace("'", "''")


def _words(table: str, by: str = "") -> str:
    key = f"{by}, " if by else ""
    return f"""SELECT {key}word, count(*)::BIGINT AS n FROM (SELECT {key}trim(w, '{_MARKS}') AS word FROM (SELECT {key}unnest({Q.toks('lower(text)')}) AS w FROM {table}))
WHERE word <> '' AND NOT regexp_matches(word, '^[0-9]+$') GROUP BY ALL"""


@query(f"SELECT word, n FROM ({_words('documents')}) ORDER BY n DESC, word LIMIT 100")
def word_freq_topn(spark, d):
    return V.word_counts(load(spark, d, "documents"), "text").orderBy(F.desc("n"), "word").limit(100)


@query(
    f"""SELECT sum(b.n)::BIGINT AS total, count(*)::BIGINT AS unique_words, coalesce(sum(b.n) FILTER (k.word IS NULL), 0)::BIGINT AS unknown, count(*) FILTER (k.word IS NULL)::BIGINT AS unknown_unique,
round(coalesce(sum(b.n) FILTER (k.word IS NULL), 0) * 100.0::DOUBLE / sum(b.n), 6) AS unknown_percent FROM ({_words('benchmark')}) b LEFT JOIN ({_words('documents')}) k USING (word)"""
)
def vocab_oov_report(spark, d):
    return V.coverage_report(V.word_counts(load(spark, d, "benchmark"), "text"), V.word_counts(load(spark, d, "documents"), "text"))


@query(f"SELECT word, b.n - coalesce(c.n, 0) AS n FROM ({_words('benchmark')}) b LEFT JOIN ({_words('conversations')}) c USING (word) WHERE b.n > coalesce(c.n, 0)")
def vocab_multiset_subtract(spark, d):
    return V.subtract_counts(V.word_counts(load(spark, d, "benchmark"), "text"), V.word_counts(load(spark, d, "conversations"), "text"))


def _forms(words: str) -> str:
    return f"SELECT DISTINCT word, unnest(list_append(list_transform(generate_series(1, length(word)), lambda i: substr(word, 1, i - 1) || substr(word, i + 1)), word)) AS form FROM ({words})"


@query(
    f"""WITH a AS ({_forms(_words('benchmark'))}), b AS ({_forms(_words('conversations'))})
SELECT DISTINCT a.word, b.word AS similar FROM a JOIN b USING (form) WHERE CASE WHEN length(a.word) = length(b.word) THEN len(list_filter(generate_series(1, length(a.word)), lambda i: substr(a.word, i, 1) <> substr(b.word, i, 1))) = 1 ELSE abs(length(a.word) - length(b.word)) = 1 AND form IN (a.word, b.word) END AND NOT contains(a.word, b.word) AND NOT contains(b.word, a.word)"""
)
def similar_words_lev1(spark, d):
    return V.similar_words(V.word_counts(load(spark, d, "benchmark"), "text"), V.word_counts(load(spark, d, "conversations"), "text"))


@query(
    """WITH c AS (SELECT DISTINCT lang, unnest(string_split(text, '')) AS ch FROM documents), s AS (SELECT lang, list(ch) AS chars FROM c WHERE ch <> '' GROUP BY lang)
SELECT x.lang AS a, y.lang AS b, round((1 - len(list_filter(x.chars, lambda z: NOT list_contains(y.chars, z)))::DOUBLE / len(x.chars))
 * (1 - len(list_filter(y.chars, lambda z: NOT list_contains(x.chars, z)))::DOUBLE / len(y.chars)) * 100, 6) AS similarity FROM s x JOIN s y ON x.lang < y.lang"""
)
def alphabet_similarity(spark, d):
    return V.charset_similarity(V.charsets(load(spark, d, "documents"), "text", "lang"), "lang")


_TOKENS = ["▁the", "▁la", "▁de", "tion", "ing", "ch", "@", "license", "token", "▁und"]


@query(
    f"""WITH l AS ({Q.LINES}), t AS (SELECT * FROM (VALUES {', '.join(f"('{t}', '{V.pattern(t)}')" for t in _TOKENS)}) v(token, p)),
e AS (SELECT token, doc_id, line_no, len(regexp_extract_all(line, p))::BIGINT AS n FROM l, t)
SELECT token, doc_id, sum(n)::BIGINT AS n, array_to_string(list(line_no ORDER BY line_no)[1:10], ',') AS lines, count(*) > 10 AS truncated FROM e WHERE n > 0 GROUP BY ALL"""
)
def token_occurrence(spark, d):
    return V.token_occurrences(lines(spark, d), _TOKENS, "doc_id", "line_no", "line")


_BOOKS = [f"src{i}" for i in range(20)]
_COUNTS = f"SELECT lang, source, count(*)::BIGINT AS verses FROM ({Q.LINES}) WHERE {Q.strip('line')} <> '' GROUP BY ALL"


@query("SELECT lang, " + ", ".join(f"coalesce(sum(verses) FILTER (source = '{b}'), 0)::BIGINT AS {b}" for b in _BOOKS) + f", coalesce(sum(verses) FILTER (source NOT IN ({', '.join(repr(b) for b in _BOOKS)})), 0)::BIGINT AS other, sum(verses)::BIGINT AS total FROM ({_COUNTS}) GROUP BY lang")
def verse_counts_pivot(spark, d):
    return V.verse_matrix(V.verse_counts(lines(spark, d), "lang", "source", "line"), "lang", "source", _BOOKS)


@query(f"SELECT lang, source, round(verses::DOUBLE / max(verses) OVER (PARTITION BY source), 3) * 100 AS percent FROM ({_COUNTS})")
def verse_percentages(spark, d):
    return V.verse_percentages(V.verse_counts(lines(spark, d), "lang", "source", "line"), "lang", "source")


@query(
    f"""WITH c AS ({_COUNTS}), m AS (SELECT source, max(verses) AS complete FROM c GROUP BY 1), p AS (SELECT DISTINCT lang FROM documents)
SELECT p.lang, m.source, CASE WHEN coalesce(c.verses, 0)::DOUBLE / complete >= 0.98 THEN '✓' WHEN coalesce(c.verses, 0) > 0 THEN '~' ELSE 'X' END AS mark FROM m CROSS JOIN p LEFT JOIN c ON c.lang = p.lang AND c.source = m.source"""
)
def coverage_marks(spark, d):
    projects = load(spark, d, "documents").select("lang").distinct()
    return V.coverage_marks(V.verse_counts(lines(spark, d), "lang", "source", "line"), projects, "lang", "source")


@query("SELECT p_brand, array_to_string(list_sort(list(DISTINCT p_type)), ',') AS types FROM part GROUP BY 1 HAVING list_has_all(list(DISTINCT p_type), ['ECONOMY', 'SMALL'])")
def set_containment(spark, d):
    sets = load(spark, d, "part").groupBy("p_brand").agg(F.array_sort(F.collect_set("p_type")).alias("types"))
    return V.containing(sets, "types", ["ECONOMY", "SMALL"]).withColumn("types", F.array_join("types", ","))


@query("SELECT l_returnflag, l_linestatus, sum(round(l_discount * 100)::BIGINT)::DOUBLE / count(*) AS mean, count(*)::BIGINT AS n, grouping(l_returnflag, l_linestatus)::BIGINT AS grain FROM lineitem GROUP BY ROLLUP(l_returnflag, l_linestatus)")
def score_rollup_book_chapter(spark, d):
    rows = load(spark, d, "lineitem").withColumn("percent", F.round(F.col("l_discount") * 100).cast("bigint"))  # whole numbers: their sum has one value
    return T.rollup_means(rows, ["l_returnflag", "l_linestatus"], "percent")


_RANKED = "SELECT o_orderpriority AS book, o_orderstatus AS status, round(avg(o_totalprice), 4) AS score, count(*)::BIGINT AS n FROM orders GROUP BY ALL"


@query(f"SELECT *, rank() OVER (PARTITION BY status ORDER BY score DESC)::INTEGER AS place, sum(n) OVER (PARTITION BY status ORDER BY score DESC, book ROWS UNBOUNDED PRECEDING)::BIGINT AS cumulative FROM ({_RANKED})")
def book_rank_cumulative(spark, d):
    rows = load(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("book"), F.col("o_orderstatus").alias("status")).agg(F.round(F.avg("o_totalprice"), 4).alias("score"), F.count("*").alias("n"))
    return V.running_rank(rows, ["status"], "score", "n", "book")


_DAYS = "SELECT event_type, strftime(ts, '%Y-%m-%d') AS day, sum(round(value * 100)::BIGINT)::DOUBLE / count(*) AS m FROM events GROUP BY ALL"


@query(f"SELECT event_type, day, m, m - lag(m) OVER w AS vs_previous, m - first_value(m) OVER w AS vs_first FROM ({_DAYS}) WINDOW w AS (PARTITION BY event_type ORDER BY day)")
def progress_diff_prev_start(spark, d):
    days = load(spark, d, "events").groupBy("event_type", F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.avg(F.round(F.col("value") * 100).cast("bigint")).alias("m"))  # in hundredths
    return T.progression(days, "event_type", "day", "m")


def _summary(c: str, n: str) -> str:
    return f"min({c})::BIGINT AS {n}_min, max({c})::BIGINT AS {n}_max, median({c})::DOUBLE AS {n}_median, round(avg({c}), 3) AS {n}_mean, round(stddev_samp({c}), 3) AS {n}_std, count(*) FILTER ({c} >= 200)::BIGINT AS {n}_long"


@query(f"WITH l AS (SELECT lang, len({Q.toks('line')}) AS words, length(line) AS chars FROM ({Q.LINES})) SELECT lang, {_summary('words', 'words')}, {_summary('chars', 'chars')} FROM l GROUP BY lang")
def token_stats(spark, d):
    rows = lines(spark, d).select("lang", F.size(X.tokens("line")).alias("words"), F.char_length("line").alias("chars"))
    return rows.groupBy("lang").agg(*T.summary("words", "words"), *T.summary("chars", "chars"))


@query(f"SELECT lang, {_summary('n', 'chars_per_word')} FROM (SELECT lang, length(unnest({Q.toks('text')})) AS n FROM documents) GROUP BY lang")
def word_length_stats(spark, d):
    rows = load(spark, d, "documents").select("lang", F.explode(F.transform(X.tokens("text"), F.char_length)).alias("n"))
    return rows.groupBy("lang").agg(*T.summary("n", "chars_per_word"))


@query(f"SELECT lang, floor(length(line) / 20.0)::BIGINT AS bin, count(*)::BIGINT AS n FROM ({Q.LINES}) GROUP BY ALL")
def length_histogram(spark, d):
    return T.histogram(lines(spark, d).select("lang", F.char_length("line").alias("chars")), "chars", 20, ["lang"])


@query("SELECT conv_id, md5(string_agg(text, ' ' ORDER BY turn)) AS text_md5, round(exp(avg(ln((length(text) % 100 + 1) / 101.0::DOUBLE))), 6) AS confidence FROM conversations GROUP BY conv_id")
def chapter_concat_gmean(spark, d):
    rows = load(spark, d, "conversations").withColumn("c", (F.char_length("text") % 100 + 1) / F.lit(101.0))
    ordered = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), " ")
    return rows.groupBy("conv_id").agg(F.md5(ordered.cast("binary")).alias("text_md5"), F.round(T.geometric_mean("c"), 6).alias("confidence"))


@query("SELECT l_shipdate_year, round(avg(v - m), 6) AS mean FROM (SELECT year(l_shipdate)::INTEGER AS l_shipdate_year, l_tax AS v, avg(l_tax) OVER (PARTITION BY l_returnflag) AS m FROM lineitem) GROUP BY 1")
def demeaned_scores(spark, d):
    rows = load(spark, d, "lineitem").select(F.year("l_shipdate").alias("l_shipdate_year"), "l_returnflag", "l_tax")
    return T.demeaned(rows, "l_tax", "l_returnflag", "l_shipdate_year")


@query("SELECT l_returnflag, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept FROM lineitem GROUP BY 1")
def qe_regression(spark, d):
    return T.simple_regression(load(spark, d, "lineitem"), "l_quantity", "l_extendedprice", ["l_returnflag"])


@query(
    """WITH r AS (SELECT event_type, floor(epoch(ts))::BIGINT % 86400 / 86400.0::DOUBLE AS x, value / 5 AS y FROM events), b AS (SELECT *, least(floor(y), 99) AS b FROM r),
w AS (SELECT *, 1 / (count(*) OVER (PARTITION BY event_type, b) + 1e-6::DOUBLE) AS w FROM b),
s AS (SELECT event_type, sum(w) AS w, sum(w * x) AS x, sum(w * y) AS y, sum(w * x * x) AS xx, sum(w * x * y) AS xy FROM w GROUP BY 1), f AS (SELECT *, (w * xy - x * y) / (w * xx - x * x) AS slope FROM s)
SELECT event_type, round(slope, 4) AS slope, round((y - slope * x) / w, 4) AS intercept FROM f"""
)
def qe_weighted(spark, d):
    seconds = F.unix_seconds(F.col("ts").cast("timestamp")) % 86400
    rows = load(spark, d, "events").select("event_type", (seconds / F.lit(86400.0)).alias("x"), (F.col("value") / 5).alias("y"))
    return T.weighted_regression(rows, "x", "y", ["event_type"])


@query("SELECT event_id, round(value * 1.5::DOUBLE + 20, 6) AS projected, CASE WHEN value * 1.5::DOUBLE + 20 >= 53 THEN 'Green' WHEN value * 1.5::DOUBLE + 20 >= 44.5 THEN 'Yellow' ELSE 'Red' END AS label FROM events")
def qe_labels(spark, d):
    return T.projected(load(spark, d, "events"), "value", 1.5, 20.0).select("event_id", "projected", "label")


_POINTS = "SELECT (row_number() OVER (ORDER BY n_nationkey) - 1)::BIGINT AS place, x, y FROM (SELECT n_nationkey, avg(c_acctbal) AS x, count(*)::DOUBLE AS y FROM nation JOIN customer ON c_nationkey = n_nationkey GROUP BY 1)"


@query(
    f"""WITH p AS ({_POINTS}), n AS (SELECT count(*) AS n FROM p), d AS (SELECT b, floor({Q.uniform("'boot'", "b", "i")} * (SELECT n FROM n))::BIGINT AS place FROM range(1000) t(b), range((SELECT n FROM n)) u(i)),
f AS (SELECT b, round(regr_slope(y, x), 4) AS slope, round(regr_intercept(y, x), 4) AS intercept FROM d JOIN p USING (place) GROUP BY b)
SELECT round(avg(slope), 4) AS slope, round(avg(intercept), 4) AS intercept FROM f WHERE slope >= (SELECT quantile_cont(slope, 0.9) FROM f)"""
)
def qe_bootstrap(spark, d):
    from pyspark.sql import Window

    customers = load(spark, d, "customer").groupBy(F.col("c_nationkey").alias("k")).agg(F.avg("c_acctbal").alias("x"), F.count("*").cast("double").alias("y"))
    nations = load(spark, d, "nation").join(customers, F.col("n_nationkey") == F.col("k"))
    points = nations.select((F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("n_nationkey")) - 1).cast("bigint").alias("place"), "x", "y")  # nations: a dimension
    return T.bootstrap_regression(points, "x", "y", points.count(), 1000, "boot")


@query(
    """WITH e AS (SELECT vec_id, label, generate_subscripts(embedding, 1) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings), c AS (SELECT label, i, avg(x) AS m FROM e GROUP BY ALL)
SELECT vec_id, round(sum(x * m) / (sqrt(sum(x * x)) * sqrt(sum(m * m))), 6) AS cosine FROM e JOIN c USING (label, i) GROUP BY vec_id"""
)
def cosine_to_centroid(spark, d):
    rows = load(spark, d, "embeddings")
    parts = rows.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    centres = parts.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda p: p["m"]).alias("c"))
    own = F.transform("embedding", lambda x: x.cast("double"))
    return rows.join(F.broadcast(centres), "label").select("vec_id", F.round(T.cosine(own, "c"), 6).alias("cosine"))  # a row per label


@query("SELECT l_returnflag, round(corr(l_quantity, l_extendedprice), 6) AS r FROM lineitem GROUP BY 1")
def corr_scores(spark, d):
    return load(spark, d, "lineitem").groupBy("l_returnflag").agg(F.round(F.corr("l_quantity", "l_extendedprice"), 6).alias("r"))


@query(
    """WITH p AS (SELECT least(s_nationkey, c_nationkey) AS a, greatest(s_nationkey, c_nationkey) AS b, abs(s_acctbal - c_acctbal) AS v FROM supplier JOIN customer ON s_suppkey = c_custkey),
m AS (SELECT a, b, median(v) AS m FROM p GROUP BY ALL) SELECT a, b, round(m / (max(m) OVER () + 0.01), 6) AS similarity FROM m"""
)
def similarity_matrix(spark, d):
    both = load(spark, d, "supplier").join(load(spark, d, "customer"), F.col("s_suppkey") == F.col("c_custkey"))
    rows = both.select("s_nationkey", "c_nationkey", F.abs(F.col("s_acctbal") - F.col("c_acctbal")).alias("v"))
    return T.pair_similarity(rows, "s_nationkey", "c_nationkey", "v")


@query(
    f"""WITH l AS ({Q.LINES}), p AS (SELECT doc_id, (line_no - 1) // 5 AS passage, min(line_no) AS a, max(line_no) AS b FROM l GROUP BY ALL)
SELECT l.doc_id, p.passage::BIGINT AS passage, count(*)::BIGINT AS n, md5(string_agg(line, ' ' ORDER BY line_no)) AS text_md5 FROM l JOIN p ON l.doc_id = p.doc_id AND l.line_no BETWEEN p.a AND p.b GROUP BY ALL"""
)
def passage_range_join(spark, d):
    rows = lines(spark, d).select(F.col("doc_id").alias("book"), "line_no", "line")
    passages = rows.groupBy("book", F.expr("(line_no - 1) div 5").alias("passage")).agg(F.min("line_no").alias("first"), F.max("line_no").alias("last"))
    met = G.verses_to_passages(rows, passages, "line_no", "line")
    return met.select(F.col("book").alias("doc_id"), "passage", F.col("n_verses").alias("n"), F.md5(F.col("line").cast("binary")).alias("text_md5"))


@query("SELECT a.n_name AS name, b.n_name AS related FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey <> b.n_nationkey")
def related_languages(spark, d):
    return M.related(load(spark, d, "nation").withColumnRenamed("n_name", "name"), "name", ["n_regionkey"])


@query("SELECT event_id, json_extract(props, '$.k')::VARCHAR::BIGINT AS k FROM events")
def json_props(spark, d):
    return load(spark, d, "events").select("event_id", F.from_json("props", "k long").getField("k").alias("k"))


def _terms(sep: str) -> str:
    return f"SELECT p_type AS cat, p_brand AS id, unnest(list_distinct(string_split(p_name, ' '))) AS {sep} FROM part"


@query(f"SELECT DISTINCT a.id, a.word AS src, b.word AS trg FROM ({_terms('word')}) a JOIN ({_terms('word')}) b ON a.id = b.id AND a.cat = 'ECONOMY' AND b.cat = 'SMALL'")
def term_pairs(spark, d):
    from lineweave.operators.terms import term_pairs as joined

    rows = load(spark, d, "part").select(F.col("p_type").alias("cat"), F.col("p_brand").alias("id"), F.split("p_name", " ").alias("renderings"))
    return joined(rows.filter("cat = 'ECONOMY'"), rows.filter("cat = 'SMALL'"))


@query("SELECT DISTINCT p_brand AS id, word, gloss FROM (SELECT p_brand, unnest(string_split(p_name, ' ')) AS word, lower(p_type) AS gloss FROM part)")
def term_gloss_pairs(spark, d):
    from lineweave.operators.terms import gloss_pairs

    rows = load(spark, d, "part").select(F.col("p_brand").alias("id"), F.split("p_name", " ").alias("renderings"), F.array(F.lower("p_type")).alias("glosses"))
    return gloss_pairs(rows)


@query("SELECT event_id, user_id, last_value(CASE WHEN event_type = 'signup' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS stem FROM events")
def carry_forward(spark, d):
    from pyspark.sql import Window

    by = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return load(spark, d, "events").select("event_id", "user_id", F.last(F.when(F.col("event_type") == "signup", F.col("event_id")), ignorenulls=True).over(by).alias("stem"))


@query("WITH n AS (SELECT s_nationkey AS k, s_suppkey AS v FROM supplier) SELECT c_nationkey AS k, c_custkey AS v FROM customer WHERE c_nationkey NOT IN (SELECT k FROM n) UNION ALL SELECT k, v FROM n")
def keyed_overwrite(spark, d):
    old = load(spark, d, "customer").select(F.col("c_nationkey").alias("k"), F.col("c_custkey").alias("v"))
    return C.keyed_overwrite(old, load(spark, d, "supplier").select(F.col("s_nationkey").alias("k"), F.col("s_suppkey").alias("v")), ["k"])


@query("SELECT time_bucket(INTERVAL '1 hour', ts) AS start, event_type, count(*)::BIGINT AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def events_tumbling(spark, d):
    from lineweave.streaming.events import tumbling

    return tumbling(load(spark, d, "events"))


@query(
    """WITH g AS (SELECT *, (ts >= lag(ts) OVER w + INTERVAL '6 hours' OR lag(ts) OVER w IS NULL)::INT AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM g)
SELECT user_id, min(ts) AS start, count(*)::BIGINT AS n FROM s GROUP BY user_id, session"""
)
def events_session(spark, d):
    from lineweave.streaming.events import sessions

    return sessions(load(spark, d, "events"))


@query("SELECT time_bucket(INTERVAL '1 hour', ts) - k * INTERVAL '1 hour' AS start, event_type, count(*)::BIGINT AS n FROM events, range(2) t(k) GROUP BY ALL")
def events_sliding(spark, d):
    from lineweave.streaming.events import sliding

    return sliding(load(spark, d, "events"))


@query(
    """WITH e AS (SELECT *, lag(event_type) OVER o AS before, lag(ts) OVER o AS then_ FROM events WINDOW o AS (PARTITION BY user_id ORDER BY ts, event_id)),
r AS (SELECT *, sum(CASE WHEN before IS NULL OR before <> event_type OR ts > then_ + INTERVAL 6 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM e)
SELECT user_id, min(ts) AS start, event_type, count(*) AS n FROM r GROUP BY user_id, run, event_type"""
)
def event_runs(spark, d):
    """Runs of one type of event: the table's plan of the stateful operator."""
    from lineweave.streaming.events import runs

    return runs(load(spark, d, "events"))


def kept(df, name):
    """Sketches as they are stored: written, and read again."""
    return written(df, name)


@query("SELECT event_type, count(DISTINCT user_id) AS users, true AS within FROM events GROUP BY 1")
def kept_distinct(spark, d):
    """Distinct users from sketches of each day: within three standard errors of the exact count."""
    events = load(spark, d, "events").withColumn("day", F.to_date("ts"))
    sketches = kept(K.distinct_sketches(events, ["day", "event_type"], "user_id"), "sketches")
    exact = events.groupBy("event_type").agg(F.count_distinct("user_id").alias("users"))
    found = K.distinct_estimates(sketches, ["event_type"]).join(exact, "event_type")
    return found.select("event_type", "users", (F.abs(F.col("estimate") - F.col("users")) <= F.greatest(F.lit(1.0), 3 * 0.01625 * F.col("users"))).alias("within"))


@query("SELECT l_returnflag, share, true AS within FROM (SELECT DISTINCT l_returnflag FROM lineitem), (VALUES (0.1::DOUBLE), (0.5), (0.9)) v(share)")
def kept_quantiles(spark, d):
    """Quantiles of prices from sketches of each year: their exact ranks are within the stated error."""
    rows = load(spark, d, "lineitem").select("l_returnflag", F.year("l_shipdate").alias("year"), "l_extendedprice")
    sketches = kept(K.quantile_sketches(rows, ["l_returnflag", "year"], "l_extendedprice"), "sketches")
    found = K.quantile_estimates(sketches, ["l_returnflag"], [0.1, 0.5, 0.9])
    ranks = rows.join(F.broadcast(found), "l_returnflag").groupBy("l_returnflag", "share")  # three rows a flag
    ranks = ranks.agg(F.avg((F.col("l_extendedprice") <= F.col("value")).cast("double")).alias("rank"))
    return ranks.select("l_returnflag", "share", (F.abs(F.col("rank") - F.col("share")) <= 0.0165).alias("within"))


@query("SELECT user_id, count(*) AS n, true AS enough FROM events GROUP BY 1")
def kept_counts(spark, d):
    """Events by user from count-min sketches of each event type: never too small."""
    events = load(spark, d, "events").select("user_id", "event_type")
    sketches = kept(K.count_sketches(events, ["event_type"], "user_id"), "sketches")
    exact = events.groupBy("user_id").agg(F.count("*").alias("n"))
    found = K.count_estimates(sketches, exact, "user_id")
    return found.select("user_id", "n", (F.col("estimate") >= F.col("n")).alias("enough"))
