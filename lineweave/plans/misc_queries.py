"""Queries for the smaller operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from lineweave.functions import text as X
from lineweave.operators import datasets as D
from lineweave.operators import lexicon as L
from lineweave.operators import misc as M
from lineweave.operators import vocabulary as V
from lineweave.plans import sqltext as Q
from lineweave.plans.line_queries import lines, pairs
from lineweave.plans.metric_queries import _B, links
from lineweave.plans.stat_queries import _words
from lineweave.sources.tables import load

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


@query(f"WITH {_B}, f AS (SELECT word FROM ({_words('conversations')}) ORDER BY n DESC, word LIMIT 50) SELECT round(100 / avg(n), 4) AS consistency FROM (SELECT src, count(*) AS n FROM b JOIN f ON src = word GROUP BY src)")
def internal_consistency(spark, d):
    top = V.word_counts(load(spark, d, "conversations"), "text").orderBy(F.desc("n"), "word").limit(50)
    return M.consistency(top, L.build(links(spark, d)))


@query(
    """SELECT lang, source, bool_or(length(text) < 100) AS any_short, bool_and(length(text) < 100) AS all_short, bool_or(contains(text, chr(10))) AS any_lines, bool_and(contains(text, chr(10))) AS all_lines FROM documents GROUP BY ALL"""
)
def quality_flags(spark, d):
    return M.quality_flags(load(spark, d, "documents"), ["lang", "source"], {"short": F.char_length("text") < 100, "lines": F.col("text").contains("\n")})


_STEMS = "SELECT doc_id, lang || '-' || source || '_2024_0' || (1 + n_chars % 9) || '_1' || (n_chars % 10) AS stem FROM documents"


@query(
    f"""SELECT doc_id, regexp_extract(stem, '^([a-z]{{2,3}})-', 1) AS iso, regexp_extract(stem, '^[a-z]{{2,3}}-(.*?)(?:_[0-9]{{4}}_[0-9]{{2}}_[0-9]{{2}})?$', 1) AS project,
strptime(regexp_extract(stem, '_([0-9]{{4}}_[0-9]{{2}}_[0-9]{{2}})$', 1), '%Y_%m_%d')::DATE AS stamp FROM ({_STEMS})"""
)
def stem_and_stamp(spark, d):
    stem = F.concat_ws("", "lang", F.lit("-"), "source", F.lit("_2024_0"), F.col("n_chars") % 9 + 1, F.lit("_1"), F.col("n_chars") % 10)
    rows = load(spark, d, "documents").select("doc_id", stem.alias("stem"))
    return rows.select("doc_id", *M.stem_parts("stem"), M.date_stamp("stem").alias("stamp"))


@query(
    f"""WITH l AS ({Q.LINES}), r AS (SELECT item_id AS id, regexp_extract(text, '[a-z]{{3,}}') AS w FROM benchmark)
SELECT DISTINCT id, unnest(regexp_extract_all(line, w || '[\\p{{L}}\\p{{M}}\\p{{N}}_]*')) AS form FROM r JOIN l ON doc_id = id WHERE w <> ''"""
)
def surface_forms(spark, d):
    word = F.regexp_extract("text", "([a-z]{3,})", 1)
    renderings = load(spark, d, "benchmark").select(F.col("item_id").alias("id"), F.concat(word, F.lit("*")).alias("rendering"), F.array("item_id").alias("refs")).filter("rendering <> '*'")
    return M.surface_forms(renderings, lines(spark, d).select(F.col("doc_id").alias("ref"), F.col("line").alias("text")))


@query("SELECT value, string_agg(p_partkey::VARCHAR, ',' ORDER BY p_partkey) AS keys FROM (SELECT DISTINCT p_partkey, unnest(string_split(p_name, ' ')) AS value FROM part) GROUP BY value")
def map_inversion(spark, d):
    rows = load(spark, d, "part").select("p_partkey", F.split("p_name", " ").alias("words"))
    return M.inverted(rows, "p_partkey", "words").select("value", F.array_join("keys", ",").alias("keys"))


@query(
    """WITH p AS (SELECT source, substr(sha256(doc_id::VARCHAR), 1, 2) AS c, sha256(string_agg(doc_id || ':' || sha256(text), chr(10) ORDER BY doc_id::VARCHAR)) AS d FROM documents GROUP BY ALL)
SELECT source, sha256(string_agg(d, '' ORDER BY c)) AS hash FROM p GROUP BY source"""
)
def content_hashes(spark, d):
    files = load(spark, d, "documents").select("source", F.col("doc_id").cast("string").alias("path"), F.col("text").cast("binary").alias("content"))
    return M.content_hash(files, ["source"])


@query("SELECT l_orderkey, string_agg(v, ' ' ORDER BY a, b, v) AS verses FROM (SELECT DISTINCT l_orderkey, l_linenumber || '-' || l_quantity::INT AS v, l_linenumber AS a, l_quantity::INT AS b FROM lineitem) GROUP BY 1")
def verse_number_sort(spark, d):
    rows = load(spark, d, "lineitem").select("l_orderkey", F.concat_ws("-", "l_linenumber", F.col("l_quantity").cast("int")).alias("v")).distinct()
    first, last = M.verse_order("v")
    ordered = F.array_sort(F.collect_list(F.struct(first.alias("a"), last.alias("b"), "v")))
    return rows.groupBy("l_orderkey").agg(F.array_join(F.transform(ordered, lambda x: x["v"]), " ").alias("verses"))


@query("SELECT conv_id, turn, floor((row_number() OVER (PARTITION BY role ORDER BY conv_id, turn) - 1) / 16)::BIGINT AS batch, role FROM conversations")
def fixed_batches(spark, d):
    return D.batches(load(spark, d, "conversations").select("conv_id", "turn", "role"), ["role"], ["conv_id", "turn"], 16)


@query(
    f"""WITH p AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS place FROM ({Q.PAIRS}) WHERE {Q.strip('src')} <> '' AND {Q.strip('trg')} <> '')
SELECT conv_id, turn, place::INTEGER AS place, CASE WHEN place = 0 THEN 'test' WHEN place = 2 THEN 'val' ELSE 'train' END AS split FROM p"""
)
def row_routing(spark, d):
    return D.route_rows(pairs(spark, d), ["turn"], ["conv_id"], {0}, {2}).select("conv_id", "turn", "place", "split")


@query(f"SELECT conv_id, turn, unnest(range(2))::INTEGER AS draft, unnest([src, trg]) AS text FROM ({Q.PAIRS})")
def draft_transposition(spark, d):
    return D.transpose_drafts(pairs(spark, d).withColumn("drafts", F.array("src", "trg")), ["conv_id", "turn"], "drafts")


@query("SELECT event_type, count(DISTINCT user_id)::BIGINT AS users FROM events GROUP BY CUBE(event_type)")
def distinct_users_cube(spark, d):
    return load(spark, d, "events").cube("event_type").agg(F.count_distinct("user_id").alias("users"))


@query("SELECT source, count(*)::BIGINT AS n FROM documents GROUP BY 1 HAVING count(*) > 10")
def frequent_sources(spark, d):
    return load(spark, d, "documents").groupBy("source").agg(F.count("*").alias("n")).filter("n > 10")


@query("SELECT conv_id, turn, CASE WHEN starts_with(trg, left(src, 3)) THEN ltrim(substr(trg, 4)) ELSE trg END AS trg FROM (SELECT conv_id, turn, src, CASE WHEN turn % 4 = 0 THEN left(src, 3) || '  ' || trg ELSE trg END AS trg FROM (" + Q.PAIRS + "))")
def source_echo(spark, d):
    rows = pairs(spark, d).withColumn("echo", F.substring("src", 1, 3))
    rows = rows.withColumn("trg", F.when(F.col("turn") % 4 == 0, F.concat("echo", F.lit("  "), "trg")).otherwise(F.col("trg")))
    return rows.select("conv_id", "turn", D.without_echo(F.col("trg"), F.col("echo")).alias("trg"))


@query(f"SELECT DISTINCT w AS word FROM (SELECT unnest({Q.toks('lower(text)')}) AS w FROM benchmark) WHERE w NOT IN (SELECT unnest({Q.toks('lower(text)')}) FROM documents)")
def vocabulary_except(spark, d):
    words = lambda t: load(spark, d, t).select(F.explode(X.tokens(F.lower("text"))).alias("word")).distinct()
    return V.except_words(words("benchmark"), words("documents"))
