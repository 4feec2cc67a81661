"""Queries over lines and pairs of lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from lineweave.functions import text as X
from lineweave.operators import corpus as C
from lineweave.operators import datasets as E
from lineweave.operators import dedup as D
from lineweave.operators import filters as R
from lineweave.operators import segmentation as G
from lineweave.operators import splits as S
from lineweave.plans import sqltext as Q
from lineweave.sources.tables import load

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def lines(spark, d):
    return C.explode_lines(load(spark, d, "documents").select("doc_id", "lang", "source", "text"))


def pairs(spark, d):
    return C.reply_pairs(load(spark, d, "conversations"))


@query(f"WITH l AS ({Q.LINES}) SELECT doc_id, line_no, line FROM l")
def doc_lines(spark, d):
    return lines(spark, d).select("doc_id", "line_no", "line")


_n, _chars = f"len({Q.toks('line')})", "length(line)"
_mono = rf"""CASE WHEN {Q.strip('line')} = '' THEN 'blank'
 WHEN {_n} < 4 OR {_n} > 200 THEN 'word_count'
 WHEN {Q.count('line', '/')} > 5 OR {Q.count('line', '[|]')} > 5 OR {Q.count('line', '-')} > 5 OR {Q.count('line', '[0-9|/-]')} / {_chars} > 0.5 THEN 'specific_punct'
 WHEN list_max(list_transform({Q.toks('line')}, lambda x: length(x))) > 150
   OR list_sum(list_transform({Q.toks('line')}, lambda x: length(x)))::DOUBLE / ({_n} + 1e-9::DOUBLE) < 3
   OR list_sum(list_transform({Q.toks('line')}, lambda x: length(x)))::DOUBLE / ({_n} + 1e-9::DOUBLE) > 20 THEN 'word_length'
 WHEN {Q.count('line', Q.PUNCT)} > 10 OR {Q.count('line', Q.PUNCT)} / {_chars} > 0.5 THEN 'punctuation'
 WHEN regexp_matches(line, '<.*?>') OR contains(line, 'http://') OR contains(line, 'https://') THEN 'html'
 WHEN contains(line, '\x') THEN 'special_char' END"""


@query(f"WITH l AS ({Q.LINES}) SELECT doc_id, line_no, {_mono} AS reason FROM l")
def line_filter_cascade(spark, d):
    return R.cascade(lines(spark, d), R.line_rules()).select("doc_id", "line_no", "reason")


@query(
    f"""WITH l AS ({Q.LINES}), r AS (SELECT lang, coalesce({_mono}, 'kept') AS reason FROM l),
c AS (SELECT lang, reason, count(*)::BIGINT AS n FROM r GROUP BY ALL)
SELECT lang, reason, n, round(n / sum(n) OVER (PARTITION BY lang), 6) AS share FROM c"""
)
def line_filter_report(spark, d):
    return R.report(R.cascade(lines(spark, d), R.line_rules()), ["lang"])


def _pair_sql() -> str:
    def both(f):
        return f"({f('src')} OR {f('trg')})"

    n = lambda c: f"len({Q.toks(c)})"
    chars = lambda c: f"list_sum(list_transform({Q.toks(c)}, lambda x: length(x)))::DOUBLE"
    dense = lambda c: f"length(regexp_replace({c}, '{Q.BLANK}+', '', 'g'))::DOUBLE"
    p = lambda c: Q.count(c, Q.PUNCT)
    cross = lambda a, b, m: f"CASE WHEN {a} = 0 OR {b} = 0 THEN {a} <> {b} ELSE greatest({a}::DOUBLE / {b}, {b}::DOUBLE / {a}) > {m} END"
    return rf"""CASE WHEN {Q.strip('src')} = '' OR {Q.strip('trg')} = '' OR src = trg THEN 'blank_or_same'
 WHEN {both(lambda c: f"({n(c)} < 4 OR {n(c)} > 200)")} THEN 'word_count'
 WHEN {cross(n('src'), n('trg'), 1.8)} THEN 'word_ratio'
 WHEN {both(lambda c: f"({Q.count(c, '/')} > 5 OR {Q.count(c, '[|]')} > 5 OR {Q.count(c, '-')} > 5 OR {Q.count(c, '[0-9|/-]')} / length({c}) > 0.5)")} THEN 'specific_punct'
 WHEN {both(lambda c: f"(list_max(list_transform({Q.toks(c)}, lambda x: length(x))) > 150 OR {chars(c)} / ({n(c)} + 1e-9::DOUBLE) < 3 OR {chars(c)} / ({n(c)} + 1e-9::DOUBLE) > 20)")} THEN 'word_length'
 WHEN {p('src')} >= 3 AND {p('trg')} >= 3 AND ({p('src')} > 12 OR {p('trg')} > 12 OR {p('src')} / (length(src) + 1e-9::DOUBLE) > 0.5 OR {p('trg')} / (length(trg) + 1e-9::DOUBLE) > 0.5
   OR {p('src')} / ({p('trg')} + 1e-9::DOUBLE) > 3 OR {p('trg')} / ({p('src')} + 1e-9::DOUBLE) > 3) THEN 'punctuation'
 WHEN {both(lambda c: f"(regexp_matches({c}, '<.*?>') OR contains({c}, 'http://') OR contains({c}, 'https://'))")} THEN 'html'
 WHEN contains(src, '\x') OR contains(trg, '\x') THEN 'special_char'
 WHEN {cross(dense('src'), dense('trg'), 3)} THEN 'char_ratio' END"""


@query(f"WITH p AS ({Q.PAIRS}) SELECT conv_id, turn, {_pair_sql()} AS reason FROM p")
def pair_filter_ratio_rules(spark, d):
    return R.cascade(pairs(spark, d), R.pair_rules()).select("conv_id", "turn", "reason")


@query(r"SELECT page_id, md5(regexp_replace(regexp_replace(html, '<.*?>', '', 'g'), 'https?://[^ \t\n\x0B\f\r]+', '', 'g')) AS text_md5 FROM pages")
def html_strip_soft(spark, d):
    return load(spark, d, "pages").select("page_id", F.md5(X.strip_html("html").cast("binary")).alias("text_md5"))


@query("SELECT page_id, regexp_matches(html, '<.*?>') OR contains(html, 'http://') OR contains(html, 'https://') AS rejected FROM pages")
def html_reject(spark, d):
    return load(spark, d, "pages").select("page_id", R.html("html").alias("rejected"))


@query(f"WITH l AS ({Q.LINES}) SELECT doc_id, line_no FROM l WHERE line <> '' AND {Q.count('line', '[^a-zA-Z]')} / length(line) <= 0.3")
def latin_share_filter(spark, d):
    return lines(spark, d).filter("line <> ''").filter(R.non_latin_share("line") <= 0.3).select("doc_id", "line_no")


_SCRIPTS = {"Latn": r"\p{Latin}", "Cyrl": r"\p{Cyrillic}", "Grek": r"\p{Greek}", "Arab": r"\p{Arabic}", "Deva": r"\p{Devanagari}", "Hani": r"\p{Han}", "Hebr": r"\p{Hebrew}"}


@query(
    "SELECT doc_id, CASE WHEN m[1] > 0 THEN m[3] ELSE 'None' END AS script FROM (SELECT doc_id, list_max(["
    + ", ".join(f"row({Q.count('text', p)}, {-i}, '{s}')" for i, (s, p) in enumerate(_SCRIPTS.items()))
    + "]) AS m FROM documents)"
)
def script_majority(spark, d):
    return load(spark, d, "documents").select("doc_id", R.script_of("text").alias("script"))


@query("SELECT doc_id, regexp_matches(text, '[^\\p{Latin}\\p{Common}\\p{Inherited}]') AS rejected FROM documents")
def script_whitelist(spark, d):
    return load(spark, d, "documents").select("doc_id", R.wrong_script("text").alias("rejected"))


@query("SELECT min(doc_id) AS doc_id, count(*)::BIGINT AS copies FROM documents GROUP BY text")
def dedup_exact_first(spark, d):
    return D.first_of_equal(load(spark, d, "documents"), ["text"], "doc_id")


@query(
    """SELECT l_partkey, l_orderkey, l_linenumber, l_extendedprice FROM (SELECT *, row_number() OVER
(PARTITION BY l_partkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS r FROM lineitem) WHERE r = 1"""
)
def dedup_best_score(spark, d):
    rows = load(spark, d, "lineitem").select("l_partkey", "l_orderkey", "l_linenumber", "l_extendedprice")
    return D.best_per_key(rows, ["l_partkey"], F.col("l_extendedprice"), ["l_orderkey", "l_linenumber"])


@query(
    f"""WITH p AS (SELECT conv_id, turn, split_part(src, ' ', 1) AS word, length(src) AS a, length(trg) AS b FROM ({Q.PAIRS}))
SELECT word, conv_id, turn FROM (SELECT *, row_number() OVER (PARTITION BY word ORDER BY abs(a - b), conv_id, turn) AS r FROM p) WHERE r = 1"""
)
def dedup_argmin_length(spark, d):
    rows = pairs(spark, d).select("conv_id", "turn", F.split_part("src", F.lit(" "), F.lit(1)).alias("word"), F.abs(F.char_length("src") - F.char_length("trg")).alias("gap"))
    return D.best_per_key(rows, ["word"], -F.col("gap"), ["conv_id", "turn"]).select("word", "conv_id", "turn")


@query(f"SELECT conv_id, turn, src, trg FROM ({Q.PAIRS})")
def parallel_turn_pairs(spark, d):
    return pairs(spark, d)


def ranged(spark, d):
    """Replies of an odd length stand for <range>: they are folded into the pair before."""
    return pairs(spark, d).withColumn("trg", F.when(F.char_length("trg") % 2 == 1, C.RANGE).otherwise(F.col("trg")))


@query(
    f"""WITH p AS (SELECT conv_id, turn, src, CASE WHEN length(trg) % 2 = 1 THEN '<range>' ELSE trg END AS trg FROM ({Q.PAIRS})),
g AS (SELECT *, sum((src <> '<range>' AND trg <> '<range>')::INT) OVER (PARTITION BY conv_id ORDER BY turn) AS grp FROM p)
SELECT conv_id, grp::BIGINT AS grp, min(turn) AS turn, max(turn) AS last,
 coalesce(string_agg(src, ' ' ORDER BY turn) FILTER (src NOT IN ('', '<range>')), '') AS src,
 coalesce(string_agg(trg, ' ' ORDER BY turn) FILTER (trg NOT IN ('', '<range>')), '') AS trg FROM g GROUP BY conv_id, grp"""
)
def parallel_range_fold(spark, d):
    return C.fold_ranges(ranged(spark, d), ["conv_id"], "turn")


def holed(spark, d):
    blank = lambda c, m: F.when(F.char_length(c) % 7 == m, "").when(F.char_length(c) % 7 == m + 1, C.PLACEHOLDER).otherwise(F.col(c))
    return pairs(spark, d).withColumns({"src": blank("src", 0), "trg": blank("trg", 0)})


_HOLED = "SELECT conv_id, turn, " + ", ".join(f"CASE WHEN length({c}) % 7 = 0 THEN '' WHEN length({c}) % 7 = 1 THEN '...' ELSE {c} END AS {c}" for c in ("src", "trg")) + f" FROM ({Q.PAIRS})"


@query(f"SELECT * FROM ({_HOLED}) WHERE src NOT IN ('', '...') AND trg NOT IN ('', '...')")
def parallel_drop_empty(spark, d):
    return C.drop_empty(holed(spark, d))


@query(f"SELECT * FROM (SELECT conv_id, turn, CASE WHEN src = '...' THEN '' ELSE src END AS src, CASE WHEN trg = '...' THEN '' ELSE trg END AS trg FROM ({_HOLED})) WHERE src <> '' OR trg <> ''")
def parallel_keep_one_sided(spark, d):
    return C.keep_one_sided(holed(spark, d))


def books(spark, d):
    rows = load(spark, d, "documents").select(F.col("source").alias("book"), F.col("doc_id").alias("chapter"), "lang")
    picked = spark.createDataFrame([("src1", None), ("src2", 22), ("src2", 42), ("src3", 3)], "book string, chapter long")
    return rows, picked


_PICKED = "(book = 'src1' OR (book = 'src2' AND chapter IN (22, 42)) OR (book = 'src3' AND chapter = 3))"


@query(f"SELECT * FROM (SELECT source AS book, doc_id AS chapter, lang FROM documents) WHERE {_PICKED}")
def book_chapter_include(spark, d):
    return C.include_chapters(*books(spark, d))


@query(f"SELECT * FROM (SELECT source AS book, doc_id AS chapter, lang FROM documents) WHERE NOT {_PICKED}")
def book_chapter_exclude(spark, d):
    return C.exclude_chapters(*books(spark, d))


@query(f"SELECT conv_id, turn, src, trg, false AS mirrored FROM ({Q.PAIRS}) UNION ALL SELECT conv_id, turn, trg, src, true FROM ({Q.PAIRS})")
def mirror_union(spark, d):
    return C.mirror(pairs(spark, d))


@query(
    f"""WITH w AS (SELECT doc_id // 10 AS k, max(text) FILTER (lang = 'de') AS de, max(text) FILTER (lang = 'en') AS en, max(text) FILTER (lang = 'es') AS es, max(text) FILTER (lang = 'fr') AS fr FROM documents GROUP BY 1),
a AS (SELECT k, list_filter([de, en, es, fr], lambda x: x IS NOT NULL AND x <> '') AS t FROM w)
SELECT k, md5(t[floor({Q.uniform("'mix'", "k")} * len(t))::INT + 1]) AS picked FROM a"""
)
def mixed_source_coalesce(spark, d):
    docs = load(spark, d, "documents").withColumn("k", F.expr("doc_id div 10"))
    wide = docs.groupBy("k").pivot("lang", ["de", "en", "es", "fr"]).agg(F.max("text"))
    return C.pick_source(wide, ["de", "en", "es", "fr"], F.col("k"), "mix").select("k", F.md5(F.col("picked").cast("binary")).alias("picked"))


@query(
    """WITH s AS (SELECT s_nationkey AS k, max(s_acctbal) AS bal, count(*)::BIGINT AS suppliers FROM supplier WHERE s_acctbal > 5000 GROUP BY 1),
c AS (SELECT c_nationkey AS k, max(c_acctbal) AS bal, count(*)::BIGINT AS customers FROM customer WHERE c_acctbal < 3000 GROUP BY 1)
SELECT k, coalesce(s.bal, c.bal) AS bal, suppliers, customers FROM s FULL JOIN c USING (k)"""
)
def combine_first_outer(spark, d):
    s = load(spark, d, "supplier").filter("s_acctbal > 5000").groupBy(F.col("s_nationkey").alias("k")).agg(F.max("s_acctbal").alias("bal"), F.count("*").alias("suppliers"))
    c = load(spark, d, "customer").filter("c_acctbal < 3000").groupBy(F.col("c_nationkey").alias("k")).agg(F.max("c_acctbal").alias("bal"), F.count("*").alias("customers"))
    return C.combine_first(s, c, ["k"])


@query(f"SELECT conv_id, turn, '<fr> <x> ' || src AS src FROM ({Q.PAIRS})")
def tag_prefix(spark, d):
    return C.add_tags(pairs(spark, d), ["fr", "x"], "src").select("conv_id", "turn", "src")


@query("SELECT l_orderkey, l_linenumber, l_discount FROM lineitem WHERE l_discount > 0.05")
def score_threshold_frac(spark, d):
    rows = load(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_discount")
    return C.score_filter(rows, 0.05, "l_discount", ["l_linenumber"], ["l_orderkey"])


@query("SELECT l_orderkey, l_linenumber, l_discount FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_discount, l_linenumber, l_partkey, l_suppkey) AS r FROM lineitem) WHERE r > 2")
def score_threshold_drop_n(spark, d):
    rows = load(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_discount", "l_partkey", "l_suppkey")
    return C.score_filter(rows, 2, "l_discount", ["l_linenumber", "l_partkey", "l_suppkey"], ["l_orderkey"]).select("l_orderkey", "l_linenumber", "l_discount")


@query("SELECT e.event_id, e.event_type, e.value FROM events e JOIN (SELECT event_type, quantile_cont(value, 0.9) AS c FROM events GROUP BY 1) q USING (event_type) WHERE e.value > c")
def score_quantile_filter(spark, d):
    return C.quantile_filter(load(spark, d, "events").select("event_id", "event_type", "value"), 0.9, "value", ["event_type"])


_SPLIT = "SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5('split:' || doc_id), doc_id) AS r, count(*) OVER (PARTITION BY lang) AS n FROM documents"
_BAND = f"SELECT doc_id, lang, CASE WHEN r <= floor(n * 0.1) THEN 'test' WHEN r <= floor(n * 0.1) + 20 THEN 'val' ELSE 'train' END AS split FROM ({_SPLIT})"


@query(_BAND)
def split_hash_disjoint(spark, d):
    return S.split_bands(load(spark, d, "documents").select("doc_id", "lang"), ["doc_id"], ["lang"], [("test", 0.1), ("val", 20)], "split")


@query(f"SELECT lang, split, count(*)::BIGINT AS n FROM ({_BAND}) GROUP BY ALL")
def split_counts(spark, d):
    return split_hash_disjoint(spark, d).groupBy("lang", "split").agg(F.count("*").alias("n"))


@query(
    """WITH s AS (SELECT doc_id, quality * 2 + toxic AS bin FROM labels),
b AS (SELECT bin, count(*) AS n, sum(count(*)) OVER () AS total FROM s GROUP BY bin),
w AS (SELECT bin, n * 60.0::DOUBLE / total AS want FROM b),
f AS (SELECT bin, floor(want)::BIGINT AS base, row_number() OVER (ORDER BY want - floor(want) DESC, bin) AS place, 60 - sum(floor(want)::BIGINT) OVER () AS rest FROM w),
t AS (SELECT bin, base + (place <= rest)::BIGINT AS take FROM f)
SELECT doc_id, bin FROM (SELECT s.*, take, row_number() OVER (PARTITION BY s.bin ORDER BY md5('sample:' || doc_id), doc_id) AS r FROM s JOIN t USING (bin)) WHERE r <= take"""
)
def stratified_sample(spark, d):
    rows = load(spark, d, "labels").select("doc_id", (F.col("quality") * 2 + F.col("toxic")).alias("bin"))
    return S.stratified(rows, "bin", 60, ["doc_id"], "sample")


def words_of_pairs(spark, d):
    return pairs(spark, d).select("conv_id", "turn", F.posexplode(X.tokens("src")).alias("i", "w"))


_WORDS = f"SELECT conv_id, turn, generate_subscripts(t, 1)::INT - 1 AS i, unnest(t) AS w FROM (SELECT conv_id, turn, {Q.toks('src')} AS t FROM ({Q.PAIRS}))"


def _joined(word: str, order: str, where: str = "") -> str:
    return f"SELECT conv_id, turn, md5(string_agg({word}, ' ' ORDER BY {order})) AS text_md5 FROM ({_WORDS}) {where} GROUP BY ALL"


def _told(noised):
    return noised.select("conv_id", "turn", F.md5(F.array_join("words", " ").cast("binary")).alias("text_md5"))


def _key():
    return [F.col("conv_id"), F.col("turn")]


@query(f"SELECT conv_id, turn, coalesce(m, md5('')) AS text_md5 FROM ({Q.PAIRS}) LEFT JOIN (SELECT conv_id, turn, text_md5 AS m FROM ({_joined('w', 'i', 'WHERE ' + Q.uniform(chr(39) + 'drop' + chr(39), 'conv_id', 'turn', 'i') + ' >= 0.2')})) USING (conv_id, turn)")
def noise_dropout(spark, d):
    return _told(pairs(spark, d).withColumn("words", S.drop_tokens(X.tokens("src"), 0.2, "drop", *_key())))


@query(_joined(f"CASE WHEN {Q.uniform(chr(39) + 'blank' + chr(39), 'conv_id', 'turn', 'i')} < 0.2 THEN '<blank>' ELSE w END", "i"))
def noise_replace(spark, d):
    return _told(pairs(spark, d).withColumn("words", S.replace_tokens(X.tokens("src"), 0.2, "blank", *_key())).filter(F.size("words") > 0))


@query(_joined("w", f"i + {Q.uniform(chr(39) + 'move' + chr(39), 'conv_id', 'turn', 'i')} * 4, i"))
def noise_permute(spark, d):
    return _told(pairs(spark, d).withColumn("words", S.permute_tokens(X.tokens("src"), 3, "move", *_key())).filter(F.size("words") > 0))


@query("SELECT doc_id, md5(replace(ltrim(replace(replace(replace(p, ' ', ''), '▁▀', ''), '▁', ' ')), chr(9), ' ')) AS text_md5 FROM (SELECT doc_id, '▁' || replace(text, ' ', ' ▁') AS p FROM documents)")
def sp_decode(spark, d):
    pieces = F.concat(F.lit("▁"), F.replace("text", F.lit(" "), F.lit(" ▁")))
    return load(spark, d, "documents").select("doc_id", F.md5(F.replace(X.decode_pieces(pieces), F.lit("\t"), F.lit(" ")).cast("binary")).alias("text_md5"))


@query()
def punct_normalise(spark, d):
    return lines(spark, d).select("doc_id", "line_no", X.normalise_punctuation("line").alias("line"))


@query(
    rf"""WITH n AS (SELECT 'src' AS side, conv_id, turn, unnest(regexp_extract_all(src, '([0-9]+(?:,*[0-9]+)*)', 1)) AS num FROM ({Q.PAIRS})
UNION ALL SELECT 'trg', conv_id, turn, unnest(regexp_extract_all(trg, '([0-9]+(?:,*[0-9]+)*)', 1)) FROM ({Q.PAIRS}))
SELECT conv_id, turn, num, bool_or(side = 'src') AS in_src, bool_or(side = 'trg') AS in_trg FROM n GROUP BY ALL"""
)
def digits_analysis(spark, d):
    found = pairs(spark, d).select("conv_id", "turn", X.numbers("src").alias("s"), X.numbers("trg").alias("t"))
    each = found.select("conv_id", "turn", F.explode(F.array_union("s", "t")).alias("num"), "s", "t")
    return each.select("conv_id", "turn", "num", F.array_contains("s", F.col("num")).alias("in_src"), F.array_contains("t", F.col("num")).alias("in_trg"))


@query(
    f"""SELECT conv_id, turn, to_json([{{role: 'system', content: 'Translate.'}}, {{role: 'user', content: src}}, {{role: 'assistant', content: trg}}])::VARCHAR AS messages,
to_json([{{role: 'user', content: 'Translate.' || chr(10) || chr(10) || src}}, {{role: 'assistant', content: trg}}])::VARCHAR AS folded FROM ({Q.PAIRS})"""
)
def chat_messages(spark, d):
    told = lambda fold: F.to_json(E.chat_prompt(F.col("src"), F.col("trg"), "Translate.", fold))
    return pairs(spark, d).select("conv_id", "turn", told(False).alias("messages"), told(True).alias("folded"))


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders) WHERE r = 1")
def latest_version_per_key(spark, d):
    rows = load(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice", "o_orderdate")
    return rows.groupBy("o_custkey").agg(F.max_by(F.struct("o_orderkey", "o_totalprice"), F.struct("o_orderdate", "o_orderkey")).alias("r")).select("o_custkey", "r.*")


@query("SELECT l_orderkey, l_linenumber, l_extendedprice, l_discount FROM lineitem ORDER BY l_discount DESC NULLS LAST, l_extendedprice DESC NULLS LAST, l_orderkey, l_linenumber LIMIT 100")
def multi_key_sort_topk(spark, d):
    rows = load(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", "l_discount")
    return rows.orderBy(F.desc_nulls_last("l_discount"), F.desc_nulls_last("l_extendedprice"), "l_orderkey", "l_linenumber").limit(100)


@query(
    f"""WITH l AS ({Q.LINES}), s AS (SELECT doc_id, line_no, sum(length(regexp_replace(line, '{Q.BLANK}+', '', 'g'))) OVER (PARTITION BY doc_id ORDER BY line_no) AS off,
  line_no = max(line_no) OVER (PARTITION BY doc_id) AS last, sum(length(regexp_replace(regexp_replace(line, '[0-9]', '', 'g'), '{Q.BLANK}+', '', 'g'))) OVER (PARTITION BY doc_id ORDER BY line_no) AS off2 FROM l)
SELECT doc_id, avg((off = off2)::INT::DOUBLE) AS accuracy, avg(abs(off - off2)::DOUBLE) AS distance FROM s WHERE NOT last GROUP BY doc_id"""
)
def segmentation_accuracy(spark, d):
    gold = lines(spark, d).select(F.col("doc_id").alias("passage"), F.col("line_no").alias("verse"), F.col("line").alias("text"))
    found = gold.withColumn("text", F.regexp_replace("text", "[0-9]", ""))
    return G.segmentation_report(gold, found, by_passage=True).withColumnRenamed("passage", "doc_id")
