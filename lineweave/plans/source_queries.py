"""Queries over the file sources and sinks (S01-S20, K01-K08): files are written from the tables to the run's shared folder, and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lineweave.functions import text as X
from lineweave.plans import sqltext as Q
from lineweave.plans.line_queries import lines, pairs
from lineweave.plans.metric_queries import _L, KEY, lexicons, links
from lineweave.session import run_dir
from lineweave.sources import files as S
from lineweave.sources import sinks as K
from lineweave.sources.tables import load

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def fresh(spark, name: str) -> str:
    return f"{run_dir(spark)}/files/{name}-{uuid.uuid4().hex}"


def one_file(rows: DataFrame, name: str, order: str, column: str) -> str:
    """The path of one text file of a dimension's rows in order."""
    path = fresh(rows.sparkSession, name)
    rows.select(order, F.col(column).alias("value")).coalesce(1).sortWithinPartitions(order).select("value").write.text(path)
    return path


_LINES = Q.LINES.replace("\n", " ")


@query(f"SELECT text, count(*)::BIGINT AS n FROM (SELECT {Q.strip('line')} AS text FROM ({_LINES})) GROUP BY 1")
def line_round_trip(spark, d):
    """All lines of all documents, written in order and read again with their numbers."""
    path = fresh(spark, "lines")
    rows = lines(spark, d).select(F.struct("doc_id", "line_no").alias("at"), "line")
    K.write_lines(rows.filter(~F.col("line").contains("\r")), path, "at", "line")
    back = S.line_scan(spark, path).select("text").unionByName(rows.filter(F.col("line").contains("\r")).select(X.strip("line").alias("text")))
    return back.groupBy("text").agg(F.count("*").alias("n"))


@query("SELECT n_nationkey::BIGINT + 1 AS line_no, n_name AS src, r_name AS trg FROM nation JOIN region ON r_regionkey = n_nationkey")
def parallel_files(spark, d):
    """Two files paired line by line as far as the shorter one goes."""
    nation, region = load(spark, d, "nation"), load(spark, d, "region")
    return S.parallel_scan(spark, {"src": one_file(nation, "nation", "n_nationkey", "n_name"), "trg": one_file(region, "region", "r_regionkey", "r_name")})


@query("SELECT l_orderkey AS line_no, ['GEN', 'EXO', 'LEV', 'NUM', 'DEU', 'JOS', 'JDG'][l_linenumber] AS book, l_linenumber::INTEGER AS book_num, 'OT' AS testament, l_quantity::INTEGER AS chapter, l_linenumber || '-9' AS verse FROM lineitem")
def verse_references(spark, d):
    rows = load(spark, d, "lineitem").join(S.book_dimension(spark), F.col("book_num") == F.col("l_linenumber"))
    made = rows.select(F.col("l_orderkey").alias("line_no"), F.concat("book", F.lit(" "), F.col("l_quantity").cast("int"), F.lit(":"), "l_linenumber", F.lit("-9")).alias("text"))
    return S.verse_refs(made).join(S.book_dimension(spark), "book").select("line_no", "book", "book_num", "testament", "chapter", "verse")


@query("SELECT 'L:' || n_nationkey AS id, n_name AS cat, CASE WHEN n_nationkey % 2 = 0 THEN 'x' ELSE '' END AS domain, CASE WHEN n_regionkey = 0 THEN 'a|b' ELSE n_name END AS glosses FROM nation")
def term_files(spark, d):
    """Metadata, glosses, renderings and references of key terms, line by line."""
    nation = load(spark, d, "nation")
    cell = F.concat_ws("\t", "n_nationkey", "n_name", F.when(F.col("n_nationkey") % 2 == 0, "x").otherwise(""))
    gloss = F.when(F.col("n_regionkey") == 0, "a\tb").otherwise(F.col("n_name"))
    scan = lambda c: S.line_scan(spark, one_file(nation.withColumn("c", c), "terms", "n_nationkey", "c"))
    found = S.terms(scan(cell), scan(gloss), scan(F.col("n_name")), scan(F.lit("GEN 1:1")), "L")
    return found.select("id", "cat", "domain", F.array_join("glosses", "|").alias("glosses"))


@query("SELECT p_name AS src, p_type AS trg, p_brand AS hash, p_retailprice AS score FROM part")
def scored_pairs(spark, d):
    path = fresh(spark, "scored")
    load(spark, d, "part").select("p_name", "p_type", "p_brand", "p_retailprice").write.csv(path, sep="\t", quote="")
    return S.scored_tsv(spark, path)


@query("SELECT p_partkey AS id, p_name || ' ' || p_type AS source, p_brand AS target FROM part")
def broken_rows(spark, d):
    """Every row broken in two within its second cell."""
    path = fresh(spark, "broken")
    rows = load(spark, d, "part").select("p_partkey", F.concat("p_partkey", F.lit("\t"), "p_name", F.lit("\n"), "p_type", F.lit("\t"), "p_brand").alias("text"))
    K.write_lines(rows, path, "p_partkey")
    return S.repaired_tsv(S.line_scan(spark, path), 3).select("id", F.get("cells", 1).alias("source"), F.get("cells", 2).alias("target"))


@query(f"WITH {_L} SELECT conv_id, turn, i, j, 0.5::DOUBLE AS p FROM l")
def alignment_files(spark, d):
    """Links as lines of an alignment file, one sentence a line."""
    told = links(spark, d).groupBy(*KEY).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "j"))), lambda x: F.concat(x["i"], F.lit("-"), x["j"], F.lit(":0.5"))), " ").alias("text"))
    rows = told.select((F.col("conv_id") * 1000 + F.col("turn")).alias("line_no"), "text")
    back = S.alignment_lines(rows)
    return back.select(F.expr("line_no div 1000").alias("conv_id"), (F.col("line_no") % 1000).alias("turn"), "i", "j", "p")


@query("SELECT s_name AS src, s_address AS trg, round(s_suppkey / 16.0, 8) AS prob FROM (SELECT s_suppkey, 's' || s_suppkey AS s_name, 't' || s_nationkey AS s_address FROM supplier)")
def lexicon_file(spark, d):
    """A lexicon written in its order to eight digits and read back."""
    path = fresh(spark, "lexicon")
    K.write_lexicon(load(spark, d, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("src"), F.concat(F.lit("t"), "s_nationkey").alias("trg"), (F.col("s_suppkey") / F.lit(16.0)).alias("prob")), path)
    return S.lexicon_lines(spark.read.text(path).withColumnRenamed("value", "text"))


@query("SELECT 'p' || o_custkey AS stem, max(o_orderkey)::INTEGER AS verses FROM orders GROUP BY 1")
def log_counts(spark, d):
    """A log of two lines for each order: the project, and a count that belongs to it; the last one holds."""
    rows = load(spark, d, "orders").select(F.lit("log").alias("file"), "o_orderkey", F.explode(F.array(F.concat(F.lit("INFO Extracting p"), "o_custkey"), F.concat(F.lit("# of Verses: "), "o_orderkey"))).alias("text"))
    logs = rows.select(F.concat("file", (F.col("o_orderkey") % 16).cast("string")).alias("file"), (F.col("o_orderkey") * 2 + F.startswith("text", F.lit("#")).cast("int")).alias("line_no"), "text")
    return S.verse_log(logs).groupBy("stem").agg(F.max("verses").alias("verses"))


@query("SELECT DISTINCT n.n_name AS \"isoCode\" FROM nation n, nation o WHERE o.n_nationkey IN (3, 7) AND (n.n_regionkey = o.n_regionkey OR n.n_nationkey % 6 = o.n_nationkey % 6)")
def related_from_json(spark, d):
    path = fresh(spark, "languages")
    nation = load(spark, d, "nation")
    K.write_json(nation.select(F.col("n_name").alias("isoCode"), F.col("n_name").alias("language"), F.col("n_regionkey").cast("string").alias("langCountry"), (F.col("n_nationkey") % 6).cast("string").alias("languageFamily")), path)
    names = [r.n_name for r in nation.filter("n_nationkey IN (3, 7)").select("n_name").collect()]  # two rows
    return S.related(S.languages(spark, path, one_list=False), names)


@query("SELECT n_nationkey::BIGINT AS line_no, n_name AS en, CASE WHEN n_nationkey % 2 = 0 THEN lower(n_name) ELSE '' END AS fr FROM nation")
def interlinear_xml(spark, d):
    """A row a line and language in XML, turned into a column a language."""
    path = fresh(spark, "xml")
    nation = load(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("line_no"), F.lit("en").alias("lang"), F.col("n_name").alias("text"))
    other = nation.filter("line_no % 2 = 0").withColumns({"lang": F.lit("fr"), "text": F.lower("text")})
    nation.unionByName(other).write.format("xml").option("rowTag", "item").save(path)
    return S.interlinear(S.xml_rows(spark, path, "item", "line_no long, lang string, text string"))


@query(f"WITH {_L} SELECT conv_id || ':' || turn AS vref, i, j, i = 0 AS sure FROM (SELECT DISTINCT conv_id, turn FROM l), (VALUES (0, 0), (0, 1), (1, 0), (1, 1), (2, 2)) v(i, j) WHERE NOT (i = 0 AND j = 1)".replace("i = 0 AS sure", "i = j AND i <> 1 AS sure").replace(" WHERE NOT (i = 0 AND j = 1)", ""))
def gold_links(spark, d):
    """Links of two words with two are taken apart, only the first pair is sure."""
    path = fresh(spark, "gold")
    link = lambda s, t: F.struct(F.array(*map(F.lit, s)).alias("source"), F.array(*map(F.lit, t)).alias("target"), F.lit(True).alias("sure"))
    rows = links(spark, d).select(*KEY).distinct().select(F.concat_ws(":", *KEY).alias("vref"), F.array(F.lit("a b")).alias("source"), F.array(F.lit("c")).alias("target"), F.array(link([0, 1], [0, 1]), link([2], [2])).alias("links"))
    K.write_json(rows, path)
    schema = "vref string, source array<string>, target array<string>, links array<struct<source: array<int>, target: array<int>, sure: boolean>>"
    return S.gold_links(spark.read.schema(schema).json(path)).select("vref", F.explode("links").alias("l")).select("vref", "l.*")


@query(f"SELECT conv_id, turn, src, trg FROM ({Q.PAIRS})")
def translation_structs(spark, d):
    each = pairs(spark, d)
    packed = each.select(*KEY, S.translation(F.col("src"), F.col("trg"), "en", "fr"))
    return packed.select(*KEY, F.col("translation.en").alias("src"), F.col("translation.fr").alias("trg"))


@query("SELECT n_nationkey AS line_no, CASE WHEN n_regionkey = 1 THEN n_name ELSE '' END AS text FROM nation")
def padded_column(spark, d):
    nation = load(spark, d, "nation").select(F.col("n_nationkey").alias("line_no"), F.col("n_name").alias("text"), "n_regionkey")
    return K.padded(nation.filter("n_regionkey = 1"), nation, "line_no", "text")


@query("SELECT l_returnflag AS split, l_linestatus AS side, count(*)::BIGINT AS n FROM lineitem GROUP BY ALL")
def partitioned_splits(spark, d):
    path = fresh(spark, "splits")
    K.write_splits(load(spark, d, "lineitem").select(F.col("l_returnflag").alias("split"), F.lit("en").alias("src_iso"), F.lit("fr").alias("trg_iso"), F.col("l_linestatus").alias("side"), "l_orderkey"), path)
    return spark.read.parquet(path).groupBy("split", "side").agg(F.count("*").alias("n"))


@query("SELECT l_returnflag AS book, printf('%.2f', sum(round(l_discount * 100)::BIGINT)::DOUBLE / count(*)) AS score FROM lineitem GROUP BY 1")
def score_cells(spark, d):
    rows = load(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("book")).agg(F.avg(F.round(F.col("l_discount") * 100).cast("bigint")).alias("score"))
    return K.score_table(rows, {"score": 2})


@query("SELECT c_nationkey AS k, c_custkey AS v FROM customer WHERE c_nationkey NOT IN (SELECT s_nationkey FROM supplier) UNION ALL SELECT s_nationkey, s_suppkey FROM supplier")
def upserted_rows(spark, d):
    new = load(spark, d, "supplier").select(F.col("s_nationkey").alias("k"), F.col("s_suppkey").alias("v"))
    return K.upserted(load(spark, d, "customer").select(F.col("c_nationkey").alias("k"), F.col("c_custkey").alias("v")), new, ["k"])


@query("SELECT l_returnflag AS book, l_linenumber AS chapter, round(exp(avg(-l_discount)), 6) AS confidence FROM lineitem GROUP BY ALL")
def confidence_rollup(spark, d):
    rows = load(spark, d, "lineitem").select(F.col("l_returnflag").alias("book"), F.col("l_linenumber").alias("chapter"), F.col("l_orderkey").alias("verse"), (-F.col("l_discount")).alias("log_prob"))
    return K.confidence_tables(rows)["chapters"].withColumn("confidence", F.round("confidence", 6))


@query(f"SELECT conv_id, turn, array_to_string(list_transform({Q.toks('src')}, lambda x: lower(regexp_replace(x, '[.,]', '', 'g')) || regexp_extract(x, '([.,]*)$', 1)), ' ') AS text FROM ({Q.PAIRS})")
def lemmas(spark, d):
    """The lemma is the word in small letters, with what analysers append; the surface's marks stay."""
    lemma = F.array_join(F.transform(X.tokens("src"), lambda x: F.concat(F.lower(F.regexp_replace(x, "[.,]", "")), F.lit("<n>|X"))), " ")
    return pairs(spark, d).select(*KEY, S.lemma_line(F.col("src"), lemma).alias("text"))


@query("SELECT 'MAT' AS book, n_regionkey::INTEGER + 1 AS chapter, n_nationkey::INTEGER + 1 AS verse, n_name || ' more' AS text FROM nation")
def marked_up_books(spark, d):
    """A book of chapters and verses with notes and headings, written as marked-up text and read verse by verse."""
    verse = F.concat(F.lit("\\v "), F.col("n_nationkey") + 1, F.lit(" "), "n_name", F.lit("\\f + note\\f*\n\\q1 more\n"))
    nation = load(spark, d, "nation").groupBy("n_regionkey").agg(F.array_join(F.array_sort(F.collect_list(F.struct("n_nationkey", verse.alias("v"))))["v"], "").alias("v"))
    books = nation.select(F.col("n_regionkey").alias("k"), F.concat(F.lit("\\id MAT\n\\c "), F.col("n_regionkey") + 1, F.lit("\n\\s Head\n\\p\n"), "v").alias("value"))
    path = fresh(spark, "books")
    books.repartition(5, "k").select("value").write.text(path)
    return S.usfm_verses(spark, f"{path}/part-*").select("book", "chapter", "verse", "text")


_PLAIN = Q.toks("regexp_replace(src, '[\\\\|~/]', '', 'g')")


def styled(spark, d) -> DataFrame:
    """(k, value): a marked-up book a conversation, its turns as verses: words in character styles and with attributes, lines
    of poetry and prose, headings, notes, figures and numbers beside the text."""
    word = lambda w, i: F.concat(
        F.when(i % 7 == 6, F.lit("\n\\q3 ")).when(i % 11 == 10, F.lit("\n\\s2 A heading\n\\pmo ")).otherwise(F.lit(" ")),
        F.when(i % 3 == 1, F.concat(F.lit("\\w "), w, F.lit('|lemma="x"\\w*'))).when(i % 5 == 2, F.concat(F.lit("\\add \\+nd "), w, F.lit("\\+nd*\\add*"))).otherwise(w),
        F.when(i % 4 == 3, F.lit("\\f + \\fr 1.1 \\ft note \\it x\\it*\\f*")).when(i % 9 == 8, F.lit("\\fig |src=\"a.jpg\"\\fig*")).otherwise(F.lit("")),
    )
    plain = X.tokens(F.regexp_replace("src", r"[\\|~/]", ""))
    verse = F.concat(F.lit("\\v "), F.col("turn") + 1, F.lit(" \\vp 9\\vp*"), F.array_join(F.transform(plain, word), ""), F.lit("\n"))
    books = pairs(spark, d).select("conv_id", F.struct("turn", verse.alias("v")).alias("v")).groupBy("conv_id").agg(F.array_join(F.array_sort(F.collect_list("v"))["v"], "").alias("v"))
    head = F.concat(F.lit("\\id CNV\n\\mt1 Title\n\\c "), F.col("conv_id") + 1, F.lit("\n\\cl Chapter\n\\s Head\n\\p\n"))
    return books.select(F.col("conv_id").alias("k"), F.concat(head, "v").alias("value"))


@query(f"SELECT 'CNV' AS book, conv_id::INTEGER + 1 AS chapter, turn::INTEGER + 1 AS verse, array_to_string({_PLAIN}, ' ') AS text FROM ({Q.PAIRS})")
def styled_books(spark, d):
    """Books full of styles, written and read: no word may be lost, and nothing else may be taken for text."""
    path = fresh(spark, "styled")
    styled(spark, d).repartition(8, "k").select("value").write.text(path)
    return S.usfm_verses(spark, f"{path}/part-*").select("book", "chapter", "verse", "text")


@query(
    f"""SELECT conv_id::INTEGER + 1 AS chapter, turn::INTEGER + 1 AS verse, CASE WHEN turn % 4 = 0 THEN 'New text of ' || conv_id ELSE array_to_string({_PLAIN}, ' ') END AS text FROM ({Q.PAIRS})"""
)
def books_written_back(spark, d):
    """Every second turn's text replaced in the books: the others come back as they were."""
    books = styled(spark, d).select(F.col("k").cast("string").alias("file"), F.col("value").alias("content"))
    new = pairs(spark, d).filter("turn % 4 = 0").select(F.col("conv_id").cast("string").alias("file"), (F.col("conv_id") + 1).cast("int").alias("chapter"), (F.col("turn") + 1).cast("int").alias("verse"), F.concat(F.lit("New text of "), "conv_id").alias("text"))
    return S.book_verses(S.usfm_updated(books, new)).select("chapter", "verse", "text")
