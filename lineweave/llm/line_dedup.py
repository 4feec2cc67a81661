"""Line dedup over range-partitioned line hashes (DataFrame functions only).

Every line of a document becomes one row (128-bit hash of its key, document, position); texts stay behind.
The rows are range-partitioned by hash with a secondary sort by document (largest first) and position, and a
window streams over them: the lines of a key's first document are its kept occurrences, those of its other
documents go once enough documents hold the key. What comes back per document is a run-length bitmap of kept
and dropped lines; `apply_bitmaps` lays it over the texts.

A key that holds 1/HOT_SHARE of all rows or more would weigh on its range alone. There can be HOT_SHARE such keys
at most, so they are summed up map-side first and their few rows (key, documents, largest document; half a megabyte)
broadcast: their lines are judged where they are read and never meet in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lineweave.llm.common import saved

BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
HOT_SHARE, LEAST_HOT = 16384, 256
NO_ID = -(2**63)


def ascii_lower(c: Column) -> Column:
    """A-Z lower-cased, all else as it is. lower() does just that on ASCII, and is much faster there."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def line_rows(docs: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    """(d, t, pos, h1, h2): a row for each line whose key has min_chars code points."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = docs.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("d"),
        F.xxhash64(text).alias("t"),
        F.posexplode(F.split(text, "\n", -1)).alias("pos", "line"),
    )
    keys = lines.select("d", "t", "pos", F.btrim("line", F.lit(BLANKS)).alias("key")).filter(
        F.char_length("key") >= min_chars
    )
    keys = keys.select("d", "t", "pos", ascii_lower(F.col("key")).alias("key"))
    return keys.select(
        "d", "t", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(0x2545F4914F6CDD1D), "key").alias("h2")
    )


def hot_keys(lines: DataFrame) -> DataFrame | None:
    """(h1, h2, hot_docs, hot_last) of the keys with 1/HOT_SHARE of all rows; None if there are none.

    Counts by hash range come first: 2**18 sums at most. Only ranges that are hot as a whole can hold a hot
    key, so only their rows are grouped by key.
    """
    ranges = lines.groupBy(F.shiftright("h1", 46).alias("r")).count()
    total = ranges.agg(F.sum("count")).first()[0] or 0
    least = max(total // HOT_SHARE, LEAST_HOT)
    hot = ranges.filter(F.col("count") >= least).select("r").toArrow()  # HOT_SHARE ranges at most
    if not hot.num_rows:
        return None
    hot = lines.sparkSession.createDataFrame(hot)
    # by document first: a hot key's documents are counted in many tasks, and only sums meet
    inside = lines.withColumn("r", F.shiftright("h1", 46)).join(F.broadcast(hot), "r", "left_semi")
    each = inside.groupBy("h1", "h2", "d").agg(F.count("*").alias("m"))
    found = each.groupBy("h1", "h2").agg(F.sum("m").alias("n"), F.count("*").alias("hot_docs"), F.max("d").alias("hot_last"))
    return found.filter(F.col("n") >= least).drop("n")


def keep_bitmaps(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20, min_docs: int = 3
) -> DataFrame:
    """(d, t, runs, n_dropped): for each document that loses lines, the lengths of its alternating runs of kept
    and dropped lines, kept first; lines past the last run are kept.

    A line's key is the line without white space `[\\x20\\x09-\\x0D]` at its ends, A-Z lower-cased. A key of at
    least min_chars code points found in at least min_docs documents loses its lines everywhere but in the
    largest id that holds it. d is the id (null: the smallest long, one document before all others); t is the
    text's hash, so that rows which share an id but not a text keep bitmaps of their own. Null and empty texts
    are one empty line and lose nothing. Repeated rows are one document and get one bitmap.
    """
    lines = saved(line_rows(docs, id_col, text_col, min_chars), "lines")
    hot = hot_keys(lines)
    cold, judged = lines, None
    if hot is not None:
        marked = lines.join(F.broadcast(hot), ["h1", "h2"], "left")
        cold = marked.filter("hot_docs is null").select(lines.columns)
        judged = marked.filter((F.col("hot_docs") >= min_docs) & (F.col("d") != F.col("hot_last"))).select("d", "t", "pos")
    key = Window.partitionBy("h1", "h2")
    ranked = (
        cold.repartitionByRange("h1", "h2")
        .sortWithinPartitions("h1", "h2", F.desc("d"), "pos")
        .withColumn("nth", F.dense_rank().over(key.orderBy(F.desc("d"))))
        .withColumn("n_docs", F.max("nth").over(key))
    )
    dropped = ranked.filter((F.col("n_docs") >= min_docs) & (F.col("nth") > 1)).select("d", "t", "pos")
    if judged is not None:
        dropped = dropped.unionByName(judged)
    places = dropped.groupBy("d", "t").agg(F.array_sort(F.collect_set("pos")).alias("p"))
    p = F.col("p")
    edges = places.select(
        "d",
        "t",
        F.size("p").cast("long").alias("n_dropped"),
        F.filter(p, lambda x, i: (i == 0) | (F.get(p, i - 1) < x - 1)).alias("s"),
        F.filter(p, lambda x, i: (i == F.size(p) - 1) | (F.get(p, i + 1) > x + 1)).alias("e"),
    )
    edges = edges.withColumn("b", F.flatten(F.zip_with("s", "e", lambda s, e: F.array(s, e + 1))))
    b = F.col("b")
    runs = F.transform(b, lambda x, i: x - F.when(i == 0, 0).otherwise(F.get(b, i - 1)))
    return edges.select("d", "t", runs.alias("runs"), "n_dropped")


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with text_col reduced to its kept lines, joined by newlines, and __n_lines, __n_dropped (long).

    A document without a bitmap keeps its text; a null text becomes the empty one. All other columns stay, but for those
    with the names of the added ones, which are replaced.
    """
    docs = docs.drop("__d", "__t", "__runs", "__mask", "__n_lines", "__n_dropped")
    text = F.coalesce(F.col(text_col), F.lit(""))
    keyed = docs.withColumn("__d", F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID))).withColumn("__t", F.xxhash64(text))
    maps = bitmaps.select(*(F.col(c).alias(f"__{c}") for c in ("d", "t", "runs", "n_dropped")))
    joined = keyed.join(maps.hint("shuffle_hash"), ["__d", "__t"], "left")
    mask = F.flatten(F.transform("__runs", lambda n, i: F.array_repeat(i % 2 == 0, n)))
    joined = joined.withColumn("__mask", mask)
    lines = F.split(text, "\n", -1)
    kept = F.array_join(F.filter(lines, lambda _, i: F.coalesce(F.get("__mask", i), F.lit(True))), "\n")
    joined = joined.withColumn("__n_lines", F.size(lines).cast("long"))
    joined = joined.withColumn(text_col, F.when(F.col("__runs").isNull(), text).otherwise(kept))
    joined = joined.withColumn("__n_dropped", F.coalesce("__n_dropped", F.lit(0).cast("long")))
    return joined.select(*docs.columns, "__n_lines", "__n_dropped")


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """docs without the repeated lines: `keep_bitmaps` laid over the texts by `apply_bitmaps`."""
    return apply_bitmaps(docs, keep_bitmaps(docs, id_col, text_col, min_chars, min_docs), id_col, text_col)


def op1_line_dedup(spark, sf_dir: str) -> DataFrame:
    from lineweave.llm.common import table

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    done = line_dedup(docs)
    return done.select(
        "doc_id",
        F.col("__n_lines").alias("n_lines"),
        F.col("__n_dropped").alias("n_dropped"),
        F.sha2("text", 256).alias("kept_sha256"),
    )


ORACLE = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
k AS (SELECT doc_id, pos, line, translate(regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''),
             'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
g AS (SELECT key, max(doc_id) AS last_doc FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
m AS (SELECT k.doc_id, k.pos, k.line, g.key IS NOT NULL AND k.doc_id <> g.last_doc AS gone FROM k LEFT JOIN g USING (key))
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
