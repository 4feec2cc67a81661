"""File sources (S01-S20): every schema is stated, and a line's number is its key."""

from __future__ import annotations

from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lineweave.functions import text as X
from lineweave.session import written
from lineweave.sources import usfm

#: The books in canonical order, three letters each.
BOOKS = (
    "GEN EXO LEV NUM DEU JOS JDG RUT 1SA 2SA 1KI 2KI 1CH 2CH EZR NEH EST JOB PSA PRO ECC SNG ISA JER LAM EZK DAN HOS JOL AMO "
    "OBA JON MIC NAM HAB ZEP HAG ZEC MAL MAT MRK LUK JHN ACT ROM 1CO 2CO GAL EPH PHP COL 1TH 2TH 1TI 2TI TIT PHM HEB JAS 1PE "
    "2PE 1JN 2JN 3JN JUD REV"
).split()


def line_scan(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no, text): stripped lines with their numbers from 1 (S01). A file is one row while it is
    split, which keeps its order; for files that are no such size see `large_line_scan`."""
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), F.regexp_replace("value", "^\ufeff", "").alias("v"))
    lines = whole.select("file", F.posexplode(F.split(F.regexp_replace("v", "\r?\n\\z", ""), "\r?\n", -1)).alias("pos", "text"))
    return lines.select("file", (F.col("pos") + 1).cast("bigint").alias("line_no"), X.strip("text").alias("text"))


def large_line_scan(spark: SparkSession, path: str) -> DataFrame:
    """The same for files of any size: splits of a file are read by many tasks, and the counts of the splits before (a row
    each) turn a line's place in its split into its number. Written once, so that numbers and counts belong together."""
    at = F.col("_metadata")
    rows = spark.read.text(path, lineSep="\n").select(at.getField("file_name").alias("file"), at.getField("file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), "value")
    rows = written(rows, "lines")
    splits = rows.groupBy("file", "block").agg(F.min("at").alias("low"), F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    numbered = rows.join(splits.select("file", "block", (before - F.col("low") + 1).alias("shift")), ["file", "block"])
    line_no, bare = F.col("at") + F.col("shift"), F.regexp_replace("value", "^\ufeff", "")
    return numbered.select("file", line_no.alias("line_no"), X.strip(F.when(line_no == 1, bare).otherwise(F.col("value"))).alias("text"))


def parallel_scan(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """(line_no, one column a path): lines by number, as many as the shortest file has."""
    out = None
    for name, path in paths.items():
        side = line_scan(spark, path).select("line_no", F.col("text").alias(name))
        out = side if out is None else out.join(side, "line_no")
    return out


def verse_refs(lines: DataFrame, column: str = "text") -> DataFrame:
    """line_no, book, chapter, verse of references like `GEN 1:1`."""
    part = lambda k: F.regexp_extract(column, r"^(\S+) (\d+):(.+)$", k)
    return lines.select("line_no", part(1).alias("book"), F.expr(f"try_cast(regexp_extract({column}, '^(\\\\S+) (\\\\d+):(.+)$', 2) AS int)").alias("chapter"), part(3).alias("verse"))


def book_dimension(spark: SparkSession) -> DataFrame:
    """(book, book_num, testament) in canonical order."""
    return spark.createDataFrame([(b, i + 1, "OT" if i < 39 else "NT") for i, b in enumerate(BOOKS)], "book string, book_num int, testament string")


def terms(metadata: DataFrame, glosses: DataFrame, renderings: DataFrame, vrefs: DataFrame, name: str) -> DataFrame:
    """Key terms from four line tables: id, cat, domain, and lists from tab-separated cells."""
    cells = lambda df, out: df.select("line_no", F.filter(F.split("text", "\t"), lambda x: x != "").alias(out))
    head = metadata.filter("text <> ''").select("line_no", F.concat(F.lit(f"{name}:"), F.split_part("text", F.lit("\t"), F.lit(1))).alias("id"), F.split_part("text", F.lit("\t"), F.lit(2)).alias("cat"), F.split_part("text", F.lit("\t"), F.lit(3)).alias("domain"))
    for df, out in ((glosses, "glosses"), (renderings, "renderings"), (vrefs, "vrefs")):
        head = head.join(cells(df, out), "line_no", "left")
    return head.drop("line_no")


def scored_tsv(spark: SparkSession, path: str) -> DataFrame:
    """src, trg, hash, score."""
    return spark.read.csv(path, sep="\t", quote="", schema="src string, trg string, hash string, score double")


def repaired_tsv(lines: DataFrame, columns: int) -> DataFrame:
    """(file, id, cells): rows of a TSV whose cells were broken over lines.

    A line that does not begin with a numeric id goes on where the last cell of the row before broke off.
    Groups are numbered by a running count within the file.
    """
    starts = F.col("text").rlike(r"^\d+\t").cast("int")
    numbered = lines.withColumn("grp", F.sum(starts).over(Window.partitionBy("file").orderBy("line_no"))).filter("grp > 0")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("line_no", "text"))), lambda x: x["text"])
    rows = numbered.groupBy("file", "grp").agg(F.split(F.array_join(ordered, " "), "\t").alias("cells"))
    return rows.filter(F.size("cells") >= columns).select("file", F.get("cells", F.lit(0)).cast("bigint").alias("id"), "cells")


def csv_scores(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """All-string CSVs under a folder, bad lines dropped, with series and experiment from each path."""
    rows = spark.read.option("recursiveFileLookup", True).csv(path, header=True, mode="DROPMALFORMED", schema=", ".join(f"`{c}` string" for c in columns), pathGlobFilter="scores-*.csv")
    at = F.col("_metadata.file_path")
    return rows.select("*", F.regexp_extract(at, r"([^/]+)/[^/]+/[^/]+$", 1).alias("series"), F.regexp_extract(at, r"([^/]+)/[^/]+$", 1).alias("experiment"), F.regexp_extract(at, r"scores-(\d+)\.csv$", 1).alias("steps"))


def usfm_books(spark: SparkSession, path: str) -> DataFrame:
    """(file, content) of marked-up books, read by Spark from any store."""
    files = spark.read.format("binaryFile").load(path)
    return files.select(F.col("_metadata.file_name").alias("file"), F.regexp_replace(F.decode("content", "UTF-8"), "^\ufeff", "").alias("content"))


def book_verses(books: DataFrame) -> DataFrame:
    """(file, book, chapter, verse, text) of marked-up books (file, content): one row a verse; a range of verses becomes its
    text at the first and <range> at the others (S08). Text in any style counts, but for notes, figures, headings, remarks,
    numbers beside the text and attributes."""

    def parse(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield pd.DataFrame([(f, *row) for f, content in zip(part["file"], part["content"], strict=True) for row in usfm_rows(content)], columns=["file", "book", "chapter", "verse", "text"])

    return books.select("file", "content").mapInPandas(parse, "file string, book string, chapter int, verse int, text string")


def usfm_verses(spark: SparkSession, path: str) -> DataFrame:
    """`book_verses` of the marked-up books in files."""
    return book_verses(usfm_books(spark, path))


def usfm_rows(content: str) -> list[tuple[str, int, int, str]]:
    return usfm.verse_rows(content)


def usfm_updated(books: DataFrame, verses: DataFrame, keep_styles: bool = True) -> DataFrame:
    """(file, content): marked-up books (file, content: string) with the text of some verses (file, chapter, verse, text)
    replaced (K07). What is not replaced comes back character by character. A book is one row, as its verses are."""
    new = verses.groupBy("file").agg(F.collect_list(F.struct("chapter", "verse", "text")).alias("new"))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            changes = [{(v["chapter"], v["verse"]): v["text"] for v in (new if new is not None else ())} for new in part["new"]]
            yield pd.DataFrame({"file": part["file"], "content": [usfm.updated(c, x, keep_styles) for c, x in zip(part["content"], changes, strict=True)]})

    return books.select("file", "content").join(new, "file", "left").mapInPandas(run, "file string, content string")


def to_vref_lines(verses: DataFrame, refs: DataFrame) -> DataFrame:
    """(line_no, text) for every reference line; blank where the project has no such verse."""
    own = verses.select("book", "chapter", F.col("verse").cast("string").alias("verse"), "text")
    return refs.join(own, ["book", "chapter", "verse"], "left").select("line_no", F.coalesce("text", F.lit("")).alias("text"))


def lemma_line(surface: Column, lemma: Column) -> Column:
    """Surface tokens with their lemma in place: what stands before | without <morphs>, within the surface's own
    leading and trailing punctuation (S09)."""

    def one(pair: Column) -> Column:
        word = F.regexp_replace(F.regexp_extract(pair["l"], r"^([^|]*)", 1), "<[^>]*>", "")
        edge = lambda p: F.regexp_extract(pair["s"], p, 1)
        return F.concat(edge(r"^([\p{P}\p{S}]*)"), word, edge(r"([\p{P}\p{S}]*)$"))

    both = F.zip_with(X.tokens(surface), X.tokens(lemma), lambda s, x: F.struct(F.coalesce(s, F.lit("")).alias("s"), F.coalesce(x, F.lit("")).alias("l")))
    return F.array_join(F.transform(both, one), " ")


def xml_rows(spark: SparkSession, path: str, row_tag: str, schema: str) -> DataFrame:
    """Rows of an XML file by tag."""
    return spark.read.format("xml").option("rowTag", row_tag).schema(schema).load(path)


def interlinear(items: DataFrame) -> DataFrame:
    """A column a language from (line_no, lang, text) rows; a missing one is empty."""
    langs = [r.lang for r in items.select("lang").distinct().orderBy("lang").collect()]  # languages: a few
    return items.groupBy("line_no").pivot("lang", langs).agg(F.first("text")).na.fill("")


def gold_alignments(spark: SparkSession, path: str) -> DataFrame:
    """(vref, src, trg, links): links of many tokens are taken apart, only the first pair of each is sure."""
    schema = "vref string, source array<string>, target array<string>, links array<struct<source: array<int>, target: array<int>, sure: boolean>>"
    return gold_links(spark.read.schema(schema).json(path, multiLine=True))


def gold_links(rows: DataFrame) -> DataFrame:
    """(vref, src, trg, links) of rows with source, target (words) and links (source, target: places, sure)."""
    safe = lambda c: F.transform(c, lambda t: F.replace(t, F.lit(" "), F.lit("~"))).alias(c)
    pairs = F.flatten(
        F.transform(
            "links",
            lambda x: F.flatten(F.transform(x["source"], lambda s, a: F.transform(x["target"], lambda t, b: F.struct(s.alias("i"), t.alias("j"), (x["sure"] & (a == 0) & (b == 0)).alias("sure"))))),
        )
    )
    return rows.select("vref", safe("source").alias("src"), safe("target").alias("trg"), pairs.alias("links"))


def alignment_lines(lines: DataFrame) -> DataFrame:
    """(line_no, i, j, p) of lines like `0-1 2-2:0.5`; # begins a comment."""
    links = lines.filter("NOT startswith(text, '#')").select("line_no", F.explode(X.tokens("text")).alias("l"))
    part = lambda k, kind: F.regexp_extract("l", r"^(\d+)-(\d+)(?::(.+))?$", k).try_cast(kind)
    return links.select("line_no", part(1, "int").alias("i"), part(2, "int").alias("j"), part(3, "double").alias("p"))


def lexicon_lines(lines: DataFrame, log_prob: bool = False, special: bool = False, least: float = 0.01) -> DataFrame:
    """(src, trg, prob) of tab-separated lines; log probabilities are kept only above `least`."""
    cell = lambda k: F.split_part("text", F.lit("\t"), F.lit(k))
    rows = lines.filter("text <> '' AND NOT startswith(text, '#')").select(cell(1).alias("src"), cell(2).alias("trg"), cell(3).try_cast("double").alias("prob"))
    if log_prob:
        rows = rows.withColumn("prob", F.exp("prob")).filter(F.col("prob") > least)
    return rows if special else rows.filter(~F.col("src").isin("NULL", "<eps>") & ~F.col("trg").isin("NULL", "<eps>"))


def verse_log(lines: DataFrame) -> DataFrame:
    """(file, stem, verses): counts in a log belong to the project named last before them; its last count holds."""
    stem = F.regexp_extract("text", r"Extracting (\S+)", 1)
    by = Window.partitionBy("file").orderBy("line_no")
    marked = lines.withColumn("stem", F.last(F.when(stem != "", stem), ignorenulls=True).over(by)).withColumn("verses", F.regexp_extract("text", r"# of Verses: *(\d+)", 1).try_cast("int"))
    return marked.filter("verses IS NOT NULL AND stem IS NOT NULL").groupBy("file", "stem").agg(F.max_by("verses", "line_no").alias("verses"))


def languages(spark: SparkSession, path: str, one_list: bool = True) -> DataFrame:
    """Language metadata from a JSON list, or from an object a line."""
    return spark.read.schema("isoCode string, language string, langCountry string, languageFamily string").json(path, multiLine=one_list)


def related(data: DataFrame, isos: list[str]) -> DataFrame:
    """(isoCode) of languages that share a country or family with one of isos."""
    own = data.filter(F.col("isoCode").isin(isos)).select(F.col("langCountry").alias("c"), F.col("languageFamily").alias("f"))
    near = (F.col("langCountry") == F.col("c")) | (F.col("languageFamily") == F.col("f"))
    return data.join(F.broadcast(own), near, "left_semi").select("isoCode").distinct()  # own: a row per iso asked for


def files_by_iso(spark: SparkSession, folder: str, isos: list[str]) -> DataFrame:
    """(file, iso) of text files named `iso-...`."""
    names = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(folder).select(F.col("_metadata.file_name").alias("file"))
    return names.withColumn("iso", F.regexp_extract("file", "^([a-z]{2,3})-", 1)).filter(F.col("iso").isin(isos))


def merged_config(*layers: dict) -> dict:
    """Settings laid over each other, nested ones key by key; the later wins."""
    out: dict = {}
    for layer in layers:
        for key, value in layer.items():
            out[key] = merged_config(out[key], value) if isinstance(value, dict) and isinstance(out.get(key), dict) else value
    return out


def load_config(folder: str, root: str, defaults: dict, name: str = "config.yml") -> dict:
    """Defaults, then the config of each folder from root down to folder."""
    import yaml

    path, top = Path(folder), Path(root)
    above = [p for p in [*reversed(path.parents), path] if p == top or top in p.parents]
    found = [yaml.safe_load((p / name).read_text(encoding="utf-8")) or {} for p in above if (p / name).exists()]
    return merged_config(defaults, *found)


def translation(src: Column, trg: Column, src_lang: str, trg_lang: str) -> Column:
    """Both sides as one struct named translation, as training sets have it."""
    return F.struct(src.alias(src_lang), trg.alias(trg_lang)).alias("translation")


def translation_rows(pairs: DataFrame, src: str, trg: str) -> DataFrame:
    """(translation: struct of both languages)."""
    return pairs.select(translation(F.col("src"), F.col("trg"), src, trg))


def last_verse(verses: DataFrame, book: str, chapter: int) -> DataFrame:
    """(file, last): the last verse of a chapter in each file of `usfm_verses`."""
    return verses.filter((F.col("book") == book) & (F.col("chapter") == chapter)).groupBy("file").agg(F.max("verse").alias("last"))
