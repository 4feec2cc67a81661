"""Vocabularies, character sets, coverage and word occurrences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lineweave.functions import text as X


def word_counts(rows: DataFrame, column: str, by: list[str] | None = None) -> DataFrame:
    """(by, word, n): lower-cased words without marks at their ends; blank and numeric ones go.

    Words are counted as they stand first, so that marks are taken off each of them once.
    """
    by = by or []
    raw = rows.select(*by, F.explode(F.split(F.lower(column), X.BLANK)).alias("w")).filter("w <> ''").groupBy(*by, "w").agg(F.count("*").alias("n"))
    words = raw.select(*by, X.strip_punct("w").alias("word"), "n")
    return words.filter((F.col("word") != "") & ~F.col("word").rlike("^[0-9]+$")).groupBy(*by, "word").agg(F.sum("n").alias("n"))


def subtract_counts(these: DataFrame, known: DataFrame) -> DataFrame:
    """(word, n): what remains of these counts after the known ones, where that is positive."""
    left = these.join(known.select("word", F.col("n").alias("k")), "word", "left")
    return left.select("word", (F.col("n") - F.coalesce("k", F.lit(0))).alias("n")).filter("n > 0")


def except_words(these: DataFrame, known: DataFrame) -> DataFrame:
    """(word) of these that known lacks."""
    return these.select("word").join(known, "word", "left_anti")


def coverage_report(these: DataFrame, known: DataFrame) -> DataFrame:
    """Tokens and types, how many are unknown, and their share of the tokens in percent."""
    marked = these.join(known.select("word", F.lit(True).alias("known")), "word", "left")
    new = F.col("known").isNull()
    sums = marked.agg(
        F.sum("n").alias("total"), F.count("*").alias("unique_words"), F.sum(F.when(new, F.col("n")).otherwise(0)).alias("unknown"), F.count_if(new).alias("unknown_unique")
    )
    return sums.withColumn("unknown_percent", F.round(F.try_divide(F.col("unknown") * F.lit(100.0), F.col("total")), 6))


def one_off(word: Column) -> Column:
    """The word and all that one deletion makes of it: words one edit apart share such a form."""
    cuts = F.transform(F.sequence(F.lit(1), F.char_length(word)), lambda i: F.concat(F.substring(word, F.lit(1), i - 1), F.substring(word, i + 1, F.char_length(word))))
    return F.array_distinct(F.concat(F.array(word), cuts))


def similar_words(unknown: DataFrame, known: DataFrame) -> DataFrame:
    """(word, similar): pairs at edit distance 1, neither holding the other.

    Words meet on shared deletion forms, an equi-join, instead of a comparison of all with all; the distance is then checked.
    """
    a = unknown.select("word", F.explode(one_off(F.col("word"))).alias("form"))
    b = known.select(F.col("word").alias("similar"), F.explode(one_off(F.col("word"))).alias("form"))
    met = a.join(b, "form").select("word", "similar").distinct()
    inside = F.contains("word", F.col("similar")) | F.contains("similar", F.col("word"))
    return met.filter((F.levenshtein("word", "similar", 1) == 1) & ~inside)


def charsets(rows: DataFrame, column: str, by: str) -> DataFrame:
    """(by, chars): the distinct characters of each project: at most as many as there are code points."""
    chars = rows.select(by, F.explode(F.array_distinct(F.split(column, ""))).alias("ch")).filter("ch <> ''")
    return chars.distinct().groupBy(by).agg(F.collect_set("ch").alias("chars"))


def charset_similarity(sets: DataFrame, by: str) -> DataFrame:
    """(a, b, similarity) of all unordered pairs of projects: 100 (1 - |A-B|/|A|) (1 - |B-A|/|B|)."""
    a, b = sets.select(F.col(by).alias("a"), F.col("chars").alias("x")), sets.select(F.col(by).alias("b"), F.col("chars").alias("y"))
    lost = lambda p, q: 1 - F.size(F.array_except(p, q)) / F.size(p)
    both = a.join(b, F.col("a") < F.col("b"))  # a row per project
    return both.select("a", "b", F.round(lost("x", "y") * lost("y", "x") * 100, 6).alias("similarity"))


def token_occurrences(lines: DataFrame, tokens: list[str], key: str, line_no: str, column: str, most: int = 10) -> DataFrame:
    """(token, key, n, lines, truncated): how often each token occurs in each file, and its first line numbers.

    A leading piece mark asks for a word begin. Of a token's lines in a file only the first `most` are gathered (A14).
    """
    count = lambda t: F.when(F.col(column).contains(t.lstrip("▁")), F.regexp_count(column, F.lit(pattern(t)))).otherwise(0).cast("bigint")
    found = F.filter(F.array(*(F.struct(F.lit(t).alias("token"), count(t).alias("n")) for t in tokens)), lambda x: x["n"] > 0)
    each = lines.select(key, line_no, F.explode(found).alias("t")).select(key, line_no, "t.*")
    placed = each.withColumn("place", F.row_number().over(Window.partitionBy("token", key).orderBy(line_no)))
    found = placed.groupBy("token", key).agg(F.sum("n").alias("n"), F.array_sort(F.collect_list(F.when(F.col("place") <= most, F.col(line_no)))).alias("first"), F.count("*").alias("all"))
    return found.select("token", key, "n", F.array_join("first", ",").alias("lines"), (F.col("all") > most).alias("truncated"))


def pattern(token: str) -> str:
    import re

    return f"(?:^|[ \\t]){re.escape(token[1:])}" if token.startswith("▁") else re.escape(token)


def verse_counts(lines: DataFrame, project: str, book: str, column: str) -> DataFrame:
    """(project, book, verses): non-blank lines."""
    return lines.filter(X.strip(column) != "").groupBy(project, book).agg(F.count("*").alias("verses"))


def verse_matrix(counts: DataFrame, project: str, book: str, books: list[str]) -> DataFrame:
    """A row per project, a column per book, all books not listed together, and the total; a missing book counts 0."""
    each = [F.coalesce(F.sum(F.when(F.col(book) == b, F.col("verses"))), F.lit(0)).alias(b) for b in books]
    other = F.coalesce(F.sum(F.when(~F.col(book).isin(books), F.col("verses"))), F.lit(0)).alias("other")
    return counts.groupBy(project).agg(*each, other, F.sum("verses").alias("total"))


def verse_totals(counts: DataFrame, project: str, testament: Column) -> DataFrame:
    """(project, testament, books, verses): per testament, and over all of them where testament is null."""
    rows = counts.withColumn("testament", testament)
    return rows.groupingSets([[F.col(project), F.col("testament")], [F.col(project)]], project, "testament").agg(F.count("*").alias("books"), F.sum("verses").alias("verses"))


def verse_percentages(counts: DataFrame, project: str, book: str) -> DataFrame:
    """Each book's verses as a percentage of the fullest project's."""
    complete = counts.groupBy(book).agg(F.max("verses").alias("complete"))
    return counts.join(complete, book).select(project, book, (F.round(F.col("verses") / F.col("complete"), 3) * 100).alias("percent"))


def coverage_marks(counts: DataFrame, projects: DataFrame, project: str, book: str, full: float = 0.98) -> DataFrame:
    """A mark for each project and book: full, part or none (Q05)."""
    complete = counts.groupBy(book).agg(F.max("verses").alias("complete"))
    grid = complete.crossJoin(F.broadcast(projects))  # books by projects: both are dimensions
    share = F.coalesce("verses", F.lit(0)) / F.col("complete")
    mark = F.when(share >= full, "✓").when(share > 0, "~").otherwise("X")
    return grid.join(counts, [project, book], "left").select(project, book, mark.alias("mark"))


def containing(groups: DataFrame, have: str, need: list[str]) -> DataFrame:
    """Rows whose array holds all of need."""
    return groups.filter(F.size(F.array_except(F.array(*map(F.lit, need)), F.col(have))) == 0)


def running_rank(rows: DataFrame, part: list[str], score: str, size: str, tie: str) -> DataFrame:
    """Place by falling score within the part, and the running total of size (W02, W03). For dimensions."""
    by = Window.partitionBy(*part).orderBy(F.desc(score), tie)
    return rows.withColumn("place", F.rank().over(Window.partitionBy(*part).orderBy(F.desc(score)))).withColumn("cumulative", F.sum(size).over(by.rowsBetween(Window.unboundedPreceding, 0)))
