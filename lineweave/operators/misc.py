"""Smaller operators: hygiene rules, stamps, maps, hashes, sub-lists, sorting of verse numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lineweave.functions import text as X


#: Characters of words in any script.
WORD = r"[\p{L}\p{M}\p{N}_]"


def date_stamp(c: Column | str) -> Column:
    """The date of names that end in _YYYY_MM_DD; null without one."""
    return F.try_to_date(F.regexp_extract(X.col(c), r"_(\d{4}_\d{2}_\d{2})$", 1), "yyyy_MM_dd")


def stem_parts(c: Column | str) -> list[Column]:
    """iso and project of `iso-project_date` names."""
    return [F.regexp_extract(X.col(c), "^([a-z]{2,3})-", 1).alias("iso"), F.regexp_extract(X.col(c), r"^[a-z]{2,3}-(.*?)(?:_\d{4}_\d{2}_\d{2})?$", 1).alias("project")]


def keep_or_delete(files: DataFrame, now: Column, months: int, protected: str) -> DataFrame:
    """A verdict and its rule for each file (name, modified): protected patterns stay, odd bytes and old files go."""
    rule = F.when(F.col("name").rlike(protected), "protected").when(~F.is_valid_utf8("name"), "encoding").when(F.col("modified") < F.add_months(now, -months), "age").otherwise("fresh")
    return files.withColumn("rule", rule).withColumn("keep", F.col("rule").isin("protected", "fresh"))


def consistency(top: DataFrame, lexicon: DataFrame) -> DataFrame:
    """100 over the mean number of renderings of the frequent words."""
    sizes = lexicon.join(top.select(F.col("word").alias("src")), "src").groupBy("src").agg(F.count_distinct("trg").alias("n"))
    return sizes.agg(F.round(100 / F.avg("n"), 4).alias("consistency"))


def quality_flags(rows: DataFrame, by: list[str], rules: dict[str, Column]) -> DataFrame:
    """For each rule whether any and whether all rows of a group fulfil it."""
    return rows.groupBy(*by).agg(*(f(c).alias(f"{how}_{name}") for name, c in rules.items() for how, f in (("any", F.bool_or), ("all", F.bool_and))))


def surface_pattern(rendering: Column) -> Column:
    """A rendering as a regular expression: ** stands for some words, * for the rest of a word in any script, all else for
    itself (C12)."""
    quoted = F.regexp_replace(rendering, r"([.^$+?()\[\]{}|\\])", r"\\$1")
    return F.replace(F.replace(quoted, F.lit(" ** "), F.lit(f"(?: {WORD}+){{0,}} ")), F.lit("*"), F.lit(f"{WORD}{{0,}}"))


def surface_forms(renderings: DataFrame, verses: DataFrame) -> DataFrame:
    """(id, form): what each rendering's pattern finds in the verses it is said to stand in.

    renderings: id, rendering, refs. verses: ref, text.
    """
    each = renderings.select("id", surface_pattern(F.col("rendering")).alias("p"), F.explode("refs").alias("ref")).join(verses, "ref")
    return each.select("id", F.explode(F.regexp_extract_all("text", F.col("p"), F.lit(0))).alias("form")).distinct()


def without_sublists(lists: Column, prefix_only: bool = False) -> Column:
    """Lists that no other, longer one contains as a run (or, with prefix_only, begins with)."""

    def within(a: Column, b: Column) -> Column:
        places = F.sequence(F.lit(1), F.lit(1) if prefix_only else F.greatest(F.size(b) - F.size(a) + 1, F.lit(1)))
        return (F.size(a) < F.size(b)) & F.exists(places, lambda i: F.slice(b, i, F.size(a)) == a)

    return F.filter(lists, lambda a: ~F.exists(lists, lambda b: within(a, b)))


def nearest(points: DataFrame, lat: float, lon: float, k: int = 30) -> DataFrame:
    """The k points of least squared distance in degrees."""
    gap = F.pow(F.col("lat") - lat, 2) + F.pow(F.col("lon") - lon, 2)
    return points.withColumn("gap", gap).orderBy("gap", "name").limit(k)


def inverted(rows: DataFrame, key: str, values: str) -> DataFrame:
    """(value, keys): which keys hold each value, ascending."""
    return rows.select(key, F.explode(F.array_distinct(values)).alias("value")).groupBy("value").agg(F.array_sort(F.collect_set(key)).alias("keys"))


def content_hash(files: DataFrame, by: list[str]) -> DataFrame:
    """SHA-256 of each group's files, by path and content.

    The lines path:hash are hashed in path order within the 256 classes of the paths' own hashes, and the classes' digests
    in their order, so no row holds more than a 256th of a group.
    """
    each = files.select(*by, "path", F.sha2("content", 256).alias("h")).withColumn("c", F.substring(F.sha2("path", 256), 1, 2))
    told = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("path", "h"))), lambda x: F.concat(x["path"], F.lit(":"), x["h"])), "\n")
    parts = each.groupBy(*by, "c").agg(F.sha2(told.cast("binary"), 256).alias("d"))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("c", "d"))), lambda x: x["d"]), "")
    return parts.groupBy(*by).agg(F.sha2(whole.cast("binary"), 256).alias("hash"))


def durations(rows: DataFrame, by: list[str], start: str, end: str) -> DataFrame:
    """The interval from the first start to the last end of each group."""
    return rows.groupBy(*by).agg((F.max(end) - F.min(start)).alias("duration"))


def lookup_pairs(rows: DataFrame, table: DataFrame, a: str, b: str, value: str) -> DataFrame:
    """rows with table's value for (a, b), else for (b, a), else null."""
    straight = table.select(a, b, F.col(value).alias("_1"))
    turned = table.select(F.col(b).alias(a), F.col(a).alias(b), F.col(value).alias("_2"))
    return rows.join(straight, [a, b], "left").join(turned, [a, b], "left").withColumn(value, F.coalesce("_1", "_2")).drop("_1", "_2")


def related(entities: DataFrame, name: str, groups: list[str]) -> DataFrame:
    """(name, related): entities that share any of these groups with it."""
    each = entities.select(name, F.explode(F.array(*(F.concat_ws(":", F.lit(g), F.col(g).cast("string")) for g in groups))).alias("g"))
    return each.join(each.withColumnRenamed(name, "related"), "g").filter(F.col(name) != F.col("related")).select(name, "related").distinct()


def verse_order(c: Column | str) -> list[Column]:
    """Sort keys of verse numbers like 15-16: first verse, then last."""
    part = lambda k: F.split_part(X.col(c), F.lit("-"), F.lit(k)).try_cast("int")
    return [part(1), F.coalesce(part(2), part(1))]
