"""Row-aligned corpora: lines, pairs, range folding, predicates, joins and unions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A line that belongs to the one before, and one without a text.
RANGE, PLACEHOLDER = "<range>", "..."


def explode_lines(docs: DataFrame, text: str = "text") -> DataFrame:
    """A row per line with its line_no from 1: the explicit key that everything else joins on."""
    keep = [c for c in docs.columns if c != text]
    return docs.select(*keep, F.posexplode(F.split(text, "\n", -1)).alias("pos", "line")).select(
        *keep, (F.col("pos") + 1).cast("bigint").alias("line_no"), "line"
    )


def reply_pairs(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, src, trg): each user turn and the assistant's next one."""
    user = conversations.filter("role = 'user'").select("conv_id", "turn", F.col("text").alias("src"))
    reply = conversations.filter("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("trg"))
    return user.join(reply, ["conv_id", "turn"])


def parallel_join(left: DataFrame, right: DataFrame, key: list[str]) -> DataFrame:
    """Positional pairing of two keyed line tables; lines without a partner go, as in zip."""
    return left.join(right, key)


def fold_ranges(pairs: DataFrame, part: list[str], order: str, src: str = "src", trg: str = "trg") -> DataFrame:
    """Rows with <range> on a side are merged into the row before.

    A row is an anchor unless a side is <range>; the running count of anchors within `part` numbers the groups.
    Texts that are neither empty nor <range> are blank-joined in order; the group keeps its anchor's key. Rows
    before the first anchor form group 0. Windows are per part, never global.
    """
    by = Window.partitionBy(*part).orderBy(order)
    anchor = ((F.col(src) != RANGE) & (F.col(trg) != RANGE)).cast("int")
    numbered = pairs.withColumn("grp", F.sum(anchor).over(by))

    def merged(side: str) -> Column:
        own = F.when((F.col(side) != "") & (F.col(side) != RANGE), F.col(side))
        ordered = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), own.alias("t"))))
        return F.array_join(F.filter(F.transform(ordered, lambda x: x["t"]), lambda t: t.isNotNull()), " ").alias(side)

    return numbered.groupBy(*part, "grp").agg(F.min(order).alias(order), F.max(order).alias("last"), merged(src), merged(trg))


def drop_empty(pairs: DataFrame, src: str = "src", trg: str = "trg") -> DataFrame:
    """Pairs in which neither side is empty or a placeholder."""
    return pairs.filter(~F.col(src).isin("", PLACEHOLDER) & ~F.col(trg).isin("", PLACEHOLDER))


def keep_one_sided(pairs: DataFrame, src: str = "src", trg: str = "trg") -> DataFrame:
    """Placeholders become empty; only pairs with both sides empty go."""
    blank = lambda c: F.when(F.col(c) == PLACEHOLDER, "").otherwise(F.col(c))
    return pairs.withColumn(src, blank(src)).withColumn(trg, blank(trg)).filter((F.col(src) != "") | (F.col(trg) != ""))


def include_chapters(rows: DataFrame, selection: DataFrame) -> DataFrame:
    """Rows whose (book, chapter) is selected; a selection row without a chapter takes the whole book."""
    wanted = (rows.book == selection.book) & (selection.chapter.isNull() | (rows.chapter == selection.chapter))
    return rows.join(F.broadcast(selection), wanted, "left_semi")  # a selection is a setting, some rows


def exclude_chapters(rows: DataFrame, selection: DataFrame) -> DataFrame:
    """The complement of `include_chapters`."""
    wanted = (rows.book == selection.book) & (selection.chapter.isNull() | (rows.chapter == selection.chapter))
    return rows.join(F.broadcast(selection), wanted, "left_anti")


def score_filter(rows: DataFrame, threshold: float, score: str, key: list[str], part: list[str]) -> DataFrame:
    """Below 1: rows of a score over the threshold; from 1 on: all but that many lowest of each part."""
    if threshold < 1:
        return rows.filter(F.col(score) > threshold)
    low = Window.partitionBy(*part).orderBy(score, *key)
    return rows.withColumn("_low", F.row_number().over(low)).filter(F.col("_low") > int(threshold)).drop("_low")


def quantile_filter(rows: DataFrame, q: float, score: str, part: list[str]) -> DataFrame:
    """Rows over the q-quantile (linear between neighbours) of their part's scores."""
    from lineweave.operators.splits import quantiles

    cut = quantiles(rows, part, score, [q]).select(*part, F.get("cuts", 0).alias("cut"))
    return (rows.join(cut, part) if part else rows.crossJoin(F.broadcast(cut))).filter(F.col(score) > F.col("cut")).drop("cut")  # one row


def mirror(pairs: DataFrame, src: str = "src", trg: str = "trg") -> DataFrame:
    """All pairs, and all with their sides swapped (F21, U01); mirrored tells them apart."""
    other = [c for c in pairs.columns if c not in (src, trg)]
    straight = pairs.select(*other, src, trg, F.lit(False).alias("mirrored"))
    return straight.unionByName(pairs.select(*other, F.col(trg).alias(src), F.col(src).alias(trg), F.lit(True).alias("mirrored")))


def add_tags(rows: DataFrame, tags: list[str], column: str) -> DataFrame:
    """Each tag and a blank put before the text."""
    return rows.withColumn(column, F.concat(F.lit("".join(f"<{t}> " for t in tags)), F.col(column)))


def combine_first(left: DataFrame, right: DataFrame, key: list[str]) -> DataFrame:
    """Full outer join; columns that both have take the left value, else the right one."""
    shared = [c for c in left.columns if c in right.columns and c not in key]
    renamed = right.select(*key, *(F.col(c).alias(f"_{c}" if c in shared else c) for c in right.columns if c not in key))
    joined = left.join(renamed, key, "full_outer")
    rest = [c for c in renamed.columns if c not in key and c not in {f"_{s}" for s in shared}]
    own = [F.coalesce(c, f"_{c}").alias(c) if c in shared else F.col(c) for c in left.columns if c not in key]
    return joined.select(*key, *own, *rest)


def pick_source(rows: DataFrame, columns: list[str], key: Column, seed: str, out: str = "picked") -> DataFrame:
    """One of the non-empty columns of each row, picked by a hash of its key."""
    from lineweave.functions.text import uniform

    there = F.filter(F.array(*columns), lambda x: x.isNotNull() & (x != ""))
    place = F.floor(uniform(F.lit(seed), key) * F.size(there)).cast("int")
    return rows.withColumn(out, F.when(F.size(there) > 0, F.get(there, place)))


def keyed_overwrite(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """new, and the rows of old whose key it lacks."""
    return old.join(new.select(*key).distinct(), key, "left_anti").unionByName(new, allowMissingColumns=True)


def expand_pairs(sources: DataFrame, targets: DataFrame, many_to_many: bool) -> DataFrame:
    """Corpus pairs of source and target files (J06): by position, or each with each. Both are plans of some rows."""
    if many_to_many:
        return sources.crossJoin(F.broadcast(targets))
    return sources.join(targets, "position").drop("position")
