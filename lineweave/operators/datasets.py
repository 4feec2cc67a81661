"""Data set building and experiment planning."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lineweave.functions import text as X
from lineweave.operators import corpus as C
from lineweave.operators.splits import numbered, split_bands


@dataclass(frozen=True)
class CorpusPair:
    """A corpus pair of the plan with its defaults (X04): sizes below 1 are fractions."""

    src: tuple[str, ...]
    trg: tuple[str, ...]
    kinds: frozenset[str] = frozenset({"train", "test", "val"})
    many_to_many: bool = False
    test_size: float = 250
    val_size: float = 250
    score_threshold: float = 0.0

    def __post_init__(self):
        if unknown := self.kinds - {"train", "test", "val", "dictionary"}:
            raise ValueError(f"unknown kinds: {sorted(unknown)}")
        if not self.src or not self.trg:
            raise ValueError("a pair needs sources and targets")
        if not self.many_to_many and len(self.src) != len(self.trg):
            raise ValueError("one-to-one pairs need as many sources as targets")

    def files(self) -> list[tuple[str, str]]:
        return [(s, t) for s in self.src for t in self.trg] if self.many_to_many else list(zip(self.src, self.trg, strict=True))


def build_dataset(pairs: DataFrame, plan: CorpusPair, part: list[str], order: str, tags: list[str], seed: str, mirrored: bool = False) -> DataFrame:
    """Range folding, empty sides out, split by key, tags on sources, mirrored training rows.

    One draw splits the keys, so all pairs of a verse land in one split.
    """
    folded = C.drop_empty(C.fold_ranges(pairs, part, order))
    split = split_by_plan(folded, [*part, order], plan, seed)
    train = split.filter("split = 'train'")
    rows = split.withColumn("mirrored", F.lit(False))
    if mirrored:
        rows = rows.unionByName(C.mirror(train).filter("mirrored"))
    return C.add_tags(rows, tags, "src")


def split_by_plan(rows: DataFrame, key: list[str], plan: CorpusPair, seed: str) -> DataFrame:
    """Test rows are the first in seeded order, validation rows follow, the rest is for training. Sizes below 1 are fractions."""
    return split_bands(rows, key, [], [("test", plan.test_size), ("val", plan.val_size)], seed)


def route_rows(rows: DataFrame, key: list[str], part: list[str], test: set[int], val: set[int], src: str = "src", trg: str = "trg") -> DataFrame:
    """A split for each non-blank pair by its place among them: test before val before train."""
    full = rows.filter((X.strip(src) != "") & (X.strip(trg) != ""))
    place = F.row_number().over(Window.partitionBy(*part).orderBy(*key)) - 1
    split = F.when(F.col("place").isin(sorted(test)), "test").when(F.col("place").isin(sorted(val)), "val").otherwise("train")
    return full.withColumn("place", place).withColumn("split", split)


def batches(rows: DataFrame, part: list[str], order: list[str], size: int) -> DataFrame:
    """A batch number of `size` rows within each part."""
    return numbered(rows, part, order).withColumn("batch", F.floor((F.col("_r") - 1) / size).cast("bigint")).drop("_r", "_n")


def transpose_drafts(rows: DataFrame, key: list[str], drafts: str) -> DataFrame:
    """(key, draft, text): an array of drafts a sentence to a row a draft."""
    return rows.select(*key, F.posexplode(drafts).alias("draft", "text"))


def rejoin_drafts(rows: DataFrame, key: list[str], order: str) -> DataFrame:
    """Sub-sentences of each row and draft joined in order; the confidence is that of their mean log score, null if one
    has none (X06, M06)."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct(order, "text"))), lambda x: x["text"])
    score = F.when(F.count("log_score") == F.count("*"), F.exp(F.avg("log_score")))
    return rows.groupBy(*key, "draft").agg(F.array_join(ordered, " ").alias("text"), score.alias("confidence"))


def needed_rows(rows: DataFrame, chapters: list[int], longest: int = 200) -> DataFrame:
    """Rows of the chapters that are no notes or remarks; text outside verses is cut into sentences when long."""
    kept = rows.filter(~F.col("marker").isin("rem", "f", "x", "fe") & F.col("chapter").isin(chapters))
    parts = F.when((F.col("marker") != "v") & (F.char_length("text") > longest), F.split(X.strip("text"), r"(?<=[.!?])\s+")).otherwise(F.array("text"))
    return kept.select("*", F.posexplode(parts).alias("part", "piece"))


def chat_prompt(src: Column, trg: Column, system: str, fold_system: bool = False) -> Column:
    """Role and content messages of a translation prompt; fold_system puts the system text into the user's."""
    say = lambda role, c: F.struct(F.lit(role).alias("role"), c.alias("content"))
    if fold_system:
        return F.array(say("user", F.concat(F.lit(system + "\n\n"), src)), say("assistant", trg))
    return F.array(say("system", F.lit(system)), say("user", src), say("assistant", trg))


def without_echo(prediction: Column, source: Column) -> Column:
    """The prediction without the source text repeated before it (C20)."""
    echoed = F.startswith(prediction, source) & (source != "")
    return F.when(echoed, F.ltrim(F.substring(prediction, F.char_length(source) + 1, F.char_length(prediction)))).otherwise(prediction)


def checkpoints(files: DataFrame, column: str = "name") -> DataFrame:
    """Least and largest step of names like `checkpoint-500`."""
    step = F.regexp_extract(column, r"checkpoint-(\d+)", 1).try_cast("bigint")
    return files.agg(F.min(step).alias("min_step"), F.max(step).alias("max_step"))


def versification(last_verses: DataFrame, rules: list[tuple[str, dict[tuple[str, int], int]]]) -> DataFrame:
    """(project, versification): the first rule whose key chapters all end at the stated verse.

    last_verses: project, book, chapter, verse. A rule is a name and the last verses of some chapters.
    """
    keys = sorted({k for _, r in rules for k in r})
    ends = last_verses.groupBy("project").agg(*(F.max(F.when((F.col("book") == b) & (F.col("chapter") == c), F.col("verse"))).alias(f"{b}_{c}") for b, c in keys))
    out = None
    for name, wanted in rules:
        fits = F.lit(True)
        for (b, c), v in wanted.items():
            fits = fits & F.coalesce(F.col(f"{b}_{c}") == v, F.lit(False))
        out = F.when(fits, name) if out is None else out.when(fits, name)
    return ends.select("project", out.otherwise("Unknown").alias("versification"))


def select_candidates(stats: DataFrame, target: str, least_parallel: int = 2000, least_score: float = 0.2) -> DataFrame:
    """Source projects for a target, each pair turned to face it, by falling score (Q05)."""
    facing = stats.select(
        F.when(F.col("trg") == target, F.col("src")).when(F.col("src") == target, F.col("trg")).alias("candidate"), "parallel", "score"
    ).filter("candidate IS NOT NULL")
    best = facing.groupBy("candidate").agg(F.max("parallel").alias("parallel"), F.max("score").alias("score"))
    return best.filter((F.col("parallel") >= least_parallel) & (F.col("score") >= least_score)).orderBy(F.desc("score"), "candidate")


def candidate_pairs(candidates: DataFrame, most: int) -> DataFrame:
    """Mixed-source pairs of the `most` best candidates (Q05)."""
    top = candidates.orderBy(F.desc("score"), "candidate").limit(most)
    a, b = top.select(F.col("candidate").alias("first")), top.select(F.col("candidate").alias("second"))
    return a.join(F.broadcast(b), F.col("first") < F.col("second"))  # `most` rows each


def stable_size(metric: Callable[[int], list[float]], base: list[float], start: int = 10, step: int = 10, most: int = 500, least: float = 0.999) -> int:
    """The smallest sample whose metrics point the same way as the base's: cosine of `least` or more."""
    size = start
    while size < most:
        found = metric(size)
        norm = math.sqrt(sum(x * x for x in found)) * math.sqrt(sum(x * x for x in base))
        if norm and sum(x * y for x, y in zip(found, base, strict=True)) / norm >= least:
            return size
        size += step
    return most


def beam_search(books: list[str], width: int, score: Callable[[list[tuple[str, ...]]], dict[tuple[str, ...], tuple[float, int]]], start: tuple[str, ...] = (), alpha: float = 0.0) -> list[tuple[tuple[str, ...], float]]:
    """Orders of books by beam search (T12): score gives log probability and length of many paths at once (one Spark job).

    A path's rank is its log probability over ((5 + length) / 6) ** alpha. Forced first books use a beam of one.
    """
    beam: list[tuple[str, ...]] = [start]
    ranked: list[tuple[tuple[str, ...], float]] = []
    while len(beam[0]) < len(books):
        wider = [p + (b,) for p in beam for b in books if b not in p]
        told = score(wider)
        ranked = sorted(((p, told[p][0] / ((5 + told[p][1]) / 6) ** alpha) for p in wider), key=lambda x: (-x[1], x[0]))[:width]
        beam = [p for p, _ in ranked]
    return ranked


def onboarding(verses: DataFrame, scored: DataFrame, project: str, book: str, column: str, by: list[str], threshold: float) -> dict[str, DataFrame]:
    """The tables of a project's first report (X09), lazily: verses per book and their share of the fullest project's, and
    the coverage of each project pair (scored: by, src, trg, score)."""
    from lineweave.operators import lexicon as L
    from lineweave.operators import vocabulary as V

    counts = V.verse_counts(verses, project, book, column)
    return {"verse_counts": counts, "verse_percentages": V.verse_percentages(counts, project, book), "corpus_stats": L.pair_coverage(scored, by, threshold)}
