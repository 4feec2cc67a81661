"""Verse segmentation (V01-V06, E15): breaks in a target passage that follow the verses of the source."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lineweave.functions import text as X
from lineweave.functions import udfs as U

CROSSING, SENTENCE, WINDOW = -20, 5, 5
PASSAGE = "struct<src: array<string>, trg: array<string>, links: array<struct<i: int, j: int>>, breaks: array<int>>"


def verses_to_passages(verses: DataFrame, passages: DataFrame, order: str = "ref", text: str = "text", width: int = 64) -> DataFrame:
    """(book, passage, text, n_verses): the verses within each passage's first and last reference, joined in order.

    References are whole numbers and passages carry the book. Verses and passages meet in stretches of `width` references of a
    book, so a verse meets the passages near it only, and a long book is spread over many keys.
    """
    stretch = lambda c: F.floor(F.col(c) / width)
    near = passages.withColumn("_s", F.explode(F.sequence(stretch("first"), stretch("last"))))
    met = verses.withColumn("_s", stretch(order)).join(near, ["book", "_s"]).filter(F.col(order).between(F.col("first"), F.col("last")))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda x: x[text])
    return met.groupBy("book", "passage").agg(F.array_join(ordered, " ").alias(text), F.count("*").alias("n_verses"))


def break_score(at: Column, to: Column) -> Column:
    """The score of a break before source word `at` and target word `to` of a passage with src, trg (words) and links.

    -20 for each link that crosses the break; of links whose words are within five of it on both sides the target
    word's distance; and 5 each for words without letters before it, without letters one behind it, and capitals
    one behind it, on both sides.
    """
    crossed = F.size(F.filter("links", lambda x: (x["i"] < at) != (x["j"] < to)))
    near = F.filter("links", lambda x: (F.abs(x["i"] - at) <= WINDOW) & (F.abs(x["j"] - to) <= WINDOW))
    pull = F.aggregate(near, F.lit(0), lambda s, x: s + F.abs(x["j"] - to).cast("int"))
    word = lambda side, i: F.when(i >= 0, F.get(F.col(side), i))
    both = lambda rule, d: F.coalesce(rule(word("src", at + d)) & rule(word("trg", to + d)), F.lit(False)).cast("int")
    bare = lambda w: ~X.contains_letter(w)
    score = CROSSING * crossed + pull + SENTENCE * (both(bare, -1) + both(bare, 1) + both(X.starts_with_capital, 1))
    return score.cast("bigint")


def scores_before(at: int | None, m: int, i: np.ndarray, j: np.ndarray, alike: list[tuple[int, np.ndarray, np.ndarray]]) -> np.ndarray:
    """`break_score` of the breaks before source word `at` and each target word from 1 to m - 1. i, j: the links; alike: the marks of
    both sides that count 5 each where both have them, and how far from the break they are looked for."""
    if at is None:
        return np.zeros(m - 1, np.int64)
    before = lambda own: np.cumsum(np.bincount(np.clip(own, 0, m), minlength=m + 1))[: m - 1]  # noqa: E731  of links, those before each place
    score = CROSSING * ((i < at).sum() + before(j) - 2 * before(j[i < at]))
    near = j[np.abs(i - at) <= WINDOW]
    for d in range(-WINDOW, WINDOW + 1):
        to = near - d
        score += abs(d) * np.bincount(to[(to >= 1) & (to < m)], minlength=m)[1:m]
    for d, src, trg in alike:
        if 0 <= at + d < len(src) and src[at + d]:
            to = np.arange(1, m) + d
            score += SENTENCE * (trg[np.minimum(to, len(trg) - 1)] & (to < len(trg)))
    return score


def break_scores(passages: DataFrame) -> DataFrame:
    """(passage, at, to, score) of each candidate break (V02): all pairs of a verse start and a place in the target.

    passages: passage, src and trg (words), links (i, j), breaks (source places of verse starts). A passage is scored within
    its row, all places of a break at once, by sums over the links before them; only the scores are rows of their own.
    """
    bare = lambda side: F.transform(side, lambda w: F.coalesce(~X.contains_letter(w), F.lit(False)))
    capital = lambda side: F.transform(side, lambda w: F.coalesce(X.starts_with_capital(w), F.lit(False)))
    ends = F.coalesce("links", F.array().cast("array<struct<i: int, j: int>>"))
    place = lambda k: F.transform(ends, lambda x: x[k].cast("int"))
    none = lambda c: F.coalesce(c, F.array().cast("array<boolean>"))
    rows = passages.filter((F.size("trg") > 1) & (F.size("breaks") > 0)).select(
        "passage", F.transform("breaks", lambda b: b.cast("int")).alias("breaks"), place("i").alias("i"), place("j").alias("j"),
        none(bare("src")).alias("sb"), bare("trg").alias("tb"), none(capital("src")).alias("sc"), capital("trg").alias("tc"),
    )
    kind = passages.schema["passage"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(lo, U.HELD) for whole in batches for lo in range(0, whole.num_rows, U.HELD)):
            own, ats, tos, scores = [], [], [], []
            for k, (breaks, *rest) in enumerate(U.rows_of(tuple(batch.columns[1:]))):
                i, j = (np.array(x, np.int64) for x in rest[:2])
                sb, tb, sc, tc = (np.array(x, bool) for x in rest[2:])
                m = len(tb)
                for at in breaks:
                    scores.append(scores_before(at, m, i, j, [(-1, sb, tb), (1, sb, tb), (1, sc, tc)]))
                own += [np.full(len(breaks) * (m - 1), k)]
                ats += [at for at in breaks for _ in range(m - 1)]
                tos += [np.tile(np.arange(1, m), len(breaks))]
            yield pa.record_batch([
                batch.column(0).take(pa.array(np.concatenate(own))), pa.array(ats, pa.int32()), pa.array(np.concatenate(tos), pa.int32()), pa.array(np.concatenate(scores), pa.int64()),
            ], ["passage", "at", "to", "score"])

    return rows.mapInArrow(run, f"passage {kind}, at int, to int, score long")


def has_letter(word: str) -> bool:
    return any(c.isalpha() for c in word)


class Links:
    """The scores of all breaks of a passage, for searches that place one break after another.

    grid[at, to] is `break_score`: links that cross a break are those before `at` and those before `to`, less twice those before
    both (a two-dimensional prefix sum); what pulls at it are sums over the diagonals beside it.
    """

    def __init__(self, src: list[str], trg: list[str], links: list[tuple[int, int]]):
        self.src, self.trg = src, trg
        n, m = len(src) + 1, len(trg) + 1
        met = np.zeros((max([n, *(i + 1 for i, _ in links)]), max([m, *(j + 1 for _, j in links)])), np.int64)  # links may lie beyond the words
        for i, j in links:
            met[i, j] += 1
        self.met = met
        both = np.zeros((met.shape[0] + 1, met.shape[1] + 1), np.int64)
        both[1:, 1:] = met.cumsum(axis=0).cumsum(axis=1)
        grid = CROSSING * (both[:n, -1:] + both[-1:, :m] - 2 * both[:n, :m])
        near = np.zeros((n, met.shape[1] + 2 * WINDOW), np.int64)  # links of each target word whose source word is near `at`
        near[:, WINDOW:-WINDOW] = [met[max(at - WINDOW, 0) : at + WINDOW + 1].sum(axis=0) for at in range(n)]
        for d in range(-WINDOW, WINDOW + 1):
            grid += abs(d) * near[:, WINDOW + d : WINDOW + d + m]
        letters = [np.array([has_letter(w) for w in side], bool) for side in (src, trg)]
        capitals = [np.array([w[:1].isupper() for w in side], bool) for side in (src, trg)]
        self.marks = [~x for x in letters]
        grid[1:, 1:] += SENTENCE * np.outer(*self.marks)
        for kind in (self.marks, capitals):
            grid[: max(len(src) - 1, 0), : max(len(trg) - 1, 0)] += SENTENCE * np.outer(kind[0][1:], kind[1][1:])
        self.grid = grid

    def score(self, at: int, to: int) -> int:
        """As `break_score`."""
        return int(self.grid[at, to])

    def best(self, at: range, to: range) -> tuple[int | None, list[tuple[int, int]]]:
        """The best score of the breaks in a window, and the breaks that have it, in order."""
        part = self.grid[at.start : at.stop, to.start : to.stop]
        if not part.size:
            return None, []
        top = int(part.max())
        return top, [(at.start + a, to.start + t) for a, t in np.argwhere(part == top).tolist()]

    def partner(self, i: int) -> int | None:
        """The target mark that source mark i is linked with, if that is its only link."""
        if not 0 <= i < len(self.src) or not self.marks[0][i] or self.met[i].sum() != 1:
            return None
        j = int(self.met[i].argmax())
        return j if j < len(self.trg) and self.marks[1][j] else None

    def preferred(self, ties: list[tuple[int, int]]) -> tuple[int, int]:
        """Of breaks that score alike the one of least rank, of these the first: 0 if it stands before the partner of the mark
        that ends the source verse, 1 if it stands behind the partner of the mark that begins the next, 2 behind any mark,
        3 elsewhere. Ranks 0 and 1 are of the first verse start only. A break of rank 0 goes behind the partner and all
        quotation marks next to it that have no link."""
        first = ties[0][0]
        ends, begins = self.partner(first - 1), self.partner(first)

        def rank(tie: tuple[int, int]) -> int:
            at, to = tie
            return 0 if (at, to) == (first, ends) else 1 if begins is not None and (at, to) == (first, begins + 1) else 2 if self.marks[1][to - 1] else 3

        at, to = min(ties, key=rank)
        if rank((at, to)) == 0:
            to += 1
            while to < len(self.trg) and self.trg[to] == '"' and not self.met[:, to].any():
                to += 1
        return at, to


def placed_breaks(links: Links, breaks: list[int]) -> list[tuple[int, int]]:
    """(at, to): breaks placed best first, each strictly between those that are placed already."""
    ends = {0: 0, len(links.src): len(links.trg)}
    out = dict(ends)
    left = sorted({b for b in breaks if 0 < b < len(links.src)})
    while left:
        top, ties = None, []
        for at in left:
            below, above = max(p for p in out if p < at), min(p for p in out if p > at)
            score, found = links.best(range(at, at + 1), range(out[below] + 1, out[above] - 1))
            if found and (top is None or score >= top):
                top, ties = score, (ties if score == top else []) + found
        if not ties:
            break
        at, to = links.preferred(ties)
        out[at] = to
        left.remove(at)
    return sorted(x for x in out.items() if x[0] not in ends)


def splits(links: Links, breaks: list[int], least: int = 15) -> list[tuple[int, int]]:
    """(at, to): where a passage is cut into smaller ones (V04): strictly between two verse starts (the first one follows the
    passage's begin) at the best place, the first of equal ones, if that scores over `least`.

    Target words are to source words as the texts' lengths, so a verse from source place p to q is looked for from three
    quarters of its begin's place in the target to five quarters of its end's, behind the cut before.
    """
    pace = len(links.trg) / max(len(links.src), 1)
    out: list[tuple[int, int]] = []
    for begin, end in zip([0, *breaks], breaks):
        low = max(int(0.75 * pace * begin), out[-1][1] + 1 if out else 1)
        high = min(int(1.25 * pace * end), len(links.trg) - 1)
        score, found = links.best(range(begin + 1, end), range(low, high + 1))
        if found and score > least:
            out.append(found[0])
    return out


def searched(search) -> Column:
    """An Arrow UDF that runs a search over the breaks of each passage: sequential by nature, so a passage is one row."""

    def run(passage: dict) -> list[dict]:
        known = Links(passage["src"], passage["trg"], [(x["i"], x["j"]) for x in passage["links"]])
        return [{"at": int(a), "to": int(t)} for a, t in search(known, sorted(passage["breaks"]))]

    kind = T.ArrayType(T.StructType([T.StructField("at", T.IntegerType()), T.StructField("to", T.IntegerType())]))
    return U.mapped(run, kind)(F.struct("src", "trg", F.col("links").cast("array<struct<i: int, j: int>>").alias("links"), "breaks"))


def place_breaks(passages: DataFrame) -> DataFrame:
    """(passage, at, to) of the verse starts' places in the target (V03). passages: as in `break_scores`."""
    return passages.select("passage", F.explode(searched(placed_breaks)).alias("b")).select("passage", "b.*")


def split_passages(passages: DataFrame) -> DataFrame:
    """(passage, part, src, trg, breaks): passages cut into parts where a break is good enough (V04); breaks count from the
    part's begin."""
    cut = passages.withColumn("_cuts", searched(splits))
    edge = lambda side, size: F.concat(F.array(F.lit(0)), F.transform("_cuts", lambda x: x[side]), F.array(F.size(size)))
    cut = cut.withColumn("_at", edge("at", "src")).withColumn("_to", edge("to", "trg"))
    each = cut.select("*", F.explode(F.sequence(F.lit(1), F.size("_cuts") + 1)).alias("part"))
    lo, hi = F.get("_at", F.col("part") - 1), F.get("_at", F.col("part"))
    low, high = F.get("_to", F.col("part") - 1), F.get("_to", F.col("part"))
    last = F.col("part") == F.size("_cuts") + 1
    own = F.transform(F.filter("breaks", lambda b: (b >= lo) & ((b < hi) | last)), lambda b: b - lo)
    return each.select("passage", "part", F.slice("src", lo + 1, hi - lo).alias("src"), F.slice("trg", low + 1, high - low).alias("trg"), own.alias("breaks"))


def segments(trg: Column, cuts: Column) -> Column:
    """The words of a target passage cut at ascending places."""
    edges = F.concat(F.array(F.lit(0)), cuts, F.array(F.size(trg)))
    return F.transform(F.sequence(F.lit(1), F.size(edges) - 1), lambda k: F.array_join(F.slice(trg, F.get(edges, k - 1) + 1, F.get(edges, k) - F.get(edges, k - 1)), " "))


def repair_edges(parts: Column) -> Column:
    """Marks that may not begin a segment go to the end of the one before."""
    lead = lambda s: F.regexp_extract(s, r"^([.,;:!?)\]”’]+)", 1)
    return F.transform(parts, lambda s, i: F.concat(F.when(i > 0, F.substring(s, F.char_length(lead(s)) + 1, F.char_length(s))).otherwise(s), lead(F.coalesce(F.get(parts, i + 1), F.lit("")))))


def segmentation_report(gold: DataFrame, found: DataFrame, by_passage: bool = False) -> DataFrame:
    """Share of exact breaks and mean distance in characters without white space, over all but each last verse."""
    by = Window.partitionBy("passage").orderBy("verse")
    off = lambda df, out: df.select("passage", "verse", F.sum(X.dense_length("text")).over(by).alias(out), F.lead("verse").over(by).isNull().alias("last"))
    both = off(gold, "a").join(off(found, "b").drop("last"), ["passage", "verse"]).filter("NOT last")
    rows = both.groupBy("passage") if by_passage else both
    return rows.agg(F.avg((F.col("a") == F.col("b")).cast("double")).alias("accuracy"), F.avg(F.abs(F.col("a") - F.col("b")).cast("double")).alias("distance"))


def passage_json(passages: DataFrame) -> DataFrame:
    """Passages as JSON text."""
    return passages.select("passage", F.to_json(F.struct(*[c for c in passages.columns if c != "passage"])).alias("json"))


def passages_from_json(rows: DataFrame, schema: str) -> DataFrame:
    return rows.select("passage", F.from_json("json", schema).alias("p")).select("passage", "p.*")
