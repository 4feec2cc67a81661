"""Word lexicons, alignments and their metrics (L01-L12, J04, J07, E09-E14, W09, S13). A lexicon is (src, trg, prob); absent is 0."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lineweave.operators.blocks import by_block
from lineweave.session import forget, written

FLOOR = 1e-9
#: Links of a task, on average, where links are counted one by one.
LINKS = 1 << 20
#: Cells (pairs of distinct words of a sentence) of a block on average, and those that are numbers at a time.
BLOCK, HELD = 1 << 22, 1 << 19


def build(links: DataFrame) -> DataFrame:
    """(src, trg, n) from linked word pairs."""
    return links.groupBy("src", "trg").agg(F.count("*").alias("n"))


def normalise(lexicon: DataFrame, weight: str = "n") -> DataFrame:
    """Weights over their sum per source word (L04). Sums are joined back rather than windowed: a frequent word
    may have very many rows."""
    sums = lexicon.groupBy("src").agg(F.sum(weight).alias("_sum"))
    return lexicon.join(sums, "src").select("src", "trg", (F.col(weight).cast("double") / F.col("_sum")).alias("prob"))


def symmetrise(direct: DataFrame, inverse: DataFrame) -> DataFrame:
    """Products of direct and inverse probabilities, normalised again (L05). inverse: its src is direct's trg."""
    back = inverse.select(F.col("trg").alias("src"), F.col("src").alias("trg"), F.col("prob").alias("q"))
    both = direct.join(back, ["src", "trg"]).select("src", "trg", (F.col("prob") * F.col("q")).alias("n")).filter("n > 0")
    return normalise(both)


def top_targets(lexicon: DataFrame, k: int | None = None) -> DataFrame:
    """With `place`: targets of each word by falling probability, equal ones by name."""
    ranked = lexicon.withColumn("place", F.row_number().over(Window.partitionBy("src").orderBy(F.desc("prob"), "trg")))
    return ranked.filter(F.col("place") <= k) if k else ranked


def ranked_groups(lexicon: DataFrame) -> DataFrame:
    """(src, ranks): targets of equal probability share a rank as a set."""
    tied = lexicon.withColumn("r", F.dense_rank().over(Window.partitionBy("src").orderBy(F.desc("prob"))))
    sets = tied.groupBy("src", "r").agg(F.array_sort(F.collect_set("trg")).alias("s"))
    return sets.groupBy("src").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "s"))), lambda x: x["s"]).alias("ranks"))


def _share(hits: Column, of: Column) -> Column:
    return F.coalesce(F.try_divide(hits.cast("double"), of.cast("double")), F.lit(1.0))


def precision_recall_at_k(lexicon: DataFrame, gold: DataFrame, k: int) -> DataFrame:
    """(precision, recall, f) of the k best targets against gold (src, trg); nothing to judge counts as 1."""
    top = top_targets(lexicon, k).select("src", "trg")
    hit = gold.select("src", "trg").distinct().withColumn("hit", F.lit(1))
    p = top.join(hit, ["src", "trg"], "left").agg(F.sum("hit").alias("hits"), F.count("*").alias("shown"))
    sizes = gold.groupBy("src").agg(F.count_distinct("trg").alias("n")).agg(F.sum(F.least("n", F.lit(k))).alias("wanted"))
    both = p.crossJoin(sizes)  # a row each
    hits = F.coalesce("hits", F.lit(0))
    scored = both.select(_share(hits, F.col("shown")).alias("precision"), _share(hits, F.coalesce("wanted", F.lit(0))).alias("recall"))
    return scored.withColumn("f", F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def mean_average_precision(lexicon: DataFrame, gold: DataFrame) -> DataFrame:
    """Per source word the sum of precision at each hit over the number of targets shown; the mean of all."""
    hit = gold.select("src", "trg").distinct().withColumn("hit", F.lit(1))
    marked = top_targets(lexicon).join(hit, ["src", "trg"], "left").na.fill(0, ["hit"])
    hits = F.sum("hit").over(Window.partitionBy("src").orderBy("place"))
    scored = marked.withColumn("p", F.when(F.col("hit") == 1, hits / F.col("place")).otherwise(0.0))
    each = scored.groupBy("src").agg((F.sum("p") / F.count("*")).alias("ap"))
    return each.agg(F.round(F.avg("ap"), 6).alias("map"))


def average_overlap(lexicon: DataFrame, gold: DataFrame, k: int) -> DataFrame:
    """Mean over the words that both have of the sum over depths d <= k of 2 |S_d & T_d| / (|S_d| + |T_d|), over k."""
    a = top_targets(lexicon, k).groupBy("src").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "trg"))), lambda x: x["trg"]).alias("s"))
    b = top_targets(gold, k).groupBy("src").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "trg"))), lambda x: x["trg"]).alias("t"))

    def agreement(d: Column) -> Column:
        s, t = F.slice("s", F.lit(1), d), F.slice("t", F.lit(1), d)
        return F.size(F.array_intersect(s, t)) * F.lit(2.0) / (F.size(s) + F.size(t))

    overlap = F.aggregate(F.sequence(F.lit(1), F.lit(k)), F.lit(0.0), lambda x, d: x + agreement(d)) / k
    return a.join(b, "src").select(overlap.alias("ao")).agg(F.round(F.avg("ao"), 6).alias("average_overlap"))


def sentence_scores(links: DataFrame, tokens: DataFrame, direct: DataFrame, inverse: DataFrame, key: list[str]) -> DataFrame:
    """Mean of the link probabilities and the NULL probabilities of unaligned tokens of each sentence.

    links: key, i, j, src, trg, and where the aligner states it p, the link's own probability. tokens: key, side (src or
    trg), at, word. A link without p scores the larger of its direct and inverse probability, an unaligned token its
    probability with NULL; floors are 1e-9.
    """
    own = F.col("p") if "p" in links.columns else F.lit(None).cast("double")
    links = links.withColumn("_own", own)
    back = inverse.select(F.col("trg").alias("src"), F.col("src").alias("trg"), F.col("prob").alias("q"))
    linked = links.join(direct, ["src", "trg"], "left").join(back, ["src", "trg"], "left")
    scored = linked.select(*key, F.coalesce("_own", F.greatest(F.coalesce("prob", F.lit(FLOOR)), F.coalesce("q", F.lit(FLOOR)), F.lit(FLOOR))).alias("p"))
    used = links.select(*key, F.lit("src").alias("side"), F.col("i").alias("at")).union(links.select(*key, F.lit("trg"), F.col("j"))).distinct()
    free = tokens.join(used, [*key, "side", "at"], "left_anti")
    null = direct.filter("src = 'NULL'").select(F.lit("trg").alias("side"), F.col("trg").alias("word"), "prob")
    null = null.union(inverse.filter("src = 'NULL'").select(F.lit("src"), F.col("trg"), "prob"))
    free = free.join(null, ["side", "word"], "left").select(*key, F.greatest(F.coalesce("prob", F.lit(FLOOR)), F.lit(FLOOR)).alias("p"))
    return scored.union(free).groupBy(*key).agg(F.round(F.avg("p"), 6).alias("score"))


def corpus_scores(pairs: DataFrame, links: DataFrame, direct: DataFrame, inverse: DataFrame, key: list[str]) -> DataFrame:
    """(key, score) of every pair (key, s, t: word arrays) (L02): -1 where a side has no word, 0 for all if no pair at all
    can be aligned."""
    full = (F.size("s") > 0) & (F.size("t") > 0)
    tokens = pairs.filter(full).select(*key, F.lit("src").alias("side"), F.posexplode("s").alias("at", "word"))
    tokens = tokens.union(pairs.filter(full).select(*key, F.lit("trg"), F.posexplode("t")))
    scored = sentence_scores(links, tokens, direct, inverse, key)
    any_ = pairs.agg(F.coalesce(F.bool_or(full), F.lit(False)).alias("_any"))
    rows = pairs.select(*key, full.alias("_full")).join(scored, key, "left").crossJoin(F.broadcast(any_))  # one row
    return rows.select(*key, F.when(~F.col("_any"), 0.0).when(~F.col("_full"), -1.0).otherwise(F.col("score")).alias("score"))


def with_scores(rows: DataFrame, cached: DataFrame, computed: DataFrame, key: list[str]) -> DataFrame:
    """rows with the score that cached has for their key, else the computed one (J04): a join by key, so neither table's
    order matters."""
    return rows.join(cached.select(*key, "score"), key, "left").join(computed.select(*key, F.col("score").alias("_new")), key, "left").withColumn("score", F.coalesce("score", "_new")).drop("_new")


def pair_coverage(rows: DataFrame, by: list[str], threshold: float) -> DataFrame:
    """Per project pair (A05): rows, those with only one side, those with both, and of these the mean score, how many a
    score at or below threshold takes away, and the mean of the rest (of all without a threshold).

    rows: by, src, trg, score.
    """
    s, t = F.char_length("src") > 0, F.char_length("trg") > 0
    both, over = s & t, F.col("score") > threshold
    mean = lambda c: F.round(F.avg(F.when(c, F.col("score"))), 4)
    return rows.groupBy(*by).agg(
        F.count("*").alias("count"),
        F.count_if(s & ~t).alias("src_only"),
        F.count_if(t & ~s).alias("trg_only"),
        F.count_if(both).alias("parallel"),
        mean(both).alias("align_score"),
        (F.count_if(both & ~over) if threshold > 0 else F.lit(0).cast("bigint")).alias("filtered_count"),
        mean(both & over if threshold > 0 else both).alias("filtered_align_score"),
    )


def alignment_metrics(system: DataFrame, gold: DataFrame, key: list[str], by: list[str], alpha: float = 0.5) -> DataFrame:
    """AER, precision, recall and F of links against gold links with a `sure` flag, per group.

    a: links, s: sure gold links, sa: sure hits, pa: all hits. AER is 1 - (pa + sa) / (s + a), 0 for nothing;
    precision pa / a and recall sa / s are 1 where their base is 0.
    """
    at = [*key, "i", "j"]
    mine = system.select(*at).distinct().withColumn("mine", F.lit(1))
    true = gold.groupBy(*at).agg(F.max(F.col("sure").cast("int")).alias("sure"))
    both = mine.join(true, at, "full_outer")
    sums = both.groupBy(*by).agg(
        F.count("mine").alias("a"), F.sum(F.coalesce("sure", F.lit(0))).alias("s"), F.count_if((F.col("mine") == 1) & F.col("sure").isNotNull()).alias("pa"), F.count_if((F.col("mine") == 1) & (F.col("sure") == 1)).alias("sa")
    )
    p, r = _share(F.col("pa"), F.col("a")), _share(F.col("sa"), F.col("s"))
    aer = F.coalesce(1 - F.try_divide((F.col("pa") + F.col("sa")).cast("double"), F.col("s") + F.col("a")), F.lit(0.0))
    f = F.try_divide(F.lit(1.0), F.try_divide(F.lit(alpha), p) + F.try_divide(F.lit(1 - alpha), r))
    return sums.select(*by, F.round(aer, 6).alias("aer"), F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(f, 6).alias("f"))


def majority_links(runs: DataFrame, key: list[str], n_runs: int) -> DataFrame:
    """Links that over half of the runs hold; runs: run, key, i, j.

    Links are hardly ever equal within a task, so sums before the shuffle would only hold all of them: they are dealt by
    sentence, LINKS to a task, and summed up there.
    """
    parts = max(int(runs.sparkSession.conf.get("spark.sql.shuffle.partitions")), runs.count() // LINKS + 1)
    runs = runs.repartition(parts, *key)
    return runs.groupBy(*key, "i", "j").agg(F.count_distinct("run").alias("n")).filter(F.col("n") * 2 > n_runs).select(*key, "i", "j")


def crossing_counts(links: DataFrame, key: list[str]) -> DataFrame:
    """How many links of its sentence each link crosses (L10). A sentence's links are one row while compared."""
    rows = links.groupBy(*key).agg(F.collect_list(F.struct("i", "j")).alias("all"))
    crossed = lambda l: F.size(F.filter("all", lambda o: (o["i"] - l["i"]) * (o["j"] - l["j"]) < 0)).cast("bigint")  # noqa: E731, E741
    counted = F.transform("all", lambda l: F.struct(l["i"].alias("i"), l["j"].alias("j"), crossed(l).alias("crossings")))  # noqa: E741
    return rows.select(*key, F.explode(counted).alias("l")).select(*key, "l.i", "l.j", "l.crossings")


def crossing_breaks(links: DataFrame, breaks: DataFrame, key: list[str]) -> DataFrame:
    """How many links of its sentence cross each break (key, at, to) before source word `at` and target word `to`."""
    rows = links.groupBy(*key).agg(F.collect_list(F.struct("i", "j")).alias("all"))
    crossed = F.filter(F.coalesce("all", F.array().cast("array<struct<i: int, j: int>>")), lambda o: (o["i"] < F.col("at")) != (o["j"] < F.col("to")))
    return breaks.join(rows, key, "left").select(*key, "at", "to", F.size(crossed).cast("bigint").alias("crossed"))


def without_crossing(links: DataFrame, other: DataFrame, key: list[str], n: int) -> DataFrame:
    """Links that, taken as breaks, fewer than n links of the other alignment cross."""
    own = links.select(*key, F.col("i").alias("at"), F.col("j").alias("to")).distinct()
    return crossing_breaks(other, own, key).filter(F.col("crossed") < n).select(*key, F.col("at").alias("i"), F.col("to").alias("j"))


def symmetric_links(forward: DataFrame, backward: DataFrame, key: list[str], heuristic: str = "intersection") -> DataFrame:
    """Links that both directions have, or either one (L08); for grow-diag-final see functions.alignment."""
    at = [*key, "i", "j"]
    if heuristic == "intersection":
        return forward.select(*at).distinct().join(backward.select(*at).distinct(), at)
    if heuristic == "union":
        return forward.select(*at).union(backward.select(*at)).distinct()
    raise ValueError(heuristic)


class Cells:
    """The word pairs of a block, which has all sentences of its target words: distinct ones by target and source word, and the
    cells of each target word of a sentence, some at a time."""

    #: Of a block's row: source words of each sentence, how often; target words by their order, how often, and where their sentence's source words are.
    FIELDS = {"x": np.int32, "n": np.int32, "y": np.int32, "m": np.int32, "many": np.int32, "start": np.int64}

    def __init__(self, row: pa.Table) -> None:
        self.src, self.trg = (row.column(c).combine_chunks().flatten() for c in ("src", "trg"))
        self.x, self.n, self.y, self.m, self.many, self.start = (np.frombuffer(row.column(c)[0].as_py(), kind) for c, kind in self.FIELDS.items())
        found, back = [], []
        for lo, hi, _, at in self.parts():
            pair, of = np.unique(np.repeat(self.y[lo:hi].astype(np.int64) << 32, self.many[lo:hi]) | self.x[at], return_inverse=True)
            found.append(pair)
            back.append(of.astype(np.int32))
        self.pairs = np.unique(np.concatenate([np.zeros(0, np.int64), *found]))
        self.at = [np.searchsorted(self.pairs, pair).astype(np.int32)[of] for pair, of in zip(found, back)]
        self.of = self.pairs & (1 << 32) - 1

    @classmethod
    def row(cls, block: pa.Table) -> pa.Table:
        """A block's sentences (src, trg) as one row: its words, and FIELDS."""

        def side(name: str) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
            """The words, and each sentence's distinct ones: sentence, word, how often."""
            column = block.column(name).combine_chunks()
            coded = column.flatten().dictionary_encode()
            at = np.repeat(np.arange(len(column)), pc.list_value_length(column).to_numpy(zero_copy_only=False))
            each, n = np.unique(at * len(coded.dictionary) + coded.indices.to_numpy().astype(np.int64), return_counts=True)
            return coded.dictionary, *np.divmod(each, max(len(coded.dictionary), 1)), n

        (src, s_row, x, n), (trg, t_row, y, m) = side("src"), side("trg")
        count = np.bincount(s_row, minlength=block.num_rows)
        order = np.argsort(y, kind="stable")
        kept = (x, n, y[order], m[order], count[t_row][order], (np.cumsum(count) - count)[t_row][order])
        whole = [pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words) for words in (src, trg)]
        return pa.table([block.column("block")[:1], *whole, *(pa.array([v.astype(kind).tobytes()], pa.binary()) for v, kind in zip(kept, cls.FIELDS.values()))], ["block", "src", "trg", *cls.FIELDS])

    def parts(self) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(lo, hi, begins, at) of about HELD cells: target words from lo to hi, where each one's cells begin, and the source words."""
        share = np.cumsum(self.many, dtype=np.int64) // HELD
        ends = [*(np.flatnonzero(share[1:] != share[:-1]) + 1).tolist(), len(share)]
        for lo, hi in zip([0, *ends], ends):
            many = self.many[lo:hi].astype(np.int64)
            begins = np.cumsum(many) - many
            if len(many):
                yield lo, hi, begins, np.arange(many.sum()) + np.repeat(self.start[lo:hi] - begins, many)

    def expected(self, prob: np.ndarray) -> np.ndarray:
        """The expected count of each pair, given its probability."""
        out = np.zeros(len(self.pairs))
        for pair, (lo, hi, begins, at) in zip(self.at, self.parts()):
            w = self.n[at] * prob[pair]
            z, many = np.add.reduceat(w, begins), self.many[lo:hi]
            w *= np.repeat(np.divide(self.m[lo:hi], z, out=np.zeros(len(z)), where=z > 0), many)
            first = int(pair.min())
            told = np.bincount(pair - first, w)
            out[first : first + len(told)] += told
        return out

    def sums(self, n: np.ndarray) -> np.ndarray:
        """Of each source word."""
        return np.bincount(self.of, n, len(self.src))

    def counts(self, even: float, known: pa.Table, rounds: int) -> np.ndarray:
        """The expected counts of a round, by the sums (k, src, n) that all blocks have told of the rounds before; after round 0 even shares."""
        n = np.full(len(self.pairs), even)
        for k in range(rounds):
            n = self.expected(self.shares(n, known, k))
        return n

    def shares(self, n: np.ndarray, known: pa.Table, k: int) -> np.ndarray:
        """n over the sums of its source word in round k; in round 0 n itself."""
        if not k:
            return n
        mine = known.filter(pc.equal(known.column("k"), k))
        sums = np.zeros(len(self.src))
        sums[pc.index_in(mine.column("src").combine_chunks(), self.src).to_numpy(zero_copy_only=False)] = mine.column("n").to_numpy()
        return np.divide(n, sums[self.of], out=np.zeros(len(n)), where=sums[self.of] > 0)


def ibm1(pairs: DataFrame, key: list[str], rounds: int = 3) -> DataFrame:
    """(src, trg, prob): IBM Model 1 (Brown et al., 1993) with a NULL source word, by expectation maximisation.

    pairs: key, src (words), trg (words). The posterior of a target word is normalised within its sentence, whatever its other target words
    are. So target words are dealt to blocks of about BLOCK cells (distinct word pairs of a sentence), with the source words
    of their sentences: all counts of a pair fall in one block. Blocks are written once, and a round's counts nowhere: only the sums of
    source words meet, and a round takes those before it once more by their sums.
    """
    full = pairs.filter(F.col("src").isNotNull() & F.col("trg").isNotNull())
    whole = lambda c: F.array_compact(F.flatten(F.collect_list(c)))
    sents = full.groupBy(*key).agg(whole(F.concat(F.array(F.lit("NULL")), "src")).alias("src"), whole("trg").alias("trg")).filter(F.size("trg") > 0)
    sents = written(sents.select("src", "trg"), "sentences")
    found = sents.agg(F.sum(F.size(F.array_distinct("src")).cast("long") * F.size(F.array_distinct("trg")))).first()[0] or 0
    size = sents.select(F.explode("trg").alias("trg")).agg(F.count_distinct("trg")).first()[0]
    blocks = max(found // BLOCK + 1, min(3 * pairs.sparkSession.sparkContext.defaultParallelism, found // HELD + 1))
    even = 1.0 / max(size, 1)
    of = F.transform("trg", lambda w: F.struct(F.pmod(F.xxhash64(w), F.lit(blocks)).alias("block"), w.alias("trg")))
    dealt = sents.select("src", of.alias("t")).select("src", "t", F.explode(F.array_distinct("t.block")).alias("block"))
    dealt = dealt.select("block", "src", F.transform(F.filter("t", lambda x: x["block"] == F.col("block")), lambda x: x["trg"]).alias("trg"))
    packed = ", ".join(f"{c} binary" for c in Cells.FIELDS)
    cells = dealt.repartition(2 * blocks, "block").groupBy("block").applyInArrow(lambda block: Cells.row(block), f"block long, src array<string>, trg array<string>, {packed}")
    cells = written(cells, "cells")
    forget(sents)
    known = pairs.sparkSession.createDataFrame([], "block long, k int, src string, n double")

    def told(rounds: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
        def run(row: pa.Table, known: pa.Table) -> pa.Table:
            block = Cells(row)
            return pa.table([pa.repeat(row.column("block")[0], len(block.src)), block.src, pa.array(block.sums(block.counts(even, known, rounds)))], ["block", "src", "n"])

        return run

    def table(row: pa.Table, known: pa.Table) -> pa.Table:
        block = Cells(row)
        prob = block.shares(block.counts(even, known, rounds), known, rounds)
        return pa.table([block.src.take(pa.array(block.of)), block.trg.take(pa.array(block.pairs >> 32)), pa.array(prob)], ["src", "trg", "prob"])

    for k in range(1, rounds + 1):
        each = by_block(cells, known, 2 * blocks, told(k), "block long, src string, n double")
        each = written(each, "told")
        sums = each.groupBy("src").agg(F.sum("n").alias("n"))
        known = known.union(written(each.select("block", "src").join(sums, "src").select("block", F.lit(k).alias("k"), "src", "n"), "sums"))
        forget(each)
    return by_block(cells, known, 2 * blocks, table, "src string, trg string, prob double")


def same_place(pairs: DataFrame, key: list[str]) -> DataFrame:
    """Links of words at the same place: a baseline. pairs: key, s, t."""
    zipped = F.filter(F.arrays_zip("s", "t"), lambda x: x["s"].isNotNull() & x["t"].isNotNull())
    each = pairs.select(*key, F.posexplode(zipped).alias("i", "x"))
    return each.select(*key, "i", F.col("i").alias("j"), F.col("x.s").alias("src"), F.col("x.t").alias("trg"))


def same_word(pairs: DataFrame, key: list[str]) -> DataFrame:
    """Links of words that both sides have, the k-th one with the k-th one: names and numbers."""
    nth = lambda c, at: pairs.select(*key, F.posexplode(c).alias(at, "_w")).withColumn("_nth", F.row_number().over(Window.partitionBy(*key, "_w").orderBy(at)))
    return nth("s", "i").join(nth("t", "j"), [*key, "_w", "_nth"]).select(*key, "i", "j", F.col("_w").alias("src"), F.col("_w").alias("trg"))


def most_likely(pairs: DataFrame, key: list[str], rounds: int = 3) -> DataFrame:
    """Links of each target word with the source word of the largest IBM Model 1 probability, the first of equals."""
    table = ibm1(pairs.select(*key, F.col("s").alias("src"), F.col("t").alias("trg")), key, rounds)
    s, t = pairs.select(*key, F.posexplode("s").alias("i", "src")), pairs.select(*key, F.posexplode("t").alias("j", "trg"))
    met = s.join(t, key).join(table, ["src", "trg"])
    best = F.max_by(F.struct("i", "src"), F.struct(F.round("prob", 9), (-F.col("i")).alias("o"))).alias("b")
    return met.groupBy(*key, "j", "trg").agg(best).select(*key, "b.i", "j", "b.src", "trg")


def _positional(name: str) -> Callable[[DataFrame, list[str]], DataFrame]:
    def run(pairs: DataFrame, key: list[str]) -> DataFrame:
        from lineweave.operators import aligners  # which builds on this module

        return getattr(aligners, name)(pairs, key)

    return run


#: Aligners by id (L11): a name, and what makes links (key, i, j, src, trg) of pairs (key, s, t). Others may be added.
ALIGNERS: dict[str, tuple[str, Callable[[DataFrame, list[str]], DataFrame]]] = {
    "place": ("Same place", same_place),
    "word": ("Same word", same_word),
    "ibm1": ("IBM Model 1", most_likely),
    "hmm": ("HMM", _positional("hmm")),
    "fast_align": ("Diagonal prior", _positional("fast_align")),
    "eflomal": ("Gibbs sampling with fertility", _positional("eflomal")),
}


def get_aligner(name: str) -> Callable[[DataFrame, list[str]], DataFrame]:
    if name not in ALIGNERS:
        raise ValueError(f"no aligner {name}; known are {sorted(ALIGNERS)}")
    return ALIGNERS[name][1]


def experiment(aligners: list[str], pairs: DataFrame, gold: DataFrame, gold_lexicon: DataFrame, key: list[str], book: str, k: int = 3) -> DataFrame:
    """(book, model, aer, precision, recall, f, precision_at_k, recall_at_k, f_at_k) of each aligner (L12): links, lexicon
    and metrics; all books together are ALL, and only there the lexicon's metrics are joined (J07).

    pairs: key, s, t. gold: key, i, j, sure. gold_lexicon: src, trg.
    """
    metrics, lexicons = None, None
    for name in aligners:
        links = get_aligner(name)(pairs, key)
        every = lambda df: df.withColumn("_book", F.explode(F.array(F.col(book).cast("string"), F.lit("ALL"))))
        own = alignment_metrics(every(links), every(gold), ["_book", *key], ["_book"]).withColumn("model", F.lit(name))
        at = precision_recall_at_k(normalise(build(links)), gold_lexicon, k).select(F.lit("ALL").alias("_book"), F.lit(name).alias("model"), *(F.col(c).alias(f"{c}_at_{k}") for c in ("precision", "recall", "f")))
        metrics = own if metrics is None else metrics.unionByName(own)
        lexicons = at if lexicons is None else lexicons.unionByName(at)
    return metrics.join(lexicons, ["_book", "model"], "left").withColumnRenamed("_book", "book")
