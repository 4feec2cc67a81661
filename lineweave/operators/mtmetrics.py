"""Translation metrics from n-gram matches (E01-E03, E06-E08, E17): Papineni et al. (2002), Popovic (2015, 2017), Doddington (2002), Lin (2004), Wu et al. (2016)."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from lineweave.functions import text as X
from lineweave.functions import udfs as U

ORDERS = 4
#: Bytes of both sides whose n-grams are counted at a time: the arrays of a count take some hundred bytes for each of them.
COUNTED = 1 << 16


def bounds(column: pa.Array) -> np.ndarray:
    """Where each row's bytes begin, and where the last one's end; a text of a list counts one more. Only offsets are read: a batch has millions of words."""
    if pa.types.is_list(column.type):
        at = column.offsets.to_numpy()
        return bounds(column.values)[at].astype(np.int64) + (0 if pa.types.is_list(column.values.type) else at)
    if not len(column):
        return np.zeros(1, np.int64)
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    return np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + len(column) + 1]


def pieces(batch: pa.RecordBatch, columns: list[int], most: int) -> Iterator[pa.RecordBatch]:
    """The batch in slices whose rows have about `most` bytes in these columns (texts, lists of them), one row at least."""
    share = (1 + sum(np.diff(bounds(batch.column(c))).astype(np.int64) for c in columns)).cumsum() // most
    ends = [*(np.flatnonzero(share[1:] != share[:-1]) + 1).tolist(), batch.num_rows]
    for lo, hi in zip([0, *ends], ends):
        if hi > lo or not batch.num_rows:
            yield batch.slice(lo, hi - lo)


def _lists(column: pa.Array, chars: bool) -> tuple[pa.Array | np.ndarray, np.ndarray]:
    """(items of all rows, where each row's begin): tokens of lists, code points of texts."""
    if chars:
        column = pc.fill_null(column, "")
        sizes = pc.utf8_length(column).to_numpy(zero_copy_only=False)
        return np.frombuffer("".join(column.to_pylist()).encode("utf-32-le"), np.uint32), np.concatenate([[0], np.cumsum(sizes)])
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    return pc.list_flatten(column), np.concatenate([[0], np.cumsum(sizes)])


def row_matches(hyp: pa.Array, ref: pa.Array, orders: int, chars: bool, parents: np.ndarray | None = None) -> np.ndarray:
    """(3, rows, orders): clipped matches, and the n-grams of each side, for n from 1 to orders. n-grams are numbered
    exactly, each by that of its first n - 1 items and its last one. parents: of several references to a row the row of
    each; an n-gram is then clipped by the largest count that one of them has, and the second side's n-grams are those of all.
    """
    refs = len(ref)
    parents = np.arange(refs) if parents is None else parents
    (a, at), (b, bt) = _lists(hyp, chars), _lists(ref, chars)
    if chars:
        codes = np.unique(np.concatenate([a, b]), return_inverse=True)[1].astype(np.int64)
    else:
        codes = pa.concat_arrays([a.cast(pa.string()), b.cast(pa.string())]).dictionary_encode().indices.to_numpy().astype(np.int64)
    rows = len(hyp)
    row = np.concatenate([np.repeat(np.arange(rows), np.diff(at)), np.repeat(np.arange(rows, rows + refs), np.diff(bt))])
    out, ids, here, kinds = np.zeros((3, rows, orders), np.int64), codes, np.arange(len(codes)), int(codes.max(initial=0)) + 1
    for n in range(orders):
        if n:
            on = (here + n < len(codes)) & (row[np.minimum(here + n, len(codes) - 1)] == row[here])
            here, ids = here[on], np.unique(ids[on] * kinds + codes[here[on] + n], return_inverse=True)[1].astype(np.int64)
        span = int(ids.max(initial=0)) + 1
        side = row[here] >= rows
        sizes = np.bincount(row[here], minlength=rows + refs)
        out[1, :, n], out[2, :, n] = sizes[:rows], np.bincount(parents, sizes[rows:], rows)
        mine, count = np.unique(row[here][~side] * span + ids[~side], return_counts=True)
        theirs, other = np.unique((row[here][side] - rows) * span + ids[side], return_counts=True)
        theirs = parents[theirs // span] * span + theirs % span
        order = np.argsort(theirs, kind="stable")
        begins = np.flatnonzero(np.diff(theirs[order], prepend=-1))
        theirs, other = theirs[order][begins], np.maximum.reduceat(other[order], begins) if len(order) else other
        _, i, j = np.intersect1d(mine, theirs, assume_unique=True, return_indices=True)
        np.add.at(out[0, :, n], mine[i] // span, np.minimum(count[i], other[j]))
    return out


def matches(rows: DataFrame, *sides: tuple[str, str, int, bool], many: bool = False) -> DataFrame:
    """rows without the columns of sides, and hit, hyp_n, ref_n (arrays by order, of one of sides after the other): clipped matches and n-grams of both sides of each row.

    sides: (hyp, ref, orders, chars), columns of word lists, or with chars of texts; with many, ref is a list of such references. Both sides of a row are at
    hand, so nothing is shuffled; what is summed up afterwards is three numbers a row and order. Texts and words go to Python and not back.
    """
    names = ("hit", "hyp_n", "ref_n")
    texts = [c for hyp, ref, _, _ in sides for c in (hyp, ref)]
    rest = [f for f in rows.schema.fields if f.name not in texts]
    schema = StructType([*rest, *(StructField(n, ArrayType(LongType())) for n in names)])

    def counted(piece: pa.RecordBatch) -> pa.RecordBatch:
        found = []
        for k, (_, _, orders, chars) in enumerate(sides):
            ref = piece.column(2 * k + 1)
            parents = pc.list_parent_indices(ref).to_numpy() if many else None
            found.append(row_matches(piece.column(2 * k), pc.list_flatten(ref) if many else ref, orders, chars, parents))
        whole = np.concatenate(found, axis=2)
        offsets = pa.array(np.arange(0, (piece.num_rows + 1) * whole.shape[2], whole.shape[2], dtype=np.int32))
        return pa.record_batch([*piece.columns[len(texts) :], *(pa.ListArray.from_arrays(offsets, pa.array(x.ravel())) for x in whole)], schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from map(counted, pieces(batch, list(range(len(texts))), COUNTED))
            del batch  # before the next one is read

    return rows.select(*texts, *(f.name for f in rest)).mapInArrow(run, schema)


def total(column: str, n: int) -> Column:
    return F.coalesce(F.sum(F.get(column, n - 1)), F.lit(0))


def closest(h: str, refs: str) -> Column:
    """The length of the reference that is nearest to h in length, of two as near the shorter; 0 without any."""
    near = F.array_min(F.transform(refs, lambda r: F.struct(F.abs(F.size(r) - F.size(h)).alias("off"), F.size(r).alias("n"))))
    return F.coalesce(near["n"], F.lit(0))


def bleu_sums(rows: DataFrame, many: bool) -> tuple[DataFrame, list[Column]]:
    """The rows' matches, and the sums that `bleu_of` wants of them."""
    if many:
        rows = rows.withColumn("r", F.filter(F.coalesce("r", F.array().cast("array<array<string>>")), lambda r: r.isNotNull()))
    rows = rows.withColumns({"_h": F.size("h"), "_r": closest("h", "r") if many else F.size("r")})
    sums = [F.sum("_h").alias("sys_len"), F.sum("_r").alias("ref_len")]
    sums += [total(c, n).alias(f"{n}_{c}") for n in range(1, ORDERS + 1) for c in ("hit", "hyp_n")]
    return matches(rows, ("h", "r", ORDERS, False), many=many), sums


def bleu_report(rows: DataFrame, columns: list[str], sets: list[list[str]], many: bool = False) -> DataFrame:
    """BLEU at several grains in one pass (E08): rows (columns, h, r) over the grouping sets of columns, as checkpoint, pair,
    book and draft. grain names a row's set; what is not in it is null. Rows without a draft count as empty ones."""
    rows = rows.select(*columns, F.coalesce("h", F.array().cast("array<string>")).alias("h"), "r")
    found, sums = bleu_sums(rows, many)
    table = found.groupingSets([[F.col(c) for c in s] for s in sets], *columns).agg(F.grouping_id().alias("_g"), *sums)
    ids = {sum(1 << k for k, c in enumerate(reversed(columns)) if c not in s): "+".join(c for c in columns if c in s) or "all" for s in sets}
    grain = F.create_map(*(F.lit(x) for pair in ids.items() for x in pair))[F.col("_g").cast("int")]
    return bleu_of(table.withColumn("grain", grain), ["grain", *columns], False)


def bleu(rows: DataFrame, by: list[str], effective: bool = False, many: bool = False) -> DataFrame:
    """BLEU per group `by` of rows (h, r: word arrays), with precisions, brevity penalty and lengths.

    Orders without a match are smoothed exponentially: the k-th of them counts 1 / (2**k * total). With
    `effective`, orders of which the system has no n-gram are left out, as for single sentences. With `many`, r is
    a list of references: matches are clipped by the largest count of one, and the nearest length counts.
    """
    found, sums = bleu_sums(rows.select(*by, "h", "r"), many)
    return bleu_of(found.groupBy(*by).agg(*sums) if by else found.agg(*sums), by, effective)


def bleu_of(table: DataFrame, by: list[str], effective: bool) -> DataFrame:
    zeros, logs, used, shown = F.lit(0), F.lit(0.0), F.lit(0), []
    for n in range(1, ORDERS + 1):
        hit, of = F.col(f"{n}_hit"), F.col(f"{n}_hyp_n")
        zeros = zeros + F.when((of > 0) & (hit == 0), 1).otherwise(0)
        p = F.when(of == 0, 0.0).when(hit == 0, 100.0 / (F.pow(F.lit(2.0), zeros) * of)).otherwise(hit * F.lit(100.0) / of)
        shown.append(F.round(p, 4).alias(f"p{n}"))
        logs = logs + F.when(of > 0, F.ln(F.when(p > 0, p))).otherwise(0.0)
        used = used + F.when(of > 0, 1).otherwise(0)
    orders = used if effective else F.lit(ORDERS)
    ratio = F.try_divide(F.col("ref_len"), F.col("sys_len"))
    bp = F.when(F.col("sys_len") == 0, 0.0).when(F.col("sys_len") >= F.col("ref_len"), 1.0).otherwise(F.exp(1 - ratio))
    whole = used > 0 if effective else used == ORDERS
    score = F.when(whole & (F.col("1_hit") > 0), bp * F.exp(logs / orders)).otherwise(0.0)
    return table.select(*by, F.round(score, 4).alias("bleu"), *shown, F.round(bp, 6).alias("bp"), "sys_len", "ref_len")


def bleu_by_draft(rows: DataFrame, draft: str) -> DataFrame:
    """BLEU of each draft and of all of them together, whose draft is null (E08): one pass, grouping sets over the sums.

    A row without a draft text counts as an empty one.
    """
    found, sums = bleu_sums(rows.select(draft, F.coalesce("h", F.array().cast("array<string>")).alias("h"), "r"), False)
    return bleu_of(found.cube(draft).agg(*sums), [draft], False)


def chrf_many(rows: DataFrame, by: list[str], key: list[str], word_order: int = 0, beta: float = 3.0) -> DataFrame:
    """`chrf` of rows (key, hyp, refs: texts) with several references: each row counts with the reference it scores best with, the
    first of equals. (key) is unique; it holds by."""
    each = rows.select(*key, "hyp", F.posexplode("refs").alias("_k", "ref"))
    alone = chrf(each, [*key, "_k"], word_order, beta)
    best = alone.groupBy(*key).agg(F.max(F.struct("chrf", (-F.col("_k")).alias("k"))).alias("b")).select(*key, (-F.col("b.k")).alias("_k"))
    return chrf(each.join(best, [*key, "_k"]), by, word_order, beta)


def chrf(rows: DataFrame, by: list[str], word_order: int = 0, beta: float = 3.0, orders: int = 6) -> DataFrame:
    """chrF per group of rows (hyp, ref: texts); word_order 1 gives chrF+, 2 chrF++.

    Characters without white space, orders 1 to 6. Without words: F of the mean precision and recall over the
    orders both sides have. With words: the mean over all orders of each order's own F.
    """
    squeeze = lambda c: F.regexp_replace(c, X.BLANK, "")
    apart = lambda c: X.tokens(F.regexp_replace(c, f"({X.PUNCT})", " $1 "))
    sides = [("h", "r", orders, True), ("hw", "rw", word_order, False)][: 1 + bool(word_order)]
    words = [apart("hyp").alias("hw"), apart("ref").alias("rw")] if word_order else []
    found = matches(rows.select(*by, squeeze("hyp").alias("h"), squeeze("ref").alias("r"), *words), *sides)
    n = orders + word_order
    sums = found.groupBy(*by).agg(*(total(c, k).alias(f"{c}{k}") for k in range(1, n + 1) for c in ("hit", "hyp_n", "ref_n")))
    ratio = lambda a, b: F.try_divide(F.col(a).cast("double"), F.col(b))
    f = lambda p, r: F.coalesce(F.try_divide((1 + beta**2) * p * r, beta**2 * p + r), F.lit(0.0))
    zero, pairs = F.lit(0.0), [(ratio(f"hit{k}", f"hyp_n{k}"), ratio(f"hit{k}", f"ref_n{k}")) for k in range(1, n + 1)]
    if word_order:
        score = sum((f(F.coalesce(p, zero), F.coalesce(r, zero)) for p, r in pairs), zero) / n
        return sums.select(*by, F.round(100 * score, 4).alias("chrf"))
    both = [(F.when(p.isNotNull() & r.isNotNull(), p), F.when(p.isNotNull() & r.isNotNull(), r)) for p, r in pairs]
    mean = lambda k: sum((F.coalesce(x[k], zero) for x in both), zero) / sum((x[k].isNotNull().cast("int") for x in both), F.lit(0))
    any_ = sum((x[0].isNotNull().cast("int") for x in both), F.lit(0)) > 0
    return sums.filter(any_).select(*by, F.round(100 * f(mean(0), mean(1)), 4).alias("chrf"))


def overlaps(rows: DataFrame, by: list[str]) -> DataFrame:
    """Mean per group of sentence scores of word arrays h and r (E06): GLEU, F of ROUGE-1, -2 and -L, and precision and
    recall of the sets of words. A score without anything to divide by is 0."""
    add = lambda c: F.aggregate(c, F.lit(0).cast("bigint"), lambda s, x: s + x)
    share = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))
    rouge = lambda hit, a, b: share(2 * hit, a + b)  # noqa: E731  F of hit / a and hit / b
    at = lambda c, k: F.get(c, k)
    sets = F.size(F.array_intersect("h", "r"))
    whole = {
        "rouge_l": rouge(U.common_subsequence("h", "r"), F.size("h"), F.size("r")),
        "set_precision": share(sets, F.size(F.array_distinct("h"))),
        "set_recall": share(sets, F.size(F.array_distinct("r"))),
    }
    found = matches(rows.select(*by, "h", "r", *(c.alias(n) for n, c in whole.items())), ("h", "r", ORDERS, False))
    each = found.select(
        *by,
        share(add("hit"), F.greatest(add("hyp_n"), add("ref_n"))).alias("gleu"),
        *(rouge(at("hit", k), at("hyp_n", k), at("ref_n", k)).alias(f"rouge{k + 1}") for k in (0, 1)),
        *whole,
    )
    return each.groupBy(*by).agg(*(F.round(F.avg(c), 6).alias(c) for c in each.columns if c not in by))


def reference_grams(rows: DataFrame, orders: int) -> DataFrame:
    """(n, g, b, hit, begun): the n-grams of r, words behind each other with a sign between that ends each; how often they stand there, how
    often h has them as well (clipped), and how many matches of n-grams one word longer begin with them. Equal ones of a few rows are one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (piece for whole in batches for piece in pieces(whole, [0, 1], COUNTED)):
            sums: dict[tuple[str, ...], list[int]] = {}
            for h, r in U.rows_of(tuple(batch.columns)):
                grams = lambda x: Counter(tuple(x[i : i + n]) for n in range(1, orders + 1) for i in range(len(x) - n + 1))
                mine = grams(h or [])
                for g, b in grams(r or []).items():
                    own = sums.setdefault(g, [0, 0, 0])
                    own[0] += b
                    if hit := min(b, mine[g]):
                        own[1] += hit
                        if len(g) > 1:
                            sums.setdefault(g[:-1], [0, 0, 0])[2] += hit
            keys = list(sums)
            yield pa.record_batch([
                pa.array([len(g) for g in keys], pa.int32()), pa.array(["".join(f"{w}\0" for w in g) for g in keys], pa.string()), *(pa.array([x[k] for x in sums.values()], pa.int64()) for k in range(3)),
            ], ["n", "g", "b", "hit", "begun"])

    return rows.mapInArrow(run, "n int, g string, b long, hit long, begun long")


def nist(rows: DataFrame, key: list[str], orders: int = 5) -> DataFrame:
    """(nist): the corpus score of word arrays h and r.

    An n-gram's weight is log2 of how often its first n - 1 words stand in the references over how often it does
    itself. So a match adds the log of its first words' count and takes off that of its own: each n-gram of a reference goes
    with its count, its matches and those of the n-grams that it begins, which its row tells, and is shuffled once.
    """
    words = rows.agg(F.sum(F.size("r")).alias("ref_len"), F.sum(F.size("h")).alias("sys_len"))
    told = reference_grams(rows.select("h", "r"), orders).groupBy("n", "g").agg(*(F.sum(c).alias(c) for c in ("b", "hit", "begun")))
    log = F.log2("b")
    sums = told.groupBy("n").agg(F.sum("hit").alias("hits"), F.sum(F.col("hit") * log).alias("own"), F.sum(F.col("begun") * log).alias("ahead"))
    shown = rows.select(F.explode(F.sequence(F.lit(1), F.lit(orders))).alias("n"), F.size("h").alias("size")).groupBy("n").agg(F.sum(F.greatest(F.col("size") - F.col("n") + 1, F.lit(0))).alias("shown"))
    before = sums.select((F.col("n") + 1).alias("n"), "ahead")
    each = shown.join(sums.drop("ahead"), "n", "left").join(before, "n", "left").crossJoin(F.broadcast(words))  # one row
    gain = F.when(F.col("n") == 1, F.col("hits") * F.log2("ref_len")).otherwise(F.col("ahead")) - F.col("own")
    score = each.agg(F.sum(F.coalesce(F.try_divide(gain, F.col("shown")), F.lit(0.0))).alias("score"))
    ratio = F.least(F.col("sys_len") / F.col("ref_len"), F.lit(1.0))
    penalty = F.exp(F.ln(F.lit(0.5)) / F.pow(F.ln(F.lit(1.5)), 2) * F.pow(F.ln(ratio), 2))  # 0.5 at two thirds of the length
    return score.crossJoin(F.broadcast(words)).select(F.round(F.col("score") * penalty, 4).alias("nist"))
