"""Near copies by the Jaccard similarity of their word shingles, exact from candidates to links.

A text is the set of its shingles' 64-bit hashes in one order that all texts share. If two sets have a similarity
of t, their overlap is at least t times the larger one, so the first shingle they share is among the first
n - ceil(t n) + 1 of both: texts that meet on no shingle of these prefixes cannot link, and no pair is lost.
Three bounds drop pairs that meet, each only if they cannot reach t: sizes, the places of the shared shingle,
and the bits of a parity sketch, of which each shingle that only one text has flips one (a short sketch first, then one
about as long as the set, so that few pairs of long texts meet in full). What is left is decided by the whole sets. Shingles that a sample finds often come last in the order; the sample decides the cost only.

Components need no pair within one of them, so three rounds follow each other, and each looks only at texts that are still
apart. The first takes its pairs from the Gray-order index of SimHash fingerprints: it joins the large groups of close
copies at little cost, but a similarity of 0.8 bounds no number of fingerprint bits, so it cannot be the only one. In
the second each text meets the first that it may be similar to on each shingle, in the third all that are left.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lineweave.llm.common import saved, unused
from lineweave.llm.components import star_components
from lineweave.llm.simhash import near_links
from lineweave.llm.tokens import PIECE, cut, joined, mixed, parts, span_hashes, spans

#: Texts to learn frequent shingles from, how often they must be there, and how many are kept.
SAMPLE, OFTEN, MAX_FREQUENT = 4096, 4, 65536
#: Least bits of a sketch; texts of one shingle that a task compares, as pairs of tiles; pairs compared at a time.
SKETCH, TILE, PAIRS = 512, 8192, 1 << 18
#: Bits that the fingerprints of the first round's pairs may differ in.
NEAR_BITS = 4


def shingles(texts: list[bytes], words: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of all shingles, repeated ones too: runs of `words` tokens, of fewer tokens all of them. A-Z are
    lower-cased. A text without a token has one shingle, 0."""
    buf, offsets = joined([t.lower() for t in texts])
    starts, ends = spans(buf, False)
    tokens, at = np.append(span_hashes(buf, starts, ends), np.uint64(0)), np.searchsorted(starts, offsets)
    n = np.diff(at)
    counts = np.maximum(n - words + 1, 1)
    text = np.repeat(np.arange(len(texts)), counts)
    first = np.arange(len(text)) - np.repeat(np.cumsum(counts) - counts - at[:-1], counts)
    length, hashes = np.minimum(n, words)[text], np.zeros(len(text), np.uint64)
    for k in range(words):
        more = mixed(hashes + tokens[np.minimum(first + k, len(tokens) - 1)] + np.uint64(k + 1))
        hashes = np.where(k < length, more, hashes)
    return text, hashes


def sets(texts: list[bytes], words: int, frequent: np.ndarray, often: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of each text's set: by text, then in the shared order (how often the sample has it, hash)."""
    text, hashes = shingles(texts, words)
    rank = np.zeros(len(hashes), np.int64)
    if len(frequent):
        place = np.minimum(np.searchsorted(frequent, hashes), len(frequent) - 1)
        rank = np.where(frequent[place] == hashes, often[place], 0)
    by = np.lexsort((hashes, rank, text))
    text, hashes = text[by], hashes[by]
    new = np.r_[True, (text[1:] != text[:-1]) | (hashes[1:] != hashes[:-1])][: len(text)]
    return text[new], hashes[new]


def sketches(text: np.ndarray, hashes: np.ndarray, n: int) -> np.ndarray:
    """(n, SKETCH / 8): the parity of the shingles that fall on each bit."""
    key, count = np.unique(text * SKETCH + (mixed(hashes) % np.uint64(SKETCH)).astype(np.int64), return_counts=True)
    key = key[count % 2 == 1]
    out = np.zeros(n * SKETCH // 8, np.uint8)
    np.bitwise_or.at(out, key >> 3, (1 << (key & 7)).astype(np.uint8))
    return out.reshape(n, SKETCH // 8)


def long_sketches(text: np.ndarray, hashes: np.ndarray, n: np.ndarray) -> list[bytes]:
    """The same in as many bits as the set has shingles, rounded up to a power of two."""
    bits = np.maximum(SKETCH, 1 << np.ceil(np.log2(np.maximum(n, 1))).astype(np.int64))
    ends = np.cumsum(bits)
    key = (ends - bits)[text] + (mixed(hashes) % bits[text].astype(np.uint64)).astype(np.int64)
    key, count = np.unique(key, return_counts=True)
    key = key[count % 2 == 1]
    out = np.zeros(int(ends[-1]) // 8 if len(ends) else 0, np.uint8)
    np.bitwise_or.at(out, key >> 3, (1 << (key & 7)).astype(np.uint8))
    return [out[(e - b) // 8 : e // 8].tobytes() for b, e in zip(bits.tolist(), ends.tolist(), strict=True)]


def fingerprints_of(text: np.ndarray, hashes: np.ndarray, n: int) -> np.ndarray:
    """SimHash of each of n texts: a bit is 1 if it is set in over half of its set's hashes. No set is empty."""
    first, out = np.searchsorted(text, np.arange(n)), np.zeros(n, np.uint64)
    size = np.diff(np.append(first, len(text)))
    for b in range(64 if n else 0):
        count = np.add.reduceat((hashes >> np.uint64(b)).astype(np.uint8) & 1, first, dtype=np.int32)
        out |= (2 * count > size).astype(np.uint64) << np.uint64(b)
    return out


def bits_apart(x: bytes, y: bytes) -> int:
    """Different bits of two long sketches, the longer one folded to the length of the other."""
    size = min(len(x), len(y))
    a, b = (np.bitwise_xor.reduce(np.frombuffer(z, np.uint64).reshape(-1, size // 8), axis=0) for z in (x, y))
    return int(np.bitwise_count(a ^ b).sum(dtype=np.int64))


def overlap_needed(total, t: Fraction):
    """The least overlap of two sets of `total` shingles together whose similarity is t or more."""
    p, q = t.numerator, t.numerator + t.denominator
    return -(-p * total // q)


def may_link(n, at, sketch, i, j, t: Fraction) -> np.ndarray:
    """Which pairs of rows (i, j), which share the shingle at these places, the bounds leave."""
    m, o = n[i], n[j]
    need = overlap_needed(m + o, t)
    on = np.flatnonzero(np.minimum(at[i], at[j]) + 1 + np.minimum(m - at[i], o - at[j]) - 1 >= need)
    apart = np.bitwise_count(sketch[i[on]] ^ sketch[j[on]]).sum(1, dtype=np.int64)
    return on[apart <= (m + o - 2 * need)[on]]


def pairs_of_runs(key, node, root, n, at, sketch, t: Fraction, every: bool) -> tuple[np.ndarray, np.ndarray]:
    """(a, b): pairs of nodes of other roots with equal key that may link. Each row's first one only, or every one.

    Rows are sorted by key and node.
    """
    end = np.searchsorted(key, key, "right")
    count = end - np.arange(len(key)) - 1
    upto, lo, linked, found = np.cumsum(count), 0, np.zeros(len(key), bool), []
    while lo < len(key):
        hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + PAIRS, "right")))
        i = np.repeat(np.arange(lo, hi), count[lo:hi])
        j = i + 1 + np.arange(len(i)) - np.repeat(upto[lo:hi] - count[lo:hi] - (upto[lo - 1] if lo else 0), count[lo:hi])
        on = (root[i] != root[j]) & ~linked[j]
        i, j = i[on], j[on]
        on = may_link(n, at, sketch, i, j, t)
        i, j = i[on], j[on]
        if not every:
            j, first = np.unique(j, return_index=True)  # i ascends
            i = i[first]
            linked[j] = True
        found.append(np.stack([node[i], node[j]]))
        lo = hi
    found = np.concatenate([np.zeros((2, 0), np.int64), *found], axis=1)
    found = np.unique(np.sort(found, axis=0), axis=1)
    return found[0], found[1]


def candidates(shared: DataFrame, t: Fraction, every: bool) -> DataFrame:
    """(a, b) of shared (s, k, node, root, n, at, sketch), where k rows have the shingle s."""
    tiles = F.ceil(F.col("k") / TILE).cast("int")
    each = shared.withColumn("own", F.pmod(F.xxhash64("node"), tiles).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), tiles - 1)))
    key = F.xxhash64("s", F.least("own", "other"), F.greatest("own", "other"))
    rows = each.select(key.alias("key"), "node", "root", "n", "at", "sketch").repartition("key").sortWithinPartitions("key", "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[pa.RecordBatch] = []  # whole runs, but for the last one

        def found(rows: pa.Table) -> pa.RecordBatch:
            key, node, root, n, at = (c.to_numpy() for c in rows.columns[:5])
            sketch = np.frombuffer(b"".join(rows.column(5).to_pylist()), np.uint64).reshape(-1, SKETCH // 64)
            a, b = pairs_of_runs(key, node, root, n.astype(np.int64), at.astype(np.int64), sketch, t, every)
            return pa.record_batch([pa.array(a), pa.array(b)], ["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            key = batch.column(0).to_numpy()
            cut = int(np.searchsorted(key, key[-1]))
            if cut or kept and kept[-1].column(0)[-1].as_py() != key[0]:
                yield found(pa.Table.from_batches([*kept, batch.slice(0, cut)]))
                kept = []
            kept.append(batch.slice(cut))
        if kept:
            yield found(pa.Table.from_batches(kept))

    return rows.mapInArrow(run, "a long, b long").distinct()


def plausible(pairs: DataFrame, sets_of: DataFrame, t: Fraction) -> DataFrame:
    """The pairs (a, b) that the long sketches leave."""
    of = lambda x, n, sketch: sets_of.select(F.col("node").alias(x), F.col("n").alias(n), F.col("long_sketch").alias(sketch))
    both = pairs.join(of("a", "m", "x"), "a").join(of("b", "o", "y"), "b").select("a", "b", "m", "o", "x", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total = (batch.column(2).to_numpy() + batch.column(3).to_numpy()).astype(np.int64)
            limit = (total - 2 * overlap_needed(total, t)).tolist()
            xy = zip(batch.column(4).to_pylist(), batch.column(5).to_pylist(), limit, strict=True)
            on = pa.array([bits_apart(x, y) <= most for x, y, most in xy], pa.bool_())
            yield pa.record_batch([batch.column(c).filter(on) for c in (0, 1)], ["a", "b"])

    return both.mapInArrow(run, "a long, b long")


def links(pairs: DataFrame, texts: DataFrame, words: int, t: Fraction) -> DataFrame:
    """The pairs (a, b) whose texts (node, text) have a similarity of t or more: decided by all their shingles."""
    wanted = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    whole = texts.join(wanted, "node", "left_semi").dropDuplicates(["node"])
    both = pairs.join(whole.select(F.col("node").alias("a"), F.col("text").alias("x")), "a")
    both = both.join(whole.select(F.col("node").alias("b"), F.col("text").alias("y")), "b").select("a", "b", "x", "y")
    none = np.zeros(0, np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (batch.column(c).cast(pa.binary()).to_pylist() for c in (2, 3))
            for lo, hi in cut([len(u) + len(v) for u, v in zip(x, y, strict=True)], PIECE):
                text, hashes = sets(x[lo:hi] + y[lo:hi], words, none, none)
                sizes = np.bincount(text, minlength=2 * (hi - lo))
                pair = text % (hi - lo)
                by = np.lexsort((hashes, pair))
                same = (hashes[by][1:] == hashes[by][:-1]) & (pair[by][1:] == pair[by][:-1])
                overlap = np.bincount(pair[by][1:][same], minlength=hi - lo)
                on = np.flatnonzero(overlap >= overlap_needed(sizes[: hi - lo] + sizes[hi - lo :], t))
                yield pa.record_batch([batch.column(c).take(pa.array(lo + on)) for c in (0, 1)], ["a", "b"])

    return both.mapInArrow(run, "a long, b long")


def frequent_shingles(texts: DataFrame, words: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, count), by hash: at most MAX_FREQUENT shingles found OFTEN in the first SAMPLE texts in order of node."""
    last = texts.select("node").distinct().orderBy("node").limit(SAMPLE).agg(F.max("node")).first()[0]
    if last is None:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    none = np.zeros(0, np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, raw in parts(batch, 0):
                yield pa.record_batch([pa.array(sets(raw, words, none, none)[1].view(np.int64))], ["s"])

    picked = texts.filter(F.col("node") <= last).dropDuplicates(["node"]).select("text")
    counts = picked.mapInArrow(run, "s long").groupBy("s").count().filter(F.col("count") >= OFTEN)
    top = counts.orderBy(F.desc("count"), "s").limit(MAX_FREQUENT).toArrow()
    hashes, often = top.column("s").to_numpy().view(np.uint64), top.column("count").to_numpy()
    by = np.argsort(hashes)
    return hashes[by], often[by]


def prefixes(texts: DataFrame, words: int, t: Fraction) -> DataFrame:
    """(node, n, fp, prefix, sketch, long_sketch) of each row's set."""
    shared = texts.sparkSession.sparkContext.broadcast(frequent_shingles(texts, words))  # MAX_FREQUENT at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, often = shared.value
        for batch in batches:
            for part, raw in parts(batch, 1):
                text, hashes = sets(raw, words, frequent, often)
                n = np.bincount(text, minlength=len(raw))
                take = n + 1 - -(-t.numerator * n // t.denominator)
                start = np.cumsum(n) - n
                inside = np.arange(len(text)) - start[text] < take[text]
                offsets = pa.array(np.r_[0, np.cumsum(take)].astype(np.int32))
                prefix = pa.ListArray.from_arrays(offsets, pa.array(hashes[inside].view(np.int64)))
                sketch = pa.array([s.tobytes() for s in sketches(text, hashes, len(raw))], pa.binary())
                whole = pa.array(long_sketches(text, hashes, n), pa.binary())
                fp = pa.array(fingerprints_of(text, hashes, len(raw)).view(np.int64))
                yield pa.record_batch([part.column(0), pa.array(n.astype(np.int32)), fp, prefix, sketch, whole], ["node", "n", "fp", "prefix", "sketch", "long_sketch"])

    return texts.select("node", "text").mapInArrow(run, "node long, n int, fp long, prefix array<long>, sketch binary, long_sketch binary")


def linked(texts: DataFrame, words: int, t: Fraction) -> DataFrame:
    """(node, root) of the texts (node, text) that have a link: root is the smallest node that links reach."""
    sets_of = saved(prefixes(texts, words, t).dropDuplicates(["node"]), "prefixes")
    dealt = sets_of.select("node", "n", F.posexplode("prefix").alias("at", "s"))
    often = sets_of.select(F.explode("prefix").alias("s")).groupBy("s").agg(F.count("*").alias("k")).filter("k > 1")  # summed up before they meet
    shared = saved(dealt.join(often, "s").join(sets_of.select("node", "sketch"), "node"), "shared")
    prints = sets_of.groupBy("fp").agg(F.min("node").alias("node"))
    level = sets_of.join(prints.withColumnRenamed("node", "first"), "fp").select(F.col("first").alias("a"), F.col("node").alias("b")).filter("a <> b")
    near = near_links(saved(prints.select("node", "fp"), "prints"), NEAR_BITS).select("a", "b").union(level)
    met = None
    stars = texts.sparkSession.createDataFrame([], "node long, root long")
    for pairs in (lambda apart: near, lambda apart: candidates(apart, t, every=False), lambda apart: candidates(apart, t, every=True)):
        apart = shared.join(stars, "node", "left").withColumn("root", F.coalesce("root", "node"))
        found = pairs(apart).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        found = found if met is None else found.join(met, ["a", "b"], "left_anti")
        found = saved(plausible(found, sets_of, t), "candidates")
        more = saved(links(found, texts, words, t), "links")
        met = found if met is None else met.union(found)
        if not more.isEmpty():
            stars = saved(star_components(more.union(stars.select("node", "root"))), "stars")
    return stars


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, node, text): node is the text's hash."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text")).withColumn("node", F.xxhash64("text"))


def similar_documents(docs: DataFrame, words: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, component_id): a row per document; component_id is the smallest id that links reach.

    Documents link if the Jaccard similarity of the sets of their word shingles is `similarity` or more. Null and
    empty texts, and those of white space, are equal. Repeated rows stay repeated. A null id is no candidate for
    component_id, which is null if a component has no other. Other columns of docs are not returned.
    """
    made = keyed(docs, id_col, text_col)
    firsts = saved(made.groupBy("node").agg(F.min("doc_id").alias("first")), "distinct")
    stars = linked(made, words, Fraction(str(similarity)))
    least = stars.join(firsts, "node").groupBy("root").agg(F.min("first").alias("low"))
    low = stars.join(least, "root").select("node", "low")
    named = firsts.join(low, "node", "left").select("node", F.coalesce("low", "first").alias("component_id"))
    return made.select("doc_id", "node").join(named, "node").select("doc_id", "component_id")


def first_of_similar(docs: DataFrame, words: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs reduced to one row of each component of `similar_documents`: that of the smallest id (null ids last), of texts
    that share it the one of the smallest hash, of repeated rows any one. All columns stay, whatever their names.
    """
    made = keyed(docs, id_col, text_col)
    each = made.groupBy("node", "doc_id").agg(F.count("*").alias("rows"))
    best = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "node", "rows"))
    firsts = saved(each.groupBy("node").agg(best.alias("f")), "distinct")
    stars = linked(made, words, Fraction(str(similarity)))
    of_group = firsts.join(stars, "node", "left").groupBy(F.coalesce("root", "node").alias("root")).agg(F.min("f").alias("f"))
    node, id_, n, times = unused(docs, "__node", "__id", "__n", "__rows")
    kept = saved(of_group.select(F.col("f.doc_id").alias(id_), F.col("f.node").alias(n), F.col("f.rows").alias(times)), "kept")
    rows = docs.withColumn(node, F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit(""))))
    same = (F.col(node) == F.col(n)) & F.col(id_col).cast("long").eqNullSafe(F.col(id_))
    once = rows.join(kept.filter(F.col(times) == 1).hint("shuffle_hash"), same, "left_semi")
    often = kept.filter(F.col(times) > 1)
    if not often.isEmpty():
        once = once.unionByName(rows.join(often, same, "left_semi").dropDuplicates([id_col, node]))
    return once.select(*docs.columns)
