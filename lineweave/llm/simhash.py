"""SimHash near-duplicates through a Gray-order hierarchical index.

Fingerprints are made in Arrow batches. Two fingerprints that differ in at most `bits` bits agree on a whole
block if the 64 bits are cut into bits + 1 of them (or on several of more blocks), so each distinct
fingerprint goes to one group for each such masked pattern. Within a group the fingerprints are sorted by the
Gray rank of their bits, pattern first. Runs that share their leading bits are the nodes of a hierarchy: the
shared bits are compared once for the whole run, the differences add up on the way down, and a run is pruned as soon as
they exceed the limit, or if all of it is linked to the query already. A group returns a forest (one row per
fingerprint at most), and the forests meet in `star_components`.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lineweave.llm.common import saved, table
from lineweave.llm.components import star_components
from lineweave.llm.tokens import mixed

#: Fingerprints in a group, as planned, and the most that one task takes at a time.
GROUP, TILE = 4096, 16384


def shingle_hashes(tokens: list[bytes], words: int, seed: int) -> Iterator[np.ndarray]:
    """XXH64 of each run of `words` tokens, blank-joined (of fewer tokens: all of them), some at a time."""
    n, digest = len(tokens), xxhash.xxh64_intdigest
    if n < words:
        yield np.array([digest(b" ".join(tokens), seed)], np.uint64)
        return
    joined = b" ".join(tokens)
    size = np.fromiter(map(len, tokens), np.int64, n)
    ends = np.cumsum(size + 1) - 1
    starts, ends = (ends - size)[: n - words + 1], ends[words - 1 :]
    for at in range(0, len(starts), 1 << 15):
        spans = zip(starts[at : at + (1 << 15)].tolist(), ends[at : at + (1 << 15)].tolist(), strict=True)
        yield np.array([digest(joined[s:e], seed) for s, e in spans], np.uint64)


def fingerprint(text: bytes, words: int, seed: int = 42, wide: int = 1) -> list[int]:
    """SimHash of the word shingles of UTF-8 text, A-Z lower-cased: a bit is 1 if it is set in over half of
    the hashes; 0 for no word. Beyond the first, each of `wide` fingerprints scrambles the hashes anew."""
    tokens = text.lower().split()
    if not tokens:
        return [0] * wide
    counts, n = np.zeros((wide, 64), np.int64), 0
    for hashes in shingle_hashes(tokens, words, seed):
        n += len(hashes)
        for k in range(wide):
            part = mixed(hashes + np.uint64(k)) if k else hashes
            counts[k] += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.uint32)
    return np.packbits(counts * 2 > n, axis=1, bitorder="little").view(np.uint64)[:, 0].tolist()


def fingerprints(docs: DataFrame, make: Callable[[bytes], list[int]], names: list[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, names): the fingerprints that make finds in each whole text, as longs. Null texts count as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.binary()).to_pylist()
            found = np.array([make(t or b"") for t in texts], np.uint64).reshape(-1, len(names))
            yield pa.record_batch([batch.column(0), *(pa.array(np.ascontiguousarray(c)) for c in found.view(np.int64).T)], ["doc_id", *names])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, " + ", ".join(f"{c} long" for c in names))


def spread(mask: int) -> list[int]:
    return [b for b in range(63, -1, -1) if mask >> b & 1]


def patterns(n: int, bits: int) -> list[tuple[int, int]]:
    """(mask, prefix) of each pattern: any two fingerprints within `bits` agree on one mask at least.

    More fingerprints get more blocks, of which two or three must agree: longer masks, hence smaller groups.
    The prefix is the part of the mask that deals out the groups, about GROUP fingerprints to each.
    """
    agree = next((a for a in (1, 2, 3) if n <= GROUP << (64 * a // (bits + a))), 4)
    blocks = bits + agree
    cuts = [round(64 * i / blocks) for i in range(blocks + 1)]
    parts = [sum(1 << b for b in range(lo, hi)) for lo, hi in zip(cuts, cuts[1:], strict=False)]
    found = []
    for chosen in combinations(parts, agree):
        mask = sum(chosen)
        long = min(mask.bit_count(), max(0, math.ceil(math.log2(max(1, n) / GROUP))))
        found.append((mask, sum(1 << b for b in spread(mask)[:long])))
    return found


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The integers start .. start + count - 1 of each pair, one after another."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - counts), counts)


def merge(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """labels (each the smallest member's index) after linking a[i] with b[i]."""
    while True:
        x, y = labels[a], labels[b]
        if (x == y).all():
            return labels
        up = np.arange(len(labels))
        np.minimum.at(up, np.maximum(x, y), np.minimum(x, y))
        while (up[up] != up).any():
            up = up[up]
        labels = up[labels]


def forest(fps: np.ndarray, mask: int, bits: int, wide: np.ndarray, wide_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(i, j): the rows that are linked to an earlier one within the group, and the root of each.

    Links: fps equal under mask that differ in at most `bits` bits, and whose rows of wide (rows, words)
    differ in at most wide_bits. Roots are first in Gray order.
    """
    order = spread(mask) + spread(~mask & (2**64 - 1))
    moved = np.zeros(len(fps), np.uint64)
    for to, b in enumerate(order):
        moved |= (fps >> np.uint64(b) & np.uint64(1)) << np.uint64(63 - to)
    rank = moved.copy()
    for s in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(s)
    by = np.argsort(rank, kind="stable")
    wide, moved = wide[by], moved[by]
    n, top = len(fps), max(mask.bit_count(), 1)
    depths = [top, *range(top + 2 * bits, 57, 2 * bits), 64]  # short steps could not exceed the limit
    starts, values = [], []
    for d in depths:
        head = moved >> np.uint64(64 - d)
        first = np.flatnonzero(np.r_[True, head[1:] != head[:-1]])
        starts.append(np.r_[first, n])
        values.append(head[first])
    below = [np.searchsorted(a[:-1], b) for a, b in zip(starts[1:], starts, strict=False)]
    root_of = np.searchsorted(starts[0], np.arange(n), "right") - 1
    labels = np.arange(n)
    step = max(16, (1 << 21) // n)
    for at in range(0, n, step):
        query = np.arange(at, min(n, at + step))
        node, spent = root_of[query], np.zeros(len(query), np.uint8)
        for level in range(1, len(depths)):
            first = below[level - 1][node]
            count = below[level - 1][node + 1] - first
            query, spent = np.repeat(query, count), np.repeat(spent, count)
            node = ranges(first, count)
            low = np.minimum.reduceat(labels, starts[level][:-1])
            low = np.where(low == np.maximum.reduceat(labels, starts[level][:-1]), low, -1)
            segment = np.uint64((1 << (depths[level] - depths[level - 1])) - 1)
            spent = spent + np.bitwise_count((moved[query] >> np.uint64(64 - depths[level]) ^ values[level][node]) & segment)
            on = (spent <= bits) & (starts[level][node + 1] > query + 1) & (low[node] != labels[query])
            query, node, spent = query[on], node[on], spent[on]
        first = np.maximum(starts[-1][node], query + 1)
        count = starts[-1][node + 1] - first
        query, other = np.repeat(query, count), ranges(first, count)
        if wide.shape[1]:
            on = labels[query] != labels[other]
            query, other = query[on], other[on]
            on = np.bitwise_count(wide[query] ^ wide[other]).sum(1, dtype=np.int64) <= wide_bits
            query, other = query[on], other[on]
        if len(query):
            labels = merge(labels, query, other)
    linked = np.flatnonzero(labels != np.arange(n))
    return by[linked], by[labels[linked]]


def near_links(distinct: DataFrame, bits: int, wide_bits: int = 0) -> DataFrame:
    """(a, b): forests over the rows of distinct (node, fp, w1, ...) that connect just what links connect: at most
    `bits` bits between fp, and wide_bits between all w together.

    A group beyond TILE rows (many near copies of one text) is cut into tiles by hash; each pair of tiles is a
    task of its own, so none takes more than two tiles and no link is lost.
    """
    masks = patterns(distinct.count(), bits)
    own, wide = distinct.columns, [c for c in distinct.columns if c[0] == "w"]
    keys = F.array(*(F.struct(F.lit(i).alias("p"), F.col("fp").bitwiseAND(F.lit(signed(x))).alias("g")) for i, (_, x) in enumerate(masks)))
    dealt = distinct.select(*own, F.explode(keys).alias("k")).select(*own, "k.p", "k.g")
    large = dealt.groupBy("p", "g").count().filter(F.col("count") > TILE)
    large = saved(large.select("p", "g", F.ceil(F.col("count") / TILE).cast("int").alias("tiles")), "large-groups")
    n_large = large.count()
    dealt = dealt.withColumn("i", F.lit(0)).withColumn("j", F.lit(0))
    if n_large:
        side = F.broadcast(large) if n_large <= 1_000_000 else large
        tile = F.pmod(F.xxhash64("node"), F.coalesce("tiles", F.lit(1))).cast("int")
        each = dealt.drop("i", "j").join(side, ["p", "g"], "left").withColumn("own", tile)
        each = each.withColumn("other", F.explode(F.sequence(F.lit(0), F.coalesce("tiles", F.lit(1)) - 1)))
        dealt = each.select(*own, "p", "g", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))

    def search(part: pd.DataFrame) -> pd.DataFrame:
        fps = part["fp"].to_numpy().view(np.uint64)
        more = np.ascontiguousarray(part[wide].to_numpy(np.int64)).view(np.uint64).reshape(len(part), len(wide))
        a, b = forest(fps, masks[part["p"].iat[0]][0], bits, more, wide_bits)
        node = part["node"].to_numpy()
        return pd.DataFrame({"a": node[a], "b": node[b]})

    return dealt.groupBy("p", "g", "i", "j").applyInPandas(search, "a long, b long")


def grouped(made: DataFrame, bits: int, wide_bits: int = 0) -> DataFrame:
    """made (doc_id, fp, w1, ...) and component_id, by the links of its distinct fingerprints."""
    prints = made.columns[1:]
    made = saved(made, "fingerprints")
    node = F.xxhash64(*prints) if len(prints) > 1 else F.col("fp")
    firsts = saved(made.groupBy(*prints).agg(F.min("doc_id").alias("first")).withColumn("node", node), "distinct")
    stars = star_components(near_links(firsts.select("node", *prints), bits, wide_bits).distinct())
    least = stars.join(firsts, "node").groupBy("root").agg(F.min("first").alias("low"))
    linked = stars.join(least, "root").select("node", "low")
    named = firsts.join(linked, "node", "left").select(*prints, F.coalesce("low", "first").alias("component_id"))
    return made.join(named, prints).select(*made.columns, "component_id")


def near_duplicates(docs: DataFrame, words: int = 4, bits: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp, component_id): a row per document; component_id is the smallest id that links reach.

    Documents link if their fingerprints differ in at most `bits` bits.
    Null and empty texts, and those of white space, have fingerprint 0 and link like any other. Repeated rows
    stay repeated. A null id is no candidate for component_id, which is null if a component has no other. Other
    columns of docs are not returned.
    """
    return grouped(fingerprints(docs, lambda t: fingerprint(t, words), ["fp"], id_col, text_col), bits)


def op4_simhash(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"), words=4, bits=4)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
