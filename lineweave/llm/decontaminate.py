"""Benchmark decontamination by suffix arrays of the training texts.

The training documents are cut into shards where they lie: a few megabytes of whole documents. Each shard is a sorted
array of its suffixes of words, and every suffix of every benchmark text is binary-searched in it. The range of
suffixes that begin with a window of the benchmark gives all places of that window, the neighbours of the place
searched for give the longest verbatim match. Documents never move: a shard's rows get their spans, benchmark items
and longest match where they were read, and affected documents are removed by a filter.

The benchmark is the stated query set. It is cut into blocks of BLOCK_BYTES at most (a single longer piece is a block of
its own), which are broadcast one after another; the documents are gone through once for each block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lineweave.llm.common import added, saved, table
from lineweave.llm.words import blocks, kinds, words_of

WINDOW = 10
#: Bytes of benchmark words in one broadcast, and words in one piece of a benchmark text.
BLOCK_BYTES, PIECE_WORDS = 16 << 20, 1 << 16
#: Words are ASCII letters and digits and all that is beyond ASCII.
KIND = kinds(bytes([*range(48), *range(58, 65), *range(91, 97), *range(123, 128)]))
HITS = "struct<n_words: long, spans: array<struct<start: long, end: long>>, items: array<string>>"


class Packed:
    """Texts of word numbers (1 and up; 0 ends a run), with m words packed into each 64-bit key."""

    def __init__(self, ids: np.ndarray, bits: int) -> None:
        self.bits, self.m = bits, 63 // bits
        n = len(ids)
        stops = np.flatnonzero(ids == 0)
        place = np.arange(n)
        ends = np.append(stops, n)
        self.run = ends[np.searchsorted(ends, place)] - place  # words from here to the end of the run
        padded = np.append(ids, np.zeros(self.m, ids.dtype)).astype(np.int64)
        key = np.zeros(n, np.int64)
        for j in range(self.m):
            key = (key << bits) | np.where(self.run > j, padded[j : j + n], 0)
        self.keys = key

    def at(self, places: np.ndarray, depth: int | np.ndarray) -> np.ndarray:
        """The keys of the m words that lie depth words behind these places, 0 where the run has ended."""
        inside = self.run[places] > depth
        return np.where(inside, self.keys[np.where(inside, places + depth, 0)], 0) if len(self.keys) else np.zeros(len(places), np.int64)


def suffix_array(text: Packed, depth: int) -> np.ndarray:
    """The places of all suffixes, sorted by their first `depth` words at least (prefix doubling from packed keys)."""
    sa = np.flatnonzero(text.run > 0)
    sa = sa[np.argsort(text.keys[sa], kind="stable")]
    if not len(sa):
        return sa
    rank = np.zeros(len(text.run) + 1, np.int64)

    def starts_of(changed: np.ndarray) -> np.ndarray:
        return np.concatenate([[0], np.flatnonzero(changed) + 1])

    sorted_keys = text.keys[sa]
    starts = starts_of(sorted_keys[1:] != sorted_keys[:-1])
    sizes = np.diff(np.append(starts, len(sa)))
    rank[sa] = np.repeat(starts + 1, sizes)  # a rank is the first place of the group, counted from 1
    h = text.m
    open_ = np.repeat(sizes > 1, sizes)
    while h < depth:
        slots = np.flatnonzero(open_)
        places = sa[slots]
        longer = text.run[places] > h
        if not longer.any():
            break  # all that tie have ended, so they are equal
        group, further = rank[places], np.where(longer, rank[np.minimum(places + h, len(rank) - 1)], 0)
        order = np.lexsort((further, group))
        sa[slots] = places[order]
        group, further = group[order], further[order]
        first = starts_of((group[1:] != group[:-1]) | (further[1:] != further[:-1]))
        sizes = np.diff(np.append(first, len(slots)))
        rank[sa[slots]] = np.repeat(slots[first] + 1, sizes)
        open_[slots] = np.repeat(sizes > 1, sizes)
        h *= 2
    return sa


def bounds(text: Packed, sa: np.ndarray, lo: np.ndarray, hi: np.ndarray, keys: np.ndarray, depth: int, shift: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Binary search, for all at once: the part of each range [lo, hi) whose key at this depth, shifted, is the one sought."""
    out = []
    for right in (False, True):
        low, high = lo.copy(), hi.copy()
        while (going := np.flatnonzero(low < high)).size:
            mid = (low[going] + high[going]) >> 1
            have = text.at(sa[mid], depth) >> shift[going]
            want = keys[going] >> shift[going]
            up = have <= want if right else have < want
            low[going] = np.where(up, mid + 1, low[going])
            high[going] = np.where(up, high[going], mid)
        out.append(low)
    return out[0], out[1]


def prefix_ranges(text: Packed, sa: np.ndarray, test: Packed, places: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each test suffix the range of text suffixes that begin with its first `length` words; if there are none,
    the empty range at the place where those of its longest match meet."""
    lo, hi = np.zeros(len(places), np.int64), np.full(len(places), len(sa), np.int64)
    depth = 0
    while (going := np.flatnonzero((lo < hi) & (length > depth))).size:
        left = np.minimum(length[going] - depth, text.m)
        low, high = bounds(text, sa, lo[going], hi[going], test.at(places[going], depth), depth, (text.m - left) * text.bits)
        lo[going], hi[going] = low, high
        depth += text.m
    return lo, hi


def common_words(text: Packed, at: np.ndarray, test: Packed, places: np.ndarray) -> np.ndarray:
    """How many words a text suffix and a test suffix have in common at their beginnings; at below 0: none."""
    out = np.zeros(len(at), np.int64)
    going, depth = np.flatnonzero(at >= 0), 0
    while going.size:
        a, b = text.at(at[going], depth), test.at(places[going], depth)
        left = np.minimum(test.run[places[going]] - depth, text.m)
        same = np.zeros(len(going), np.int64)
        for j in range(text.m):
            cut = (text.m - 1 - j) * text.bits
            same += ((a >> cut) == (b >> cut)) & (j < left)
        out[going] += same
        going = going[same == text.m]
        depth += text.m
    return out


class Bench:
    """A block of the benchmark: its words numbered, its texts one after another with a 0 between them."""

    def __init__(self, ids: list[str | None], ats: list[int], texts: list[list[str]], window: int) -> None:
        self.ids, self.ats = ids, np.array(ats, np.int64)
        sizes = np.array([len(t) for t in texts], np.int64)
        flat = pa.array([w for t in texts for w in t], pa.string())
        coded = flat.dictionary_encode()
        self.vocabulary = coded.dictionary
        self.bits = max(1, int(len(self.vocabulary)).bit_length())
        numbers = np.zeros(int(sizes.sum()) + len(sizes), np.int32)
        self.item = np.repeat(np.arange(len(sizes)), sizes + 1)
        self.place = np.arange(len(numbers)) - np.repeat(np.cumsum(sizes + 1) - sizes - 1, sizes + 1)
        inside = self.place < np.repeat(sizes, sizes + 1)
        numbers[inside] = coded.indices.to_numpy() + 1
        self.text = Packed(numbers, self.bits)
        self.places = np.flatnonzero(inside)
        whole = np.minimum(sizes, window)[self.item[self.places]]
        self.windows = self.places[self.text.run[self.places] >= whole]
        self.width = np.minimum(sizes, window)[self.item[self.windows]]
        self.longest = int(sizes.max(initial=0))


class Shard:
    """Some training documents, one after another with a 0 between them, and their suffix array."""

    def __init__(self, texts: pa.Array, bench: Bench) -> None:
        got = words_of(texts, KIND)
        ids = pc.fill_null(pc.index_in(got.words, value_set=bench.vocabulary.cast(got.words.type)), -1).to_numpy(zero_copy_only=False) + 1
        self.n_words = np.bincount(got.doc, minlength=got.n_docs)
        numbers = np.zeros(len(ids) + got.n_docs, np.int32)
        self.head = np.cumsum(self.n_words + 1) - self.n_words - 1
        numbers[np.arange(len(ids)) + got.doc] = ids
        self.doc = np.repeat(np.arange(got.n_docs), self.n_words + 1)
        self.text = Packed(numbers, bench.bits)
        self.sa = suffix_array(self.text, bench.longest)

    def occurrences(self, bench: Bench) -> tuple[np.ndarray, dict[int, set[int]]]:
        """Which words lie in an occurrence of a window, and the benchmark texts whose windows each document holds."""
        lo, hi = prefix_ranges(self.text, self.sa, bench.text, bench.windows, bench.width)
        met = np.flatnonzero(lo < hi)
        edges = np.zeros(len(self.doc) + 1, np.int64)
        docs: dict[int, set[int]] = {}
        if not met.size:
            return edges[:-1] > 0, docs
        ranges, which = np.unique(np.stack([lo[met], hi[met], bench.width[met]]), axis=1, return_inverse=True)
        items = np.unique(np.stack([which.reshape(-1), bench.item[bench.windows[met]]]), axis=1)
        cuts = np.searchsorted(items[0], np.arange(ranges.shape[1] + 1))
        for k, (low, high, width) in enumerate(ranges.T):
            at = self.sa[low:high]
            np.add.at(edges, at, 1)
            np.add.at(edges, at + width, -1)
            own = items[1, cuts[k] : cuts[k + 1]].tolist()
            for d in np.unique(self.doc[at]).tolist():
                docs.setdefault(d, set()).update(own)
        return np.cumsum(edges[:-1]) > 0, docs

    def matches(self, bench: Bench) -> tuple[np.ndarray, np.ndarray]:
        """For each benchmark suffix the length of its longest verbatim match here."""
        lo, hi = prefix_ranges(self.text, self.sa, bench.text, bench.places, bench.text.run[bench.places])
        if not len(self.sa):
            return np.zeros(len(lo), np.int64)
        beside = [np.where(lo > 0, self.sa[np.maximum(lo - 1, 0)], -1), np.where(lo < len(self.sa), self.sa[np.minimum(lo, len(self.sa) - 1)], -1)]
        return np.maximum(*(common_words(self.text, at, bench.text, bench.places) for at in beside))


def runs(flags: np.ndarray) -> list[tuple[int, int]]:
    edges = np.flatnonzero(np.diff(np.concatenate([[False], flags, [False]]).astype(np.int8)))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))


def bench_pieces(benchmark: DataFrame, id_col: str, text_col: str, window: int) -> DataFrame:
    """(item_id, at, words, size): the benchmark's texts as words, long ones in overlapping pieces that share
    window - 1 words, so that each window is whole in one of them."""
    piece = PIECE_WORDS
    step = piece - window + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, "text"):
            got = words_of(batch.column(1), KIND)
            cuts = np.searchsorted(got.doc, np.arange(got.n_docs + 1)).tolist()
            rows = []
            for i, (lo, hi) in enumerate(zip(cuts, cuts[1:], strict=False)):
                for at in range(0, max(hi - lo - window + 1, 1) if hi > lo else 0, step):
                    words = got.words[lo + at : min(hi, lo + at + piece)].to_pylist()
                    rows.append((batch.column(0)[i].as_py(), at, words, sum(map(len, words)) + len(words)))
            kinds_ = (pa.string(), pa.int64(), pa.list_(pa.string()), pa.int64())
            yield pa.record_batch([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds_)], ["item_id", "at", "words", "size"])

    texts = benchmark.select(F.col(id_col).cast("string").alias("item_id"), F.col(text_col).cast("string").alias("text"))
    return texts.mapInArrow(run, "item_id string, at long, words array<string>, size long")


def bench_blocks(benchmark: DataFrame, id_col: str, text_col: str, window: int) -> Iterator[Bench]:
    """The blocks of the benchmark, each brought to the driver by itself: BLOCK_BYTES or a single piece at most."""
    pieces = saved(bench_pieces(benchmark, id_col, text_col, window).distinct(), "benchmark")
    n = max(1, -(-(pieces.agg(F.sum("size")).first()[0] or 0) // (BLOCK_BYTES // 2)))
    while True:
        dealt = pieces.withColumn("block", F.pmod(F.xxhash64("item_id", "at", "words"), F.lit(n)).cast("int"))
        most = dealt.groupBy("block").agg(F.sum("size").alias("size"), F.count("*").alias("n")).filter(F.col("n") > 1).agg(F.max("size")).first()[0]
        if (most or 0) <= BLOCK_BYTES:
            break
        n *= 2
    for k in range(n):
        rows = dealt.filter(F.col("block") == k).select("item_id", "at", "words").toArrow()
        if rows.num_rows or n == 1:
            yield Bench(*(rows.column(c).to_pylist() for c in ("item_id", "at", "words")), window)


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """docs with a column __hits: n_words; spans (words from 0, end exclusive) covered by occurrences of benchmark
    windows; items, the sorted ids whose windows occur.

    Words are runs of ASCII letters, digits and characters beyond ASCII, A-Z lower-cased. A window is `window`
    consecutive words of one benchmark text; a text of fewer words, but not none, is one window. Null and empty texts
    have no words. Repeated documents each get their row, repeated items of one id are one item; an item without an id
    marks words but is not listed. A column __hits of docs is replaced, all others stay.
    """
    docs, schema = added(docs, "__hits", HITS)
    fields, first = docs.columns, True
    for bench in bench_blocks(benchmark, id_col, text_col, window):
        sent = docs.sparkSession.sparkContext.broadcast(bench)
        docs = docs if first else saved(docs, "hits")

        def run(batches: Iterator[pa.RecordBatch], sent=sent, first=first) -> Iterator[pa.RecordBatch]:
            bench = sent.value
            for batch in blocks(batches, text_col):
                shard = Shard(batch.column(fields.index(text_col)), bench)
                covered, items = shard.occurrences(bench)
                old = [None] * batch.num_rows if first else batch.column(len(fields)).to_pylist()
                rows = []
                for d in range(batch.num_rows):
                    n, head = int(shard.n_words[d]), int(shard.head[d])
                    flags = covered[head : head + n]
                    names = {bench.ids[i] for i in items.get(d, ())} - {None}
                    if old[d]:
                        flags = flags.copy()
                        for s in old[d]["spans"]:
                            flags[s["start"] : s["end"]] = True
                        names |= set(old[d]["items"])
                    rows.append({"n_words": n, "spans": [{"start": s, "end": e} for s, e in runs(flags)], "items": sorted(names)})
                yield pa.record_batch([*batch.columns[: len(fields)], pa.array(rows, hits_type())], [*fields, "__hits"])

        docs = docs.mapInArrow(run, schema)
        first = False
    return docs


def hits_type() -> pa.DataType:
    span = pa.struct([("start", pa.int64()), ("end", pa.int64())])
    return pa.struct([("n_words", pa.int64()), ("spans", pa.list_(span)), ("items", pa.list_(pa.string()))])


def longest_matches(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", doc_text: str = "text", id_col: str = "item_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """(item_id, words, item_at, doc_id, doc_at): the longest verbatim match of each benchmark text in any document.

    Each shard sends one row for each benchmark text it has a word of. Of equally long matches the first place in the
    item counts, then the smallest doc_id and place (null ids first). Items of which no word occurs have no row.
    """
    slim = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(doc_text).cast("string").alias("text"))
    found = None
    for bench in bench_blocks(benchmark, id_col, text_col, window):
        sent = docs.sparkSession.sparkContext.broadcast(bench)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            bench = sent.value
            for batch in blocks(batches, "text"):
                shard = Shard(batch.column(1), bench)
                length = shard.matches(bench)
                keep = np.flatnonzero(length > 0)
                item = bench.item[bench.places[keep]]
                order = keep[np.lexsort((bench.place[bench.places[keep]], -length[keep], item))]
                order = order[np.unique(bench.item[bench.places[order]], return_index=True)[1]]
                lo, hi = prefix_ranges(shard.text, shard.sa, bench.text, bench.places[order], length[order])
                ids = batch.column(0).to_pylist()
                rows = []
                for k, low, high in zip(order.tolist(), lo.tolist(), hi.tolist(), strict=True):
                    at = shard.sa[low:high].tolist()
                    p = min(at, key=lambda x: (ids[shard.doc[x]] is not None, ids[shard.doc[x]] or 0, x))
                    d, i = int(shard.doc[p]), int(bench.item[bench.places[k]])
                    rows.append((bench.ids[i], int(length[k]), int(bench.place[bench.places[k]] + bench.ats[i]), ids[d], int(p - shard.head[d])))
                types = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
                yield pa.record_batch([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], ["item_id", "words", "item_at", "doc_id", "doc_at"])

        part = slim.mapInArrow(run, "item_id string, words long, item_at long, doc_id long, doc_at long")
        found = part if found is None else found.unionByName(part)
    rank = F.struct((-F.col("words")).alias("short"), "item_at", "doc_id", "doc_at")
    best = found.groupBy("item_id").agg(F.min(rank).alias("best"))
    return best.select("item_id", (-F.col("best.short")).alias("words"), "best.item_at", "best.doc_id", "best.doc_at")


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """docs without those that hold a window of the benchmark (see `contamination`); their columns stay as they are."""
    hits = contamination(docs, benchmark, id_col, text_col, window)
    return hits.filter(F.size("__hits.spans") == 0).select(*(c for c in docs.columns if c != "__hits"))


def op11_decontaminate(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = contamination(docs, table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("__hits.spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select(
        "doc_id",
        F.col("__hits.n_words").alias("n_words"),
        n_hit.alias("n_hit"),
        F.size("__hits.items").cast("long").alias("n_items"),
        F.sha2(F.array_join("__hits.items", ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLE = f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
q AS (SELECT item_id, len(w) AS n, least(len(w), {WINDOW}) AS k, w FROM b WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS s
        FROM (SELECT item_id, k, w, unnest(range(1, n - k + 2)) AS i FROM q)),
p AS (SELECT r, k, i, array_to_string(w[i:i + k - 1], ' ') AS s
      FROM (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM q))),
h AS (SELECT p.r, p.i, p.k, win.item_id FROM p JOIN win USING (k, s)),
hit AS (SELECT r, count(DISTINCT i + j) AS n_hit FROM (SELECT DISTINCT r, i, k, unnest(range(0, k)) AS j FROM h) GROUP BY r),
it AS (SELECT r, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM h GROUP BY r)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(hit.n_hit, 0)::BIGINT AS n_hit, coalesce(it.n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(it.ids, '')) AS items_sha256, coalesce(hit.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN it USING (r)
"""
