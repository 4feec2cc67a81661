"""Phrase collocations by multikey three-way quicksort of suffix pointers.

A suffix is the words from one place to the end of its piece, `longest` words at most. Three passes:

1. Words are counted by language. Leading pairs and triples of words are counted in 2**BUCKET_BITS buckets a task, summed
   over all tasks: a bucket below min_count holds no frequent phrase, so a suffix ends before the first word that would
   lead it into such a bucket, and one of fewer than two words is not sent at all. Buckets hold no phrase back that is
   frequent, however full they are: exact counts come later.
2. Equal suffixes of a task become one with a weight, and sorted runs of them are cut at the borders of ranges of leading
   words and routed. Borders come from a bounded sample of evenly spaced suffixes of all runs. A range ends wherever its share
   is reached, even between suffixes that begin alike, so no frequent word or phrase weighs on one task.
3. Each task sorts pointers to its suffixes by multikey three-way quicksort, all segments of a round at once: the
   segment equal to its pivot goes one word deeper and its weight is the count of that prefix; segments that weigh less
   than min_count are abandoned. Only the prefixes of a range's first and last suffix can reach into another range, so
   they are sent whatever they weigh, and summed up.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lineweave.llm.common import saved, table
from lineweave.llm.tokens import mixed, span_hashes
from lineweave.llm.words import Words, blocks, kinds, words_of

LONGEST, MIN_COUNT, COVER_PCT, TOP = 5, 100, 100, 2000
#: Buckets of leading words; counts are kept in a byte each and stay at its largest value. They travel a kilobyte a row, as
#: Arrow takes thousands of rows at a time.
BUCKET_BITS, CHUNK_BITS = 24, 10
#: Suffixes in a range, on average; shares of a language that are ranked apart before they meet.
RANGE_ROWS, SHARES = 1 << 18, 32
#: Bytes of text whose words are held at a time.
TEXT_BYTES = 1 << 20
#: Suffixes of a task that are held to be summed up before they are sent; runs show every SPACING-th suffix, and about SAMPLES
#: of these at most tell the borders of ranges.
MERGE_ROWS, SPACING, SAMPLES = 1 << 16, 64, 1 << 16
#: Suffixes in a row of a run, and those that are routed at a time. Spark reads 4096 rows and Arrow takes 10,000 at once, however long they
#: are, so a row is a few kilobytes.
RUN_ROWS, ROUTED = 1 << 6, 1 << 14
RUN = "lang array<string>, phrase array<string>, n array<long>"
KIND = kinds(b" \t", b".,;:!?\n\x0b\x0c\r")
FACTORS = [np.uint64(f) for f in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


class Block:
    """The words of some texts as numbers, and the hashes of the pairs and triples that begin at each."""

    def __init__(self, langs: pa.Array, texts: pa.Array) -> None:
        got: Words = words_of(texts, KIND)
        coded = got.words.dictionary_encode()
        langs = pc.fill_null(langs.cast(pa.string()), "und").dictionary_encode()
        self.vocabulary, self.langs = coded.dictionary.cast(pa.string()), langs.dictionary
        self.code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        self.lang = langs.indices.to_numpy(zero_copy_only=False).astype(np.int64)[got.doc]
        self.piece = got.piece
        n = len(self.code)
        word, lang = hashes(self.vocabulary), hashes(self.langs)
        own = word[self.code]
        self.together = np.zeros((2, n), bool)  # whether the next one, the next two words are of the same piece
        self.together[0, : n - 1] = self.piece[1:] == self.piece[:-1]
        self.together[1, : max(n - 2, 0)] = self.piece[2:] == self.piece[:-2] if n > 2 else False
        pair = lang[self.lang] + own * FACTORS[0]
        pair[: n - 1] += own[1:] * FACTORS[1]
        triple = pair.copy()
        triple[: max(n - 2, 0)] += own[2:] * FACTORS[2]
        self.buckets = [(mixed(h) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64) for h in (pair, triple)]


def hashes(words: pa.Array) -> np.ndarray:
    n = len(words)
    at = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + n + 1].astype(np.int64)
    raw = words.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and len(raw) else np.zeros(1, np.uint8)
    return span_hashes(data, at[:-1], at[1:])


def summed_up(parts: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.RecordBatch]:
    """The rows (keys, n), equal ones added up as long as all fit into MERGE_ROWS."""
    held, n = [], 0

    def merged() -> pa.Table:
        return pa.concat_tables(held).group_by(keys).aggregate([("n", "sum")]).rename_columns({"n_sum": "n"})

    for part in parts:
        held.append(pa.Table.from_batches([part]))
        n += part.num_rows
        if n < MERGE_ROWS:
            continue
        held = [merged()]
        n = held[0].num_rows
        if n >= MERGE_ROWS // 2:
            yield from held[0].to_batches(max_chunksize=1 << 16)
            held, n = [], 0
    if held:
        yield from merged().to_batches(max_chunksize=1 << 16)


def first_pass(docs: DataFrame) -> DataFrame:
    """(lang, word, n) and (chunk, counts): words and buckets of leading words counted by task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["lang", "word", "n", "chunk", "counts"]
        full = [np.zeros(1 << BUCKET_BITS, np.uint8) for _ in range(2)]

        def words() -> Iterator[pa.RecordBatch]:
            for batch in blocks(batches, "text", TEXT_BYTES):
                block = Block(batch.column(0), batch.column(1))
                each, n = np.unique(block.lang * len(block.vocabulary) + block.code, return_counts=True)
                lang, word = np.divmod(each, max(len(block.vocabulary), 1))
                yield pa.record_batch([block.langs.take(pa.array(lang)), block.vocabulary.take(pa.array(word)), pa.array(n)], names[:3])
                for counts, bucket, inside in zip(full, block.buckets, block.together, strict=True):
                    met, n = np.unique(bucket[inside], return_counts=True)
                    counts[met] = np.minimum(counts[met] + n, 255)

        for part in summed_up(words(), ["lang", "word"]):
            yield pa.record_batch([*part.columns, pa.nulls(part.num_rows, pa.int32()), pa.nulls(part.num_rows, pa.binary())], names)
        per, size = 1 << (BUCKET_BITS - CHUNK_BITS), 1 << CHUNK_BITS
        for order, counts in enumerate(full):
            parts = [(order * per + c, counts[c * size : (c + 1) * size]) for c in range(per)]
            parts = [(c, p.tobytes()) for c, p in parts if p.any()]
            if parts:
                k = len(parts)
                yield pa.record_batch([pa.nulls(k, pa.string()), pa.nulls(k, pa.string()), pa.nulls(k, pa.int64()), pa.array([c for c, _ in parts], pa.int32()), pa.array([p for _, p in parts], pa.binary())], names)

    return docs.mapInArrow(run, "lang string, word string, n long, chunk int, counts binary")


def frequent_buckets(counts: DataFrame, min_count: int) -> list[np.ndarray]:
    """A bit for each bucket of pairs and of triples: whether it holds min_count of them (4 MB in all)."""
    least = min(min_count, 255)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for c, part in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                part = np.frombuffer(part, np.uint8)
                sums[c] = np.minimum(sums[c] + part, 1 << 16) if c in sums else part.astype(np.uint32)
        yield pa.record_batch([pa.array(list(sums), pa.int32()), pa.array([np.packbits(s >= least).tobytes() for s in sums.values()], pa.binary())], ["chunk", "bits"])

    bits = np.zeros((2, 1 << (BUCKET_BITS - 3)), np.uint8)
    per, size = 1 << (BUCKET_BITS - CHUNK_BITS), 1 << (CHUNK_BITS - 3)
    told = counts.repartition("chunk").mapInArrow(run, "chunk int, bits binary").toArrow()
    for c, part in zip(told.column("chunk").to_pylist(), told.column("bits").to_pylist(), strict=True):
        bits[c // per, (c % per) * size : (c % per + 1) * size] = np.frombuffer(part, np.uint8)
    return list(bits)


def suffixes(docs: DataFrame, bits: list[np.ndarray], longest: int) -> DataFrame:
    """Runs (lang, phrase, n: lists), sorted, of the suffixes that may hold a frequent phrase, each word followed by a space,
    equal ones of a task once with their number, as long as they fit into MERGE_ROWS."""
    sent = docs.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in summed_up(each_block(batches), ["lang", "phrase"]):
            yield from run_of(part.sort_by([("lang", "ascending"), ("phrase", "ascending")]), RUN_ROWS)

    def each_block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = sent.value
        for batch in blocks(batches, "text", TEXT_BYTES):
            block = Block(batch.column(0), batch.column(1))
            n = len(block.code)
            pair, triple = (inside & ((b[bucket >> 3] >> (7 - (bucket & 7)).astype(np.uint8)) & 1).astype(bool) for b, bucket, inside in zip(bits, block.buckets, block.together, strict=True))
            length = np.where(pair, 2, 1)
            going = pair
            for k in range(3, longest + 1):
                further = np.zeros(n, bool)
                further[: max(n - k + 3, 0)] = triple[k - 3 :]
                going = going & further
                length[going] = k
            at = np.flatnonzero(length > 1)
            m, length = len(at), length[at]
            words = np.full((longest, m), -1, np.int64)
            key = np.zeros(m, np.uint64)
            for j in range(longest):
                has = length > j
                words[j, has] = block.code[at[has] + j]
                key = mixed(key * FACTORS[0] + words[j].astype(np.uint64) + np.uint64(7))
            key += block.lang[at].astype(np.uint64)
            order = np.argsort(key)
            words, lang = words[:, order], block.lang[at][order]
            new = np.ones(m, bool)
            new[1:] = (lang[1:] != lang[:-1]) | (words[:, 1:] != words[:, :-1]).any(axis=0)  # equal hashes of unlike suffixes only cost a row
            first = np.flatnonzero(new)
            total = np.diff(np.append(first, m))
            words, lang = words[:, first], lang[first]
            parts = [block.vocabulary.take(pa.array(w, mask=w < 0)) for w in words]
            phrase = pc.binary_join_element_wise(*parts, "", " ", null_handling="skip")
            yield pa.record_batch([block.langs.take(pa.array(lang)), phrase, pa.array(total)], ["lang", "phrase", "n"])

    return docs.mapInArrow(run, RUN)


def run_of(part: pa.RecordBatch, size: int) -> Iterator[pa.RecordBatch]:
    """The rows as lists of about `size`, a row each; a batch for each stretch of ROUTED."""
    most = max(size, ROUTED)
    for lo in range(0, part.num_rows, most):
        own = part.slice(lo, most)
        offsets = pa.array([*range(0, own.num_rows, size), own.num_rows], pa.int32())
        yield pa.record_batch([pa.ListArray.from_arrays(offsets, c) for c in own.columns], part.schema.names)


def borders(runs: DataFrame, parts: int, total: int) -> list[tuple[str, str]]:
    """(lang, phrase) where each range but the first begins."""
    places = F.sequence(F.lit(0), F.size("n") - 1, F.lit(SPACING))
    shown = runs.select(F.explode(F.transform(places, lambda i: F.struct(F.get("lang", i).alias("lang"), F.get("phrase", i).alias("phrase"), i.alias("i"), F.size("n").alias("n")))).alias("s")).select("s.*")
    share = max(1, total // SPACING // SAMPLES)  # one in so many, told by hash, so that a rerun shows the same
    found = shown.filter(F.pmod(F.xxhash64("lang", "phrase", "i", "n"), F.lit(share)) == 0).select("lang", "phrase").toArrow()
    keys = sorted(zip(found.column(0).to_pylist(), found.column(1).to_pylist(), strict=True))
    return sorted({keys[len(keys) * k // parts] for k in range(1, parts)}) if keys else []


def routed(runs: DataFrame, cuts: list[tuple[str, str]]) -> DataFrame:
    """The runs cut at the borders, each piece in the task of its range."""
    rows = max(1, ROUTED // RUN_ROWS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(lo, rows) for whole in batches for lo in range(0, whole.num_rows, rows)):
            flat = pa.record_batch([c.flatten() for c in batch.columns], batch.schema.names)
            keys = list(zip(flat.column(0).to_pylist(), flat.column(1).to_pylist(), strict=True))
            order = sorted(range(len(keys)), key=keys.__getitem__)  # rows that follow each other are in order but where a run begins
            flat, keys = flat.take(pa.array(order, pa.int64())), [keys[k] for k in order]
            at = bisect_left(cuts, keys[0]) if keys else 0
            at += at < len(cuts) and bool(keys) and cuts[at] == keys[0]
            lo = 0
            while lo < len(keys):
                hi = bisect_left(keys, cuts[at], lo) if at < len(cuts) else len(keys)
                if hi > lo:
                    lists = next(run_of(flat.slice(lo, hi - lo), hi - lo))
                    yield pa.record_batch([pa.array([at], pa.int32()), *lists.columns], ["part", "lang", "phrase", "n"])
                lo, at = hi, at + 1

    return runs.mapInArrow(run, f"part int, {RUN}").repartitionById(len(cuts) + 1, "part").select("lang", "phrase", "n")


def multikey_counts(rows: np.ndarray, weights: np.ndarray, least: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(pointers, depths, counts) of all prefixes of the rows that weigh `least` or more: multikey three-way quicksort.

    rows: (n, depth) numbers, 0 behind a row's end. A prefix is told by a pointer to one row that begins with it.
    """
    out = []
    ptr, seg, depth = np.arange(len(rows)), np.zeros(len(rows), np.int64), np.zeros(1, np.int64)
    while len(ptr):
        starts = np.flatnonzero(np.append(True, seg[1:] != seg[:-1]))
        ends = np.append(starts[1:], len(ptr))
        pivot = rows[ptr[(starts + ends) // 2], depth]
        seg = np.repeat(np.arange(len(starts)), ends - starts)
        keys = rows[ptr, depth[seg]]
        side = 1 + (keys > pivot[seg]).astype(np.int64) - (keys < pivot[seg])
        part = seg * 3 + side
        order = np.argsort(part, kind="stable")
        ptr, part = ptr[order], part[order]
        starts = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
        sizes = np.diff(np.append(starts, len(ptr)))
        total = np.add.reduceat(weights[ptr], starts)
        own, side = np.divmod(part[starts], 3)
        equal = side == 1
        counted = equal & (total >= least) & (pivot[own] != 0)
        out.append((ptr[starts[counted]], depth[own[counted]] + 1, total[counted]))
        depth = depth[own] + equal
        going = (total >= least) & (~equal | (pivot[own] != 0)) & (depth < rows.shape[1])
        keep = np.repeat(going, sizes)
        ptr, depth = ptr[keep], depth[going]
        seg = np.repeat(np.arange(len(depth)), sizes[going])
    return out


def range_counts(rows: DataFrame, min_count: int, longest: int) -> DataFrame:
    """(lang, phrase, n): the phrases of each range with min_count suffixes or more, and those at its two ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flat = [pa.record_batch([c.flatten() for c in b.columns], ["lang", "phrase", "n"]) for b in batches]
        held = pa.Table.from_batches(flat, pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("n", pa.int64())])).combine_chunks()
        if not held.num_rows:
            return
        lang = held.column("lang").combine_chunks().dictionary_encode()
        lists = pc.split_pattern(held.column("phrase"), " ").combine_chunks()
        coded = pc.dictionary_encode(lists.flatten())
        sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False) - 1  # the last is the empty one behind the last space
        n = len(sizes)
        flat, at = coded.indices.to_numpy(zero_copy_only=False), np.cumsum(sizes + 1) - sizes - 1
        words = np.zeros((n, longest + 1), np.int32)
        words[:, 0] = lang.indices.to_numpy(zero_copy_only=False) + 1
        for j in range(longest):
            has = sizes > j
            words[has, j + 1] = flat[at[has] + j] + 1
        weights = held.column("n").to_numpy()
        # the rows that come first and last in the order by which they were dealt out
        ends = []
        for pick in (min, max):
            langs = lang.dictionary.to_pylist()
            code = langs.index(pick(langs))
            own = np.flatnonzero(words[:, 0] == code + 1)
            phrases = held.column("phrase").take(pa.array(own))
            ends.append(int(own[pc.index(phrases, pc.min_max(phrases)[pick.__name__]).as_py()]))
        edge, counts = {}, []
        for e in ends:
            same = np.cumprod(words == words[e], axis=1) * (words[e] != 0)
            for d in range(3, 2 + int(sizes[e])):
                edge[tuple(words[e, :d].tolist())] = (e, d, int(weights[same[:, d - 1] > 0].sum()))
        for ptr, depth, total in multikey_counts(words, weights, min_count):
            counts += [(p, d, t) for p, d, t in zip(ptr.tolist(), depth.tolist(), total.tolist(), strict=True) if d > 2 and tuple(words[p, :d].tolist()) not in edge]
        counts += edge.values()
        langs, vocabulary = lang.dictionary.to_pylist(), coded.dictionary.to_pylist()
        told = [(langs[words[p, 0] - 1], " ".join(vocabulary[w - 1] for w in words[p, 1:d]), t) for p, d, t in counts]
        yield pa.record_batch([pa.array([r[i] for r in told], t) for i, t in enumerate((pa.string(), pa.string(), pa.int64()))], ["lang", "phrase", "n"])

    total = rows.agg(F.sum(F.size("n"))).first()[0] or 0
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), total // RANGE_ROWS + 1)
    return routed(rows, borders(rows, parts, total)).mapInArrow(run, "lang string, phrase string, n long")


def phrase_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", min_count: int = MIN_COUNT, longest: int = LONGEST) -> tuple[DataFrame, DataFrame]:
    """(lang, word, n) of all words, and (lang, phrase, n) of the phrases of 2 to `longest` words found min_count times."""
    docs = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    told = saved(first_pass(docs), "leading")
    words = saved(told.filter("word IS NOT NULL").groupBy("lang", "word").agg(F.sum("n").alias("n")), "words")
    bits = frequent_buckets(told.filter("word IS NULL").select("chunk", "counts"), min_count)
    rows = saved(suffixes(docs, bits, longest), "suffixes")
    counted = range_counts(rows, min_count, longest).groupBy("lang", "phrase").agg(F.sum("n").alias("n"))
    return words, saved(counted.filter(F.col("n") >= min_count), "phrases")


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", min_count: int = MIN_COUNT, longest: int = LONGEST, cover_pct: int = COVER_PCT, top: int = TOP) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's `top` phrases.

    A-Z are lower-cased; texts are cut at `[.,;:!?\\x0A-\\x0D]` into pieces and these into words `[^\\x20\\x09]+`. Null texts
    have no words, a null language is `und`. Candidates are the phrases of 2 to `longest` words with a = f(phrase) >=
    min_count, overlaps counted. Cut after k words, l and r are the counts of both parts, n those of all words of the
    language; the score is floor(1000 * a * n / (l * r)) in 38-digit decimals. The lowest score of all cuts counts, of
    equal ones that of the smallest k. A candidate goes if a longer one that holds its words side by side has cover_pct
    per cent of its count or more. Phrases rank by score and a, falling, then by their bytes. Repeated rows count as
    often as they come; other columns of docs are not returned.
    """
    words, phrases = phrase_counts(docs, text_col, lang_col, min_count, longest)
    totals = words.groupBy("lang").agg(F.sum("n").alias("n"))
    counts = words.filter(F.col("n") >= min_count).select("lang", F.col("word").alias("phrase"), "n").unionByName(phrases)
    parts = phrases.select("lang", "phrase", F.col("n").alias("a"), F.split("phrase", " ").alias("w"))
    size = F.size("w")
    side = lambda start, length: F.array_join(F.slice("w", start, length), " ")
    cuts = parts.select("lang", "phrase", "a", "w", F.explode(F.sequence(F.lit(1), size - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", side(F.lit(1), F.col("k")).alias("left"), side(F.col("k") + 1, size - F.col("k")).alias("right"))
    cuts = cuts.join(counts.select("lang", F.col("phrase").alias("left"), F.col("n").alias("l")), ["lang", "left"])
    cuts = cuts.join(counts.select("lang", F.col("phrase").alias("right"), F.col("n").alias("r")), ["lang", "right"])
    exact = lambda c: f"cast({c} as decimal(16, 0))"
    cuts = cuts.join(F.broadcast(totals), "lang") if totals.count() <= 10_000 else cuts.join(totals, "lang")
    score = F.expr(f"(1000BD * {exact('a')} * {exact('n')}) div ({exact('l')} * {exact('r')})")
    best = cuts.withColumn("score", score).groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    spans = F.flatten(F.transform(F.sequence(F.lit(2), size - 1), lambda k: F.transform(F.sequence(F.lit(1), size - k + 1), lambda i: F.array_join(F.slice("w", i, k), " "))))
    inside = parts.filter(size > 2).select("lang", F.col("a").alias("longer"), F.explode(spans).alias("phrase"))
    inside = inside.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    left = best.join(inside, ["lang", "phrase"], "left").filter(F.col("longer").isNull() | (100 * F.col("longer") < cover_pct * F.col("a")))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    left = left.select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score", F.pmod(F.xxhash64("phrase"), F.lit(SHARES)).alias("share"))
    shares = left.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "share").orderBy(*order))).filter(F.col("rank") <= top)
    ranked = shares.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op12_collocations(spark, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


ORACLE = rf"""
WITH t AS (SELECT coalesce(lang, 'und') AS lang, row_number() OVER () AS d, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
p AS (SELECT lang, regexp_extract_all(unnest(regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') AS w FROM t),
g AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase, count(*) AS f
      FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM p, (SELECT unnest(range(1, {LONGEST} + 1)) AS k)) GROUP BY ALL HAVING count(*) >= {MIN_COUNT}),
n AS (SELECT lang, sum(len(w))::HUGEINT AS n FROM p GROUP BY lang),
c AS (SELECT lang, k AS size, phrase, f AS a, string_split(phrase, ' ') AS w FROM g WHERE k > 1),
cut AS (SELECT c.lang, c.phrase, c.a, k, array_to_string(w[1:k], ' ') AS left_, array_to_string(w[k + 1:], ' ') AS right_ FROM (SELECT *, unnest(range(1, size)) AS k FROM c) c),
s AS (SELECT cut.lang, cut.phrase, cut.a, n.n, cut.k, x.f AS l, y.f AS r, (1000::HUGEINT * cut.a * n.n) // (x.f::HUGEINT * y.f) AS score
      FROM cut JOIN n USING (lang) JOIN g x ON x.lang = cut.lang AND x.phrase = left_ AND x.k = cut.k JOIN g y ON y.lang = cut.lang AND y.phrase = right_),
best AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
sub AS (SELECT lang, a, array_to_string(w[i:i + k - 1], ' ') AS phrase
        FROM (SELECT lang, a, w, size, k, unnest(range(1, size - k + 2)) AS i FROM c, (SELECT unnest(range(2, {LONGEST})) AS k) WHERE k < size)),
longer AS (SELECT lang, phrase, max(a) AS longer FROM sub GROUP BY ALL),
kept AS (SELECT best.* FROM best LEFT JOIN longer USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < {COVER_PCT} * a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r,
       n::BIGINT AS n, score::BIGINT AS score
FROM kept QUALIFY rank <= {TOP}
"""
