"""Document fingerprints by consistent weighted sampling (Ioffe, 2010).

A text's terms are its words, A-Z lower-cased, weighted by their counts. For each of SAMPLES positions every
term draws r and c from Gamma(2, 1) and b from the uniform distribution, all from a hash of term and position. With
t = floor(ln(weight) / r + b) the term's key is ln(c) - r * (t - b) - r; the least key wins, and the sample is the
pair (term, t). Two texts draw the same sample with a probability that is their generalised Jaccard
similarity: the sum of the smaller over the sum of the larger weights.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lineweave.llm.common import table
from lineweave.llm.line_dedup import NO_ID
from lineweave.llm.tokens import cut, hashed, mixed

SAMPLES = 128
#: Code points of text and documents handled together; draws kept at a time; terms drawn and (document, term) pairs compared
#: at a time, few enough to stay in a processor's cache.
BATCH, ROWS, DRAWS, CHUNK, GROUP = 4 << 20, 1 << 15, 1 << 23, 512, 4096


def draws(terms: np.ndarray, first: int, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(r, c, b) of each term for the positions first .. first + width - 1; c is the logarithm."""
    position = np.arange(first + 1, first + width + 1).astype(np.uint64) * np.uint64(0xD1B54A32D192ED03)
    out = tuple(np.empty((len(terms), width), np.float32) for _ in range(3))
    low, scale = np.uint64(0xFFFFFF), np.float32(2**-24)

    def uniform(z: np.ndarray, shift: int) -> np.ndarray:
        return ((z >> np.uint64(shift) & low).astype(np.float32) + np.float32(0.5)) * scale

    for at in range(0, len(terms), CHUNK):
        r, c, b = (x[at : at + CHUNK] for x in out)
        x = mixed(terms[at : at + CHUNK, None] ^ position)
        y = mixed(x + np.uint64(0x9E3779B97F4A7C15))
        np.negative(np.log(uniform(x, 0) * uniform(x, 24), out=r), out=r)
        np.negative(np.log(uniform(y, 0) * uniform(y, 24), out=c), out=c)
        np.log(c, out=c)
        np.multiply((x >> np.uint64(48)).astype(np.float32), np.float32(2**-16), out=b)
    return out


def signatures(texts: list[bytes]) -> np.ndarray:
    """(texts, SAMPLES) of 16-bit samples; all 0 for a text without a word."""
    tokens, at = hashed([t.lower() for t in texts], by_kind=False)
    terms, term = np.unique(tokens, return_inverse=True)
    doc = np.repeat(np.arange(len(texts)), np.diff(at))
    pairs, weight = np.unique(doc * max(len(terms), 1) + term, return_counts=True)
    doc, term = np.divmod(pairs, max(len(terms), 1))
    out = np.zeros((len(texts), SAMPLES), np.uint16)
    first = np.flatnonzero(np.diff(doc, prepend=-1))
    count = np.diff(np.append(first, len(pairs)))
    groups = list(cut(count.tolist(), GROUP))
    heavy, logs = weight > 1, np.log(weight.astype(np.float32))
    width = max(8, min(SAMPLES, DRAWS // max(len(terms), 1)))
    for k in range(0, SAMPLES if len(pairs) else 0, width):
        r, c, b = draws(terms, k, min(width, SAMPLES - k))
        c += r * b - r  # the key where t is 0, as it is at weight 1
        for lo, hi in groups:
            start, end = first[lo], first[hi - 1] + count[hi - 1]
            own = term[start:end]
            keys, more = c[own], np.flatnonzero(heavy[start:end])
            steps = np.floor(logs[start:end][more, None] / r[own[more]] + b[own[more]])
            keys[more] -= r[own[more]] * steps
            least = np.minimum.reduceat(keys, first[lo:hi] - start, axis=0)
            row, column = np.divmod(np.flatnonzero(keys == np.repeat(least, count[lo:hi], axis=0)), keys.shape[1])
            won = own[row]
            t = np.floor(logs[start + row] / r[won, column] + b[won, column]).astype(np.int64)
            sample = mixed(terms[won] + t.astype(np.uint64) * np.uint64(0xA0761D6478BD642F)) >> np.uint64(48)
            out[doc[start + row], k + column] = np.maximum(sample, 1)
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a == b).mean(axis=-1)


def printed(signature: np.ndarray) -> str:
    return signature.astype(">u2").tobytes().hex()


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint) of each whole text; null and empty texts share the fingerprint of zeros."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from lineweave.llm.tokens import pieces

        for batch in batches:
            raw = [t or b"" for t in batch.column(1).cast(pa.binary()).to_pylist()]
            for lo, hi in pieces(raw, BATCH):
                prints = [printed(s) for s in signatures(raw[lo:hi])]
                yield pa.record_batch([batch.column(0).slice(lo, hi - lo), pa.array(prints, pa.string())], ["doc_id", "fingerprint"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, fingerprint string")


def beside_next(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(part, lead, doc_id, text), dealt out by ranges of doc_id and sorted within each part by falling doc_id.

    Rows with lead 1 are the documents. So that each comes right behind its successor, the heads of some ids (of an id's
    rows the text of the smallest hash) are sent along with lead 0: to each part the first id of the next (to the last
    part the least of all), and around ids that repeat so often that they span several ranges: their rows are dealt
    to parts of their own by hash, each of which gets the successor's head, and their own head stays in its range.
    Texts are shuffled once.
    """
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    found = [int(c) for c in rows.stat.approxQuantile("doc_id", [i / n for i in range(1, n)], 1 / (8 * n))] if n > 1 else []
    cuts = sorted(set(found))
    width = {c: k + 1 for c, k in Counter(found).items() if k > 1}  # ids that hold a whole range: in so many parts
    hot, base = {}, len(cuts) + 1
    for c in sorted(width):
        hot[c] = base
        base += width[c]

    @F.arrow_udf("int")
    def range_of(ids: pa.Array) -> pa.Array:
        return pa.array(np.searchsorted(np.array(cuts, np.int64), ids.to_numpy(), "right").astype(np.int32))

    placed = rows.withColumn("part", range_of("doc_id"))
    told = placed.groupBy("part").agg(F.min("doc_id").alias("low"), *(F.min(F.when(F.col("doc_id") > c, F.col("doc_id"))).alias(f"after{k}") for k, c in enumerate(hot))).collect()  # a row a part
    lows = sorted((r.part, r.low) for r in told)
    if not lows:
        return placed.select("part", F.lit(1).alias("lead"), "doc_id", "text")
    sent = [(lows[i - 1][0], low) for i, (_, low) in enumerate(lows)]
    for k, c in enumerate(hot):
        after = min((r[f"after{k}"] for r in told if r[f"after{k}"] is not None), default=lows[0][1])
        sent += [(bisect_right(cuts, c), c), *((hot[c] + i, after) for i in range(width[c]))]
    wanted = sorted({i for _, i in sent})
    heads = rows.filter(F.col("doc_id").isin(wanted)).groupBy("doc_id").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))
    to = spark.createDataFrame(sorted(set(sent)), "part int, doc_id long")
    heads = heads.join(F.broadcast(to), "doc_id").select("part", F.lit(0).alias("lead"), "doc_id", "text")  # two rows a part at most
    part = F.col("part")
    for c, at in hot.items():
        part = F.when(F.col("doc_id") == c, at + F.pmod(F.xxhash64("text"), F.lit(width[c])).cast("int")).otherwise(part)
    dealt = placed.select(part.cast("int").alias("part"), F.lit(1).alias("lead"), "doc_id", "text").unionByName(heads)
    # the head that wraps around or leads a part has the largest id or, after the last id, comes first
    first = (F.col("lead") == 0) & (F.col("doc_id") == lows[0][1])
    dealt = dealt.repartitionById(base, "part")
    return dealt.sortWithinPartitions("part", F.desc(first), F.desc("doc_id"), "lead", F.xxhash64("text"))


def edited(text: str, following: str) -> str:
    """text with its last floor(n / 2) code points replaced by the first as many of following."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def compare_with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of each document.

    The next document is that of the next larger id (after the largest: the smallest), of repeated ids the one
    whose text has the smallest hash. Null ids count as the smallest id; null texts are empty. Repeated rows
    of an id each get a row and share their successor. A lone document follows itself. Other columns of docs are not
    returned.
    """

    def told(rows: list[tuple[int, str, str]]) -> pa.RecordBatch:
        changed = [edited(t, f) for _, t, f in rows]
        texts = list(dict.fromkeys(t for _, *two in rows for t in two))
        place = {t: i for i, t in enumerate(texts)}
        made = signatures([t.encode() for t in texts + changed])
        own, next_ = made[[place[t] for _, t, _ in rows]], made[[place[f] for *_, f in rows]]
        new = made[len(texts) :]
        cols = [
            pa.array([None if i == NO_ID else i for i, *_ in rows], pa.int64()),
            pa.array([len(t) for _, t, _ in rows], pa.int64()),
            pa.array([hashlib.sha256(t.encode()).hexdigest() for t in changed], pa.string()),
            pa.array([printed(s) for s in own], pa.string()),
            pa.array([printed(s) for s in new], pa.string()),
            pa.array(likeness(own, new)),
            pa.array(likeness(own, next_)),
        ]
        return pa.record_batch(cols, ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come by falling id, so of all that was before only one text is kept: the head of the id above."""
        rows, size, now, head, above = [], 0, None, None, None
        for batch in batches:
            for part, lead, i, text in zip(*(batch.column(c).to_pylist() for c in ("part", "lead", "doc_id", "text")), strict=True):
                if now is None or now[0] != part:
                    now, head, above = (part, i), text, None
                elif now[1] != i:
                    now, head, above = (part, i), text, head
                if lead:
                    rows.append((i, text, head if above is None else above))
                    size += len(text)
                if size > BATCH or len(rows) >= ROWS:
                    yield told(rows)
                    rows, size = [], 0
        if rows:
            yield told(rows)

    return beside_next(docs, id_col, text_col).mapInArrow(
        run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    )


def op10_fingerprint(spark, sf_dir: str) -> DataFrame:
    return compare_with_next(table(spark, sf_dir, "documents"))
