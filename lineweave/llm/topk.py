"""Exact top-k inner products on a bit-sliced index.

Components are quantised to integers. A block of vectors keeps, for each component and bit, one bitmap over
its rows. A query adds the slices of all components, weighted by its own integers, with carry-save adders on
whole bitmaps: the sums come out as slices again. The top rows are then selected from the most significant
slice downward, and the rows level at the boundary are resolved exactly, the smaller id first.

Every query meets every vector, so the work is cut like a matrix: a task takes one group of queries and streams a share
of the blocks past it, one at a time, with the best rows so far of each query. A block whose bound (from the least
and largest value of each component) lies below a query's k-th score is passed over.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lineweave.llm.common import saved, table

#: Vectors in a block; least and most queries in a group. Large inputs get large groups, so that a block is sent to few.
BLOCK, QUERIES, MOST_QUERIES = 1 << 15, 128, 4096
#: Tasks that few groups of queries are cut into, by shares of the blocks: as many for each core.
TASKS_A_CORE = 4
ONES = np.uint64(2**64 - 1)
LEAST, MOST = -(2**63), 2**63 - 1


def slices(values: np.ndarray, low: int, bits: int) -> np.ndarray:
    """values (rows, dims) to bitmaps (dims, bits, words) of values - low, which may take all 64 bits."""
    rows = -(-len(values) // 64) * 64
    shifted = np.zeros((rows, values.shape[1]), np.uint64)
    shifted[: len(values)] = values.view(np.uint64) - np.array([low], np.int64).view(np.uint64)
    out = np.empty((values.shape[1], bits, rows // 64), np.uint64)
    for b in range(bits):
        plane = (shifted >> np.uint64(b) & np.uint64(1)).astype(np.uint8)
        out[:, b] = np.packbits(np.ascontiguousarray(plane.T), axis=1, bitorder="little").view(np.uint64)
    return out


def weighted_sum(index: np.ndarray, query: np.ndarray) -> list[np.ndarray]:
    """Slices, least significant first, of the sum of |query| times the components, those of negative weight complemented."""
    index = np.where((query < 0)[:, None, None], index ^ ONES, index)
    weight, bits = np.where(query < 0, 0 - query.view(np.uint64), query.view(np.uint64)), index.shape[1]
    levels: list[list[np.ndarray]] = [[] for _ in range(bits + max(int(weight.max(initial=0)).bit_length(), 1))]
    for c in range(int(weight.max(initial=0)).bit_length()):
        part = index[(weight >> np.uint64(c) & np.uint64(1)) > 0]
        for b in range(bits):
            levels[b + c].append(part[:, b])
    out, level = [], 0
    while level < len(levels):
        maps = np.concatenate(levels[level]) if levels[level] else np.zeros((0, index.shape[2]), np.uint64)
        carries = []
        while len(maps) > 1:
            k = len(maps) // 3
            if k:
                a, b, c = maps[:k], maps[k : 2 * k], maps[2 * k : 3 * k]
                half = a ^ b
                carries.append(a & b | c & half)
                maps = np.concatenate([half ^ c, maps[3 * k :]])
            else:
                carries.append(maps[:1] & maps[1:])
                maps = maps[:1] ^ maps[1:]
        out.append(maps[0] if len(maps) else np.zeros(index.shape[2], np.uint64))
        if carries:
            if level + 1 == len(levels):
                levels.append([])
            levels[level + 1] += carries
        level += 1
    return out


def rows_of(bitmap: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(bitmap.view(np.uint8), bitorder="little"))


def select_top(sums: list[np.ndarray], valid: np.ndarray, k: int) -> np.ndarray:
    """Rows of the k largest sums among valid ones, ties to the smaller row."""
    sure, level = np.zeros_like(valid), valid.copy()
    k = min(k, int(np.bitwise_count(valid).sum()))
    for s in reversed(sums):
        more = sure | level & s
        n = int(np.bitwise_count(more).sum())
        if n > k:
            level = level & s
        else:
            sure, level = more, level & ~s
            if n == k:
                return rows_of(sure)
    got = rows_of(sure)
    return np.concatenate([got, rows_of(level)[: k - len(got)]])


def read(sums: list[np.ndarray], rows: np.ndarray) -> list[int]:
    """The sums of some rows, from their bits. They may have more than 64."""
    out = [0] * len(rows)
    for at in range(0, len(sums), 32):
        part = np.zeros(len(rows), np.int64)
        for j, s in enumerate(sums[at : at + 32]):
            part += (s[rows // 64] >> (rows % 64).astype(np.uint64) & np.uint64(1)).astype(np.int64) << j
        out = [x + (y << at) for x, y in zip(out, part.tolist(), strict=True)]
    return out


def shift_of(query: list[int], low: int, bits: int) -> int:
    """What a weighted sum has beyond the inner product: slices hold value - low, complements 2**bits - 1 - that."""
    return -sum(x for x in query if x < 0) * (2**bits - 1) - low * sum(query)


def quantised(vectors: DataFrame, id_col: str, vector_col: str, scale: float) -> DataFrame:
    """(id, v, row): floor(scale * x) of each usable vector. row tells rows of an id apart: a hash of the vector and, of
    equal rows, their number."""
    x = F.col(vector_col)
    usable = F.col(id_col).isNotNull() & x.isNotNull() & F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    rows = vectors.filter(F.coalesce(usable, F.lit(False)))
    ints = F.transform(x, lambda e: F.floor(e.cast("double") * scale).cast("long"))
    return rows.select(F.col(id_col).cast("long").alias("id"), ints.alias("v")).groupBy("id", "v").agg(F.count("*").alias("n")).select("id", "v", F.explode(F.sequence(F.lit(1).cast("long"), "n")).alias("nth")).select("id", "v", F.xxhash64("v", "nth").alias("row"))


def matrix(lists: pd.Series, dims: int) -> np.ndarray:
    out = np.zeros((len(lists), dims), np.int64)
    for i, v in enumerate(lists):
        out[i, : len(v)] = v
    return out


def blocks_of(rows: DataFrame, n: int, dims: int, sliced: bool) -> DataFrame:
    """(block, ids, keys, low, bits, least, most, data): rows dealt to n blocks by hash, ids ascending. data: the bit
    slices of value - low, or the integers themselves; least and most of each component."""

    def pack(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["id", "row"])
        v = matrix(part["v"], dims)
        low, high = int(v.min()), int(v.max())
        bits = max((high - low).bit_length(), 1)
        data = slices(v, low, bits) if sliced else v
        told = [part["id"].to_numpy(np.int64), part["row"].to_numpy(np.int64), v.min(0), v.max(0), data]
        ids, keys, least, most, data = (np.ascontiguousarray(x).tobytes() for x in told)
        return pd.DataFrame({"block": [int(part["b"].iat[0])], "ids": [ids], "keys": [keys], "low": [low], "bits": [bits], "least": [least], "most": [most], "data": [data]})

    dealt = rows.withColumn("b", F.pmod(F.xxhash64("id", "row"), F.lit(n)))
    return dealt.groupBy("b").applyInPandas(pack, "block long, ids binary, keys binary, low long, bits int, least binary, most binary, data binary")


class Search:
    """The best k rows so far of some queries, over the blocks that pass."""

    def __init__(self, ids: np.ndarray, keys: np.ndarray, values: np.ndarray, k: int):
        self.ids, self.keys, self.values, self.k = ids.tolist(), keys.tolist(), values, k
        self.exact = values.tolist()
        self.best: list[list[tuple[int, int]]] = [[] for _ in self.ids]  # (-score, id), ascending

    def meet(self, ids: np.ndarray, keys: np.ndarray, low: int, bits: int, least: np.ndarray, most: np.ndarray, maps: np.ndarray) -> None:
        valid = np.packbits(np.arange(maps.shape[2] * 64) < len(ids), bitorder="little").view(np.uint64)
        bounds = (least.tolist(), most.tolist())
        for i, (q, x) in enumerate(zip(self.ids, self.values, strict=True)):
            best = self.best[i]
            if len(best) == self.k and sum(w * bounds[w > 0][d] for d, w in enumerate(self.exact[i])) < -best[-1][0]:
                continue
            others, lo, hi = valid.copy(), *np.searchsorted(ids, [q, q + 1]).tolist()
            own = lo + int(np.searchsorted(keys[lo:hi], self.keys[i]))
            if own < hi and keys[own] == self.keys[i]:  # the query's own row; others of its id are candidates
                others[own // 64] &= ~(np.uint64(1) << np.uint64(own % 64))
            sums = weighted_sum(maps, x)
            at = select_top(sums, others, self.k)
            shift = shift_of(self.exact[i], low, bits)
            best += [(shift - s, v) for s, v in zip(read(sums, at), ids[at].tolist(), strict=True)]
            best.sort()
            del best[self.k :]

    def told(self) -> pa.RecordBatch:
        """query_id, key, vec_id, score, beyond: scores that a long does not hold are its least or largest, and their order is
        that of beyond."""
        rows = [(q, key, v, -s) for q, key, best in zip(self.ids, self.keys, self.best, strict=True) for s, v in best]
        beyond = [None if LEAST < s < MOST else (s + (1 << 300)).to_bytes(40, "big") for *_, s in rows]
        columns = [pa.array(c, pa.int64()) for c in ([q for q, *_ in rows], [key for _, key, *_ in rows], [v for *_, v, _ in rows], [min(max(s, LEAST), MOST) for *_, s in rows])]
        return pa.record_batch([*columns, pa.array(beyond, pa.binary())], ["query_id", "key", "vec_id", "score", "beyond"])


def top_k(vectors: DataFrame, k: int = 20, query_every: int = 20, scale: float = 64.0, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest inner products of each query with all other vectors.

    Queries are the ids divisible by query_every. Vectors that are null, or hold null or non-finite components,
    and rows without an id take no part; a shorter vector counts as ending in zeros. Scores are those of the
    integers floor(scale * x), ties go to the smaller id. Fewer than k other vectors: all of them. Rows that share an id
    are each a query and a candidate of their own, for each other too. Other columns are not returned.

    Integers beyond a long become the nearest long. Ranks go by the exact inner products of these integers
    whatever their size; a score that a long does not hold is reported as the nearest long.
    """
    rows = saved(quantised(vectors, id_col, vector_col, scale), "quantised")
    is_query = F.col("id") % query_every == 0
    n, n_queries, dims = rows.agg(F.count("*"), F.count_if(is_query), F.max(F.size("v"))).first()
    dims = max(dims or 0, 1)
    n_blocks, n_groups = max(1, -(-n // BLOCK)), max(1, -(-n_queries // min(max(QUERIES, n_queries // 64), MOST_QUERIES)))
    cores = vectors.sparkSession.sparkContext.defaultParallelism
    shares = max(1, min(n_blocks, TASKS_A_CORE * cores // n_groups))  # of the blocks; the queries are sent to each
    index = saved(blocks_of(rows, n_blocks, dims, True), "bit-slices")
    asked = saved(blocks_of(rows.filter(is_query), n_groups, dims, False), "queries")
    to = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    streams = index.withColumn("own", F.pmod("block", F.lit(shares))).select(to(n_groups).alias("group"), F.col("own").alias("share"), F.lit(1).alias("kind"), *index.columns)
    heads = asked.withColumn("own", F.col("block")).select(F.col("own").alias("group"), to(shares).alias("share"), F.lit(0).alias("kind"), *asked.columns)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, task = None, None
        for batch in batches:
            for row in range(batch.num_rows):
                own = batch.column("group")[row].as_py(), batch.column("share")[row].as_py()
                if own != task:
                    if now:
                        yield now.told()
                    now, task = None, own
                ids, keys, least, most, data = (np.frombuffer(batch.column(c)[row].as_buffer(), t) for c, t in (("ids", np.int64), ("keys", np.int64), ("least", np.int64), ("most", np.int64), ("data", np.uint64)))
                if batch.column("kind")[row].as_py() == 0:
                    now = Search(ids, keys, data.view(np.int64).reshape(len(ids), dims), k)
                elif now:  # a group without queries has no head
                    bits = batch.column("bits")[row].as_py()
                    now.meet(ids, keys, batch.column("low")[row].as_py(), bits, least, most, data.reshape(dims, bits, -1))
        if now:
            yield now.told()

    # a task holds the queries of one group, and one batch of blocks; hashing may give it several groups, one after another
    tasks = heads.unionByName(streams).repartition(min(n_groups * shares, max(4 * TASKS_A_CORE * cores, n_groups)), "group", "share").sortWithinPartitions("group", "share", "kind", "block")
    found = tasks.mapInArrow(search, "query_id long, key long, vec_id long, score long, beyond binary")
    best = Window.partitionBy("query_id", "key").orderBy(F.desc("score"), F.desc("beyond"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op7_topk(spark, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


ORACLE = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * 64)::BIGINT) AS q FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
e AS (SELECT vec_id, generate_subscripts(q, 1) AS d, unnest(q) AS x FROM v),
s AS (SELECT a.vec_id AS query_id, b.vec_id, sum(a.x * b.x)::BIGINT AS score FROM e a JOIN e b USING (d)
      WHERE a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
