"""Arrow batches of thousands of rows are worked on a few rows or bytes at a time."""

import random

import numpy as np
import pyarrow as pa

from lineweave.functions import udfs as U
from lineweave.operators import mtmetrics as MT


def test_matches_are_counted_by_pieces_of_bounded_size():
    draw = random.Random(5)
    word = lambda: draw.choice(["a", "b", "cé", "dd"])
    lists = lambda n: [None if draw.random() < 0.05 else [word() for _ in range(draw.randrange(9))] for _ in range(n)]
    words = [pa.array(lists(200), pa.list_(pa.string())) for _ in range(2)]
    texts = [pa.array([None if x is None else "".join(x) for x in c.to_pylist()]) for c in words]
    many = pa.array([[x for x in lists(draw.randrange(3)) if x is not None] for _ in range(200)], pa.list_(pa.list_(pa.string())))
    for columns, chars in ((words, False), (texts, True)):
        whole = pa.record_batch(columns, ["h", "r"])
        parts = list(MT.pieces(whole, [0, 1], 64))
        assert len(parts) > 20 and pa.Table.from_batches(parts).combine_chunks().equals(pa.Table.from_batches([whole]))
        assert max(sum(len("".join(x or "").encode()) for c in p.columns for x in c.to_pylist()) for p in parts if p.num_rows > 1) < 128
        found = np.concatenate([MT.row_matches(*p.columns, 3, chars) for p in parts], axis=1)
        assert (found == MT.row_matches(*columns, 3, chars)).all()
    parts = list(MT.pieces(pa.record_batch([words[0], many], ["h", "r"]), [0, 1], 64))
    assert len(parts) > 20 and sum(p.num_rows for p in parts) == 200
    assert [p.num_rows for p in MT.pieces(pa.record_batch([words[0][:0], many[:0]], ["h", "r"]), [0, 1], 64)] == [0]


def test_sizes_of_rows_are_read_from_offsets():
    """A batch of 10,000 rows has millions of words: nothing that has an item for each of them is made before rows are parted."""
    import tracemalloc

    words = pa.array([["word"] * 300 for _ in range(2000)], pa.list_(pa.string()))
    many = pa.ListArray.from_arrays(pa.array(range(0, 2001, 2), pa.int32()), words)
    batch = pa.record_batch([words[:1000], many], ["h", "r"])
    held = pa.total_allocated_bytes()
    tracemalloc.start()
    first = next(MT.pieces(batch, [0, 1], 1 << 16))
    assert tracemalloc.get_traced_memory()[1] < 1 << 20 and pa.total_allocated_bytes() - held < 1 << 20  # 900,000 words
    tracemalloc.stop()
    assert 10 < first.num_rows < 20
    sliced = batch.slice(500, 100)
    assert MT.bounds(sliced.column(1))[[0, 1]].tolist() == [1000 * 300 * 5, 1002 * 300 * 5]


def test_texts_do_not_come_back_from_python(spark):
    rows = spark.createDataFrame([(1, "a b".split(), ["a"]), (2, None, ["b"])], "k int, h array<string>, r array<string>")
    found = MT.matches(rows, ("h", "r", 2, False))
    assert found.columns == ["k", "hit", "hyp_n", "ref_n"] and sorted(found.collect())[0] == (1, [1, 0], [2, 1], [1, 0])


def test_few_rows_are_python_objects_at_a_time(spark):
    class Column:
        """Tells how many rows are asked for at once."""

        asked: list[int] = []

        def __init__(self, values):
            self.values = values

        def __len__(self):
            return len(self.values)

        def slice(self, at, n):
            return Column(self.values[at : at + n])

        def to_pylist(self):
            Column.asked.append(len(self.values))
            return self.values

    assert list(U.rows_of((Column(list(range(1000))),))) == [(i,) for i in range(1000)] and max(Column.asked) <= 64
    df = spark.range(300).selectExpr("id", "transform(sequence(0, id), x -> cast(x as string)) AS a", "if(id % 7 = 0, null, array('1')) AS b").repartition(1)
    got = {r[0]: r[1] for r in df.select("id", U.common_subsequence("a", "b")).collect()}
    assert got == {i: None if i % 7 == 0 else int(i > 0) for i in range(300)}
