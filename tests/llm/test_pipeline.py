"""The stages of the pipeline on nulls, empty and long texts, ties, repeated rows, shared ids and clashing columns."""

import os
import random
from collections import Counter

import corpus_pipeline as P
import pytest

from lineweave.llm import similar
from lineweave.llm.quality import KEEP_AT

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, node long, part int, runs string"


def rows():
    draw = random.Random(3)
    word = lambda: "".join(draw.choice("abcdefghij") for _ in range(5))
    text = lambda n: " ".join(word() for _ in range(n))
    near, shared = text(60), "a line that many documents share word for word"
    out = [(1, None), (2, ""), (3, " \n\t"), (None, "no id " + text(20)), (None, ""), (9, near), (8, near), (7, near + " more"), (7, near + " more"), (7, text(30)), (None, near)]
    out += [(20 + i, f"{shared}\nown {text(20)}") for i in range(4)]
    out += [(30, f'{text(9)}\npassword: "Zk3VbQ8sTn5XwLr2HdYp"\n{text(5)}'), (31, text(40_000)), (32, "x" * 200_000)]
    return [(i, t, "en", "s", None if t is None else len(t), 1, 2, "r") for i, t in out]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("tables")
    spark.createDataFrame([(9, 1, 0), (20, 1, 0), (21, 0, 0), (None, 1, 0), (31, None, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


def ids(df):
    return Counter(r.doc_id for r in df.select("doc_id").collect())


def test_quality_keeps_what_scores(spark, docs, folder):
    got = P.quality(spark, docs, folder)
    scores = P.score(docs, P.quality_model(docs, P.table(spark, folder, "labels")))
    assert got.columns == docs.columns
    assert ids(got) == Counter(r.doc_id for r in scores.collect() if r["__score"] >= KEEP_AT)


def test_lines_drops_the_shared_line_but_once(spark, docs, folder):
    got = {r.doc_id: r for r in P.lines(spark, docs, folder).collect() if r.doc_id is not None}
    assert [got[i].text.startswith("own ") for i in range(20, 24)] == [True, True, True, False]
    assert all(r.n_chars == len(r.text) for r in got.values()) and got[1].text == ""
    assert ids(P.lines(spark, docs, folder)) == ids(docs)


def test_near_duplicates_leaves_one_row_of_each_group(spark, docs, folder):
    got = P.near_duplicates(spark, docs, folder)
    told = Counter((r.doc_id, (r.text or "").strip()) for r in got.collect())
    assert got.columns == docs.columns and max(told.values()) == 1
    want, groups = {}, {}
    texts = [t for _, t, *_ in rows()]
    own = [similar.sets([(t or "").encode()], 5, *(similar.np.zeros(0, d) for d in ("uint64", "int64")))[1] for t in texts]
    root = list(range(len(texts)))
    for i, a in enumerate(own):
        for j in range(i):
            same = len(similar.np.intersect1d(a, own[j]))
            if 5 * same >= 4 * (len(a) + len(own[j]) - same):
                x, y = sorted((root[i], root[j]))
                root = [x if r == y else r for r in root]
    for r, (i, *_) in zip(root, rows(), strict=True):
        groups.setdefault(r, []).append(i)
    want = Counter(min((i is None, i or 0) for i in g)[1] if any(i is not None for i in g) else None for g in groups.values())
    assert ids(got) == want


def test_secrets_and_packing_keep_every_row(spark, docs, folder):
    got = P.secrets(spark, docs, folder)
    assert got.columns == docs.columns and ids(got) == ids(docs)
    assert "[SECRET]" in got.filter("doc_id = 30").first().text and "Zk3VbQ8sTn5XwLr2HdYp" not in got.filter("doc_id = 30").first().text
    packed = P.packing(spark, docs, folder)
    assert ids(packed) == ids(docs)
    places = [(r.batch_id, r.slot) for r in packed.collect()]
    assert len(set(places)) == len(places)


@pytest.mark.parametrize("name", [n for n, _ in P.STAGES])
def test_stages_on_no_rows(spark, docs, folder, name):
    assert dict(P.STAGES)[name](spark, docs.limit(0), folder).count() == 0


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no tables here")
def test_stages_follow_each_other(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = P.run(spark, sf)
    assert 0 < got.count() < docs.count() and not ids(got) - ids(docs)
