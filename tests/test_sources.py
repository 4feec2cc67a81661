import json

import pytest
from pyspark.sql import functions as F

from lineweave.sources import files as S
from lineweave.sources import sinks as K


def put(folder, name, text, mode="w"):
    path = folder / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_line_scan_numbers_and_strips(spark, tmp_path):
    path = put(tmp_path, "a.txt", "﻿ one \n\n\tthree\t\r\nfour\n")
    got = [(r.line_no, r.text) for r in S.line_scan(spark, path).orderBy("line_no").collect()]
    assert got == [(1, "one"), (2, ""), (3, "three"), (4, "four")]


def test_large_files_get_the_same_numbers(spark, tmp_path):
    for name in ("a.txt", "b.txt"):
        put(tmp_path, f"big/{name}", "".join(f" line {i} of {name}\t\n" if i % 7 else "\n" for i in range(4000)))
    was = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        big = sorted(tuple(r) for r in S.large_line_scan(spark, str(tmp_path / "big")).collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was)
    assert big == sorted(tuple(r) for r in S.line_scan(spark, str(tmp_path / "big")).collect()) and len(big) == 8000


def test_parallel_scan_takes_the_shortest(spark, tmp_path):
    a, b = put(tmp_path, "a.txt", "1\n2\n3\n"), put(tmp_path, "b.txt", "x\ny\n")
    got = S.parallel_scan(spark, {"src": a, "trg": b}).orderBy("line_no").collect()
    assert [tuple(r) for r in got] == [(1, "1", "x"), (2, "2", "y")]


def test_verse_refs(spark, tmp_path):
    lines = S.line_scan(spark, put(tmp_path, "v.txt", "GEN 1:1\nPHM 1:13-14\nbad\n"))
    got = [tuple(r) for r in S.verse_refs(lines).orderBy("line_no").collect()]
    assert got == [(1, "GEN", 1, "1"), (2, "PHM", 1, "13-14"), (3, "", None, "")]
    assert S.book_dimension(spark).count() == 66


def test_terms(spark, tmp_path):
    scan = lambda n, t: S.line_scan(spark, put(tmp_path, n, t))
    got = S.terms(scan("m", "k1\tPN\tplace\n\nk2\tX\td\n"), scan("g", "a\tb\n\nc\n"), scan("r", "q\n"), scan("v", "GEN 1:1\n"), "L").orderBy("id").collect()
    assert [(r.id, r.cat, r.glosses, r.renderings) for r in got] == [("L:k1", "PN", ["a", "b"], ["q"]), ("L:k2", "X", ["c"], None)]


def test_repaired_tsv(spark, tmp_path):
    lines = S.line_scan(spark, put(tmp_path, "b.tsv", "id\tsource\ttarget\n1\tone\tun\n2\ttwo \nmore\tdeux\n3\tx\n"))
    got = [(r.id, r.cells) for r in S.repaired_tsv(lines, 3).orderBy("id").collect()]
    assert got == [(1, ["1", "one", "un"]), (2, ["2", "two more", "deux"])]


def test_tables_from_files(spark, tmp_path):
    path = put(tmp_path, "s.tsv", 'a\t"b\th\t0.5\n')
    assert [tuple(r) for r in S.scored_tsv(spark, path).collect()] == [("a", '"b', "h", 0.5)]
    put(tmp_path, "ser/exp/scores-500.csv", "book,BLEU\nGEN,12.5\n")
    got = S.csv_scores(spark, str(tmp_path / "ser"), ["book", "BLEU"]).collect()
    assert [(r.book, r.BLEU, r.series, r.experiment, r.steps) for r in got] == [("GEN", "12.5", "ser", "exp", "500")]
    put(tmp_path, "iso/en-A.txt", "x")
    put(tmp_path, "iso/fr-B.txt", "x")
    assert [r.file for r in S.files_by_iso(spark, str(tmp_path / "iso"), ["en"]).collect()] == ["en-A.txt"]


def test_usfm(spark, tmp_path):
    path = put(tmp_path, "p/41MAT.SFM", "\\id MAT test\n\\c 1\n\\s Head\n\\p\n\\v 1 In the\\f + note\\f* beginning\n\\q1 more\n\\v 2-3 two \\nd Lord\\nd* three\n")
    got = [tuple(r)[1:] for r in S.usfm_verses(spark, path).collect()]
    assert got == [("MAT", 1, 1, "In the beginning more"), ("MAT", 1, 2, "two Lord three"), ("MAT", 1, 3, "<range>")]
    refs = spark.createDataFrame([(1, "MAT", 1, "1"), (2, "MAT", 1, "9")], "line_no long, book string, chapter int, verse string")
    assert [r.text for r in S.to_vref_lines(S.usfm_verses(spark, path), refs).orderBy("line_no").collect()] == ["In the beginning more", ""]


def test_lemma_line(spark):
    df = spark.createDataFrame([("“Go, now.", "go|V<past> now<adv>|A")], "s string, l string")
    assert df.select(S.lemma_line(F.col("s"), F.col("l"))).first()[0] == "“go, now."


def test_xml_interlinear(spark, tmp_path):
    path = put(tmp_path, "x.xml", "<d><row><n>1</n><lang>en</lang><t>a</t></row><row><n>1</n><lang>fr</lang><t>b</t></row><row><n>2</n><lang>en</lang><t>c</t></row></d>")
    rows = S.xml_rows(spark, path, "row", "n long, lang string, t string").select(F.col("n").alias("line_no"), "lang", F.col("t").alias("text"))
    assert [tuple(r) for r in S.interlinear(rows).orderBy("line_no").collect()] == [(1, "a", "b"), (2, "c", "")]


def test_gold_alignment_links(spark, tmp_path):
    path = put(tmp_path, "g.json", json.dumps([{"vref": "MAT 1:1", "source": ["a b", "c"], "target": ["x", "y"], "links": [{"source": [0, 1], "target": [0, 1], "sure": True}]}]))
    row = S.gold_alignments(spark, path).first()
    assert row.src == ["a~b", "c"] and [(x.i, x.j, x.sure) for x in row.links] == [(0, 0, True), (0, 1, False), (1, 0, False), (1, 1, False)]


def test_alignment_and_lexicon_lines(spark, tmp_path):
    lines = S.line_scan(spark, put(tmp_path, "a.txt", "# note\n0-1 2-2:0.5\n"))
    assert [tuple(r) for r in S.alignment_lines(lines).collect()] == [(2, 0, 1, None), (2, 2, 2, 0.5)]
    lex = S.line_scan(spark, put(tmp_path, "l.txt", "# c\na\tx\t-0.1\na\ty\t-9\nNULL\tz\t-0.2\n"))
    got = [(r.src, r.trg) for r in S.lexicon_lines(lex, log_prob=True).collect()]
    assert got == [("a", "x")]


def test_log_carries_the_last_stem(spark, tmp_path):
    lines = S.line_scan(spark, put(tmp_path, "o.log", "Extracting en-A\n# of Verses: 3\n# of Verses: 5\nExtracting fr-B\n# of Verses: 7\n"))
    assert sorted((r.stem, r.verses) for r in S.verse_log(lines).collect()) == [("en-A", 5), ("fr-B", 7)]


def test_related_languages(spark, tmp_path):
    rows = [("aa", "A", "X", "f1"), ("bb", "B", "X", "f2"), ("cc", "C", "Y", "f1"), ("dd", "D", "Z", "f3")]
    path = put(tmp_path, "l.json", json.dumps([dict(zip(("isoCode", "language", "langCountry", "languageFamily"), r, strict=True)) for r in rows]))
    assert sorted(r[0] for r in S.related(S.languages(spark, path), ["aa"]).collect()) == ["aa", "bb", "cc"]


def test_config_layers(tmp_path):
    assert S.merged_config({"a": {"x": 1, "y": 2}}, {"a": {"y": 3}, "b": [1]}) == {"a": {"x": 1, "y": 3}, "b": [1]}
    pytest.importorskip("yaml")
    put(tmp_path, "config.yml", "a: {x: 5}\n")
    put(tmp_path, "sub/config.yml", "a: {y: 6}\n")
    assert S.load_config(str(tmp_path / "sub"), str(tmp_path), {"a": {"z": 7}}) == {"a": {"x": 5, "y": 6, "z": 7}}


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(2, "b"), (1, "a"), (3, "c")], "line_no long, text string")
    K.write_lines(rows, str(tmp_path / "out"))
    text = "".join(p.read_text() for p in sorted((tmp_path / "out").glob("part-*")))
    assert text == "a\nb\nc\n"
    spine = spark.range(1, 6).withColumnRenamed("id", "line_no")
    assert [r.text for r in K.padded(rows, spine, "line_no", "text").orderBy("line_no").collect()] == ["a", "b", "c", "", ""]
    lex = spark.createDataFrame([("a", "x", 0.25), ("a", "y", 0.75)], "src string, trg string, prob double")
    K.write_lexicon(lex, str(tmp_path / "lex"))
    assert "".join(p.read_text() for p in sorted((tmp_path / "lex").glob("part-*"))) == "a\ty\t0.75000000\na\tx\t0.25000000\n"
    assert K.score_table(lex, {"prob": 1}).first().prob in ("0.3", "0.2")
    new = spark.createDataFrame([(2, "B")], "line_no long, text string")
    assert sorted(tuple(r) for r in K.upserted(rows, new, ["line_no"]).collect()) == [(1, "a"), (2, "B"), (3, "c")]
    split = spark.createDataFrame([("train", "en", "fr", "src", "t")], "split string, src_iso string, trg_iso string, side string, text string")
    K.write_splits(split, str(tmp_path / "splits"))
    assert spark.read.parquet(str(tmp_path / "splits")).count() == 1
    conf = spark.createDataFrame([("GEN", 1, 1, 0.0), ("GEN", 1, 2, -2.0)], "book string, chapter int, verse int, log_prob double")
    assert abs(K.confidence_tables(conf)["books"].first().confidence - 0.36787944) < 1e-6
    K.write_json(lex, str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json")).count() == 2


BOOK = (
    '\\id GEN test\n\\h Genesis\n\\mt1 Title\n\\ip Intro \\bk x\\bk*\n\\c 1\n\\s1 Head\n\\p\n\\v 1 He said \\it hello\\it* there \\w Lord|lemma="lord"\\w*\'s end,\\f + \\ft note \\it x\\it* y\\f* so.\n'
    '\\q3 third level\n\\s2 Between \\nd X\\nd*\n\\r (ref)\n\\pmo more\n\\v 2-3 two \\va 4\\va* three \\qt-s |sid="1"\\*word\\qt-e\\*\n\\tr \\th1 a\\tc2 b\n\\v 4a x // y\n\\v 4b again\n'
    "\\c 2\n\\cp B\n\\p\n\\v 1 \\add \\+nd Lord\\+nd* God\\add*\n\\b\n\\rem no text\n\\p\n\\v 2\n\\p late\n\\v 3\n"
)


def test_no_text_of_a_marked_up_book_is_lost():
    from lineweave.sources import usfm

    assert usfm.verse_rows(BOOK) == [
        ("GEN", 1, 1, "He said hello there Lord's end, so. third level more"), ("GEN", 1, 2, "two three word a b"), ("GEN", 1, 3, "<range>"), ("GEN", 1, 4, "x y again"),
        ("GEN", 2, 1, "Lord God"), ("GEN", 2, 2, "late"), ("GEN", 2, 3, ""),
    ]
    assert "".join(t.raw for t in usfm.tokens(BOOK)) == BOOK


def test_books_are_written_back():
    from lineweave.sources import usfm

    for content in (BOOK, BOOK.replace("\n", "\r\n"), "", "no marker", "\\", "\\v", "\\c x\\v y \\* \\f open"):
        assert usfm.updated(content, {}) == content and "".join(t.raw for t in usfm.tokens(content)) == content
    new = {(1, 1): "First.", (1, 2): "Both.", (2, 2): "Filled.", (2, 3): "Last."}
    for styles in (True, False):
        out = usfm.updated(BOOK, new, styles)
        rows = {(c, v): t for _, c, v, t in usfm.verse_rows(out)}
        want = {(c, v): t for _, c, v, t in usfm.verse_rows(BOOK)}
        assert rows == want | new
        for kept in ("\\f + \\ft note \\it x\\it* y\\f*", "\\s2 Between \\nd X\\nd*\n\\r (ref)\n", "\\va 4\\va*", "\\v 4a x // y\n\\v 4b again\n", "\\rem no text\n"):
            assert kept in out
        assert ("\\w Lord" in out, "\\it hello" in out) == (False, False)


def test_books_updated_by_spark(spark):
    books = spark.createDataFrame([("a", BOOK), ("b", BOOK), ("c", "")], "file string, content string")
    new = spark.createDataFrame([("b", 1, 1, "New."), ("x", 1, 1, "Lost.")], "file string, chapter int, verse int, text string")
    got = {r.file: r.content for r in S.usfm_updated(books, new).collect()}
    assert got["a"] == BOOK and got["c"] == "" and "\\v 1 New." in got["b"]


def test_byte_order_mark_of_the_first_line_only(spark, tmp_path):
    path = put(tmp_path, "bom.txt", "\ufefffirst\n\ufeffsecond\n")
    for scan in (S.line_scan, S.large_line_scan):
        assert [r.text for r in scan(spark, path).orderBy("line_no").collect()] == ["first", "\ufeffsecond"]
