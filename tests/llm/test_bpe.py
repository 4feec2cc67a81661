import hashlib

import pytest

from lineweave.llm import bpe

public_tokenizers = pytest.importorskip("public_tokenizers")
tokenizers = pytest.importorskip("tokenizers")
PATH = public_tokenizers.path("word_bpe_49k.json")
TEXTS = ["", " \t", "it's DON'T we'LL", "<|startoftext|>Hi<|endoftext|> <|startoftext|", "ΑΣ ΑΣΑ ς", "İstanbul é é", "a b\x85c\x1cd", "aaaaaaaa aaaa !!!!!!! ???????", "日本語テキスト 😀😀", "½ ² ٣ 1234", "ﬁ 한국어 가", "a" * 3000, "!?" * 500, "Les déjà-vu's"]


@pytest.fixture(scope="module")
def library():
    t = tokenizers.Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return t


def test_encode_equals_library(library):
    encoder = bpe.Encoder(bpe.vocabulary(PATH))
    for _ in range(2):  # the second time from the table of known words
        ids, at = encoder.encode(TEXTS)
        for i, text in enumerate(TEXTS):
            assert ids[at[i] : at[i + 1]].tolist() == library.encode(text, add_special_tokens=False).ids, text


def test_every_code_point_equals_library(library):
    """In a word, behind it, and before a digit; and marks in sequences that NFC reorders."""
    encoder = bpe.Encoder(bpe.vocabulary(PATH))
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = ["".join(f"a{chr(c)}b {chr(c)}1 " for c in points[at : at + 16]) for at in range(0, len(points), 16)]
    marks = [chr(a) for r in bpe.INERT.split() for a in range(int(r.split("-")[0], 16), int(r.split("-")[-1], 16) + 1)]
    texts += [f"a{m}\u0316\u0301 \u00e1{m}\u0316 \u0345{m}\u0301 q\u0334{m}x" for m in marks] + ["\U00011935\U00011930"]
    for at in range(0, len(texts), 1000):
        ids, offsets = encoder.encode(texts[at : at + 1000])
        for i, want in enumerate(library.encode_batch(texts[at : at + 1000], add_special_tokens=False)):
            assert ids[offsets[i] : offsets[i + 1]].tolist() == want.ids, ascii(texts[at + i])


def test_repeated_rows_and_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "one two", [7]), (1, "one two", [7]), (2, "", None)], "doc_id long, text string, ids array<int>")
    got = bpe.encode_and_decode(docs, PATH)
    assert got.columns == ["doc_id", "ids", "text"] and sorted((r.doc_id, len(r.ids)) for r in got.collect()) == [(1, 2), (1, 2), (2, 0)]


def test_small_table_of_words(library, monkeypatch):
    monkeypatch.setattr(bpe, "KEPT_WORDS", 3)
    encoder = bpe.Encoder(bpe.vocabulary(PATH))
    for text in TEXTS:
        assert encoder.encode([text])[0].tolist() == library.encode(text, add_special_tokens=False).ids


def test_round_trip_and_digests(spark, library):
    docs = spark.createDataFrame([*enumerate(TEXTS), (99, None), (None, "x")], "doc_id long, text string")
    both = {r.doc_id: r for r in bpe.encode_and_decode(docs, PATH).collect()}
    apart = {r.doc_id: r for r in bpe.decode(bpe.encode(docs, PATH), PATH).collect()}
    assert both == apart and both[99].ids == [] and both[99].text == ""
    for i, text in enumerate(TEXTS):
        want = library.encode(text, add_special_tokens=False).ids
        assert both[i].ids == want
        assert hashlib.sha256(both[i].text.encode()).digest() == hashlib.sha256(library.decode(want, skip_special_tokens=False).encode()).digest()
    assert bpe.encode(docs.limit(0), PATH).count() == 0
