"""BPE encoding in batched numpy merge rounds, and decoding.

The distinct words of a batch of texts become one flat array of symbols. Each round finds, for every word, its
pair of lowest merge rank by binary search over the sorted pair keys, and merges all places of that pair in
all words at once; only pairs next to a merge are looked up again. Words met before keep their tokens in a
bounded table of the Python worker.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lineweave.llm.common import table
from lineweave.llm.tokens import cut

#: Words that a worker keeps; beyond that it starts anew.
KEPT_WORDS = 200_000
#: White space as the vocabulary's own normaliser and splitter see it.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: What newer character tables than the library's call letters or numbers; they are signs to it.
SIGNS = (
    "0558 058B-058C 088F 0C5C 0CDC 208F 209D-209F A7CE-A7CF A7D2 A7D4 A7DD A7E2 A7F1 AB6C-AB6D 107BB-107BF 10940-10959 10EC5-10EC7 "
    "10ED9-10EEE 11B0A 11DB0-11DDB 11DE0-11DE9 11DF1 1246F 12475-1247F 12550-12686 16EA0-16EB8 16EBB-16ED3 16FF2-16FF6 187F8-187FF "
    "18CD6-18CDA 18D09-18D20 18D80-18DF2 18E00-19191 191A0-191D2 1B123-1B128 1B168 1D6A6 1DF1F-1DF24 1DF2B-1DF81 1DF90-1DF96 "
    "1DFCD-1DFFF 1E6C0-1E6DE 1E6E0-1E6E2 1E6E4-1E6E5 1E6E7-1E6ED 1E6F0-1E6F4 1E6FE-1E6FF 2B73A-2B73F 2B81E 2CEA2-2CEAD 323B0-33479 3D000-3FC3F"
)
#: Marks that the library's NFC, of an older table, neither reorders nor composes.
INERT = (
    "07FD 0898-089F 08CA-08D3 09FE 0C3C 0D3B-0D3C 0EBA 1715 1ABF-1ACE 1DF6-1DFA A82C 10D24-10D27 10EAB-10EAC 10EFD-10EFF 10F46-10F50 "
    "10F82-10F85 11070 1133B 1145E 11839-1183A 11930 1193D-1193E 11943 119E0 11A34 11A47 11A99 11D42 11D44-11D45 11D97 11F41-11F42 "
    "16FF0-16FF1 1E08F 1E130-1E136 1E2AE 1E2EC-1E2EF 1E4EC-1E4EF"
)
#: Capitals (first, last, small letter of the first) that Python's lower() may not know yet.
CAPITALS = (
    (0x1C89, 0x1C89, 0x1C8A), (0xA7CB, 0xA7CB, 0x264), (0xA7CC, 0xA7CC, 0xA7CD), (0xA7CE, 0xA7CE, 0xA7CF), (0xA7D2, 0xA7D2, 0xA7D3),
    (0xA7D4, 0xA7D4, 0xA7D5), (0xA7DA, 0xA7DA, 0xA7DB), (0xA7DC, 0xA7DC, 0x19B), (0x10D50, 0x10D65, 0x10D70), (0x16EA0, 0x16EB8, 0x16EBB),
)


def char_class(ranges: str) -> str:
    """The inside of a character class, of ranges in hexadecimal."""
    return "".join("-".join(f"\\U{int(x, 16):08X}" for x in r.split("-")) for r in ranges.split())


SMALL = {c: small + c - first for first, last, small in CAPITALS for c in range(first, last + 1)}
SMALL[ord("Σ")] = ord("σ")  # by character: no rule for a final sigma
LATE_SIGN, LATE_MARK = re.compile(f"[{char_class(SIGNS)}]"), re.compile(f"([{char_class(INERT)}])")
#: What most texts have nothing of.
LATE = re.compile(f"[{char_class(SIGNS)}{char_class(INERT)}{''.join(map(chr, SMALL))}]")
WORD = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{SPACE}\p{{L}}\p{{N}}]+", regex.V0)
_LATE = char_class(SIGNS)
#: The same for texts with late signs.
WORD_LATE = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[\p{{L}}--[{_LATE}]]+|[\p{{N}}--[{_LATE}]]|(?:[^{SPACE}\p{{L}}\p{{N}}]|[{_LATE}])+", regex.V1)


def byte_chars() -> list[str]:
    """The printable character that stands for each byte: itself if it is printable Latin-1, else the next from U+0100 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class Vocabulary:
    """Merges and names of a tokenizers JSON file whose model is a BPE with word ends over byte characters."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        ids, end = model["vocab"], model["end_of_word_suffix"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        named = ids | self.special
        self.names = [""] * (max(named.values()) + 1)
        for name, i in named.items():
            self.names[i] = name
        chars = byte_chars()
        self.inner = np.array([ids[c] for c in chars], np.int64)
        self.final = np.array([ids[c + end] for c in chars], np.int64)
        self.size = len(self.names)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        keys = np.array([ids[a] * self.size + ids[b] for a, b in pairs], np.int64)
        order = np.argsort(keys)
        self.keys = keys[order]
        self.ranks = order.astype(np.int64)
        self.made = np.array([ids[a + b] for a, b in pairs], np.int64)
        self.split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The merge rank of each pair; the number of merges where there is none."""
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], len(self.keys))

    def merge_rounds(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, counts): the tokens of all words, one after another, and how many each has. No word is empty."""
        raw = np.frombuffer(b"".join(words), np.uint8)
        ends = np.cumsum([len(w) for w in words])
        symbols = self.inner[raw]
        symbols[ends - 1] = self.final[raw[ends - 1]]
        word = np.repeat(np.arange(len(words)), np.diff(ends, prepend=0))
        none = len(self.keys)
        done_ids, done_words = [], []
        rank = np.full(len(symbols), none, np.int64)  # of each symbol with the one behind it
        inside = np.flatnonzero(word[1:] == word[:-1])
        rank[inside] = self.rank(symbols[inside], symbols[inside + 1])
        while len(symbols):
            first = np.flatnonzero(np.diff(word, prepend=-1))
            least = np.repeat(np.minimum.reduceat(rank, first), np.diff(np.append(first, len(word))))
            open_ = least < none
            if not open_.all():
                done_ids.append(symbols[~open_])
                done_words.append(word[~open_])
                symbols, word, rank, least = symbols[open_], word[open_], rank[open_], least[open_]
                continue
            hit = rank == least
            run = np.flatnonzero(hit)
            # of pairs that overlap (a a a), every second one from the left
            start = np.flatnonzero(np.diff(run, prepend=-2) != 1)
            nth = np.arange(len(run)) - np.repeat(start, np.diff(np.append(start, len(run))))
            run = run[nth % 2 == 0]
            symbols[run] = self.made[rank[run]]
            stay = np.ones(len(symbols), bool)
            stay[run + 1] = False
            touched = np.zeros(len(symbols), bool)
            touched[run] = True
            symbols, word, rank, touched = symbols[stay], word[stay], rank[stay], touched[stay]
            redo = touched.copy()
            redo[:-1] |= touched[1:]
            redo = np.flatnonzero(redo)
            rank[redo] = none
            redo = redo[redo < len(symbols) - 1]
            redo = redo[word[redo] == word[redo + 1]]
            rank[redo] = self.rank(symbols[redo], symbols[redo + 1])
        word = np.concatenate(done_words) if done_words else np.zeros(0, np.int64)
        by = np.argsort(word, kind="stable")
        ids = np.concatenate(done_ids)[by] if done_ids else np.zeros(0, np.int64)
        return ids, np.bincount(word, minlength=len(words))


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def composed(text: str) -> str:
    """NFC, with inert marks as borders."""
    return "".join(p if i % 2 else unicodedata.normalize("NFC", p) for i, p in enumerate(LATE_MARK.split(text)))


def words_of(text: str) -> list[str]:
    """The words and signs of a text without special strings, in NFC and in lower case by character. White space only parts
    them, so runs of it need not become single blanks first."""
    if text.isascii():
        return WORD.findall(text.lower())
    if not LATE.search(text):
        return WORD.findall(unicodedata.normalize("NFC", text).lower())
    text = composed(text).translate(SMALL).lower()
    return (WORD_LATE if LATE_SIGN.search(text) else WORD).findall(text)


class Encoder:
    """Encodes batches of texts; keeps the tokens of up to KEPT_WORDS words."""

    def __init__(self, vocab: Vocabulary):
        self.vocab = vocab
        self.forget()

    def forget(self) -> None:
        self.places: dict[str, int] = {}
        self.ids, self.starts, self.counts = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)
        if self.vocab.special:
            self.learn_ids(list(self.vocab.special), np.array(list(self.vocab.special.values())), np.ones(len(self.vocab.special), np.int64))

    def learn_ids(self, words: list[str], ids: np.ndarray, counts: np.ndarray) -> None:
        self.places.update(zip(words, range(len(self.starts), len(self.starts) + len(words)), strict=True))
        self.starts = np.concatenate([self.starts, len(self.ids) + np.cumsum(counts) - counts])
        self.ids, self.counts = np.concatenate([self.ids, ids.astype(np.int32)]), np.concatenate([self.counts, counts])

    def words(self, text: str) -> list[str]:
        vocab = self.vocab
        if vocab.split is None or not any(s in text for s in vocab.special):
            return words_of(text)
        out: list[str] = []
        for i, part in enumerate(vocab.split.split(text)):
            # a special string never is a word of the splitter by itself: its letters and signs are cut apart
            out += [part] if i % 2 else words_of(part)
        return out

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets): the tokens of all texts, one after another."""
        found = [self.words(t) for t in texts]
        if len(self.places) > KEPT_WORDS:
            self.forget()
        new = list({w for ws in found for w in ws} - self.places.keys())
        if new:
            self.learn_ids(new, *self.vocab.merge_rounds([w.encode() for w in new]))
        sizes = np.array([len(ws) for ws in found], np.int64)
        place = np.fromiter((p for ws in found for p in map(self.places.__getitem__, ws)), np.int64, int(sizes.sum()))
        counts = self.counts[place]
        ends = np.cumsum(counts)
        at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.starts[place] - (ends - counts), counts)
        offsets = np.concatenate([[0], np.concatenate([[0], ends])[np.cumsum(sizes)]])
        return self.ids[at], offsets


_encoders: dict[str, Encoder] = {}
#: Bytes of text that become Python words at a time.
PIECE = 2 << 20


def encoded_pieces(batch: pa.RecordBatch, vocab_path: str) -> Iterator[tuple[pa.Array, pa.ListArray]]:
    """(ids of the rows, token ids) of a batch (id, text), a piece at a time."""
    encoder = _encoders.setdefault(vocab_path, Encoder(vocabulary(vocab_path)))
    sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)
    for lo, hi in cut(sizes, PIECE):
        ids, offsets = encoder.encode([t or "" for t in batch.column(1).slice(lo, hi - lo).to_pylist()])
        yield batch.column(0).slice(lo, hi - lo), pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids))


def named(ids: pa.ListArray, vocab_path: str) -> pa.Array:
    """The tokens' names, a blank between."""
    names = pa.array(vocabulary(vocab_path).names, pa.string())
    lists = pa.ListArray.from_arrays(ids.offsets, names.take(ids.values))
    return pc.binary_join(lists, " ")


def rows_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def encode(docs: DataFrame, vocab_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids): the token ids of each whole text, without added special tokens; special strings inside a
    text become their own ids, as the tokenizers library has it. A null or empty text has none. Repeated rows stay
    repeated; other columns of docs are not returned. Where Python's character tables differ from the library's, the
    library's hold (SIGNS, INERT, CAPITALS).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for keys, ids in encoded_pieces(batch, vocab_path):
                yield pa.record_batch([keys, ids], ["doc_id", "ids"])

    return rows_of(docs, id_col, text_col).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, vocab_path: str) -> DataFrame:
    """(doc_id, ids, text): the tokens' names with a blank between, special ones too. The vocabulary states no
    decoder, so word ends and byte characters stay as they are named."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = pa.concat_arrays([batch.column("ids")])
            yield pa.record_batch([*batch.columns, named(ids, vocab_path)], ["doc_id", "ids", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids array<int>, text string")


def encode_and_decode(docs: DataFrame, vocab_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """decode(encode(docs)) in one Python worker a core instead of two."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for keys, ids in encoded_pieces(batch, vocab_path):
                yield pa.record_batch([keys, ids, named(ids, vocab_path)], ["doc_id", "ids", "text"])

    return rows_of(docs, id_col, text_col).mapInArrow(run, "doc_id long, ids array<int>, text string")


def op9_bpe(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    done = encode_and_decode(table(spark, sf_dir, "documents"), path)
    return done.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("text", 256).alias("decoded_sha256"),
    )
