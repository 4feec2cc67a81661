"""Secret scans: fixed patterns, and a linear-chain conditional random field for what they miss.

Tokens are runs of the bytes that secrets are made of. Each is described by its shape (length, digits, letter
cases, changes of class), its neighbours, the separator before it and features of the whole file, and the
field tags it as the begin of a secret, its inside, or outside. A chain is a line, in training as in decoding by
Viterbi. The field learns from a bounded sample of lines whose labels are the pattern matches. Each match is
learned from in other spellings and places too: in other alphabets and lengths, behind ordinary words instead of
keywords, behind other separators, half of them with nothing known of the words around. So the field learns what
secrets look like, not the patterns themselves.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lineweave.llm.common import added, saved, table
from lineweave.llm.tokens import cut, joined, mixed, parts, span_hashes

#: The base patterns, and the least length of what they must find.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
WORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
KINDS = ("assign", "access", "hex", "learned")
LONG_HEX = re.compile(rb"[0-9a-f]{16}")

_LETTERS, _DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
#: What secrets are respelt in, and what may stand between a name and a secret.
ALPHABETS = (_LETTERS + _LETTERS.lower() + _DIGITS, _LETTERS + _LETTERS.lower() + _DIGITS + "+/", _LETTERS + _LETTERS.lower() + _DIGITS + "-_", _LETTERS + _LETTERS + _DIGITS, _DIGITS + "abcdef", _DIGITS + "ABCDEF")
SEPARATORS = (' = "', ': "', "=", ": ", " ", " '", '": "', " => ")

#: The bounds of what is learned from: documents (in order of their id's hash), and tokens of their lines (in order of
#: the line's hash, a third each for lines with a secret, other lines with long or mixed tokens, and one in PLAIN_EVERY of
#: the rest). RESPELT: how often each line with a secret is respelt. LONGEST, NEAR: lines of more tokens are learned
#: from in parts, and respelt in as many code points around a secret.
MAX_DOCS, MAX_TOKENS, PLAIN_EVERY, RESPELT, LONGEST, NEAR = 8000, 600_000, 8, 6, 256, 1000
SLOTS, FEATURES, TAGS = 1 << 16, 7, 3  # tags: 0 begin, 1 inside, 2 outside
BEGIN, INSIDE, OUTSIDE = range(TAGS)
CONTEXT = [2, 3, 4]  # the features of neighbouring words and separators
NEVER = -1e4
EPOCHS, RATE, DECAY, MINIBATCH = 12, 0.3, 1e-4, 8192


def base_spans(text: str, raw: bytes) -> list[tuple[int, int, int, int]]:
    """(start, end, kind, start of the secret itself) in code points; raw is the text in UTF-8."""
    out, low = [], raw.lower()
    if any(w in low for w in WORDS):
        out += [(m.start(), m.end(), 0, m.start(2)) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if b"AKIA" in raw:
        out += [(m.start(), m.end(), 1, m.start()) for m in ACCESS.finditer(text) if len(m[0]) >= 18]
    if LONG_HEX.search(raw):
        out += [(m.start(), m.end(), 2, m.start()) for m in HEX.finditer(text) if len(m[0]) >= 16]
    return sorted(out)


def _set(*spans: tuple[int, int]) -> np.ndarray:
    out = np.zeros(256, bool)
    for lo, hi in spans:
        out[lo : hi + 1] = True
    return out


DIGIT, UPPER, LOWER, HIGH = _set((48, 57)), _set((65, 90)), _set((97, 122)), _set((128, 255))
HEXES = _set((48, 57), (97, 102))
CLASS = DIGIT * 1 + UPPER * 2 + LOWER * 3 + HIGH * 4
TOKEN = (CLASS > 0) | np.isin(np.arange(256), [43, 45, 47, 95])


class Tokens:
    """Tokens of some texts: byte spans in their joint buffer, the line each is on, and hashed features."""

    def __init__(self, texts: list[bytes], share: np.ndarray | None = None):
        """share: of each text's bytes the digits, in 64ths, if the texts are parts of others."""
        buf, self.offsets = joined(texts)
        self.share = share
        inside = TOKEN[buf]
        edges = np.flatnonzero(np.diff(inside, prepend=False, append=False))
        self.starts, self.ends = edges[::2], edges[1::2]
        self.doc = np.searchsorted(self.offsets, self.starts, "right") - 1
        breaks = np.concatenate([np.flatnonzero(buf == 10), self.offsets[1:] - 1])
        breaks.sort()
        self.line = np.searchsorted(breaks, self.starts)
        self.begins = np.flatnonzero(np.diff(self.line, prepend=-1))  # first token of each line
        self.features = self._features(buf)

    def _count(self, flags: np.ndarray) -> np.ndarray:
        sums = np.zeros(len(flags) + 1, np.int32)
        np.cumsum(flags, out=sums[1:], dtype=np.int32)
        return sums[self.ends] - sums[self.starts], sums

    def _features(self, buf: np.ndarray) -> np.ndarray:
        n = len(self.starts)
        if not n:
            self.digits, self.share = np.zeros(0, np.int32), np.zeros(len(self.offsets) - 1, np.int64)
            return np.zeros((0, FEATURES), np.int64)
        size = self.ends - self.starts
        kind = CLASS[buf]
        digits, digit_sums = self._count(DIGIT[buf])
        self.digits = digits
        upper, _ = self._count(UPPER[buf])
        lower, _ = self._count(LOWER[buf])
        high, _ = self._count(HIGH[buf])
        hexes, _ = self._count(HEXES[buf])
        turns, _ = self._count(np.diff(kind, prepend=kind[:1]) != 0)
        length = np.minimum(size, 15) + np.minimum(np.maximum(size - 16, 0) // 8, 6) + (size > 15)
        share = lambda x: (4 * x + size - 1) // size  # noqa: E731  0 none ... 4 over three quarters
        shape = (((length * 5 + share(digits)) * 5 + share(upper)) * 5 + share(lower)) * 2 + (high > 0)
        look = (np.minimum(turns, 7) * 2 + (hexes == size)) * 2 + (digits > 0)
        if self.share is None:
            self.share = np.minimum(8, 64 * np.diff(digit_sums[self.offsets]) // np.maximum(np.diff(self.offsets), 1))
        file = self.share[self.doc]
        words = span_hashes(np.where(UPPER[buf], buf + 32, buf).astype(np.uint8), self.starts, self.ends)
        same_before = np.r_[False, self.line[1:] == self.line[:-1]]
        same_after = np.r_[same_before[1:], False]
        before = np.where(same_before, np.r_[np.uint64(0), words[:-1]], np.uint64(1))
        after = np.where(same_after, np.r_[words[1:], np.uint64(0)], np.uint64(1))
        sign = np.zeros(n, np.uint64)
        gap = np.where(same_before, self.starts - np.r_[0, self.ends[:-1]], 1 << 30)
        for k in range(1, 5):
            sign = sign * np.uint64(257) + np.where(gap >= k, buf[np.maximum(self.starts - k, 0)], 0).astype(np.uint64)
        columns = [shape, look * 32 + length, before, after, sign, file * 32 + length, np.zeros(n)]
        out = np.empty((n, FEATURES), np.int64)
        for k, c in enumerate(columns):
            out[:, k] = (mixed(c.astype(np.uint64) * np.uint64(FEATURES) + np.uint64(k)) >> np.uint64(48)).astype(np.int64)
        return out


class Field:
    """Weights (SLOTS, TAGS) of the features, and moves (TAGS, TAGS): scores of a tag after another."""

    def __init__(self):
        self.weights = np.zeros((SLOTS, TAGS))
        self.moves = np.zeros((TAGS, TAGS))
        self.moves[OUTSIDE, INSIDE] = NEVER
        self.first = np.array([0.0, NEVER, 0.0])

    def fit(self, chains: list[tuple[np.ndarray, np.ndarray]]) -> Field:
        """Least negative log-likelihood of chains (features (n, FEATURES), tags (n,)) by AdaGrad, gradients by
        forward-backward. Chains of like length share a batch, so their order does not matter."""
        grown, grown_moves = np.full((SLOTS, TAGS), 1e-6), np.full((TAGS, TAGS), 1e-6)
        draw, batches, sizes = np.random.default_rng(5), [], [len(y) for _, y in chains]
        order = sorted(range(len(chains)), key=lambda i: (sizes[i], chains[i][0].tobytes(), chains[i][1].tobytes()))
        for lo, hi in cut([sizes[i] for i in order], MINIBATCH):
            part = [chains[i] for i in order[lo:hi]]
            f = np.zeros((len(part), len(part[-1][1]), FEATURES), np.int32)
            y, mask = np.full(f.shape[:2], OUTSIDE), np.zeros(f.shape[:2], bool)
            for k, (one, tags) in enumerate(part):
                f[k, : len(tags)], y[k, : len(tags)], mask[k, : len(tags)] = one, tags, True
            batches.append((f, y, mask))
        for _ in range(EPOCHS):
            for k in draw.permutation(len(batches)):
                f, y, mask = batches[k]
                single, double = self.marginals(self.weights[f].sum(2), mask)
                np.put_along_axis(single, y[:, :, None], np.take_along_axis(single, y[:, :, None], 2) - mask[:, :, None], 2)
                each = np.repeat(single[mask], FEATURES, axis=0)
                slope = np.stack([np.bincount(f[mask].ravel(), each[:, t], SLOTS) for t in range(TAGS)], 1)
                on = mask[:, 1:]
                moved = double.sum((0, 1)) - np.bincount((y[:, :-1] * TAGS + y[:, 1:])[on], minlength=TAGS * TAGS).reshape(TAGS, TAGS)
                for w, g, h in ((self.weights, slope / len(y), grown), (self.moves, moved / len(y), grown_moves)):
                    g = g + DECAY * w * (g != 0)
                    h += g * g
                    w -= RATE * g / np.sqrt(h)
                self.moves[OUTSIDE, INSIDE] = NEVER
        return self

    def marginals(self, score: np.ndarray, mask: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Chances of each tag and of each pair of neighbouring tags; 0 where mask (n, length) is not set."""
        n, length, _ = score.shape
        mask = np.ones((n, length), bool) if mask is None else mask
        log_sum = lambda x, axis: (m := x.max(axis, keepdims=True)).squeeze(axis) + np.log(np.exp(x - m).sum(axis))
        forth, back = np.empty_like(score), np.zeros_like(score)
        forth[:, 0] = score[:, 0] + self.first
        for t in range(1, length):
            forth[:, t] = np.where(mask[:, t, None], score[:, t] + log_sum(forth[:, t - 1, :, None] + self.moves, 1), forth[:, t - 1])
        for t in range(length - 2, -1, -1):
            back[:, t] = np.where(mask[:, t + 1, None], log_sum(self.moves + (score[:, t + 1] + back[:, t + 1])[:, None, :], 2), 0)
        whole = log_sum(forth[:, -1], 1)[:, None, None]
        double = np.exp(forth[:, :-1, :, None] + self.moves + (score[:, 1:] + back[:, 1:])[:, :, None, :] - whole[..., None])
        return np.exp(forth + back - whole) * mask[:, :, None], double * mask[:, 1:, None, None]

    def decode(self, score: np.ndarray, line: np.ndarray) -> np.ndarray:
        """The best tags of each line: Viterbi over all lines side by side, the longest first."""
        n = len(score)
        if not n:
            return np.zeros(0, np.int8)
        begins = np.flatnonzero(np.diff(line, prepend=-1))
        sizes = np.diff(np.append(begins, n))
        order = np.argsort(-sizes, kind="stable")
        begins, sizes = begins[order], sizes[order]
        active = np.searchsorted(-sizes, -np.arange(1, sizes[0] + 1), "right")
        came = np.zeros((n, TAGS), np.int8)
        best = score[begins] + self.first
        ends = np.empty((len(begins), TAGS))
        for t in range(1, len(active)):
            k = active[t]
            ends[k : len(best)] = best[k:]
            options = best[:k, :, None] + self.moves
            at = begins[:k] + t
            came[at] = options.argmax(1)
            best = options.max(1) + score[at]
        ends[: len(best)] = best
        tags = np.zeros(n, np.int8)
        now = ends.argmax(1).astype(np.int8)
        for t in range(len(active) - 1, -1, -1):
            k = active[t]
            at = begins[:k] + t
            tags[at] = now[:k]
            if t:
                now[:k] = came[at, now[:k]]
        return tags


def secrets_in(spans: list[tuple[int, int, int, int]]) -> list[tuple[int, int]]:
    """(start, end) of the secrets of base spans, without keyword and quote; none overlap."""
    out: list[tuple[int, int]] = []
    for _, end, _, start in spans:
        if not out or start >= out[-1][1]:
            out.append((start, end))
        elif end > out[-1][1]:
            out[-1] = (out[-1][0], end)
    return out


MAX_HASH = (1 << 63) - 1


def respelt(text: str, spans: list[tuple[int, int, int, int]], draw: np.random.Generator) -> tuple[str, list[tuple[int, int]]]:
    """text with each secret in other letters of another length, half of them behind an ordinary word and another
    separator in place of what an assignment has, and where the secrets are now."""
    heads = {secret: start for start, _, kind, secret in reversed(spans) if kind == 0}
    words = re.findall(r"[^\W\d_]{3,}", text) or ["key"]
    parts, places, at, size = [], [], 0, 0
    for start, end in secrets_in(spans):
        letters = ALPHABETS[draw.integers(len(ALPHABETS))]
        new = "".join(letters[i] for i in draw.integers(0, len(letters), draw.integers(16, 64)))
        before = text[at:start]
        if start in heads and heads[start] >= at and draw.random() < 0.5:
            before = text[at : heads[start]] + words[draw.integers(len(words))] + SEPARATORS[draw.integers(len(SEPARATORS))]
        parts += [before, new]
        places.append((size + len(before), size + len(before) + len(new)))
        size, at = places[-1][1], end
    return "".join([*parts, text[at:]]), places


def labels_of(tokens: Tokens, texts: list[str], secrets: list[list[tuple[int, int]]]) -> np.ndarray:
    """Tags: of each secret's tokens the first begins, the others are inside."""
    tags = np.full(len(tokens.starts), OUTSIDE, np.int8)
    for d, (text, places) in enumerate(zip(texts, secrets, strict=True)):
        at = was = 0
        for start, end in places:
            lo = at + len(text[was:start].encode())
            at, was = lo + len(text[start:end].encode()), end
            first, last = np.searchsorted(tokens.ends, tokens.offsets[d] + lo, "right"), np.searchsorted(tokens.starts, tokens.offsets[d] + at)
            tags[first:last] = INSIDE
            tags[first : min(first + 1, last)] = BEGIN
    return tags


def stretches(text: str, spans: list[tuple[int, int, int, int]]) -> Iterator[tuple[int, int, list]]:
    """(start, end, spans) of the lines that hold spans, of long lines what is near them."""
    group: list = []
    for span in [*spans, None]:
        if group and (span is None or span[0] >= hi):
            yield lo, hi, [(s - lo, e - lo, k, at - lo) for s, e, k, at in group]
            group = []
        if span is not None:
            lo = lo if group else max(text.rfind("\n", 0, span[0]) + 1, span[0] - NEAR)
            end = text.find("\n", span[1])
            hi = max(hi if group else 0, min(len(text) if end < 0 else end, span[1] + NEAR))
            group.append(span)


def lines_of(raws: list[bytes], tokens: Tokens, tags: np.ndarray, apart: np.ndarray, copies: bool) -> Iterator[tuple[int, int, bytes, bytes]]:
    if not len(tags):
        return
    size, buf = tokens.ends - tokens.starts, b" ".join([*raws, b""])
    mixed_ = (np.add.reduceat(tokens.digits, tokens.begins) > 0) & (np.maximum.reduceat(size, tokens.begins) >= 12)
    secret = np.minimum.reduceat(tags, tokens.begins) < OUTSIDE
    out = np.maximum.reduceat(apart, tokens.begins) | (copies & ~secret)
    ends = np.append(tokens.begins[1:], len(tags))
    for k in np.flatnonzero(~out).tolist():
        lo, hi = tokens.begins[k], ends[k]
        h = xxhash.xxh64_intdigest(buf[tokens.starts[lo] : tokens.ends[hi - 1]]) >> 1
        kind = 0 if secret[k] else 1 if mixed_[k] else 2
        if kind < 2 or h % PLAIN_EVERY == 0:
            yield kind, h, tokens.features[lo:hi].astype(np.int32).tobytes(), tags[lo:hi].tobytes()


def labelled_lines(texts: list[str], kinds: tuple[str, ...]) -> Iterator[tuple[int, int, bytes, bytes]]:
    """(class, hash, features, tags) of the lines of some texts that may be learned from: 0 with secrets, in their own spelling
    and respelt, 1 with a long and mixed token, 2 others, one in PLAIN_EVERY. Lines with base spans of other kinds
    than these are left out."""
    raws = [t.encode() for t in texts]
    spans = [base_spans(t, r) for t, r in zip(texts, raws, strict=True)]
    given = [[s for s in one if KINDS[s[2]] in kinds] for one in spans]
    hidden = [[s for s in one if KINDS[s[2]] not in kinds] for one in spans]
    tokens = Tokens(raws)
    tags, apart = (labels_of(tokens, texts, [secrets_in(s) for s in one]) for one in (given, hidden))
    yield from lines_of(raws, tokens, tags, apart < OUTSIDE, False)
    copies = []
    for i, one in enumerate(given):
        for lo, hi, near in stretches(texts[i], one):
            for k in range(RESPELT if not any(lo < e and s < hi for s, e, *_ in hidden[i]) else 0):
                part = texts[i][lo:hi]
                copies.append((*respelt(part, near, np.random.default_rng([xxhash.xxh64_intdigest(part), k])), tokens.share[i]))
    for lo, hi in cut([len(t) for t, *_ in copies], 1 << 20):
        again, places, share = zip(*copies[lo:hi], strict=True)
        raws = [t.encode() for t in again]
        tokens = Tokens(raws, np.array(share))
        hidden_ = np.arange(lo, hi)[tokens.doc] % 2 == 1
        tokens.features[np.ix_(hidden_, CONTEXT)] = np.array(CONTEXT)  # of every second copy only shapes are seen
        tags = labels_of(tokens, list(again), list(places))
        yield from lines_of(raws, tokens, tags, np.zeros(len(tags), bool), True)


def chains_of(features: bytes, tags: bytes) -> list[tuple[np.ndarray, np.ndarray]]:
    """A line as chains: one, or if it is long, parts that do not begin inside a secret."""
    f, y = np.frombuffer(features, np.int32).reshape(-1, FEATURES), np.frombuffer(tags, np.int8)
    out, lo = [], 0
    while len(y) - lo > LONGEST:
        free = np.flatnonzero(y[lo + LONGEST :] != INSIDE)
        if not len(free):
            break
        hi = lo + LONGEST + int(free[0])
        out.append((f[lo:hi], y[lo:hi]))
        lo = hi
    return [*out, (f[lo:], y[lo:])] if lo < len(y) else out


def last_hash(sizes: DataFrame, limit: int) -> int:
    """The largest hash up to which the lines (h, n) have at most `limit` tokens together, the first line's at least; -1 for
    no lines. Sums by 16 bits of the hash at a time tell where to look closer, so 65536 numbers at most are collected."""
    used, prefix = 0, 0
    for shift in (47, 31, 15, 0):
        inside = sizes.filter(F.shiftright("h", shift + 16) == prefix) if shift else sizes.filter(F.shiftright("h", 15) == prefix)
        sums = sorted(tuple(r) for r in inside.groupBy(F.shiftright("h", shift).alias("p")).agg(F.sum("n")).collect())
        if not sums:
            return -1
        for p, n in sums:
            if used + n > limit:
                prefix = p
                break
            used += n
        else:
            return MAX_HASH
    return prefix - 1 if used else prefix


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_docs: int = MAX_DOCS, max_tokens: int = MAX_TOKENS, kinds: tuple[str, ...] = KINDS[:3]) -> Field:
    """A field learned from the base patterns of these kinds in a bounded sample: lines of at most max_docs documents,
    the first in order of their id's hash, with at most max_tokens tokens (and one line) together.

    Null and empty texts and rows without an id teach nothing. A table without any secret gives a field that finds
    none, an empty one likewise.
    """
    picked = docs.select(F.col(id_col).cast("long").alias("i")).dropna().distinct().orderBy(F.xxhash64("i"), "i").limit(max_docs)
    texts = docs.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(picked), "i")  # max_docs ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, raw in parts(batch, 1):
                columns = list(zip(*labelled_lines([t.decode() for t in raw], kinds), strict=True)) or [()] * 4
                types = (pa.int32(), pa.int64(), pa.binary(), pa.binary())
                yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, types, strict=True)], ["k", "h", "f", "y"])

    found = saved(texts.mapInArrow(run, "k int, h long, f binary, y binary"), "labelled-lines")
    sizes = saved(found.groupBy("k", "h").agg(F.max(F.octet_length("y")).alias("n")), "line-sizes")
    last = {k: last_hash(sizes.filter(F.col("k") == k), max_tokens // 3) for k in range(3)}
    if last[0] < 0:
        return Field()
    on = (F.col("h") <= last[0]) & (F.col("k") == 0) | (F.col("h") <= last[1]) & (F.col("k") == 1) | (F.col("h") <= last[2]) & (F.col("k") == 2)
    rows = found.filter(on).groupBy("k", "h").agg(F.max(F.struct("f", "y")).alias("r")).select("r.f", "r.y").toArrow()
    chains = [c for f, y in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist(), strict=True) for c in chains_of(f, y)]
    field = Field().fit(chains)
    del rows, chains
    pa.default_memory_pool().release_unused()
    return field


def find(texts: list[str], field: Field) -> list[list[tuple[int, int, int]]]:
    """(start, end, kind) of all spans of each text: the base ones, and learned ones that no base one covers whole."""
    raws = [t.encode() for t in texts]
    tokens = Tokens(raws)
    score = np.zeros((len(tokens.starts), TAGS))
    for k in range(FEATURES):
        score += field.weights[tokens.features[:, k]]
    tags = field.decode(score, tokens.line)
    out = [[s[:3] for s in base_spans(t, r)] for t, r in zip(texts, raws, strict=True)]
    heads = np.flatnonzero(tags == BEGIN)
    if not len(heads):
        return out
    tail = np.flatnonzero(np.append(tags, OUTSIDE) != INSIDE)
    last = tail[np.searchsorted(tail, heads + 1)] - 1
    begins = np.frombuffer(b" ".join([*raws, b""]), np.uint8) & 0xC0 != 0x80  # one byte for each code point
    points = np.concatenate([[0], np.cumsum(begins, dtype=np.int64)])
    starts, ends, origin = points[tokens.starts[heads]], points[tokens.ends[last]], points[tokens.offsets]
    docs, first = np.unique(tokens.doc[heads], return_index=True)
    for d, at, to in zip(docs.tolist(), first.tolist(), [*first[1:].tolist(), len(heads)], strict=True):
        lo, hi = starts[at:to] - origin[d], ends[at:to] - origin[d]
        base = sorted(out[d])
        reach = np.maximum.accumulate([e for _, e, _ in base]) if base else np.zeros(0, np.int64)
        nth = np.searchsorted([s for s, *_ in base], lo, "right") - 1
        free = (nth < 0) | (np.append(reach, 0)[nth] < hi)
        out[d] = sorted(base + [(s, e, 3) for s, e in zip(lo[free].tolist(), hi[free].tolist(), strict=True)])
    return out


SPANS = "array<struct<kind: string, start: long, end: long>>"


def scan(docs: DataFrame, field: Field, id_col: str = "doc_id", text_col: str = "text", redact: str | None = None) -> DataFrame:
    """docs and __spans: secrets of each whole text in code points, ends exclusive, by start and then kind.

    Kinds: assign, access and hex are the base patterns; learned are the field's own. Null and empty texts
    have none. With redact, each secret in text_col is replaced by that string (spans that touch or overlap: by one).
    A column of docs named __spans is replaced.
    """
    docs, schema = added(docs, "__spans", SPANS)
    spark, at_text = docs.sparkSession, docs.columns.index(text_col)
    shared = spark.sparkContext.broadcast((field.weights.astype(np.float32), field.moves))  # SLOTS x TAGS floats

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Field()
        model.weights, model.moves = shared.value
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            for part, raws in parts(batch, at_text):
                spans = find([t.decode() for t in raws], model)
                columns = list(part.columns)
                if redact is not None:
                    columns[at_text] = pa.array([redacted(t, s, redact) if s else t for t, s in zip(columns[at_text].to_pylist(), spans, strict=True)], columns[at_text].type)
                told = [[{"kind": KINDS[k], "start": s, "end": e} for s, e, k in one] for one in spans]
                yield pa.record_batch([*columns, pa.array(told, kind)], [*part.schema.names, "__spans"])

    return docs.mapInArrow(run, schema)


def redacted(text: str, spans: list[tuple[int, int, int]], mark: str) -> str:
    out, at = [], 0
    for start, end, _ in spans:
        if start >= at and (start > at or not out):
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join([*out, text[at:]])


def op8_secrets(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = scan(docs, fit(docs)).select("doc_id", "__spans")
    base = F.filter("__spans", lambda s: s["kind"] != "learned")
    line = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter("__spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(line(base), 256).alias("base_sha256"), line(F.col("__spans")).alias("spans"))
