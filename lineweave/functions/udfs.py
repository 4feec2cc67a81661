"""What built-in functions cannot express, as Arrow UDFs over plain Python functions (class P of the inventory)."""

from __future__ import annotations

import difflib
import re
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type


#: Rows of an Arrow batch that are Python objects at a time.
HELD = 64


def rows_of(columns: tuple[pa.Array, ...], held: int = HELD) -> Iterator[tuple]:
    """The rows of columns, a few at a time as Python objects: a batch has thousands, and a list of words takes many times its bytes."""
    for lo in range(0, len(columns[0]), held):
        yield from zip(*(c.slice(lo, held).to_pylist() for c in columns), strict=True)


def mapped(f: Callable, kind: T.DataType):
    """An Arrow UDF that applies f to each row's values; null for a null."""
    arrow = to_arrow_type(kind)

    @F.arrow_udf(kind)
    def run(*columns: pa.Array) -> pa.Array:
        found: list = []
        parts = []
        for row in rows_of(columns):
            found.append(None if any(x is None for x in row) else f(*row))
            if len(found) == HELD:
                parts.append(pa.array(found, arrow))
                found = []
        return pa.concat_arrays([*parts, pa.array(found, arrow)])

    return run


def nfc_text(text: str) -> str:
    return unicodedata.normalize("NFC", text)


def unicode_details(text: str) -> str:
    """U+XXXX NAME of each character."""
    return "; ".join(f"U+{ord(c):04X} {unicodedata.name(c, '')}".rstrip() for c in text)


def normaliser_warnings(text: str, rules: dict[str, str]) -> list[dict]:
    """(code, pos, slice) of what the normaliser of these rules cannot or should not decide.

    consecutive: marks next to each other, white space aside. undefined: a sign that is no letter, number, white space or
    known mark. bordered: a mark between other characters without spacing. starting and ending: a mark that clings to
    the word before begins the text, one that clings to the word after ends it. apart: a mark that may cling either
    way has white space on both sides.
    """
    of = lambda *kinds: "".join(re.escape(m) for m, k in rules.items() if k in kinds)
    every = of("before", "after", "either", "none")
    patterns = [("consecutive", rf"[{every}][{every}\s]*[{every}]"), ("undefined", rf"[^\w\s{every}]|_"), ("bordered", rf"(?<=[^\s{every}])[{every}](?=[^\s{every}])")]
    patterns += [(code, p) for code, kind, p in (("starting", "before", r"\A\s*([{}])"), ("ending", "after", r"([{}])(?=\s*\Z)"), ("apart", "either", r"(?<=\S\s)\s*([{}])(?=\s+\S)")) if of(kind) for p in [p.format(of(kind))]]
    out = []
    for code, pattern in patterns:
        for m in re.finditer(pattern, text):
            if code != "undefined" or unicodedata.category(m[0])[0] not in "LN":
                at = 1 if m.re.groups else 0
                out.append({"code": code, "pos": m.start(at), "slice": m[at]})
    return out


def edit_counts(a: list, b: list, swaps: bool = False) -> int:
    """Edit distance of two token lists; with swaps, exchanging neighbours is one edit (M07). Without, see quick_edits."""
    if not swaps:
        return quick_edits(a, b)
    before, row = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        older, before, row = before, row, [i]
        for j, y in enumerate(b, 1):
            cost = min(before[j] + 1, row[j - 1] + 1, before[j - 1] + (x != y))
            if swaps and i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                cost = min(cost, older[j - 2] + 1)
            row.append(cost)
    return row[-1]


def jaro_similarity(a: list, b: list) -> float:
    """Jaro similarity of two sequences."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    taken, mine = [False] * len(b), []
    for i, x in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not taken[j] and b[j] == x:
                taken[j] = True
                mine.append(x)
                break
    if not mine:
        return 0.0
    theirs = [y for y, t in zip(b, taken, strict=True) if t]
    m, swapped = len(mine), sum(x != y for x, y in zip(mine, theirs, strict=True)) / 2
    return (m / len(a) + m / len(b) + (m - swapped) / m) / 3


def quick_edits(a: list, b: list) -> int:
    """Edit distance of two token lists by bit vectors (Myers, 1999)."""
    if not a:
        return len(b)
    places: dict = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << i
    full, last, up, down, score = (1 << len(a)) - 1, 1 << len(a) - 1, (1 << len(a)) - 1, 0, len(a)
    for y in b:
        same = places.get(y, 0)
        across = (((same & up) + up) ^ up) | same
        rise, fall = down | ~(across | up) & full, up & across
        score += bool(rise & last) - bool(fall & last)
        rise, fall = (rise << 1 | 1) & full, fall << 1 & full
        keep = same | down
        up, down = fall | ~(keep | rise) & full, rise & keep
    return score


def distances(words: np.ndarray, ref: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edit distances of the first words (row) to the first of ref (column), and of those from a row on to those from a column on."""
    out = np.empty((len(words) + 1, 2, len(ref) + 1), np.int32)
    at = np.arange(len(ref) + 1, dtype=np.int32)
    out[0], out[:, :, 0] = at, np.arange(len(words) + 1)[:, None]
    other = np.stack([words, words[::-1]], axis=1)[:, :, None] != np.stack([ref, ref[::-1]])
    out[1:, :, 1:] = other
    for last, row in zip(out[:-1], out[1:]):
        row[:, 1:] += last[:, :-1]
        np.minimum(row[:, 1:], last[:, 1:] + 1, out=row[:, 1:])
        row -= at
        np.minimum.accumulate(row, axis=1, out=row)
        row += at
    return out[:, 0], out[::-1, 1, ::-1]


class Bounds:
    """What any shift in hyp costs at least: a run of n words that is taken out changes the distance to ref by what it does alone, and n more
    at most where it is put back; a word that is put in does so likewise, and one more at most where it is taken out."""

    def __init__(self, hyp: list[str], ref: list[str], longest: int) -> None:
        number: dict[str, int] = {}
        a, b = (np.array([number.setdefault(w, len(number)) for w in words], np.int64) for words in (hyp, ref))
        self.before, self.behind = distances(a, b)
        self.out = [((self.before[: len(hyp) + 1 - n] + self.behind[n:]).min(axis=1) - n).tolist() for n in range(1, min(longest, len(hyp)) + 1)]
        self.met: dict[str, list[int]] = {}

    def put(self, w: str, at: int, places: list[int]) -> int:
        """With the word w, which ref has at places, put in before place `at` of hyp, where it meets one of them, and another taken out."""
        if w not in self.met:
            places = np.array(places)
            self.met[w] = ((self.before[:, places] + self.behind[:, places + 1]).min(axis=1) - 1).tolist()
        return self.met[w][at]


def ter_edits(hyp: list[str], ref: list[str], reach: int = 50, longest: int = 10) -> int:
    """Edits of TER (Snover et al., 2006): the shift that saves most is made as long as one saves more than it costs.

    A shift moves a run of words, of any length up to longest, to where the same run stands in ref. Put back elsewhere, it saves
    an edit a word at most against hyp without the run, so shifts that cannot beat the best one so far are passed over.
    """
    hyp, shifts = list(hyp), 0
    if not ref:
        return len(hyp)
    places: dict[str, list[int]] = {}
    for j, w in enumerate(ref):
        places.setdefault(w, []).append(j)
    bits = {w: sum(1 << j for j in js) for w, js in places.items()}
    full, last = (1 << len(ref)) - 1, 1 << len(ref) - 1

    def step(w: str, up: int, down: int, score: int) -> tuple[int, int, int]:
        """One more word against all of ref, as in quick_edits."""
        same = bits.get(w, 0)
        across = (((same & up) + up) ^ up) | same
        rise, fall = down | ~(across | up) & full, up & across
        score += bool(rise & last) - bool(fall & last)
        rise, fall = (rise << 1 | 1) & full, fall << 1 & full
        keep = same | down
        return fall | ~(keep | rise) & full, rise & keep, score

    while True:
        states = [(full, 0, len(ref))]  # by how many words of hyp are behind; a shift changes nothing before its first place
        for w in hyp:
            states.append(step(w, *states[-1]))
        best = states[-1][2]
        found, known, open_ = None, {}, []
        least = Bounds(hyp, ref, longest) if best else None
        for i, w in enumerate(hyp if best else ()):
            for j in places.get(w, ()):
                if i == j or abs(i - j) > reach:
                    continue
                n = 0
                while n < longest and i + n < len(hyp) and j + n < len(ref) and hyp[i + n] == ref[j + n]:
                    n += 1
                    low = least.out[n - 1][i]
                    if n == 1 and low < best - 1:
                        low = max(low, min(least.put(w, j + 1 if j > i else j, places[w]) if j < len(hyp) else low, best))
                    if low < best - 1:
                        open_.append((low, i, j, n))
        for low, *at in sorted(open_):
            if found and (low, at) >= found[:2]:  # of equal costs the first place counts
                if low > found[0]:
                    break
                continue
            i, j, n = at
            to = min(j, len(hyp) - n)
            first, end = min(i, to), max(i, to) + n
            part = (*hyp[i + n : end], *hyp[i : i + n]) if to > i else (*hyp[i : i + n], *hyp[to:i])
            state = states[first]
            for x in part:
                state = step(x, *state)
            cost = known.get((end, state))
            if cost is None:  # where two shifts meet again, so do their ends
                ended = state
                for x in hyp[end:]:
                    ended = step(x, *ended)
                cost = known[end, state] = ended[2]
            if cost + 1 < best and (found is None or (cost, at) < found[:2]):
                found = cost, at, [*hyp[:first], *part, *hyp[end:]]
        if found is None:
            break
        hyp = found[2]
        shifts += 1
    return best + shifts


def word_diff(ref: str, pred: str) -> list[str]:
    """Edit script over words: tag, words of ref, words of pred, each tab-joined."""
    a, b = ref.split(), pred.split()
    codes = difflib.SequenceMatcher(None, a, b, autojunk=False).get_opcodes()
    return ["\t".join((tag, " ".join(a[i:j]), " ".join(b[k:m]))) for tag, i, j, k, m in codes]


def common_length(a: list, b: list) -> int:
    """Length of the longest common subsequence of two token lists, by bit vectors (Crochemore et al., 2001)."""
    places: dict = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << i
    full = row = (1 << len(a)) - 1
    for y in b:
        met = row & places.get(y, 0)
        row = (row + met | row - met) & full
    return len(a) - row.bit_count()


def without_parens(text: str, left: str = "(", right: str = ")") -> str:
    """Text outside balanced brackets (C11). Brackets are counted from the right; what the last of them leaves open stays."""
    depth, run, marks = 0, 0, []
    for c in reversed(text):
        was, depth = depth, max(0, depth + (c == right) - (c == left))
        marks.append((run, was > 0 or depth > 0))
        run += was > 0 and depth == 0
    kept = [c for c, (k, inside) in zip(text, reversed(marks), strict=True) if not inside or (k == run and depth)]
    return "".join(kept)


def gloss_list(text: str) -> list[str]:
    """Glosses of a list in one cell (C11): of a cell that begins with square brackets their content; question marks, brackets
    of both kinds with what is in them, and numbering at the end go; the rest is split, each gloss once."""
    if head := re.match(r"\[(.+?)\]", text):
        text = head[1]
    plain = without_parens(" ".join(without_parens(text.replace("?", "").strip()).split()), "[", "]")
    parts = (p.strip() for p in re.split("[;,/]", re.sub(r"\s+\d+(\.\d+)*$", "", plain)))
    return list(dict.fromkeys(p for p in parts if p))


def grow_diag_final(forward: set[tuple[int, int]], backward: set[tuple[int, int]], both: bool = True) -> list[tuple[int, int]]:
    """Symmetrised links (Koehn et al., 2003): grown from the intersection over neighbours in the union, then links
    of words still free (both sides with `both`, else either)."""
    links, union = forward & backward, forward | backward
    rows, columns = {i for i, _ in links}, {j for _, j in links}

    def add(i: int, j: int) -> None:
        links.add((i, j))
        rows.add(i)
        columns.add(j)

    near = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1) if a or b]
    grown = True
    while grown:
        grown = False
        for i, j in sorted(links):
            for a, b in near:
                new = (i + a, j + b)
                if new in union and new not in links and (new[0] not in rows or new[1] not in columns):
                    add(*new)
                    grown = True
    for side in (forward, backward):
        for i, j in sorted(side):
            free = (i not in rows, j not in columns)
            if all(free) if both else any(free):
                add(i, j)
    return sorted(links)


def overlap_depths(s: list, t: list) -> tuple[list[float], list[float]]:
    """Agreement A(d) and overlap X(d) of two ranked lists whose items are names or sets of tied names."""
    as_set = lambda x: {x} if isinstance(x, str) else set(x)
    agree, shared, a, b = [], [], set(), set()
    for d in range(max(len(s), len(t))):
        a |= as_set(s[d]) if d < len(s) else set()
        b |= as_set(t[d]) if d < len(t) else set()
        agree.append(2 * len(a & b) / (len(a) + len(b)))
        shared.append(agree[-1] * min(d + 1, len(s), len(t)))
    return agree, shared


def rbo_ext(s: list, t: list, p: float = 0.9) -> float:
    """Extrapolated rank-biased overlap (Webber et al., 2010), tied items as sets."""
    short, long = sorted((len(s), len(t)))
    if not long:
        return 1.0
    if not short:
        return 0.0
    agree, shared = overlap_depths(s, t)
    total = sum(p**d * agree[d - 1] for d in range(1, long + 1))
    total += sum(p**d * shared[short - 1] * (d - short) / (short * d) for d in range(short + 1, long + 1))
    tail = (shared[long - 1] - shared[short - 1]) / long + shared[short - 1] / short
    return (1 - p) / p * total + p**long * tail


def warnings_of(rules: dict[str, str]):
    """The Arrow UDF of normaliser_warnings for these rules."""
    found = T.StructType([T.StructField("code", T.StringType()), T.StructField("pos", T.IntegerType()), T.StructField("slice", T.StringType())])
    return mapped(lambda text: normaliser_warnings(text, rules), T.ArrayType(found))


nfc = mapped(nfc_text, T.StringType())
details = mapped(unicode_details, T.StringType())
token_edits = mapped(lambda a, b: edit_counts(list(a), list(b), True), T.LongType())
jaro = mapped(lambda a, b: jaro_similarity(list(a), list(b)), T.DoubleType())
ter_edit_count = mapped(lambda a, b: ter_edits(list(a), list(b)), T.LongType())
diff = mapped(word_diff, T.ArrayType(T.StringType()))
common_subsequence = mapped(lambda a, b: common_length(list(a), list(b)), T.LongType())
glosses = mapped(gloss_list, T.ArrayType(T.StringType()))
rbo = mapped(lambda s, t: rbo_ext([list(x) for x in s], [list(x) for x in t]), T.DoubleType())


def grown_links(forward: list[dict], backward: list[dict]) -> list[dict]:
    links = lambda x: {(r["i"], r["j"]) for r in x}
    return [{"i": i, "j": j} for i, j in grow_diag_final(links(forward), links(backward))]


grow_diag = mapped(grown_links, T.ArrayType(T.StructType([T.StructField("i", T.IntegerType()), T.StructField("j", T.IntegerType())])))


#: Names under which `register` makes the functions known to SQL; others may be added.
SQL_NAMES = {
    "lw_nfc": nfc,
    "lw_unicode_details": details,
    "lw_token_edits": token_edits,
    "lw_jaro": jaro,
    "lw_ter_edits": ter_edit_count,
    "lw_word_diff": diff,
    "lw_common_subsequence": common_subsequence,
    "lw_glosses": glosses,
    "lw_rank_biased_overlap": rbo,
}


def register(spark) -> None:
    """Make the functions known to spark.sql."""
    for name, function in SQL_NAMES.items():
        spark.udf.register(name, function)
