"""METEOR with its exact and stem stages (E06), after Banerjee and Lavie (2005) and Denkowski and Lavie (2014)."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lineweave.functions.udfs import mapped

#: Weights of recall, of broken order and its power.
ALPHA, GAMMA, BETA = 0.9, 0.5, 3.0


class Bonds:
    """Places where two neighbours of hyp may meet two neighbours of ref, as bits of a set: (i, j) stands for i with j and i + 1 with j + 1.
    A matching has as many chunks as words less bonds, and bonds that agree on every word can all be had: so the fewest chunks
    are the largest set of bonds without two that exclude each other. Bonds that share no word fall into parts by themselves."""

    def __init__(self, hyp: list[str], ref: list[str], given: dict[int, int], free: dict[str, list[int]]) -> None:
        taken = set(given.values())
        meets = lambda i, j: given[i] == j if i in given else j not in taken and hyp[i] == ref[j]
        found = [(i, j) for i in range(len(hyp) - 1) for j in ((given[i],) if i in given else free.get(hyp[i], ())) if j + 1 < len(ref) and meets(i + 1, j + 1)]
        self.bit = {at: 1 << k for k, at in enumerate(found)}
        self.left, self.right = [0] * (len(hyp) + 1), [0] * (len(ref) + 1)  # the bonds from each place on
        for (i, j), bit in self.bit.items():
            self.left[i] |= bit
            self.right[j] |= bit
        self.all, self.known = (1 << len(found)) - 1, {}
        self.apart = [self.against(i, j) | self.against(i + 1, j + 1) for i, j in found]
        self.runs = [0] * len(found)  # how far each one's diagonal goes on
        for k in range(len(found) - 1, -1, -1):
            i, j = found[k]
            self.runs[k] = 1 + (self.runs[after.bit_length() - 1] if (after := self.bit.get((i + 1, j + 1), 0)) else 0)
        self.found, self.words = found, list(zip(hyp, hyp[1:]))

    def of(self, i: int) -> int:
        """The bonds of place i of hyp."""
        return self.left[i] | (self.left[i - 1] if i else 0)

    def against(self, i: int, j: int) -> int:
        """The bonds that i with j excludes."""
        return (self.of(i) | self.right[j] | (self.right[j - 1] if j else 0)) & ~(self.bit.get((i, j), 0) | self.bit.get((i - 1, j - 1), 0))

    def near(self, some: int, whole: int) -> int:
        """The parts of whole that some lie in."""
        out, new = 0, some
        while new:
            out |= new
            grown = 0
            for k in bits(new):
                grown |= self.apart[k]
            new = grown & whole & ~out
        return out

    def most(self, whole: int) -> int:
        """A largest set without two that exclude each other."""
        out = 0
        while whole:
            low = whole & -whole
            part = self.near(low, whole)
            whole &= ~part
            out |= low if part == low else self.most_of(part)
        return out

    def most_of(self, part: int) -> int:
        """`most` of a part that hangs together."""
        if part not in self.known:
            members = list(bits(part))
            limit = self.limit(members)
            # long diagonals first: often this is all that there can be
            rest, best = part, 0
            for k in sorted(members, key=lambda k: (-self.runs[k], k)):
                while rest >> k & 1:  # a diagonal as a whole
                    rest &= ~(self.apart[k] | 1 << k)
                    best |= 1 << k
                    i, j = self.found[k]
                    after = self.bit.get((i + 1, j + 1), 0)
                    k = after.bit_length() - 1 if after else k
            if best.bit_count() < limit:
                degrees = [((self.apart[k] & part).bit_count(), k) for k in members]
                (least, k), (_, widest) = min(degrees), max(degrees)
                k = k if least == 1 else widest  # a largest set has one that excludes but one other
                best = max(best, 1 << k | self.most(part & ~(self.apart[k] | 1 << k)), key=int.bit_count)
                without = part & ~(1 << k)
                if least > 1 and best.bit_count() < min(limit, self.limit(list(bits(without)))):
                    best = max(best, self.most(without), key=int.bit_count)
            self.known[part] = best
        return self.known[part]

    def limit(self, members: list[int]) -> int:
        """No set is larger: each place has one bond, and neighbours meet the like alone."""
        kinds: dict[tuple[str, str], tuple[set[int], set[int]]] = {}
        for k in members:
            i, j = self.found[k]
            left, right = kinds.setdefault(self.words[i], (set(), set()))
            left.add(i)
            right.add(j)
        return sum(min(len(left), len(right)) for left, right in kinds.values())

    def without(self, whole: int, held: int, less: int) -> int | None:
        """A largest set of whole, of which held is one, without those of less; none if all such sets have some."""
        if not held & less:
            return held
        part = self.near(held & less, whole)
        other = self.most(part & ~less)
        return held & ~part | other if other.bit_count() == (held & part).bit_count() else None


def bits(some: int) -> Iterator[int]:
    while some:
        low = some & -some
        yield low.bit_length() - 1
        some ^= low


def matching(hyp: list[str], ref: list[str], given: dict[int, int], beam: int | None = None) -> dict[int, int]:
    """One-to-one places (hyp to ref) of equal words, added to those given: as many as there can be, in the fewest chunks (runs
    that follow each other on both sides), of equal ones the least places, where a word that is left out comes before all. With
    a beam only so many partial matchings are followed, and with many repeated words one in fewer chunks may be missed."""
    if beam:
        return followed(hyp, ref, given, beam)
    taken, free, spare = set(given.values()), {}, Counter(w for i, w in enumerate(hyp) if i not in given)
    for j, w in enumerate(ref):
        if j not in taken:
            free.setdefault(w, []).append(j)
    for w, n in spare.items():
        spare[w] = max(n - len(free.get(w, ())), 0)
    bonds, out = Bonds(hyp, ref, given, free), dict(given)
    whole, held = bonds.all, bonds.most(bonds.all)
    for i, w in enumerate(hyp):
        if i in given:
            continue
        for j in [-1] * (spare[w] > 0) + free.get(w, []):
            less = bonds.of(i) if j < 0 else bonds.against(i, j)
            if (other := bonds.without(whole, held, less)) is not None:
                whole, held = whole & ~less, other
                if j < 0:
                    spare[w] -= 1
                else:
                    free[w].remove(j)
                    out[i] = j
                break
    return dict(sorted(out.items()))


def followed(hyp: list[str], ref: list[str], given: dict[int, int], beam: int) -> dict[int, int]:
    """`matching` by a beam of partial matchings that goes along hyp."""
    taken, free_ref = set(given.values()), {}
    for j, w in enumerate(ref):
        if j not in taken:
            free_ref.setdefault(w, []).append(j)
    mask_of = {w: sum(1 << j for j in js) for w, js in free_ref.items()}
    later = Counter(w for i, w in enumerate(hyp) if i not in given)
    need = {w: min(n, len(free_ref.get(w, ()))) for w, n in later.items()}
    none = 1 << len(ref)  # the mark of a state that has left a word out
    # chunks, rank among the states by their places, places taken (bits), place of the last word (-1: none), and the way there
    states: list[tuple[int, int, int, int, tuple | None]] = [(0, 0, 0, -1, None)]
    for i, w in enumerate(hyp):
        fixed = given.get(i)
        if fixed is None:
            later[w] -= 1
        own_mask, own_places, wanted, left = mask_of.get(w, 0), free_ref.get(w, ()), need.get(w, 0), later[w]
        grown: dict[tuple[int, int], tuple] = {}
        for chunks, rank, mask, last, way in states:
            if fixed is not None:
                options = [fixed]
            else:
                own = (mask & own_mask).bit_count()
                options = [j for j in own_places if not mask >> j & 1] if own < wanted else []
                if own + left >= wanted:
                    options.append(-1)
            for j in options:
                now, met = (mask | none, chunks) if j < 0 else (mask | 1 << j, chunks + (last < 0 or j != last + 1))
                before = grown.get((now, j))
                if before is None or (met, rank) < before[:2]:
                    grown[now, j] = (met, rank, now, j, way)
        kept = sorted(grown.values(), key=lambda g: (g[0], g[1], g[3]))[:beam]
        ranks = {place: k for k, place in enumerate(sorted((g[1], g[3]) for g in kept))}
        states = [(met, ranks[rank, j], now, j, (j, way)) for met, rank, now, j, way in kept]
    if not states:
        return {}
    way, out = states[0][4], []
    while way is not None:
        out.append(way[0])
        way = way[1]
    return {i: j for i, j in enumerate(reversed(out)) if j >= 0}


def meteor_score(hyp: list[str], ref: list[str], hyp_stems: list[str], ref_stems: list[str]) -> float:
    """Exact matches first, then those of stems among the words left. No match scores 0."""
    found = matching(hyp_stems, ref_stems, matching(hyp, ref, {}))
    if not found:
        return 0.0
    chunks = sum(found.get(i - 1, -2) != j - 1 for i, j in found.items())
    p, r = len(found) / len(hyp), len(found) / len(ref)
    return p * r / (ALPHA * p + (1 - ALPHA) * r) * (1 - GAMMA * (chunks / len(found)) ** BETA)


_score = mapped(lambda h, r, a, b: meteor_score(list(h), list(r), list(a), list(b)), T.DoubleType())


def meteor(hyp: Column, ref: Column, stem=lambda w: F.substring(w, 1, 5)) -> Column:
    """The score of each row's word lists; stem makes a word's stem (its first five letters unless given)."""
    return _score(hyp, ref, F.transform(hyp, stem), F.transform(ref, stem))
