"""TER passes over shifts that cannot be the best, by bounds that hold."""

import random

from lineweave.functions import udfs as U


def test_bounds_hold_for_every_shift():
    draw, cut = random.Random(7), 0
    for _ in range(150):
        hyp, ref = ([draw.choice("abcdef") for _ in range(draw.randrange(1, 11))] for _ in range(2))
        bounds, best = U.Bounds(hyp, ref, 10), U.quick_edits(hyp, ref)
        places = {w: [j for j, x in enumerate(ref) if x == w] for w in ref}
        for i in range(len(hyp)):
            for j in range(len(ref)):
                n = 0
                while i != j and i + n < len(hyp) and j + n < len(ref) and hyp[i + n] == ref[j + n]:
                    n += 1
                    rest = hyp[:i] + hyp[i + n :]
                    to = min(j, len(hyp) - n)
                    cost = U.quick_edits(rest[:to] + hyp[i : i + n] + rest[to:], ref)
                    assert bounds.out[n - 1][i] <= cost
                    if n == 1 and j < len(hyp):
                        put = min(bounds.put(hyp[i], j + 1 if j > i else j, places[hyp[i]]), best - 1)
                        assert put <= cost
                        cut += max(put, bounds.out[0][i]) >= best - 1
    assert cut > 400
