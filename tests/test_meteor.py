"""METEOR's matchings have the fewest chunks there are, however many words repeat."""

import random

from lineweave.functions import meteor as E


def chunks(found):
    return sum(found.get(i - 1, -2) != j - 1 for i, j in found.items())


def test_no_better_matching_is_missed():
    draw, missed = random.Random(4), 0
    for k in range(300):
        words = [f"w{n}" for n in range(2 + k % 5)]
        hyp, ref = ([draw.choice(words) for _ in range(draw.randrange(9))] for _ in range(2))
        given = {draw.randrange(len(hyp)): draw.randrange(len(ref))} if hyp and ref and k % 3 == 0 else {}
        found = E.matching(hyp, ref, given)
        assert found == E.matching(hyp, ref, given, beam=1 << 20)  # follows all of them
        missed += chunks(E.matching(hyp, ref, given, beam=2)) > chunks(found)
    assert missed > 10
    # more ways than a beam of 40 can hold
    names = [f"w{n}" for n in range(12)]
    ref = [w for n in names for w in (n, "de")] + ["end"]
    hyp = [w for n in reversed(names) for w in ("de", n)] + ["de", "end"]
    found = E.matching(hyp, ref, {})
    assert len(found) == 25 and chunks(found) <= chunks(E.matching(hyp, ref, {}, beam=40))
    same = ["a"] * 40
    assert chunks(E.matching(same, same[1:], {})) == 1


def test_drafts_of_long_replies_have_fewer_chunks_than_a_beam_finds():
    draw, fewer = random.Random(8), 0
    words = [f"w{n}" for n in range(30)]
    for _ in range(30):
        ref = [draw.choice(words) for _ in range(60)]
        hyp = [w for w in ref[30:] + ref[:30] if draw.random() < 0.8]
        found, beam = E.matching(hyp, ref, {}), E.matching(hyp, ref, {}, beam=40)
        assert len(found) == len(beam) == len(hyp) and chunks(found) <= chunks(beam)
        fewer += chunks(found) < chunks(beam)
    assert fewer > 0


def test_query_has_the_mean_of_each_conversation(spark):
    from lineweave.plans.metric_queries import meteor

    rows = meteor(spark, "/root/testdata/sf0.001").collect()
    by = {}
    for r in rows:
        by.setdefault(r.conv_id, []).append(r)
    assert any(len(x) > 1 for x in by.values())
    assert all(abs(sum(r.meteor for r in x) / len(x) - r.conv_meteor) < 2e-6 for x in by.values() for r in x)
