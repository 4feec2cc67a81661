"""Conversation repair against every edit sequence, and against a plain dynamic programme on long conversations."""

import hashlib
import heapq
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from lineweave.llm import repair as rep

SCHEMA = "conv_id long, turn long, role string, text string, edit int"
PATTERN = re.compile(r"(s?(ua)+)?")


def plain(rows):
    """The contract on the rows of one conversation (sorted): counts, cost, audit, digest."""
    seen, faults = set(), []
    for role, text in rows:
        if not text.strip(" \t\n\x0b\x0c\r"):
            faults.append("blank")
        elif (role, text) in seen:
            faults.append("duplicate")
        else:
            faults.append("" if text.rstrip(" \t\n\x0b\x0c\r")[-1] in ".!?" else "truncated")
        seen.add((role, text))
    initials = [r[:1] for r, _ in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    return faults, illegal


def exhaustive(rows, faults):
    """Best-first over all edit sequences by (cost, audit): the first whole one that fits the pattern."""
    heap = [(0, "", 0, "", ())]
    while heap:
        cost, audit, i, made, told = heapq.heappop(heap)
        if i == len(rows) and PATTERN.fullmatch(made):
            return cost, audit, told
        if len(made) < 2 * len(rows) + 3:
            heapq.heappush(heap, (cost + 3, audit + "I", i, made + "u", (*told, "user:")))
            heapq.heappush(heap, (cost + 3, audit + "I", i, made + "a", (*told, "assistant:")))
        if i < len(rows):
            role, text = rows[i]
            heapq.heappush(heap, (cost + 4, audit + "D", i + 1, made, told))
            if faults[i] in ("", "truncated"):
                more = cost + 3 * (faults[i] == "truncated")
                heapq.heappush(heap, (more, audit + "K", i + 1, made + (role[:1] or "-"), (*told, f"{role}:{text}")))
                for name in ("user", "assistant"):
                    heapq.heappush(heap, (more + 3, audit + "R", i + 1, made + name[0], (*told, f"{name}:{text}")))


def programme(rows, faults):
    """The same by a table of (cost, audit) for each state, audits as whole strings."""
    to = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}
    now = {0: (0, "")}

    def inserted(now):
        for _ in range(2):
            for (s, r), t in to.items():
                if r != "s" and s in now:
                    now[t] = min(now.get(t, (1 << 60, "")), (now[s][0] + 3, now[s][1] + "I"))
        return now

    for (role, _), fault in zip(rows, faults, strict=True):
        new = {}
        for s, (cost, audit) in inserted(now).items():
            offers = [(s, cost + 4, "D")]
            if fault in ("", "truncated"):
                more = 3 * (fault == "truncated")
                offers += [(t, cost + more, "K") for (a, r), t in to.items() if a == s and r == role[:1]]
                offers += [(t, cost + more + 3, "R") for (a, r), t in to.items() if a == s and r != "s"]
            for t, c, letter in offers:
                new[t] = min(new.get(t, (1 << 60, "")), (c, audit + letter))
        now = new
    return min(x for s, x in inserted(now).items() if s in (0, 3))


def digest(lines):
    return hashlib.sha256("\n".join(lines).encode()).hexdigest()


ROLES = ["user", "assistant", "user", "assistant", "system", "tool", "", "ua"]
TEXTS = ["Yes.", "No!", "cut", " \t", "", "Why?\n", "1.", "É"]


def test_small_conversations_equal_exhaustive_search(spark):
    draw = random.Random(6)
    rows, want = [], []
    for conv in range(120):
        own = [(turn, draw.choice(ROLES), draw.choice(TEXTS)) for turn in range(draw.randrange(1, 5))]
        rows += [(conv, turn, role, text, 9) for turn, role, text in own]
        said = [(r, t) for _, r, t in own]
        faults, illegal = plain(said)
        cost, audit, told = exhaustive(said, faults)
        want.append((conv, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, cost, audit, digest(told)))
    found, turns = rep.repair(spark.createDataFrame(rows, SCHEMA))
    assert turns.columns == ["conv_id", "place", "edit", "role", "text"]
    out = found.join(rep.digests(turns), "conv_id", "left").fillna(digest([]), ["repaired_sha256"])
    assert sorted(map(tuple, out.collect())) == want


@pytest.mark.parametrize("chunk", [3, 4096])
def test_a_conversation_over_many_ranges(spark, monkeypatch, chunk):
    monkeypatch.setattr(rep, "CHUNK", chunk)
    monkeypatch.setattr(rep, "FAN", 2)
    draw = random.Random(chunk)
    own = [(turn, draw.choice(ROLES[:5]), draw.choice([f"{turn}.", f"{turn}", "", "Same."])) for turn in range(400)]
    rows = [(7, *x, 0) for x in own] + [(7, 500, "user", "often", 0)] * 20 + [(8, 1, "user", "Alone.", 0), (6, None, "assistant", None, 0)]
    found, turns = rep.repair(spark.createDataFrame(rows, SCHEMA).repartition(3))
    got = {r.conv_id: r for r in found.collect()}
    said = [(r, t) for _, r, t in own] + [("user", "often")] * 20
    faults, illegal = plain(said)
    assert (got[7].cost, got[7].audit) == programme(said, faults)
    assert (got[7].blank, got[7].duplicate, got[7].truncated, got[7].illegal) == (*(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal)
    assert (got[8].audit, got[6].audit, got[6].blank) == ("KI", "D", 1)
    left = [r for r in turns.orderBy("place").collect() if r.conv_id == 7]
    assert PATTERN.fullmatch("".join(r.role[:1] for r in left)) and [r.place for r in left] == list(range(len(left)))
    assert "".join(r.edit for r in left) == got[7].audit.replace("D", "")
    kept = iter(left)
    at = 0
    for letter in got[7].audit:
        r = next(kept) if letter != "D" else None
        if letter == "I":
            assert r.text == ""
            continue
        assert r is None or r.text == said[at][1]
        at += 1


def test_damage_and_report(spark):
    draw = random.Random(1)
    rows = [(c, t, draw.choice(["user", "assistant", None]), draw.choice(["Fine. Yes!", None, "Hm?"]), 1) for c in range(40) for t in (*range(draw.randrange(6)), None)]
    rows += [(None, 3, "user", "No id.", 1), (None, None, "assistant", "No id!", 1)]
    want = {c: [] for c, *_ in rows}
    for c, t, role, text, _ in rows:
        role, text = role or " ", text or " "
        hit = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        if hit:
            text = "" if hit == 1 else re.sub("[.!?]", "", text) if hit == 2 else text
            want[c] += [(t, "user" if hit == 4 else role, text)] * (2 if hit == 3 else 1)
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r.conv_id: r for r in rep.conversation_report(df, rep.damaged(df)).collect()}
    assert got.keys() == want.keys()
    for c, own in want.items():
        own.sort(key=lambda x: (x[0] is not None, x[0] or 0))
        said = [(r, t) for _, r, t in own]
        faults, illegal = plain(said)
        turns = {t for t, *_ in own if t is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        cost, audit, told = exhaustive(said, faults)
        assert tuple(got[c])[1:] == (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, digest(told))


def test_audits_compare_like_strings(monkeypatch):
    for prime in ((1 << 61) - 1, 5):  # with so small a prime nearly all hashes collide
        monkeypatch.setattr(rep, "PRIME", prime)
        draw, tree, nodes = random.Random(2), rep.Audits(), [0]
        for _ in range(300):
            node = draw.choice(nodes[-20:])
            for letter in draw.choices("DIKR", [1, 1, 8, 1], k=draw.randrange(4)):
                node = tree.add(node, letter)
            nodes.append(node)
        for _ in range(3000):
            a, b = draw.choice(nodes), draw.choice(nodes)
            assert tree.less(a, b) == (tree.text(a) < tree.text(b))


def test_stretches_join_to_the_whole():
    draw = random.Random(4)
    rows = [(draw.choice("uasx"), draw.choice([1, 1, 2]), draw.random() < 0.1, draw.random() < 0.1, draw.random() < 0.3) for _ in range(40)]
    whole = rep.spans(rows)
    assert rep.joined(rep.joined(rep.spans(rows[:11]), rep.spans(rows[11:12])), rep.spans(rows[12:])) == whole


def test_empty_table_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, 1, "user", "Hm.", 5)], SCHEMA)
    assert rep.conversation_report(df.limit(0), rep.damaged(df.limit(0))).count() == 0
    odd = df.withColumns({c: F.lit(1) for c in ("h1", "copies", "blank", "at", "k", "of", "audit")})
    found, turns = rep.repair(odd)
    assert found.first().audit == "KI" and turns.count() == 2
    lost = rep.conversation_report(df, df.limit(0)).first()
    assert tuple(lost) == (1, 0, 0, 0, 0, 0, 0, "", digest([]))
