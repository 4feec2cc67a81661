"""Conversation structure repair: the cheapest edits that make turns alternate, told by the least audit string.

A conversation's edits are found by dynamic programming over its rows and four states of the pattern `(s?(ua)+)?`. Each
state keeps its cost and its audit, a node of a persistent tree: audits that begin alike share their nodes. A node has
the hash of its whole string and ancestors at distances of powers of two, so audits of equal cost are compared by
a binary search for their longest common prefix; what equal hashes claim is verified letter by letter back to the
first shared node.

Conversations may hold any share of all rows. Slim rows (no texts) are dealt by ranges of conversation and turn; what
a range or a chunk of CHUNK rows holds of a conversation becomes a table of the cheapest audits from each state to each
state, and tables are joined side by side, FAN at a time. Of audits that lead from one state to another at one
cost none begins another (further letters would have a cost), so the least whole is made of the least parts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lineweave.llm.common import saved, table

BLANKS = " \t\n\x0b\x0c\r"
INSERT, REROLE, DELETE, TRUNCATED = 3, 3, 4, 3
CHUNK, FAN = 4096, 64
#: States: nothing yet, after s, after u, after a. A conversation may end in the first and the last.
STATES, FINAL = range(4), (0, 3)
NEXT = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}
INSERTS = ((0, 2), (1, 2), (3, 2), (2, 3))
#: To end from a state: the letters that insert what is missing.
CLOSING = {0: "", 1: "II", 2: "I", 3: ""}
PRIME, BASE = (1 << 61) - 1, 0x1F3D5B79A2C4E6


class Audits:
    """Strings as nodes of a tree: a parent and a letter each, with hashes and binary-lifting ancestors."""

    def __init__(self) -> None:
        self.letter, self.depth, self.hash, self.up = [""], [0], [0], [[]]

    def add(self, node: int, letter: str) -> int:
        """The node of the string that goes on with this letter."""
        up, at, k = [node], node, 0
        while k < len(self.up[at]):
            at = self.up[at][k]
            up.append(at)
            k += 1
        self.letter.append(letter)
        self.depth.append(self.depth[node] + 1)
        self.hash.append((self.hash[node] * BASE + ord(letter)) % PRIME)
        self.up.append(up)
        return len(self.up) - 1

    def cut(self, node: int, depth: int) -> int:
        """The ancestor at this depth."""
        left = self.depth[node] - depth
        while left:
            k = left.bit_length() - 1
            node = self.up[node][k]
            left -= 1 << k
        return node

    def same(self, a: int, b: int) -> bool:
        """Whether two nodes of one depth have the same string, letter by letter back to a node they share."""
        while a != b:
            if self.letter[a] != self.letter[b]:
                return False
            a, b = self.up[a][0], self.up[b][0]
        return True

    def text(self, node: int) -> str:
        out = []
        while node:
            out.append(self.letter[node])
            node = self.up[node][0]
        return "".join(reversed(out))

    def less(self, a: int, b: int) -> bool:
        """Whether the string of a comes before that of b."""
        if a == b:
            return False
        m = min(self.depth[a], self.depth[b])
        x, y = self.cut(a, m), self.cut(b, m)
        if self.hash[x] == self.hash[y]:
            if self.same(x, y):
                return self.depth[a] < self.depth[b]
            return self.text(a) < self.text(b)  # a collision
        for k in range(len(self.up[x]) - 1, -1, -1):  # up to the first letters that differ
            if k < len(self.up[x]) and self.hash[self.up[x][k]] != self.hash[self.up[y][k]]:
                x, y = self.up[x][k], self.up[y][k]
        if self.letter[x] != self.letter[y] and self.same(self.up[x][0], self.up[y][0]):
            return self.letter[x] < self.letter[y]
        return self.text(a) < self.text(b)  # a collision


def step(audits: Audits, now: list, initial: str, bad: bool, truncated: bool) -> list:
    """The states after one more row. now: for each state None or (cost, node); bad rows must be deleted."""

    def offer(to: list, state: int, cost: int, node: int, letter: str) -> None:
        old = to[state]
        if old is None or cost < old[0]:
            to[state] = (cost, audits.add(node, letter))
        elif cost == old[0]:
            new = audits.add(node, letter)
            if audits.less(new, old[1]):
                to[state] = (cost, new)

    out: list = [None] * 4
    if bad:  # inserting before a deletion is never the least: D comes before I
        for s in STATES:
            if now[s]:
                offer(out, s, now[s][0] + DELETE, now[s][1], "D")
        return out
    now = list(now)
    for s, t in INSERTS:
        if now[s]:
            offer(now, t, now[s][0] + INSERT, now[s][1], "I")
    fault = TRUNCATED if truncated else 0
    for s in STATES:
        if not now[s]:
            continue
        cost, node = now[s]
        offer(out, s, cost + DELETE, node, "D")
        if s in NEXT.get(initial, ()):
            offer(out, NEXT[initial][s], cost + fault, node, "K")
        for r in "ua":
            if s in NEXT[r]:
                offer(out, NEXT[r][s], cost + REROLE + fault, node, "R")
    return out


def spans(rows: list[tuple[str, int, bool, bool, bool]]) -> list[list]:
    """paths[s][t]: the cheapest (cost, audit) that leads from state s to t over these rows, None if there is none.

    rows: (role initial, copies, blank, duplicate, truncated); copies behind the first are duplicates.
    """
    out = []
    for s in STATES:
        audits = Audits()
        now: list = [None] * 4
        now[s] = (0, 0)
        for initial, copies, blank, duplicate, truncated in rows:
            now = step(audits, now, initial, blank or duplicate, truncated)
            for _ in range(copies - 1):
                now = step(audits, now, initial, True, False)
        out.append([x and (x[0], audits.text(x[1])) for x in now])
    return out


def joined(a: list, b: list) -> list:
    """The paths over two stretches, one behind the other."""
    return [[min(((a[s][m][0] + b[m][t][0], a[s][m][1] + b[m][t][1]) for m in STATES if a[s][m] and b[m][t]), default=None) for t in STATES] for s in STATES]


def ended(paths: list) -> tuple[int, str]:
    """The cheapest cost and its least audit of a whole conversation."""
    return min((x[0] + INSERT * len(CLOSING[t]), x[1] + CLOSING[t]) for t, x in enumerate(paths[0]) if x)


def damaged(rows: DataFrame) -> DataFrame:
    """conversations as the operator's test bed damages them, by crc32(`conv_id:turn`) % 20 (nulls: one space):
    0 drops the row, 1 empties its text, 2 takes `[.!?]` out of it, 3 repeats the row, 4 sets the role user."""
    told = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    hit = F.pmod(F.crc32(F.concat(told("conv_id"), F.lit(":"), told("turn")).cast("binary")), F.lit(20))
    rows = rows.select("conv_id", "turn", told("role").alias("role"), told("text").alias("text"), hit.alias("hit")).filter("hit <> 0")
    text = F.when(F.col("hit") == 1, "").when(F.col("hit") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("hit") == 4, "user").otherwise(F.col("role"))
    copies = F.when(F.col("hit") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(copies).alias("copy")).drop("copy")


KEYS = ["turn", "role", "h1", "h2"]


def judged(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, turn, role, h1, h2, text, copies): equal rows of a turn once, with their number; and, with their faults
    in the place of texts, (conv_id, turn, role, h1, h2, copies, blank, truncated, duplicate). The two 64-bit hashes stand
    for the text; a row is a duplicate if its role and text were seen in an earlier turn."""
    one = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), one("role").alias("role"), one("text").alias("text"))
    rows = rows.withColumns({"h1": F.xxhash64("text"), "h2": F.xxhash64(F.lit(0x2545F4914F6CDD1D), "text")})
    rows = saved(rows.groupBy("conv_id", *KEYS).agg(F.any_value("text").alias("text"), F.count("*").alias("copies")), "turns")
    place = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    seen = rows.groupBy("conv_id", "role", "h1", "h2").agg(F.min(place).alias("first"), F.count("*").alias("n")).filter("n > 1")
    seen = seen.select("conv_id", "role", "h1", "h2", F.struct(F.col("first.turn").alias("turn")).alias("first")).alias("seen")
    end = F.rtrim(F.col("text"), F.lit(BLANKS))
    slim = rows.select("conv_id", *KEYS, "copies", (end == "").alias("blank"), (~F.right(end, F.lit(1)).isin(".", "!", "?")).alias("truncated")).alias("slim")
    on = F.col("slim.conv_id").eqNullSafe(F.col("seen.conv_id"))
    for c in ("role", "h1", "h2"):
        on &= F.col(f"slim.{c}") == F.col(f"seen.{c}")
    again = F.col("first").isNotNull() & ~F.col("slim.turn").eqNullSafe(F.col("first.turn"))
    slim = slim.join(seen, on, "left").select("slim.*", again.alias("duplicate"))
    return rows, slim


PATHS = "array<struct<cost: long, audit: string>>"
PART = f"conv_id long, at struct<known: boolean, turn: long, role: string, h1: long, h2: long, nth: long>, blank long, duplicate long, truncated long, illegal long, first string, last string, paths {PATHS}"


def legal(a: str, b: str) -> bool:
    return a + b in ("su", "ua", "au")


def flat(paths: list) -> list:
    return [x and {"cost": x[0], "audit": x[1]} for row in paths for x in row]


def square(paths: list) -> list:
    cells = [x and (x["cost"], x["audit"]) for x in paths]
    return [cells[4 * s : 4 * s + 4] for s in STATES]


def chunk_rows(rows: list[dict], nth: int) -> dict:
    """What some rows of a conversation, one behind the other, come to."""
    each, sums, illegal = [], [0, 0, 0], 0
    for k, r in enumerate(rows):
        initial, n = r["role"][:1], r["copies"]
        if r["blank"]:
            sums[0] += n
        elif r["duplicate"]:
            sums[1] += n
        else:
            sums[1] += n - 1
            sums[2] += r["truncated"]
        illegal += (n - 1) * (not legal(initial, initial)) + (k > 0 and not legal(rows[k - 1]["role"][:1], initial))
        each.append((initial, n, r["blank"], r["duplicate"], r["truncated"]))
    if len(rows) == 1 and rows[0]["copies"] > CHUNK and (rows[0]["blank"] or rows[0]["duplicate"]):
        n = rows[0]["copies"]  # all of them go
        paths = [[(DELETE * n, "D" * n) if s == t else None for t in STATES] for s in STATES]
    else:
        paths = spans(each)
    at = {"known": rows[0]["turn"] is not None} | {k: rows[0][k] for k in KEYS} | {"nth": nth}
    return {"conv_id": rows[0]["conv_id"], "at": at, "blank": sums[0], "duplicate": sums[1], "truncated": sums[2], "illegal": illegal, "first": rows[0]["role"][:1], "last": rows[-1]["role"][:1], "paths": flat(paths)}


def both(a: dict, b: dict) -> dict:
    """Two stretches of a conversation as one."""
    out = {k: a[k] + b[k] for k in ("blank", "duplicate", "truncated", "illegal")}
    out["illegal"] += not legal(a["last"], b["first"])
    return {"conv_id": a["conv_id"], "at": a["at"], "first": a["first"], "last": b["last"], "paths": flat(joined(square(a["paths"]), square(b["paths"])))} | out


def batches_of(rows: Iterable[dict], schema: pa.Schema, size: int = 512) -> Iterator[pa.RecordBatch]:
    held = []
    for r in rows:
        held.append(r)
        if len(held) >= size:
            yield pa.RecordBatch.from_pylist(held, schema)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for lo in range(0, batch.num_rows, 1024):
            yield from batch.slice(lo, 1024).to_pylist()


def part_schema() -> pa.Schema:
    at = pa.struct([("known", pa.bool_()), ("turn", pa.int64()), ("role", pa.string()), ("h1", pa.int64()), ("h2", pa.int64()), ("nth", pa.int64())])
    paths = pa.list_(pa.struct([("cost", pa.int64()), ("audit", pa.string())]))
    counts = [(c, pa.int64()) for c in ("blank", "duplicate", "truncated", "illegal")]
    return pa.schema([("conv_id", pa.int64()), ("at", at), *counts, ("first", pa.string()), ("last", pa.string()), ("paths", paths)])


def stretches(rows: Iterable[dict], size: int) -> Iterator[dict]:
    """The sorted rows of many conversations, cut where a conversation ends and at about `size` rows."""
    held, n, nth = [], 0, 0
    for r in rows:
        if held and held[0]["conv_id"] != r["conv_id"]:
            yield chunk_rows(held, nth)
            held, n = [], 0
        if r["copies"] > size:  # the first copy stays with its neighbours, the rest is a stretch of its own
            yield from (chunk_rows(x, nth + k) for k, x in enumerate([[*held, r | {"copies": 1}], [r | {"copies": r["copies"] - 1, "duplicate": True}]]))
            held, n, nth = [], 0, nth + 2
            continue
        held.append(r)
        n += r["copies"]
        if n >= size:
            yield chunk_rows(held, nth)
            held, n, nth = [], 0, nth + 1
    if held:
        yield chunk_rows(held, nth)


def audits(slim: DataFrame) -> DataFrame:
    """(conv_id, blank, duplicate, truncated, illegal, cost, audit) of each conversation of `judged` rows."""
    size = CHUNK

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from batches_of(stretches(rows_of(batches), size), part_schema())

    n = int(slim.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = slim.select("conv_id", *KEYS, "copies", "blank", "truncated", "duplicate").repartitionByRange(n, "conv_id", *KEYS).sortWithinPartitions("conv_id", *KEYS)
    parts, fan = saved(dealt.mapInArrow(cut, PART), "stretches"), FAN
    many = parts.groupBy("conv_id").agg(F.count("*").alias("n")).filter("n > 1")
    ids = parts.join(many.select(F.col("conv_id").alias("of")), F.col("conv_id").eqNullSafe(F.col("of")), "left_semi")
    alone = parts.join(many.select(F.col("conv_id").alias("of")), F.col("conv_id").eqNullSafe(F.col("of")), "left_anti")
    place = ids.select("conv_id", "at").withColumn("k", F.row_number().over(Window.partitionBy("conv_id").orderBy("at")) - 1)  # no audits here
    place = place.select(F.col("conv_id").alias("of"), F.col("at").alias("there"), "k")
    cut_up = saved(ids.join(place, F.col("conv_id").eqNullSafe(F.col("of")) & F.col("at").eqNullSafe(F.col("there"))).drop("of", "there"), "places")

    def join_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def run() -> Iterator[dict]:
            now = None
            for r in rows_of(batches):
                k = r.pop("k") // fan
                if now and (now[0]["conv_id"], now[1]) == (r["conv_id"], k):
                    now = (both(now[0], r), k)
                    continue
                if now:
                    yield now[0] | {"k": now[1]}
                now = (r, k)
            if now:
                yield now[0] | {"k": now[1]}

        yield from batches_of(run(), part_schema().append(pa.field("k", pa.int32())), 16)

    most = cut_up.agg(F.max("k")).first()[0]
    while most:
        cut_up = saved(cut_up.repartition("conv_id", F.floor(F.col("k") / fan)).sortWithinPartitions("conv_id", "k").mapInArrow(join_up, f"{PART}, k int"), "places")
        most //= fan

    def end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = ("conv_id", "blank", "duplicate", "truncated", "illegal")
        schema = pa.schema([*((c, pa.int64()) for c in kept), ("cost", pa.int64()), ("audit", pa.string())])
        done = ({c: r[c] for c in kept} | dict(zip(("cost", "audit"), ended(square(r["paths"])), strict=True)) for r in rows_of(batches))
        yield from batches_of(done, schema)

    whole = alone.unionByName(cut_up.drop("k"))
    return whole.mapInArrow(end, "conv_id long, blank long, duplicate long, truncated long, illegal long, cost long, audit string")


def repaired(rows: DataFrame, audits: DataFrame) -> DataFrame:
    """(conv_id, place, edit, role, text): the turns that each audit leaves of its `judged` rows, in order.

    A conversation's rows stream past its audit; nothing but the audit is held.
    """
    told = audits.select("conv_id", F.lit(0).alias("kind"), *(F.lit(None).cast(t).alias(c) for c, t in zip(KEYS, ("long", "string", "long", "long"), strict=True)), F.col("audit").alias("text"), F.lit(0).cast("long").alias("copies"))
    both_ = rows.select("conv_id", F.lit(1).alias("kind"), *KEYS, "text", "copies").unionByName(told)
    dealt = both_.repartition("conv_id").sortWithinPartitions("conv_id", "kind", *KEYS).select("conv_id", "kind", "role", "text", "copies")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("conv_id", pa.int64()), ("place", pa.int64()), ("edit", pa.string()), ("role", pa.string()), ("text", pa.string())])
        yield from batches_of(edited(rows_of(batches)), schema, 256)

    return dealt.mapInArrow(run, "conv_id long, place long, edit string, role string, text string")


def edited(rows: Iterable[dict]) -> Iterator[dict]:
    conv, audit, at, place, turn = None, "", 0, 0, "user"

    def inserts() -> Iterator[dict]:
        nonlocal at, place, turn
        while at < len(audit) and audit[at] == "I":
            yield {"conv_id": conv, "place": place, "edit": "I", "role": turn, "text": ""}
            at, place, turn = at + 1, place + 1, "assistant" if turn == "user" else "user"

    for r in rows:
        if not r["kind"]:
            yield from inserts()
            conv, audit, at, place, turn = r["conv_id"], r["text"], 0, 0, "user"
            continue
        for _ in range(r["copies"]):
            yield from inserts()
            edit = audit[at]
            at += 1
            if edit == "D":
                continue
            role = r["role"] if edit == "K" else turn
            if edit == "R" or role[:1] != "s":
                turn = "assistant" if turn == "user" else "user"
            yield {"conv_id": conv, "place": place, "edit": edit, "role": role, "text": r["text"]}
            place += 1
    yield from inserts()


def repair(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(audits, turns) of conversations (conv_id, turn, role, text): what was wrong and the cheapest edits, one row for
    each conversation, and the turns they leave, (conv_id, place, edit, role, text).

    Rows go by turn (null first), those of one turn by role and a hash of their text, so repeated rows follow each other.
    Null roles and texts are one space; rows without a conv_id are one conversation. A row's first fault counts: blank
    (white space only), duplicate (role and text seen before), truncated (does not end in `.`, `!` or `?`). Keep
    costs nothing, Rerole 3, Delete 4 (a must for blank and duplicate rows), Insert 3, an undeleted truncated row 3 more.
    The initials of the roles left are `(s?(ua)+)?`: a role that begins with another letter, or is empty, is never kept. Of
    audits of least cost the ASCII-least counts. illegal: neighbours whose initials are not su, ua or au. Other columns of
    rows are not returned.
    """
    texts, slim = judged(rows)
    found = saved(audits(slim), "audits")
    return found, repaired(texts, found)


def digests(turns: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256) over `role:text` of the turns, newline-joined; the turns stream past the digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done() -> Iterator[dict]:
            now = None
            for r in rows_of(batches):
                line = f"{r['role']}:{r['text']}".encode()
                if now and now[0] == r["conv_id"]:
                    now[1].update(b"\n" + line)
                    continue
                if now:
                    yield {"conv_id": now[0], "repaired_sha256": now[1].hexdigest()}
                now = (r["conv_id"], hashlib.sha256(line))
            if now:
                yield {"conv_id": now[0], "repaired_sha256": now[1].hexdigest()}

        yield from batches_of(done(), pa.schema([("conv_id", pa.int64()), ("repaired_sha256", pa.string())]))

    return turns.mapInArrow(run, "conv_id long, repaired_sha256 string")


def conversation_report(original: DataFrame, rows: DataFrame) -> DataFrame:
    """A row for each conv_id of original: what is wrong with its rows in `rows`, the audit and the digest of the turns."""
    rows = saved(rows, "damaged")
    found, turns = repair(rows)
    days = rows.select("conv_id", F.col("turn").cast("long").alias("turn")).distinct().groupBy("conv_id")
    gaps = days.agg(F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).cast("long").alias("gaps"))
    out = original.select("conv_id").distinct()
    for side in (gaps, found, digests(turns)):
        side = side.withColumnRenamed("conv_id", "of")
        out = out.join(side, F.col("conv_id").eqNullSafe(F.col("of")), "left").drop("of")
    zero = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select("conv_id", *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"))


def op13_repair(spark, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return conversation_report(rows, damaged(rows))


def _moves() -> str:
    """All ways past one row, as SQL values: from, to, letters, cost, edit, the initial it needs, inserted turns, new role."""
    names, out = {"u": "user", "a": "assistant"}, []
    for s in STATES:
        befores = [(s, [])] + [(t, [r]) for r in "ua" if (t := NEXT[r].get(s)) is not None]
        befores += [(NEXT[r][t], [*made, r]) for t, made in befores[1:] for r in "ua" if t in NEXT[r] and NEXT[r][t] != s]
        for m, made in befores:
            told = "[" + ", ".join(f"'{names[r]}:'" for r in made) + "]::VARCHAR[]"
            lead, cost = "I" * len(made), INSERT * len(made)
            out.append(f"({s}, {m}, '{lead}D', {cost + DELETE}, 'D', '', {told}, '')")
            out += [f"({s}, {NEXT[r][m]}, '{lead}K', {cost}, 'K', '{r}', {told}, '')" for r in "sua" if m in NEXT[r]]
            out += [f"({s}, {NEXT[r][m]}, '{lead}R', {cost + REROLE}, 'R', '', {told}, '{names[r]}')" for r in "ua" if m in NEXT[r]]
    return ", ".join(out)


_CRC = ", ".join(f"t{k + 1} AS (SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END AS c FROM t{k})" for k in range(8))
ORACLE = rf"""
WITH RECURSIVE t0 AS (SELECT i, i::BIGINT AS c FROM range(256) r(i)), {_CRC},
tab AS (SELECT list(c ORDER BY i) AS x FROM t8),
raw AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations),
hits AS (SELECT conv_id, turn, role, text, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(key, ''), lambda c: ascii(c)::BIGINT)),
         lambda c, b: xor(c >> 8, x[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS hit FROM raw, tab),
dam AS (SELECT conv_id, turn, CASE hit WHEN 4 THEN 'user' ELSE role END AS role,
               CASE hit WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
               unnest(CASE hit WHEN 3 THEN [0, 1] ELSE [0] END) AS copy FROM hits WHERE hit <> 0),
num AS (SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i,
               row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) > 1 AS again,
               regexp_replace(text, '[\x20\x09-\x0D]+$', '') AS body FROM dam),
rows_ AS (SELECT *, body = '' AS blank, body <> '' AND again AS dup, body <> '' AND NOT again AND right(body, 1) NOT IN ('.', '!', '?') AS trunc,
                 lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) || left(role, 1) NOT IN ('su', 'ua', 'au') AS odd FROM num),
facts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (dup) AS duplicate,
                 count(*) FILTER (trunc) AS truncated, count(*) FILTER (odd) AS illegal, count(*) AS n FROM rows_ GROUP BY conv_id),
moves(s, t, letters, cost, edit, initial, made, role) AS (VALUES {_moves()}),
run AS (SELECT conv_id, 0::BIGINT AS i, 0 AS s, 0 AS cost, '' AS audit, []::VARCHAR[] AS told FROM facts
        UNION ALL
        SELECT r.conv_id, n.i, m.t, r.cost + m.cost + CASE WHEN m.edit <> 'D' AND n.trunc THEN {TRUNCATED} ELSE 0 END AS cost, r.audit || m.letters AS audit,
               list_concat(r.told, m.made, CASE m.edit WHEN 'D' THEN []::VARCHAR[] WHEN 'K' THEN [n.role || ':' || n.text] ELSE [m.role || ':' || n.text] END) AS told
        FROM run r JOIN rows_ n ON n.conv_id IS NOT DISTINCT FROM r.conv_id AND n.i = r.i + 1
        JOIN moves m ON m.s = r.s AND (m.edit = 'D' OR NOT (n.blank OR n.dup) AND (m.edit = 'R' OR m.initial = left(n.role, 1)))
        QUALIFY row_number() OVER (PARTITION BY r.conv_id, m.t ORDER BY r.cost + m.cost + CASE WHEN m.edit <> 'D' AND n.trunc THEN {TRUNCATED} ELSE 0 END, r.audit || m.letters) = 1),
ends(s, letters, made) AS (VALUES (0, '', []::VARCHAR[]), (1, 'II', ['user:', 'assistant:']), (2, 'I', ['assistant:']), (3, '', []::VARCHAR[])),
best AS (SELECT r.conv_id, r.cost + {INSERT} * length(e.letters) AS cost, r.audit || e.letters AS audit, list_concat(r.told, e.made) AS told
         FROM run r JOIN ends e USING (s) JOIN facts f ON f.conv_id IS NOT DISTINCT FROM r.conv_id AND f.n = r.i
         QUALIFY row_number() OVER (PARTITION BY r.conv_id ORDER BY r.cost + {INSERT} * length(e.letters), r.audit || e.letters) = 1)
SELECT c.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
       coalesce(illegal, 0)::BIGINT AS illegal, coalesce(cost, 0)::BIGINT AS cost, coalesce(audit, '') AS audit, sha256(coalesce(array_to_string(told, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN facts f ON f.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN best b ON b.conv_id IS NOT DISTINCT FROM c.conv_id
"""
