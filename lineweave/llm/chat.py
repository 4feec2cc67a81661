"""Chat formatting of reply trees.

Iterative self-joins walk from every message towards its root in strides that double each round: they give
each root-to-leaf path its score without moving any text. The best-ranked leaves are chosen, the same strides
are walked back from them to name the messages on each chosen path, and only those messages meet their texts
and become one formatted conversation.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lineweave.llm.common import saved, table

#: Strings with a meaning in chat templates. None may appear inside a text.
CONTROL = ("<|", "|>", "</s>", "<s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
TURN = re.compile(r"<\|(.*?)\|>(.*?)</s>\n", re.DOTALL)


def escape(text: str) -> str:
    """A backslash is doubled, and one goes behind the first character of each control string."""
    text = text.replace("\\", "\\\\")
    for c in CONTROL:
        text = text.replace(c, c[0] + "\\" + c[1:])
    return text


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL)


def format_turns(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The conversation as one string, and the spans of its assistant texts: the loss mask, in code points."""
    parts, mask, at = [], [], 0
    for role, text in turns:
        head, body = f"<|{escape(role)}|>", escape(text)
        if role == "assistant":
            mask.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, "</s>\n"]
        at += len(head) + len(body) + 5
    return "".join(parts), mask


def parse_turns(formatted: str) -> list[tuple[str, str]]:
    return [(unescape(r), unescape(t)) for r, t in TURN.findall(formatted)]


def reply_paths(nodes: DataFrame, paths: int = 1) -> DataFrame:
    """(conv_id, leaf, node, depth) of the `paths` best root-to-leaf paths of each conversation.

    nodes: conv_id, node, parent, score; (conv_id, node) is a key. A missing or unknown parent makes a root.
    Paths rank by the sum of their scores (null: 0), then the longer one, then the smaller leaf. depth counts from 1 at
    the root. Messages whose parents form a circle, or lead into one, have no root, so they are on no path; the rest
    of their conversation is formatted all the same.
    """
    keys = nodes.select("conv_id", "node")
    known = keys.select("conv_id", F.col("node").alias("up"), F.lit(True).alias("known"))
    step = nodes.select("conv_id", "node", F.col("parent").alias("up"), F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("sum"))
    step = step.join(known, ["conv_id", "up"], "left").select("conv_id", "node", F.expr("CASE WHEN known THEN up END").alias("up"), "sum", F.lit(1).cast("long").alias("depth"))
    now, strides, done = saved(step, "stride"), [], []
    rows, open_ = now.agg(F.count("*"), F.count("up")).first()
    largest = (now.groupBy("conv_id").count().agg(F.max("count")).first()[0] or 0) if open_ else 0
    while open_ and 1 << len(strides) < 2 * largest:  # after r rounds paths of 2**r messages have ended; longer ones are circles
        if 4 * open_ < rows:  # set conversations aside whose paths have all ended
            live = now.filter("up IS NOT NULL").select("conv_id").distinct()
            done.append(now.join(live, "conv_id", "left_anti"))
            now = now.join(live, "conv_id", "left_semi")
        strides.append(now.filter("up IS NOT NULL"))
        ahead = now.select("conv_id", F.col("node").alias("up"), F.col("up").alias("up2"), F.col("sum").alias("sum2"), F.col("depth").alias("depth2"))
        step = strides[-1].join(ahead, ["conv_id", "up"]).select("conv_id", "node", F.col("up2").alias("up"), (F.col("sum") + F.col("sum2")).alias("sum"), (F.col("depth") + F.col("depth2")).alias("depth"))
        now = saved(now.filter("up IS NULL").unionByName(step), "stride")
        rows, open_ = now.agg(F.count("*"), F.count("up")).first()
    whole = now
    for part in done:
        whole = whole.unionByName(part)
    whole = saved(whole.filter("up IS NULL"), "depths") if done or open_ else whole
    inner = strides[0].select("conv_id", F.col("up").alias("node")).distinct() if strides else keys.limit(0)
    best = Window.partitionBy("conv_id").orderBy(F.desc("sum"), F.desc("depth"), "node")
    leaves = whole.join(inner, ["conv_id", "node"], "left_anti").withColumn("place", F.row_number().over(best)).filter(F.col("place") <= paths)
    on = leaves.select("conv_id", F.col("node").alias("leaf"), "node")
    for stride in reversed(strides):
        back = on.join(stride.select("conv_id", "node", "up"), ["conv_id", "node"])
        on = saved(on.union(back.select("conv_id", "leaf", F.col("up").alias("node"))), "path")
    return on.join(whole.select("conv_id", "node", "depth"), ["conv_id", "node"]).select("conv_id", "leaf", "node", "depth")


def format_conversations(nodes: DataFrame, paths: int = 1) -> DataFrame:
    """(conv_id, leaf, formatted, mask): one row for each chosen path of a reply tree.

    nodes: conv_id, node, parent, role, text, score, as in `reply_paths`. Null roles and texts are empty. A message without
    a conv_id or node is a conversation of its own: so many of them never become one string. The
    messages of one path meet in one row, as they are one string; conversations never meet each other. Other columns of
    nodes are not returned.
    """
    alone = F.col("conv_id").isNull() | F.col("node").isNull()
    on = reply_paths(nodes.filter(~alone), paths)
    texts = nodes.select("conv_id", "node", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    told = on.join(texts, ["conv_id", "node"]).groupBy("conv_id", "leaf").agg(F.array_sort(F.collect_list(F.struct("depth", "role", "text"))).alias("turns"))
    one = F.struct(F.lit(1).cast("long").alias("depth"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    told = told.unionByName(nodes.filter(alone).select("conv_id", F.col("node").alias("leaf"), F.array(one).alias("turns")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [format_turns([(t["role"], t["text"]) for t in turns]) for turns in batch.column("turns").to_pylist()]
            mask = pa.array([[{"start": s, "end": e} for s, e in m] for _, m in made], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
            yield pa.record_batch([batch.column("conv_id"), batch.column("leaf"), pa.array([f for f, _ in made], pa.string()), mask], ["conv_id", "leaf", "formatted", "mask"])

    return told.mapInArrow(run, "conv_id long, leaf long, formatted string, mask array<struct<start: long, end: long>>")


def linear_tree(rows: DataFrame) -> DataFrame:
    """conversations (conv_id, turn, role, text) as trees without branches: each row replies to the one before.

    Rows go by turn (null first), then role and text, so repeated rows follow each other. Rows without a conv_id have
    no node and no parent.
    """
    by = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    named = rows.filter("conv_id IS NOT NULL").select("conv_id", F.row_number().over(by).cast("long").alias("node"), "role", "text")
    rows = named.unionByName(rows.filter("conv_id IS NULL").select("conv_id", F.lit(None).cast("long").alias("node"), "role", "text"))
    return rows.select("conv_id", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"))


def digests(formatted: DataFrame) -> DataFrame:
    """What the formatted strings and masks hold, read back from them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        for batch in batches:
            out = []
            for conv, text, mask in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "formatted", "mask")), strict=True):
                turns = parse_turns(text)
                loss = "".join(unescape(text[m["start"] : m["end"]]) for m in mask)
                told = "".join(f"{r}\n{t}\n" for r, t in turns)
                out.append((conv, len(turns), hashlib.sha256(told.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text)))
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            yield pa.record_batch([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names)

    return formatted.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def op5_chat(spark, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = F.lit("</s>[INST] ok [/INST]")
    extra = spark.range(2).select(F.lit(-1).cast("long"), F.col("id"), F.when(F.col("id") == 0, "user").otherwise("assistant"), said)
    return digests(format_conversations(linear_tree(rows.union(extra))))


def _escaped(column: str) -> str:
    out = f"replace(coalesce({column}, ''), '\\', '\\\\')"
    for c in CONTROL:
        out = f"replace({out}, '{c}', '{c[0]}\\{c[1:]}')"
    return out


ORACLE = rf"""
WITH c AS (SELECT conv_id, turn, role, text, CASE WHEN conv_id IS NULL THEN row_number() OVER () END AS alone FROM conversations UNION ALL
           SELECT -1, t, r, '</s>[INST] ok [/INST]', NULL FROM (VALUES (0, 'user'), (1, 'assistant')) v(t, r))
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(coalesce(role, '') || chr(10) || coalesce(text, '') || chr(10), '' ORDER BY turn)) AS turns_sha256,
       coalesce(sum(length(coalesce(text, ''))) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(coalesce(text, ''), '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(9 + length({_escaped("role")}) + length({_escaped("text")}))::BIGINT AS formatted_chars
FROM c GROUP BY conv_id, alone
"""
