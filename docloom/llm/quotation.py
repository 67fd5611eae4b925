"""Quotation linking: conversations in reply order, without quotes.

Lines that begin with ``>`` signs are quoted, once per sign; consecutive lines of
one level form a passage.  Passages and their lines are normalised (case folded,
white space collapsed) and hashed.  The original of a passage is the first
message of the conversation that has it as its own text.  A message replies to
the original of most quoted characters on its lowest quoted level that is found;
ties go to the earlier message.  Originals precede the messages that quote them,
so replies form trees.  A conversation is ordered by thread, depth and message.

No message meets all others: each hash has one original per conversation, found
by aggregation.  Depths double their reach in every round, and positions come
from a global sort, so a conversation may hold any share of all messages.

Defined results: null and empty texts have no passages; attribution lines right
before a quote ("... wrote:") belong to the quote; messages that quote nothing
known start a thread; rows without conversation or message number come back
without links and position; rows that agree in conversation, number, role and
text count once; rows that share a number share their place in the tree and get
positions one after the other.  Other columns are not read; an empty table gives
an empty table.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import groupby

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.ranking import positions
from ..session import durable

QUOTED = re.compile(r"[ \t]*((?:>[ \t]?)+)(.*)", re.DOTALL)
ATTRIBUTION = re.compile(r".{0,200}\b(?:wrote|writes|schrieb|escribió|a écrit)\s*:\s*")


def passages(text: str | None) -> list[tuple[int, str]]:
    """(level, text) of the passages; level 0 is the message's own text."""
    lines = []
    for line in (text or "").split("\n"):
        match = QUOTED.fullmatch(line)
        lines.append((match[1].count(">"), match[2]) if match else (0, line))
    kept = [x for i, x in enumerate(lines) if not (x[0] == 0 and i + 1 < len(lines) and lines[i + 1][0] > 0 and ATTRIBUTION.fullmatch(x[1]))]
    return [(level, "\n".join(line for _, line in part)) for level, part in groupby(kept, key=lambda x: x[0])]


def own_text(text: str | None) -> str | None:
    """A text without its quotes."""
    if text is None or ">" not in text:
        return text
    return "\n".join(part.strip("\n") for level, part in passages(text) if level == 0).strip("\n")


def units(passage: str) -> dict[str, int]:
    """Hashes and sizes of a passage and of its lines, normalised; empty ones are left out."""
    found = {}
    for part in (passage, *passage.split("\n")):
        plain = " ".join(part.casefold().split())
        if plain:
            found[hashlib.sha256(plain.encode()).hexdigest()[:32]] = len(plain)
    return found


def reply_links(messages: DataFrame) -> DataFrame:
    """``_conv, _msg, _parent`` of the messages that quote an earlier one, from ``_conv, _msg, _text``."""

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for conv, msg, text in zip(frame["_conv"], frame["_msg"], frame["_text"], strict=True):
                for level, passage in passages(text):
                    out += [(conv, msg, level, digest, size) for digest, size in units(passage).items()]
            yield pd.DataFrame(out, columns=["_conv", "_msg", "level", "digest", "size"])

    found = messages.mapInPandas(read, "_conv long, _msg long, level int, digest string, size long")
    originals = found.where("level = 0").groupBy("_conv", "digest").agg(F.min("_msg").alias("_parent"))
    quotes = found.where("level > 0").join(originals, ["_conv", "digest"]).where("_parent < _msg")
    sums = quotes.groupBy("_conv", "_msg", "level", "_parent").agg(F.sum("size").alias("size"))
    best = F.min(F.struct("level", -F.col("size"), "_parent"))["_parent"]
    return sums.groupBy("_conv", "_msg").agg(best.alias("_parent"))


def link_quotations(messages: DataFrame, conversation: str = "conv_id", message: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``conv_id, turn, role, text`` (without quotes), ``reply_to, thread, depth, position``."""
    plain = messages.select(F.col(conversation).cast("long").alias("_conv"), F.col(message).cast("long").alias("_msg"), F.col(role).alias("role"), F.col(text).alias("_text")).distinct()
    placed = plain.where("_conv IS NOT NULL AND _msg IS NOT NULL")
    links = durable(placed.select("_conv", "_msg").distinct().join(reply_links(placed), ["_conv", "_msg"], "left"))
    up = links.select("_conv", "_msg", F.coalesce("_parent", "_msg").alias("_up"), F.col("_parent").isNotNull().cast("long").alias("_steps"))
    moving, settled = up.where("_steps > 0"), up.where("_steps = 0")
    while not moving.isEmpty():
        far = up.select("_conv", F.col("_msg").alias("_up"), F.col("_up").alias("_far"), F.col("_steps").alias("_more"))
        moved = durable(moving.join(far, ["_conv", "_up"]).select("_conv", "_msg", F.col("_far").alias("_up"), (F.col("_steps") + F.col("_more")).alias("_steps"), (F.col("_more") > 0).alias("_moved")))
        settled, moving = settled.union(moved.where("NOT _moved").drop("_moved")), moved.where("_moved").drop("_moved")
        up = settled.union(moving)

    @F.pandas_udf("string")
    def unquoted(batch: pd.Series) -> pd.Series:
        return pd.Series([own_text(t) for t in batch], dtype=object)

    trees = links.join(up, ["_conv", "_msg"])
    full = placed.join(trees, ["_conv", "_msg"]).withColumn("_own", unquoted("_text"))
    ordered = positions(full, ["_conv"], [F.col("_up"), F.col("_steps"), F.col("_msg"), F.col("role"), F.col("_text")])
    loose = plain.where("_conv IS NULL OR _msg IS NULL").withColumn("_own", unquoted("_text"))
    names = ["conv_id", "turn", "role", "text", "reply_to", "thread", "depth", "position"]
    linked = ordered.select("_conv", "_msg", "role", "_own", "_parent", "_up", "_steps", "position").toDF(*names)
    return linked.unionByName(loose.select(F.col("_conv").alias("conv_id"), F.col("_msg").alias("turn"), "role", F.col("_own").alias("text")), allowMissingColumns=True)


def as_mail(messages: DataFrame, conversation: str = "conv_id", message: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The messages as a mail client would send them: each quotes the message before and, one level deeper, the one before that."""
    plain = messages.select(F.col(conversation).alias("conv_id"), F.col(message).alias("turn"), F.col(role).alias("role"), F.col(text).alias("text"))
    single = plain.groupBy("conv_id", "turn").agg(F.min("text").alias("text"))

    def quote(column: str, marks: str):
        return F.when(F.length(column) > 0, F.concat(F.regexp_replace(column, "(?m)^", marks), F.lit("\n"))).otherwise("")

    for name, back in (("_one", 1), ("_two", 2)):
        before = single.select("conv_id", (F.col("turn") + back).alias("turn"), F.coalesce("text", F.lit("")).alias(name))
        plain = plain.join(before, ["conv_id", "turn"], "left")
    body = F.concat(quote("_two", ">> "), quote("_one", "> "), F.coalesce("text", F.lit("")))
    return plain.select("conv_id", "turn", "role", body.alias("text"))
