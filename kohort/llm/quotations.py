"""Chat formatting by quotation linking, with built-in functions only.

Every message is read line by line: leading ``>`` marks give a line's quote level, and neighbouring lines of one
level are a passage. Quoted passages and their lines are normalised (A-Z lower-cased, white space collapsed) and
hashed; the hashes are joined with those of what earlier messages of the conversation say themselves, and a
message replies to the original of its shallowest quotes, the one most of them are from. The result has one row per
message, without its quotes and the line that announces them, numbered in reply order: every message comes
after the one it answers. Rows stay per message, so a conversation of any length is never one value.

Of a passage said several times the earliest message is the original, found by a combining aggregate, so a
phrase that everyone uses adds one row to the join. Positions in a conversation come from counts of blocks of turns.

Defined cases: rows that repeat conversation, turn, role and text are one message with ``copies``; a null text is an
empty one, a null role is written as ``unknown``; messages with a null conversation are one conversation of
their own; a null turn comes first and is nobody's original; messages of one turn follow by role and text; further
columns are ignored; an empty table gives an empty result. Texts are read whole, however long.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWER, UPPER, stage

MARKS = r"^((?:[ \t]*>)+)"
ANNOUNCES = r"(?i)(wrote|schrieb|écrit|escribió)[ \t]*:[ \t]*$"
#: turns of a block in which messages are numbered together
BLOCK = 256


def normal(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.translate(text, UPPER, LOWER), r"[ \t\r\n]+", " "))


def units(whole: Column, lines: Column) -> Column:
    """Distinct normalised non-empty texts of a passage and of its lines."""
    every = F.concat(F.array(whole), lines)
    return F.array_distinct(F.filter(F.transform(every, normal), lambda u: u != ""))


def passages(messages: DataFrame) -> DataFrame:
    """``messages`` with ``parsed`` lines, ``runs`` of one level, and the body without quotes."""
    lines = F.split(F.coalesce("text", F.lit("")), r"\r?\n")

    def parse(line: Column) -> Column:
        marks = F.regexp_extract(line, MARKS, 1)
        return F.struct(
            F.length(F.translate(marks, " \t", "")).alias("level"), F.regexp_replace(line, MARKS + " ?", "").alias("content")
        )

    read = messages.withColumn("parsed", F.transform(lines, parse)).withColumn("size", F.size("parsed"))
    level = lambda i: F.get("parsed", i)["level"]
    read = read.withColumn(
        "starts", F.filter(F.sequence(F.lit(0), F.col("size") - 1), lambda i: (i == 0) | (level(i) != level(i - 1)))
    )

    def run(start: Column, at: Column) -> Column:
        end = F.coalesce(F.get("starts", at + 1), F.col("size"))
        own = F.transform(F.slice("parsed", start + 1, end - start), lambda x: x["content"])
        # the line that announces a quote is no part of what a message says
        last = F.element_at(own, -1)
        announces = (level(start) == 0) & (end < F.col("size")) & last.rlike(ANNOUNCES)
        said = F.when(announces, F.slice(own, F.lit(1), F.size(own) - 1)).otherwise(own)
        return F.struct(level(start).alias("level"), said.alias("lines"), F.array_join(said, "\n").alias("content"))

    read = read.withColumn("runs", F.transform("starts", run))
    said = F.transform(F.filter("runs", lambda r: r["level"] == 0), lambda r: r["content"])
    return read.withColumn("body", F.regexp_replace(F.array_join(said, "\n"), r"^\s+|\s+$", "")).drop("parsed", "starts", "size")


def link(read: DataFrame) -> DataFrame:
    """(message, reply_to, n_linked) of the messages with a quote of an earlier message of their conversation."""
    own = read.select(
        "message", "conversation", "turn", F.posexplode("runs").alias("at", "run"), F.col("body")
    )
    quotes = own.where("run.level > 0").select(
        "message", "conversation", "turn", "at", F.col("run.level").alias("level"), F.explode(units(F.col("run.content"), F.col("run.lines"))).alias("unit")
    )
    said = F.flatten(F.transform(F.filter("runs", lambda r: r["level"] == 0), lambda r: F.concat(F.array(r["content"]), r["lines"])))
    originals = read.where("turn IS NOT NULL").select(
        "conversation", "turn", F.explode(units(F.col("body"), said)).alias("unit")
    )
    digest = F.sha2("unit", 256).alias("digest")
    originals = originals.select("conversation", "turn", digest).groupBy("conversation", "digest").agg(F.min("turn").alias("original"))
    quotes = quotes.select("message", "conversation", "turn", "at", "level", F.length("unit").alias("size"), digest)
    on = quotes["conversation"].eqNullSafe(originals["conversation"]) & (quotes["digest"] == originals["digest"])
    found = quotes.join(originals, on).where(F.col("original") < F.col("turn"))
    per_original = found.groupBy("message", "level", "original").agg(F.sum("size").alias("size"), F.collect_set("at").alias("runs"))
    best = F.max(F.struct(-F.col("level"), "size", "original")).alias("best")
    return per_original.groupBy("message").agg(best, F.array_distinct(F.flatten(F.collect_list("runs"))).alias("runs")).select(
        "message", F.col("best.original").alias("reply_to"), F.size("runs").cast("long").alias("n_linked")
    )


def positions(messages: DataFrame) -> DataFrame:
    """``messages`` with ``position``, from 0, in their conversation."""
    blocked = messages.withColumn("block", F.coalesce(F.floor(F.col("turn") / BLOCK), F.lit(-(1 << 62))))
    counts = stage(blocked.groupBy("conversation", "block").agg(F.count("*").alias("n")))
    earlier = Window.partitionBy("conversation").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(
        F.col("conversation").alias("c"), F.col("block").alias("b"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before")
    )
    inside = Window.partitionBy("conversation", "block").orderBy("turn", "role", "text")
    on = F.col("conversation").eqNullSafe(F.col("c")) & (F.col("block") == F.col("b"))
    numbered = blocked.withColumn("own", F.row_number().over(inside) - 1).join(counts, on)
    return numbered.withColumn("position", F.col("before") + F.col("own")).drop("c", "b", "before", "own", "block")


def chat(conversations: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per message: conversation, position, turn, role, body, reply_to, n_quotes, n_linked, copies, chat.

    ``reply_to`` is the turn that the message's quotes are from; null where it quotes nobody and so answers the
    message before it. ``chat`` is the message in chat form.
    """
    own = conversations.select(
        F.col(conversation).cast("long").alias("conversation"), F.col(turn).cast("long").alias("turn"), F.col(role).cast("string").alias("role"), F.col(text).cast("string").alias("text")
    )
    messages = own.groupBy("conversation", "turn", "role", "text").agg(F.count("*").alias("copies"))
    # written, so that a message keeps its number
    messages = stage(positions(messages).withColumn("message", F.monotonically_increasing_id()))
    read = passages(messages)
    joined = read.join(link(read), "message", "left")
    name = F.coalesce("role", F.lit("unknown"))
    return joined.select(
        F.col("conversation").alias(conversation),
        F.col("position").cast("long"),
        F.col("turn").alias(turn),
        name.alias(role),
        F.col("body"),
        "reply_to",
        F.size(F.filter("runs", lambda r: r["level"] > 0)).cast("long").alias("n_quotes"),
        F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"),
        F.col("copies").cast("long"),
        F.concat(F.lit("<|"), name, F.lit("|>\n"), F.col("body"), F.lit("\n<|end|>")).alias("chat"),
    )
