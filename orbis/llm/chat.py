"""Chat formatting by perspective rotation, in DataFrame functions only.

For every participant (role) of a conversation the dialogue is rendered once with that speaker as
the assistant and the others as named users; the mask has the character ranges of the
assistant's own words. A rendering is a list of parts of at most ``part_turns`` turns, each a
row, so that no conversation, however long, has to fit in one row or task; part_start says where a
part begins in the whole rendering. An ordinary conversation has one part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orbis.session import materialize

PART_TURNS = 256


def turns_of(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, at, the turn's place (from 0) in its conversation, and total, how many turns that has.

    Null roles count as "unknown" and null texts as empty; turns are ordered by turn (nulls
    first), then hash, role and text; exact repeats of a turn count once. Ranks come from counts of
    bounded stretches of turns, so a long conversation isn't sorted in one task.
    """
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("unknown")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    ).distinct()
    rows = rows.withColumn("h", F.xxhash64("role", "text"))
    # A stretch: up to 512 turn numbers, and where one number has many turns a 1/1024 of their hashes.
    rows = rows.withColumn("a", F.floor(F.col("turn") / 512).cast("long"))
    stretch = ["conv_id", "a", "b"]
    sized = rows.groupBy("conv_id", "a").agg(F.count("*").alias("n")).filter("n > 100000")
    # Only in such crowded stretches are turn and hash added to the key.
    crowded = rows.join(sized.select(F.col("conv_id").alias("c2"), F.col("a").alias("a2")), F.col("conv_id").eqNullSafe(F.col("c2")) & F.col("a").eqNullSafe(F.col("a2")), "left")
    fine = F.struct(F.col("turn").alias("t"), F.shiftright("h", 54).alias("x"))
    rows = crowded.withColumn("b", F.when(F.col("c2").isNotNull() | F.col("a2").isNotNull(), fine)).drop("c2", "a2")
    counts = rows.groupBy(*stretch).agg(F.count("*").alias("n"))
    ahead = Window.partitionBy("conv_id").orderBy("a", "b").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*[F.col(c).alias(f"_{c}") for c in stretch], F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("start"), F.sum("n").over(Window.partitionBy("conv_id")).alias("total"))
    rank = F.row_number().over(Window.partitionBy(*stretch).orderBy("turn", "h", "role", "text")) - 1
    same = F.lit(True)
    for c in stretch:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return rows.withColumn("rank", rank).join(starts, same).select("conv_id", "turn", "role", "text", (F.col("start") + F.col("rank")).alias("at"), "total")


OWN_HEAD = "<|assistant|>\n"


def user_head(role: Column) -> Column:
    return F.concat(F.lit("<|user name="), role, F.lit("|>\n"))


def rendered(speaker: Column, role: Column, text: Column) -> Column:
    own = role == speaker
    head = F.when(own, F.lit(OWN_HEAD)).otherwise(user_head(role))
    return F.struct(F.concat(head, text, F.lit("<|end|>\n")).alias("s"), F.length(head).alias("head"), (F.length(text) + F.length(F.lit("<|end|>"))).alias("body"), own.alias("own"))


def plain_length(turns: Column) -> Column:
    """Characters of a rendering in which all speakers are users."""
    return F.aggregate(turns, F.lit(0).cast("long"), lambda n, x: n + F.length(user_head(x["role"])) + F.length(x["text"]) + F.length(F.lit("<|end|>\n")))


def part_starts(parts: DataFrame) -> DataFrame:
    """conv_id, part, perspective, part_start of parts (conv_id, part, roles, n): running sums of n, less what own heads are shorter."""
    speakers = parts.select(F.col("conv_id").alias("_conv"), F.explode(F.array_distinct("roles")).alias("perspective")).distinct()
    own = F.size(F.filter("roles", lambda r: r == F.col("perspective")))
    change = F.length(F.lit(OWN_HEAD)) - F.length(user_head(F.col("perspective")))
    lengths = parts.join(speakers, F.col("conv_id").eqNullSafe(F.col("_conv"))).select("conv_id", "part", "perspective", (F.col("n") + own * change).alias("n"))
    before = Window.partitionBy("conv_id", "perspective").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return lengths.select("conv_id", "part", "perspective", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("part_start"))


def rotate(conversations: DataFrame, *, part_turns: int = PART_TURNS) -> DataFrame:
    """conv_id, perspective, part, part_start, n_turns, n_own, rendered, mask: one row a part, see turns_of() for order and nulls.

    mask lists the (start, end) character ranges in ``rendered`` that the perspective's speaker
    said, their end marks included. Null conv_ids form one conversation; an empty table gives no rows.
    """
    turns = turns_of(conversations)
    listed = F.sort_array(F.collect_list(F.struct("at", "role", "text"))).alias("t")
    # Written once, as three readers follow.
    parts = materialize(turns.withColumn("part", F.floor(F.col("at") / part_turns).cast("long")).groupBy("conv_id", "part").agg(F.max("total").alias("total"), listed), "parts")
    roles = F.transform("t", lambda x: x["role"])
    # A conversation of one part has its speakers in it. Those of several are few: the places of their parts come from lengths alone.
    short = parts.filter(F.col("total") <= part_turns).select("conv_id", "part", F.explode(F.array_distinct(roles)).alias("perspective"), F.lit(0).cast("long").alias("part_start"), "t")
    several = parts.filter(F.col("total") > part_turns)
    starts = part_starts(several.select("conv_id", "part", roles.alias("roles"), plain_length(F.col("t")).alias("n")))
    later = several.select(F.col("conv_id").alias("_c"), F.col("part").alias("_n"), "t").join(starts, F.col("_c").eqNullSafe(F.col("conv_id")) & (F.col("_n") == F.col("part")))
    each = short.unionByName(later.select("conv_id", "part", "perspective", "part_start", "t"))
    pieces = F.transform("t", lambda x: rendered(F.col("perspective"), x["role"], x["text"]))
    each = each.select("conv_id", "perspective", "part", "part_start", F.explode(F.array(pieces)).alias("p"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("mask"))

    def add(a: Column, x: Column) -> Column:
        span = F.struct((a["at"] + x["head"]).alias("start"), (a["at"] + x["head"] + x["body"]).alias("end"))
        return F.struct((a["at"] + F.length(x["s"])).alias("at"), F.when(x["own"], F.array_append(a["mask"], span)).otherwise(a["mask"]).alias("mask"))

    text = F.concat_ws("", F.transform("p", lambda x: x["s"]))
    own = F.size(F.filter("p", lambda x: x["own"]))
    return each.select("conv_id", "perspective", "part", "part_start", F.size("p").alias("n_turns"), own.alias("n_own"), text.alias("rendered"), F.aggregate("p", start, add, lambda a: a["mask"]).alias("mask"))
