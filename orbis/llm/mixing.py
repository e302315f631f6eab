"""Mixing sources to target weights by Pfair scheduling, in DataFrame functions only.

Each source's rows, in the order of a hash, form blocks. With w the weight of a source as a part of
all, its block j (from 0) is released at slot floor(j / w) and due by slot ceil((j + 1) / w); in each
slot the released block with the earliest deadline goes (ties: to the source with the smaller
name). The weights add up to 1, so every block meets its window and a source is always less than one
block away from its share, however long the phase. When a source runs dry a new phase begins for
the others with weights in the same proportion, so that every row gets a place. The state (a few
numbers a source) is folded over all slots and kept at every 1000th; from there on the slots
are listed in parallel.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orbis.session import checked_broadcast, materialize

CHUNK = 1000
BLOCK_ROWS = 32


def let(value: Column, use) -> Column:
    return F.transform(F.array(value), use)[0]


def total_of(sources: Column) -> Column:
    """Weights of the sources that aren't dry, in all. A weight under 0 counts as 0."""
    return F.aggregate(sources, F.lit(0.0), lambda a, s: a + F.when(s["done"] < s["left"], s["w"]).otherwise(0.0))


def next_of(state: Column) -> Column:
    """The source (its index) of the state's slot: earliest deadline first among the released blocks; null when all are dry.

    A weight of 0 comes when no other source has blocks left. The factors keep quotients that are whole numbers whole.
    """
    most = F.lit(1 << 60)

    def due(s: Column, i: Column) -> Column:
        some = s["w"] > 0
        out = F.when(some, F.least(F.floor(s["done"] * state["total"] / s["w"] * (1 + 1e-14)), most)).otherwise(F.lit(0)) > state["t"]
        return F.when(s["done"] < s["left"], F.struct(out.alias("early"), F.when(some, F.least(F.ceil((s["done"] + 1) * state["total"] / s["w"] * (1 - 1e-14)), most)).otherwise(most).alias("due"), i.alias("i")))

    return F.array_min(F.transform(state["sources"], due))["i"]


def advanced(state: Column, i: Column) -> Column:
    """The state after a block of source i; the phase ends with a source that runs dry. Unchanged for a null i."""

    def taken(sources: Column) -> Column:
        own = F.get(sources, i)
        dry = own["done"] == own["left"]
        rest = F.transform(sources, lambda s: F.struct(s["w"].alias("w"), F.lit(0).cast("long").alias("done"), (s["left"] - s["done"]).alias("left")))
        return F.when(dry, F.struct((state["phase"] + 1).alias("phase"), F.lit(0).cast("long").alias("t"), total_of(rest).alias("total"), rest.alias("sources"))).otherwise(F.struct(state["phase"].alias("phase"), (state["t"] + 1).alias("t"), state["total"].alias("total"), sources.alias("sources")))

    stepped = F.transform(state["sources"], lambda s, k: F.struct(s["w"].alias("w"), (s["done"] + F.when(k == i, 1).otherwise(0)).alias("done"), s["left"].alias("left")))
    return F.when(i.isNull(), state).otherwise(let(stepped, taken))


STATE = "struct<phase:int,t:bigint,total:double,sources:array<struct<w:double,done:bigint,left:bigint>>>"


def snapshots_of(sources: Column, chunks: Column) -> Column:
    """The state before each chunk of slots."""
    own = F.transform(sources, lambda s: F.struct(F.greatest(s["w"], F.lit(0.0)).alias("w"), F.lit(0).cast("long").alias("done"), s["blocks"].alias("left")))
    start = let(own, lambda x: F.struct(F.lit(0).alias("phase"), F.lit(0).cast("long").alias("t"), total_of(x).alias("total"), x.alias("sources"))).cast(STATE)
    step = lambda state, _: let(next_of(state), lambda i: advanced(state, i)).cast(STATE)
    chunk = lambda a, _: F.struct(F.aggregate(F.sequence(F.lit(1), F.lit(CHUNK)), a["state"], step).alias("state"), F.array_append(a["all"], a["state"]).alias("all"))
    return F.aggregate(F.sequence(F.lit(1).cast("long"), chunks), F.struct(start.alias("state"), F.array().cast(f"array<{STATE}>").alias("all")), chunk, lambda a: a["all"])


def slots_of(state: Column) -> Column:
    """phase, source (its index), nth block of it in the phase and its blocks at the phase's begin, for the slots of a chunk."""
    kind = "array<struct<phase:int,i:int,nth:bigint,left:bigint>>"

    def step(a: Column, _: Column) -> Column:
        def placed(i: Column) -> Column:
            own = F.get(a["state"]["sources"], i)
            slot = F.struct(a["state"]["phase"].alias("phase"), i.alias("i"), own["done"].alias("nth"), own["left"].alias("left"))
            return F.struct(advanced(a["state"], i).cast(STATE).alias("state"), F.when(i.isNull(), a["slots"]).otherwise(F.array_append(a["slots"], slot)).cast(kind).alias("slots"))

        return let(next_of(a["state"]), placed)

    return F.aggregate(F.sequence(F.lit(1), F.lit(CHUNK)), F.struct(state.alias("state"), F.array().cast(kind).alias("slots")), step, lambda a: a["slots"])


def schedule(counts: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """phase, slot, source, nth, left: the place of every block, for counts (source, n, w), one row a source.

    Sources and their weights are a table the size of the configuration; it is folded in one row,
    with a state for every chunk of slots.
    """
    sources = F.sort_array(F.collect_list(F.struct("source", F.col("w").cast("double").alias("w"), F.ceil(F.col("n") / block_rows).cast("long").alias("blocks"))))
    whole = counts.agg(sources.alias("s"), F.sum(F.ceil(F.col("n") / block_rows)).cast("long").alias("blocks")).filter("blocks > 0")
    chunks = F.ceil(F.col("blocks") / CHUNK).cast("long")
    plan = materialize(whole.select(F.transform("s", lambda s: s["source"]).alias("names"), F.posexplode(snapshots_of(F.col("s"), chunks)).alias("chunk", "state")), "phases")
    slots = plan.repartition("chunk").select("names", "chunk", F.posexplode(slots_of(F.col("state"))).alias("k", "b"))
    return slots.select("b.phase", (F.col("chunk").cast("long") * CHUNK + F.col("k")).alias("slot"), F.get("names", F.col("b.i")).alias("source"), "b.nth", "b.left")


def mix(docs: DataFrame, *, weights: dict[str, float] | None = None, power: float = 0.5, block_rows: int = BLOCK_ROWS, most_sources: int = 10_000, columns: list[str] | None = None) -> DataFrame:
    """All rows of docs, as a struct ``row`` of their columns (or ``columns`` of them, doc_id among these), whatever these are called, with source, block, in_block, slot and phase.

    Ordering by (slot, in_block) gives the mix. Rows of block j of a source are its rows j *
    block_rows and on in the order of a hash of doc_id and text; only a source's last block may be short.
    Target weights are ``weights``, where a source that isn't named gets the smallest, or else the
    sources' row counts to ``power``. Null sources count as the empty name. In the first phase
    all sources are at their target; no row is dropped, and none repeated, in any.
    A hot source is ranked in parallel: by counts of hash buckets of some thousand rows, then in each bucket.
    Equal rows are ranked in any order; an empty table gives no rows. The schedule's state holds one entry a
    source, so more than ``most_sources`` are refused.
    """
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns or docs.columns]).alias("row"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"), F.xxhash64("doc_id", F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("hash"))
    counts = materialize(own.groupBy("source").agg(F.count("*").alias("n")), "sources")
    if (n := counts.count()) > most_sources:
        raise ValueError(f"{n} sources, more than {most_sources}: name a column with fewer values, or raise most_sources")
    if weights:
        named = F.create_map(*[x for k, v in weights.items() for x in (F.lit(k), F.lit(float(v)))])
        weight = F.coalesce(F.get(F.array(named), F.lit(0))[F.col("source")], F.lit(float(min(weights.values()))))
    else:
        weight = F.pow("n", F.lit(power))
    places = materialize(schedule(counts.select("source", "n", weight.alias("w")), block_rows), "places")
    return _placed(own, counts, places, block_rows)


def _placed(own: DataFrame, counts: DataFrame, places: DataFrame, block_rows: int) -> DataFrame:
    # Buckets of about 2000 rows of a source, in the order of the hash's upper bits.
    buckets = F.greatest(F.lit(1), F.ceil(F.col("n") / 2000)).cast("long")
    bits = F.shiftrightunsigned("hash", 33)
    keyed = own.join(F.broadcast(counts), "source").withColumn("bucket", F.floor(bits * buckets / F.lit(1 << 31)).cast("long")).drop("n")
    sizes = keyed.groupBy("source", "bucket").agg(F.count("*").alias("size"))
    ahead = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("source", "bucket", F.coalesce(F.sum("size").over(ahead), F.lit(0)).alias("start"))
    rank = F.row_number().over(Window.partitionBy("source", "bucket").orderBy("hash", F.col("row")["doc_id"])) - 1
    ranked = keyed.withColumn("rank", rank).join(starts, ["source", "bucket"]).withColumn("rank", F.col("start") + F.col("rank"))
    ranked = ranked.withColumn("block", F.floor(F.col("rank") / block_rows).cast("long")).withColumn("in_block", (F.col("rank") % block_rows).cast("int"))
    first = F.col("blocks") - F.col("left") + F.col("nth")
    blocks = places.join(counts.select("source", F.ceil(F.col("n") / block_rows).cast("long").alias("blocks")), "source")
    blocks = blocks.select("source", first.alias("block"), "slot", "phase")
    return ranked.join(checked_broadcast(blocks, places.count()), ["source", "block"]).select("row", "source", "block", "in_block", "slot", "phase")


def mixed_order(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs with docs' columns, dealt and sorted in the order of the mix: files follow each other in it."""
    placed = mix(docs, **options)
    sorted_rows = placed.repartitionByRange("slot", "in_block").sortWithinPartitions("slot", "in_block")
    return sorted_rows.select(*[F.col("row")[c].alias(c) for c in docs.columns])
