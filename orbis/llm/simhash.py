"""SimHash near-duplicates by vantage-point trees over Hamming distance.

Shards are the branches of vantage-point trees. A branch splits at a distance t from its vantage
point v: fingerprints with d(x, v) <= t are at home in the inner part, the others in the outer. By
the triangle bound a fingerprint with d(x, v) > t + r has no neighbour within r in the inner part, and one
with d(x, v) <= t - r none in the outer; those in between lie along the boundary, and are sent to both sides:
at home in one, a visitor in the other. On all 64 bits distances crowd around 32, and a ball of radius 3
meets both sides of nearly every split, so there are two trees, one on each half of the bits: of at most 3
differing bits one half has at most 1, so the radius there is 1, and about a quarter of the rows visit the other side of
a split at the median. All branches of a level share a vantage point, so a row's shards follow from its
distances alone. In a shard a 64-bit vantage-point tree of the rows at home is asked with radius 3 for all rows
there, visitors too: each pair is found where one of it is at home.

Shards with too many rows at home get further levels, three times at most; what is still larger consists of
fingerprints that agree nearly everywhere, and its homes are dealt to tiles, each of which all rows of the shard visit. No
rows are dropped anywhere.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orbis.llm.names import unused
from orbis.session import materialize

RADIUS = 3
LEAF = 2048
BUCKET = 64


def fingerprint_of(text: str, words: int = 3) -> int:
    from itertools import repeat

    from xxhash import xxh64_intdigest

    found = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and the six ASCII blanks only
    if not found:
        return 0
    n = max(1, len(found) - words + 1)
    grams = map(b" ".join, zip(*(found[k:] for k in range(words)))) if len(found) >= words else [b" ".join(found)]
    h = np.fromiter(map(xxh64_intdigest, grams, repeat(42)), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for k in range(0, n, 100_000):
        ones += np.unpackbits(h[k : k + 100_000].view(np.uint8), bitorder="little").reshape(-1, 64).sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """doc_id, text_hash and fp of each row. Null texts count as empty; an empty text has fingerprint 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.fromiter((fingerprint_of(t.as_py(), words) for t in b.column(2)), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fps.view(np.int64))], names=["doc_id", "text_hash", "fp"])

    return keyed(docs).select("doc_id", "text_hash", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, "doc_id long, text_hash long, fp long")


def keyed(docs: DataFrame) -> DataFrame:
    """A row's identity: its doc_id and a hash of its text."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"), F.col("text").cast("string").alias("text"))


# --- Exact pairs in a shard -------------------------------------------------------------------


def vp_pairs(own: np.ndarray, asked: np.ndarray, fp: np.ndarray, out: list) -> None:
    """Pairs of rows ``asked`` and rows ``own`` within RADIUS, by a vantage-point tree of the latter with buckets of BUCKET rows."""
    if not len(own) or not len(asked):
        return
    d = np.bitwise_count(fp[own] ^ fp[own[0]])
    split = int(np.partition(d, (len(d) - 1) // 2)[(len(d) - 1) // 2])
    if len(own) <= BUCKET or split == d.max():  # a bucket, or most at one distance: no split parts them
        for k in range(0, len(asked), 1024):
            part = asked[k : k + 1024]
            for m in range(0, len(own), 1024):
                i, j = np.nonzero(np.bitwise_count(fp[part][:, None] ^ fp[own[m : m + 1024]][None, :]) <= RADIUS)
                keep = part[i] != own[m + j]
                if keep.any():
                    out.append((part[i[keep]], own[m + j[keep]]))
        return
    to = np.bitwise_count(fp[asked] ^ fp[own[0]]).astype(int)
    vp_pairs(own[d <= split], asked[to <= split + RADIUS], fp, out)
    vp_pairs(own[d > split], asked[to > split - RADIUS], fp, out)


def forest(n: int, pairs: list) -> np.ndarray:
    """The smallest row linked to each of n rows, directly or through others."""
    label = np.arange(n)
    if not pairs:
        return label
    a, b = np.concatenate([p[0] for p in pairs]), np.concatenate([p[1] for p in pairs])
    while True:
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        label = label[label]
        if (label == before).all() and (label[a] == label[b]).all():
            return label


def _shard_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spanning links of each run of equal keys: (key, home, fp) rows sorted by key."""

    def flush(table: pa.Table) -> pa.RecordBatch:
        key, home, fp = table.column(0).to_numpy(), table.column(1).to_numpy().astype(bool), table.column(2).to_numpy().astype(np.int64).view(np.uint64)
        starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        found: list = []
        for s, e in zip(starts, [*starts[1:], len(fp)]):
            pairs: list = []
            vp_pairs(s + np.flatnonzero(home[s:e]), np.arange(s, e), fp, pairs)
            if pairs:
                root = s + forest(e - s, [(a - s, b - s) for a, b in pairs])
                kept = np.flatnonzero(root != np.arange(s, e))
                found.append((fp[root[kept]], fp[s + kept]))
        a, b = (np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.uint64) for k in (0, 1))
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) < 50_000:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        key = table.column(0).to_numpy()
        cut = int(np.flatnonzero(key == key[-1])[0])  # the last run may go on
        if cut:
            yield flush(table.slice(0, cut))
        held = table.slice(cut).to_batches()
    if held and (table := pa.Table.from_batches(held)).num_rows:
        yield flush(table.combine_chunks())


# --- Routing ----------------------------------------------------------------------------------


def vantage_points(first: int, n: int) -> list[int]:
    """Fixed, evenly mixed points of 32 bits: multiples of an odd constant near 2^64 / golden ratio."""
    return [(k * 0x9E3779B97F4A7C15 & (1 << 64) - 1) >> 32 for k in range(first + 1, first + n + 1)]


def half(tree: int) -> Column:
    return F.shiftrightunsigned("fp", 32) if tree == 0 else F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF))


def levels_for(rows: DataFrame, first: int, n: int) -> list[list[tuple[int, int]]]:
    """For each tree, the vantage point of each level and the median of the rows' distances to it."""
    points = vantage_points(first, n)
    medians = [F.percentile_approx(F.when(F.col("tree") == t, F.bit_count(half(t).bitwiseXOR(F.lit(v)))), 0.5) for t in (0, 1) for v in points]
    found = rows.filter("home").agg(*[m.alias(f"m{k}") for k, m in enumerate(medians)]).first()
    return [[(v, 16 if found[t * n + k] is None else int(found[t * n + k])) for k, v in enumerate(points)] for t in (0, 1)]


def routed(rows: DataFrame, levels: list[list[tuple[int, int]]]) -> DataFrame:
    """Each row (tree, shard, home, fp) in the shards below its own that its ball of radius 1 meets; at home, if it was, in one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, 5000):
                b = whole.slice(k, 5000)
                tree, shard, home, fp = (b.column(c).to_numpy(zero_copy_only=False) for c in range(4))
                code = np.where(tree == 0, fp.view(np.uint64) >> np.uint64(32), fp.view(np.uint64) & np.uint64(0xFFFFFFFF))
                row, home = np.arange(len(fp)), home.astype(bool)
                for level in range(len(levels[0])):
                    v, t = (np.array([own[level][x] for own in levels], np.uint64)[tree] for x in (0, 1))
                    d, t = np.bitwise_count(code ^ v).astype(int)[row], t.astype(int)[row]
                    inner, outer = d <= t + 1, d >= t
                    shard, home = np.concatenate([2 * shard[inner], 2 * shard[outer] + 1]), np.concatenate([(home & (d <= t))[inner], (home & (d > t))[outer]])
                    row = np.concatenate([row[inner], row[outer]])
                yield pa.RecordBatch.from_arrays([pa.array(tree[row], pa.int32()), pa.array(shard, pa.int64()), pa.array(home), pa.array(fp[row], pa.int64())], names=["tree", "shard", "home", "fp"])

    return rows.select("tree", "shard", "home", "fp").mapInArrow(run, "tree int, shard long, home boolean, fp long")


def links(fps: DataFrame, leaf: int = LEAF) -> DataFrame:
    """Spanning links (a, b) between distinct fingerprints fp that differ in at most RADIUS bits."""
    rows = fps.select(F.explode(F.array(F.lit(0), F.lit(1))).alias("tree"), F.lit(1).cast("long").alias("shard"), F.lit(True).alias("home"), "fp")
    most, first, found = fps.count(), 0, None
    keyed = lambda x, *tile: x.select(F.xxhash64("tree", "shard", *tile).alias("key"), "home", "fp")
    for _ in range(3):
        if most > leaf:
            n = max(1, math.ceil(math.log2(most / leaf)))
            rows, first = materialize(routed(rows, levels_for(rows, first, n)), "routed"), first + n
        sizes = rows.groupBy("tree", "shard").agg(F.sum(F.col("home").cast("int")).alias("n")).filter(F.col("n") > 4 * leaf)
        large = materialize(sizes, "large-shards")
        most = large.agg(F.max("n")).first()[0]
        if most is None:
            some, rows = rows, None
        else:
            rows = materialize(rows.join(large, ["tree", "shard"], "left"), "with-sizes")
            some, rows = rows.filter("n is null"), rows.filter("n is not null")
        found = keyed(some) if found is None else found.unionByName(keyed(some))
        if rows is None:
            break
    if rows is not None:
        k = F.ceil(F.col("n") / leaf).cast("int")
        tiles = rows.select("tree", "shard", "home", "fp", F.pmod(F.xxhash64("fp"), k).alias("own"), F.explode(F.sequence(F.lit(0), k - 1)).alias("tile"))
        found = found.unionByName(keyed(tiles.withColumn("home", F.col("home") & (F.col("own") == F.col("tile"))), F.col("tile") + 1))
    dealt = found.repartition("key").sortWithinPartitions("key")
    return dealt.mapInArrow(_shard_links, "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node and its component's smallest node, for all nodes of edges (a, b): alternating large and small stars."""
    edges = materialize(edges.filter("a <> b"), "edges")
    signature = None
    while True:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a"))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        edges = both.join(low, "u").filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        down = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct()
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(low, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).union(low.select("u", "m"))
        edges = materialize(small.filter("a <> b").distinct(), "stars")
        now = edges.agg(F.count("*").alias("n"), F.expr("bit_xor(xxhash64(a, b))").alias("x")).first()
        if now == signature:
            break
        signature = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(edges.select("b", "b").distinct())


def classes(prints: DataFrame, leaf: int = LEAF) -> DataFrame:
    """fp, n (its rows), component_id (smallest doc_id that its links reach) and keep (the smallest row there), one row for each fp."""
    key = F.struct("doc_id", "text_hash")
    each = materialize(prints.groupBy("fp").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id"), F.min(key).alias("first_row")), "distinct-prints")
    roots = materialize(components(links(each.select("fp"), leaf)), "roots")
    linked = each.join(roots, each["fp"] == roots["node"])
    merged = linked.groupBy("root").agg(F.min("first_id").alias("component_id"), F.min("first_row").alias("keep"))
    of_node = roots.join(merged, "root").select("node", "component_id", "keep")
    return each.join(of_node, each["fp"] == of_node["node"], "left").select("fp", "n", F.coalesce("component_id", "first_id").alias("component_id"), F.coalesce("keep", "first_row").alias("keep"))


def with_classes(prints: DataFrame, found: DataFrame, hot: int = 1024) -> DataFrame:
    """prints with the columns of found, joined by fp.

    Fingerprints of more than ``hot`` rows, and more than 1/4096 of all rows, are at most 4096: these are
    broadcast, so that no group of copies is dealt to one task. The others are joined by a shuffle.
    """
    total = found.agg(F.sum("n")).first()[0] or 0
    large = F.col("n") > max(hot, total // 4096)
    common = F.broadcast(found.filter(large))
    rest = prints.join(common.select("fp"), "fp", "left_anti").join(found.filter(~large), "fp")
    return prints.join(common, "fp").unionByName(rest)


def near_duplicates(docs: DataFrame, words: int = 3, leaf: int = LEAF) -> DataFrame:
    """doc_id, text_hash, fp, component_id and keep of each row.

    Rows whose fingerprints differ in at most 3 bits are linked, empty texts like any other.
    component_id is the smallest doc_id reachable; null doc_ids count only where there is no
    other. Repeated rows are linked like copies. keep is true for the rows equal to the
    component's first in order of doc_id (nulls first) and text hash.
    """
    prints = materialize(fingerprints(docs, words), "prints")
    found = materialize(classes(prints, leaf), "classes")
    same = F.col("keep")["doc_id"].eqNullSafe(F.col("doc_id")) & (F.col("keep")["text_hash"] == F.col("text_hash"))
    return with_classes(prints, found).select("doc_id", "text_hash", "fp", "component_id", same.alias("keep"))


def deduplicate(docs: DataFrame, words: int = 3, leaf: int = LEAF) -> DataFrame:
    """One row of docs from each component, with all its columns: the first in order of doc_id (nulls first) and text hash.

    Of rows that agree in both, the one with the smallest hash of all columns stays. Null texts
    count as empty; an empty table gives no rows. Columns may have any names.
    """
    own, keep_id, keep_hash, row = unused(docs.columns, "own_hash", "keep_id", "keep_hash", "row")
    kept = near_duplicates(docs, words, leaf).filter("keep").select(F.col("doc_id").alias(keep_id), F.col("text_hash").alias(keep_hash)).distinct()
    hashed = docs.withColumn(own, F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))))
    match = F.col("doc_id").cast("long").eqNullSafe(F.col(keep_id)) & (F.col(own) == F.col(keep_hash))
    columns = [F.col(f"`{c}`") for c in docs.columns]
    whole = F.xxhash64(*[F.col(f"`{f.name}`") if f.dataType.typeName() not in ("map", "variant") else F.to_json(f"`{f.name}`") for f in docs.schema])
    first = hashed.join(kept, match, "left_semi").groupBy("doc_id", own).agg(F.min_by(F.struct(*columns), whole).alias(row))
    return first.select(*[F.col(row)[c].alias(c) for c in docs.columns])
