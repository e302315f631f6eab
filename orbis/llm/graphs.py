"""Approximate nearest neighbours by robust-pruned directed graphs, one for each shard.

Equal vectors form one node that keeps their smallest ids. Each shard's graph is built in
batches: a greedy search from the entry point proposes neighbours for each new node, relaxed
distance pruning keeps a diverse few (a candidate goes if a kept one is nearer to it by the
factor ALPHA than the node is), and back edges are added and pruned alike. Queries are searched in
every shard with a beam, and the shards' finds merged by exact cosine in double precision.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orbis.session import checked_broadcast, materialize

SHARD = 4096
DEGREE = 28
BEAM = 64
ALPHA = 1.2
QUERY_BLOCK = 1024


def beam_search(x: np.ndarray, graph: np.ndarray, entry: np.ndarray, q: np.ndarray, beam: int, wide: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """Ids (-1: none) and distances of the nearest nodes found for each row of q, all rows at once.

    Each step expands the ``wide`` nearest nodes of a row's beam that weren't yet, until none are left.
    """
    rows = np.arange(len(q))[:, None]
    ids = np.full((len(q), beam), -1)
    dist = np.full((len(q), beam), np.inf, np.float32)
    done = np.ones((len(q), beam), bool)
    seen = np.zeros((len(q), len(x) + 1), bool)
    seen[:, -1] = True  # stands for "no neighbour"
    first = entry[:beam]
    ids[:, : len(first)], done[:, : len(first)] = first, False
    dist[:, : len(first)] = 1 - q @ x[first].T
    seen[:, first] = True
    order = np.argsort(dist, 1, kind="stable")
    ids, dist, done = (np.take_along_axis(v, order, 1) for v in (ids, dist, done))
    while True:
        live = np.flatnonzero(~done.all(1))
        if not len(live):
            return ids, dist
        own = rows[: len(live)]
        next_ = np.argsort(done[live], 1, kind="stable")[:, :wide]  # the beam is sorted: the first undone ones are the nearest
        node = np.where(np.take_along_axis(done[live], next_, 1), -1, np.take_along_axis(ids[live], next_, 1))
        done[live[:, None], next_] = True
        near = np.where(node[..., None] >= 0, graph[node], -1).reshape(len(live), -1)
        near = np.sort(near, 1)
        near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
        near[seen[live[:, None], near]] = -1
        seen[live[:, None], near] = True
        width = max(1, int((near >= 0).sum(1).max()))
        near = -np.sort(-near, 1)[:, :width]
        d = 1 - np.einsum("bwd,bd->bw", x[near], q[live], optimize=True)
        d[near < 0] = np.inf
        all_d = np.concatenate([dist[live], d], 1)
        order = np.argsort(all_d, 1, kind="stable")[:, :beam]
        dist[live] = np.take_along_axis(all_d, order, 1)
        ids[live] = np.take_along_axis(np.concatenate([ids[live], near], 1), order, 1)
        done[live] = np.take_along_axis(np.concatenate([done[live], near < 0], 1), order, 1)


def robust_prune(x: np.ndarray, node: np.ndarray, cand: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """At most ``degree`` of each row's candidates (-1: none): nearest first, without those a kept one covers."""
    cand = np.where(cand == node[:, None], -1, cand)
    cand = np.sort(cand, 1)
    cand[:, 1:][cand[:, 1:] == cand[:, :-1]] = -1
    own = np.sqrt(np.maximum(0, 2 - 2 * np.einsum("bcd,bd->bc", x[cand], x[node], optimize=True)))
    own[cand < 0] = np.inf
    order = np.argsort(own, 1, kind="stable")
    cand, own = np.take_along_axis(cand, order, 1), np.take_along_axis(own, order, 1)
    v = x[cand]
    between = np.sqrt(np.maximum(0, 2 - 2 * (v @ v.transpose(0, 2, 1))))
    alive = cand >= 0
    out = np.full((len(node), degree), -1)
    at = np.arange(len(node))
    for k in range(degree):
        best = np.argmax(alive, 1)
        some = alive[at, best]
        if not some.any():
            break
        out[some, k] = cand[at, best][some]
        alive &= ~(alpha * between[at, best] <= own) | ~some[:, None]
        alive[at, best] = False
    return out


def build_graph(x: np.ndarray, degree: int = DEGREE, beam: int = BEAM, alpha: float = ALPHA, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Edges (n, degree; -1: none) and entry points of a graph over unit vectors x."""
    n = len(x)
    rng = np.random.default_rng(seed)
    graph = np.full((n, degree), -1)
    middle = int(np.argmax(x @ x.mean(0)))
    order = np.concatenate([[middle], rng.permutation(np.delete(np.arange(n), middle))])
    entry = order[: min(n, 8)]
    # The first few see each other; then ever larger batches search the graph so far.
    seedlings = order[: min(n, 64)]
    graph[seedlings] = robust_prune(x, seedlings, np.tile(seedlings, (len(seedlings), 1)), degree, alpha)
    for start, again in [(0, True)] + [(0, False)]:
        k = len(seedlings) if again else 0
        while k < n:
            batch = order[k : k + (min(512, max(32, k)) if again else 512)]
            found, _ = beam_search(x, graph, entry, x[batch], beam)
            graph[batch] = robust_prune(x, batch, np.concatenate([found, graph[batch]], 1), degree, alpha)
            source, target = np.repeat(batch, degree), graph[batch].ravel()
            source, target = source[target >= 0], target[target >= 0]
            by = np.argsort(target, kind="stable")
            source, target = source[by], target[by]
            nodes, first, count = np.unique(target, return_index=True, return_counts=True)
            for a in range(0, len(nodes), 512):
                own, f, c = nodes[a : a + 512], first[a : a + 512], count[a : a + 512]
                back = np.full((len(own), int(c.max())), -1)
                place = np.arange(back.shape[1])
                valid = place[None, :] < c[:, None]
                back[valid] = source[(f[:, None] + place)[valid]]
                if back.shape[1] > 3 * degree:  # a hub: its nearest proposals, the rest reach it as their own neighbour
                    d = 1 - np.einsum("bcd,bd->bc", x[back], x[own], optimize=True)
                    d[back < 0] = np.inf
                    back = np.take_along_axis(back, np.argsort(d, 1, kind="stable")[:, : 3 * degree], 1)
                both = np.concatenate([graph[own], back], 1)
                graph[own] = robust_prune(x, own, both, degree, alpha)
            k += len(batch)
        if n <= 64:
            break
    return graph, entry


def unit(v: np.ndarray) -> np.ndarray:
    scaled = v / np.abs(v).max(1, keepdims=True)  # first, so that squares neither overflow nor vanish
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosines of vectors a (d) with rows of b, in double precision."""
    return unit(b) @ unit(a[None, :])[0]


def valid_vectors(rows: DataFrame) -> DataFrame:
    """vec_id and v (array of double) of the rows that take part, repeated ones once."""
    v = F.col("embedding").cast("array<double>")
    good = F.col("vec_id").isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return rows.filter(F.coalesce(good, F.lit(False))).select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).distinct()


def build_index(rows: DataFrame, *, k: int = 5, shard: int = SHARD, degree: int = DEGREE, beam: int = BEAM) -> DataFrame:
    """One row a shard: dim, shard, n, ids (up to k + 1 smallest of each node), vectors, graph and entry as bytes. All valid rows are indexed."""
    vectors = valid_vectors(rows)
    order = Window.partitionBy("v").orderBy("vec_id")
    few = vectors.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= k + 1)  # the others of equal vectors can't be among the k nearest
    nodes = materialize(few.groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")), "nodes")
    sizes = nodes.groupBy(F.size("v").alias("dim")).agg(F.ceil(F.count("*") / shard).cast("long").alias("shards"))
    dealt = nodes.withColumn("dim", F.size("v")).join(checked_broadcast(sizes, sizes.count()), "dim").withColumn("shard", F.pmod(F.xxhash64("ids"), F.col("shards")))

    def build(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("ids", key=lambda c: c.map(lambda i: i[0])).reset_index(drop=True)
        v = np.stack(part["v"].to_numpy()).astype(np.float64)
        graph, entry = build_graph(unit(v).astype(np.float32), degree, beam)
        ids = np.full((len(v), k + 1), -1, np.int64)
        count = part["ids"].map(len).to_numpy()
        for row, own in enumerate(part["ids"]):
            ids[row, : len(own)] = own
        return pd.DataFrame({"dim": [v.shape[1]], "shard": [part["shard"][0]], "n": [len(v)], "ids": [ids.tobytes()], "counts": [count.astype(np.int32).tobytes()], "vectors": [v.tobytes()], "graph": [graph.astype(np.int32).tobytes()], "entry": [entry.astype(np.int32).tobytes()]})

    schema = "dim int, shard long, n int, ids binary, counts binary, vectors binary, graph binary, entry binary"
    return materialize(dealt.select("dim", "shard", "v", "ids").groupBy("dim", "shard").applyInPandas(build, schema), "graphs")


def search(index: DataFrame, queries: DataFrame, *, k: int = 5, beam: int = BEAM, block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k nearest found by cosine, ties to the smaller vec_id, its own id left out.

    queries have vec_id and embedding. Vectors that are null, zero or hold null or non-finite
    components take no part, on either side, and only vectors of equal length are compared. A
    query id with several vectors is searched with the smallest of them. Fewer than k candidates: all of
    them. Queries go in blocks to every shard; a block and a shard are one row each.
    """
    own = valid_vectors(queries).groupBy("vec_id").agg(F.min("v").alias("v")).withColumn("dim", F.size("v"))
    own = materialize(own, "queries")
    blocks = own.groupBy("dim").agg(F.ceil(F.count("*") / block).cast("long").alias("blocks"))
    dealt = own.join(checked_broadcast(blocks, blocks.count()), "dim").withColumn("block", F.pmod(F.xxhash64("vec_id"), F.col("blocks")))
    packed = dealt.groupBy("dim", "block").agg(F.collect_list("vec_id").alias("q_ids"), F.flatten(F.collect_list("v")).alias("q_vectors"))
    # A row for each length of vectors; a block names its shards by itself, as a join by length would have one key.
    shards = index.groupBy("dim").agg(F.max("shard").alias("last"))
    numbers = F.explode(F.sequence(F.lit(0).cast("long"), F.col("last"))).alias("shard")
    sent = packed.join(checked_broadcast(shards, shards.count()), "dim").select("dim", "q_ids", "q_vectors", numbers)
    pairs = sent.join(index, ["dim", "shard"]).select("dim", "q_ids", "q_vectors", "n", "ids", "counts", "vectors", "graph", "entry")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            for r in part.itertuples():
                v = np.frombuffer(r.vectors, np.float64).reshape(r.n, r.dim)
                graph = np.frombuffer(r.graph, np.int32).reshape(r.n, -1).astype(np.int64)
                ids = np.frombuffer(r.ids, np.int64).reshape(r.n, -1)
                q = np.asarray(r.q_vectors, np.float64).reshape(-1, r.dim)
                found, _ = beam_search(unit(v).astype(np.float32), graph, np.frombuffer(r.entry, np.int32), unit(q).astype(np.float32), beam)
                found = found[:, : min(beam, 4 * k)]
                exact = np.einsum("bwd,bd->bw", unit(v)[found], unit(q), optimize=False)
                row, col = np.nonzero(found >= 0)
                node = found[row, col]
                each = ids[node]  # the ids of a node share its score
                place, which = np.nonzero(each >= 0)
                out = pd.DataFrame({"query_id": np.asarray(r.q_ids)[row[place]], "vec_id": each[place, which], "score": exact[row, col][place]})
                out = out[out["query_id"] != out["vec_id"]].sort_values(["query_id", "score", "vec_id"], ascending=[True, False, True])
                yield out.groupby("query_id").head(k)

    found = pairs.mapInPandas(run, "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.distinct().withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
