"""Approximate nearest neighbours over robust-pruned directed graphs.

Distinct vectors are dealt to shards of bounded size.  A shard's graph starts random; greedy
searches for every vector propose its neighbours, and pruning with a relaxed distance keeps
those that lead in different directions.  A query is searched with a beam in every shard, its
finds are scored exactly, and the best over all shards are kept.

Rows with the same vector are one node that carries its smallest ids: with k nearest wanted,
no id beyond the k + 1 smallest of a node can be among them.
"""

from __future__ import annotations

import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import staged

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _unit(vectors: np.ndarray) -> np.ndarray:
    return (vectors / np.sqrt((vectors * vectors).sum(axis=1, keepdims=True)))


def beam_search(unit: np.ndarray, graph: np.ndarray, entry: int, targets: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """Node ids and distances (1 - cosine), nearest first, of a beam search for each target; -1 pads."""
    n, b = len(unit), len(targets)
    ids = np.full((b, beam), -1, dtype=np.int64)
    dist = np.full((b, beam), np.inf, dtype=np.float64)
    done = np.ones((b, beam), dtype=bool)
    seen = np.zeros((b, n + 1), dtype=bool)  # the last column takes the padding
    seen[:, n] = True
    ids[:, 0], done[:, 0], seen[:, entry] = entry, False, True
    dist[:, 0] = 1 - targets @ unit[entry]
    active = np.arange(b)
    while len(active):
        at = np.argmin(np.where(done[active], np.inf, dist[active]), axis=1)
        done[active, at] = True
        near = graph[ids[active, at]]
        near = np.where(near < 0, n, near)
        fresh = ~seen[active[:, None], near]
        seen[active[:, None], near] = True
        rows, cols = np.nonzero(fresh)
        new = np.full(near.shape, np.inf, dtype=np.float64)
        if len(rows):
            new[rows, cols] = 1 - np.einsum("ij,ij->i", targets[active[rows]], unit[near[rows, cols]])
        every = np.concatenate([dist[active], new], axis=1)
        best = np.argsort(every, axis=1, kind="stable")[:, :beam]
        dist[active] = np.take_along_axis(every, best, axis=1)
        ids[active] = np.take_along_axis(np.concatenate([ids[active], np.where(fresh, near, -1)], axis=1), best, axis=1)
        done[active] = np.take_along_axis(np.concatenate([done[active], ~fresh], axis=1), best, axis=1)
        active = active[~done[active].all(axis=1)]
    return ids, dist


def robust_prune(unit: np.ndarray, points: np.ndarray, proposed: np.ndarray, degree: int, relax: float) -> np.ndarray:
    """At most ``degree`` neighbours of each point: the nearest left is kept, and whatever is nearer
    to it, by the factor ``relax``, than to the point is dropped; -1 pads."""
    cand = np.sort(np.where(proposed == points[:, None], -1, proposed), axis=1)
    cand[:, 1:][cand[:, 1:] == cand[:, :-1]] = -1
    vectors = unit[np.maximum(cand, 0)]
    to_point = np.sqrt(np.maximum(2 - 2 * np.einsum("bcd,bd->bc", vectors, unit[points]), 0))
    to_point = np.where(cand < 0, np.inf, to_point)
    between = np.sqrt(np.maximum(2 - 2 * np.matmul(vectors, vectors.transpose(0, 2, 1)), 0))
    out = np.full((len(points), degree), -1, dtype=np.int64)
    left, every = to_point.copy(), np.arange(len(points))
    for k in range(degree):
        at = np.argmin(left, axis=1)
        some = np.isfinite(left[every, at])
        if not some.any():
            break
        out[some, k] = cand[every, at][some]
        left[some[:, None] & (relax * between[every, at] <= to_point)] = np.inf
        left[every, at] = np.inf
    return out


def build_graph(unit: np.ndarray, degree: int, beam: int, relax: float, seed: int = 7, batch: int = 128) -> tuple[np.ndarray, int]:
    """Neighbour ids of every vector (-1 pads) and the entry node, the one nearest to the mean."""
    n, rng = len(unit), np.random.default_rng(seed)
    entry = int(np.argmax(unit @ unit.mean(axis=0)))
    graph = np.full((n, degree), -1, dtype=np.int64)
    if n > 1:
        graph = rng.integers(0, n, size=(n, degree))
        graph[graph == np.arange(n)[:, None]] = -1
    order = rng.permutation(n)
    for factor in (1.0, relax):
        for start in range(0, n, batch):
            points = order[start : start + batch]
            found, _ = beam_search(unit, graph, entry, unit[points], beam)
            graph[points] = robust_prune(unit, points, np.concatenate([found, graph[points]], axis=1), degree, factor)
            back: dict[int, list[int]] = {}
            for p, near in zip(points.tolist(), graph[points].tolist(), strict=True):
                for q in near:
                    if q >= 0:
                        back.setdefault(q, []).append(p)
            held = np.array(sorted(back), dtype=np.int64)
            if not len(held):
                continue
            more = np.full((len(held), max(map(len, back.values()))), -1, dtype=np.int64)
            for k, q in enumerate(held.tolist()):
                more[k, : len(back[q])] = back[q]
            for part in range(0, len(held), batch):  # bounds the memory of the pairwise distances
                q = held[part : part + batch]
                graph[q] = robust_prune(unit, q, np.concatenate([graph[q], more[part : part + batch]], axis=1), degree, factor)
    return graph, entry


def usable(vector: Column) -> Column:
    """Not null or zero, and without null or non-finite components."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & fine & F.exists(vector, lambda x: x != 0)


def index(vectors: DataFrame, k: int = 5, shard_rows: int = 4096, degree: int = 32, beam: int = 64, relax: float = 1.2) -> DataFrame:
    """The staged graphs of ``vectors`` (vec_id, embedding): shard, node, ids, embedding, near, entry.

    Every usable vector is indexed.  Vectors of another length lie in shards of their own.
    """
    rows = vectors.where(F.col("vec_id").isNotNull() & usable(F.col("embedding"))).select("vec_id", "embedding").distinct()
    first = Window.partitionBy("embedding").orderBy("vec_id")
    rows = rows.withColumn("place", F.row_number().over(first)).where(F.col("place") <= k + 1)
    nodes = staged(rows.groupBy("embedding").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")))
    shards = max(1, -(-nodes.count() // shard_rows))
    nodes = nodes.withColumn("dim", F.size("embedding")).withColumn("shard", F.pmod(F.xxhash64("embedding"), F.lit(shards)).cast("int"))

    def built(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("ids", key=lambda s: s.map(lambda x: x[0])).reset_index(drop=True)
        graph, entry = build_graph(_unit(np.stack(frame["embedding"].to_numpy()).astype(np.float64)), degree, beam, relax)
        near = [row[row >= 0].tolist() for row in graph]
        return frame.assign(node=np.arange(len(frame)), near=near, entry=entry)[["dim", "shard", "node", "ids", "embedding", "near", "entry"]]

    kind = vectors.schema["embedding"].dataType.simpleString()
    schema = f"dim int, shard int, node int, ids array<bigint>, embedding {kind}, near array<int>, entry int"
    return staged(nodes.groupBy("dim", "shard").applyInPandas(built, schema))


def _searched(k: int, beam: int):
    def searched(graph: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        columns = ["query_id", "vec_id", "score"]
        if not len(graph) or not len(queries):
            return pd.DataFrame([], columns=columns)
        graph = graph.sort_values("node").reset_index(drop=True)
        original = np.stack(graph["embedding"].to_numpy()).astype(np.float64)
        norms, unit = np.sqrt((original * original).sum(axis=1)), _unit(original)
        near = np.full((len(graph), max(1, graph["near"].map(len).max())), -1, dtype=np.int64)
        for row, x in enumerate(graph["near"]):
            near[row, : len(x)] = x
        ids, out = graph["ids"].tolist(), []
        for start in range(0, len(queries), 256):
            part = queries.iloc[start : start + 256]
            asked = np.stack(part["embedding"].to_numpy()).astype(np.float64)
            found, _ = beam_search(unit, near, int(graph["entry"][0]), _unit(asked), beam)
            for query_id, q, nodes in zip(part["vec_id"], asked, found, strict=True):
                nodes = nodes[nodes >= 0]
                scores = (original[nodes] @ q) / (norms[nodes] * np.sqrt(q @ q))
                hits = [(-s, i) for s, node in zip(scores.tolist(), nodes.tolist(), strict=True) for i in ids[node] if i != query_id]
                out += [(query_id, i, -s) for s, i in sorted(hits)[:k]]
        return pd.DataFrame(out, columns=columns)

    return searched


def search(graphs: DataFrame, queries: DataFrame, k: int = 5, beam: int = 160, block: int = 4096) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest found for every usable row of ``queries``.

    Queries go to every shard of their length in blocks of about ``block``, so a task holds one
    shard and one block.  Ties go to the smaller vec_id; a query's own row is no candidate,
    other rows with its vector are.  Fewer than ``k`` candidates give fewer rows; an empty index
    or no queries give none.  Repeated query rows count once.
    """
    asked = staged(queries.where(F.col("vec_id").isNotNull() & usable(F.col("embedding"))).select("vec_id", "embedding").dropDuplicates(["vec_id"]))
    blocks = max(1, -(-asked.count() // block))
    shards = graphs.select("dim", "shard").distinct()
    left = graphs.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    right = asked.withColumn("dim", F.size("embedding")).withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int"))
    right = right.join(shards.groupBy("dim").agg(F.collect_list("shard").alias("shards")), "dim")
    right = right.select("vec_id", "embedding", "dim", "block", F.explode("shards").alias("shard"))
    keys = ["dim", "shard", "block"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(_searched(k, beam), "query_id bigint, vec_id bigint, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
