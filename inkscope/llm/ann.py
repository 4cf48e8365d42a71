"""Approximate nearest neighbours by a robust-pruned directed graph per shard.

Vectors are dealt to shards by a hash of their id.  In a shard, equal vectors
are one node that knows its smallest ids.  The graph grows in batches: a greedy
beam search from the medoid proposes a node's neighbours, relaxed pruning keeps
the diverse ones (a candidate goes if a kept neighbour is nearer to it, by the
factor ``alpha``, than the node is), and edges back are added and pruned alike.
Inner product becomes a distance through one more coordinate that gives all
vectors of a shard the same length.

Queries visit every shard, in blocks; a beam search returns the best nodes, which
are scored again in double precision on the original vectors.  The per-shard
lists are merged by score, ties to the smaller id.

Null and zero vectors, and such as hold null or non-finite components, take no
part.  Vectors meet only vectors of their own dimension.  Of repeated query ids
one is searched.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

DEGREE = 32
BUILD_BEAM = 64
BEAM = 200
ALPHA = 1.2
SHARD_ROWS = 50_000
LEAST_SHARDS = 6
QUERY_BLOCK = 20_000


def _rows_dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.einsum("nd,nd->n", a, b)


class Graph:
    """A pruned neighbour graph over distinct vectors (rows of ``vectors``)."""

    def __init__(self, vectors: np.ndarray, neighbours: np.ndarray | None = None, entry: int = 0):
        self.vectors = np.ascontiguousarray(vectors, np.float32)
        self.neighbours, self.entry = neighbours, entry

    @classmethod
    def build(cls, vectors: np.ndarray, degree: int = DEGREE, beam: int = BUILD_BEAM, alpha: float = ALPHA, seed: int = 3) -> Graph:
        n = len(vectors)
        wide = vectors.astype(np.float64)
        norm = (wide * wide).sum(1)
        lift = np.sqrt(np.maximum(norm.max() - norm, 0))
        space = np.concatenate([wide, lift[:, None]], 1).astype(np.float32)
        self = cls(space, np.full((n, degree), -1, np.int32), int((space @ space.mean(0)).argmax()))
        self.length = float(norm.max())
        order = np.random.default_rng(seed).permutation(n)
        order = np.concatenate([[self.entry], order[order != self.entry]])
        done = 1
        while done < n:
            batch = order[done : done + max(1, min(done, 1_024))]
            ids, seen = self.search(space[batch], beam, with_seen=True)
            found = np.concatenate([ids, seen], 1)
            found[found == batch[:, None]] = -1
            self.neighbours[batch] = self._prune(batch, found, degree, alpha)
            self._link_back(batch, degree, alpha)
            done += len(batch)
        self.vectors = np.ascontiguousarray(vectors, np.float32)
        return self

    def _prune(self, nodes: np.ndarray, candidates: np.ndarray, degree: int, alpha: float) -> np.ndarray:
        """Diverse neighbours of ``nodes`` out of ``candidates`` (-1: none)."""
        out = np.full((len(nodes), degree), -1, np.int32)
        for begin in range(0, len(nodes), 256):
            rows = slice(begin, begin + 256)
            c = np.sort(candidates[rows], 1)
            c[:, 1:][c[:, 1:] == c[:, :-1]] = -1
            v = self.vectors[c]
            near = np.einsum("bcd,bd->bc", v, self.vectors[nodes[rows]])
            far = np.maximum(2 * (self.length - near), 0)  # squared distance to the node
            far[c < 0] = np.inf
            keep = min(c.shape[1], 4 * degree)
            best = np.argsort(far, 1, kind="stable")[:, :keep]
            c, far, v = np.take_along_axis(c, best, 1), np.take_along_axis(far, best, 1), np.take_along_axis(v, best[:, :, None], 1)
            between = np.maximum(2 * (self.length - v @ v.transpose(0, 2, 1)), 0) * (alpha * alpha)
            live = np.isfinite(far)
            row = np.arange(len(c))
            for k in range(degree):
                some = live.any(1)
                if not some.any():
                    break
                pick = live.argmax(1)  # candidates are sorted: the nearest left
                out[rows][some, k] = c[row, pick][some]
                live &= between[row, pick] > far
                live[row, pick] = False
        return out

    def _link_back(self, batch: np.ndarray, degree: int, alpha: float) -> None:
        to = self.neighbours[batch].ravel()
        of = np.repeat(batch, degree)[to >= 0]
        to = to[to >= 0]
        order = np.argsort(to, kind="stable")
        to, of = to[order], of[order]
        targets, first, count = np.unique(to, return_index=True, return_counts=True)
        have = (self.neighbours[targets] >= 0).sum(1)
        fits = have + count <= degree
        slot = np.arange(len(to)) - np.repeat(first, count) + np.repeat(have, count)
        direct = np.repeat(fits, count)
        self.neighbours[to[direct], slot[direct]] = of[direct]
        over = np.flatnonzero(~fits)
        over = over[np.argsort(count[over])]
        for begin in range(0, len(over), 512):
            part = over[begin : begin + 512]
            found = np.full((len(part), degree + int(count[part].max())), -1, np.int32)
            found[:, :degree] = self.neighbours[targets[part]]
            for r, k in enumerate(part):
                found[r, degree : degree + count[k]] = of[first[k] : first[k] + count[k]]
            self.neighbours[targets[part]] = self._prune(targets[part], found, degree, alpha)

    def search(self, queries: np.ndarray, beam: int, with_seen: bool = False, wide: int = 4):
        """Ids [Q, beam] nearest first (-1: none); optionally the expanded nodes."""
        n = len(self.vectors)
        beam = min(beam, n)
        block = max(1, min(1_024, (96 << 20) // (4 * n)))
        ids_out = np.full((len(queries), beam), -1, np.int32)
        seen_out: list[np.ndarray] = []
        for begin in range(0, len(queries), block):
            q = np.ascontiguousarray(queries[begin : begin + block], np.float32)
            ids_out[begin : begin + block], seen = self._search_block(q, beam, wide, with_seen)
            if with_seen:
                seen_out.append(seen)
        if not with_seen:
            return ids_out
        most = max(s.shape[1] for s in seen_out)
        return ids_out, np.concatenate([np.pad(s, ((0, 0), (0, most - s.shape[1])), constant_values=-1) for s in seen_out])

    def _search_block(self, q: np.ndarray, beam: int, wide: int, with_seen: bool):
        total = len(q)
        stamp = np.zeros((total, len(self.vectors)), np.int32)
        ids = np.full((total, beam), -1, np.int32)
        sim = np.full((total, beam), -np.inf, np.float32)
        open_ = np.zeros((total, beam), bool)
        ids[:, 0], sim[:, 0], open_[:, 0] = self.entry, q @ self.vectors[self.entry], True
        stamp[:, self.entry] = 1
        rows = np.arange(total)
        seen: list[np.ndarray] = []
        while rows.size:
            score = np.where(open_[rows], sim[rows], -np.inf)
            w = min(wide, beam)
            pick = np.argpartition(-score, w - 1, axis=1)[:, :w]
            ok = np.take_along_axis(score, pick, 1) > -np.inf
            node = np.where(ok, np.take_along_axis(ids[rows], pick, 1), -1)
            open_[rows[:, None], pick] = False
            if with_seen:
                step = np.full((total, w), -1, np.int32)
                step[rows] = node
                seen.append(step)
            near = self.neighbours[node].reshape(len(rows), -1)
            near[np.repeat(node < 0, self.neighbours.shape[1], axis=1)] = -1
            r, col = np.nonzero(near >= 0)
            target = near[r, col]
            at = rows[r]
            fresh = stamp[at, target] == 0
            r, col, target, at = r[fresh], col[fresh], target[fresh], at[fresh]
            stamp[at, target] = col + 2
            only = stamp[at, target] == col + 2  # one of several equal ones
            r, col, target, at = r[only], col[only], target[only], at[only]
            got = np.full(near.shape, -np.inf, np.float32)
            got[r, col] = _rows_dot(self.vectors[target], q[at])
            all_ids = np.concatenate([ids[rows], near], 1)
            all_sim = np.concatenate([sim[rows], got], 1)
            all_open = np.concatenate([open_[rows], got > -np.inf], 1)
            top = np.argpartition(-all_sim, beam - 1, axis=1)[:, :beam]
            ids[rows], sim[rows], open_[rows] = (np.take_along_axis(a, top, 1) for a in (all_ids, all_sim, all_open))
            rows = rows[open_[rows].any(1)]
        best = np.argsort(-sim, 1, kind="stable")
        ids = np.where(np.take_along_axis(sim, best, 1) > -np.inf, np.take_along_axis(ids, best, 1), -1)
        return ids, (np.concatenate(seen, 1) if seen else np.zeros((total, 0), np.int32))


def usable(column: str):
    """Vectors that take part: finite components throughout, not all zero."""
    bad = f"x -> x is null or isnan(x) or abs(x) = double('infinity')"
    return F.expr(f"{column} is not null and size({column}) > 0 and not exists({column}, {bad}) and exists({column}, x -> x <> 0)")


def _matrix(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    flat = pa.concat_arrays([c.flatten() for c in column.chunks]) if column.num_chunks else pa.array([], pa.float64())
    return flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _build_shard(key, rows: pa.Table, degree: int, beam: int, alpha: float, k: int) -> pa.Table:
    dim, shard = key[0].as_py(), key[1].as_py()
    vectors, ids = _matrix(rows.column("vector"), dim), rows.column("id").to_numpy()
    _, first, node = np.unique(vectors, axis=0, return_index=True, return_inverse=True)
    order = np.lexsort((ids, node.ravel()))
    node, ids = node.ravel()[order], ids[order]
    rank = np.arange(len(node)) - np.searchsorted(node, node)
    kept = rank <= k  # of copies, a query can need so many at most
    graph = Graph.build(vectors[first], degree, beam, alpha)
    return pa.table(
        {
            "dim": pa.array([dim], pa.int32()),
            "shard": pa.array([shard], pa.int32()),
            "entry": pa.array([graph.entry], pa.int32()),
            "vectors": [vectors[first].tobytes()],
            "neighbours": [graph.neighbours.tobytes()],
            "ids": [ids[kept].astype(np.int64).tobytes()],
            "nodes": [node[kept].astype(np.int32).tobytes()],
        }
    )


_GRAPH = "dim int, shard int, entry int, vectors binary, neighbours binary, ids binary, nodes binary"


def _search_shard(key, queries: pa.Table, graphs: pa.Table, beam: int, k: int) -> pa.Table:
    out = {"query_id": [], "id": [], "score": []}
    if queries.num_rows and graphs.num_rows:
        dim = key[0].as_py()
        row = {n: graphs.column(n)[0].as_py() for n in graphs.column_names}
        vectors = np.frombuffer(row["vectors"], np.float64).reshape(-1, dim)
        neighbours = np.frombuffer(row["neighbours"], np.int32).reshape(len(vectors), -1)
        ids, nodes = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["nodes"], np.int32)
        first = np.searchsorted(nodes, np.arange(len(vectors) + 1))
        q, qid = _matrix(queries.column("vector"), dim), queries.column("id").to_numpy()
        found = Graph(vectors, neighbours, row["entry"]).search(q, max(beam, k + 1))
        for begin in range(0, len(q), 1_024):
            part = found[begin : begin + 1_024]
            r, c = np.nonzero(part >= 0)
            node = part[r, c]
            score = (vectors[node] * q[begin + r]).sum(1)
            best = np.lexsort((-score, r))
            r, node, score = r[best], node[best], score[best]
            place = np.arange(len(r)) - np.searchsorted(r, r)
            # nodes tied with the last one needed stay, whatever their ids
            last = np.full(len(part), -np.inf)
            last[r[place == k]] = score[place == k]
            near = (place <= k) | (score >= last[r])
            r, node, score = r[near], node[near], score[near]
            copies = first[node + 1] - first[node]
            at = np.repeat(first[node] - np.cumsum(copies) + copies, copies) + np.arange(copies.sum())
            r, score, found_ids = np.repeat(r, copies), np.repeat(score, copies), ids[at]
            own = found_ids != qid[begin + r]
            r, score, found_ids = r[own], score[own], found_ids[own]
            best = np.lexsort((found_ids, -score, r))
            r, score, found_ids = r[best], score[best], found_ids[best]
            top = np.arange(len(r)) - np.searchsorted(r, r) < k
            out["query_id"].append(qid[begin + r[top]])
            out["id"].append(found_ids[top])
            out["score"].append(score[top])
    join = lambda n, t: np.concatenate(out[n]) if out[n] else np.zeros(0, t)
    return pa.table({"query_id": pa.array(join("query_id", np.int64), pa.int64()), "id": pa.array(join("id", np.int64), pa.int64()), "score": pa.array(join("score", np.float64), pa.float64())})


def search(
    base: DataFrame, queries: DataFrame, k: int = 20, key: str = "vec_id", vector: str = "embedding",
    degree: int = DEGREE, build_beam: int = BUILD_BEAM, beam: int = BEAM, alpha: float = ALPHA, shard_rows: int = SHARD_ROWS,
) -> DataFrame:
    """(query_id, rank, id, score): the ``k`` nearest found for each query.

    ``beam`` trades work for recall.  A query's own id is never its neighbour.
    """
    pick = lambda df: df.where(F.col(key).isNotNull() & usable(vector)).select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vector")).withColumn("dim", F.size("vector"))
    base, queries = pick(base), pick(queries).dropDuplicates(["id"])
    shards = max(LEAST_SHARDS, -(-base.count() // shard_rows))
    blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    dealt = base.withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int"))
    graphs = dealt.groupBy("dim", "shard").applyInArrow(lambda key, rows: _build_shard(key, rows, degree, build_beam, alpha, k), _GRAPH)
    graphs = graphs.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    asked = queries.withColumn("block", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(blocks)).cast("int")).withColumn(
        "shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))
    )
    found = (
        asked.groupBy("dim", "shard", "block")
        .cogroup(graphs.groupBy("dim", "shard", "block"))
        .applyInArrow(lambda key, q, g: _search_shard(key, q, g, beam, k), "query_id bigint, id bigint, score double")
    )
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")


def exact(base: pd.DataFrame, queries: pd.DataFrame, k: int, key: str = "vec_id", vector: str = "embedding") -> dict[int, list[int]]:
    """Brute force for small tables: the ``k`` nearest ids of each query id."""
    ids = base[key].to_numpy()
    m = np.stack([np.asarray(v, np.float64) for v in base[vector]])
    out = {}
    for q, v in zip(queries[key], queries[vector]):
        score = (m * np.asarray(v, np.float64)).sum(1)
        best = [i for i in np.lexsort((ids, -score)) if ids[i] != q][:k]
        out[int(q)] = [int(ids[i]) for i in best]
    return out
