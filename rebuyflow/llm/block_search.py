"""Nearest neighbours by a block matrix join.

Vectors are dealt to blocks by a hash of their id; queries go to every block (a stated query set against all rows).
Each block is held once as int8 codes, and query batches stream past it. An int8 product tile approximates all inner
products; with the norms of what quantisation left over (r = v - scale * codes) the error of q.b is at most
|r_q| |b| + |q - r_q| |r_b|, which bounds every distance from both sides. Pairs whose lower bound does not exceed the
query's k-th smallest upper bound survive and are recomputed in double precision, so nothing is lost. The k best of
each tile are merged across blocks by heaps.

Vectors that are null, zero or hold null or non-finite parts take no part, nor do vectors of another length than the
query's. A repeated id counts once. Ties go to the smaller id. Fewer than k candidates: all of them. Empty table: no
rows. A third of all vectors being equal only makes ties: blocks are even, since they follow the id.
"""
from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rebuyflow.llm.tables import small_batches
from rebuyflow.llm.vectors import matrix, usable_vectors
from rebuyflow.plans.stages import stage

BLOCK_ROWS = 8192
STRIP = 128
"""Queries of one product tile: STRIP x BLOCK_ROWS doubles are held a few times."""


HUGE, TINY = 1e140, 1e-140


def extreme(v: np.ndarray) -> bool:
    """Whether squares of these components may leave the range of doubles."""
    largest = np.abs(v).max(axis=1)
    return bool(((largest > HUGE) | (largest < TINY)).any())


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distance of each row pair; pairs out of range are scaled by a power of two first, which is exact."""
    with np.errstate(over="ignore", invalid="ignore", under="ignore"):
        plain = np.sqrt(((a - b) ** 2).sum(axis=1))
        odd = np.flatnonzero(~((plain > TINY) & (plain < HUGE)))
        if len(odd):
            _, power = np.frexp(np.maximum(np.abs(a[odd]).max(axis=1), np.abs(b[odd]).max(axis=1)))
            apart = np.ldexp(a[odd], -power[:, None] - 1) - np.ldexp(b[odd], -power[:, None] - 1)
            _, more = np.frexp(np.abs(apart).max(axis=1))  # nearly equal vectors differ by much less than their size
            plain[odd] = np.ldexp(np.sqrt((np.ldexp(apart, -more[:, None]) ** 2).sum(axis=1)), power + 1 + more)
    return plain


class Codes:
    """int8 codes of the rows of a matrix, their scales, and what is needed for the bounds."""

    def __init__(self, v: np.ndarray):
        self.extreme = extreme(v)
        if self.extreme:
            return
        self.scale = np.abs(v).max(axis=1) / 127
        self.scale[self.scale == 0] = np.finfo(float).tiny
        self.codes = np.rint(v / self.scale[:, None]).astype(np.int8)
        near = self.codes * self.scale[:, None]
        self.left = np.sqrt(((v - near) ** 2).sum(axis=1))
        self.near, self.square = np.sqrt((near ** 2).sum(axis=1)), (v ** 2).sum(axis=1)
        # products of codes are whole numbers, exact in the chosen type
        self.exact = np.float32 if v.shape[1] * 127 * 127 < 1 << 24 else np.float64


def tile_bounds(q: Codes, b: Codes) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of the squared distances."""
    product = (q.codes.astype(q.exact) @ b.codes.astype(b.exact).T).astype(np.float64) * q.scale[:, None] * b.scale
    whole = q.square[:, None] + b.square
    error = 2 * (q.left[:, None] * np.sqrt(b.square) + q.near[:, None] * b.left) + 1e-9 * whole
    middle = whole - 2 * product
    return middle - error, middle + error


def tile_nearest(q_ids, q, b_ids, b, b_codes: Codes, k: int):
    """(query, neighbour, distance) of the k nearest of each query in this block."""
    q_codes, own = Codes(q), q_ids[:, None] == b_ids
    if q_codes.extreme or b_codes.extreme:  # no bounds out of range: every pair of the tile is computed
        at_q, at_b = np.nonzero(~own)
    else:
        low, high = tile_bounds(q_codes, b_codes)
        low[own] = high[own] = np.inf
        last = min(k, len(b_ids)) - 1
        limit = np.partition(high, last, axis=1)[:, last]
        at_q, at_b = np.nonzero((low <= limit[:, None]) & ~own)
    exact = np.concatenate([distances(q[at_q[s:s + 65536]], b[at_b[s:s + 65536]]) for s in range(0, len(at_q), 65536)] or [np.zeros(0)])
    order = np.lexsort((b_ids[at_b], exact, at_q))
    at_q, at_b, exact = at_q[order], at_b[order], exact[order]
    first = np.searchsorted(at_q, at_q)
    keep = np.arange(len(at_q)) - first < k
    return q_ids[at_q[keep]], b_ids[at_b[keep]], exact[keep]


def nearest(table: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding",
            block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(query_id, rank, <id_col>, score): the k nearest of each query row by Euclidean distance."""
    small_batches(table.sparkSession)
    rows = stage(usable_vectors(table, id_col, vec_col), "search-vectors")
    blocks = max(1, -(-rows.count() // block_rows))
    asked = table.filter(is_query).select(F.col(id_col).cast("long").alias("id")).distinct()
    queries = rows.join(asked, "id").withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).withColumn("role", F.lit(1))
    base = rows.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")).withColumn("role", F.lit(0))
    columns = ["dim", "block", "role", "id", "v"]
    stream = base.select(*columns).unionByName(queries.select(*columns)).repartition("dim", "block").sortWithinPartitions("dim", "block", "role", "id")

    def tiles(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """A block's rows come first and are gathered; then its queries pass."""
        key, gathered, block = None, [], None
        for frame in frames:
            for own_key, part in frame.groupby(["dim", "block", "role"], sort=True):
                if own_key[:2] != key:
                    key, gathered, block = own_key[:2], [], None
                if own_key[2] == 0:
                    gathered.append((part["id"].to_numpy(), matrix(part["v"])))
                    continue
                if not gathered:
                    continue
                if block is None:
                    ids, v = np.concatenate([g[0] for g in gathered]), np.concatenate([g[1] for g in gathered])
                    block = ids, v, Codes(v)
                q_ids, q = part["id"].to_numpy(), matrix(part["v"])
                for s in range(0, len(q_ids), STRIP):
                    a, n, d = tile_nearest(q_ids[s:s + STRIP], q[s:s + STRIP], *block, k)
                    yield pd.DataFrame({"query_id": a, "id": n, "score": d})

    def merge(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """One heap of k per query of this partition."""
        heaps: dict[int, list] = {}
        for frame in frames:
            for query, near, score in zip(frame["query_id"].tolist(), frame["id"].tolist(), frame["score"].tolist()):
                heap = heaps.setdefault(query, [])
                if len(heap) < k:
                    heapq.heappush(heap, (-score, -near))
                elif (-score, -near) > heap[0]:
                    heapq.heapreplace(heap, (-score, -near))
        found = [(query, rank, -near, -score) for query, heap in heaps.items() for rank, (score, near) in enumerate(sorted(heap, reverse=True), 1)]
        yield pd.DataFrame(found, columns=["query_id", "rank", "id", "score"])

    best = stream.mapInPandas(tiles, "query_id long, id long, score double")
    return (best.repartition("query_id").mapInPandas(merge, "query_id long, rank int, id long, score double")
            .withColumnRenamed("id", id_col))
