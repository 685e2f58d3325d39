"""Near-duplicate vectors by a pivot-permutation index.

A bounded sample of vectors serves as pivots. Every vector is described by its `prefix` nearest pivots in order and is
entered in the inverted list of each. Two vectors are candidates if they share at least `shared` of those pivots, and
the cosines of candidates are verified in double precision. Sharing is counted and verified inside a list, as matrix
products over pairs of its blocks, in the list of the smallest pivot both share, hence once. Long lists are cut into
blocks of at most `TILE` rows, each pair of blocks being a task's group of bounded size; nothing is capped. A tile
returns link counts and a spanning forest of its links, never its pairs.

Equal vectors are one vector with copies. The index may miss links (recall is measured in the tests, 0.9 at least);
whatever it reports is verified.

Vectors that are null, zero or hold null or non-finite parts link with nothing, vectors of different lengths neither.
A repeated id counts once; rows without an id are left out. Empty table: no rows. Other columns are ignored.
"""
from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rebuyflow.llm.components import connected_components
from rebuyflow.llm.tables import small_batches
from rebuyflow.llm.vectors import matrix, usable_vectors
from rebuyflow.plans.stages import stage

PREFIX, SHARED = 8, 2
PIVOTS_PER_ROOT, MOST_PIVOTS = 8, 4096
"""Pivots: drawn by hash, 8 times the root of the number of vectors, so lists grow as its root; at most 4096."""
SPREAD = 0.8
"""Largest cosine of two pivots: in a dense group one stands for all, so that its members agree on their nearest."""
TILE = 1024


def spread_pivots(v: np.ndarray, most: float = SPREAD) -> np.ndarray:
    """The drawn vectors in turn, but for those too near to one already taken."""
    taken = np.zeros_like(v)
    n = 0
    for row in v:
        if not n or (taken[:n] @ row).max() < most:
            taken[n] = row
            n += 1
    return taken[:n]


def nearest_pivots(v: np.ndarray, pivots: np.ndarray, prefix: int) -> np.ndarray:
    """Numbers of the nearest pivots by cosine, nearest first."""
    near = v.astype(np.float32) @ pivots.T
    n = min(prefix, len(pivots))
    top = np.argpartition(-near, n - 1, axis=1)[:, :n]
    return np.take_along_axis(top, np.argsort(-np.take_along_axis(near, top, 1), axis=1, kind="stable"), 1).astype(np.int32)


def tile_links(pivot: int, a_perm, b_perm, a, b, threshold: float, shared: int) -> np.ndarray:
    """Which pairs of a tile are verified links and belong to this pivot's list."""
    used, at = np.unique(np.concatenate([a_perm.ravel(), b_perm.ravel()]), return_inverse=True)
    has = np.zeros((len(a_perm) + len(b_perm), len(used)), np.float32)
    has[np.repeat(np.arange(len(has)), a_perm.shape[1]), at] = 1
    left, right = has[:len(a_perm)], has[len(a_perm):]
    smaller = used < pivot
    mine = (left[:, smaller] @ right[:, smaller].T == 0) & (left @ right.T >= shared)
    return mine & (a @ b.T >= threshold)


def forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest index connected to each of n nodes by the given pairs."""
    label = np.arange(n)
    while True:
        was = label.copy()
        np.minimum.at(label, i, was[j])
        np.minimum.at(label, j, label[i])
        label = label[label]
        if (label == was).all():
            return label


def near_duplicate_vectors(table: DataFrame, threshold: float = 0.95, id_col: str = "vec_id", vec_col: str = "embedding",
                           prefix: int = PREFIX, shared: int = SHARED, tile: int = TILE) -> DataFrame:
    """(id, n_links, component_id, kept): one row per id."""
    small_batches(table.sparkSession)
    rows = stage(usable_vectors(table, id_col, vec_col), "pivot-vectors")
    groups = stage(rows.groupBy("v", "dim").agg(F.min("id").alias("rep"), F.count("*").alias("copies")), "pivot-distinct")
    count = groups.count()
    wanted = min(MOST_PIVOTS, max(16, math.ceil(PIVOTS_PER_ROOT * math.sqrt(count))))
    sample = groups.orderBy(F.xxhash64("rep"), "rep").limit(wanted).collect()  # bounded: at most MOST_PIVOTS vectors
    pivots = {}
    for dim in {r["dim"] for r in sample}:
        p = matrix([r["v"] for r in sample if r["dim"] == dim])
        pivots[dim] = spread_pivots((p / np.sqrt((p ** 2).sum(axis=1))[:, None]).astype(np.float32))

    def describe(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for dim, part in frame.groupby("dim"):
                v = matrix(part["v"])
                v /= np.abs(v).max(axis=1)[:, None]
                v /= np.sqrt((v ** 2).sum(axis=1))[:, None]
                # without a pivot of this length one list holds them all
                perm = nearest_pivots(v, pivots[dim], prefix) if dim in pivots else np.zeros((len(v), 1), np.int32)
                yield pd.DataFrame({"rep": part["rep"].to_numpy(), "copies": part["copies"].to_numpy(), "dim": part["dim"].to_numpy(),
                                    "perm": list(perm), "unit": [x.tobytes() for x in v]})

    described = stage(groups.mapInPandas(describe, "rep long, copies long, dim int, perm array<int>, unit binary"), "pivot-permutations")
    entries = described.withColumn("pivot", F.explode("perm"))
    lists = entries.groupBy("dim", "pivot").agg(F.ceil(F.count("*") / tile).cast("int").alias("blocks"), F.count("*").alias("n")).filter("n > 1").drop("n")
    dealt = entries.join(F.broadcast(lists), ["dim", "pivot"])  # at most one row per pivot, so at most MOST_PIVOTS per length
    block = F.pmod(F.xxhash64("rep", F.lit(5)), F.col("blocks")).cast("int")
    tiles = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least(F.col("block"), o).alias("x"), F.greatest(F.col("block"), o).alias("y")))
    placed = dealt.withColumn("block", block).withColumn("tile", F.explode(tiles)).select("dim", "pivot", "tile.x", "tile.y", "block", "rep", "copies", "perm", "unit")

    def verify(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        _, pivot, x, y = key
        need = min(shared, len(frame["perm"].iloc[0]))
        frame = frame.sort_values("rep")
        a, b = frame[frame["block"] == x], frame[frame["block"] == y]
        if not len(a) or not len(b):
            return pd.DataFrame({"rep": [], "links": [], "root": []})
        perm = [np.array(f["perm"].tolist(), np.int32) for f in (a, b)]
        unit = [np.frombuffer(b"".join(f["unit"]), np.float64).reshape(len(f), -1) for f in (a, b)]
        hit = tile_links(pivot, *perm, *unit, threshold, need)
        ids = [f["rep"].to_numpy() for f in (a, b)]
        copies = [f["copies"].to_numpy() for f in (a, b)]
        if x == y:
            np.fill_diagonal(hit, False)
            i, j = np.nonzero(hit)
            label, own, links = forest(len(a), i, j), ids[0], hit @ copies[0]
        else:
            i, j = np.nonzero(hit)
            label, own = forest(len(a) + len(b), i, j + len(a)), np.concatenate(ids)
            links = np.concatenate([hit @ copies[1], copies[0] @ hit])
        some = links > 0
        return pd.DataFrame({"rep": own[some], "links": links[some], "root": own[label[some]]})

    found = stage(placed.groupBy("dim", "pivot", "x", "y").applyInPandas(verify, "rep long, links long, root long"), "pivot-links")
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    components = connected_components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    copied = groups.filter("copies > 1").select("v", "rep", "copies")
    members = rows.join(copied, "v", "left").select("id", F.coalesce("rep", "id").alias("rep"), F.coalesce("copies", F.lit(1)).alias("copies"))
    every = table.filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id")).distinct()
    out = (every.join(members, "id", "left").withColumn("rep", F.coalesce("rep", "id"))
           .join(links, "rep", "left").join(components.select(F.col("node").alias("rep"), "component"), "rep", "left"))
    component = F.coalesce("component", "rep")
    return out.select(F.col("id").alias(id_col), (F.coalesce("links", F.lit(0)) + F.coalesce("copies", F.lit(1)) - 1).cast("long").alias("n_links"),
                      component.alias("component_id"), (F.col("id") == component).alias("kept"))
