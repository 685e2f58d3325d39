"""Repeated byte strings by two-stage suffix sorting.

Windows are told apart by anchors (see windows.py); the different stretches of an anchor are put together and their
suffixes sorted in two stages: only suffixes smaller than their successors are sorted directly, the rest is induced
bucket by bucket from the ranks of what follows them. Neighbours in that order are compared for their common prefix;
where it reaches the length, both starts are repeated. Everything removed is covered by a string of `length` bytes
that starts at two places at least, in one document or two; strings are judged on the input.

Null or empty text and texts shorter than the length: nothing removed. Rows with the same id and text are one document
read twice: both rows get its result, and do not repeat each other. Rows with the same id and different texts are
different documents. A null id is an id like any other. Other columns are ignored. Empty table: no rows. Documents of any length are cut into overlapping
pieces, and periodic text into bounded stretches, without losing a window.
"""
from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from rebuyflow.llm import windows as W
from rebuyflow.plans.stages import stage

LENGTH, RUN = 400, 24
MOST_DIFFERENT = 64
CHUNK = 1 << 20


def octets(body: bytes) -> np.ndarray:
    return np.frombuffer(body, np.uint8)


def two_stage_order(pieces: list[bytes], starts: list[int], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted suffixes (to `depth` bytes) among the first starts[p] of each piece, as (piece, offset).

    A suffix smaller than its successor is sorted directly. For another one, what follows its run of equal bytes starts
    with a smaller byte, so its rank is known when the bucket of its own first byte is scanned: by length of the run,
    then by that rank. In a bucket the induced suffixes come before the directly sorted ones.
    """
    size = np.array([len(p) + 1 for p in pieces])
    base = np.cumsum(size) - size
    text = np.zeros(size.sum(), np.int16)
    for p, b in zip(pieces, base):
        text[b:b + len(p)] = np.frombuffer(p, np.uint8).astype(np.int16) + 1  # 0 ends a piece
    change = np.flatnonzero(np.concatenate([text[1:] != text[:-1], [True]]))
    run_end = change[np.searchsorted(change, np.arange(len(text)))]
    follow = np.minimum(run_end + 1, len(text) - 1)
    direct = (text[follow] > text) & (text > 0)
    owner = np.repeat(np.arange(len(pieces)), size)
    offset = np.arange(len(text)) - base[owner]
    # besides the wanted starts, ranks are needed up to the first directly sorted suffix after them
    stops = np.flatnonzero(direct | (text == 0))
    reach = stops[np.searchsorted(stops, base + np.maximum(np.array(starts) - 1, 0))]
    active = (np.arange(len(text)) <= reach[owner]) & (text > 0)
    first = np.flatnonzero(active & direct)
    keys = [pieces[p][o:o + depth] for p, o in zip(owner[first].tolist(), offset[first].tolist())]
    first = first[np.array(sorted(range(len(keys)), key=keys.__getitem__), np.int64)]
    induced = np.flatnonzero(active & ~direct)
    induced = induced[np.argsort(text[induced], kind="stable")]
    rank, order, filled = np.full(len(text), -1, np.int64), [], 0
    for c in np.unique(text[active]):
        lo, hi = np.searchsorted(text[induced], [c, c + 1])
        own = induced[lo:hi]
        own = own[np.lexsort((rank[follow[own]], run_end[own] - own))]
        lo, hi = np.searchsorted(text[first], [c, c + 1])
        bucket = np.concatenate([own, first[lo:hi]])
        rank[bucket] = np.arange(filled, filled + len(bucket))
        filled += len(bucket)
        order.append(bucket)
    order = np.concatenate(order) if order else np.zeros(0, np.int64)
    order = order[offset[order] < np.array(starts)[owner[order]]]
    return owner[order], offset[order]


def common_prefixes(pieces: list[bytes], owner: np.ndarray, offset: np.ndarray, depth: int) -> np.ndarray:
    """Length of the common prefix of each suffix and the next in order, at most `depth` (a multiple of 8)."""
    size = np.array([len(p) for p in pieces])
    flat = np.frombuffer(b"".join(pieces) + bytes(8), np.uint8)
    at = (np.cumsum(size) - size)[owner] + offset
    a, b, out = at[:-1], at[1:], np.full(max(len(at) - 1, 0), depth)
    words = np.lib.stride_tricks.as_strided(flat, (len(flat) - 7, 8), (1, 1)).copy().view(np.uint64).ravel()
    still = np.arange(len(a))
    for k in range(0, depth, 8):
        x = words[a[still] + k] ^ words[b[still] + k]
        stop = x != 0
        out[still[stop]] = k + (x[stop].view(np.uint8).reshape(-1, 8) != 0).argmax(axis=1)
        still = still[~stop]
        if not len(still):
            break
    return out


def repeated_starts(pieces: list[bytes], starts: list[int], length: int) -> list[np.ndarray]:
    """Per piece, which of its first starts begin a string of `length` bytes that another start begins too."""
    owner, offset = two_stage_order(pieces, starts, length)
    equal = common_prefixes(pieces, owner, offset, length) >= length
    flag = np.zeros(len(owner), bool)
    flag[:-1] |= equal
    flag[1:] |= equal
    out = [np.zeros(n, bool) for n in starts]
    order = np.argsort(owner, kind="stable")
    bounds = np.searchsorted(owner[order], np.arange(len(pieces) + 1))
    for p in range(len(pieces)):
        own = order[bounds[p]:bounds[p + 1]]
        out[p][offset[own]] = flag[own]
    return out


def anchor_cells(content: np.ndarray, h: int, n: int, length: int, run: int) -> Iterator[tuple[int, int, int, bytes, bytes, bytes]]:
    """(first window, windows, place in the cell, digest, digest of the core, tails) of the cells of a stretch of n windows.

    A window belongs to the first anchor `h` at or after its start; up to there its windows are dealt, from the back, into
    cells of `PART` places. Both are read off the window's own bytes, so equal windows have equal places. All windows of
    a cell hold its core. The tails are the bytes of the cell before and after the
    core, joined: window i is the core with the `PART` - 1 bytes of the tails from i on around it.
    """
    places = np.flatnonzero(W.byte_runs(content, run).view(np.int64) == h)
    own = np.arange(n)
    anchor = places[np.searchsorted(places, own)]
    place = (own - anchor - 1) % W.PART
    first = np.flatnonzero(np.concatenate([[True], (place[1:] == 0) | (anchor[1:] != anchor[:-1])]))
    raw = content.tobytes()
    for a, b, p in zip(first.tolist(), [*first[1:].tolist(), n], place[first].tolist()):
        inner, outer = a - p + W.PART - 1, a - p + length
        yield a, b - a, p, xxhash.xxh3_128_digest(raw[a:b + length - 1]), xxhash.xxh3_128_digest(raw[inner:outer]), raw[a:inner] + raw[outer:b + length - 1]


def hot_cells(joined: DataFrame, length: int, run: int) -> DataFrame:
    """(x, y, id, u, start, n, p, tails, copies): the hot stretches in cells, x and y digests of the cell and of its core.

    Cells that a stretch holds several times (periodic text has an anchor every period) are one row, and the windows
    they repeat are rows of their own without digests.
    """
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, rest = [], []
            for row, (body, wanted) in enumerate(zip(W.unpacked(batch.column("body")), batch.column("wanted").to_pylist())):
                data = octets(body)
                for w in wanted:
                    if not w["hot"]:
                        continue
                    own = list(anchor_cells(data[w["start"]:w["start"] + w["n"] + length - 1], w["h"], w["n"], length, run))
                    times = Counter(cell[3] for cell in own)
                    one = {cell[3]: cell for cell in reversed(own)}
                    rows = [(x, y, w["start"] + a, n, p, tails, w["copies"] * times[x]) for x, (a, n, p, _, y, tails) in one.items()]
                    if len(one) < len(own):
                        again = np.repeat([times[cell[3]] > 1 for cell in own], [cell[1] for cell in own])
                        rows += [(None, None, w["start"] + a, n, 0, None, 0) for a, n in zip(*[v.tolist() for v in W.runs_of(again)])]
                    at += [row] * len(rows)
                    rest += rows
            if at:
                at = pa.array(at, pa.int64())
                x, y, start, n, p, tails, copies = zip(*rest)
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary()), pa.array(y, pa.binary()), batch.column("id").take(at), batch.column("u").take(at), pa.array(start, pa.int32()), pa.array(n, pa.int32()),
                                                  pa.array(p, pa.int32()), pa.array(tails, pa.binary()), pa.array(copies, pa.int64())], ["x", "y", "id", "u", "start", "n", "p", "tails", "copies"])

    kind = joined.schema["id"].dataType.simpleString()
    hot = joined.filter(F.exists("wanted", lambda w: w["hot"]))
    return stage(hot.mapInArrow(cut, f"x binary, y binary, id {kind}, u long, start int, n int, p int, tails binary, copies long"), "hot-cells")


def hot_windows(joined: DataFrame, length: int, run: int) -> DataFrame:
    """(id, u, start, n): repeated windows of hot anchors, whose stretches are too many to be sorted in one task.

    Cells that occur several times are repeated as a whole. A window of another cell can only be repeated where a
    different cell has the same core; only those cells are looked at window by window, and their tails tell the windows
    apart, so no text is read again.
    """
    every = hot_cells(joined, length, run)
    cells, within = every.filter("x is not null"), every.filter("x is null").select("id", "u", "start", "n")
    one = F.struct("id", "u", "start", "n", "y", "p", "tails")
    contents = stage(cells.groupBy("x").agg(F.sum("copies").alias("k"), F.min(one).alias("one")).select("x", "k", "one.*"), "suffix-cell-contents")
    several = contents.filter("k > 1").select("x")
    whole = cells.select("x", "id", "u", "start", "n").join(several, "x", "left_semi").select("id", "u", "start", "n")
    cores = contents.groupBy("y").agg(F.count("*").alias("c")).filter("c > 1").select("y")
    alike = stage(contents.drop("x").join(cores, "y", "left_semi"), "suffix-cells-alike")
    single = (alike.select("*", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("i"))
              .select("y", (F.col("p") + F.col("i")).alias("place"), F.expr(f"substring(tails, i + 1, {W.PART - 1})").alias("around"), "k", "id", "u", (F.col("start") + F.col("i")).alias("start")))
    window = ["y", "place", "around"]
    often = stage(single.groupBy(*window).agg(F.count("*").alias("c"), F.min("k").alias("k")).filter("c > 1 and k = 1").select(*window), "suffix-often")
    edges = single.filter("k = 1").join(often, window, "left_semi").select("id", "u", "start", F.lit(1).alias("n"))
    return whole.unionByName(within).unionByName(edges)


def repeated_windows(rows: DataFrame, length: int = LENGTH, run: int = RUN) -> DataFrame:
    """(id, u, spots): starts of repeated strings as an array of (start, n)."""
    again = W.find_stretches(rows, octets, W.byte_runs, length, run)
    kinds = W.kinds_of(again)
    joined = stage(W.with_bodies(rows, kinds, MOST_DIFFERENT), "suffix-bodies")

    id_type = to_arrow_type(rows.schema["id"].dataType)

    def sort_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in W.anchor_groups(W.with_whole_ids(batches), CHUNK):
            flags = repeated_starts(chunk["content"].tolist(), chunk["n"].tolist(), length)
            found = [(r, s, n) for r, f in enumerate(flags) for s, n in zip(*[v.tolist() for v in W.runs_of(f)])]
            if found:
                r, s, n = (np.array(v) for v in zip(*found))
                yield W.spot_batch(chunk["id"].to_numpy()[r], id_type, chunk["u"].to_numpy()[r], chunk["start"].to_numpy()[r] + s, n)

    kind = rows.schema["id"].dataType.simpleString()
    sorted_ = W.stretch_units(joined, octets, length).mapInArrow(sort_anchors, f"id {kind}, u long, start int, n int")
    hot = hot_windows(joined, length, run)
    copied = stage(again.groupBy("h", "x").agg(F.count("*").alias("copies")).filter("copies > 1").select("h", "x"), "suffix-copied")
    copies = again.join(copied, ["h", "x"], "left_semi").select("id", "u", "start", "n")
    return sorted_.unionByName(hot).unionByName(copies).groupBy("id", "u").agg(F.collect_list(F.struct("start", "n")).alias("spots"))


def remove_repeats(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, spans, kept): removed spans as (start, end) in bytes, and the bytes that stay."""
    rows = W.keyed(docs, id_col, text_col)
    spots = repeated_windows(rows, length)
    kind = rows.schema["id"].dataType.simpleString()

    def drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, spans, kept = [], [], []
            for body, own in zip(W.unpacked(batch.column("body")), batch.column("spots").to_pylist()):
                first, size = W.covered(own, length, len(body))
                n.append(len(body))
                spans.append([{"start": s, "end": e} for s, e in zip(first.tolist(), (first + size).tolist())])
                edges = [0, *[x for s in spans[-1] for x in (s["start"], s["end"])], len(body)]
                kept.append(b"".join([body[a:b] for a, b in zip(edges[::2], edges[1::2])]))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(n, pa.int64()), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(kept, pa.binary())],
                                             [id_col, "n_bytes", "spans", "kept"])

    return W.by_document(W.packed(rows), spots, "left").select("id", "body", "spots").mapInArrow(drop, f"`{id_col}` {kind}, n_bytes long, spans array<struct<start:long,end:long>>, kept binary")
