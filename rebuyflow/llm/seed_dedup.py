"""Repeated word sequences by seed and extend.

Windows of `length` words are winnowed to anchors (see windows.py). Stretches that share an anchor are joined on it;
each pair is laid anchor on anchor and extended both ways as long as the words agree. A repeat that reaches the length
is kept whole (it is maximal within the stretches), and the later of the two gives up the words it covers. The order is
that of (doc_id, start): of equal sequences the first stays.

Stretches of anchors with more than `MOST_SEEDS` different ones are cut to parts in step with the anchor. Equal parts are
settled by the first one's place; what stays different is compared window by window, by digest. Copies of a whole
stretch are settled by the first one's place.

Null text or text without words: nothing removed. Rows with the same id and text are one document read twice, both get
its result. Rows with one id and different texts are ordered by a hash of the text. A null id is an id like any other
and comes first in the order. Other columns are ignored. Empty table: no rows. Windows are judged on the input, and no document or group is cut short.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from rebuyflow.llm import windows as W
from rebuyflow.llm.windows import A, B, scramble
from rebuyflow.plans.stages import stage

LENGTH, RUN = 20, 6
MOST_SEEDS = 64
CHUNK = 1 << 21


def words(body: bytes) -> np.ndarray:
    return W.word_hashes(np.frombuffer(body, np.uint8))


def later_repeats(anchor: np.ndarray, contents: list[np.ndarray], starts: np.ndarray, doc: np.ndarray, length: int, run: int, batch: int = 40_000):
    """(stretch, first window, windows) of repeats whose earlier copy is in the same anchor's stretches.

    Stretches come sorted by anchor, document and start. A seed is a place of the anchor in a stretch; every two seeds of
    one anchor with different surroundings are extended. Overlapping stretches of one document give the same place twice, which repeats nothing.
    """
    reach = length - run
    seed_of, at = [], []
    for s, own in enumerate(contents):
        hits = np.flatnonzero(W.word_runs(own, run) == anchor[s])
        seed_of.append(np.full(len(hits), s))
        at.append(hits)
    seed_of, at = np.concatenate(seed_of), np.concatenate(at)
    if len(seed_of) < 2:
        return
    absolute = starts[seed_of] + at
    order = np.lexsort((absolute, doc[seed_of], anchor[seed_of]))
    seed_of, at, absolute = seed_of[order], at[order], absolute[order]
    size = np.array([len(c) for c in contents])
    base, flat = np.cumsum(size) - size, np.concatenate(contents)
    place = at[:, None] + np.arange(-reach, length)
    inside = (place >= 0) & (place < size[seed_of][:, None])
    around = np.where(inside, flat[np.where(inside, base[seed_of][:, None] + place, 0)], np.uint64(0))
    left = np.minimum.accumulate(inside[:, :reach][:, ::-1], axis=1).sum(axis=1)
    right = np.minimum.accumulate(inside[:, reach:], axis=1).sum(axis=1)
    # surroundings seen before repeat as a whole and need not be extended again: only the first of each goes on
    digest = scramble((around * np.multiply.accumulate(np.full(around.shape[1], A, np.uint64))).sum(axis=1, dtype=np.uint64) + (left * 64 + right).astype(np.uint64) * B) ^ anchor[seed_of]
    _, first, back = np.unique(digest, return_index=True, return_inverse=True)
    model = first[back]
    known = (model != np.arange(len(model))) & (around == around[model]).all(axis=1) & (inside == inside[model]).all(axis=1) & (anchor[seed_of] == anchor[seed_of[model]])
    again = known & ((doc[seed_of] != doc[seed_of[model]]) | (absolute != absolute[model])) & (left + right >= length)
    yield seed_of[again], at[again] - left[again], (left + right)[again] - length + 1
    new = np.flatnonzero(~known)
    group = anchor[seed_of[new]]
    border = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    many = np.repeat(np.concatenate([border[1:], [len(new)]]), np.diff(np.concatenate([border, [len(new)]]))) - np.arange(len(new)) - 1
    edge = np.cumsum(many)
    for lo in range(0, len(new), batch // 64 + 1):  # the pairs of some first partners at a time
        hi = min(lo + batch // 64 + 1, len(new))
        n = many[lo:hi]
        i = np.repeat(np.arange(lo, hi), n)
        j = i + 1 + np.arange(len(i)) - np.repeat(edge[lo:hi] - n - (edge[lo - 1] if lo else 0), n)
        x, y = new[i], new[j]
        apart = (doc[seed_of[x]] != doc[seed_of[y]]) | (absolute[x] != absolute[y])
        x, y = x[apart], y[apart]
        same = (around[x] == around[y]) & inside[x] & inside[y]
        l = np.minimum.accumulate(same[:, :reach][:, ::-1], axis=1).sum(axis=1)
        r = np.minimum.accumulate(same[:, reach:], axis=1).sum(axis=1)
        far = l + r >= length
        later = y[far]  # seeds are in order of place
        yield seed_of[later], at[later] - l[far], (l + r)[far] - length + 1


def hot_windows(joined: DataFrame, length: int, run: int) -> DataFrame:
    """(id, u, start, n): windows of hot anchors that also start earlier.

    Of equal parts the first stays and the others go as a whole. The first parts' windows are then compared by digest:
    a window goes if the same digest has an earlier place.
    """
    parts = W.hot_parts(joined, words, W.word_runs, length, run)
    place = F.struct("id", "u", "start")
    contents = stage(parts.groupBy("x").agg(F.count("*").alias("k"), F.min(F.struct(place.alias("place"), "n")).alias("one")).select("x", "k", "one.*"), "seed-part-contents")
    firsts = contents.filter("k > 1").select("x", F.col("place").alias("first"))
    whole = parts.select("x", "id", "u", "start", "n").join(firsts, "x").filter(place > F.col("first")).select("id", "u", "start", "n")
    single = W.part_windows(joined, contents, words, length)
    often = stage(single.groupBy("d").agg(F.count("*").alias("c"), F.min(place).alias("first")).filter("c > 1").select("d", "first"), "seed-part-firsts")
    edges = single.join(often, "d").filter(place > F.col("first")).select("id", "u", "start", F.lit(1).alias("n"))
    return whole.unionByName(edges)


def later_windows(rows: DataFrame, length: int = LENGTH, run: int = RUN) -> DataFrame:
    """(id, u, spots): windows that also start earlier, as an array of (start, n)."""
    again = W.find_stretches(rows, words, W.word_runs, length, run)
    kinds = W.kinds_of(again)
    joined = stage(W.with_bodies(rows, kinds, MOST_SEEDS), "seed-bodies")

    id_type = to_arrow_type(rows.schema["id"].dataType)

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in W.anchor_groups(W.with_whole_ids(batches), CHUNK):
            ids, u, starts = chunk["id"].to_numpy(), chunk["u"].to_numpy(), chunk["start"].to_numpy()
            doc = np.cumsum(np.concatenate([[True], (ids[1:] != ids[:-1]) | (u[1:] != u[:-1])]))
            contents = [np.frombuffer(c, np.uint64) for c in chunk["content"]]
            # repeats of a stretch overlap; they are laid over its windows and leave as maximal runs
            size = np.array([len(c) + 1 for c in contents])
            base = np.cumsum(size) - size
            marks = np.zeros(size.sum(), np.int64)
            for s, first, n in later_repeats(chunk["h"].to_numpy().view(np.uint64), contents, starts, doc, length, run):
                np.add.at(marks, base[s] + first, 1)
                np.add.at(marks, base[s] + first + n, -1)
            first, n = W.runs_of(np.cumsum(marks) > 0)
            if len(first):
                s = np.searchsorted(base, first, side="right") - 1
                yield W.spot_batch(ids[s], id_type, u[s], starts[s] + first - base[s], n)

    kind = rows.schema["id"].dataType.simpleString()
    extended = W.stretch_units(joined, words, length).mapInArrow(extend, f"id {kind}, u long, start int, n int")
    hot = hot_windows(joined, length, run)
    copied = stage(again.groupBy("h", "x").agg(F.count("*").alias("copies"), F.min(F.struct("id", "u", "start")).alias("first")).filter("copies > 1"), "seed-copied")
    copies = again.join(copied.select("h", "x", "first"), ["h", "x"]).filter(F.struct("id", "u", "start") > F.col("first")).select("id", "u", "start", "n")
    return extended.unionByName(hot).unionByName(copies).groupBy("id", "u").agg(F.collect_set(F.struct("start", "n")).alias("spots"))


def remove_later_repeats(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, n_removed, spans, kept): removed spans as (start, end) in words, and the words that stay."""
    rows = W.keyed(docs, id_col, text_col)
    spots = later_windows(rows, length)
    kind = rows.schema["id"].dataType.simpleString()

    def drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, removed, spans, kept = [], [], [], []
            for body, own in zip(W.unpacked(batch.column("body")), batch.column("spots").to_pylist()):
                start, end = W.word_places(np.frombuffer(body, np.uint8))
                first, size = W.covered(own, length, len(start))
                stay = np.ones(len(start), bool)
                for f, s in zip(first.tolist(), size.tolist()):
                    stay[f:f + s] = False
                n.append(len(start))
                removed.append(int(size.sum()))
                spans.append([{"start": f, "end": f + s} for f, s in zip(first.tolist(), size.tolist())])
                kept.append(b" ".join([body[a:b] for a, b in zip(start[stay].tolist(), end[stay].tolist())]).decode())
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(kept, pa.string())],
                                             [id_col, "n_words", "n_removed", "spans", "kept"])

    return W.by_document(W.packed(rows), spots, "left").select("id", "body", "spots").mapInArrow(drop, f"`{id_col}` {kind}, n_words long, n_removed long, spans array<struct<start:long,end:long>>, kept string")
