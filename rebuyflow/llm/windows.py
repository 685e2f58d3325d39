"""Windows of fixed length that occur more than once, found without a row per window.

Every window (`length` units: bytes or words) has an anchor: the smallest hash among its short runs of units. Equal
windows have equal anchors, so all windows can be told apart anchor by anchor. Consecutive windows with one anchor are
one row, a *stretch*, of about half a window's length; its content hash collapses copies before anything is compared.
An anchor that occurs once in the whole table has no repeated window (unless a stretch repeats itself) and goes.

Three kinds of rows remain, and together they cover all windows, whatever the size of a group:
- stretches whose whole content occurs several times (copies): settled by their counts;
- different stretches of one anchor, up to a bound: compared in one task by the operator's own method;
- anchors with more different stretches (hot passages): cut to parts in step with the anchor; equal parts collapse, and
  only one part of each content is looked at window by window.
"""
from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rebuyflow.llm.tables import small_batches
from rebuyflow.plans.stages import stage

PIECE = 1 << 19
"""Units of one document looked at in one go; longer documents are cut into overlapping pieces."""
LONGEST = 1024
"""Windows of one stretch; self-repeating text would make longer ones."""
A, B, C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


def scramble(x: np.ndarray) -> np.ndarray:
    """Spread the information of 64-bit numbers over all bits."""
    x = x ^ (x >> np.uint64(31))
    x = x * A
    x = x ^ (x >> np.uint64(29))
    x = x * B
    return x ^ (x >> np.uint64(32))


def sliding_min(h: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every `width` neighbours: running minima from both ends of blocks."""
    n = len(h)
    full = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    full[:n] = h
    rows = full.reshape(-1, width)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    back = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n - width + 1], ahead[width - 1:n])


def stretches(h: np.ndarray, width: int):
    """(anchor, first window, windows, repeats itself) of each stretch; h: hashes of the short runs, width: of a window."""
    least = sliding_min(h, width)
    n = len(least)
    first = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
    size = np.diff(np.concatenate([first, [n]]))
    if size.max() > LONGEST:
        first = np.concatenate([np.arange(f, f + s, LONGEST) for f, s in zip(first, size)])
        size = np.diff(np.concatenate([first, [n]]))
    # equal windows of one stretch need an anchor that leaves and another that enters on the way
    leaves = np.add.reduceat((h[:n] == least).astype(np.int32), first)
    enters = (h[width - 1:width - 1 + n] == least)
    enters[first] = False
    return least[first], first, size, (leaves > 0) & (np.add.reduceat(enters.astype(np.int32), first) > 0)


def byte_runs(data: np.ndarray, run: int) -> np.ndarray:
    """Hash of every `run` bytes (a multiple of 8)."""
    words = np.lib.stride_tricks.as_strided(data, (len(data) - 7, 8), (1, 1)).copy().view(np.uint64).ravel()
    n, total = len(data) - run + 1, np.uint64(0)
    for k, factor in zip(range(0, run, 8), (A, B, C)):
        total = total + scramble(words[k:k + n] * factor)
    return scramble(total)


def word_places(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each word: runs without space or the five control characters that are white space."""
    white = np.concatenate([[True], (data == 32) | ((data >= 9) & (data <= 13)), [True]])
    return np.flatnonzero(white[:-1] & ~white[1:]), np.flatnonzero(~white[:-1] & white[1:])


_POWERS = np.multiply.accumulate(np.full(4096, A, np.uint64))


def word_hashes(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word."""
    start, end = word_places(data)
    if not len(start):
        return np.zeros(0, np.uint64)
    size = end - start
    where = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    values = (data[np.repeat(start, size) + where].astype(np.uint64) + np.uint64(1)) * _POWERS[where & 4095] * (np.uint64(2) * (where >> 12).astype(np.uint64) + np.uint64(1))
    return scramble(np.add.reduceat(values, np.cumsum(size) - size) + size.astype(np.uint64) * B)


def word_runs(words: np.ndarray, run: int) -> np.ndarray:
    """Hash of every `run` words."""
    n, total = len(words) - run + 1, np.zeros(len(words) - run + 1, np.uint64)
    for k in range(run):
        total = total * C + words[k:k + n]
    return scramble(total)


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, u, body): u tells texts of one id apart; rows that agree in both are one document.

    Where no id repeats, u is constant and costs nothing to carry along. A null id is an id like any other.
    """
    body = F.coalesce(F.col(text_col), F.lit(""))
    unique = docs.groupBy(id_col).agg(F.count("*").alias("n")).filter("n > 1").isEmpty()
    u = F.lit(0).cast("long") if unique else F.xxhash64(body)
    return docs.select(F.col(id_col).alias("id"), u.alias("u"), body.cast("binary").alias("body"))


def packed(rows: DataFrame) -> DataFrame:
    """The same rows with their bodies compressed: texts are shuffled twice, and this is what a shuffle writes."""
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        small = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("u"), pa.array([small(b) for b in batch.column("body").to_pylist()], pa.binary())], ["id", "u", "body"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(pack, f"id {kind}, u long, body binary")


def by_document(rows: DataFrame, found: DataFrame, how: str = "inner") -> DataFrame:
    """Rows (id, u, ...) with what was found for their document; a null id meets null ids."""
    other = found.withColumnsRenamed({"id": "found_id", "u": "found_u"})
    return rows.join(other, F.col("id").eqNullSafe(F.col("found_id")) & (F.col("u") == F.col("found_u")), how).drop("found_id", "found_u")


def unpacked(column) -> list[bytes]:
    whole = zstandard.ZstdDecompressor().decompress
    return [whole(b) for b in column.to_pylist()]


def find_stretches(rows: DataFrame, units: Callable[[bytes], np.ndarray], runs: Callable[[np.ndarray, int], np.ndarray], length: int, run: int) -> DataFrame:
    """(id, u, start, n, h, x, twice) of the stretches whose anchor is not unique in the table."""
    small_batches(rows.sparkSession)
    width = length - run + 1

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = {k: [] for k in ("at", "start", "n", "h", "x", "twice")}
            for row, body in enumerate(batch.column("body").to_pylist()):
                own = units(body)
                for p in range(0, len(own) - length + 1, PIECE):
                    part = own[p:p + PIECE + length - 1]
                    anchor, first, size, twice = stretches(runs(part, run), width)
                    raw, step = part.tobytes(), part.itemsize
                    out["x"].append(np.array([xxhash.xxh3_64_intdigest(raw[s * step:(s + n + length - 1) * step]) for s, n in zip(first.tolist(), size.tolist())], np.uint64))
                    for k, v in (("at", np.full(len(first), row)), ("start", first + p), ("n", size), ("h", anchor), ("twice", twice)):
                        out[k].append(v)
            if not out["at"]:
                continue
            out = {k: np.concatenate(v) for k, v in out.items()}
            at = pa.array(out["at"])
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").take(at), batch.column("u").take(at), pa.array(out["start"].astype(np.int32)), pa.array(out["n"].astype(np.int32)),
                 pa.array(out["h"].view(np.int64)), pa.array(out["x"].view(np.int64)), pa.array(out["twice"])], ["id", "u", "start", "n", "h", "x", "twice"])

    kind = rows.schema["id"].dataType.simpleString()
    every = stage(rows.mapInArrow(cut, f"id {kind}, u long, start int, n int, h long, x long, twice boolean"), "stretches")
    anchors = every.groupBy("h").agg(F.count("*").alias("c"), F.max("twice").alias("t")).filter("c > 1 or t").select("h")
    return stage(every.join(anchors, "h", "left_semi").dropDuplicates(["id", "u", "start", "n"]), "stretches-again")


def kinds_of(again: DataFrame) -> DataFrame:
    """(h, x, copies, first, different, twice): contents of stretches, and how many different ones their anchor has."""
    contents = stage(again.groupBy("h", "x").agg(F.count("*").alias("copies"), F.min(F.struct("id", "u", "start", "n")).alias("first"), F.max("twice").alias("twice")), "stretch-contents")
    per_anchor = stage(contents.groupBy("h").agg(F.count("*").alias("different"), F.max("twice").alias("any_twice")).filter("different > 1 or any_twice"), "stretch-anchors")
    return stage(contents.join(per_anchor, "h"), "stretch-kinds")


def with_bodies(rows: DataFrame, kinds: DataFrame, most: int) -> DataFrame:
    """Documents that hold the first of some kind, each with its list of (h, start, n, copies, hot)."""
    wanted = (kinds.select("first.*", "h", "copies", (F.col("different") > most).alias("hot")).groupBy("id", "u")
              .agg(F.collect_list(F.struct("h", "start", "n", "copies", "hot")).alias("wanted")))
    return by_document(packed(rows), wanted)


PART = 32
"""Windows of a part of a hot stretch."""


def hot_parts(joined: DataFrame, units: Callable[[bytes], np.ndarray], runs: Callable[[np.ndarray, int], np.ndarray], length: int, run: int) -> DataFrame:
    """(x, id, u, start, n, copies): the hot stretches in parts.

    A stretch is cut where its distance from the anchor is a multiple of `PART` windows, so that equal passages are cut
    alike: their parts have one content x and collapse in an aggregate, whatever surrounds the passages. What is left of
    a passage that occurs often are the parts at its edges.
    """
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, rest = [], []
            for row, (body, wanted) in enumerate(zip(unpacked(batch.column("body")), batch.column("wanted").to_pylist())):
                own = units(body) if any(w["hot"] for w in wanted) else None
                for w in wanted:
                    if not w["hot"]:
                        continue
                    first, last = w["start"], w["start"] + w["n"]
                    content = own[first:last + length - 1]
                    raw, step = content.tobytes(), content.itemsize
                    shift = int(np.flatnonzero(runs(content, run).view(np.int64) == w["h"])[0]) % PART
                    edges = [0, *range(shift, w["n"], PART)] if shift else [*range(0, w["n"], PART)]
                    for a, b in zip(edges, [*edges[1:], w["n"]]):
                        if a < b:
                            at.append(row)
                            rest.append((xxhash.xxh3_128_digest(raw[a * step:(b + length - 1) * step]), first + a, b - a, w["copies"]))
            if at:
                at = pa.array(at, pa.int64())
                x, start, n, copies = zip(*rest)
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary()), batch.column("id").take(at), batch.column("u").take(at), pa.array(start, pa.int32()), pa.array(n, pa.int32()),
                                                  pa.array(copies, pa.int64())], ["x", "id", "u", "start", "n", "copies"])

    kind = joined.schema["id"].dataType.simpleString()
    hot = joined.filter(F.exists("wanted", lambda w: w["hot"]))
    return stage(hot.mapInArrow(cut, f"x binary, id {kind}, u long, start int, n int, copies long"), "hot-parts")


def part_windows(joined: DataFrame, contents: DataFrame, units: Callable[[bytes], np.ndarray], length: int) -> DataFrame:
    """(d, id, u, start, k): a digest of every window of one part of each content, given as (place, n, k)."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, start, k, digest = [], [], [], []
            for row, (body, parts) in enumerate(zip(unpacked(batch.column("body")), batch.column("parts").to_pylist())):
                own = units(body)
                raw, step = own.tobytes(), own.itemsize
                for part in parts:
                    for s in range(part["start"], part["start"] + part["n"]):
                        at.append(row)
                        start.append(s)
                        k.append(part["k"])
                        digest.append(xxhash.xxh3_128_digest(raw[s * step:(s + length) * step]))
            if at:
                at = pa.array(at, pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(digest, pa.binary()), batch.column("id").take(at), batch.column("u").take(at), pa.array(start, pa.int32()), pa.array(k, pa.int64())],
                                                 ["d", "id", "u", "start", "k"])

    parts = contents.select("place.*", "n", "k").groupBy("id", "u").agg(F.collect_list(F.struct("start", "n", "k")).alias("parts"))
    kind = joined.schema["id"].dataType.simpleString()
    return stage(by_document(joined.select("id", "u", "body"), parts).mapInArrow(cut, f"d binary, id {kind}, u long, start int, k long"), "hot-windows")


def stretch_units(joined: DataFrame, units: Callable[[bytes], np.ndarray], length: int) -> DataFrame:
    """(h, id, u, start, n, copies, content) of the other stretches, dealt and sorted by anchor."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, rest, content = [], [], []
            for row, (body, wanted) in enumerate(zip(unpacked(batch.column("body")), batch.column("wanted").to_pylist())):
                own = units(body)
                for w in wanted:
                    if not w["hot"]:
                        at.append(row)
                        rest.append((w["h"], w["start"], w["n"], w["copies"]))
                        content.append(own[w["start"]:w["start"] + w["n"] + length - 1].tobytes())
            if at:
                at = pa.array(at, pa.int64())
                h, start, n, copies = zip(*rest)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h, pa.int64()), batch.column("id").take(at), batch.column("u").take(at), pa.array(start, pa.int32()), pa.array(n, pa.int32()), pa.array(copies, pa.int64()),
                     pa.array(content, pa.binary())], ["h", "id", "u", "start", "n", "copies", "content"])

    kind = joined.schema["id"].dataType.simpleString()
    usual = joined.filter(F.exists("wanted", lambda w: ~w["hot"]))
    return usual.mapInArrow(cut, f"h long, id {kind}, u long, start int, n int, copies long, content binary").repartition("h").sortWithinPartitions("h", "id", "u", "start")


def with_whole_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
    """Pandas frames whose ids stay Python values: as numbers of pandas they turn to floats beside a null."""
    for batch in batches:
        yield batch.drop_columns(["id"]).to_pandas().assign(id=pd.Series(batch.column("id").to_pylist(), dtype=object))


def spot_batch(ids: np.ndarray, kind: pa.DataType, u: np.ndarray, start: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(ids.tolist(), kind), pa.array(u, pa.int64()), pa.array(start.astype(np.int32)), pa.array(n.astype(np.int32))], ["id", "u", "start", "n"])


def anchor_groups(frames: Iterator[pd.DataFrame], most_bytes: int) -> Iterator[pd.DataFrame]:
    """Whole anchors again, gathered to chunks of about `most_bytes` of content (an anchor is never cut)."""
    held, size = [], 0
    for frame in frames:
        held.append(frame)
        size += frame["content"].map(len).sum()
        if size >= most_bytes:
            every = pd.concat(held, ignore_index=True)
            open_ = every["h"] == every["h"].iloc[-1]  # this anchor may go on in the next batch
            if not open_.all():
                yield every[~open_].reset_index(drop=True)
                every = every[open_]
            held, size = [every], every["content"].map(len).sum()
    if held and len(last := pd.concat(held, ignore_index=True)):
        yield last


def runs_of(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First index and length of each run of True."""
    edge = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    first = np.flatnonzero(edge == 1)
    return first, np.flatnonzero(edge == -1) - first


def covered(wanted, length: int, total: int) -> tuple[np.ndarray, np.ndarray]:
    """Merged spans of units covered by windows starting in the given (start, n) runs."""
    marks = np.zeros(total + 1, np.int32)
    for w in wanted or []:
        marks[w["start"]] += 1
        marks[min(total, w["start"] + w["n"] + length - 1)] -= 1
    return runs_of(np.cumsum(marks[:total]) > 0)
