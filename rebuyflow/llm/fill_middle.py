"""Fill-in-middle transformation with unit borders found eight bytes at a time.

A unit is a run of non-space bytes with the white space before it, or the white space that ends a text. The UTF-8 bytes
of a whole Arrow batch are viewed as uint64 words. Arithmetic on all eight lanes at once marks the bytes that end a
unit and the bytes that start a code point; bitwise_count and one cumulative sum per batch rank them. The k-th unit end
of a text is then found by a binary search for its word and a select inside the word.

Where a text is cut and how it is arranged depends on its id and the seed alone, so a recomputed task gives the same
rows. Nothing is shuffled; a task holds one batch, bounded by rows and bytes.

Null text: an empty text (plain, 0 units). Empty text: plain. Text of white space: one unit. A text that contains a
marker stays plain, whatever its hashes say. Null id: hashed as an empty id. Repeated rows and ids: every input row
gives one output row. Texts of any length are taken whole. Extra columns are kept, whatever their names; added columns
replace columns of the same name (in any case). Empty table: no rows.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rebuyflow.llm.tables import numbered, small_batches

HIGH = np.uint64(0x8080808080808080)
LOW7 = np.uint64(0x7F7F7F7F7F7F7F7F)
LANES = np.uint64(0x0101010101010101)
ONE = np.uint64(1)
PLAIN, PSM, SPM = "plain", "psm", "spm"
ADDED = (("n", T.LongType()), ("form", T.StringType()), ("prefix_chars", T.LongType()), ("middle_chars", T.LongType()), ("output", T.StringType()))


@dataclass(frozen=True)
class FillConfig:
    """`percent` of texts are rearranged, `spm_percent` of those with the suffix first."""
    seed: int = 42
    percent: int = 50
    spm_percent: int = 80
    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"

    @property
    def markers(self) -> tuple[str, str, str]:
        return self.prefix, self.suffix, self.middle


def white_lanes(words: np.ndarray) -> np.ndarray:
    """High bit of each lane that holds 0x20 or 0x09..0x0D."""
    low = words & LOW7
    other = words ^ (LANES * np.uint64(0x20))
    space = ~((other & LOW7) + LOW7 | other)  # high bit clear in a lane only if the lane is zero
    control = (low + LANES * np.uint64(0x80 - 9)) & ~(low + LANES * np.uint64(0x80 - 14)) & ~words
    return (space | control) & HIGH


def unit_ends(words: np.ndarray) -> np.ndarray:
    """High bit of each lane whose byte is not white while the next byte is; the last lane's successor counts as not white."""
    white = white_lanes(words)
    after = white >> np.uint64(8)
    after[:-1] |= white[1:] << np.uint64(56)
    return ~white & after & HIGH


def point_starts(words: np.ndarray) -> np.ndarray:
    """High bit of each lane that starts a code point, i.e. is no continuation byte 10xxxxxx."""
    return ~(words & ~(words << ONE)) & HIGH


class Ranked:
    """Marks of a byte sequence with rank and select: marks before a byte, and the byte of the k-th mark."""

    def __init__(self, marks: np.ndarray):
        self.marks = marks
        self.until = np.cumsum(np.bitwise_count(marks), dtype=np.int64)

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Marks at bytes 0 .. at - 1."""
        word, lane = at >> 3, (at & 7).astype(np.uint64)
        inside = np.minimum(word, len(self.marks) - 1)
        below = (ONE << (lane * np.uint64(8))) - ONE
        whole = np.where(word > 0, self.until[np.maximum(word, 1) - 1], 0)
        return whole + np.bitwise_count(self.marks[inside] & below)

    def select(self, k: np.ndarray) -> np.ndarray:
        """Byte of the k-th mark, k from 1: search the word, then drop the lower marks of it."""
        word = np.searchsorted(self.until, k)
        left = k - np.where(word > 0, self.until[np.maximum(word, 1) - 1], 0)
        bits = self.marks[word]
        for step in range(1, 8):
            bits = np.where(left > step, bits & (bits - ONE), bits)
        lowest = bits & (~bits + ONE)
        return (word << 3) + (np.bitwise_count(lowest - ONE).astype(np.int64) >> 3)


def cut_places(data: np.ndarray, edges: np.ndarray, first: np.ndarray, second: np.ndarray):
    """Units of each text, byte places of its two cuts, and code points before the first cut and between the two.

    `data` holds the texts end to end, text i at edges[i]:edges[i + 1]; the cuts fall after `first` modulo n + 1 units
    and `second` modulo n + 1, the smaller one first.
    """
    padded = np.zeros(-(-max(len(data), 1) // 8) * 8, np.uint8)
    padded[:len(data)] = data
    words = padded.view("<u8")
    marks = unit_ends(words)
    start, end = edges[:-1], edges[1:]
    last = end[end > start] - 1  # a text's last byte ends a unit in either case
    np.bitwise_or.at(marks, last >> 3, np.uint64(0x80) << ((last & 7).astype(np.uint64) * np.uint64(8)))
    ends, points = Ranked(marks), Ranked(point_starts(words))
    before = ends.rank(start)
    n = ends.rank(end) - before
    a, b = first % (n + 1), second % (n + 1)
    places = []
    for k in (np.minimum(a, b), np.maximum(a, b)):
        place = start.copy()
        some = k > 0
        place[some] = ends.select(before[some] + k[some]) + 1
        places.append(place)
    p, m = places
    return n, p, m, points.rank(p) - points.rank(start), points.rank(m) - points.rank(p)


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, edges) of a string array without nulls."""
    column = column.cast(pa.large_binary())
    edges = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[edges[0]:edges[-1]] if raw is not None and len(raw) else np.zeros(0, np.uint8)
    return data, edges - edges[0]


def fill_in_middle(docs: DataFrame, cfg: FillConfig = FillConfig(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row with n (units), form, prefix_chars, middle_chars (code points, null if plain) and output."""
    small_batches(docs.sparkSession)
    new = {name for name, _ in ADDED}
    kept = [i for i, name in enumerate(docs.columns) if name.lower() not in new]
    plain, own = numbered(docs), [f"c{i}" for i in kept]
    doc_id, body = (F.col(f"c{docs.columns.index(name)}") for name in (id_col, text_col))
    digest = F.sha2(F.concat(F.lit(f"{cfg.seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    rows = plain.select(*own, F.coalesce(body.cast("string"), F.lit("")).alias("text"), digest.alias("digest"))
    hashes = [F.conv(F.substring("digest", 8 * i + 1, 8), 16, 10).cast("long").alias(f"h{i + 1}") for i in range(4)]
    rows = rows.select(*own, "text", *hashes)
    markers = [m.encode() for m in cfg.markers]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, edges = _bytes(batch.column("text"))
            h1, h2, h3, h4 = (batch.column(name).to_numpy(zero_copy_only=False) for name in ("h1", "h2", "h3", "h4"))
            n, first, second, prefix, middle = cut_places(data, edges, h1, h2)
            chosen = (edges[1:] > edges[:-1]) & (h3 % 100 < cfg.percent)
            raw = data.tobytes()
            forms, outputs = [], []
            p_mark, s_mark, m_mark = markers
            for lo, p, m, hi, change, spm in zip(edges[:-1].tolist(), first.tolist(), second.tolist(), edges[1:].tolist(), chosen.tolist(), (h4 % 100 < cfg.spm_percent).tolist()):
                body = raw[lo:hi]
                if not change or any(mark in body for mark in markers):
                    forms.append(PLAIN)
                    outputs.append(body)
                elif spm:
                    forms.append(SPM)
                    outputs.append(b"".join((s_mark, raw[m:hi], p_mark, raw[lo:p], m_mark, raw[p:m])))
                else:
                    forms.append(PSM)
                    outputs.append(b"".join((p_mark, raw[lo:p], s_mark, raw[m:hi], m_mark, raw[p:m])))
            plain = np.array([f == PLAIN for f in forms], bool)
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(name) for name in own], pa.array(n, pa.int64()), pa.array(forms, pa.string()), pa.array(prefix, pa.int64(), mask=plain),
                 pa.array(middle, pa.int64(), mask=plain), pa.array(outputs, pa.binary()).cast(pa.string())], [*own, *[name for name, _ in ADDED]])

    schema = T.StructType([*[T.StructField(name, docs.schema[i].dataType) for name, i in zip(own, kept)], *[T.StructField(name, kind) for name, kind in ADDED]])
    return rows.mapInArrow(run, schema).toDF(*[docs.columns[i] for i in kept], *[name for name, _ in ADDED])


def restored(output: Column, form: Column, cfg: FillConfig = FillConfig()) -> Column:
    """The exact text behind an output: its parts lie between the markers, which occur once each."""
    parts = F.split(output, "|".join(f"\\Q{m}\\E" for m in cfg.markers))
    part = [F.element_at(parts, i) for i in (2, 3, 4)]
    return F.when(form == PSM, F.concat(part[0], part[2], part[1])).when(form == SPM, F.concat(part[1], part[2], part[0])).otherwise(output)
