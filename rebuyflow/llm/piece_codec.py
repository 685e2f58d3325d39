"""SentencePiece encoding and decoding for merge-type vocabularies.

A text starts as its single characters. An agenda (heap) holds every adjacent pair whose concatenation is a piece, best
score first and leftmost first among equals; popping the best pair merges it and puts its two new neighbours on the
agenda, until no pair is left. Characters that are no piece become byte pieces.

Pieces of such vocabularies carry the word mark only in front, and a line break is no piece, so what lies between two
such borders is merged independently of the rest: a *segment*. Segments repeat, hence each worker keeps a bounded
table of those already merged. The new segments of an Arrow batch are merged together: their agendas are the rows of an
array, and a round merges the best pair of every row. Long segments and those with characters outside the vocabulary
have an agenda of their own. Every segment that enters the table is first compared with the sentencepiece library, one
library call for the new segments of a batch; where both disagree the library's ids are used and counted in
`n_corrected` (of the batch's first row). A vocabulary with pieces across those borders is handled as one segment per text.

Null text: encoded as the empty text (end id only, decoded ''). Any length: the agenda is O(n log n). Repeated rows and
ids, extra columns: every input row gives one output row and keeps its columns.
"""
from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rebuyflow.llm.tables import small_batches

MARK = "▁"
SHORT, NEVER = 40, float("inf")
WIDTHS = (8, 16, 32)
"""Characters of a segment in the arrays of agendas."""
TABLE_ENTRIES = 700_000
"""Segments a worker remembers; a full table is emptied (memory bound, no influence on results)."""


class PieceCodec:
    """Vocabulary of one model and the segments merged so far."""

    def __init__(self, model: bytes):
        self.library = lib = sentencepiece.SentencePieceProcessor(model_proto=model)
        every = range(lib.get_piece_size())
        special = {i for i in every if lib.is_control(i) or lib.is_unknown(i) or lib.is_byte(i)}
        self.ids = {lib.id_to_piece(i): i for i in every if i not in special}
        self.cost = {piece: -lib.get_score(i) for piece, i in self.ids.items()}
        self.bytes = {int(lib.id_to_piece(i)[3:-1], 16): i for i in special if lib.is_byte(i)}
        self.text = [lib.id_to_piece(i).replace(MARK, " ") for i in every]
        self.value = {i: b for b, i in self.bytes.items()}
        self.end, self.unknown = lib.eos_id(), lib.unk_id()
        free = not any(MARK in p.lstrip(MARK) or "\n" in p for p in self.ids)
        self.cut = re.compile(f"{MARK}*[^{MARK}\n]+|{MARK}+|\n" if free else "(?s).+").findall
        self.free = free
        self._arrays()
        self.table: dict[str, bytes] = {}
        self.respelled: dict[str, str] = {}  # segments that do not decode to themselves
        self.last = np.array([self.end], np.int32).tobytes()
        self.corrected = 0

    def _arrays(self) -> None:
        """The vocabulary as arrays: id of a character, rank of a piece's cost, and the piece that two pieces make."""
        self.char = np.full(0x110000, -1, np.int32)
        for piece, i in self.ids.items():
            if len(piece) == 1:
                self.char[ord(piece)] = i
        n = self.library.get_piece_size()
        cost = np.full(n, np.inf)
        for piece, i in self.ids.items():
            cost[i] = self.cost[piece]
        self.rank = np.unique(cost, return_inverse=True)[1].astype(np.int32)
        pairs = [(a << 32 | b, i) for piece, i in self.ids.items() for k in range(1, len(piece))
                 if (a := self.ids.get(piece[:k])) is not None and (b := self.ids.get(piece[k:])) is not None]
        keys, made = (np.array(x, np.int64) for x in zip(*sorted(pairs))) if pairs else (np.array([-1], np.int64), np.array([0], np.int64))
        self.pair_keys, self.pair_made = keys, made.astype(np.int32)

    def _made(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Id of the piece that two neighbours make, -1 if none; -1 is no neighbour."""
        key = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where((self.pair_keys[at] == key) & (left >= 0) & (right >= 0), self.pair_made[at], -1)

    def _merge_rows(self, symbols: np.ndarray) -> np.ndarray:
        """All agendas of an array at once: symbols (-1 beyond the end) -> pieces. A round merges each row's best pair, leftmost of equals."""
        out, open_ = symbols, np.arange(len(symbols))
        never, columns = np.int32(len(self.rank)), np.arange(symbols.shape[1] - 1)
        made = self._made(symbols[:, :-1].ravel(), symbols[:, 1:].ravel()).reshape(len(symbols), -1)
        while len(open_):
            order = np.where(made >= 0, self.rank[made], never)
            best = order.argmin(axis=1)
            row = np.arange(len(open_))
            more = order[row, best] < never
            if not more.all():
                out[open_[~more]] = symbols[~more]
                symbols, made, open_, best, row = symbols[more], made[more], open_[more], best[more], np.arange(more.sum())
            symbols[row, best] = made[row, best]
            behind = columns > best[:, None]
            symbols[:, 1:-1] = np.where(behind[:, :-1] | (columns[:-1] == best[:, None]), symbols[:, 2:], symbols[:, 1:-1])
            symbols[:, -1] = -1
            made[:, :-1] = np.where(behind[:, :-1] | (columns[:-1] == best[:, None]), made[:, 1:], made[:, :-1])
            made[:, -1] = -1
            made[row, best] = self._made(symbols[row, best], symbols[row, best + 1])
            led = best > 0
            made[row[led], best[led] - 1] = self._made(symbols[row[led], best[led] - 1], symbols[row[led], best[led]])
        return out

    def merge_many(self, segments: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all segments one after the other, edges)."""
        size = np.fromiter(map(len, segments), np.int64, len(segments))
        known = self.char[np.frombuffer("".join(segments).encode("utf-32-le", "surrogatepass"), np.uint32)]
        base = np.cumsum(size) - size
        apart = np.flatnonzero((np.add.reduceat((known < 0).astype(np.int32), base) > 0) | (size > WIDTHS[-1]))
        alone = {i: np.array(self.merge(segments[i]), np.int32) for i in apart.tolist()}
        usual = np.ones(len(segments), bool)
        usual[apart] = False
        count, parts = np.zeros(len(segments), np.int64), []
        count[apart] = [len(alone[i]) for i in apart.tolist()]
        for low, width in zip((0, *WIDTHS), WIDTHS):
            rows = np.flatnonzero(usual & (size > low) & (size <= width))
            if len(rows):
                place = np.arange(width + 1)
                inside = place < size[rows][:, None]
                pieces = self._merge_rows(np.where(inside, known[np.where(inside, base[rows][:, None] + place, 0)], -1))
                count[rows] = (pieces >= 0).sum(axis=1)
                parts.append((rows, pieces[pieces >= 0]))
        edges = np.concatenate([[0], np.cumsum(count)])
        ids = np.empty(edges[-1], np.int32)
        for rows, flat in parts:
            ids[np.repeat(edges[rows], count[rows]) + np.arange(len(flat)) - np.repeat(np.cumsum(count[rows]) - count[rows], count[rows])] = flat
        for i, own in alone.items():
            ids[edges[i]:edges[i + 1]] = own
        return ids, edges

    def merge(self, segment: str) -> list[int]:
        """Ids of a segment, by the agenda: a heap, or for a short segment a list whose least entry is looked up."""
        symbols = self._by_list(segment) if len(segment) <= SHORT else self._by_heap(segment)
        out: list[int] = []
        for s in symbols:
            known = self.ids.get(s)
            if known is not None:
                out.append(known)
            else:
                out += [self.bytes.get(b, self.unknown) for b in s.encode()]
        return out

    def _by_list(self, segment: str) -> list[str]:
        cost, symbols = self.cost.get, list(segment)
        agenda = [cost(segment[i:i + 2], NEVER) for i in range(len(segment) - 1)]
        while agenda and (best := min(agenda)) != NEVER:
            i = agenda.index(best)  # the leftmost of equals
            symbols[i] += symbols.pop(i + 1)
            del agenda[i]
            if i < len(agenda):
                agenda[i] = cost(symbols[i] + symbols[i + 1], NEVER)
            if i:
                agenda[i - 1] = cost(symbols[i - 1] + symbols[i], NEVER)
        return symbols

    def _by_heap(self, segment: str) -> list[str]:
        symbols, cost, n = list(segment), self.cost, len(segment)
        agenda = [(cost[p], i, i + 1, 2) for i in range(n - 1) if (p := segment[i:i + 2]) in cost]
        heapq.heapify(agenda)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while agenda:
            _, left, right, size = heapq.heappop(agenda)
            a, b = symbols[left], symbols[right]
            if not a or not b or len(a) + len(b) != size:
                continue  # one side has been merged meanwhile
            symbols[left], symbols[right] = merged, _ = a + b, ""
            after[left] = follow = after[right]
            if follow < n:
                before[follow] = left
                if (pair := merged + symbols[follow]) in cost:
                    heapq.heappush(agenda, (cost[pair], left, follow, len(pair)))
            lead = before[left]
            if lead >= 0 and (pair := symbols[lead] + merged) in cost:
                heapq.heappush(agenda, (cost[pair], lead, left, len(pair)))
        return [s for s in symbols if s]

    def spell(self, ids: list[int]) -> str:
        """Text of a segment's ids, its word marks as spaces; runs of byte pieces are read as UTF-8."""
        if not any(i in self.value for i in ids):
            return "".join([self.text[i] for i in ids])
        raw = b"".join(bytes([self.value[i]]) if i in self.value else self.text[i].encode() for i in ids)
        return raw.decode("utf-8", "replace")

    def expected(self, segment: str) -> list[int]:
        """What the library makes of a segment inside a text."""
        # it puts a word mark in front: a marked word goes without its first mark, all else behind a line break
        marked = segment[0] == MARK and segment.strip(MARK) != ""
        answer = self.library.encode(segment[1:] if marked else "\n" + segment, num_threads=1)
        return answer if marked else answer[2:]

    def learn(self, segments: list[str]) -> None:
        """Merge new segments and compare them with the library, all in one call: as lines of one text."""
        ids, edges = self.merge_many(segments)
        line = self.bytes.get(10)
        lines = [s for s in segments if s != "\n"]
        same = False
        if self.free and line is not None:
            answer = np.array(self.library.encode("\n" + "\n".join(lines), num_threads=1), np.int32)
            own = np.insert(ids, edges[:-1], line)
            if len(lines) < len(segments):  # the line break itself is asked for alone
                k = segments.index("\n")
                own = np.delete(own, np.arange(edges[k] + k, edges[k + 1] + k + 1))
                same = ids[edges[k]:edges[k + 1]].tolist() == self.expected("\n")
            else:
                same = True
            same = same and np.array_equal(answer[1:], own)
        raw, edge = ids.tobytes(), (4 * edges).tolist()
        self.table.update(zip(segments, [raw[a:b] for a, b in zip(edge[:-1], edge[1:])]))
        if not same:
            for segment in segments:
                right = np.array(self.expected(segment), np.int32).tobytes()
                if self.table[segment] != right:
                    self.table[segment] = right
                    self.corrected += 1
        # pieces of the vocabulary spell a segment as it is written; byte pieces and unknown ones may not
        special = np.ones(self.library.get_piece_size(), bool)
        special[list(self.ids.values())] = False
        odd = np.add.reduceat(special[ids].astype(np.int32), edges[:-1]) > 0
        for i in range(len(segments)) if not same else np.flatnonzero(odd).tolist():
            text = self.spell(np.frombuffer(self.table[segments[i]], np.int32).tolist())
            if text != segments[i].replace(MARK, " "):
                self.respelled[segments[i]] = text

    def encode_batch(self, bodies: list[str]) -> tuple[list[bytes], list[str]]:
        """Per text its ids as int32 with the end id, and the decoded text."""
        marked = [MARK + body.replace(" ", MARK) if body else "" for body in bodies]
        cut = [self.cut(m) for m in marked]
        new = set().union(*cut).difference(self.table)
        if new:
            if len(self.table) + len(new) > TABLE_ENTRIES:
                self.table.clear()
                self.respelled.clear()
                new = set().union(*cut)
            self.learn(list(new))
        get = self.table.__getitem__
        ids = [b"".join([*map(get, segments), self.last]) for segments in cut]
        if self.respelled:
            decoded = ["".join([self.respelled.get(s) or s.replace(MARK, " ") for s in segments])[1:] for segments in cut]
        else:
            decoded = [m.replace(MARK, " ")[1:] for m in marked]
        return ids, decoded

    def encode(self, body: str) -> tuple[bytes, str]:
        """(ids as int32 with the end id, decoded text) of one text."""
        ids, decoded = self.encode_batch([body])
        return ids[0], decoded[0]


_CODECS: dict[int, PieceCodec] = {}


def codec(model: bytes) -> PieceCodec:
    """One codec per worker and model."""
    key = hash(model)
    if key not in _CODECS:
        _CODECS[key] = PieceCodec(model)
    return _CODECS[key]


def encode_pieces(docs: DataFrame, model: bytes, text_col: str = "text", ids_col: str = "ids",
                  decoded_col: str = "decoded") -> DataFrame:
    """Every row with its piece ids (end id last), the text they decode to, and n_corrected.

    `model` is the serialised model (about half a megabyte), shipped with the tasks. Added columns replace columns of
    the same name.
    """
    small_batches(docs.sparkSession)
    kept = [f for f in docs.schema.fields if f.name not in (ids_col, decoded_col, "n_corrected")]
    schema = T.StructType([*kept, T.StructField(ids_col, T.ArrayType(T.IntegerType())),
                           T.StructField(decoded_col, T.StringType()), T.StructField("n_corrected", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = codec(model)
        for batch in batches:
            was = tool.corrected
            ids, decoded = tool.encode_batch([body or "" for body in batch.column(text_col).to_pylist()])
            corrected = [tool.corrected - was, *[0] * (batch.num_rows - 1)][:batch.num_rows]
            ends = np.cumsum([0, *[len(i) // 4 for i in ids]], dtype=np.int32)
            values = pa.Array.from_buffers(pa.int32(), int(ends[-1]), [None, pa.py_buffer(b"".join(ids))])
            yield pa.RecordBatch.from_arrays([*[batch.column(f.name) for f in kept], pa.ListArray.from_arrays(pa.array(ends), values),
                                              pa.array(decoded, pa.string()), pa.array(corrected, pa.int64())], [f.name for f in schema])

    return docs.mapInArrow(run, schema)


def read_model(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def digests(encoded: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", decoded_col: str = "decoded") -> DataFrame:
    """Per row: number of ids and the two digests."""
    return encoded.select(id_col, F.size(ids_col).cast("long").alias("n_tokens"),
                          F.sha2(F.array_join(F.col(ids_col).cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
                          F.sha2(F.col(decoded_col).cast("binary"), 256).alias("decoded_sha256"), "n_corrected")
