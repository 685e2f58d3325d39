"""Phrase collocation mining after Toivonen: a sample proposes, full passes count exactly.

Phrases are runs of one to four words inside a piece of text, counted per group (language). A phrase can only be
frequent if its first and its last part (one word shorter) are. So:

1. A sample of documents (a fixed rate, by hash) proposes the phrases it sees at a lowered threshold, length by length,
   and tells their words.
2. A full pass counts the proposed phrases and their negative border: phrases that were not proposed, but both parts
   were (for a single word there is nothing to ask for). Every occurrence is counted.
3. A border hash that reaches the threshold is a failure: it becomes a proposal, and another pass counts it by its words
   together with the border it opens. Passes go on until no border hash fails. Each settles one length more at least.

The full pass counts proposals by two hashes (80 bits) and gets their words from the sample; a proposal that the sample
never spelled (a false positive of the filter) is spelled in the next pass. The border is counted by 48 bits of a hash:
two phrases with one such hash can only make its count too high, which costs a needless proposal.

Proposals reach the tasks as a bit filter of a fixed size (`filter_bits`), so what is broadcast does not grow. Counting
runs over chunks of bounded size. A task adds up several chunks and sends spelled phrases as rows and hashes as blocks:
all of one range (`bucket`) with their counts, ten bytes each for proposals, six for the border. The ranges are dealt
anew and added up one after the other; their number follows the sample's estimate of the words.

Null text: empty. Null group: `und`. Text without words: counts nothing. Repeated rows count each. Null or equal ids:
any column may be null, ids are used for sampling only. Very long texts are cut at piece borders, never inside a piece.
Extra columns are ignored. Empty table: no rows.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rebuyflow.llm.tables import named, small_batches
from rebuyflow.llm.windows import A, B, C, scramble
from rebuyflow.plans.stages import stage

LONGEST = 4
SCALE = 2_000_000
WORD, GAP, BREAK = 0, 1, 2
CHUNK = 4 << 20
"""Bytes of text counted at once."""
SALTS = 64

_KIND = np.zeros(256, np.uint8)
_KIND[[0x20, 0x09]] = GAP
_KIND[np.frombuffer(b".,;:!?\x0a\x0b\x0c\x0d", np.uint8)] = BREAK
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_MASK = np.array([0, *[(1 << 8 * n) - 1 for n in range(1, 9)]], np.uint64)
HELD = 1 << 20
"""Phrases or hashes a task holds before it sends them."""
KEPT_BITS = 48
"""Bits of a hash that the filter and the border know."""
LEAST_BUCKET_BITS = 9
PER_BUCKET = 1 << 21
"""Words of the corpus per range of hashes."""
COUNTED = "lang string, phrase string, c long, h long, g int"


@dataclass(frozen=True)
class PhraseConfig:
    """`sample_one_in`: documents of the sample; `sample_share`: the lowered threshold as a share of the expected count."""
    least: int = 30
    absorbed_percent: int = 80
    best: int = 2000
    sample_one_in: int = 5
    sample_share: float = 0.7
    filter_bits: int = 25

    @property
    def sample_least(self) -> int:
        return max(2, int(self.least / self.sample_one_in * self.sample_share))


def _word_table(data: np.ndarray):
    """(start, size, piece, hash, second hash) of each word; data is lower-cased and ends in eight bytes of padding."""
    kind = _KIND[data]
    inside = np.empty(len(kind) + 2, bool)
    inside[0] = inside[-1] = False
    np.equal(kind, WORD, out=inside[1:-1])
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    start, size = edge[::2].copy(), edge[1::2] - edge[::2]
    piece = np.cumsum(kind == BREAK, dtype=np.int32)[start]
    eight = np.ndarray((max(len(data) - 7, 0),), np.uint64, data, strides=(1,))
    h, g = size.astype(np.uint64) * B, size.astype(np.uint64) * C
    open_, at = np.arange(len(start)), 0
    while len(open_):  # eight bytes of every word that is still that long
        value = eight[start[open_] + at] & _MASK[np.minimum(size[open_] - at, 8)]
        h[open_] = scramble(h[open_] + value * A)
        g[open_] = scramble(g[open_] ^ value * B) * C
        at += 8
        open_ = open_[size[open_] > at]
    return start, size, piece, h, g


def _places(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The two bits of a phrase in the filter."""
    h, shift = h >> np.uint64(64 - KEPT_BITS) << np.uint64(64 - KEPT_BITS), np.uint64(64 - bits)
    return h >> shift, (h * C) >> shift


class BitFilter:
    """Membership in a set of phrase hashes, without false negatives."""

    def __init__(self, words: np.ndarray, bits: int):
        self.octets, self.bits = words.view(np.uint8), bits

    def has(self, h: np.ndarray) -> np.ndarray:
        first, second = _places(h, self.bits)
        found = self._bit(first)
        some = np.flatnonzero(found)
        found[some] = self._bit(second[some])
        return found

    def _bit(self, place: np.ndarray) -> np.ndarray:
        return (self.octets[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8) & np.uint8(1)).astype(bool)


def _runs(h: np.ndarray, g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order that puts equal (h, g) side by side, and where each run of them begins."""
    order = np.argsort(h)
    x, y = h[order], g[order]
    new = np.concatenate([[True], x[1:] != x[:-1]])
    if not (new[1:] | (y[1:] == y[:-1])).all():  # a hash of two phrases
        order = np.lexsort((g, h))
        x, y = h[order], g[order]
        new = np.concatenate([[True], (x[1:] != x[:-1]) | (y[1:] != y[:-1])])
    return order, np.flatnonzero(new)


def _written(data: np.ndarray, start: np.ndarray, size: np.ndarray, first: np.ndarray, k: int) -> pa.Array:
    """The k words from each of the given ones on, joined by single spaces."""
    sizes = np.stack([size[first + j] for j in range(k)])
    edges = np.concatenate([[0], np.cumsum(sizes.sum(axis=0) + k - 1)])
    letters, at = np.full(edges[-1], 32, np.uint8), edges[:-1].copy()
    for j in range(k):
        within = np.arange(sizes[j].sum()) - np.repeat(np.cumsum(sizes[j]) - sizes[j], sizes[j])
        letters[np.repeat(at, sizes[j]) + within] = data[np.repeat(start[first + j], sizes[j]) + within]
        at += sizes[j] + 1
    return pa.Array.from_buffers(pa.large_binary(), len(first), [None, pa.py_buffer(edges.astype(np.int64)), pa.py_buffer(letters)]).cast(pa.binary()).cast(pa.string())


def count_chunk(texts: list[bytes], langs: list[str], known: BitFilter, before: BitFilter | None, spell: BitFilter | bool):
    """Spelled phrases as (h, g, count, lang, phrase), proposals as (h, g, count), border phrases as (h, count).

    Proposals are spelled where `spell` is true. Left out is what an earlier pass with the filter `before` has counted,
    but for proposals in the filter `spell`. Without `before`, the empty phrase of a group holds its number of words.
    """
    data = _LOWER[np.frombuffer(b"\n".join(texts) + b"\n" * 8, np.uint8)]
    start, size, piece, h, g = _word_table(data)
    if not len(start):
        return
    names, code = np.unique(np.array(langs, dtype=object), return_inverse=True)
    owner = code[np.searchsorted(np.cumsum([len(t) + 1 for t in texts]), start, side="right")]
    salt_of = scramble(np.array([hash_text(n) for n in names], np.uint64))
    h, g = scramble(h ^ salt_of[owner]), g ^ salt_of[owner]

    if before is None:
        yield np.zeros(len(names), np.uint64), salt_of, np.bincount(owner, minlength=len(names)), pa.array(names, pa.string()), pa.array([""] * len(names), pa.string())

    def reach(filter_, shorter):
        """(proposed, proposed or both parts proposed) of this length, from the proposed ones a word shorter."""
        member = filter_.has(h)
        return member, member | (True if shorter is None else shorter[:len(h)] & shorter[1:len(h) + 1])

    in_known = in_before = None
    for k in range(1, LONGEST + 1):
        if k > 1:
            n = len(start) - k + 1
            if n <= 0:
                break
            h, g = scramble(h[:n] * B + words_h[k - 1:]), scramble(g[:n] * A + words_g[k - 1:])
        else:
            words_h, words_g = h, g
        whole = piece[:len(h)] == piece[k - 1:]
        in_known, near = reach(known, in_known)
        member, border = in_known & whole, near & ~in_known & whole
        if before is not None:
            in_before, near = reach(before, in_before)
            member, border = member & (~in_before | spell.has(h)), border & ~near
        pick = np.flatnonzero(member)
        if len(pick):
            order, new = _runs(h[pick], g[pick])
            first, count = pick[order[new]], np.diff(np.concatenate([new, [len(pick)]]))
            if spell is False:
                yield h[first], g[first], count
            else:
                yield h[first], g[first], count, pa.array(names[owner[first]], pa.string()), _written(data, start, size, first, k)
        if border.any():
            yield np.unique(h[border] >> np.uint64(64 - KEPT_BITS), return_counts=True)


def hash_text(name: str) -> int:
    """A 64-bit number of a group's name, the same in every process."""
    value = 0
    for b in name.encode():
        value = (value * 0x100000001B3 + b + 1) % (1 << 64)
    return value


def _cut_long(body: bytes) -> Iterator[bytes]:
    """A text in parts of about CHUNK bytes that end at a piece border."""
    marks = (b".", b",", b";", b":", b"!", b"?", b"\n", b"\x0b", b"\x0c", b"\r")
    while len(body) > CHUNK:
        cut = max(body.rfind(mark, 0, CHUNK) for mark in marks)
        if cut <= 0:
            ahead = [p for mark in marks if (p := body.find(mark, CHUNK)) > 0]
            if not ahead:
                break
            cut = min(ahead)
        yield body[:cut]
        body = body[cut:]
    yield body


def _planes(values: np.ndarray, n: int) -> np.ndarray:
    """The n low bytes of each number, one row per number."""
    return np.ascontiguousarray(values).view(np.uint8).reshape(len(values), -1)[:, :n]


def _numbers(planes: np.ndarray) -> np.ndarray:
    """Numbers of the given low bytes, one row per byte."""
    wide = np.zeros((planes.shape[1], 8), np.uint8)
    wide[:, :len(planes)] = planes.T
    return wide.view(np.uint64).ravel()


class Sums:
    """What a task has counted and not sent yet: spelled phrases, proposals, border."""

    def __init__(self, bucket_bits: int):
        self.bits, self.held = bucket_bits, {5: [], 3: [], 2: []}

    def add(self, part) -> Iterator[pa.RecordBatch]:
        held = self.held[len(part)]
        held.append(part)
        if sum(len(p[0]) for p in held) >= HELD:
            yield from self.send(len(part))

    def send(self, kind: int) -> Iterator[pa.RecordBatch]:
        parts, self.held[kind] = self.held[kind], []
        if not parts:
            return
        h = np.concatenate([p[0] for p in parts])
        g = np.concatenate([p[1] for p in parts]) if kind > 2 else np.zeros(len(h), np.uint64)
        count = np.concatenate([p[2 if kind > 2 else 1] for p in parts])
        order, new = _runs(h, g)
        first, count = order[new], np.add.reduceat(count[order], new)
        h, g = h[first], g[first]
        if kind == 5:
            lang, phrase = (pa.concat_arrays([p[i] for p in parts]).take(pa.array(first)) for i in (3, 4))
            yield self._batch(h >> np.uint64(64 - self.bits), h=pa.array(h.view(np.int64)), g=pa.array((g >> np.uint64(48)).astype(np.int32)), lang=lang, phrase=phrase, c=pa.array(count))
            return
        times = (count + 254) // 255  # counts beyond a byte are sent in parts
        byte = np.full(times.sum(), 255, np.uint8)
        byte[np.cumsum(times) - 1] = count - 255 * (times - 1)
        width = 64 if kind == 3 else KEPT_BITS
        h, g = np.repeat(h, times), np.repeat(g, times)
        bucket = h >> np.uint64(width - self.bits)
        rows = [_planes(h & np.uint64((1 << (width - self.bits)) - 1), 7), _planes(g >> np.uint64(48), 2)] if kind == 3 else [_planes(h & np.uint64((1 << (width - self.bits)) - 1), 5)]
        rows = np.hstack([*rows, byte[:, None]])
        edge = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]]))
        blocks = pa.array([rows[a:b].T.tobytes() for a, b in zip(edge[:-1].tolist(), edge[1:].tolist())], pa.binary())
        yield self._batch(bucket[edge[:-1]], **{"proposed" if kind == 3 else "border": blocks})

    def _batch(self, bucket: np.ndarray, **columns) -> pa.RecordBatch:
        kinds = {"h": pa.int64(), "g": pa.int32(), "lang": pa.string(), "phrase": pa.string(), "c": pa.int64(), "proposed": pa.binary(), "border": pa.binary()}
        return pa.RecordBatch.from_pydict({"bucket": pa.array(bucket.astype(np.int32))} | {name: columns.get(name, pa.nulls(len(bucket), kind)) for name, kind in kinds.items()})


def _frequent_hashes(blocks: list[bytes], bytes_of_h: int, bytes_of_g: int, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Low bits, second hash and sum of the hashes in one range's blocks that reach `least`."""
    rows = np.hstack([np.frombuffer(b, np.uint8).reshape(bytes_of_h + bytes_of_g + 1, -1) for b in blocks])
    h, g = _numbers(rows[:bytes_of_h]), _numbers(rows[bytes_of_h:-1])
    order, new = _runs(h, g)
    c = np.add.reduceat(rows[-1][order].astype(np.int64), new)
    some = c >= least
    return h[order[new[some]]], g[order[new[some]]], c[some]


def count_phrases(texts: DataFrame, known, before, spell, bits: int, bucket_bits: int, least: int) -> DataFrame:
    """What occurs at least `least` times in `texts` (lang, body): spelled phrases (lang, phrase, c, h, g), proposals
    (c, h, g) and border hashes (c, h).

    `known`, `before` and `spell` are broadcast bit filters (numpy words); see `count_chunk`.
    """
    small_batches(texts.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, old = BitFilter(known.value, bits), None if before is None else BitFilter(before.value, bits)
        spelled = spell if isinstance(spell, bool) else BitFilter(spell.value, bits)
        held, langs, size, sums = [], [], 0, Sums(bucket_bits)

        def chunk():
            for part in count_chunk(held, langs, now, old, spelled):
                yield from sums.add(part)

        for batch in batches:
            for lang, body in zip(batch.column("lang").to_pylist(), batch.column("body").to_pylist()):
                for part in _cut_long(body):
                    held.append(part)
                    langs.append(lang)
                    size += len(part)
                    if size >= CHUNK:
                        yield from chunk()
                        held, langs, size = [], [], 0
        if held:
            yield from chunk()
        for kind in sums.held:
            yield from sums.send(kind)

    def total(own: dict[str, list], bucket: int) -> Iterator[pa.RecordBatch]:
        """What is frequent in one range."""
        if own["phrases"]:
            table = pa.Table.from_batches(own["phrases"]).group_by(["lang", "phrase"]).aggregate([("c", "sum"), ("h", "min"), ("g", "min")])
            table = table.rename_columns(["lang", "phrase", "c", "h", "g"])
            yield from table.filter(pc.or_(pc.greater_equal(table["c"], least), pc.equal(table["phrase"], ""))).to_batches()
        for name, bytes_of_h, bytes_of_g, width in (("proposed", 7, 2, 64), ("border", 5, 0, KEPT_BITS)):
            if own[name]:
                h, g, c = _frequent_hashes(own[name], bytes_of_h, bytes_of_g, least)
                h = (np.uint64(bucket) << np.uint64(width - bucket_bits) | h) << np.uint64(64 - width)
                none = pa.nulls(len(h), pa.string())
                yield pa.RecordBatch.from_arrays([none, none, pa.array(c), pa.array(h.view(np.int64)), pa.array(g.astype(np.int32)) if bytes_of_g else pa.nulls(len(h), pa.int32())],
                                                 ["lang", "phrase", "c", "h", "g"])

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, open_ = {"phrases": [], "proposed": [], "border": []}, None
        for batch in batches:
            bucket = batch.column("bucket").to_numpy()
            edge = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]])).tolist() if len(bucket) else [0]
            for a, b in zip(edge[:-1], edge[1:]):
                if bucket[a] != open_ and open_ is not None:
                    yield from total(own, open_)
                    own = {name: [] for name in own}
                open_, part = int(bucket[a]), batch.slice(a, b - a)
                spelled = part.filter(part.column("phrase").is_valid())
                if spelled.num_rows:
                    own["phrases"].append(spelled.select(["lang", "phrase", "c", "h", "g"]))
                for name in ("proposed", "border"):
                    own[name] += part.column(name).drop_null().to_pylist()
        if open_ is not None:
            yield from total(own, open_)

    sent = texts.mapInArrow(run, "bucket int, h long, g int, lang string, phrase string, c long, proposed binary, border binary")
    return sent.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(add_up, COUNTED)


def filter_words(phrases: DataFrame, bits: int) -> np.ndarray:
    """The bit filter of the phrases' hashes: bits are joined in the cluster, the driver gets one row per filter word."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = batch.column("h").to_numpy(zero_copy_only=False).view(np.uint64)
            place = np.unique(np.concatenate(_places(h, bits)))
            word, first = np.unique(place >> np.uint64(6), return_index=True)
            value = np.bitwise_or.reduceat(np.uint64(1) << (place & np.uint64(63)), first) if len(first) else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(word.astype(np.int32)), pa.array(value.view(np.int64))], ["word", "value"])

    rows = phrases.select("h").mapInArrow(run, "word int, value long").groupBy("word").agg(F.bit_or("value").alias("value")).toArrow()
    words = np.zeros(1 << (bits - 6), np.uint64)
    words[rows.column("word").to_numpy()] = rows.column("value").to_numpy().view(np.uint64)
    return words


def _grow(texts: DataFrame, proposed: np.ndarray, least: int, bits: int, bucket_bits: int, names: DataFrame | None = None) -> tuple[list[DataFrame], np.ndarray]:
    """Count proposals and border, propose what fails, and go on until nothing does.

    With `names`, the first pass counts proposals by hash and they are spelled from there. Returns the frequent phrases
    (lang, phrase, c, h, g), one stored table per pass, and the filter of the last proposals.
    """
    context, before, spell, tables = texts.sparkSession.sparkContext, None, names is None, []
    while True:
        known = context.broadcast(proposed)
        counted = stage(count_phrases(texts, known, before, spell, bits, bucket_bits, least), "phrases")
        spelled, hashed = counted.filter("phrase IS NOT NULL"), counted.filter("phrase IS NULL AND g IS NOT NULL")
        unspelled = np.zeros_like(proposed)
        if names is not None and before is None:
            spelled = spelled.unionByName(hashed.drop("lang", "phrase").join(names.select("lang", "phrase", "h", "g"), ["h", "g"]))
            unspelled = filter_words(hashed.join(names, ["h", "g"], "left_anti"), bits)
        tables.append(spelled)
        extended = proposed | filter_words(counted.filter("phrase IS NULL AND g IS NULL"), bits)
        if (extended == proposed).all() and not unspelled.any():
            return tables, proposed
        before, proposed, spell = known, extended, context.broadcast(unspelled)


def frequent_phrases(docs: DataFrame, cfg: PhraseConfig = PhraseConfig(), lang_col: str = "lang", text_col: str = "text", id_col: str = "doc_id") -> list[DataFrame]:
    """Every phrase of up to four words with at least `least` occurrences as (lang, phrase, c, h, g), one table per full pass.

    In the first table, the empty phrase holds a group's number of words. No phrase is in two tables.
    """
    columns = [F.coalesce(named(lang_col), F.lit("und")).alias("lang"), F.coalesce(named(text_col), F.lit("")).cast("binary").alias("body")]
    drawn = F.pmod(F.xxhash64(named(id_col), named(text_col)), F.lit(cfg.sample_one_in)) == 0
    nothing = np.zeros(1 << (cfg.filter_bits - 6), np.uint64)
    seen, proposed = _grow(docs.filter(drawn).select(*columns), nothing, cfg.sample_least, cfg.filter_bits, LEAST_BUCKET_BITS)
    words = (seen[0].filter("phrase = ''").agg(F.sum("c")).first()[0] or 0) * cfg.sample_one_in
    names = reduce(DataFrame.unionByName, seen).filter("phrase <> ''")
    tables, _ = _grow(docs.select(*columns), proposed, cfg.least, cfg.filter_bits, max(LEAST_BUCKET_BITS, (words // PER_BUCKET).bit_length()), names)
    return tables


def collocations(docs: DataFrame, cfg: PhraseConfig = PhraseConfig(), lang_col: str = "lang", text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) of each group's best phrases.

    A phrase's score is that of its lowest-scoring cut into two parts, floor(2000000 a / (l + r)) in exact decimals. A
    phrase inside a longer one with at least `absorbed_percent` of its occurrences is dropped.
    """
    tables = frequent_phrases(docs, cfg, lang_col, text_col, id_col)
    every = stage(reduce(DataFrame.unionByName, tables), "phrase-counts")
    words = F.split("phrase", " ")
    counts = every.filter("phrase <> ''").select("lang", "phrase", words.alias("words"), F.size(words).alias("k"), "c")
    total = every.filter("phrase = ''").select("lang", F.col("c").alias("n"))
    candidates = counts.filter("k > 1")

    inside = candidates.filter("k > 2").select("lang", "c", "k", "words").withColumn("size", F.explode(F.sequence(F.lit(2), F.col("k") - 1)))
    inside = inside.withColumn("from", F.explode(F.sequence(F.lit(1), F.col("k") - F.col("size") + 1)))
    inside = inside.groupBy("lang", F.array_join(F.slice("words", F.col("from"), F.col("size")), " ").alias("phrase")).agg(F.max("c").alias("longer"))
    stays = F.col("longer").isNull() | (F.col("longer").cast("decimal(38,0)") * 100 < F.col("a").cast("decimal(38,0)") * cfg.absorbed_percent)
    left = (candidates.withColumnRenamed("c", "a").join(inside, ["lang", "phrase"], "left").filter(stays).drop("longer"))

    cuts = left.withColumn("cut", F.explode(F.sequence(F.lit(1), F.col("k") - 1)))
    sides = cuts.select("lang", "phrase", "a", "cut", F.explode(F.array(
        F.struct(F.lit(True).alias("first"), F.array_join(F.slice("words", F.lit(1), F.col("cut")), " ").alias("part")),
        F.struct(F.lit(False).alias("first"), F.array_join(F.slice("words", F.col("cut") + 1, F.col("k") - F.col("cut")), " ").alias("part")))).alias("s"))
    sides = sides.select("lang", "phrase", "a", "cut", "s.first", "s.part")
    known = counts.filter(F.col("k") < LONGEST).select("lang", F.col("phrase").alias("part"), "c")
    both = (sides.join(known, ["lang", "part"]).groupBy("lang", "phrase", "a", "cut")
            .agg(F.max(F.when(F.col("first"), F.col("c"))).alias("l"), F.max(F.when(~F.col("first"), F.col("c"))).alias("r")))
    ratio = F.expr(f"CAST(CAST(a AS DECIMAL(19,0)) * {SCALE} AS DECIMAL(38,0)) DIV (CAST(l AS DECIMAL(19,0)) + CAST(r AS DECIMAL(19,0)))")
    worst = F.min(F.struct(ratio.alias("score"), "cut", "l", "r")).alias("w")
    scored = both.groupBy("lang", "phrase", "a").agg(worst).select("lang", "phrase", "a", "w.l", "w.r", "w.score")

    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    salted = scored.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    ahead = salted.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).filter(F.col("rank") <= cfg.best)
    best = ahead.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= cfg.best)
    return best.join(total, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
