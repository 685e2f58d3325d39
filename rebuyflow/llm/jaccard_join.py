"""Word-shingle Jaccard join with adaptive multi-match prefixes.

A document's set holds the hashes of its distinct 5-word shingles. Shingles have one global order: those in the lower
5/16 of the hash range first, rare before frequent, then the others by hash; so only a part of all shingles is counted.
Two sets of similarity t or more share at least l shingles among the first n - ceil(t n) + l of each (n: size). Every
document picks its own l: a longer prefix looks up more lists but asks for more shared shingles before anything is
verified; l minimises the lists' lengths plus what their candidates would cost. A pair must share min(l, l') of the
prefix shingles. Shingles of a single document come first in the order and start no list, so most documents have no
candidates at all.

Equal sets are one set. Short lists are joined pair by pair, multi-match filtered, and verified. Documents tied
together by long lists form clusters, which are verified block against block (bounded tiles, exact intersections by
matrix products); a tile returns a spanning forest of its links, not its pairs. No list, cluster or candidate is
capped. Links are exact up to collisions of 64-bit hashes.

Null or empty text, or text without words: empty set, linked with nothing. One to four words: the whole sequence is the
only shingle. Rows of one id are separate documents that share a name. Rows with a null id are documents without a name:
they link like others, a component is named after its smallest id that is not null, and one of nameless documents only
has a null component_id. Repeated rows have equal sets. Other columns are ignored. Empty table: no rows.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rebuyflow.llm.components import connected_components
from rebuyflow.llm.pivot_index import forest
from rebuyflow.llm.tables import small_batches
from rebuyflow.llm.windows import B, scramble, word_hashes, word_runs
from rebuyflow.plans.stages import stage

WORDS, PERCENT = 5, 75
COUNTED = np.uint64(5 * (1 << 60))
"""Shingles below this hash are counted and ordered by frequency."""
MOST_MATCHES = 4
VERIFY_COST = 20.0
SHORT_LIST = 16
TILE_ROWS, TILE_SHINGLES = 1024, 1 << 20


def shingle_set(body: bytes, words: int = WORDS) -> np.ndarray:
    """Sorted distinct shingle hashes; A-Z count as a-z."""
    data = np.frombuffer(body, np.uint8)
    data = data + np.where((data >= 65) & (data <= 90), 32, 0).astype(np.uint8)
    own = word_hashes(data)
    if not len(own):
        return own
    if len(own) < words:
        return scramble(word_runs(own, len(own)) + np.full(1, len(own), np.uint64) * B)
    return np.unique(word_runs(own, words))


def set_digest(own: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(own.tobytes()) if len(own) else 0


def least_prefix(n: int, percent: int) -> int:
    """Prefix length for one match."""
    return n - -(-n * percent // 100) + 1


def signed(values) -> np.ndarray:
    return np.asarray(values, np.uint64).view(np.int64)


def document_sets(docs: DataFrame, id_col: str, text_col: str, percent: int) -> DataFrame:
    """(k, id, t, n, s, counted, rest): k numbers the rows, t tells texts apart, s sets; rest: what the longest prefix needs beyond counted."""
    kind = docs.schema[id_col].dataType.simpleString()
    rows = _bodies(docs, id_col, text_col)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, s, counted, rest = [], [], [], []
            for body in batch.column("body").to_pylist():
                own = shingle_set(body)
                cut = int(np.searchsorted(own, COUNTED))
                more = max(0, least_prefix(len(own), percent) + MOST_MATCHES - 1 - cut) if len(own) else 0
                n.append(len(own))
                s.append(set_digest(own))
                counted.append(signed(own[:cut]))
                rest.append(signed(own[cut:cut + more]))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("t"), pa.array(n, pa.int32()), pa.array(signed(s)), pa.array(counted, pa.list_(pa.int64())), pa.array(rest, pa.list_(pa.int64()))],
                                             ["id", "t", "n", "s", "counted", "rest"])

    sets = rows.mapInArrow(build, f"id {kind}, t long, n int, s long, counted array<long>, rest array<long>")
    return stage(sets.withColumn("k", F.monotonically_increasing_id()), "shingle-sets")  # numbers are fixed once written


def text_digest(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")).cast("binary"))


def _bodies(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("id"), text_digest(F.col(text_col)).alias("t"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("body"))


def adaptive_prefixes(sets: DataFrame, percent: int) -> DataFrame:
    """(k, n, l, prefix): the shingles of the chosen prefix that can be shared, of one row per set, if there are any."""
    frequency = F.count("*").over(_by("token"))
    shared = sets.select("k", F.explode("counted").alias("token")).withColumn("f", frequency).filter("f > 1")
    lists = shared.groupBy("k").agg(F.array_sort(F.collect_list(F.struct("f", "token"))).alias("m"))
    first = sets.filter("n > 0").groupBy("s", "n").agg(F.min("k").alias("k")).select("k")
    rows = (sets.filter("n > 0").select("k", "n", "rest", F.size("counted").alias("c")).join(first, "k", "left_semi").join(lists, "k", "left")
            .withColumn("m", F.coalesce("m", F.array().cast("array<struct<f:bigint,token:bigint>>"))))
    base = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1
    options = []
    for l in range(1, MOST_MATCHES + 1):
        length = F.least(base + l - 1, F.col("n"))
        listed = F.greatest(F.lit(0), F.least(length - (F.col("c") - F.size("m")), F.size("m"))).cast("int")  # single ones come first
        others = F.greatest(F.lit(0), F.least(length - F.col("c"), F.size("rest"))).cast("int")
        looked = F.aggregate(F.slice("m", F.lit(1), listed), F.lit(0).cast("long"), lambda a, e: a + e["f"] - 1)
        options.append(F.struct((looked * (1 + VERIFY_COST / l)).alias("cost"), F.lit(l).alias("l"), listed.alias("listed"), others.alias("others")))
    # l matches need a set of l shingles: beyond t * n of them a longer prefix proves nothing
    allowed = [F.when(F.lit(l) <= F.ceil(F.col("n") * percent / 100), o) for l, o in enumerate(options, 1)]
    best = F.array_min(F.filter(F.array(*allowed), lambda o: o.isNotNull()))
    prefix = F.concat(F.transform(F.slice("m", F.lit(1), F.col("best.listed")), lambda e: e["token"]), F.slice("rest", F.lit(1), F.col("best.others")))
    return rows.withColumn("best", best).select("k", "n", F.col("best.l").alias("l"), prefix.alias("prefix")).filter(F.size("prefix") > 0)


def _by(*keys: str):
    return Window.partitionBy(*keys)


def similar(n_a, n_b, both, percent: int):
    return both * 100 >= (n_a + n_b - both) * percent


def tile_similar(a: list[np.ndarray], b: list[np.ndarray], percent: int) -> np.ndarray:
    """Which pairs of two blocks of sets reach the similarity."""
    flat = np.concatenate([*a, *b])
    owner = np.repeat(np.arange(len(a) + len(b)), [len(x) for x in [*a, *b]])
    values, at, count = np.unique(flat, return_inverse=True, return_counts=True)
    slot = np.cumsum(count > 1) - 1
    keep = (count > 1)[at]
    at, owner = slot[at[keep]], owner[keep]
    order = np.argsort(at, kind="stable")
    at, owner = at[order], owner[order]
    both = np.zeros((len(a), len(b)), np.float32)
    for c in range(0, int((count > 1).sum()), 4096):
        lo, hi = np.searchsorted(at, [c, c + 4096])
        has = np.zeros((len(a) + len(b), 4096), np.float32)
        has[owner[lo:hi], at[lo:hi] - c] = 1
        both += has[:len(a)] @ has[len(a):].T
    size = np.array([len(x) for x in a])[:, None] + np.array([len(x) for x in b])
    return similar(size, 0, both.astype(np.int64), percent)


def jaccard_roots(docs: DataFrame, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, t, n, root): one row per input row, whose text has the digest t; rows of one component share a root, which is never null."""
    small_batches(docs.sparkSession)
    sets = document_sets(docs, id_col, text_col, percent)
    prefixes = stage(adaptive_prefixes(sets, percent), "jaccard-prefixes")
    entries = prefixes.select("k", "n", F.explode("prefix").alias("token"))
    lists = stage(entries.select("k", "n", "token", F.count("*").over(_by("token")).alias("size"), F.min("k").over(_by("token")).alias("leader")).filter("size > 1"), "jaccard-lists")
    long = lists.filter(F.col("size") > SHORT_LIST)
    clusters = stage(connected_components(long.select(F.col("k").alias("a"), F.col("leader").alias("b"))).select(F.col("node").alias("k"), F.col("component").alias("cluster")), "jaccard-clusters")
    links = _pair_links(docs, sets, prefixes, lists.filter(F.col("size") <= SHORT_LIST), clusters, percent, id_col, text_col)
    linked = connected_components(links).select(F.col("node").alias("k"), F.col("component").alias("root"))
    narrow = sets.select("id", "t", "n", "s", "k")
    first = narrow.filter("n > 0").groupBy("s", "n").agg(F.min("k").alias("first"))
    return stage(narrow.join(first, ["s", "n"], "left").withColumn("first", F.coalesce("first", "k")).join(linked.withColumnRenamed("k", "first"), "first", "left")
                 .select("id", "t", "n", F.coalesce("root", "first").alias("root")), "jaccard-roots")


def jaccard_components(docs: DataFrame, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id): one row per input row."""
    rooted = jaccard_roots(docs, percent, id_col, text_col)
    names = stage(rooted.groupBy("root").agg(F.min("id").alias("component_id")), "jaccard-names")
    return rooted.join(names, "root").select(F.col("id").alias(id_col), F.col("n").cast("long").alias("n_shingles"), "component_id")


def _pair_links(docs, sets, prefixes, short, clusters, percent, id_col, text_col) -> DataFrame:
    """Verified links (a, b): of short lists pair by pair, of clusters as forests of their tiles."""
    x, y = short.select("token", F.col("k").alias("a"), F.col("n").alias("na")), short.select("token", F.col("k").alias("b"), F.col("n").alias("nb"))
    sized = (F.col("na") * 100 >= F.col("nb") * percent) & (F.col("nb") * 100 >= F.col("na") * percent)
    met = x.join(y, "token").filter((F.col("a") < F.col("b")) & sized).groupBy("a", "b", "na", "nb").count().drop("count")
    member = clusters.select("k", "cluster")
    met = (met.join(member.select(F.col("k").alias("a"), F.col("cluster").alias("ca")), "a", "left").join(member.select(F.col("k").alias("b"), F.col("cluster").alias("cb")), "b", "left")
           .filter(~(F.col("ca").eqNullSafe(F.col("cb")) & F.col("ca").isNotNull())))  # a cluster's tiles settle its pairs
    own = prefixes.select("k", "l", "prefix")
    matched = (met.join(own.select(F.col("k").alias("a"), F.col("l").alias("la"), F.col("prefix").alias("pa")), "a")
               .join(own.select(F.col("k").alias("b"), F.col("l").alias("lb"), F.col("prefix").alias("pb")), "b")
               .filter(F.size(F.array_intersect("pa", "pb")) >= F.least("la", "lb")))
    pairs = stage(matched.select("a", "b", "na", "nb"), "jaccard-pairs")
    wanted = pairs.select(F.col("a").alias("k")).unionByName(pairs.select(F.col("b").alias("k"))).unionByName(clusters.select("k")).distinct()
    full = stage(_full_sets(docs, sets.select("k", "id", "t", "s").join(wanted, "k", "left_semi"), id_col, text_col), "jaccard-full")
    both = F.size(F.array_intersect("ta", "tb"))
    verified = (pairs.join(full.select(F.col("k").alias("a"), F.col("tokens").alias("ta")), "a").join(full.select(F.col("k").alias("b"), F.col("tokens").alias("tb")), "b")
                .filter(similar(F.col("na"), F.col("nb"), both, percent)).select("a", "b"))
    return stage(verified, "jaccard-verified").unionByName(stage(_cluster_links(full, clusters, percent), "jaccard-tiles"))


def _full_sets(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(k, tokens) of the wanted rows, from their texts; rows of one id, or of none, meet by their texts only."""
    wanted = wanted.withColumnsRenamed({"id": "wanted_id", "t": "wanted_t"})
    rows = _bodies(docs, id_col, text_col).join(wanted, F.col("id").eqNullSafe(F.col("wanted_id")) & (F.col("t") == F.col("wanted_t"))).select("k", "s", "body")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k, tokens = [], []
            for key, s, body in zip(*[batch.column(c).to_pylist() for c in ("k", "s", "body")]):
                own = shingle_set(body)
                if int(signed([set_digest(own)])[0]) == s:
                    k.append(key)
                    tokens.append(signed(own))
            yield pa.RecordBatch.from_arrays([pa.array(k, pa.int64()), pa.array(tokens, pa.list_(pa.int64()))], ["k", "tokens"])

    return rows.mapInArrow(build, "k long, tokens array<long>").dropDuplicates(["k"])


def _cluster_links(full: DataFrame, clusters: DataFrame, percent: int) -> DataFrame:
    """(a, b): a spanning forest of the links of each tile of each cluster.

    Sets of sizes further apart than the similarity allows never meet: a cluster falls into size bands, and blocks of a
    band meet those of their own and the next one only.
    """
    band = F.floor(F.log(F.size("tokens").cast("double")) / F.log(F.lit(101 / percent))).cast("int")
    rows = stage(full.select("k", band.alias("band"), F.size("tokens").alias("n")).join(clusters, "k"), "jaccard-bands")
    blocks = F.ceil(F.greatest(F.count("*") / TILE_ROWS, F.sum("n") / TILE_SHINGLES)).cast("int")
    sizes = stage(rows.groupBy("cluster", "band").agg(blocks.alias("blocks")), "jaccard-band-sizes")
    own = rows.join(sizes, ["cluster", "band"]).select("k", "cluster", "band", F.pmod(F.xxhash64("k"), F.col("blocks")).cast("int").alias("block"))
    other = sizes.select("cluster", F.col("band").alias("with"), F.col("blocks").alias("others"))
    near = own.withColumn("with", F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1))).join(other, ["cluster", "with"])
    first = (F.col("with") > F.col("band")) | ((F.col("with") == F.col("band")) & (F.col("block") <= F.col("o")))
    sides = [F.col(c) for c in ("band", "block", "with", "o")]
    tiles = (near.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("others") - 1)))
             .select("k", "cluster", "band", "block", *[F.when(first, a).otherwise(b).alias(n) for n, a, b in zip(("bx", "x", "by", "y"), sides, sides[2:] + sides[:2])]))
    dealt = tiles.join(full, "k")

    def verify(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        _, bx, x, by, y = key
        frame = frame.sort_values("k")
        a, b = frame[(frame["band"] == bx) & (frame["block"] == x)], frame[(frame["band"] == by) & (frame["block"] == y)]
        if not len(a) or not len(b):
            return pd.DataFrame({"a": [], "b": []})
        hit = tile_similar([np.asarray(t) for t in a["tokens"]], [np.asarray(t) for t in b["tokens"]], percent)
        if (bx, x) == (by, y):
            i, j = np.nonzero(np.triu(hit, 1))
            label, own = forest(len(a), i, j), a["k"].to_numpy()
        else:
            i, j = np.nonzero(hit)
            label, own = forest(len(a) + len(b), i, j + len(a)), np.concatenate([a["k"].to_numpy(), b["k"].to_numpy()])
        tied = label != np.arange(len(label))
        return pd.DataFrame({"a": own[tied], "b": own[label[tied]]})

    return dealt.groupBy("cluster", "bx", "x", "by", "y").applyInPandas(verify, "a long, b long")
