"""Hilbert-curve ordering into shards of near equal bytes, in DataFrame functions only.

Several metadata dimensions are quantised to `BITS` bits each (size by its logarithm, categories by a hash) and turned
into a position on a Hilbert curve. Rows are sorted by it and the sorted run is cut into shards at equal byte
quantiles, so a shard covers a compact region in all dimensions at once and file statistics prune on each of them.

Equal texts (same size, CRC-32 and 64-bit hash) form a group: it takes the curve position of its smallest source and
language, hence its rows are neighbours, and it stays in one shard unless it exceeds 1/`WHOLE` of a shard. Larger
groups (a third of all rows, say) are cut like other rows. Law `bytes`: a shard's size is off by at most such a share
plus the largest document.

The global order is found without a single sorting task: a range shuffle on the full key (ties end with the id), sums
per range, running sums inside ranges. Only one row per range is summed in one place.

Null text: size 1, CRC-32 of no bytes. Null categories are a category. Repeated rows keep separate slots. An empty
table gives no rows. Other columns are ignored.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rebuyflow.llm.tables import crc32_of
from rebuyflow.plans.stages import stage

BITS = 10
WHOLE = 16
LARGEST_LOG = 40


def hilbert_index(x: Column, y: Column, z: Column, bits: int = BITS) -> Column:
    """Position of a cell on the three-dimensional Hilbert curve.

    The axes are turned level by level from the highest bit, then Gray-coded, and their bits are interleaved.
    """
    def turn(state, dim, q):
        x, axis, p = state["x"], state[dim], q - 1
        swap = (x.bitwiseXOR(axis)).bitwiseAND(p)
        first = F.when(axis.bitwiseAND(q) != 0, x.bitwiseXOR(p)).otherwise(x.bitwiseXOR(swap))
        moved = F.when(axis.bitwiseAND(q) != 0, axis).otherwise(axis.bitwiseXOR(swap))
        if dim == "x":
            return F.struct(F.when(axis.bitwiseAND(q) != 0, x.bitwiseXOR(p)).otherwise(x).alias("x"), state["y"].alias("y"), state["z"].alias("z"))
        return F.struct(first.alias("x"), *[(moved if d == dim else state[d]).alias(d) for d in "yz"])

    def bit(value, k):
        return F.shiftright(value, k).bitwiseAND(F.lit(1).cast("long"))

    start = F.struct(x.cast("long").alias("x"), y.cast("long").alias("y"), z.cast("long").alias("z"))
    levels = F.array(*[F.lit(1 << k).cast("long") for k in range(bits - 1, 0, -1)])
    steps = F.flatten(F.transform(levels, lambda q: F.transform(F.array(F.lit(0), F.lit(1), F.lit(2)), lambda d: F.struct(q.alias("q"), d.alias("d")))))
    turned = F.aggregate(steps, start, lambda s, e: F.when(e["d"] == 0, turn(s, "x", e["q"])).when(e["d"] == 1, turn(s, "y", e["q"])).otherwise(turn(s, "z", e["q"])))

    def interleave(s):
        gx = s["x"]
        gy = s["y"].bitwiseXOR(gx)
        gz = s["z"].bitwiseXOR(gy)
        flip = F.aggregate(levels, F.lit(0).cast("long"), lambda t, q: F.when(gz.bitwiseAND(q) != 0, t.bitwiseXOR(q - 1)).otherwise(t))
        return F.transform(F.array(flip), lambda t: sum(
            (F.shiftleft(bit(axis.bitwiseXOR(t), k), 3 * k + 2 - i) for k in range(bits) for i, axis in enumerate((gx, gy, gz))),
            F.lit(0).cast("long")))[0]

    return F.transform(F.array(turned), interleave)[0]


def hilbert_shards(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text",
                   categories: tuple[str, str] = ("lang", "source")) -> DataFrame:
    """(id, size, text_crc32, curve, shard, slot): slots are gapless from 0 within a shard."""
    cells = 1 << BITS
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("bytes"),
                       crc32_of(F.coalesce(F.col(text_col), F.lit(""))).alias("crc"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("hash"),
                       *[F.col(c).cast("string").alias(f"cat{i}") for i, c in enumerate(categories)]).withColumn("size", F.col("bytes") + 1)
    rows = stage(rows.withColumn("number", F.monotonically_increasing_id()), "shard-rows")  # the texts are read once; a stored number tells equal rows apart
    same = ["size", "crc", "hash"]
    groups = stage(rows.groupBy(*same).agg(F.count("*").alias("n"), F.sum("size").alias("group_bytes"), F.min("cat0").alias("g0"), F.min("cat1").alias("g1"))
                   .filter("n > 1").drop("n"), "shard-groups")
    total = rows.agg(F.sum("size")).first()[0] or 0  # one number
    joined = rows.join(groups, same, "left")
    whole = F.coalesce(F.col("group_bytes"), F.col("size")) * (shards * WHOLE) <= F.lit(total)
    known = F.col("group_bytes").isNotNull()
    scaled = F.least(F.lit(cells - 1), F.floor(F.log2("size") * (cells / LARGEST_LOG)).cast("int"))
    spread = [F.pmod(F.xxhash64(F.when(known, F.col(f"g{i}")).otherwise(F.col(f"cat{i}"))), F.lit(cells)) for i in range(2)]
    keyed = joined.select("id", "size", "crc", "hash", F.when(~whole, F.col("id")).alias("part"), F.when(~whole, F.col("number")).alias("part_number"), "number",
                          F.when(whole, F.coalesce("group_bytes", "size")).otherwise(F.col("size")).alias("unit_bytes"),
                          hilbert_index(scaled, *spread).alias("curve"))
    unit = ["curve", *same, "part", "part_number"]  # rows of a group that is split are units of their own, with or without an id
    ranged = stage(keyed.repartitionByRange(*unit).withColumn("range", F.spark_partition_id()), "shard-ranges")
    sums = ranged.groupBy("range").agg(F.count("*").alias("n"), F.sum("size").alias("b"))  # one row per range
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("rows_before"), F.coalesce(F.sum("b").over(before), F.lit(0)).alias("bytes_before"))
    inside = Window.partitionBy("range").orderBy(*unit, "id", "number")
    placed = (ranged.withColumn("row", F.row_number().over(inside) - 1)
              .withColumn("start", F.coalesce(F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
              .withColumn("unit_start", F.min("start").over(Window.partitionBy("range", *unit)))
              .join(F.broadcast(offsets), "range"))
    middle = F.col("bytes_before") + F.when(F.col("part_number").isNull(), F.col("unit_start")).otherwise(F.col("start")) + F.col("unit_bytes") / 2
    numbered = stage(placed.select("id", "size", "crc", "curve", (F.col("rows_before") + F.col("row")).alias("index"),
                                   F.least(F.lit(shards - 1), F.floor(middle * shards / F.lit(max(total, 1)))).cast("int").alias("shard")), "shard-numbered")
    first = numbered.groupBy("shard").agg(F.min("index").alias("first"))  # one row per shard
    return numbered.join(F.broadcast(first), "shard").select(F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), "curve", "shard",
                                                             (F.col("index") - F.col("first")).cast("long").alias("slot"))


def write_shards(docs: DataFrame, placed: DataFrame, path: str, id_col: str = "doc_id") -> None:
    """The documents as one folder per shard, in curve order; ids must be unique."""
    (docs.join(placed.select(id_col, "shard", "slot"), id_col).repartition("shard").sortWithinPartitions("shard", "slot")
     .write.partitionBy("shard").parquet(path))
