"""Mixing sources to target weights by temperature.

Source token shares p are raised to an exponent a and normalised: w = p^a / sum p^a. The exponent is bisected (in
sections, one aggregate over the sources for a whole grid of exponents) until the mixture has the target entropy, or,
where that would repeat a source too often, until no source is read more than `max_repetition` times. Each source then
gets the budget w * total tokens, realised as permutations of its blocks: whole epochs first, then the longest prefix
of one more permutation, cut between documents, that stays within the budget.

A block is a hash bucket of one source's rows, so a source with a third of all rows is spread over `BLOCKS` groups and
no task orders a whole source. The result gives every drawn row its epoch, block and position in [0, 1): sorted by
position, every prefix of the mixture has nearly the target weights.

Tokens are words (runs without white space). Null or empty text: no tokens, drawn with its block at no cost. A source
without any tokens keeps weight 0 and is drawn once. A null source is a source. Repeated rows are drawn separately.
An empty table gives an empty mixture. Other columns are kept; columns named like the added ones are replaced.
"""
from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rebuyflow.llm.tables import named
from rebuyflow.plans.stages import stage

BLOCKS = 1024
WORD = r"[^\x20\x09-\x0D]+"
ADDED = ("mix_epoch", "mix_block", "mix_tokens", "mix_position")


@dataclass(frozen=True)
class MixTarget:
    entropy: float = 0.95  # of the largest possible, ln(number of sources)
    max_repetition: float = 2.0
    seed: int = 17


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def find_exponent(sources: DataFrame, target: MixTarget, grid: int = 32, rounds: int = 6) -> tuple[float, float]:
    """(exponent, ln of the normaliser) for `sources` (tokens per source, all positive): one aggregate per round."""
    logs = sources.select(F.ln(F.col("tokens") / F.col("total")).alias("lp"))

    def measure(exponents):
        points = F.explode(F.array(*[F.lit(float(e)) for e in exponents])).alias("a")
        each = logs.select("lp", points).withColumn("q", F.exp(F.col("a") * F.col("lp")))
        rows = each.groupBy("a").agg(F.sum("q").alias("z"), F.sum(F.col("q") * F.col("lp")).alias("zl"), F.max(F.col("q") / F.exp("lp")).alias("r"), F.count("*").alias("n")).collect()
        return {r["a"]: (math.log(r["z"]) - r["a"] * r["zl"] / r["z"], r["r"] / r["z"], r["z"], r["n"]) for r in rows}  # entropy, repetition, normaliser

    def bisect(fits):
        """Largest exponent in [0, 1] below which `fits` holds, which holds at 0 if anywhere."""
        low, high = 0.0, 1.0
        for _ in range(rounds):
            grid_points = [low + (high - low) * k / grid for k in range(grid + 1)]
            found = measure(grid_points)
            good = [a for a in grid_points if fits(found[a])]
            if not good or good[-1] >= high:
                return good[-1] if good else low
            low, high = good[-1], good[-1] + (high - low) / grid
        return low

    by_entropy = bisect(lambda m: m[0] >= target.entropy * math.log(m[3]) - 1e-12)
    value = measure([by_entropy])[by_entropy]
    if value[1] > target.max_repetition:  # repetition falls as the exponent rises to 1
        by_entropy = min(1.0, bisect(lambda m: m[1] > target.max_repetition) + 32.0 ** -rounds)
        value = measure([by_entropy])[by_entropy]
    return by_entropy, math.log(value[2])


def mixing_plan(sources: DataFrame, target: MixTarget) -> DataFrame:
    """Per source (key, tokens, total): weight, budget, whole epochs and what is left for one more."""
    with_tokens = sources.filter("tokens > 0")
    if not with_tokens.head(1):
        return sources.select("key", "tokens", F.lit(0.0).alias("weight"), F.lit(0).cast("long").alias("budget"), F.lit(1).cast("long").alias("epochs"), F.lit(0).cast("long").alias("rest"))
    exponent, log_z = find_exponent(with_tokens, target)
    weight = F.when(F.col("tokens") > 0, F.exp(F.ln(F.col("tokens") / F.col("total")) * exponent - log_z)).otherwise(0.0)
    budget = F.floor(F.col("weight") * F.col("total") + 1e-6).cast("long")
    return (sources.withColumn("weight", weight).withColumn("budget", budget)
            .withColumn("epochs", F.when(F.col("tokens") > 0, F.floor(F.col("budget") / F.greatest("tokens", F.lit(1)))).otherwise(1).cast("long"))
            .withColumn("rest", F.when(F.col("tokens") > 0, F.col("budget") - F.col("epochs") * F.col("tokens")).otherwise(0))
            .select("key", "tokens", "weight", "budget", "epochs", "rest"))


def mix_sources(docs: DataFrame, target: MixTarget = MixTarget(), id_col: str = "doc_id", text_col: str = "text",
                source_col: str = "source", tokens: Column | None = None) -> DataFrame:
    """The drawn rows: all columns, then mix_epoch, mix_block, mix_tokens and mix_position.

    `tokens` (default: the words of the text) measures a row; with it, the rows need not carry their text.
    """
    kept = [c for c in docs.columns if c not in ADDED]
    key = F.coalesce(F.concat(F.lit("="), named(source_col).cast("string")), F.lit("null"))
    hashed = [named(f.name) for f in docs.schema.fields if f.name in kept and f.name != id_col and not f.dataType.simpleString().startswith(("map", "variant"))]
    identity = F.xxhash64(F.lit(target.seed), named(id_col), *hashed)  # rows of one id, or without, are spread by what else they hold
    rows = docs.select(F.struct(*[named(c).alias(c) for c in kept]).alias("row"), key.alias("key"), identity.alias("order"), F.xxhash64(F.lit(target.seed + 1), named(id_col), *hashed).alias("tie"),
                       (word_count(named(text_col)) if tokens is None else tokens.cast("long")).alias("n"))
    rows = rows.withColumn("block", F.pmod(F.col("order"), F.lit(BLOCKS)).cast("int"))
    blocks = stage(rows.groupBy("key", "block").agg(F.sum("n").alias("block_tokens")), "mix-blocks")  # at most BLOCKS rows per source
    sources = blocks.groupBy("key").agg(F.sum("block_tokens").alias("tokens"))
    total = blocks.agg(F.sum("block_tokens")).first()[0] or 0  # one number
    plan = stage(mixing_plan(stage(sources.withColumn("total", F.lit(total)), "mix-sources"), target), "mix-plan")
    epochs = F.explode(F.sequence(F.lit(0).cast("long"), F.when(F.col("rest") > 0, F.col("epochs")).otherwise(F.col("epochs") - 1))).alias("epoch")
    reads = plan.filter("epochs > 0 or rest > 0").select("key", "tokens", "budget", "epochs", "rest", epochs)
    order = Window.partitionBy("key", "epoch").orderBy(F.xxhash64(F.lit(target.seed), "block", "epoch"), "block").rowsBetween(Window.unboundedPreceding, -1)
    dealt = (blocks.join(reads, "key").withColumn("block_start", F.coalesce(F.sum("block_tokens").over(order), F.lit(0)))
             .filter((F.col("epoch") < F.col("epochs")) | (F.col("block_start") < F.col("rest"))))
    inside = Window.partitionBy("key", "block").orderBy("order", "tie").rowsBetween(Window.unboundedPreceding, -1)
    drawn = (rows.withColumn("doc_start", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(dealt, ["key", "block"])
             .withColumn("start", F.col("block_start") + F.col("doc_start"))
             .filter((F.col("epoch") < F.col("epochs")) | (F.col("start") + F.col("n") <= F.col("rest"))))
    at = (F.col("epoch") * F.col("tokens") + F.col("start")) / F.greatest("budget", F.lit(1))
    return drawn.select("row.*", F.col("epoch").cast("int").alias("mix_epoch"), F.col("block").alias("mix_block"), F.col("n").alias("mix_tokens"),
                        F.least(at, F.lit(1.0)).alias("mix_position"))
