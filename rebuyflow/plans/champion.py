"""Trained champions: written once under a version, promoted by a pointer, read back as the daily batch's forecast.

A store is a folder of any file system Spark reads:
- `versions/<version>/<target>`: one set of trees per target, never overwritten;
- `versions/<version>/card`: one row about the version, written after its trees, so a version without a card is unfinished;
- `promotions`: one row per promotion, appended last. The latest one names the champion; earlier ones stay, so going
  back to a former version is one more promotion.

What passes the driver is the models and their cards, whose size the tree configuration bounds.
"""
from __future__ import annotations

from dataclasses import dataclass
from hashlib import sha256

from pyspark.errors import AnalysisException
from pyspark.ml.regression import GBTRegressionModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rebuyflow.functions.scalars import half_up_min1
from rebuyflow.operators import models
from rebuyflow.operators.features import with_day_facts

MODE = "base"
TARGETS = {"gap": "target_gap_days", "quantity": "target_quantity"}
CARD = ("version string, features array<string>, training_rows bigint, last_origin_on date, gap_rounds int, quantity_rounds int, "
        "gap_digest string, quantity_digest string")
PROMOTION = "number bigint, version string, reason string, promoted_at timestamp"


def tree_digest(trees: GBTRegressionModel) -> str:
    """Digest of every split, leaf value and weight."""
    return sha256(f"{trees.treeWeights}{trees.toDebugString.partition(chr(10))[2]}".encode()).hexdigest()


@dataclass(frozen=True)
class Champion:
    """Trees of one version as the `forecast` of `run_daily`."""

    version: str
    trees: dict[str, GBTRegressionModel]
    card: dict

    def __call__(self, known: DataFrame, waiting: DataFrame, hist: DataFrame) -> DataFrame:
        """Gap and quantity of the open origins; only those meet the customer and product facts of their day."""
        rows = with_day_facts(waiting, hist)
        for target, trees in self.trees.items():
            rows = models.predict_value(rows, trees, MODE, f"raw_{target}")
        return rows.select("origin_event_id", *[half_up_min1(F.greatest(f"raw_{target}", F.lit(1.0))).alias(name) for target, name in
                                                (("gap", "champion_gap_days"), ("quantity", "champion_quantity"))])


def train(version: str, origins: DataFrame, cfg: models.TreeConfig = models.TreeConfig()) -> Champion:
    """Champion of split origins: rounds chosen on the early-stop rows, refit on the whole training pool."""
    eligible = origins.filter("role_eligible")
    parts = {role: eligible.filter(F.col("fit_role") == role).withColumn("is_early", F.lit(role == "early_stop")) for role in ("train_core", "early_stop")}
    inner = models.labelled(parts["train_core"].unionByName(parts["early_stop"]), MODE)
    pool = models.labelled(origins.filter("train_pool"), MODE)
    fits = {name: models.train_target(inner, pool, label, cfg) for name, label in TARGETS.items()}
    seen = pool.agg(F.count("*").alias("rows"), F.max("origin_on").alias("last")).first()
    card = {"version": version, "features": models.feature_names(MODE), "training_rows": seen["rows"], "last_origin_on": seen["last"],
            **{f"{name}_rounds": rounds for name, (_, rounds) in fits.items()}, **{f"{name}_digest": tree_digest(trees) for name, (trees, _) in fits.items()}}
    return Champion(version, {name: trees for name, (trees, _) in fits.items()}, card)


@dataclass(frozen=True)
class ModelStore:
    """Versions and promotions under one folder."""

    spark: SparkSession
    root: str

    def _path(self, version: str, part: str) -> str:
        return f"{self.root}/versions/{version}/{part}"

    def _one_row(self, row: dict, schema: str) -> DataFrame:
        return self.spark.createDataFrame([row], schema).coalesce(1)

    def save(self, champion: Champion) -> None:
        """Write a version; one that exists, finished or not, is an error."""
        for name, trees in champion.trees.items():
            trees.write().save(self._path(champion.version, name))
        self._one_row(champion.card, CARD).write.mode("errorifexists").parquet(self._path(champion.version, "card"))

    def card(self, version: str) -> dict:
        try:
            return self.spark.read.schema(CARD).parquet(self._path(version, "card")).first().asDict()
        except AnalysisException as missing:
            raise ValueError(f"No finished version {version} in {self.root}") from missing

    def promotions(self) -> DataFrame:
        """All promotions; none in a new store."""
        try:
            return self.spark.read.schema(PROMOTION).parquet(f"{self.root}/promotions")
        except AnalysisException:
            return self.spark.createDataFrame([], PROMOTION)

    def promote(self, version: str, reason: str) -> None:
        """Make a finished version the champion."""
        self.card(version)
        last = self.promotions().agg(F.max("number")).first()[0]
        row = self._one_row({"number": (last or 0) + 1, "version": version, "reason": reason, "promoted_at": None}, PROMOTION)
        row.withColumn("promoted_at", F.current_timestamp()).write.mode("append").parquet(f"{self.root}/promotions")

    def current(self) -> str:
        """The version promoted last; of two promotions under one number the greater version."""
        last = self.promotions().agg(F.max(F.struct("number", "version")).alias("last")).first()["last"]
        if last is None:
            raise ValueError(f"No champion in {self.root}")
        return last["version"]

    def load(self, version: str | None = None) -> Champion:
        """The champion or a given version; trees that differ from their card or need other inputs are an error."""
        version = version or self.current()
        card = self.card(version)
        if card["features"] != models.feature_names(MODE):
            raise ValueError(f"Version {version} was trained on other inputs")
        trees = {name: GBTRegressionModel.load(self._path(version, name)) for name in TARGETS}
        changed = [name for name in TARGETS if tree_digest(trees[name]) != card[f"{name}_digest"]]
        if changed:
            raise ValueError(f"Version {version} differs from its card: {', '.join(changed)}")
        return Champion(version, trees, card)
