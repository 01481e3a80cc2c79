"""Walk-forward learners: the rows of all folds are binned once, and trees and lines are fitted and scored by Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import trees
from tessera.operators.evaluation import rank_ic
from tessera.operators.panel import fold_rows
from tessera.sinks.steps import forget, materialize

LEARNERS = ("boosted", "forest", "ridge")


def walk_forward(
    panel: DataFrame, features: list[str], label: str, *, train: int = 504, test: int = 63, boosted: trees.Shape = trees.Shape(depth=6, least=20, reg=1.0), rounds: int = 100, rate: float = 0.05,
    forest: trees.Shape = trees.Shape(depth=15, least=10, columns=0.5), many: int = 100, reg: float = 1.0,
) -> DataFrame:
    """fold, d, ticker, one score per learner and their mean, for the test rows of each fold.

    Features are in [-1, 1] and cut into equal bins. Each fold learns from all rows with a label of its `train` dates before the test
    block; its test rows go through the trees with them, without counting. Boosted trees take `rounds` passes of up to `depth` levels each,
    the forest's `many` trees are grown at once, of rows and features drawn by hash; both as tessera.operators.trees does. A fold without
    labelled rows scores 0.
    """
    width, bins = len(features), boosted.bins
    rows = fold_rows(panel, train, test).select("fold", "is_train", "d", "ticker", F.col(label).cast("double").alias("y"), trees.binned(features, bins).alias("x"))
    counts = F.col("is_train") & F.col("y").isNotNull()
    rows = rows.where(~F.col("is_train") | counts).select("fold", "d", "ticker", F.when(counts, F.col("y")).alias("y"), counts.cast("long").alias("w"), "x")
    rows = materialize(rows, "folds")
    one = trees.boost(rows, boosted, width, rounds=rounds, rate=rate)
    two = trees.forest(rows, trees.Shape(**(vars(forest) | {"bins": bins})), width, trees=many, key=["d", "ticker"])
    weights = materialize(trees.ridge(rows, boosted, width, reg=reg), "lines")
    ahead = one.where("w = 0").select("fold", "d", "ticker", "x", F.col("pred").alias("boosted")).join(two.withColumnRenamed("pred", "forest"), ["fold", "d", "ticker"]).join(weights, "fold", "left")
    scored = ahead.select("fold", "d", "ticker", "boosted", "forest", F.coalesce(trees.line("weights", "x", bins), F.lit(0.0)).alias("ridge"))
    forget(rows)
    return scored.withColumn("score", sum((F.col(k) for k in LEARNERS[1:]), F.col(LEARNERS[0])) / len(LEARNERS))


def learner_ics(scored: DataFrame, labels: DataFrame) -> DataFrame:
    """model, mean, n: rank coefficient of each learner and of their mean, ranked at once."""
    rows = scored.join(labels, ["ticker", "d"]).unpivot(["d", "ticker", "fwd"], [*LEARNERS, "score"], "model", "value")
    ics = rank_ic(rows.withColumn("score", F.round("value", 9)), "model", "d")
    return ics.groupBy("model").agg(F.avg("ic").alias("mean"), F.count("ic").alias("n"))
