"""Recalibration of probabilities."""
from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pitchframe.operators.evaluate import clipped
from pitchframe.plans.ordered import ordered_groups
from pitchframe.plans.scratch import written

CLIP = 1e-6
# Distinct probabilities pooled in one task at first.
BLOCK_ROWS = 100_000


def _observed(df: DataFrame, p: str, y: str) -> DataFrame:
    return df.where(F.col(p).isNotNull() & F.col(y).isNotNull())


def platt_scaling(df: DataFrame, p: str, y: str, max_iter: int = 200) -> DataFrame:
    """Add ``calibrated``: a logistic curve over the log-odds of ``p``, fitted to ``y``.

    Equal (p, y) pairs are merged into one weighted row before the iterations.
    """
    safe = clipped(F.col(p), CLIP)
    log_odds = F.log(safe / (1 - safe))
    rows = _observed(df, p, y).select(log_odds.alias("x"), F.col(y).cast("double").alias("label"))
    merged = written(rows.groupBy("x", "label").agg(F.count("*").cast("double").alias("weight")), "platt")
    points = VectorAssembler(inputCols=["x"], outputCol="features").transform(merged)
    model = LogisticRegression(
        regParam=0.0, weightCol="weight", maxIter=max_iter, tol=1e-12
    ).fit(points)
    score = F.lit(float(model.intercept)) + F.lit(float(model.coefficients[0])) * log_odds
    return df.withColumn("calibrated", 1 / (1 + F.exp(-score)))


def pooled(total: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Starts of the blocks that pooling adjacent violators leaves of points in order."""
    starts: list[int] = []
    sums: list[float] = []
    weights: list[float] = []
    for i, (t, w) in enumerate(zip(total.tolist(), weight.tolist())):
        start = i
        while sums and sums[-1] * w >= t * weights[-1]:
            t, w, start = t + sums.pop(), w + weights.pop(), starts.pop()
        starts.append(start)
        sums.append(t)
        weights.append(w)
    return np.asarray(starts, dtype=np.int64)


def _pool(points: pd.DataFrame) -> pd.DataFrame:
    points = points.sort_values("x", kind="stable")
    total, weight = points["total"].to_numpy(), points["weight"].to_numpy()
    starts = pooled(total, weight)
    return pd.DataFrame(
        {
            "curve": points["curve"].to_numpy()[starts],
            "block": points["block"].to_numpy()[starts],
            "x": points["x"].to_numpy()[starts],
            "total": np.add.reduceat(total, starts),
            "weight": np.add.reduceat(weight, starts),
        }
    )


def isotonic_curve(df: DataFrame, p: str, y: str, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``x`` and ``fit``: where each step of the monotone curve over ``p`` starts, and its height.

    Distinct values of ``p`` are dealt in order to blocks of about ``block_rows``. Adjacent
    violators are pooled within each block; then blocks whose neighbour starts lower
    than they end are pooled together, until none does. Pooling leaves few steps of noisy
    outcomes, so the blocks that meet stay small.
    """
    points = _points(_observed(df, p, y).withColumn("curve", F.lit(0).cast("bigint")), p, y)
    return _curves(written(points, "isotonic-points"), block_rows).select("x", "fit")


def _points(df: DataFrame, p: str, y: str) -> DataFrame:
    """Sum and number of the outcomes of every curve and value of ``p``."""
    seen = df.groupBy("curve", F.col(p).cast("double").alias("x"))
    return seen.agg(F.sum(F.col(y).cast("double")).alias("total"), F.count("*").cast("double").alias("weight"))


def _curves(points: DataFrame, block_rows: int) -> DataFrame:
    """curve, x, fit: the steps of the monotone curve over the ``points`` of each curve."""
    blocks = max(1, -(-points.count() // block_rows))
    dealt = points.repartitionByRange(blocks, "curve", "x").withColumn("block", F.spark_partition_id().cast("bigint"))
    steps = written(dealt.select("curve", "block", "x", "total", "weight"), "isotonic-dealt")
    while True:
        steps = steps.groupBy("curve", "block").applyInPandas(_pool, "curve bigint, block bigint, x double, total double, weight double")
        steps = written(steps, "isotonic-steps")
        mean = F.struct("x", (F.col("total") / F.col("weight")).alias("m"))
        ends = steps.groupBy("curve", "block").agg(F.min(mean)["m"].alias("first"), F.max(mean)["m"].alias("last"))
        # a row per curve and block from here on
        order = Window.partitionBy("curve").orderBy("block")
        apart = F.coalesce(F.lag("last").over(order) < F.col("first"), F.lit(True))
        joined = ends.select("curve", "block", F.sum(apart.cast("bigint")).over(order).alias("into"))
        joined = written(joined, "isotonic-blocks")
        if joined.agg(F.count("*") == F.countDistinct("curve", "into")).first()[0]:
            return steps.select("curve", "x", (F.col("total") / F.col("weight")).alias("fit"))
        steps = steps.join(joined, ["curve", "block"]).select("curve", F.col("into").alias("block"), "x", "total", "weight")


def isotonic(df: DataFrame, p: str, y: str, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Add ``calibrated``: the monotone step curve over ``p`` that fits ``y`` best.

    A value of ``p`` between two steps has the lower one's height, one below all
    the height of the first; a null has none.
    """
    curve = written(isotonic_curve(df, p, y, block_rows), "isotonic-curve")
    lowest = curve.agg(F.min("fit")).first()[0]
    value = F.nanvl(F.col(p).cast("double"), F.lit(None).cast("double"))
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    rows = df.select(value.alias("__x"), F.lit(1).alias("__kind"), F.lit(None).cast("double").alias("__fit"), row.alias("__row"))
    nothing = F.lit(None).cast(rows.schema["__row"].dataType)
    steps = curve.select(F.col("x").alias("__x"), F.lit(0).alias("__kind"), F.col("fit").alias("__fit"), nothing.alias("__row"))
    line = ordered_groups(rows.unionByName(steps), [], ["__x", "__kind"])
    # the curve never falls, so the step a value is on is the highest before it
    found = line.running({"__step": ("max", F.col("__fit"))}, inclusive=True).result().where("__kind = 1")
    fit = F.when(F.col("__x").isNotNull(), F.coalesce("__step", F.lit(lowest).cast("double")))
    return found.select("__row.*", fit.alias("calibrated"))


def isotonic_out_of_fold(df: DataFrame, p: str, y: str, fold: str, folds: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Add ``calibrated``: the monotone curve fitted on the folds before the row's alone.

    ``fold`` numbers the rows from 0 to ``folds`` - 1, in the order in which their outcomes became known;
    other rows are an error. Rows of fold 0, of folds before any outcome, and without ``p`` or
    fold have no calibrated value. All curves are pooled together, and what they are made of
    is one row per fold and value of ``p``, repeated for the later folds.
    """
    number = F.col(fold).cast("bigint")
    checked = F.when((number < 0) | (number >= folds), F.raise_error(F.lit(f"fold outside 0 to {folds - 1}"))).otherwise(number)
    seen = _observed(df, p, y).where(number.isNotNull())
    per_fold = _points(seen.withColumn("curve", checked), p, y)
    later = F.explode(F.when(F.col("curve") < folds - 1, F.sequence(F.col("curve") + 1, F.lit(folds - 1).cast("bigint"))))
    points = per_fold.select(later.alias("curve"), "x", "total", "weight")
    points = points.groupBy("curve", "x").agg(F.sum("total").alias("total"), F.sum("weight").alias("weight"))
    curves = written(_curves(written(points, "isotonic-points"), block_rows), "isotonic-curves")

    value = F.nanvl(F.col(p).cast("double"), F.lit(None).cast("double"))
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    rows = df.select(number.alias("__curve"), value.alias("__x"), F.lit(1).alias("__kind"), F.lit(None).cast("double").alias("__fit"), row.alias("__row"))
    nothing = F.lit(None).cast(rows.schema["__row"].dataType)
    steps = curves.select(F.col("curve").alias("__curve"), F.col("x").alias("__x"), F.lit(0).alias("__kind"), F.col("fit").alias("__fit"), nothing.alias("__row"))
    line = ordered_groups(rows.unionByName(steps), ["__curve"], ["__x", "__kind"])
    found = line.running({"__step": ("max", F.col("__fit"))}, inclusive=True).result().where("__kind = 1")
    # one row per fold: its curve's lowest step, for values below the first
    lowest = curves.groupBy(F.col("curve").alias("__curve")).agg(F.min("fit").alias("__lowest"))
    found = found.join(F.broadcast(lowest), "__curve", "left")
    fit = F.when(F.col("__x").isNotNull(), F.coalesce("__step", "__lowest"))
    return found.select("__row.*", fit.alias("calibrated"))


def recalibration_effect(df: DataFrame, p: str, calibrated: str, y: str, fold: str) -> DataFrame:
    """Per fold, rows with an outcome and both probabilities, and their Brier score before and after."""
    both = df.where(F.col(p).isNotNull() & F.col(calibrated).isNotNull() & F.col(y).isNotNull())
    error = lambda c: F.avg(F.pow(F.col(c) - F.col(y), 2))
    return both.groupBy(fold).agg(F.count("*").alias("n"), error(p).alias("brier_before"), error(calibrated).alias("brier_after"))
