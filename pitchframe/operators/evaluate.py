"""Chronological folds, calibration metrics and correlations."""
from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitchframe.operators.clean import with_dates
from pitchframe.plans.ordered import ordered_groups

INITIAL_TRAIN_SIZE = 200
STEP_SIZE = 38
CLIP = 1e-15


def walk_forward_folds(
    fixtures: DataFrame,
    initial_train_size: int = INITIAL_TRAIN_SIZE,
    step_size: int = STEP_SIZE,
    keep: Sequence[str] = (),
) -> DataFrame:
    """Chronological position and test fold of each fixture, with the columns ``keep``.

    Fold 0 is only ever trained on. Fold k is tested with a model trained on all
    rows of the folds before it, the first ``train_rows`` positions.
    """
    ranked = (
        ordered_groups(with_dates(fixtures).select("fixture_id", "date", *keep), [], ["date", "fixture_id"])
        .running({"position": ("count", F.lit(1))}, inclusive=True)
        .result()
    )
    fold = F.greatest(F.ceil((F.col("position") - initial_train_size) / step_size), F.lit(0))
    train = F.when(F.col("fold") > 0, initial_train_size + step_size * (F.col("fold") - 1))
    return ranked.withColumn("fold", fold.cast("bigint")).withColumn("train_rows", train.cast("bigint"))


def clipped(p: Column, clip: float) -> Column:
    """``p`` kept within [clip, 1 - clip]; null stays null (least and greatest skip it)."""
    return F.when(p.isNotNull(), F.least(F.greatest(p, F.lit(clip)), F.lit(1 - clip)))


def _squared(p: str, y: str) -> Column:
    return F.pow(F.col(p) - F.col(y), 2)


def brier_score(df: DataFrame, p: str, y: str, by: Sequence[str] = ()) -> DataFrame:
    """Mean squared error of the probability ``p`` of the 0/1 outcome ``y``."""
    return df.groupBy(*by).agg(F.count(_squared(p, y)).alias("n"), F.avg(_squared(p, y)).alias("brier"))


def log_loss(df: DataFrame, p: str, y: str, by: Sequence[str] = (), clip: float = CLIP) -> DataFrame:
    """Mean negative log likelihood, probabilities kept within [clip, 1 - clip]."""
    safe = clipped(F.col(p), clip)
    loss = -(F.col(y) * F.log(safe) + (1 - F.col(y)) * F.log(1 - safe))
    return df.groupBy(*by).agg(F.count(loss).alias("n"), F.avg(loss).alias("log_loss"))


def reliability_bins(df: DataFrame, p: str, y: str, bins: int = 10) -> DataFrame:
    """Mean probability and observed rate per equal-width probability bin."""
    place = F.least(F.floor(F.col(p) * bins), F.lit(bins - 1)).cast("bigint")
    return (
        df.where(F.col(p).isNotNull() & F.col(y).isNotNull())
        .groupBy(place.alias("bin"))
        .agg(F.count("*").alias("n"), F.avg(p).alias("mean_p"), F.avg(y).alias("observed"))
    )


def outcome_brier_trend(df: DataFrame, period: str = "week") -> DataFrame:
    """Three-way Brier score of played fixtures per period of the fixture date."""
    margin = F.col("home_goals") - F.col("away_goals")
    happened = F.when(margin > 0, F.col("p_home")).when(margin == 0, F.col("p_draw")).otherwise(F.col("p_away"))
    squares = [F.col(c) * F.col(c) for c in ("p_home", "p_draw", "p_away")]
    # sum of (p - y)^2 over the outcomes, where y is 1 for one of them and 0 else
    score = squares[0] + squares[1] + squares[2] - 2 * happened + 1
    start = F.date_trunc(period, "date").cast("timestamp_ntz").alias("period")
    # unknown probabilities drop out of the aggregates: a filter on them would
    # repeat their whole expression below the projection that computes them
    periods = df.where(margin.isNotNull()).groupBy(start)
    return periods.agg(F.count(score).alias("n"), F.avg(score).alias("brier")).where(F.col("n") > 0)


def feature_correlation(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Pearson correlation of each pair of columns, over rows where both are known."""
    pairs = list(combinations(columns, 2))
    row = df.agg(*[F.corr(a, b).alias(f"c{i}") for i, (a, b) in enumerate(pairs)])
    cells = [
        F.struct(F.lit(a).alias("left"), F.lit(b).alias("right"), F.col(f"c{i}").alias("correlation"))
        for i, (a, b) in enumerate(pairs)
    ]
    return row.select(F.inline(F.array(*cells)))
