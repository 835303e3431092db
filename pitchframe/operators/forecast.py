"""Expected goals adjusted for absences, scorelines and outcome probabilities."""
from __future__ import annotations

from collections.abc import Mapping
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Weight of an absence per playing position, decay per match missed.
POSITION_WEIGHTS: dict[str, float] = {
    "goalkeeper": 1.4,
    "centre_back": 1.3,
    "full_back": 1.1,
    "defensive_mid": 1.2,
    "central_mid": 1.2,
    "winger": 1.0,
    "striker": 1.1,
}
INJURY_DECAY = 0.7
# Weights of the two probability sets of a blend.
BLEND_WEIGHTS = (0.5, 0.5)

# Playing positions of each position group.
GROUP_POSITIONS: dict[str, tuple[str, ...]] = {
    "GK": ("goalkeeper",),
    "DEF": ("centre_back", "full_back"),
    "MID": ("defensive_mid", "central_mid"),
    "FWD": ("winger", "striker"),
}
# Relative loss of expected goals per unit of absence load.
ABSENCE_EFFECT = 0.05
MAX_GOALS = 6
TASKS_PER_CORE = 4
OUTCOMES = ("p_home", "p_draw", "p_away")


def group_weights(weights: Mapping[str, float] = POSITION_WEIGHTS) -> dict[str, float]:
    """Mean weight of the positions of each group."""
    return {g: sum(weights[p] for p in ps) / len(ps) for g, ps in GROUP_POSITIONS.items()}


def absence_load(
    absence_runs: DataFrame,
    *,
    weights: Mapping[str, float] = POSITION_WEIGHTS,
    decay: float = INJURY_DECAY,
) -> DataFrame:
    """Load per (fixture, team): weight x minute share, decaying along a run of absences."""
    weight = F.lit(1.0)
    for group, value in group_weights(weights).items():
        weight = F.when(F.col("position_group") == group, F.lit(value)).otherwise(weight)
    term = weight * F.col("starter_minute_share") * F.pow(F.lit(decay), F.col("consecutive_missed") - 1)
    return absence_runs.groupBy("fixture_id", "team").agg(F.sum(term).alias("load"))


def adjusted_lambda(
    rated: DataFrame, absence_runs: DataFrame, *, effect: float = ABSENCE_EFFECT, **load_options
) -> DataFrame:
    """Expected goals scaled by ``exp(-effect * load)`` of the scoring team."""
    load = absence_load(absence_runs, **load_options)
    for role in ("home", "away"):
        side = load.select(
            F.col("fixture_id"), F.col("team").alias(f"{role}_team"), F.col("load").alias(f"{role}_load")
        )
        rated = rated.join(side, ["fixture_id", f"{role}_team"], "left")
    factor = lambda role: F.exp(F.lit(-effect) * F.coalesce(f"{role}_load", F.lit(0.0)))
    return rated.withColumns(
        {f"adjusted_{r}_goals": F.col(f"expected_{r}_goals") * factor(r) for r in ("home", "away")}
    ).drop("home_load", "away_load")


def scoreline_grid(
    df: DataFrame,
    home_rate: str = "expected_home_goals",
    away_rate: str = "expected_away_goals",
    max_goals: int = MAX_GOALS,
) -> DataFrame:
    """Probability of each scoreline up to ``max_goals`` per side, one row per scoreline."""
    h, a = F.col("h"), F.col("a")
    # the terms of each side are computed once a fixture, and looked at from every scoreline
    terms = lambda rate: F.array(*[F.pow(rate, F.lit(k)) * F.lit(1.0 / factorial(k)) for k in range(max_goals + 1)])
    known = df.select("fixture_id", F.col(home_rate).cast("double").alias("h"), F.col(away_rate).cast("double").alias("a"))
    known = known.where(h.isNotNull() & a.isNotNull())
    # the few bytes of a fixture become many rows: they are dealt over all cores before that
    tasks = TASKS_PER_CORE * df.sparkSession.sparkContext.defaultParallelism
    return (
        known.repartition(tasks, "fixture_id")
        .select("fixture_id", F.exp(-(h + a)).alias("none"), terms(h).alias("h"), terms(a).alias("a"))
        .select("fixture_id", "none", "a", F.posexplode("h").alias("home_goals", "home_term"))
        .select("fixture_id", "none", "home_goals", "home_term", F.posexplode("a").alias("away_goals", "away_term"))
        .select(
            "fixture_id",
            "home_goals",
            "away_goals",
            (F.col("none") * F.col("home_term") * F.col("away_term")).alias("probability"),
        )
    )


def outcome_probabilities(
    df: DataFrame,
    home_rate: str = "expected_home_goals",
    away_rate: str = "expected_away_goals",
    max_goals: int = MAX_GOALS,
) -> DataFrame:
    """Add home, draw and away probabilities: exact sums over the scoreline grid.

    The sums stay within the row: no scorelines are produced and nothing is shuffled.
    The common factor exp(-rate) cancels out of the shares.
    """
    names = df.columns
    goals = range(max_goals + 1)
    # Terms rate^k / k! of each side, built up one power at a time. A null rate
    # counts as 0 until the end: terms that are never null make short code.
    rates = {"__h1": F.col(home_rate), "__a1": F.col(away_rate)}
    df = df.withColumns({c: F.coalesce(r.cast("double"), F.lit(0.0)) for c, r in rates.items()})
    df = df.withColumns({"__h0": F.lit(1.0), "__a0": F.lit(1.0)})
    for k in goals[2:]:
        df = df.withColumns({f"__{s}{k}": F.expr(f"__{s}{k - 1} * __{s}1 * {1.0 / k!r}D") for s in "ha"})
    # __h_below3 is the sum of the terms of fewer than 3 goals
    sums = {f"__{s}_below{k}": " + ".join(f"__{s}{j}" for j in range(k)) for s in "ha" for k in range(1, max_goals + 2)}
    df = df.withColumns({c: F.expr(total) for c, total in sums.items()})
    mass = {
        "p_home": " + ".join(f"__h{k} * __a_below{k}" for k in goals[1:]),
        "p_draw": " + ".join(f"__h{k} * __a{k}" for k in goals),
        "p_away": " + ".join(f"__a{k} * __h_below{k}" for k in goals[1:]),
    }
    whole = F.expr(f"__h_below{max_goals + 1} * __a_below{max_goals + 1}")
    known = F.col(home_rate).isNotNull() & F.col(away_rate).isNotNull()
    return df.select(*names, *[F.when(known, F.expr(m) / whole).alias(o) for o, m in mass.items()])


def blend_probabilities(
    first: DataFrame, second: DataFrame, weights: tuple[float, float] = BLEND_WEIGHTS
) -> DataFrame:
    """Weighted mean of two probability sets per fixture, rescaled to sum 1.

    A fixture that only one set has keeps that set's probabilities.
    """
    a = first.select("fixture_id", F.lit(True).alias("__in_a"), *[F.col(o).alias(f"__a_{o}") for o in OUTCOMES])
    b = second.select("fixture_id", F.lit(True).alias("__in_b"), *[F.col(o).alias(f"__b_{o}") for o in OUTCOMES])
    mixed = {
        o: F.when(F.col("__in_a") & F.col("__in_b"), weights[0] * F.col(f"__a_{o}") + weights[1] * F.col(f"__b_{o}"))
        .when(F.col("__in_a"), F.col(f"__a_{o}"))
        .otherwise(F.col(f"__b_{o}"))
        for o in OUTCOMES
    }
    joined = a.join(b, "fixture_id", "full").withColumns(mixed)
    whole = F.nullif(sum((F.col(o) for o in OUTCOMES), F.lit(0.0)), F.lit(0.0))
    return joined.select("fixture_id", *[(F.col(o) / whole).alias(o) for o in OUTCOMES])
