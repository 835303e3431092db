"""Point-in-time features of a fixture from the matches before it."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitchframe.operators import forecast, ratings
from pitchframe.operators.clean import with_dates, with_side_columns, with_xg_flag
from pitchframe.plans.ordered import OrderedGroups, ordered_groups
from pitchframe.plans.skew import tasks_for

POINTS_WINDOW = 5
GOALS_WINDOW = 5
XG_FOR_WINDOW = 8
XG_AGAINST_WINDOW = 8

FORM = ("form_points", "form_goals_for", "form_goals_against")
XG = ("xg_for", "xg_against", "xg_balance")
REST = ("rest_days",)


def _team_rows(fixtures: DataFrame) -> OrderedGroups:
    fixtures = with_side_columns(with_dates(fixtures))

    def side(team: str, own: str, other: str, home: int) -> Column:
        return F.struct(
            F.col(team).alias("team"),
            F.lit(home).alias("home"),
            F.col(f"{own}_goals").cast("double").alias("goals_for"),
            F.col(f"{other}_goals").cast("double").alias("goals_against"),
            F.col(f"{own}_xg").cast("double").alias("own_xg"),
            F.col(f"{other}_xg").cast("double").alias("other_xg"),
        )

    both = F.array(side("home_team", "home", "away", 1), side("away_team", "away", "home", 0))
    margin = F.col("goals_for") - F.col("goals_against")
    points = F.when(margin > 0, 3.0).when(margin == 0, 1.0).when(margin < 0, 0.0)
    rows = (
        fixtures.select("fixture_id", "date", F.inline(both))
        .where(F.col("team").isNotNull())
        .withColumn("points", points)
    )
    return ordered_groups(rows, ["team"], ["date", "fixture_id", "home"])


def _add_form(groups: OrderedGroups, points_window: int, goals_window: int) -> OrderedGroups:
    groups = groups.rolling(
        points_window, lambda w: {"form_points": F.sum("points").over(w)}, reads=["points"]
    )
    return groups.rolling(
        goals_window,
        lambda w: {
            "form_goals_for": F.avg("goals_for").over(w),
            "form_goals_against": F.avg("goals_against").over(w),
        },
        reads=["goals_for", "goals_against"],
    )


def _add_xg(groups: OrderedGroups, for_window: int, against_window: int) -> OrderedGroups:
    groups = groups.rolling(
        for_window, lambda w: {"xg_for": F.avg("own_xg").over(w)}, reads=["own_xg"]
    )
    groups = groups.rolling(
        against_window, lambda w: {"xg_against": F.avg("other_xg").over(w)}, reads=["other_xg"]
    )
    balance = F.col("xg_for") - F.col("xg_against")
    return groups.with_frame(groups.frame.withColumn("xg_balance", balance))


def _add_rest(groups: OrderedGroups) -> OrderedGroups:
    groups = groups.rolling(1, lambda w: {"__last": F.max("date").over(w)}, reads=["date"])
    rest = F.datediff("date", "__last").cast("bigint")
    return groups.with_frame(groups.frame.withColumn("rest_days", rest).drop("__last"))


def _per_fixture(groups: OrderedGroups, features: tuple[str, ...], fixtures: DataFrame) -> DataFrame:
    """One row per fixture; one without any team has no features.

    The rows are dealt by fixture before they are grouped: no two rows of a fixture come from one
    team, so there is nothing to combine earlier.
    """
    columns = [
        F.max(F.when(F.col("home") == flag, F.col(f))).alias(f"{role}_{f}")
        for role, flag in (("home", 1), ("away", 0))
        for f in features
    ]
    rows = groups.result().select("fixture_id", "home", *features)
    teamless = fixtures.where(F.col("home_team").isNull() & F.col("away_team").isNull()).select("fixture_id")
    rows = rows.unionByName(teamless, allowMissingColumns=True)
    return rows.repartition(tasks_for(rows, groups.rows), "fixture_id").groupBy("fixture_id").agg(*columns)


def rolling_form(
    fixtures: DataFrame, points_window: int = POINTS_WINDOW, goals_window: int = GOALS_WINDOW
) -> DataFrame:
    """Points and mean goals of both teams over their last matches."""
    return _per_fixture(_add_form(_team_rows(fixtures), points_window, goals_window), FORM, fixtures)


def rolling_xg(
    fixtures: DataFrame, for_window: int = XG_FOR_WINDOW, against_window: int = XG_AGAINST_WINDOW
) -> DataFrame:
    """Mean xg for and against of both teams over their last matches."""
    return _per_fixture(_add_xg(_team_rows(fixtures), for_window, against_window), XG, fixtures)


def rest_days(fixtures: DataFrame) -> DataFrame:
    """Days since the previous match of each team."""
    return _per_fixture(_add_rest(_team_rows(fixtures)), REST, fixtures)


def team_features(
    fixtures: DataFrame,
    points_window: int = POINTS_WINDOW,
    goals_window: int = GOALS_WINDOW,
    for_window: int = XG_FOR_WINDOW,
    against_window: int = XG_AGAINST_WINDOW,
) -> DataFrame:
    """Form, xg and rest days together: one shuffle by team, one by fixture."""
    groups = _add_form(_team_rows(fixtures), points_window, goals_window)
    groups = _add_rest(_add_xg(groups, for_window, against_window))
    return _per_fixture(groups, (*FORM, *XG, *REST), fixtures)


def head_to_head(fixtures: DataFrame) -> DataFrame:
    """Earlier meetings of the same two teams, seen from the current home team."""
    low = F.least("home_team", "away_team")
    at_home = F.col("home_team") == F.col("low")
    margin = F.col("home_goals") - F.col("away_goals")
    low_margin = F.when(at_home, margin).otherwise(-margin).cast("double")
    meetings = (
        with_dates(fixtures)
        .where(F.col("home_team").isNotNull() & F.col("away_team").isNotNull())
        .withColumns({"low": low, "high": F.greatest("home_team", "away_team")})
        .withColumns({"at_home": at_home, "low_margin": low_margin})
        .select("fixture_id", "date", "low", "high", "at_home", "low_margin")
    )
    m = F.col("low_margin")
    history = ordered_groups(meetings, ["low", "high"], ["date", "fixture_id"]).running(
        {
            "h2h_matches": ("count", m),
            "__low_wins": ("sum", F.when(m > 0, 1).otherwise(0)),
            "__high_wins": ("sum", F.when(m < 0, 1).otherwise(0)),
            "__margin": ("sum", F.coalesce(m, F.lit(0.0))),
        }
    )
    own = lambda a, b: F.when(F.col("at_home"), F.col(a)).otherwise(F.col(b))
    wins, losses = own("__low_wins", "__high_wins"), own("__high_wins", "__low_wins")
    met = history.result().select(
        "fixture_id",
        "h2h_matches",
        wins.alias("h2h_home_wins"),
        (F.col("h2h_matches") - wins - losses).alias("h2h_draws"),
        losses.alias("h2h_away_wins"),
        # adding zero turns a negative zero into zero
        (F.when(F.col("at_home"), F.col("__margin")).otherwise(-F.col("__margin")) + F.lit(0.0)).alias(
            "h2h_goal_diff"
        ),
    )
    # a fixture without one of its teams has no history, not an empty one
    teamless = fixtures.where(F.col("home_team").isNull() | F.col("away_team").isNull())
    return met.unionByName(teamless.select("fixture_id"), allowMissingColumns=True)


def elo_asof(fixtures: DataFrame, elo: DataFrame) -> DataFrame:
    """Rating of both teams as of the latest rating date strictly before the fixture.

    Fixtures and ratings share one ordered timeline per team, on which the
    latest rating is a running maximum, so no range join is needed.
    """
    teams = F.array(
        F.struct(F.col("home_team").alias("team"), F.lit(1).alias("home")),
        F.struct(F.col("away_team").alias("team"), F.lit(0).alias("home")),
    )
    nothing = F.lit(None)
    asked = with_dates(fixtures).select("fixture_id", "date", F.inline(teams)).select(
        "team", "date", F.lit(0).alias("kind"), "fixture_id", "home", nothing.cast("double").alias("elo")
    )
    rated = with_dates(elo).select(
        "team", "date", F.lit(1).alias("kind"), nothing.cast("string").alias("fixture_id"),
        nothing.cast("int").alias("home"), "elo",
    )
    timeline = asked.withColumn("fixture_id", F.col("fixture_id").cast("string")).unionByName(rated)
    placed = F.col("team").isNotNull() & F.col("date").isNotNull()
    # without a team or a date there is nothing to look up, but still a fixture
    placeless = timeline.where(~placed & (F.col("kind") == 0)).select("fixture_id", "home")
    timeline = timeline.where(placed)
    # at one instant fixtures come before ratings: a rating counts strictly later
    known = F.when(F.col("elo").isNotNull(), F.struct("date", "elo"))
    latest = ordered_groups(timeline, ["team"], ["date", "kind", "fixture_id", "home", "elo"]).running(
        {"latest": ("max", known)}
    )
    side = lambda flag: F.max(F.when(F.col("home") == flag, F.col("latest.elo")))
    known_sides = latest.result().where(F.col("kind") == 0).select("fixture_id", "home", "latest")
    asked_sides = known_sides.unionByName(placeless, allowMissingColumns=True)
    return (
        asked_sides.repartition(tasks_for(asked_sides, latest.rows), "fixture_id")
        .groupBy("fixture_id")
        .agg(side(1).alias("home_elo"), side(0).alias("away_elo"))
        .withColumn("elo_diff", F.col("home_elo") - F.col("away_elo"))
    )


def unmatched_teams(fixtures: DataFrame, elo: DataFrame) -> DataFrame:
    """Team names that occur in only one of the two sources."""
    ours = ratings.team_universe(fixtures).withColumn("in_fixtures", F.lit(True))
    theirs = elo.where(F.col("team").isNotNull()).select("team").distinct().withColumn("in_elo", F.lit(True))
    both = ours.join(theirs, "team", "full_outer")
    missing = F.when(F.col("in_elo").isNull(), F.lit("elo")).when(F.col("in_fixtures").isNull(), F.lit("fixtures"))
    return both.select("team", missing.alias("missing_in")).where(F.col("missing_in").isNotNull())


def rating_diffs(rated: DataFrame, elo_of_fixture: DataFrame | None = None) -> DataFrame:
    """Home minus away ratings; with as-of ratings given also their difference."""
    columns = [
        F.col("fixture_id"),
        (F.col("home_attack_rating") - F.col("away_attack_rating")).alias("attack_diff"),
        (F.col("home_defense_rating") - F.col("away_defense_rating")).alias("defense_diff"),
        (F.col("expected_home_goals") - F.col("expected_away_goals")).alias("expected_goals_diff"),
    ]
    diffs = rated.select(*columns)
    if elo_of_fixture is not None:
        diffs = diffs.join(elo_of_fixture.select("fixture_id", "elo_diff"), "fixture_id", "left")
    return diffs


def feature_table(
    fixtures: DataFrame,
    elo: DataFrame,
    absence_runs: DataFrame | None = None,
    *,
    rating_window: int = ratings.RATING_WINDOW,
    sweeps: int = ratings.SWEEPS,
    **windows: int,
) -> DataFrame:
    """All features of a fixture, one row per fixture, with its result as target."""
    rated = ratings.rolling_ratings(fixtures, rating_window, sweeps=sweeps)
    if absence_runs is None:
        adjusted = rated.withColumns(
            {"adjusted_home_goals": F.col("expected_home_goals"), "adjusted_away_goals": F.col("expected_away_goals")}
        )
    else:
        adjusted = forecast.adjusted_lambda(rated, absence_runs)
    likely = forecast.outcome_probabilities(adjusted, "adjusted_home_goals", "adjusted_away_goals")
    margin = F.col("home_goals") - F.col("away_goals")
    result = F.when(margin > 0, "home").when(margin == 0, "draw").when(margin < 0, "away")
    own = with_xg_flag(with_side_columns(likely)).select(
        "fixture_id",
        "date",
        "is_xg_missing",
        (F.col("expected_home_goals") - F.col("expected_away_goals")).alias("expected_goals_diff"),
        (F.col("home_attack_rating") - F.col("away_attack_rating")).alias("attack_diff"),
        (F.col("home_defense_rating") - F.col("away_defense_rating")).alias("defense_diff"),
        "adjusted_home_goals",
        "adjusted_away_goals",
        "p_home",
        "p_draw",
        "p_away",
        result.alias("result"),
    )
    return (
        own.join(team_features(fixtures, **windows), "fixture_id", "left")
        .join(head_to_head(fixtures), "fixture_id", "left")
        .join(elo_asof(fixtures, elo), "fixture_id", "left")
    )
