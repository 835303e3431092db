"""One query per operator: (spark, sf_dir) -> DataFrame."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from entry_queries.inputs import rounded, table
from pitchframe.functions import numeric, text
from pitchframe.operators import (
    absences,
    calibrate,
    clean,
    evaluate,
    features,
    forecast,
    ingest,
    models,
    profile,
    ratings,
)
from pitchframe.plans.scratch import scratch_path
from pitchframe.plans.skew import lookup
from pitchframe.sources import landed

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

FIXTURE_COLUMNS = ("fixture_id", "season", "date", "home_team", "away_team")
MODEL_FEATURES = (
    "attack_diff", "defense_diff", "adjusted_home_goals", "adjusted_away_goals", "p_home", "p_draw",
    "home_form_points", "away_form_points", "home_form_goals_for", "away_form_goals_for",
    "home_xg_balance", "away_xg_balance", "home_rest_days", "away_rest_days", "h2h_matches",
    "h2h_goal_diff", "elo_diff",
)
FEATURE_COLUMNS = (
    "attack_diff", "defense_diff", "expected_goals_diff", "adjusted_home_goals", "adjusted_away_goals", "p_home", "p_draw",
    "p_away", *(f"{r}_{f}" for r in ("home", "away") for f in (*features.FORM, *features.XG)),
    "h2h_goal_diff", "home_elo", "away_elo", "elo_diff",
)


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


# --- sources and sinks ---


@query
def scan_fixtures(spark, sf):
    scanned = landed.fixtures(table("raw_schedule", spark, sf), season="2023/2024", league="first")
    return scanned.select("fixture_id", "season", "league", "date", "home_team", "away_team", "home_goals", "away_goals")


@query
def scan_match_stats(spark, sf):
    return landed.match_stats(table("raw_match_stats", spark, sf), season="2024-2025")


@query
def match_stats_for_fixture(spark, sf):
    types = {"xg": "double", "shots": "bigint", "sot": "bigint"}
    return ingest.match_stats_for_fixture(table("raw_match_stats", spark, sf), "00000420", types)


@query
def resolve_fixture_key(spark, sf):
    fixtures = ingest.normalize_schedule(table("raw_schedule", spark, sf))
    stats = table("raw_match_stats", spark, sf)
    return ingest.resolve_fixture_key(stats, fixtures).select("fixture_id", "team", "match_report", "date", "notes")


@query
def player_minutes(spark, sf):
    return ingest.player_minutes(table("player_logs", spark, sf), "00000421")


@query
def conform_player_logs(spark, sf):
    logs = table("player_logs", spark, sf)
    raw = logs.select(
        "fixture_id", "team", F.col("player_name").alias("player"), F.col("minutes_played").alias("minutes"), "position"
    )
    return ingest.conform_player_logs(raw, table("fixtures", spark, sf))


@query
def elo_snapshot(spark, sf):
    return ingest.elo_snapshot(table("elo", spark, sf), "2024-01-20 12:00:00")


@query
def elo_history(spark, sf):
    return ingest.elo_history(table("elo", spark, sf))


@query
def player_season_minutes(spark, sf):
    # a log of no known fixture counts under the null season
    seasons = table("fixtures", spark, sf).select("fixture_id", "season")
    return ingest.player_season_minutes(lookup(table("player_logs", spark, sf), seasons, ["fixture_id"]))


@query
def parquet_roundtrip(spark, sf):
    path = scratch_path(spark, "roundtrip")
    fixtures = table("fixtures", spark, sf)
    landed.write_table(fixtures, path, partition_by=["season"])
    return landed.scan(spark, path, fixtures.schema).select(*fixtures.columns)


@query
def landed_season(spark, sf):
    """One season of a landed folder of several, whose other directories aren't opened."""
    path = scratch_path(spark, "landed")
    fixtures = table("fixtures", spark, sf)
    landed.write_table(fixtures, path, partition_by=["season"])
    return landed.of_season(landed.scan(spark, path, fixtures.schema), "2024/2025").select(*fixtures.columns)


@query
def landed_season_again(spark, sf):
    """A season landed once more, with other goals, beside those already there."""
    path = scratch_path(spark, "landed")
    fixtures = table("fixtures", spark, sf)
    landed.write_table(fixtures, path, partition_by=["season"])
    corrected = landed.of_season(fixtures, "2024/2025").withColumn("home_goals", F.col("home_goals") + 1)
    landed.write_table(corrected, path, partition_by=["season"], others="keep")
    return landed.scan(spark, path, fixtures.schema).select(*fixtures.columns)


# --- scalar functions and projections ---


@query
def season_label(spark, sf):
    raw = table("raw_schedule", spark, sf)
    bad = F.when(F.col("season_text").startswith("2023"), F.col("season_text")).otherwise(F.lit("2024"))
    return raw.select(
        F.col("game_id").alias("fixture_id"),
        text.season_label(F.col("season_text")).alias("label"),
        text.season_label(F.col("season")).alias("label_again"),
        text.season_label(bad).alias("label_or_null"),
    )


@query
def parse_score(spark, sf):
    home, away = text.parse_score(F.col("score"))
    inner_home, inner_away = text.parse_score(F.col("score"), skip_brackets=True)
    return table("raw_schedule", spark, sf).select(
        F.col("game_id").alias("fixture_id"), home.alias("home_goals"), away.alias("away_goals"),
        inner_home.alias("home_goals_in_play"), inner_away.alias("away_goals_in_play"),
    )


@query
def normalize_schedule(spark, sf):
    return ingest.normalize_schedule(table("raw_schedule", spark, sf))


@query
def sanitize_profile(spark, sf):
    return ingest.numeric_profile(table("raw_match_stats", spark, sf))


@query
def sanitize_numeric(spark, sf):
    return ingest.sanitize_match_stats(table("raw_match_stats", spark, sf))


@query
def standardize_teams(spark, sf):
    return clean.standardize_teams(table("raw_schedule", spark, sf)).select(
        F.col("game_id").alias("fixture_id"), "home_team", "away_team", "score"
    )


@query
def position_group(spark, sf):
    return table("player_logs", spark, sf).select(
        "fixture_id", "player_id", text.position_group(F.col("position")).alias("position_group")
    )


@query
def xg_missing_flag(spark, sf):
    return clean.with_xg_flag(table("fixtures", spark, sf)).select("fixture_id", "home_xg", "away_xg", "is_xg_missing")


@query
def base_differentials(spark, sf):
    diffs = clean.base_differentials(table("fixtures", spark, sf))
    return rounded(diffs, "xg_diff").select("fixture_id", "goals_diff", "xg_diff", "shots_diff", "sot_diff")


def _statistics(spark, sf):
    fixtures = ingest.normalize_schedule(table("raw_schedule", spark, sf))
    stats = ingest.sanitize_match_stats(table("raw_match_stats", spark, sf))
    return fixtures, ingest.resolve_fixture_key(stats, fixtures)


@query
def merge_match_stats(spark, sf):
    fixtures, stats = _statistics(spark, sf)
    return clean.merge_match_stats(fixtures, stats).select(
        "fixture_id", "home_team", "away_team", "home_xg", "away_xg", "home_shots", "away_shots",
        "home_sot", "away_sot", "is_xg_missing",
    )


@query
def clean_fixtures(spark, sf):
    fixtures, stats = _statistics(spark, sf)
    as_text = fixtures.withColumn("date", F.col("date").cast("string"))
    cleaned = clean.clean_fixtures(as_text, stats, ordered=True)
    return rounded(cleaned, "xg_diff").select(
        "fixture_id", "season", "date", "home_team", "away_team", "home_goals", "away_goals", "home_xg",
        "away_xg", "is_xg_missing", "goals_diff", "xg_diff", "shots_diff", "sot_diff",
    )


# --- profiles ---


@query
def validate_fixtures(spark, sf):
    return profile.validate_fixtures(table("fixtures", spark, sf).drop("away_team"))


@query
def missing_profile(spark, sf):
    cleaned = clean.with_xg_flag(table("fixtures", spark, sf))
    return rounded(profile.missing_profile(cleaned), "rate")


@query
def fixture_sample(spark, sf):
    return profile.sample(table("fixtures", spark, sf), ["fixture_id", "date", "home_team", "away_team", "home_goals"])


# --- absences ---


@query
def starter_minute_share(spark, sf):
    shares = absences.starter_minute_share(table("player_logs", spark, sf))
    return rounded(shares, "starter_minute_share").select("player_id", "fixture_id", "starter_minute_share")


@query
def consecutive_missed(spark, sf):
    runs = absences.consecutive_missed(table("player_logs", spark, sf))
    return runs.select("player_id", "fixture_id", "consecutive_missed")


@query
def player_absences(spark, sf):
    return rounded(absences.player_absences(table("player_logs", spark, sf)), "starter_minute_share")


@query
def absence_type(spark, sf):
    runs = absences.consecutive_missed(table("player_logs", spark, sf)).where("is_missed")
    run = F.col("consecutive_missed")
    return runs.select(
        "player_id", "fixture_id", "consecutive_missed",
        numeric.absence_type(run).alias("absence_type"), numeric.absence_type(run, 3).alias("absence_type_from_3"),
    )


@query
def absence_distribution(spark, sf):
    return profile.absence_distribution(absences.player_absences(table("player_logs", spark, sf)))


@query
def absence_by_season(spark, sf):
    found = absences.player_absences(table("player_logs", spark, sf))
    return profile.absence_by_season(found, table("fixtures", spark, sf))


# --- ratings ---


@query
def poisson_observations(spark, sf):
    return ratings.poisson_observations(table("fixtures", spark, sf), keep=["fixture_id"])


@query
def team_universe(spark, sf):
    return ratings.team_universe(table("fixtures", spark, sf))


@query
def reference_team(spark, sf):
    return ratings.reference_team(table("fixtures", spark, sf))


@query
def empirical_home_advantage(spark, sf):
    means = ratings.empirical_home_advantage(table("fixtures", spark, sf))
    return rounded(means, "mean_goals", "mean_home_goals", "mean_away_goals", "home_advantage")


@query
def empirical_ratings(spark, sf):
    return rounded(ratings.empirical_ratings(table("fixtures", spark, sf)), "attack", "defense")


@query
def team_last_n(spark, sf):
    return ratings.team_last_n(table("fixtures", spark, sf)).withColumn("recency", F.col("recency").cast("bigint"))


@query
def rating_window_members(spark, sf):
    return ratings.rating_window_members(table("fixtures", spark, sf))


@query
def poisson_ratings(spark, sf):
    fitted = ratings.fit_poisson_ratings(table("fixtures", spark, sf)).drop("converged")
    return rounded(fitted, "attack", "defense", "home_advantage")


@query
def poisson_ratings_without_home(spark, sf):
    fitted = ratings.fit_poisson_ratings(table("fixtures", spark, sf), home_field_advantage=False).drop("converged")
    return rounded(fitted, "attack", "defense", "home_advantage")


@query
def poisson_ratings_glr(spark, sf):
    fitted = ratings.fit_poisson_ratings_glr(table("fixtures", spark, sf))
    return rounded(fitted, "attack", "defense", "home_advantage", places=5)


@query
def rolling_ratings(spark, sf):
    rated = ratings.rolling_ratings(table("fixtures", spark, sf))
    return rounded(rated, *ratings.RATING_COLUMNS).select(
        "fixture_id", *ratings.RATING_COLUMNS, "expected_home_goals", "expected_away_goals"
    )


def _static_expected_goals(spark, sf):
    """Expected goals from the means of both teams before the match; an unknown team counts as average."""
    known = ratings.asof_strengths(table("fixtures", spark, sf))
    strengths = [F.col(f"{r}_{k}") for r in ("home", "away") for k in ("attack", "defense")]
    home, away = numeric.expected_goals(*strengths, F.col("home_advantage"))
    return known.withColumns({"expected_home_goals": home, "expected_away_goals": away})


@query
def expected_goals(spark, sf):
    return _static_expected_goals(spark, sf).select("fixture_id", "expected_home_goals", "expected_away_goals")


@query
def expected_goals_summary(spark, sf):
    goals = ["expected_home_goals", "expected_away_goals"]
    summary = profile.describe(_static_expected_goals(spark, sf), goals)
    # the mean of three-decimal values has an exact short form: round beyond its digits
    return rounded(summary, "mean", "std", "p25", "p50", "p75", places=9)


# --- features ---


@query
def elo_asof(spark, sf):
    return features.elo_asof(table("fixtures", spark, sf), table("elo", spark, sf))


@query
def unmatched_teams(spark, sf):
    return features.unmatched_teams(ingest.normalize_schedule(table("raw_schedule", spark, sf)), table("elo", spark, sf))


@query
def rolling_form(spark, sf):
    form = features.rolling_form(table("fixtures", spark, sf))
    return rounded(form, *[c for c in form.columns if "goals" in c])


@query
def rolling_xg(spark, sf):
    xg = features.rolling_xg(table("fixtures", spark, sf))
    return rounded(xg, *[c for c in xg.columns if c != "fixture_id"])


@query
def rest_days(spark, sf):
    return features.rest_days(table("fixtures", spark, sf))


@query
def head_to_head(spark, sf):
    return features.head_to_head(table("fixtures", spark, sf))


@query
def rating_diffs(spark, sf):
    fixtures = table("fixtures", spark, sf)
    diffs = features.rating_diffs(ratings.rolling_ratings(fixtures), features.elo_asof(fixtures, table("elo", spark, sf)))
    return rounded(diffs, "attack_diff", "defense_diff", "expected_goals_diff")


def _feature_table(spark, sf):
    runs = absences.absence_runs(table("player_logs", spark, sf))
    return features.feature_table(table("fixtures", spark, sf), table("elo", spark, sf), runs)


@query
def feature_table(spark, sf):
    return rounded(_feature_table(spark, sf), *FEATURE_COLUMNS)


@query
def feature_correlation(spark, sf):
    form, xg = (f(table("fixtures", spark, sf)) for f in (features.rolling_form, features.rolling_xg))
    columns = [c for df in (form, xg) for c in df.columns if c != "fixture_id"]
    return rounded(evaluate.feature_correlation(form.join(xg, "fixture_id"), columns), "correlation")


# --- forecasts ---


@query
def absence_load(spark, sf):
    return rounded(forecast.absence_load(absences.absence_runs(table("player_logs", spark, sf))), "load")


@query
def adjusted_lambda(spark, sf):
    runs = absences.absence_runs(table("player_logs", spark, sf))
    adjusted = forecast.adjusted_lambda(_static_expected_goals(spark, sf), runs)
    return rounded(adjusted, "adjusted_home_goals", "adjusted_away_goals").select(
        "fixture_id", "expected_home_goals", "adjusted_home_goals", "expected_away_goals", "adjusted_away_goals"
    )


@query
def scoreline_grid(spark, sf):
    grid = forecast.scoreline_grid(_static_expected_goals(spark, sf))
    # values up to 1 are exact enough as doubles: half to even without a decimal for each of 49 rows a fixture
    return grid.withColumn("probability", F.rint(F.col("probability") * 1e8) / F.lit(1e8))


@query
def outcome_probabilities(spark, sf):
    likely = forecast.outcome_probabilities(_static_expected_goals(spark, sf))
    return rounded(likely, *forecast.OUTCOMES).select("fixture_id", *forecast.OUTCOMES)


def _xg_outcomes(spark, sf):
    return forecast.outcome_probabilities(table("fixtures", spark, sf), "home_xg", "away_xg")


@query
def blend_probabilities(spark, sf):
    static = forecast.outcome_probabilities(_static_expected_goals(spark, sf))
    return rounded(forecast.blend_probabilities(static, _xg_outcomes(spark, sf)), *forecast.OUTCOMES)


# --- evaluation ---


@query
def walk_forward_folds(spark, sf):
    return evaluate.walk_forward_folds(table("fixtures", spark, sf))


@query
def brier_score(spark, sf):
    return rounded(evaluate.brier_score(table("scores", spark, sf), "p", "y", ["lang"]), "brier")


@query
def log_loss(spark, sf):
    return rounded(evaluate.log_loss(table("scores", spark, sf), "p", "y", ["lang"]), "log_loss")


@query
def reliability_bins(spark, sf):
    return rounded(evaluate.reliability_bins(table("scores", spark, sf), "p", "y"), "mean_p", "observed")


@query
def brier_trend(spark, sf):
    return rounded(evaluate.outcome_brier_trend(_xg_outcomes(spark, sf)), "brier")


@query
def platt_scaling(spark, sf):
    scaled = calibrate.platt_scaling(table("scores", spark, sf), "p", "y")
    return rounded(scaled, "calibrated", places=4).select("doc_id", "calibrated")


@query
def isotonic(spark, sf):
    scaled = calibrate.isotonic(table("scores", spark, sf), "p", "y")
    return rounded(scaled, "calibrated").select("doc_id", "calibrated")


CALIBRATION_FOLDS = 5


def _out_of_fold(spark, sf):
    scores = table("scores", spark, sf).withColumn("fold", F.col("doc_id") % CALIBRATION_FOLDS)
    return calibrate.isotonic_out_of_fold(scores, "p", "y", "fold", CALIBRATION_FOLDS)


@query
def isotonic_out_of_fold(spark, sf):
    return rounded(_out_of_fold(spark, sf), "calibrated").select("doc_id", "fold", "calibrated")


@query
def recalibration_effect(spark, sf):
    effect = calibrate.recalibration_effect(_out_of_fold(spark, sf), "p", "calibrated", "y", "fold")
    return rounded(effect, "brier_before", "brier_after")


def _boosted(spark, sf):
    return models.boosted_model(_feature_table(spark, sf), MODEL_FEATURES)


@query
def boosted_model(spark, sf):
    return _boosted(spark, sf)[0]


@query
def boosted_importances(spark, sf):
    return _boosted(spark, sf)[1]
