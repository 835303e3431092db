"""Whole query results against DuckDB on the smallest given tables.

``PITCHFRAME_FULL=1`` adds the slow queries, and runs the window queries once
more with every group split into blocks.
"""
import os
from pathlib import Path

import pytest

import __spark_entry__ as entry
from tests.compare import difference, duck

SF = "/root/testdata/sf0.001"
FULL = os.environ.get("PITCHFRAME_FULL") == "1"
SLOW = {"feature_table", "rating_diffs", "poisson_ratings_glr", "poisson_ratings_without_home", "adjusted_lambda", "blend_probabilities", "feature_correlation", "scoreline_grid"}
WINDOWED = ["starter_minute_share", "player_absences", "rating_window_members", "rolling_ratings", "elo_asof", "rolling_form", "rest_days", "walk_forward_folds", "expected_goals_summary", "feature_table"]

pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="given tables not present")


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", [n for n in entry.oracle_sql() if FULL or n not in SLOW])
def test_query_equals_sql(spark, con, name):
    assert difference(entry.queries()[name](spark, SF), con, entry.oracle_sql()[name]) == ""


@pytest.mark.parametrize("name", WINDOWED if FULL else ["player_absences", "rolling_form"])
def test_split_groups_equal_sql(spark, con, tiny_groups, name):
    assert difference(entry.queries()[name](spark, SF), con, entry.oracle_sql()[name]) == ""


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0
