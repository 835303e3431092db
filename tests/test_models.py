import datetime as dt
import inspect
import math
import random
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from entry_queries import registry
from pitchframe.functions import boosting
from pitchframe.operators import evaluate, models

SF = "/root/testdata/sf0.001"
SIZES = {"initial_train_size": 60, "step_size": 40}


def _table(spark, n=150):
    """Fixtures of which some share their date, lack it or weren't played, and a feature that tells the result."""
    rnd = random.Random(8)
    rows = []
    for i in rnd.sample(range(n), n):
        strength = None if i % 11 == 0 else rnd.gauss(0, 1)
        result = "home" if (strength or 0) > 0.3 else "away" if (strength or 0) < -0.3 else "draw"
        date = None if i in (3, 140) else dt.datetime(2024, 8, 1) + dt.timedelta(days=i // 4)
        rows.append((f"f{i:04d}", date, None if i % 29 == 5 else result, strength, float(i % 7)))
    return spark.createDataFrame(rows, "fixture_id string, date timestamp_ntz, result string, strength double, noise double")


@pytest.mark.parametrize("split", [False, True])
def test_features_of_a_boosted_model_are_made_once(spark, split, request):
    if split:
        request.getfixturevalue("tiny_groups")
    made = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            made.add(len(batch))
            yield batch

    table = _table(spark)
    table = table.mapInPandas(counted, table.schema)
    predictions, importances = models.boosted_model(table, ["strength", "noise"], trees=1, max_depth=2, **SIZES)
    assert predictions.count() == 85 and importances.count() == 3 * 3 * 2
    assert made.value == 150


@pytest.mark.parametrize("numbered", [False, True])
def test_boosted_folds_are_those_of_walk_forward_folds(spark, numbered):
    table = _table(spark)
    if numbered:  # as texts, 9 would come after 10
        table = table.withColumn("fixture_id", F.substring("fixture_id", 2, 4).cast("int"))
    predictions, _ = models.boosted_model(table, ["strength", "noise"], trees=1, max_depth=2, **SIZES)
    folds = evaluate.walk_forward_folds(table.where("result is not null"), **SIZES).where("fold > 0")
    got = {r.fixture_id: r.fold for r in predictions.collect()}
    assert got == {r.fixture_id: r.fold for r in folds.collect()} and set(got.values()) == {1, 2, 3}
    assert all(abs(r.p_home + r.p_draw + r.p_away - 1) < 1e-9 for r in predictions.collect())


SPECIFIED = {
    "initial_train_size": 200, "step_size": 38, "trees": 300, "max_depth": 4, "learning_rate": 0.05, "subsample": 0.8,
    "column_share": 0.8, "min_child_weight": 3.0, "min_gain": 0.1, "l1": 0.1, "l2": 1.0,
}


def test_registered_models_have_the_specified_parameters(monkeypatch):
    bound = []
    signature = inspect.signature(models.boosted_model)
    monkeypatch.setattr(registry, "_feature_table", lambda spark, sf: None)
    monkeypatch.setattr(models, "boosted_model", lambda *a, **k: bound.append(signature.bind(*a, **k)) or ("p", "i"))
    assert (registry.boosted_model(None, SF), registry.boosted_importances(None, SF)) == ("p", "i")
    for call in bound:
        call.apply_defaults()
        assert {k: call.arguments.get(k) for k in SPECIFIED} == SPECIFIED
        assert call.arguments["columns"] == registry.MODEL_FEATURES


@pytest.mark.skipif(not Path(SF).exists(), reason="given tables not present")
def test_registered_models_forecast_each_fixture_after_the_first_fold(spark):
    played = registry.table("fixtures", spark, SF).where("home_goals is not null and away_goals is not null").count()
    predictions, importances = registry._boosted(spark, SF)
    folds = -(-(played - 200) // 38)
    sizes = {r["fold"]: r["count"] for r in predictions.groupBy("fold").count().collect()}
    assert sizes == {k: min(38, played - 200 - 38 * (k - 1)) for k in range(1, folds + 1)}
    assert importances.count() == folds * 3 * len(registry.MODEL_FEATURES)


def _both(result):
    return [sorted(map(tuple, df.collect())) for df in result]


def test_folds_beyond_a_task_have_the_same_trees(spark, monkeypatch):
    table, options = _table(spark), {"trees": 5, "max_depth": 3, **SIZES}
    monkeypatch.setattr(models, "TREES_AT_ONCE", 2)
    within = _both(models.boosted_model(table, ["strength", "noise"], **options))
    assert {r[1] for r in within[0]} == {1, 2, 3} and len(within[1]) == 18
    monkeypatch.setattr(models, "FIT_ROWS", 80)
    assert _both(models.boosted_model(table, ["strength", "noise"], **options)) == within


def test_a_fold_knows_only_what_came_before(spark):
    table, columns, options = _table(spark), ["strength", "noise"], {"trees": 5, **SIZES}
    later = F.col("date") > "2024-08-30"
    changed = table.withColumns(
        {"result": F.when(later, "draw").otherwise(F.col("result")), "noise": F.when(later, 99.0).otherwise(F.col("noise"))}
    )
    known = {r.fixture_id for r in table.where("date <= '2024-08-30'").collect()}
    before, after = (
        {r.fixture_id: r[1:] for r in models.boosted_model(t, columns, **options)[0].collect() if r.fixture_id in known}
        for t in (table, changed)
    )
    assert before == after and len({v[0] for v in before.values()}) > 1


def test_boosted_forecasts_beat_the_base_rates(spark):
    predictions, importances = models.boosted_model(_table(spark, 400), ["strength", "noise"], **{**SIZES, "trees": 80})
    got = predictions.collect()
    error = lambda p, y: sum((p[k] - (k == y)) ** 2 for k in ("home", "draw", "away"))
    rate = {k: sum(r.result == k for r in got) / len(got) for k in ("home", "draw", "away")}
    forecast = sum(error({"home": r.p_home, "draw": r.p_draw, "away": r.p_away}, r.result) for r in got)
    assert forecast < 0.5 * sum(error(rate, r.result) for r in got)
    home = {r.feature: r.importance for r in importances.where("fold = 8 and outcome = 'p_home'").collect()}
    assert home["strength"] > 0.8 and abs(sum(home.values()) - 1) < 1e-9


@pytest.mark.parametrize("least", [3.0, 20.0])
def test_a_split_is_the_best_of_all(least):
    """One tree of one split against the formulas of the specified booster, tried at each value of each feature."""
    rnd = np.random.default_rng(5)
    x = rnd.integers(0, 20, (300, 3)).astype("float64")
    y = (x[:, 1] + rnd.normal(0, 4, 300) > 12).astype("float64")
    options = boosting.Options(1, 1, 0.05, 1.0, 1.0, least, 0.1, 0.1, 1.0, 32, 42)
    codes = boosting.binned(x, boosting.edges_of(x, 32))
    chances, _ = boosting.boosted(codes, np.stack([y, 1 - y]), 250, options)
    x_train, y_train = x[:250], y[:250]
    start = math.log((y_train.sum() + 0.5) / (251 - y_train.sum() - 0.5))
    p = 1 / (1 + math.exp(-start))
    strong = lambda g: math.copysign(max(abs(g) - 0.1, 0), g)
    score = lambda m: strong((p - y_train[m]).sum()) ** 2 / (m.sum() * p * (1 - p) + 1)
    value = lambda m: -0.05 * strong((p - y_train[m]).sum()) / (m.sum() * p * (1 - p) + 1)
    tried = []
    for j in range(3):
        for cut in np.unique(x_train[:, j]):
            left = x_train[:, j] <= cut
            if min(left.sum(), (~left).sum()) * p * (1 - p) >= least:
                tried.append((score(left) + score(~left), j, cut, value(left), value(~left)))
    _, j, cut, low, high = max(tried)
    want = 1 / (1 + np.exp(-(start + np.where(x[250:, j] <= cut, low, high))))
    assert np.abs(chances[0] - want).max() < 1e-4 and j == 1
