"""Attack and defense ratings: whole-table fits and point-in-time window fits."""
from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pitchframe.functions import fit, numeric
from pitchframe.operators.clean import with_dates
from pitchframe.plans.ordered import ordered_groups
from pitchframe.plans.scratch import dropped, written
from pitchframe.plans.skew import tasks_for

# The solver travels with the task, so workers need no installed package.
cloudpickle.register_pickle_by_value(fit)

RATING_WINDOW = 8
# A fit stops when no factor changes by more than this share; one that still moves after
# so many sweeps hasn't converged.
TOLERANCE, SWEEPS = 1e-12, 2_000
# The same for a group that is solved by distributed sums, each sweep of which takes several jobs.
DISTRIBUTED_SWEEPS = 200
# Goals each factor of a window fit is worth before any match is seen.
PRIOR_GOALS = 3.0
# Windows fitted at once: as many as keep the arrays of a fit in the cache of a core.
FIT_WINDOWS = 2_000
# Most (team, opponent, home) cells of one group solved inside a task; a group of
# n teams has at most 2 n^2 of them. Larger groups are solved by distributed sums.
MAX_GROUP_CELLS = 2_000_000
# Most columns the normal equations of the general linear model may have.
MAX_GLR_COLUMNS = 4096

RATING_COLUMNS = (
    "home_attack_rating",
    "home_defense_rating",
    "away_attack_rating",
    "away_defense_rating",
)


def _sides(df: DataFrame, *keep: str) -> DataFrame:
    """Two rows per fixture, one seen from each team, in one scan."""

    def side(team: str, opponent: str, home: int, scored: str, conceded: str) -> Column:
        return F.struct(
            F.col(team).alias("team"),
            F.col(opponent).alias("opponent"),
            F.lit(home).alias("home"),
            F.col(scored).cast("double").alias("goals"),
            F.col(conceded).cast("double").alias("conceded"),
        )

    both = F.array(
        side("home_team", "away_team", 1, "home_goals", "away_goals"),
        side("away_team", "home_team", 0, "away_goals", "home_goals"),
    )
    return df.select(*keep, F.inline(both))


def poisson_observations(fixtures: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Home row and away row of every played fixture: team, opponent, home, goals."""
    played = fixtures.dropna(subset=["home_goals", "away_goals"])
    return _sides(played, *keep).drop("conceded")


def team_universe(fixtures: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """Distinct team names, unplayed fixtures included."""
    names = F.explode(F.array("home_team", "away_team")).alias("team")
    return fixtures.select(*group, names).where(F.col("team").isNotNull()).distinct()


def reference_team(fixtures: DataFrame) -> DataFrame:
    """First team in name order and the number of teams."""
    return team_universe(fixtures).agg(F.min("team").alias("first_team"), F.count("*").alias("teams"))


def empirical_home_advantage(fixtures: DataFrame, group: Sequence[str] = ("season",)) -> DataFrame:
    """Mean goals of all, home and away sides per group, and home over away."""
    obs = poisson_observations(fixtures, group)
    means = obs.groupBy(*group).agg(
        F.avg("goals").alias("mean_goals"),
        F.avg(F.when(F.col("home") == 1, F.col("goals"))).alias("mean_home_goals"),
        F.avg(F.when(F.col("home") == 0, F.col("goals"))).alias("mean_away_goals"),
    )
    away = F.col("mean_away_goals")
    ratio = F.when(away > 0, F.col("mean_home_goals") / F.nullif(away, F.lit(0.0)))
    return means.withColumn(
        "home_advantage", F.coalesce(ratio, F.lit(numeric.COLD_START_ADVANTAGE))
    )


def empirical_ratings(fixtures: DataFrame, group: Sequence[str] = ("season",)) -> DataFrame:
    """Mean goals scored and conceded per team over the mean of its group.

    Both means of a team come from the same rows, so one aggregation serves
    them. Teams without a played match have rating 1.
    """
    played = F.col("goals").isNotNull() & F.col("conceded").isNotNull()
    sides = _sides(fixtures, *group)
    teams = (
        sides.where(F.col("team").isNotNull())
        .groupBy(*group, "team")
        .agg(
            F.avg(F.when(played, F.col("goals"))).alias("scored"),
            F.avg(F.when(played, F.col("conceded"))).alias("conceded"),
        )
    )
    league = sides.where(played).groupBy(*group).agg(F.nullif(F.avg("goals"), F.lit(0.0)).alias("mean"))
    joined = teams.join(league, list(group), "left")
    one = F.lit(1.0)
    return joined.select(
        *group,
        "team",
        F.coalesce(F.col("scored") / F.col("mean"), one).alias("attack"),
        F.coalesce(F.col("conceded") / F.col("mean"), one).alias("defense"),
    )


def asof_strengths(fixtures: DataFrame, group: Sequence[str] = ("season",)) -> DataFrame:
    """Each fixture with ``{home,away}_{attack,defense}`` and ``home_advantage`` as known before its date.

    A team's means of goals scored and conceded, and those of its group, are taken over the
    matches of the group on strictly earlier dates. A team without one counts as average, and a group
    without an away goal has the advantage of a cold start; so has a fixture without a date.
    """
    group = list(group)
    fixtures = with_dates(fixtures)
    sides = _sides(fixtures, *group, "date").where(F.col("date").isNotNull())
    played = F.col("goals").isNotNull() & F.col("conceded").isNotNull()
    total = lambda value, condition=played: F.coalesce(F.sum(F.when(condition, value)), F.lit(0.0))
    at_home = played & (F.col("home") == 1)
    # one row per team and date, and per group and date: sums before a date need no row of that date
    team_days = sides.where(F.col("team").isNotNull()).groupBy(*group, "team", "date").agg(
        total(F.col("goals")).alias("scored"), total(F.col("conceded")).alias("against"), total(F.lit(1.0)).alias("matches")
    )
    group_days = sides.groupBy(*group, "date").agg(
        total(F.col("goals"), at_home).alias("at_home"), total(F.col("conceded"), at_home).alias("away"), total(F.lit(1.0), at_home).alias("matches")
    )
    before = lambda days, keys, names: ordered_groups(days, keys, ["date"]).running({f"{n}_before": ("sum", F.col(n)) for n in names}).result()
    teams = before(team_days, [*group, "team"], ["scored", "against", "matches"])
    league = before(group_days, group, ["at_home", "away", "matches"])
    key = lambda *columns: F.struct(*columns)
    out = fixtures.withColumn("__at", key(*group, "date"))
    league = league.select(key(*group, "date").alias("__at"), F.col("at_home_before").alias("__h"), F.col("away_before").alias("__a"), F.col("matches_before").alias("__n"))
    out = out.join(league, "__at", "left")
    mean = F.nullif((F.col("__h") + F.col("__a")) / F.nullif(2 * F.col("__n"), F.lit(0.0)), F.lit(0.0))
    out = out.withColumns({"__mean": mean, "home_advantage": F.coalesce(F.when(F.col("__a") > 0, F.col("__h") / F.nullif("__a", F.lit(0.0))), F.lit(numeric.COLD_START_ADVANTAGE))})
    # there may be as many team days as sides: merged, as the planner takes them for small
    for role in ("home", "away"):
        side = teams.select(key(*group, "team", "date").alias("__at"), *[F.col(f"{c}_before").alias(f"__{c}") for c in ("scored", "against", "matches")])
        out = out.withColumn("__at", key(*group, F.col(f"{role}_team").alias("team"), "date")).join(side.hint("merge"), "__at", "left")
        share = lambda c: F.coalesce(F.col(c) / F.nullif("__matches", F.lit(0.0)) / F.col("__mean"), F.lit(1.0))
        out = out.withColumns({f"{role}_attack": share("__scored"), f"{role}_defense": share("__against")}).drop("__scored", "__against", "__matches")
    return out.drop("__at", "__h", "__a", "__n", "__mean")


# --- whole-table fit ---------------------------------------------------------


def rating_cells(fixtures: DataFrame, group: Sequence[str]) -> DataFrame:
    """Sufficient statistics of the model: matches and goals per (team, opponent, home).

    The likelihood depends on the fixtures through these sums alone, so the data
    is read once however many sweeps follow.
    """
    played = F.col("goals").isNotNull() & F.col("conceded").isNotNull()
    return (
        _sides(fixtures, *group)
        .groupBy(*group, "team", "opponent", "home")
        .agg(
            F.count(F.when(played, F.lit(1))).cast("double").alias("matches"),
            F.coalesce(F.sum(F.when(played, F.col("goals"))), F.lit(0.0)).alias("goals"),
            F.count("*").alias("fixtures"),
        )
    )


def _solve_in_task(
    cells: DataFrame, group: Sequence[str], *, default_advantage: float, **options
) -> DataFrame:
    keys = ", ".join(f"`{g}` {cells.schema[g].dataType.simpleString()}" for g in group)
    schema = f"{keys}, team string, attack double, defense double, home_advantage double, converged boolean"
    multiplicative_fit, mean_one = fit.multiplicative_fit, fit.mean_one

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["home", "team", "opponent"])
        names = pdf["team"].dropna().unique()
        code = pd.Index(names)
        use = pdf[(pdf["matches"] > 0) & pdf["team"].notna() & pdf["opponent"].notna()]
        fitted = multiplicative_fit(
            np.zeros(len(use), dtype=np.int64),
            use["home"].to_numpy(),
            code.get_indexer(use["team"]),
            code.get_indexer(use["opponent"]),
            use["goals"].to_numpy(),
            use["matches"].to_numpy(),
            1,
            len(names),
            default_advantage=default_advantage,
            **options,
        )
        attack, defense, advantage, converged = fitted
        one_group = np.zeros(len(names), dtype=np.int64)
        result = pd.DataFrame(
            {
                "team": names,
                "attack": mean_one(attack, one_group, 1),
                "defense": mean_one(defense, one_group, 1),
                "home_advantage": advantage[0],
                "converged": converged[0],
            }
        )
        if len(names) < 2 or pdf["fixtures"].sum() < 4 or pdf["matches"].sum() < 4:
            # each fixture is two rows of the cells
            result = result.assign(attack=1.0, defense=1.0, home_advantage=default_advantage, converged=True)
        for g in reversed(group):
            result.insert(0, g, pdf[g].iloc[0])
        return result

    return cells.groupBy(*group).applyInPandas(solve, schema)


def _solve_distributed(
    cells: DataFrame,
    group: Sequence[str],
    *,
    sweeps: int,
    home_field_advantage: bool,
    tolerance: float,
    default_advantage: float,
) -> DataFrame:
    """The same updates as joins and grouped sums, for groups too large for a task.

    Only the team and rate tables change; each is written after its update, so
    the plan of an update never contains the updates before it, and the table it
    replaces is deleted. A sweep ends with one look at the largest change.
    """
    # one non-null key stands for the group columns in the joins
    cells = written(
        cells.withColumn("__g", F.to_json(F.struct(*group), {"ignoreNullFields": "false"})), "cells"
    )
    use = cells.where(
        (F.col("matches") > 0) & F.col("team").isNotNull() & F.col("opponent").isNotNull()
    ).select("__g", "team", "opponent", "home", "matches", "goals")
    one = F.lit(1.0)
    teams = written(
        cells.where(F.col("team").isNotNull())
        .select("__g", *group, "team")
        .distinct()
        .withColumns({"attack": one, "defense": one, "attack_change": F.lit(0.0), "defense_change": F.lit(0.0)}),
        "teams",
    )
    rates = written(use.select("__g").distinct().withColumns({"base": one, "advantage": one}), "rates")

    def step(keys: list[str], home_only: bool = False) -> DataFrame:
        fitted = (
            use.join(teams.select("__g", "team", "attack"), ["__g", "team"])
            .join(
                teams.select("__g", F.col("team").alias("opponent"), "defense"), ["__g", "opponent"]
            )
            .join(rates, "__g")
        )
        if home_only:
            fitted = fitted.where(F.col("home") == 1)
        lift = F.when(F.col("home") == 1, F.col("advantage")).otherwise(one)
        mu = F.sum(F.col("matches") * F.col("base") * lift * F.col("attack") * F.col("defense"))
        factor = F.coalesce(F.sum("goals") / F.nullif(mu, F.lit(0.0)), one)
        return fitted.groupBy("__g", *keys).agg(factor.alias("factor"))

    def scaled(table: DataFrame, factors: DataFrame, keys: list[str], column: str) -> DataFrame:
        joined = table.join(factors, ["__g", *keys], "left")
        factor = F.coalesce("factor", one)
        changes = {f"{column}_change": F.abs(factor - 1)} if f"{column}_change" in table.columns else {}
        new = written(joined.withColumns({column: F.col(column) * factor, **changes}).drop("factor"), column)
        dropped(table)
        return new

    still = False
    for sweep in range(sweeps + 1):
        rates = scaled(rates, step([]), [], "base")
        if home_field_advantage:
            rates = scaled(rates, step([], home_only=True), [], "advantage")
        if sweep < sweeps:
            teams = scaled(teams, step(["team"]), ["team"], "attack")
            by_opponent = step(["opponent"]).withColumnRenamed("opponent", "team")
            teams = scaled(teams, by_opponent, ["team"], "defense")
            if still:
                break
            # base and advantage are updated once more after the last change of the teams
            largest = teams.agg(F.max(F.greatest("attack_change", "defense_change"))).first()[0]
            still = largest is not None and largest <= tolerance

    size = cells.groupBy("__g").agg(
        F.countDistinct("team").alias("teams"),
        F.sum("fixtures").alias("sides"),
        F.sum("matches").alias("observations"),
        F.coalesce(F.sum("goals") > 0, F.lit(False)).alias("some"),
    )
    enough = (F.col("teams") >= 2) & (F.col("sides") >= 4) & (F.col("observations") >= 4)
    if home_field_advantage:
        usable = F.col("some") & (F.col("advantage") > 0)
        advantage = F.when(usable, F.col("advantage")).otherwise(F.lit(default_advantage))
    else:
        advantage = one
    per_group = (
        teams.groupBy("__g")
        .agg(
            F.avg("attack").alias("a"),
            F.avg("defense").alias("d"),
            (F.max(F.greatest("attack_change", "defense_change")) <= tolerance).alias("still"),
        )
        .join(size.select("__g", "some", enough.alias("enough")), "__g")
        .join(rates, "__g", "left")
        .select("__g", "a", "d", "enough", "still", advantage.alias("home_advantage"))
    )
    mean = lambda c: F.when(F.col(c) > 0, F.col(c)).otherwise(one)
    fitted = lambda value, default: F.when(F.col("enough"), value).otherwise(F.lit(default))
    return teams.join(per_group, "__g").select(
        *group,
        "team",
        fitted(F.col("attack") / mean("a"), 1.0).alias("attack"),
        fitted(F.col("defense") / mean("d"), 1.0).alias("defense"),
        fitted(F.col("home_advantage"), default_advantage).alias("home_advantage"),
        (~F.col("enough") | F.col("still")).alias("converged"),
    )


def fit_poisson_ratings(
    fixtures: DataFrame,
    group: Sequence[str] = ("season",),
    *,
    home_field_advantage: bool = True,
    sweeps: int = SWEEPS,
    tolerance: float = TOLERANCE,
    max_group_cells: int = MAX_GROUP_CELLS,
) -> DataFrame:
    """Attack, defense (mean 1 per group), home advantage and ``converged``, one fit per group.

    Groups with fewer than two teams, two fixtures or four observations have all
    ratings 1 and the cold-start advantage. A group that still moves after ``sweeps``
    has the empirical ratings and advantage instead, and ``converged`` is false.
    """
    fitted = _fitted_ratings(fixtures, group, home_field_advantage, sweeps, tolerance, max_group_cells)
    group = list(group)
    failed = fitted.where(~F.col("converged"))
    if failed.isEmpty():
        return fitted
    if not group:
        fitted, fixtures, group = fitted.withColumn("__whole", F.lit(0)), fixtures.withColumn("__whole", F.lit(0)), ["__whole"]
    mine, theirs = [F.struct(*[f"{side}.{g}" for g in group]) for side in ("f", "e")]
    means = empirical_ratings(fixtures, group).withColumnsRenamed({"attack": "e_attack", "defense": "e_defense"})
    joined = fitted.alias("f").join(means.alias("e"), mine.eqNullSafe(theirs) & (F.col("f.team") == F.col("e.team")), "left")
    joined = joined.select("f.*", "e_attack", "e_defense")
    ratio = empirical_home_advantage(fixtures, group).withColumnRenamed("home_advantage", "e_advantage")
    joined = joined.alias("f").join(ratio.alias("e"), mine.eqNullSafe(theirs), "left").select("f.*", "e_advantage")
    kept = lambda name, other: F.when(F.col("converged"), F.col(name)).otherwise(F.col(other)).alias(name)
    advantage = kept("home_advantage", "e_advantage") if home_field_advantage else F.col("home_advantage")
    out = joined.select(*group, "team", kept("attack", "e_attack"), kept("defense", "e_defense"), advantage, "converged")
    return out.drop("__whole")


def _fitted_ratings(
    fixtures: DataFrame, group: Sequence[str], home_field_advantage: bool, sweeps: int, tolerance: float, max_group_cells: int
) -> DataFrame:
    """The fits themselves, as a table of one row per group and team."""
    group = list(group)
    if not group:
        grouped = fixtures.withColumn("__whole", F.lit(0))
        return _fitted_ratings(grouped, ["__whole"], home_field_advantage, sweeps, tolerance, max_group_cells).drop("__whole")
    cells = written(rating_cells(fixtures, group), "rating-cells")
    options = {
        "sweeps": sweeps,
        "home_field_advantage": home_field_advantage,
        "tolerance": tolerance,
        "default_advantage": numeric.COLD_START_ADVANTAGE,
    }
    # each group by its own size: one that is too large changes nothing for the others
    large = cells.groupBy(*group).count().where(F.col("count") > max_group_cells)
    large = large.select(*[F.col(g).alias(f"__{g}") for g in group])
    if large.isEmpty():
        return written(_solve_in_task(cells, group, **options), "ratings")
    large = written(large, "large-groups")
    same = reduce(and_, [F.col(g).eqNullSafe(F.col(f"__{g}")) for g in group])
    small = _solve_in_task(cells.join(large, same, "left_anti"), group, **options)
    options["sweeps"] = min(sweeps, DISTRIBUTED_SWEEPS)
    return written(small.unionByName(_solve_distributed(cells.join(large, same, "left_semi"), group, **options)), "ratings")


def fit_poisson_ratings_glr(
    fixtures: DataFrame, *, home_field_advantage: bool = True, max_iter: int = 50
) -> DataFrame:
    """The whole-table fit by Spark ML's general linear model, on weighted cells.

    It needs an identified model and at most ``MAX_GLR_COLUMNS`` columns.
    """
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
    from pyspark.ml.regression import GeneralizedLinearRegression

    cells = rating_cells(fixtures, []).where(
        (F.col("matches") > 0) & F.col("team").isNotNull() & F.col("opponent").isNotNull()
    )
    data = written(
        cells.select(
            "team",
            "opponent",
            F.col("home").cast("double").alias("home"),
            "matches",
            (F.col("goals") / F.col("matches")).alias("mean_goals"),
        ),
        "glr-cells",
    )
    teams = max(data.select(F.countDistinct("team"), F.countDistinct("opponent")).first())
    if 2 * teams > MAX_GLR_COLUMNS:
        raise ValueError(f"{teams} teams exceed the normal equations; use fit_poisson_ratings")
    inputs = [*(["home"] if home_field_advantage else []), "team_x", "opponent_x"]
    order = {"stringOrderType": "alphabetDesc"}  # the encoder drops the last, i.e. the first name
    model = Pipeline(
        stages=[
            StringIndexer(inputCol="team", outputCol="team_i", **order),
            StringIndexer(inputCol="opponent", outputCol="opponent_i", **order),
            OneHotEncoder(inputCols=["team_i", "opponent_i"], outputCols=["team_x", "opponent_x"]),
            VectorAssembler(inputCols=inputs, outputCol="features"),
            GeneralizedLinearRegression(
                family="poisson", link="log", labelCol="mean_goals", weightCol="matches",
                maxIter=max_iter, tol=1e-12,
            ),
        ]
    ).fit(data)
    team_names, opponent_names = (model.stages[i].labels for i in (0, 1))
    coefficients = list(model.stages[-1].coefficients)
    home = coefficients.pop(0) if home_field_advantage else 0.0
    n = len(team_names) - 1
    scale = {
        "attack": dict(zip(team_names, [*coefficients[:n], 0.0])),
        "defense": dict(zip(opponent_names, [*coefficients[n:], 0.0])),
    }
    names = sorted(set(team_names) | set(opponent_names))
    factors = {k: np.exp([v.get(t, 0.0) for t in names]) for k, v in scale.items()}
    # one row per team, bounded by the column limit above
    table = pd.DataFrame({"team": names, **{k: v / v.mean() for k, v in factors.items()}})
    table["home_advantage"] = float(np.exp(home))
    return fixtures.sparkSession.createDataFrame(table)


# --- point-in-time fit -------------------------------------------------------


def team_last_n(fixtures: DataFrame, n: int = RATING_WINDOW) -> DataFrame:
    """The latest ``n`` fixtures of each team.

    The rank filter is applied before the shuffle too, so a task sends at most
    ``n`` rows per team.
    """
    latest = Window.partitionBy("team").orderBy(
        F.col("date").desc_nulls_first(), F.col("fixture_id").desc()
    )
    teams = F.explode(F.array_distinct(F.array("home_team", "away_team"))).alias("team")
    return (
        with_dates(fixtures)
        .select(teams, "fixture_id", "date")
        .where(F.col("team").isNotNull())
        .withColumn("recency", F.row_number().over(latest))
        .where(F.col("recency") <= n)
    )


def _histories(fixtures: DataFrame, window: int, remember: Column, name: str) -> DataFrame:
    """Per fixture what is remembered of the last ``window`` earlier fixtures of both teams.

    Unplayed fixtures take a place in the window. A fixture of a team with itself
    counts once, as a home row. The rows are dealt by fixture before they are grouped: no two rows of
    a fixture come from one team, so there is nothing to combine earlier.
    """
    rows = _sides(with_dates(fixtures), "fixture_id", "date").where(
        F.col("team").isNotNull() & ((F.col("home") == 1) | ~F.col("team").eqNullSafe(F.col("opponent")))
    )
    rows = rows.select("fixture_id", "date", "team", "home", remember.alias("__match"))
    groups = ordered_groups(rows, ["team"], ["date", "fixture_id"]).rolling(
        window, lambda w: {"history": F.collect_list("__match").over(w)}, reads=["__match"]
    )
    side = lambda flag: F.first(F.when(F.col("home") == flag, F.col("history")), ignorenulls=True)
    found = groups.result().select("fixture_id", "home", "history")
    return (
        found.repartition(tasks_for(found, groups.rows), "fixture_id")
        .groupBy("fixture_id")
        .agg(side(1).alias(f"home_{name}"), side(0).alias(f"away_{name}"))
    )


def window_histories(fixtures: DataFrame, window: int = RATING_WINDOW) -> DataFrame:
    """Histories of both teams as short match structs, oldest first.

    A match is kept as its team saw it: opponent, home flag, goals for and
    against. No id is needed to recognize a match both teams share, see
    :func:`_window_fit`, so the arrays that are shuffled stay small.
    """
    match = F.struct(
        "opponent", F.col("home").cast("boolean").alias("home"), "goals", "conceded"
    )
    return _histories(fixtures, window, match, "history")


def rating_window_members(fixtures: DataFrame, window: int = RATING_WINDOW) -> DataFrame:
    """One row per fixture and earlier fixture in its rating window."""
    nothing = F.array().cast("array<string>")
    ids = _histories(fixtures, window, F.col("fixture_id"), "ids")
    members = F.array_union(*[F.coalesce(f"{role}_ids", nothing) for role in ("home", "away")])
    return ids.select("fixture_id", F.explode(members).alias("member_id"))


def _window_fit(sweeps: int, home_field_advantage: bool, prior: float, tolerance: float):
    """Arrow UDF fitting ``FIT_WINDOWS`` windows of a batch at once.

    Earlier meetings of the two teams appear in both histories. Each history
    holds the latest of them, so the shorter list is the end of the longer one:
    leaving out the meetings of the side that has fewer keeps each exactly once.
    """
    default_advantage = numeric.COLD_START_ADVANTAGE
    fields = [*[pa.field(c, pa.float64()) for c in (*RATING_COLUMNS, "home_advantage")], pa.field("converged", pa.bool_())]
    solve, normalize, at_once = fit.multiplicative_fit, fit.mean_one, FIT_WINDOWS

    def fitted(home: pa.Array, away: pa.Array, home_history: pa.Array, away_history: pa.Array) -> pa.Array:
        n = len(home)
        window = np.arange(n)
        sizes = [pc.fill_null(pc.list_value_length(h), 0).to_numpy() for h in (home_history, away_history)]
        row = np.concatenate([np.repeat(window, k) for k in sizes])
        of_away = np.repeat([False, True], [k.sum() for k in sizes])
        matches = pa.concat_arrays([pc.list_flatten(h) for h in (home_history, away_history)])
        column = lambda name: pc.struct_field(matches, name)

        names = pc.dictionary_encode(
            pa.concat_arrays([column("opponent"), home.cast(pa.string()), away.cast(pa.string())])
        )
        code = pc.fill_null(names.indices, -1).to_numpy(zero_copy_only=False).astype(np.int64)
        n_names = max(len(names.dictionary), 1)
        opponent, own = code[: len(row)], {"home": code[len(row) : len(code) - n], "away": code[len(code) - n :]}
        team = np.where(of_away, own["away"][row], own["home"][row])
        other = np.where(of_away, own["home"][row], own["away"][row])

        meeting = (opponent == other) & (opponent >= 0)
        met = [np.bincount(row[meeting & (of_away == side)], minlength=n) for side in (False, True)]
        repeated = meeting & (of_away == (met[1] <= met[0])[row])
        keep = ~repeated
        row, team, opponent = row[keep], team[keep], opponent[keep]
        at_home = column("home").to_numpy(zero_copy_only=False)[keep].astype(np.int64)
        scored, conceded = (column(c).to_numpy(zero_copy_only=False)[keep] for c in ("goals", "conceded"))

        # one slot per (window, team)
        both_rows, both = np.concatenate([row, row]), np.concatenate([team, opponent])
        known = both >= 0
        slots = np.unique(both_rows[known] * n_names + both[known])
        slot_row = slots // n_names
        at = lambda r, c: np.searchsorted(slots, r * n_names + c)

        played = ~(np.isnan(scored) | np.isnan(conceded))
        use = played & (opponent >= 0)
        t, o = at(row[use], team[use]), at(row[use], opponent[use])
        # the two teams of the fixture take part in every match of its window
        slot_name = slots % n_names
        hub = np.where(slot_name == own["home"][slot_row], 0, np.where(slot_name == own["away"][slot_row], 1, -1))
        attack, defense, advantage, converged = solve(
            np.concatenate([row[use], row[use]]),
            np.concatenate([at_home[use], 1 - at_home[use]]),
            np.concatenate([t, o]),
            np.concatenate([o, t]),
            np.concatenate([scored[use], conceded[use]]),
            np.ones(2 * len(t)),
            n,
            len(slots),
            sweeps=sweeps,
            home_field_advantage=home_field_advantage,
            prior=prior,
            tolerance=tolerance,
            default_advantage=default_advantage,
            hub=hub,
        )
        attack, defense = normalize(attack, slot_row, n), normalize(defense, slot_row, n)
        # two teams and two played fixtures are the least a fit is made of
        enough = (np.bincount(row[played], minlength=n) >= 2) & (np.bincount(slot_row, minlength=n) >= 2)

        def rating(values, role):
            result = np.ones(n)
            if len(slots):
                place = np.minimum(at(window, own[role]), len(slots) - 1)
                hit = enough & (own[role] >= 0) & (slots[place] == window * n_names + own[role])
                result[hit] = values[place[hit]]
            return result

        columns = [
            rating(attack, "home"),
            rating(defense, "home"),
            rating(attack, "away"),
            rating(defense, "away"),
            np.where(enough, advantage, default_advantage),
            converged | ~enough,
        ]
        return pa.StructArray.from_arrays([pa.array(c) for c in columns], fields=fields)

    @F.arrow_udf(", ".join(f"{f.name} double" for f in fields[:-1]) + ", converged boolean")
    def ratings(home: pa.Array, away: pa.Array, home_history: pa.Array, away_history: pa.Array) -> pa.Array:
        given = home, away, home_history, away_history
        starts = range(0, max(len(home), 1), at_once)
        return pa.concat_arrays([fitted(*[a.slice(start, at_once) for a in given]) for start in starts])

    return ratings


def rolling_ratings(
    fixtures: DataFrame,
    window: int = RATING_WINDOW,
    *,
    home_field_advantage: bool = True,
    sweeps: int = SWEEPS,
    prior: float = PRIOR_GOALS,
    tolerance: float = TOLERANCE,
) -> DataFrame:
    """Each fixture with ratings and expected goals known before it was played.

    A window of 16 matches doesn't identify the factors of all its teams. ``prior`` goals pull
    each factor towards 1, which makes the maximum unique; ``ratings_converged`` tells whether it was
    reached within ``sweeps``. The prior is positive.
    """
    if prior <= 0:
        raise ValueError("a window fit needs a positive prior to be defined")
    fixtures = with_dates(fixtures)
    histories = window_histories(fixtures, window)
    fitted = _window_fit(sweeps, home_field_advantage, prior, tolerance)(
        "home_team", "away_team", "home_history", "away_history"
    )
    rated = (
        # histories are many times the size the planner takes from the files: never broadcast them
        fixtures.join(histories.hint("merge"), "fixture_id", "left")
        .withColumn("__fit", fitted)
        .select(*fixtures.columns, "__fit.*")
        .withColumnRenamed("converged", "ratings_converged")
    )
    home, away = numeric.expected_goals(*[F.col(c) for c in RATING_COLUMNS], F.col("home_advantage"))
    return rated.withColumns({"expected_home_goals": home, "expected_away_goals": away}).drop("home_advantage")
