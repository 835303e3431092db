"""Boosted outcome model with walk-forward validation.

Every fold has trees of its own, of all fixtures before it, so the work grows with the square of
the fixtures. Folds don't depend on each other: they are dealt over tasks, which get the fixtures
once for many folds. A fold of more rows than a task should hold is fitted by
sums over all tasks, a job per level of a tree, to the same trees.
"""
from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitchframe.functions import boosting
from pitchframe.functions.boosting import Options, Tree
from pitchframe.operators.clean import with_dates
from pitchframe.operators.evaluate import INITIAL_TRAIN_SIZE, STEP_SIZE, walk_forward_folds
from pitchframe.operators.forecast import OUTCOMES
from pitchframe.plans.scratch import dropped, scratch_path, written
from pitchframe.plans.skew import max_group_rows, tasks_for

# Fixed values of the booster.
MAX_DEPTH = 4
LEARNING_RATE = 0.05
TREES = 300
SUBSAMPLE = 0.8
COLUMN_SHARE = 0.8
MIN_CHILD_WEIGHT = 3.0
MIN_GAIN = 0.1
L1 = 0.1
L2 = 1.0
BINS = 32
# Trees split this value off, so a missing feature forms a branch of its own.
MISSING = -1000.0

# A fold that ends beyond these rows is fitted by sums over all tasks.
FIT_ROWS = 500_000
# Tasks that share the other folds, for each core. They are dealt by ranges, as a hash would put several in one.
TASKS_PER_CORE = 8
# Trees of such a fold until its rows are stored with their scores.
TREES_AT_ONCE = 25

# Fixtures of a fold by position, with the chance of each outcome; without position,
# the share of each outcome's gain that each column has.
_FITS = "fold bigint, position bigint, values array<double>"
_STATE = "position bigint, outcome int, codes binary, raw array<double>"

Batches = Iterator[pa.RecordBatch]


def _matrix(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _happened(outcome: np.ndarray) -> np.ndarray:
    return (np.arange(len(OUTCOMES))[:, None] == outcome).astype("float64")


def _fits(fold: int, positions: np.ndarray, chances: np.ndarray, shares: np.ndarray | None = None) -> pa.Table:
    values = (chances / chances.sum(axis=0)).T.tolist()
    places = positions.tolist()
    if shares is not None:
        values, places = [*values, shares.ravel().tolist()], [*places, None]
    arrays = [pa.array([fold] * len(places), pa.int64()), pa.array(places, pa.int64()), pa.array(values, pa.list_(pa.float64()))]
    return pa.table(arrays, ["fold", "position", "values"])


def _within_tasks(data: DataFrame, folds: int, ends: Callable[[int], tuple[int, int]], m: int, options: Options) -> DataFrame:
    """Fits of folds 1 to ``folds``; a task gets all fixtures they need and each so many-th fold."""
    tasks = min(folds, TASKS_PER_CORE * data.sparkSession.sparkContext.defaultParallelism)

    def fit(table: pa.Table) -> pa.Table:
        order = np.argsort(table["position"].to_numpy())
        x, happened = _matrix(table["x"], m)[order], _happened(table["outcome"].to_numpy()[order])
        parts = []
        for fold in range(table["task"][0].as_py() + 1, folds + 1, tasks):
            train, end = ends(fold)
            codes = boosting.binned(x[:end], boosting.edges_of(x[:train], options.bins))
            chances, shares = boosting.boosted(codes, happened[:, :end], train, options)
            parts.append(_fits(fold, np.arange(train + 1, end + 1), chances, shares))
        return pa.concat_tables(parts)

    needed = data.where(F.col("position") <= ends(folds)[1]).select("position", "outcome", "x")
    dealt = needed.withColumn("task", F.explode(F.sequence(F.lit(0), F.lit(tasks - 1))))
    return dealt.repartitionByRange(tasks, "task").groupBy("task").applyInArrow(fit, _FITS)


def _over_tasks(data: DataFrame, fold: int, train: int, end: int, m: int, options: Options) -> DataFrame:
    """Fit of one fold, whose rows stay where they are: tasks send sums per place, column and bin."""
    spark, outcomes, bins = data.sparkSession, len(OUTCOMES), options.bins
    rows = data.where(F.col("position") <= end).select("position", "outcome", "x")
    cuts = [F.percentile_approx(F.col("x")[j], boosting.quantiles(bins)).alias(f"x{j}") for j in range(m)]
    counts = [F.count_if(F.col("outcome") == k).cast("double").alias(f"n{k}") for k in range(outcomes)]
    known = rows.where(F.col("position") <= train).agg(*cuts, *counts).first()
    edges = [np.unique(np.asarray(known[f"x{j}"], dtype="float64")) for j in range(m)]
    prior = boosting.prior(np.asarray([known[f"n{k}"] for k in range(outcomes)]))

    def batch_of(position: pa.Array, outcome: pa.Array, codes: np.ndarray, raw: np.ndarray) -> pa.RecordBatch:
        scores = pa.array(raw.T.tolist(), pa.list_(pa.float64()))
        packed = pa.array([c.tobytes() for c in codes], pa.binary())
        return pa.record_batch([position, outcome, packed, scores], ["position", "outcome", "codes", "raw"])

    def start(batches: Batches) -> Batches:
        for batch in batches:
            codes = boosting.binned(_matrix(batch["x"], m), edges)
            yield batch_of(batch["position"], batch["outcome"], codes, np.repeat(prior[:, None], len(codes), axis=1))

    def scored(batches: Batches, trees: list[Tree]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
        for batch in batches:
            if not batch.num_rows:
                continue
            codes = np.frombuffer(b"".join(batch["codes"].to_pylist()), dtype="uint8").reshape(-1, m)
            raw = _matrix(batch["raw"], outcomes).T
            for tree in trees:
                raw = tree.added(codes, raw)
            yield batch, codes, raw

    state = written(rows.repartition(tasks_for(rows, end), "position").mapInArrow(start, _STATE), "scored")
    gained, pending = np.zeros((outcomes, m)), []
    for number in range(options.trees if train else 0):
        columns = options.columns(m, number)

        def measure(level: int, tree: Tree, smaller: np.ndarray, trees: tuple = tuple(pending)) -> np.ndarray:
            shape = (2, outcomes, 2**level, len(columns), bins)

            def count(batches: Batches) -> Batches:
                sums = np.zeros((2, int(np.prod(shape[1:]))))
                for batch, codes, raw in scored(batches, list(trees)):
                    position = batch["position"].to_numpy()
                    drawn = options.drawn(position, number) & (position <= train)
                    at = boosting.roots(outcomes, len(codes))
                    for above in range(level):
                        at = tree.step(codes, above, at)
                    weight = boosting.weights(raw, _happened(batch["outcome"].to_numpy()))
                    row, place, heavy = boosting.picked(np.broadcast_to(drawn, at.shape), at, weight)
                    cells = boosting.cells_of(codes, columns, bins)
                    part = boosting.histograms(cells, row, place, outcomes * 2**level, bins, heavy)
                    sums += part.reshape(2, -1)
                cell = np.flatnonzero(sums.any(axis=0))
                yield pa.record_batch([pa.array(cell), pa.array(sums[0, cell]), pa.array(sums[1, cell])], ["cell", "g", "h"])

            parts = state.mapInArrow(count, "cell bigint, g double, h double")
            whole = parts.groupBy("cell").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).toPandas()
            sums = np.zeros((2, int(np.prod(shape[1:]))))
            sums[:, whole["cell"].to_numpy(dtype="int64")] = whole["g"], whole["h"]
            return sums.reshape(shape)

        tree, gain = boosting.grow(measure, outcomes, m, columns, options)
        gained += gain
        pending.append(tree)
        if len(pending) == TREES_AT_ONCE:

            def advance(batches: Batches, trees: tuple = tuple(pending)) -> Batches:
                for batch, codes, raw in scored(batches, list(trees)):
                    yield batch_of(batch["position"], batch["outcome"], codes, raw)

            before, state = state, written(state.mapInArrow(advance, _STATE), "scored")
            dropped(before)
            pending = []

    def forecast(batches: Batches) -> Batches:
        for batch, _, raw in scored(batches, pending):
            yield from _fits(fold, batch["position"].to_numpy(), boosting.chances(raw)).to_batches()

    shares = spark.createDataFrame([(fold, None, boosting.shares(gained).ravel().tolist())], _FITS)
    return state.where(F.col("position") > train).mapInArrow(forecast, _FITS).unionByName(shares)


def boosted_model(
    table: DataFrame,
    columns: Sequence[str],
    *,
    initial_train_size: int = INITIAL_TRAIN_SIZE,
    step_size: int = STEP_SIZE,
    trees: int = TREES,
    max_depth: int = MAX_DEPTH,
    learning_rate: float = LEARNING_RATE,
    subsample: float = SUBSAMPLE,
    column_share: float = COLUMN_SHARE,
    min_child_weight: float = MIN_CHILD_WEIGHT,
    min_gain: float = MIN_GAIN,
    l1: float = L1,
    l2: float = L2,
    bins: int = BINS,
    seed: int = 42,
) -> tuple[DataFrame, DataFrame]:
    """Outcome probabilities of every tested fixture, and feature importances per fold.

    ``table`` has fixture_id, date, result (home, draw, away) and the feature
    columns. One binary model per outcome, rescaled to sum 1; fold k is scored
    by models trained on the rows before it alone.
    """
    spark, m = table.sparkSession, len(columns)
    options = Options(
        trees, max_depth, learning_rate, subsample, column_share, min_child_weight, min_gain, l1, l2, bins, seed
    )
    known = F.array(*[F.lit(o.removeprefix("p_")) for o in OUTCOMES])
    missing = F.lit(MISSING)
    filled = [F.coalesce(F.nanvl(F.col(c).cast("double"), missing), missing) for c in columns]
    # the features are made once; folds, fits and forecasts read the stored rows
    made = written(
        with_dates(table)
        .where(F.col("result").isNotNull())
        .select("fixture_id", "date", "result", F.array(*filled).alias("x")),
        "boosted",
    )
    placed = walk_forward_folds(made, initial_train_size, step_size, keep=["result", "x"])
    data = written(placed.withColumn("outcome", (F.array_position(known, F.col("result")) - 1).cast("int")), "placed")
    dropped(made)

    rows = data.count()
    folds = max(0, -((initial_train_size - rows) // step_size))

    def ends(fold: int) -> tuple[int, int]:
        train = initial_train_size + step_size * (fold - 1)
        return train, min(train + step_size, rows)

    limit = min(FIT_ROWS, max_group_rows(data))
    within = sum(ends(fold)[1] <= limit for fold in range(1, folds + 1))
    path = scratch_path(spark, "fits")
    fits = _within_tasks(data, within, ends, m, options) if within else spark.createDataFrame([], _FITS)
    fits.write.parquet(path)
    for fold in range(within + 1, folds + 1):
        _over_tasks(data, fold, *ends(fold), m, options).write.mode("append").parquet(path)
    fits = spark.read.schema(_FITS).parquet(path)

    chances = [F.col("values")[k].alias(o) for k, o in enumerate(OUTCOMES)]
    forecasts = fits.where(F.col("position").isNotNull()).select("position", *chances)
    predictions = data.join(forecasts, "position").select("fixture_id", "fold", "result", *OUTCOMES)
    outcome = F.array(*[F.lit(o) for o in OUTCOMES])[F.floor(F.col("pos") / m).cast("int")]
    feature = F.array(*[F.lit(c) for c in columns])[F.col("pos") % m]
    importances = (
        fits.where(F.col("position").isNull())
        .select("fold", F.posexplode("values").alias("pos", "importance"))
        .select("fold", outcome.alias("outcome"), feature.alias("feature"), "importance")
    )
    return predictions, importances
