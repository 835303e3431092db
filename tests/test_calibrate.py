import bisect

import numpy as np
import pytest
from pyspark.sql import functions as F

from pitchframe.operators import calibrate


def _curve(points):
    """Pool adjacent violators over (p, y) in plain Python."""
    sums = {}
    for p, y in points:
        s, n = sums.get(p, (0.0, 0))
        sums[p] = (s + y, n + 1)
    blocks = []
    for p in sorted(sums):
        blocks.append([p, *sums[p]])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            _, s, n = blocks.pop()
            blocks[-1][1] += s
            blocks[-1][2] += n
    return [b[0] for b in blocks], [b[1] / b[2] for b in blocks]


@pytest.mark.parametrize("block_rows", [100_000, 7])
def test_out_of_fold_curves_know_earlier_folds_only(spark, block_rows):
    rng = np.random.default_rng(2)
    rows = [(i, i % 4, round(float(rng.random()), 2), float(rng.random() < 0.4), "x") for i in range(300)]
    rows += [(900, 2, None, 1.0, "x"), (901, 3, 0.5, None, "x"), (902, None, 0.5, 1.0, "x"), (903, 3, 0.0, 0.0, "x"), (903, 3, 0.0, 0.0, "x")]
    df = spark.createDataFrame(rows, "id long, fold long, p double, y double, curve string")
    got = calibrate.isotonic_out_of_fold(df, "p", "y", "fold", 4, block_rows)
    assert got.columns == [*df.columns, "calibrated"]
    found = sorted(map(tuple, got.collect()), key=str)
    assert len(found) == len(rows)
    for i, fold, p, y, _, calibrated in found:
        past = [(r[2], r[3]) for r in rows if r[1] is not None and fold is not None and r[1] < fold and None not in r[2:4]]
        if p is None or not past:
            assert calibrated is None
        else:
            x, fit = _curve(past)
            assert calibrated == pytest.approx(fit[max(0, bisect.bisect_right(x, p) - 1)])
    effect = {r.fold: r for r in calibrate.recalibration_effect(got, "p", "calibrated", "y", "fold").collect()}
    assert set(effect) == {1, 2, 3}
    mine = [r for r in found if r[1] == 3 and None not in (r[2], r[3], r[5])]
    assert effect[3].n == len(mine) and effect[3].brier_after == pytest.approx(np.mean([(r[5] - r[3]) ** 2 for r in mine]))


def test_folds_out_of_range_and_no_rows(spark):
    df = spark.createDataFrame([(0, 0.5, 1.0), (5, 0.5, 0.0)], "fold long, p double, y double")
    with pytest.raises(Exception, match="fold outside"):
        calibrate.isotonic_out_of_fold(df, "p", "y", "fold", 3).collect()
    assert calibrate.isotonic_out_of_fold(df.limit(0), "p", "y", "fold", 3).collect() == []
    first = calibrate.isotonic_out_of_fold(df.where("fold = 0"), "p", "y", "fold", 3).withColumn("none", F.col("calibrated").isNull())
    assert [r["none"] for r in first.collect()] == [True]
