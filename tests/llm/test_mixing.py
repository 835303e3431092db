from collections import defaultdict

import numpy as np
import pytest

from pitchframe.llm import mixing
from tests.llm.helpers import documents, none, odd


def targets_by_sharing(sizes, weights=(5, 2, 1), most=3.0):
    """Reshare the excess of capped sources by weight until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    free, target, left = set(names), {}, float(sum(sizes.values()))
    while free:
        rate = left / sum(weight[s] for s in free)
        over = {s for s in free if rate * weight[s] > most * sizes[s]}
        if not over:
            target |= {s: rate * weight[s] for s in free}
            break
        target |= {s: most * sizes[s] for s in over}
        left -= sum(target[s] for s in over)
        free -= over
    return target


def check(spark, docs, slack=1.0, **options):
    sized = mixing.word_sizes(docs)
    sizes, largest = defaultdict(int), defaultdict(int)
    for r in sized.collect():
        sizes[r["source"]] += r["size"]
        largest[r["source"]] = max(largest[r["source"]], r["size"])
    want = targets_by_sharing(sizes)
    rows = mixing.mixture(docs, **options).collect()
    assert len(rows) == docs.count()
    totals = {(sizes[s], round(want[s], 6)): 0 for s in sizes}
    for r in rows:
        assert r["taken"] == r["copies"] * r["size"] and 0 <= r["taken"] <= 3 * r["size"]
        totals[(r["source_size"], round(r["target"], 6))] += r["taken"]
    groups = defaultdict(list)
    for s in sizes:
        groups[(sizes[s], round(want[s], 6))].append(s)
    for key, sources in groups.items():
        assert abs(totals[key] - sum(want[s] for s in sources)) <= slack * sum(largest[s] for s in sources) + 1e-6
    return sorted(map(tuple, rows), key=str)


def test_documents_by_levels(spark):
    docs = documents(spark)
    one = check(spark, docs)
    assert one == check(spark, docs.repartition(5))
    check(spark, docs, group_rows=40)


def test_odd_rows(spark):
    check(spark, odd(spark))
    check(spark, odd(spark), group_rows=2)
    with pytest.raises(ValueError):
        mixing.mixture(odd(spark), group_rows=1)
    assert mixing.mixture(none(spark)).collect() == []
    assert mixing.mixed(none(spark)).collect() == []


def test_small_sources_are_capped(spark):
    rows = [(i, "w " * 10, "a" if i == 0 else "b") for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    taken = {r["doc_id"]: r for r in mixing.mixture(docs).collect()}
    assert taken[0]["target"] == 30.0 and taken[0]["taken"] == 30
    assert taken[1]["target"] == 170.0


def test_expected_copies_are_kept():
    size, p = np.array([3.0, 5.0, 2.0, 9.0]), np.array([0.3, 0.6, 0.5, 0.8])
    total = np.zeros(4)
    for seed in range(4000):
        rng = np.random.default_rng(seed)
        out, pivot = mixing.round_group(p, size, rng.random(4))
        assert abs((out * size).sum() - (p * size).sum()) < 1e-9
        if pivot >= 0:
            out[pivot] = rng.random() < out[pivot]
        total += out
    assert np.abs(total / 4000 - p).max() < 0.04


def test_mixed_rows_follow_the_copies(spark):
    docs = odd(spark)
    copies = sum(r["copies"] for r in mixing.mixture(docs).collect())
    out = mixing.mixed(docs)
    assert out.columns == docs.columns
    assert out.count() == copies


@pytest.mark.parametrize("value", [None, "", " \n"])
def test_no_words(spark, value):
    docs = spark.createDataFrame([(1, value, "a")], "doc_id long, text string, source string")
    assert [tuple(r)[:5] for r in mixing.mixture(docs).collect()] == [(1, 0, 0, 0.0, 0)]
