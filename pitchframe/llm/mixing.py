"""Mixing sources to target weights by pivotal dependent rounding.

Every document of a source should be taken ``target / source size`` times. The whole
part of that number is taken as it is; the fractional parts are rounded in pairs:
two documents hand words to each other, at random in the direction but without
changing the expected copies of either, until one of them has a whole number.
The words a source takes thus change only when its very last document is rounded.

A bucket of documents leaves one fractional document; these meet again in groups,
level by level, until each source has one left: a reduction tree of bounded groups.
"""
from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pitchframe.llm.common import ROW, WORD, filled_id, restored_id, row_key
from pitchframe.plans.scratch import written

WEIGHTS = (5, 2, 1)
MAX_REPEATS = 3.0
#: Documents of a bucket, and the fan-in of the reduction tree.
GROUP_ROWS = 20_000
SEED = 20_240_601
#: Parts in which rows that are all alike are numbered.
SALTS = 64

_DECIDED = "__src int, __bucket long, doc_id long, row_a long, row_b long, size long, copies int, p double"


def word_sizes(docs: DataFrame) -> DataFrame:
    """``docs`` with their words counted as ``size``; a null text counts 0."""
    return docs.withColumn("size", F.coalesce(F.regexp_count("text", F.lit(WORD)).cast("long"), F.lit(0).cast("long")))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeats: float = MAX_REPEATS) -> DataFrame:
    """source, source_size, documents, target and the source's number ``__src``.

    A target is ``rate * weight``, or ``max_repeats * source_size`` if that is less, with the
    rate at which all targets add up to all sizes: what remains when the excess of capped
    sources is reshared by weight until none is above. One row per source goes through
    the two ordered windows here, never a row per document.
    """
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("documents"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.col("__src") % len(weights) + 1)
    sources = sources.withColumn("__src", F.row_number().over(by_name) - 1).withColumn("__weight", weight)
    sources = sources.withColumn("__most", F.col("source_size") * F.lit(max_repeats))
    by_ratio = Window.orderBy(F.col("__most") / F.col("__weight"), "__src")
    before, rest = by_ratio.rowsBetween(Window.unboundedPreceding, -1), by_ratio.rowsBetween(0, Window.unboundedFollowing)
    whole = Window.partitionBy()
    rate = (F.sum("source_size").over(whole) - F.coalesce(F.sum("__most").over(before), F.lit(0.0))) / F.sum("__weight").over(rest)
    sources = sources.withColumn("__rate", rate)
    # In order of the ratio, sources are capped up to the first whose cap isn't reached;
    # capping more of them only lowers the rate.
    fits = F.when(F.col("__rate") <= F.col("__most") / F.col("__weight"), F.col("__rate"))
    sources = sources.withColumn("__final", F.max(fits).over(whole))
    target = F.least(F.col("__most"), F.coalesce(F.col("__final") * F.col("__weight"), F.col("__most")))
    return sources.select("source", "source_size", "documents", "__src", target.alias("target"))


def round_group(p: np.ndarray, size: np.ndarray, draws: np.ndarray) -> tuple[np.ndarray, int]:
    """Pivotal rounding of expected extra copies ``p`` of documents of ``size`` words.

    Returns the copies, 0 or 1 once decided, and the index of the one still fractional (-1: none).
    """
    p = p.copy()
    pivot = -1
    for i in range(len(p)):
        if not 0.0 < p[i] < 1.0:
            continue
        if pivot < 0:
            pivot = i
            continue
        a, b = pivot, i
        gain = min((1.0 - p[a]) * size[a], p[b] * size[b])  # words a may take from b
        give = min(p[a] * size[a], (1.0 - p[b]) * size[b])
        if draws[i] * (gain + give) < give:
            if (1.0 - p[a]) * size[a] <= p[b] * size[b]:
                p[a], p[b] = 1.0, p[b] - gain / size[b]
            else:
                p[a], p[b] = p[a] + gain / size[a], 0.0
        elif p[a] * size[a] <= (1.0 - p[b]) * size[b]:
            p[a], p[b] = 0.0, p[b] + give / size[b]
        else:
            p[a], p[b] = p[a] - give / size[a], 1.0
        near = np.round(p[[a, b]])
        p[[a, b]] = np.where(np.abs(p[[a, b]] - near) < 1e-12, near, p[[a, b]])
        pivot = a if 0.0 < p[a] < 1.0 else b if 0.0 < p[b] < 1.0 else -1
    return p, pivot


def _round_level(rows: DataFrame, level: int, seed: int, last: bool) -> DataFrame:
    """Decide all but one document of every (source, bucket); ``last`` decides that one too."""

    def decide(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["doc_id", *ROW], kind="stable").reset_index(drop=True)
        key = [seed, level, int(frame["__src"].iloc[0]), int(frame["__bucket"].iloc[0])]
        draws = np.random.Generator(np.random.PCG64(key)).random(len(frame) + 1)
        p, pivot = round_group(frame["p"].to_numpy(), frame["size"].to_numpy(dtype="float64"), draws)
        if last and pivot >= 0:
            p[pivot] = float(draws[-1] < p[pivot])
            pivot = -1
        whole = np.rint(p).astype("int64")
        if pivot >= 0:
            whole[pivot] = 0
        left = np.zeros(len(p))
        if pivot >= 0:
            left[pivot] = p[pivot]
        return frame.assign(copies=frame["copies"].to_numpy() + whole, p=left)

    return rows.groupBy("__src", "__bucket").applyInPandas(decide, _DECIDED)


def mixture(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeats: float = MAX_REPEATS, group_rows: int = GROUP_ROWS, seed: int = SEED) -> DataFrame:
    """doc_id, size, source_size, target, taken, copies and ``ROW`` of every document.

    ``copies`` is how often the mix takes the document, ``taken`` its words. A null or
    empty text has size 0 and takes no words. A null source is a source, the last. Equal
    rows are documents of their own. Reruns agree: draws depend on the seed and on the
    documents of a bucket in order of their ids. No documents give no rows; other
    columns are ignored.
    """
    if group_rows < 2:
        raise ValueError("documents are rounded in pairs: group_rows is 2 at least")
    sized = written(word_sizes(docs).select(filled_id(), *row_key("text", "source"), "source", "size"), "sizes")
    targets = written(source_targets(sized, weights, max_repeats), "targets")
    same = sized["source"].eqNullSafe(targets["source"])
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    # A rounding error above or below a whole number of copies isn't a fraction.
    rate = F.when(F.abs(rate - F.round(rate)) < 1e-12, F.round(rate)).otherwise(rate)
    buckets = F.ceil(F.col("documents") / F.lit(group_rows))
    rows = sized.join(targets, same).select(
        "__src",
        F.pmod(F.xxhash64("doc_id", *ROW, F.lit(seed)), buckets).alias("__bucket"),
        "doc_id",
        *ROW,
        "size",
        F.floor(rate).cast("int").alias("copies"),
        F.when(F.col("size") > 0, rate - F.floor(rate)).otherwise(F.lit(0.0)).alias("p"),
    )
    most = (targets.agg(F.max("documents")).first()[0] or 0) / group_rows
    decided, level = [], 0
    while True:
        last = most <= 1
        done = _round_level(rows, level, seed, last)
        if last:
            decided.append(done)
            break
        done = written(done, "rounded")
        decided.append(done.where("p = 0"))
        rows = done.where("p > 0").withColumn("__bucket", F.floor(F.col("__bucket") / F.lit(group_rows)).cast("long"))
        most, level = most / group_rows, level + 1
    out = decided[0]
    for part in decided[1:]:
        out = out.unionByName(part)
    named = targets.select("__src", "source_size", "target")
    return out.join(named, "__src").select(restored_id(), "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies", *ROW)


def mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeats: float = MAX_REPEATS, group_rows: int = GROUP_ROWS, seed: int = SEED) -> DataFrame:
    """``docs`` with every row as often as the mix takes it; rows it doesn't take go.

    Rows that are alike in id, text and source take the copies of all of them in nearly equal parts.
    Null ids, texts and sources are values like others. No rows give none; all columns of ``docs`` stay.
    """
    plan = mixture(docs, weights, max_repeats, group_rows, seed)
    key = [f"__mix_{c}" for c in ("id", *ROW)]
    # Rows that are alike in id, text and source share out the copies of their kind.
    plan = plan.select(filled_id().alias(key[0]), *[F.col(c).alias(k) for c, k in zip(ROW, key[1:])], "copies")
    kinds = written(plan.groupBy(*key).agg(F.count("*").alias("__mix_rows"), F.sum("copies").alias("__mix_copies")), "copies")
    marked = docs.withColumns(dict(zip(key, [filled_id(), *row_key("text", "source")])))
    taken = marked.join(kinds.where("__mix_copies > 0").hint("merge"), key)
    if kinds.where("__mix_rows > 1 AND __mix_copies > 0").isEmpty():
        return _repeated(taken, F.col("__mix_copies"), docs.columns)
    single = taken.where("__mix_rows = 1").withColumn("__mix_times", F.col("__mix_copies"))
    # Rows of a kind are numbered in salted groups, each starting where those before it end.
    salted = written(taken.where("__mix_rows > 1").withColumn("__mix_salt", F.monotonically_increasing_id() % SALTS), "repeated")
    before = Window.partitionBy(*key).orderBy("__mix_salt").rowsBetween(Window.unboundedPreceding, -1)
    counts = salted.groupBy(*key, "__mix_salt").agg(F.count("*").alias("__mix_n"))
    counts = counts.select(*key, "__mix_salt", F.coalesce(F.sum("__mix_n").over(before), F.lit(0)).alias("__mix_before"))
    nth = F.row_number().over(Window.partitionBy(*key, "__mix_salt").orderBy(*key)) + F.col("__mix_before")
    share = F.floor(F.col("__mix_copies") / F.col("__mix_rows"))
    more = (F.col("__mix_nth") <= F.col("__mix_copies") % F.col("__mix_rows")).cast("long")
    shared = salted.join(counts, [*key, "__mix_salt"]).withColumn("__mix_nth", nth).withColumn("__mix_times", share + more)
    columns = [*docs.columns, "__mix_times"]
    return _repeated(single.select(columns).unionByName(shared.select(columns)), F.col("__mix_times"), docs.columns)


def _repeated(rows: DataFrame, times: Column, columns: list[str]) -> DataFrame:
    """``columns`` of every row, as often as ``times`` says."""
    each = F.explode(F.array_repeat(F.lit(True), times.cast("int"))).alias("__mix_copy")
    return rows.select(*columns, each).select(columns)
