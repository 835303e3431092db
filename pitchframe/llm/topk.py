"""Exact top-k by inner product: exhaustive term-at-a-time accumulation in blocks.

Vectors are rows of weighted terms (a component that is not zero). A block of
candidates keeps, per term, the postings of that term. Every query of a block
walks its terms and adds ``query weight x posting weight`` into a dense array with
one score per candidate; the block's best k are cut out of that array by
partition selection, and the few winners of all blocks are merged.
"""
from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pitchframe.plans.scratch import written

#: Rows of a block: postings and scores of one block pair stay in a task's memory.
CANDIDATE_BLOCK = 4096
QUERY_BLOCK = 16_384
_HITS = "query_id long, vec_id long, score long"


def scaled_components(vector: Column, scale: int) -> Column:
    """``floor(scale * x)`` of every component, taken as a double; saturates at 64 bits."""
    return F.transform(vector, lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("long"))


def usable(vector: Column) -> Column:
    """Neither null nor with a component that is null or not finite."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(vector.isNotNull() & finite, F.lit(False))


def best(scores: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k highest scores; of equal ones the first."""
    if len(scores) <= k:
        return np.arange(len(scores))
    kth = np.partition(scores, len(scores) - k)[len(scores) - k]
    above = np.flatnonzero(scores > kth)
    return np.concatenate([above, np.flatnonzero(scores == kth)[: k - len(above)]])


def _postings(vectors: pd.Series) -> list[tuple[slice | np.ndarray, np.ndarray]]:
    """Per term the candidates that have it and their weights."""
    lengths = np.fromiter((len(v) for v in vectors), dtype="int64", count=len(vectors))
    dense = np.zeros((len(vectors), int(lengths.max(initial=0))), dtype="int64")
    for row, vector in enumerate(vectors):
        dense[row, : len(vector)] = vector
    out = []
    for term in range(dense.shape[1]):
        has = np.flatnonzero(dense[:, term])
        everywhere = len(has) == len(dense)
        out.append((slice(None) if everywhere else has, np.ascontiguousarray(dense[has, term])))
    return out


def _score_block(queries: pd.DataFrame, candidates: pd.DataFrame, k: int) -> pd.DataFrame:
    if queries.empty or candidates.empty:
        return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}, dtype="int64")
    candidates = candidates.sort_values("vec_id", kind="stable")
    ids = candidates["vec_id"].to_numpy(dtype="int64")
    postings = _postings(candidates["vector"])
    scores = np.zeros(len(ids), dtype="int64")
    hits = []
    for query_id, vector in zip(queries["vec_id"], queries["vector"]):
        scores[:] = 0
        for term, weight in enumerate(vector[: len(postings)]):
            if weight:
                where, weights = postings[term]
                scores[where] += weight * weights
        lo, hi = np.searchsorted(ids, query_id), np.searchsorted(ids, query_id, side="right")
        others = scores if lo == hi else np.delete(scores, slice(lo, hi))
        found = best(others, k)
        found_ids = ids[np.where(found >= lo, found + (hi - lo), found)]
        hits.append((np.full(len(found), query_id), found_ids, others[found]))
    columns = [np.concatenate(c) for c in zip(*hits)]
    return pd.DataFrame(dict(zip(["query_id", "vec_id", "score"], columns)))


def _blocks(n: int) -> Column:
    return F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, scale: int = 256, candidate_block: int = CANDIDATE_BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: the k best candidates of each query.

    A query's own row, any row with its ``vec_id``, is no candidate. Ties go to the
    smaller ``vec_id``. Vectors that are null or hold a null, NaN or infinite component,
    and rows without ``vec_id``, take no part. An empty vector scores 0; vectors of
    different lengths agree on 0 for the terms one of them lacks. A repeated
    candidate row counts once per row, a repeated query row once. Scores are 64-bit
    integers. Fewer candidates than k give fewer rows; no rows give none.
    """
    kept = vectors.where(usable(F.col("embedding")) & F.col("vec_id").isNotNull())
    scaled = kept.select(F.col("vec_id").cast("long"), is_query.alias("__query"), scaled_components(F.col("embedding"), scale).alias("vector"))
    scaled = written(scaled, "scaled")
    n, q = scaled.agg(F.count("*"), F.count(F.when(F.col("__query"), 1))).first()
    cbs, qbs = max(1, -(-n // candidate_block)), max(1, -(-q // query_block))
    salt = F.xxhash64("vec_id")
    candidates = scaled.select("vec_id", "vector", F.pmod(salt, F.lit(cbs)).alias("cb"), _blocks(qbs).alias("qb"))
    queries = scaled.where("__query").dropDuplicates(["vec_id"])
    queries = queries.select("vec_id", "vector", _blocks(cbs).alias("cb"), F.pmod(salt, F.lit(qbs)).alias("qb"))

    def score(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        return _score_block(left, right, k)

    hits = queries.groupBy("qb", "cb").cogroup(candidates.groupBy("qb", "cb")).applyInPandas(score, _HITS)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
