import numpy as np
from pyspark.sql import functions as F

from pitchframe.llm import topk
from tests.llm.helpers import SF


def query():
    return F.col("vec_id") % 50 == 0


def brute(rows, k=5):
    ok = [(i, [int(np.floor(256 * float(x))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q, a in {i: v for i, v in ok if i % 50 == 0}.items():
        scores = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in ok if i != q)[:k]
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scores)]
    return sorted(out)


def test_vectors_in_blocks(spark):
    vectors = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"]) for r in vectors.collect()]
    for sizes in ({}, {"candidate_block": 37, "query_block": 3}):
        assert sorted(map(tuple, topk.top_k(vectors, query(), **sizes).collect())) == brute(rows)


def test_odd_vectors(spark):
    inf = float("inf")
    rows = [(0, [1.0, 0.0]), (50, [0.5, -0.25]), (1, [1.0, 1.0]), (2, [1.0, 1.0]), (3, None), (4, [None, 1.0]), (5, [float("nan"), 1.0]), (6, [inf, 1.0]), (7, []), (8, [0.1]), (None, [1.0, 1.0]), (9, [1.0, 0.0, 5.0]), (100, None)]
    vectors = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, score int")
    rows = [(r["vec_id"], r["embedding"]) for r in vectors.collect()]
    assert sorted(map(tuple, topk.top_k(vectors, query()).collect())) == brute(rows)
    assert topk.top_k(vectors.limit(0), query()).collect() == []
    assert topk.top_k(vectors.where("vec_id = 0"), query()).collect() == []
