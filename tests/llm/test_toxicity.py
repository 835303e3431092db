import math
import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from pitchframe.llm import toxicity
from pitchframe.llm.queries import op12_toxicity
from tests.llm.helpers import documents, none, odd

TABLES = "/root/testdata/sf0.01"


def plain_terms(text):
    out = Counter()
    for word in re.findall(r"[^\W\d_]+", (text or "").lower()):
        out.update([word, *[word[:n] + "-" for n in (4, 5, 6, 7, 8) if n < len(word)]])
    return out


def plain_scores(examples, texts, k=15):
    """The contract of the operator re-stated with dense vectors: examples (id, text, label) by id."""
    bags, y = [plain_terms(t) for _, t, _ in examples], np.array([x for *_, x in examples], dtype=float)
    n, toxic = Counter(t for b in bags for t in b), Counter(t for b, label in zip(bags, y) if label for t in b)
    rows, ones = len(y), y.sum()

    def ratio(t):
        a, b = toxic[t], n[t] - toxic[t]
        cells = [(a, n[t] * ones), (b, n[t] * (rows - ones)), (ones - a, (rows - n[t]) * ones), (rows - ones - b, (rows - n[t]) * (rows - ones))]
        return 2 * sum(o * math.log(o * rows / e) for o, e in cells if o)

    terms = [t for t in n if n[t] >= 3]
    terms = sorted(t for t in terms if ratio(t) >= 2 * math.log(len(terms)))
    at = {t: i for i, t in enumerate(terms)}

    def vector(bag):
        v = np.zeros(len(terms) + 1)
        for t, c in bag.items():
            if t in at:
                v[at[t]] = (1 + math.log(c)) * math.log((rows + 1) / (n[t] + 1))
        return v / (np.linalg.norm(v) or 1)

    dense = np.array([vector(b) for b in bags])

    def vote(v, skip=-1):
        near = sorted((-round(float(s), 12), examples[i][0], i) for i, s in enumerate(dense @ v) if s > 1e-12 and i != skip)[:k]
        w = np.array([s * s for s, *_ in near])
        return (sum(w * y[[i for *_, i in near]]) + 0.1 * y.mean()) / (w.sum() + 0.1) if near else y.mean(), [(e, round(-s, 9)) for s, e, _ in near]

    slope, offset = toxicity.calibration(np.array([vote(dense[i], i)[0] for i in range(rows)]), y)
    out = []
    for text in texts:
        v, near = vote(vector(plain_terms(text)))
        out.append((1 / (1 + math.exp(-(slope * math.log((v + 0.02) / (1.02 - v)) + offset))), near))
    return out


def test_nearest_equals_all_cosines():
    rng = np.random.default_rng(3)
    for examples, n_terms, block in ((0, 5, 4), (1, 3, 4), (300, 40, 8), (300, 6, 64)):
        vectors = []
        for _ in range(examples + 30):
            terms = np.unique(rng.integers(0, n_terms, rng.integers(0, 6)))
            w = rng.integers(1, 4, len(terms)).astype(float)
            vectors.append((terms, w / np.linalg.norm(w)) if len(w) else (terms, w))
        ids = rng.permutation(examples).tolist()
        index = toxicity.build_index([str(t) for t in range(n_terms)], np.ones(n_terms), ids, [0] * examples, vectors[:examples], block)
        dense = np.zeros((len(vectors), n_terms))
        for i, (t, w) in enumerate(vectors):
            dense[i, t] = w
        for q in range(len(vectors)):
            skip = ids[q] if q < examples else None
            want = sorted((-round(float(dense[q] @ dense[i]), 12), ids[i]) for i in range(examples) if ids[i] != skip and dense[q] @ dense[i] > 1e-12)[:5]
            got = [(-s, int(index.ids[e])) for s, e in toxicity.nearest(index, *vectors[q], 5, skip)]
            assert [i for _, i in got] == [i for _, i in want] and np.allclose([s for s, _ in got], [s for s, _ in want], atol=1e-9)


def test_documents_equal_plain_scores(spark):
    docs = spark.read.parquet(f"{TABLES}/documents.parquet")
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{TABLES}/labels.parquet").collect() if zlib.crc32(str(r["doc_id"]).encode()) % 5}
    rows = sorted((r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect())
    want = plain_scores([(i, t, labels[i]) for i, t in rows if i in labels and t is not None], [t for _, t in rows])
    got = sorted(tuple(r) for r in op12_toxicity(spark, TABLES).collect())
    assert np.allclose([r[2] for r in got], [s for s, _ in want], atol=1e-6)
    assert [[(e["doc_id"], round(e["cosine"], 9)) for e in r[4]] for r in got] == [n for _, n in want]
    assert all(r[1] == (zlib.crc32(str(r[0]).encode()) % 5 == 0) and r[3] == int(r[2] >= 0.5) for r in got)


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.1"
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    held = [(labels[r["doc_id"]], r["predicted"], r["score"]) for r in op12_toxicity(spark, folder).where("held_out").collect() if r["doc_id"] in labels]
    assert np.mean([a == b for a, b, _ in held]) > 0.96
    # Part of the labels is noise: toxic ones are found, and few others.
    assert np.mean([b for a, b, _ in held if a]) > 0.8 and np.mean([b for a, b, _ in held if not a]) < 0.02
    assert abs(np.mean([s for *_, s in held]) - np.mean([a for a, *_ in held])) < 0.03


def test_odd_and_no_rows(spark):
    labels = spark.createDataFrame([(1, 1, "x"), (1, 0, "x"), (2, 0, "x"), (3, 1, "x"), (None, 1, "x"), (6, None, "x"), (99, 1, "x")], "doc_id long, toxic int, score string")
    docs = odd(spark).withColumns({c: F.lit("x") for c in ("score", "evidence", "toxic", "terms")})
    for known in (labels, labels.limit(0)):
        index = toxicity.fit_toxicity(docs, known)
        got = toxicity.toxicity_scores(docs, index).collect()
        assert sorted(str(r["doc_id"]) for r in got) == sorted(str(r["doc_id"]) for r in docs.collect())
        assert all(0 <= r["score"] <= 1 for r in got)
        assert toxicity.toxicity_scores(none(spark), index).collect() == []
    assert len(toxicity.fit_toxicity(none(spark), labels).labels) == 0


def test_long_texts_are_read_whole():
    text = ("Wort-und " * 300_000) + "a" * 1_200_000 + " Ende ende"
    assert toxicity.word_counts(text) == Counter({"wort": 300_000, "und": 300_000, "a" * 1_200_000: 1, "ende": 2})


def test_a_hot_id_is_one_example(spark):
    docs = documents(spark).select("doc_id", "text").unionByName(spark.range(2_000).select(F.lit(1).cast("long").alias("doc_id"), F.concat(F.lit("word "), F.col("id").cast("string")).alias("text")))
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, toxic int")
    assert toxicity._chosen(docs, labels, 10).count() == 2
