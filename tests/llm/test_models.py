"""Language profiles and quality trees: held-out accuracy, and plain re-statements of their cores."""
import tracemalloc
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from pitchframe.llm import langid, quality
from pitchframe.llm.queries import QUERIES
from tests.llm.helpers import SF, documents, none, odd


def test_vectors_are_bound_and_bundled_letters():
    vectors, known = langid.document_vectors(["Ab", "...", "", "ab  ab"], 64)
    letter = lambda c: langid.letter_vector(ord(c) if c != " " else 0, 64, langid.SEED)
    gram = lambda g: np.roll(letter(g[0]), 2) * np.roll(letter(g[1]), 1) * letter(g[2])
    assert known.tolist() == [True, False, False, True]
    assert np.allclose(vectors[0], gram("ab ") + gram(" ab"))
    assert np.allclose(vectors[3], gram("ab ") * 2 + gram("b a") + gram(" ab") * 2)
    assert not vectors[1].any() and not vectors[2].any()


def test_languages_of_held_out_documents(spark):
    lang = {r["doc_id"]: r["lang"] for r in documents(spark).collect()}
    rows = QUERIES["op1_language_id"](spark, SF).collect()
    assert len(rows) == len(lang)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1 for r in rows)
    held = [r for r in rows if r["held_out"] and lang[r["doc_id"]] is not None]
    assert np.mean([r["lang_pred"] == lang[r["doc_id"]] for r in held]) > 0.9


def test_language_of_odd_rows(spark):
    docs = odd(spark)
    profiles = langid.language_profiles(docs)
    got = sorted((str(r["doc_id"]), r["lang_pred"]) for r in langid.identify(docs, profiles).collect())
    assert [x for x in got if x[0] in "34567"] == [("3", "und"), ("4", "und"), ("5", "und"), ("6", "de"), ("7", "und")]
    assert set(profiles) == {"en", "de"}  # the only French texts have no letter
    assert len(got) == docs.count()
    kept = langid.with_language(docs, profiles)
    assert kept.schema == docs.schema
    assert sorted(map(str, kept.collect())) == sorted(str(r) for r in docs.collect() if str(r["doc_id"]) not in ("3", "4", "5", "7"))
    assert {r["lang_pred"] for r in langid.identify(docs, {}).collect()} == {"und"}
    assert langid.language_profiles(none(spark)) == {} and langid.identify(none(spark), profiles).collect() == []


@pytest.mark.parametrize("parts", [1, 4, 8])
def test_tasks_without_a_letter(spark, parts):
    rows = [(i, "123 !", "en") for i in range(8)] + [(8, "some words", "de")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(parts)
    assert set(langid.language_profiles(docs)) == {"de"}
    assert langid.language_profiles(docs.where("doc_id < 8")) == {}


def test_short_texts_take_little_memory():
    tracemalloc.start()
    texts = [f"{i:05d}".translate(str.maketrans("0123456789", "abcdefghij")) + chr(0x4E00 + i % 9_000) + "abcd" for i in range(20_000)]
    vectors, known = langid.document_vectors(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert known.all() and peak < 300_000_000
    assert (vectors[:3] == langid.document_vectors(texts[:3])[0]).all()


def test_profiles_are_bounded_and_repeatable(spark):
    docs = documents(spark)
    few = langid.language_profiles(docs, per_language=5)
    assert few.keys() == langid.language_profiles(docs).keys()
    again = langid.language_profiles(docs.repartition(6), per_language=5)
    assert all(np.allclose(few[k], again[k]) for k in few)


def test_quality_of_held_out_documents(spark):
    larger = SF.replace("sf0.001", "sf0.01")  # 80 labels are too few to learn from
    label = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{larger}/labels.parquet").collect()}
    rows = QUERIES["op5_quality_trees"](spark, larger).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and r["predicted"] == (r["score"] >= 0.3) for r in rows)
    held = [(r["predicted"], label[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in label]
    assert held and np.mean([p == y for p, y in held]) > 0.95


def test_trees_learn_and_traverse():
    rng = np.random.default_rng(0)
    x = rng.random((3000, len(quality.STATISTICS)))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.3)).astype(float)
    trees = quality.fit_trees(x, y)
    assert ((trees.score(x) > 0.5) == y).mean() > 0.97
    bins = trees.binned(x[:50])
    for row, total in zip(bins, trees.raw_score(bins)):
        plain = trees.base
        for feature, cut, value in zip(trees.feature, trees.cut, trees.value):
            node = 0
            while feature[node] >= 0:
                node = 2 * node + 1 + (row[feature[node]] > cut[node])
            plain += value[node]
        assert abs(plain - total) < 1e-9


def test_quality_of_odd_rows(spark):
    docs = odd(spark)
    labels = spark.createDataFrame([(1, 1), (7, 0), (None, 1), (2, None), (1, 1)], "doc_id long, quality int")
    trees = quality.fit_quality(docs, labels)
    scored = quality.quality_scores(docs, trees).collect()
    assert len(scored) == docs.count() and all(0 <= r["score"] <= 1 for r in scored)
    constant = quality.fit_quality(docs, labels.limit(0))
    assert {r["score"] for r in quality.quality_scores(docs, constant).collect()} == {0.5}
    assert quality.quality_scores(none(spark), trees).collect() == []
    assert len(quality.statistics("")) == len(quality.statistics("a b.\nc")) == len(quality.STATISTICS)


def test_fit_is_bounded(spark):
    labels = spark.range(100).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("quality"))
    docs = spark.range(100).select(F.col("id").alias("doc_id"), F.lit("some text").alias("text"))
    quality.fit_quality(docs, labels, fit_rows=10)
