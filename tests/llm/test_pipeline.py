import random
from functools import partial

import corpus_pipeline
from tests.llm import test_jaccard
from tests.llm.helpers import SF, none, odd, texts

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def stages_of(spark, docs):
    from pitchframe.plans.scratch import written

    out = []
    for _, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, SF), "stage")
        out.append(docs)
    return out


def test_stages_keep_the_columns_and_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    known, single, clean, mixed, packed = stages_of(spark, docs)
    assert all(d.columns == COLUMNS for d in (known, single, clean, mixed))
    assert known.count() == docs.where("text rlike '\\\\p{L}'").count()
    assert 0 < single.count() < known.count()
    assert clean.count() == single.count()
    assert clean.where("text rlike '@[a-z]+\\\\.(com|org)'").count() == 0
    pieces = packed.groupBy("doc_id").count().count()
    assert pieces == mixed.select("doc_id").distinct().count()


def test_odd_and_no_rows(spark):
    known, single, clean, mixed, packed = stages_of(spark, odd(spark).select(COLUMNS))
    assert sorted(str(r["doc_id"]) for r in single.collect()) == ["1", "1", "6", "8", "None"]
    assert packed.count() > 0
    assert stages_of(spark, none(spark).select(COLUMNS))[-1].count() == 0


def test_near_duplicates_go_from_80_percent_on(spark, monkeypatch):
    rng, rows = random.Random(5), []
    for family in range(6):
        words = [f"w{family}_{rng.randint(0, 5000)}" for _ in range(rng.choice([30, 200, 900]))]
        for extra in (0.0, 0.12, 0.2, 0.24, 0.3):  # the longer copy holds the shorter one
            rows.append((len(rows), " ".join(words + [f"x{len(rows)}_{i}" for i in range(int(extra * len(words)))])))
        for gap in (20, 50, 90):  # one word in so many is another one
            rows.append((len(rows), " ".join(f"y{len(rows)}_{i}" if i % gap == 7 else w for i, w in enumerate(words))))
    docs = spark.createDataFrame([(d, t, "en", "a", len(t)) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    monkeypatch.setattr(test_jaccard, "shingles", partial(test_jaccard.shingles, n=5))
    want = {low for _, _, low in test_jaccard.brute(texts(docs), 80)}
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, SF)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == want
    assert len(want) < len({low for _, _, low in test_jaccard.brute(texts(docs), 90)})
