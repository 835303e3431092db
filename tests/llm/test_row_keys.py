"""Rows of one id whose 32-bit hashes are the same are told apart by all operators that join on them."""
import pytest
from pyspark.sql import functions as F

from pitchframe.llm import jaccard, mixing, substrings

SCHEMA = "doc_id long, text string, source string, lang string"


@pytest.fixture(scope="module")
def docs(spark):
    words = [F.format_string(f"w{i}_%d", F.col("id") * 31 + i) for i in range(60)]
    texts = spark.range(150_000).select(F.concat_ws(" ", *words).alias("text"))
    same = texts.withColumn("h", F.hash("text")).groupBy("h").agg(F.sort_array(F.collect_list("text")).alias("t")).where("size(t) > 1").limit(3)
    pairs = [tuple(r["t"][:2]) for r in same.collect()]
    assert pairs
    rows = [(None, t, s, "en") for pair in pairs for t, s in zip(pair, (None, ""))]
    # The first text of each pair is repeated under a larger id, so that spans of it go.
    rows += [(7, pair[0] + " end", "b", "en") for pair in pairs] + [(7, pair[1][:20], "b", "en") for pair in pairs]
    return spark.createDataFrame(rows, SCHEMA)


def test_near_duplicates_keep_all(docs):
    kept = jaccard.one_of_each(docs)
    want = {r["text"] for r in docs.where("doc_id IS NULL OR text NOT LIKE '% end'").collect()}
    assert {r["text"] for r in kept.collect()} == want


def test_spans_go_to_their_text(docs):
    got = {(r["doc_id"], r["n_words"], r["n_removed"]) for r in substrings.remove_repeats(docs).collect()}
    assert {g for g in got if g[0] is None} == {(None, 60, 0)}
    assert (7, 61, 60) in got and all(g[2] in (0, 60) for g in got)


def test_mix_tells_null_from_empty_sources(docs):
    plan = mixing.mixture(docs)
    want = sorted(map(str, plan.select("doc_id", "copies", *mixing.ROW).where("copies > 0").collect()))
    mixed = mixing.mixed(docs)
    assert mixed.columns == docs.columns and want
    keys = mixed.select("doc_id", *[k for k in mixing.row_key("text", "source")]).groupBy("doc_id", *mixing.ROW).agg(F.count("*").cast("int").alias("copies"))
    assert sorted(map(str, keys.select("doc_id", "copies", *mixing.ROW).collect())) == want


def test_repeated_rows_share_their_copies(spark):
    rows = [(1, "one two three", "a", str(i)) for i in range(3_000)] + [(i, "four five", "b", "x") for i in range(500)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(6)
    plan = {r[0]: r[1] for r in mixing.mixture(docs).groupBy("size").agg(F.sum("copies")).collect()}
    mixed = mixing.mixed(docs)
    got = mixed.groupBy("source").agg(F.count("*").alias("n")).collect()
    assert {r["source"]: r["n"] for r in got} == {"a": plan[3], "b": plan[2]}
    # They differ by their last column, and no row is taken twice more often than another.
    times = [r["count"] for r in mixed.where("source = 'a'").groupBy("lang").count().collect()]
    assert max(times) - (min(times) if len(times) == 3_000 else 0) <= 1
