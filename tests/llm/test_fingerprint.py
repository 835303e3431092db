import hashlib

from pitchframe.llm import fingerprint
from tests.llm.helpers import documents, none, odd, texts


def followed(rows):
    return [(d, t, rows[(i + 1) % len(rows)][1]) for i, (d, t) in enumerate(rows)]


def check(docs):
    got = fingerprint.fingerprints(docs).collect()
    want = []
    for d, t, n in followed(texts(docs)):
        half = len(t) // 2
        edited = t[: len(t) - half] + n[:half]
        want.append((d, len(t), hashlib.sha256(edited.encode()).hexdigest()))
    assert sorted(map(str, want)) == sorted(str(tuple(r)[:3]) for r in got)
    for r in got:
        assert 0.0 <= r["near_edited"] <= 1.0 and 0.0 <= r["near_next"] <= 1.0
    prints = {}
    for d, t in texts(docs):
        prints.setdefault(d, set()).add(t)
    return got


def test_documents_in_blocks(spark, monkeypatch):
    docs = documents(spark)
    one = sorted(map(str, check(docs)))
    monkeypatch.setattr(fingerprint, "BLOCK_ROWS", 1)
    assert sorted(map(str, check(docs.repartition(7)))) == one


def test_ids_dense_in_one_stretch_fill_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(fingerprint, "BLOCK_ROWS", 4)
    # Most ids lie in a ten-thousandth of the space between their neighbours.
    ids = [i * 10**9 for i in range(200)] + [50 * 10**9 + i for i in range(1, 3_000)]
    docs = spark.createDataFrame([(i, f"text {i}") for i in ids], "doc_id long, text string")
    check(docs)
    place, _ = fingerprint._blocks(docs.select("doc_id"))
    sizes = [r["count"] for r in place(docs).groupBy("block").count().collect()]
    assert max(sizes) < 10 * sorted(sizes)[len(sizes) // 2]


def test_odd_rows(spark):
    docs = odd(spark)
    got = check(docs)
    same = [r["fingerprint"] for r in got if r["n_chars"] == 53]
    assert len(same) == 3 and len(set(same)) == 1
    assert all(r["fingerprint"] == "" for r in got if r["doc_id"] in (3, 4, 5))
    assert fingerprint.fingerprints(none(spark)).collect() == []
    (alone,) = fingerprint.fingerprints(docs.where("doc_id = 7")).collect()
    assert alone["near_next"] == 1.0


def winnowed(text, k, w):
    """Positions that plain winnowing keeps, for hashes read off the fingerprint of all grams."""
    grams = text
    return {s + max(i for i in range(min(w, len(grams))) if grams[s + i] == min(grams[s : s + w])) for s in range(max(1, len(grams) - w + 1))}


def test_rightmost_smallest_gram_of_every_window(spark):
    words = " ".join("abracadabra simsalabim hokus pokus abracadabra simsalabim hokus pokus eins zwei drei vier fünf sechs sieben acht".split())
    docs = spark.createDataFrame([(1, words)], "doc_id long, text string")
    split = lambda f: [(int(p), int(h, 16)) for p, h in (x.split(":") for x in f.split(","))]
    every = dict(split(fingerprint.fingerprints(docs, 4, 1).first()["fingerprint"]))
    kept = split(fingerprint.fingerprints(docs, 4, 8).first()["fingerprint"])
    grams = [every[i] for i in range(len(every))]
    assert len(grams) == len(words.split()) - 3
    assert {p for p, _ in kept} == winnowed(grams, 4, 8)
    assert all(every[p] == h for p, h in kept)


def test_shared_run_is_found(spark):
    run = " ".join(f"r{i}" for i in range(fingerprint.GRAM_WORDS + fingerprint.WINDOW_GRAMS - 1))
    rows = [(1, f"a b c d e f g {run} h i j k l m n"), (2, f"z {run} y x w v u t s")]
    got = fingerprint.fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    hashes = [{x.split(":")[1] for x in r["fingerprint"].split(",")} for r in got]
    assert hashes[0] & hashes[1]
