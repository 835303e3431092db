import hashlib
import random

import numpy as np

from pitchframe.llm import substrings
from tests.llm.helpers import documents, none, odd, texts


def brute(rows, n):
    first = {}
    for d, t in rows:
        w = t.encode().split()
        for s in range(len(w) - n + 1):
            key = tuple(w[s : s + n])
            if key not in first or (first[key] is not None and (d is None or d < first[key])):
                first[key] = d
    out = []
    for d, t in rows:
        w = t.encode().split()
        gone = [False] * len(w)
        for s in range(len(w) - n + 1):
            f = first[tuple(w[s : s + n])]
            if d is not None and (f is None or f < d):
                gone[s : s + n] = [True] * n
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        out.append((d, len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def result(docs, **options):
    return sorted((tuple(r)[:4] for r in substrings.remove_repeats(docs, **options).collect()), key=str)


def test_documents(spark):
    docs = documents(spark)
    assert result(docs) == brute(texts(docs), 50)


def test_planted_passages_and_few_words(spark):
    rng = random.Random(3)
    shared = [[rng.choice("abcdefgh") for _ in range(rng.randint(3, 60))] for _ in range(6)]
    rows = []
    for d in range(60):
        words = []
        for _ in range(rng.randint(0, 5)):
            words += rng.choice(shared) if rng.random() < 0.7 else [rng.choice("xyz") for _ in range(rng.randint(1, 30))]
        rows.append((d // 2, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for n, anchor in ((6, 3), (10, 4), (12, 12)):
        assert result(docs, min_words=n, anchor_words=anchor) == brute(texts(docs), n)


def test_odd_rows(spark):
    docs = odd(spark)
    assert result(docs) == brute(texts(docs), 50)
    assert result(docs, min_words=3, anchor_words=2) == brute(texts(docs), 3)
    assert substrings.remove_repeats(none(spark)).collect() == []


def test_winnow_takes_the_rightmost_of_the_smallest():
    rng = np.random.default_rng(1)
    for width in (1, 2, 5, 31):
        grams = (rng.integers(0, 4, 200).astype("uint64") << np.uint64(30))
        got = substrings.winnow(grams, width)
        want = [s + max(i for i in range(width) if grams[s + i] == grams[s : s + width].min()) for s in range(200 - width + 1)]
        assert got.tolist() == want
