import random
from collections import defaultdict

import numpy as np
import pytest

from pitchframe.llm import jaccard
from tests.llm.helpers import documents, none, odd, texts


def shingles(text, n=3):
    w = text.encode().lower().split()
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def brute(rows, percent=90):
    sets = [shingles(t) for _, t in rows]
    up = list(range(len(rows)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                a, b = sorted((top(i), top(j)))
                up[b] = a
    low = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        low[top(i)].append(d)
    least = {k: None if None in v else min(v) for k, v in low.items()}
    return sorted(((d, len(sets[i]), least[top(i)]) for i, (d, _) in enumerate(rows)), key=str)


def result(docs, **options):
    return sorted(map(tuple, jaccard.near_duplicates(docs, **options).collect()), key=str)


def test_documents(spark):
    docs = documents(spark)
    assert result(docs) == brute(texts(docs))


def chains(seed):
    """Families of texts around the threshold, linked in chains rather than to one centre."""
    rng, rows = random.Random(seed), []
    for family in range(4):
        words = [f"w{family}_{rng.randint(0, 400)}" for _ in range(rng.choice([12, 40, 90, 300]))]
        for _ in range(14):
            words = list(words)
            for _ in range(rng.choice([0, 1, 1, 2, 4])):
                words[rng.randrange(len(words))] = f"n{rng.randint(0, 9999)}"
            rows.append((rng.randint(0, 500), " ".join(words)))
    return rows


@pytest.mark.parametrize("parts,different", [(2, 1), (3, 1), (4, 2), (1, 0)])
def test_chains_of_links(spark, parts, different):
    docs = spark.createDataFrame(chains(parts), "doc_id long, text string")
    assert result(docs, parts=parts, different=different) == brute(texts(docs))


def test_odd_rows(spark):
    docs = odd(spark)
    assert result(docs) == brute(texts(docs))
    assert result(none(spark)) == []
    kept = jaccard.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == sorted([1, 1, 3, 4, 5, 6, 7, 8, None], key=str)


@pytest.mark.parametrize("size", [1, 2, 9, 10, 19, 60, 700, 5000])
def test_like_sets_share_a_signature(size):
    rng = np.random.default_rng(size)
    for _ in range(20):
        a = np.unique(rng.integers(0, 2**63, size, dtype="uint64"))
        drop = rng.integers(0, max(1, size // 10 + 1))
        add = rng.integers(0, max(1, size // 19 + 1))
        b = np.unique(np.concatenate([rng.permutation(a)[drop:], rng.integers(0, 2**63, add, dtype="uint64")]))
        if len(b) and jaccard.alike(a, b):
            assert np.intersect1d(jaccard.signatures(a), jaccard.signatures(b)).size


def test_components_reach_the_smallest(spark):
    edges = [(i, i + 1) for i in range(1, 30)] + [(100, 90), (101, 90), (101, 80)]
    node = "struct<doc_id:long,row:int>"
    links = spark.createDataFrame([((min(e), 0), (max(e), 0)) for e in edges], f"lead {node}, node {node}")
    got = {r["node"]["doc_id"]: r["comp"]["doc_id"] for r in jaccard.components(links).collect()}
    assert got == {i: 1 for i in range(2, 31)} | {90: 80, 100: 80, 101: 80}


@pytest.mark.parametrize("size", [100_000, 713_910, 2_000_000])
@pytest.mark.parametrize("percent,parts,different", [(90, 2, 1), (80, 2, 1), (80, 1, 0)])
def test_large_sets_need_few_splittings(monkeypatch, size, percent, parts, different):
    rounds, plain = [], jaccard._enumerate

    def counted(*args):
        rounds.append(args)
        assert len(rounds) <= 6
        return plain(*args)

    monkeypatch.setattr(jaccard, "_enumerate", counted)
    rng = np.random.default_rng(size)
    a = np.unique(rng.integers(0, 2**63, size, dtype="uint64"))
    gone = size * (100 - percent) // 100 - 10
    b = np.sort(rng.permutation(a)[gone:])
    assert jaccard.alike(a, b, percent)
    found = []
    for shingles in (a, b):
        rounds.clear()
        found.append(jaccard.signatures(shingles, percent, parts, different))
        bands = len(jaccard.band_limits(size, percent))
        assert len(found[-1]) <= (0.4 if percent == 90 else 1.6) * bands * size
    assert np.intersect1d(*found).size


@pytest.mark.parametrize("percent,parts,different,rounds", [(80, 1, 0, 6), (80, 2, 1, 6), (80, 4, 3, 6), (60, 2, 1, 6), (90, 2, 1, 0), (80, 1, 0, 0)])
def test_like_sets_meet_at_every_similarity(monkeypatch, percent, parts, different, rounds):
    monkeypatch.setattr(jaccard, "ROUNDS", rounds)
    rng, checked = np.random.default_rng(percent + parts), 0
    for _ in range(400):
        size = int(rng.choice([1, 3, 5, 7, 9, 12, 20, 45, 130, 900]))
        a = np.unique(rng.integers(0, 2**63, size, dtype="uint64"))
        lost = rng.integers(0, size * (100 - percent) // 100 + 1)
        new = rng.integers(0, size * (100 - percent) // 200 + 2)
        b = np.unique(np.concatenate([rng.permutation(a)[lost:], rng.integers(0, 2**63, new, dtype="uint64")]))
        if jaccard.alike(a, b, percent):
            checked += 1
            assert np.intersect1d(jaccard.signatures(a, percent, parts, different), jaccard.signatures(b, percent, parts, different)).size
    assert checked > 100


def test_alike_texts_whose_leader_is_unlike_both(spark):
    """Texts that meet in a common passage, led by one that sizes and sketches rule out at once."""
    rng = np.random.default_rng(8)
    passage = [f"p{i}" for i in range(60)]
    rows = [(0, " ".join(passage + [f"lead{i}" for i in range(70)]))]
    for family in range(1, 6):
        words = passage + [f"f{family}_{i}" for i in range(60)]
        for copy in range(4):
            changed = list(words)
            changed[int(rng.integers(60, 120))] = f"c{family}_{copy}"
            rows.append((len(rows), " ".join(changed)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute(texts(docs))
    assert len({low for _, _, low in want}) > 2
    got = sorted(map(tuple, jaccard.near_duplicates(docs).collect()))
    assert got == sorted(want)


def test_long_texts_that_share_a_passage_do_not_move(spark, monkeypatch):
    """Where sets may differ in more elements than the short sketch tells, the fine one rules them out."""
    rng, moved, verify = random.Random(3), [], jaccard._linked
    text = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    passage = text(900)
    rows = [(i, " ".join(text(2100) + passage)) for i in range(6)]
    rows.append((9, rows[0][1] + " more"))

    def counted(pairs, *rest):
        moved.append(pairs.count())
        return verify(pairs, *rest)

    monkeypatch.setattr(jaccard, "_linked", counted)
    assert result(spark.createDataFrame(rows, "doc_id long, text string"), shingle_words=5, percent=80, parts=1, different=0) == [
        (i, 2996 + (i == 9), 0 if i == 9 else i) for i in [0, 1, 2, 3, 4, 5, 9]
    ]
    assert sum(moved) == 1


@pytest.mark.parametrize("n,other", [(600, 700), (1000, 1200), (3000, 3500), (4096, 4097)])
def test_fine_sketches_differ_in_no_more_bits_than_the_sets(n, other):
    rng = np.random.default_rng(n)
    a = np.unique(rng.integers(0, 1 << 63, n, dtype="uint64"))
    for shared in (0, n // 2, n - 3, n):
        b = np.unique(np.concatenate([a[:shared], rng.integers(0, 1 << 63, other - shared, dtype="uint64")]))
        far = jaccard.sketch_distance(jaccard.fine_sketch(a), jaccard.fine_sketch(b))
        assert far <= len(np.setxor1d(a, b)) and far % 2 == len(np.setxor1d(a, b)) % 2
    assert far < 200 or other - n > 100
    assert jaccard.sketch_distance(jaccard.fine_sketch(a), jaccard.fine_sketch(a[:400])) == 0
