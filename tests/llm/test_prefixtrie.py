import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from pitchframe.llm import prefixtrie
from tests.llm.helpers import SF

SCHEMA = "conv_id long, turn int, role string, text string, path string, depth int, key1 string"


def brute(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(ts)] for c, ts in own.items()}
    members = defaultdict(list)
    for c in own:
        h = zlib.crc32(str(c).encode()) % 4
        path = tuple(own.get(c - c % 20, [])[:h] + own[c][h:])
        for d in range(len(path) + 1):
            members[path[:d]].append((c, d == len(path)))
    out = {p: [min(c for c, _ in m), len(p), None, len(m), 0, 0, 0] for p, m in members.items()}
    for p in out:
        if p:
            out[p][2] = out[p[:-1]][0]
            out[p[:-1]][4] += 1
    for p in out:
        words = len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        for d in range(len(p) + 1):
            out[p[:d]][5] += out[p][4] == 0
            out[p[:d]][6] += (out[p][3] - 1) * words
    for p, m in members.items():
        out[p].append(hashlib.sha256(",".join(str(c) for c, end in sorted(m) if end).encode()).hexdigest())
    return sorted((tuple(r) for r in out.values()), key=lambda r: r[:2])


def check(spark, rows, **options):
    if not isinstance(rows, list):
        rows = [tuple(r) for r in rows.select("conv_id", "turn", "role", "text").collect()]
    table = spark.createDataFrame([(*r, "x", 1, "y") for r in rows], SCHEMA)
    got = sorted((tuple(r) for r in prefixtrie.conversation_trie(table, **options).collect()), key=lambda r: r[:2])
    assert got == brute(rows)
    return got


@pytest.mark.parametrize("options", [{}, {"shard_turns": 60, "chunk_ids": 2}, {"shard_turns": 1}])
def test_conversations_equal_brute_force(spark, options):
    check(spark, spark.read.parquet(f"{SF}/conversations.parquet"), **options)


def test_random_tries_in_small_shards(spark):
    rng = np.random.default_rng(5)
    rows = []
    for c in range(400):
        # A third of all are one and the same; few different turns, so that tries are bushy and deep.
        path = [0] * 6 if c % 3 == 0 else rng.integers(0, 3, rng.integers(1, 9)).tolist()
        rows += [(c, i, "ab"[x % 2], f"turn {x} " * x) for i, x in enumerate(path)]
    for turns in (10, 97, 100_000):
        check(spark, rows, shard_turns=turns, chunk_ids=7)


def test_odd_rows(spark):
    rows = [
        (None, 1, "user", "no conversation"), (1, None, "user", "null turn"), (1, 0, None, None), (1, 0, None, None), (1, 0, "", ""),
        (7, 3, "user", "alone"), (20, 1, "user", ""), (25, 1, "a", "b c"), (26, 1, "", "ab c"), (-5, 1, "user", "below zero"),
        (27, 1, "user", " \t \x0b"), (40, 1, "user", "long " * 50_000), (41, 2, "user", "x"), (43, 2, "user", "x"),
    ]
    rows += [(60, i, "user", str(i % 7)) for i in range(200)] + [(61, i, "user", str(i % 7)) for i in range(200)]
    check(spark, rows)
    check(spark, rows, shard_turns=50)
    check(spark, [])
    # Id 7 borrows from a conversation that isn't there: nothing is left of it.
    assert zlib.crc32(b"7") % 4 and check(spark, [(7, 3, "user", "alone")])[0][:4] == (7, 0, None, 1)


def test_hot_ending(spark):
    rows = spark.range(0, 50_000, 20).select(F.col("id").alias("conv_id"), F.lit(1).alias("turn"), F.lit("user").alias("role"), F.lit("hello").alias("text"))
    got = prefixtrie.conversation_trie(rows.repartition(5), chunk_ids=100).orderBy("depth").collect()
    assert [r["n_convs"] for r in got] == [2_500, 2_500]
    assert got[1]["ends_sha256"] == hashlib.sha256(",".join(map(str, range(0, 50_000, 20))).encode()).hexdigest()


def test_parentheses():
    rng = np.random.default_rng(1)
    for n in (1, 2, 70, 3_000):
        depth, bits = 0, []
        while len(bits) + depth < 2 * n:
            up = depth == 0 or rng.random() < 0.55
            bits.append(up)
            depth += 1 if up else -1
        bits = np.array(bits + [False] * depth)
        stack, want = [], {}
        for i, up in enumerate(bits):
            if up:
                stack.append(i)
            else:
                want[stack.pop()] = i
        opened = np.flatnonzero(bits)
        for block in (2, 7, 64):
            got = prefixtrie.Parentheses(bits, block).find_close(opened)
            assert got.tolist() == [want[i] for i in opened.tolist()]
