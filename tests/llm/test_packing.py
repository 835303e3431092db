import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from pitchframe.llm import packing
from tests.llm.helpers import documents, none, odd

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.mark.parametrize("seed", range(8))
def test_plan_places_every_piece_without_gaps(seed):
    rng = random.Random(seed)
    capacity = rng.choice([7, 30, 100, 2048])
    counts = {rng.randint(1, capacity): rng.randint(1, 40) for _ in range(rng.randint(0, 60))}
    at, seen = defaultdict(list), Counter()
    for length, a, b, first, per, offset in packing.packing_plan(counts, capacity):
        assert a == seen[length]
        seen[length] = b
        for r in range(b - a):
            at[first + r // per].append((offset + r % per * length, length))
    assert dict(seen) == counts
    assert sorted(at) == list(range(len(at)))
    for places in at.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= capacity


def test_plan_pairs_large_pieces_and_fills_up():
    assert len({r[3] for r in packing.packing_plan({60: 1, 50: 2, 40: 1}, 100)}) == 2
    small = {1500: 10, 1000: 20, 700: 5, 300: 40, 40: 100}
    sequences = max(f + -(-(b - a) // p) for _, a, b, f, p, _ in packing.packing_plan(small))
    assert sequences <= -(-sum(k * v for k, v in small.items()) // 2048) + 1


def test_ids_equal_those_of_whole_texts():
    awkward = ["a<|endoftext|>b <|ENDOFTEXT|>", "H̱ ẖ H̱x", "don't I'LL it's, 's.", "12,345.67 a1b2!!?", " a b\x1cc", "İstanbul ΑΣ ΑΣ.", "", "é É.", "x|<|y", "日本語 テスト。", "word's.' 'tis ...x"]
    plain = Tokenizer.from_file(PATH)
    for text, ids in zip(awkward, packing.word_ids(PATH)(awkward)):
        assert np.frombuffer(ids, "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids


def test_ids_of_endings_that_start_in_the_stem():
    words = ["(foo).", '"x"!', "don'.", "f();", 'foo".', "foo):", "x];", "ab_.", "s'.", "a=|", "-,", "İ.", "A̱.", "ẖ,", "é.", "x².", "ⓐ.", "日本。.", "<|endoftext|>.", '"3fdf5a"###', "...", "it's.", "12,"]
    plain = Tokenizer.from_file(PATH)
    for text in [*words, " ".join(words)]:
        got = packing.WordIds(PATH)([text])[0]
        assert np.frombuffer(got, "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids, text


def check_packed(docs, capacity):
    plain, want = Tokenizer.from_file(PATH), Counter()
    for r in docs.collect():
        ids = [*plain.encode(r["text"] or "", add_special_tokens=False).ids, 0]
        for piece, start in enumerate(range(0, len(ids), capacity)):
            part = np.asarray(ids[start : start + capacity], dtype="<u4")
            want[(r["doc_id"], piece, start, len(part), zlib.crc32(part.tobytes()))] += 1
    rows = packing.pack(docs, PATH, capacity).collect()
    assert Counter(tuple(r)[:5] for r in rows) == want
    at = defaultdict(list)
    for r in rows:
        at[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in at.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= capacity
    return len(at), sum(k[3] * n for k, n in want.items())


@pytest.mark.parametrize("capacity", [2048, 16])
def test_odd_rows(spark, capacity):
    check_packed(odd(spark), capacity)
    assert packing.pack(none(spark), PATH).collect() == []


def test_documents_fill_sequences(spark, monkeypatch):
    monkeypatch.setattr(packing, "ROWS_PER_BUCKET", 1)
    sequences, tokens = check_packed(documents(spark), 2048)
    assert sequences <= -(-tokens // 2048) * 1.01 + 1
