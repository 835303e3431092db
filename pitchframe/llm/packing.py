"""Best-fit packing of tokenised documents into sequences of fixed capacity.

Lengths are integers up to the capacity, so a packing is a plan over the *histogram*
of lengths: at most ``capacity`` counters, whatever the number of documents. The
plan is made once, on the driver, from those counters; documents then find their
place by their rank within their length. No task and no driver step holds documents.

Method (large-item matching): pieces above a third of the capacity go at most two to
a sequence, the largest left being matched with the largest left that fits beside it.
Smaller pieces then fill the fullest sequence they fit in, largest first.
"""
from __future__ import annotations

import os
import unicodedata
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import lru_cache
from itertools import filterfalse

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pitchframe.llm.common import filled_id, restored_id, text_slices
from pitchframe.plans.scratch import written

CAPACITY = 2048
SEPARATOR_ID = 0
#: Different words and stems whose ids a Python process remembers.
REMEMBERED = 200_000, 500_000
#: Punctuation that the vocabulary parts from the word before it.
ENDINGS = b".,!?;:%&$#*|"
#: Rows of one length that are numbered together.
ROWS_PER_BUCKET = 200_000
TEXT_BATCH = 1_000_000

_PIECES = "doc_id long, piece int, start long, length int, ids_crc32 long"
_PLAN = "length int, rank_from long, rank_to long, seq_from long, per_seq int, offset_from int"


class WordIds:
    """Token ids of texts as little-endian unsigned 32-bit integers.

    The vocabulary drops white space, ignores case and never joins over white space, so a
    text's ids are those of its words, and a word's are those of its stem and of the
    punctuation that ends it, if the stem ends in a letter or digit; else the punctuation
    belongs to a run that starts in the stem, and the word stays whole. Each different stem
    is tokenised once per Python process, as far as ``REMEMBERED`` goes; what isn't
    remembered is tokenised again.
    """

    def __init__(self, tokenizer_path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self._tokenizer = Tokenizer.from_file(tokenizer_path)
        vocabulary = self._tokenizer.get_vocab(with_added_tokens=True)
        self._ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self._ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self._words: dict[bytes, bytes] = {}
        self._stems: dict[bytes, bytes] = {}

    def _encode_each(self, words: list[bytes]) -> dict[bytes, bytes]:
        found = self._tokenizer.encode_batch_fast([w.decode("utf-8") for w in words], add_special_tokens=False)
        return {word: np.asarray(encoding.ids, dtype="<u4").tobytes() for word, encoding in zip(words, found)}

    def _encode(self, words: list[bytes]) -> dict[bytes, bytes]:
        """Words of letters in one go: each ends with a token that says so."""
        letters, other = {}, []
        for word in words:
            text = word.decode("utf-8")
            if text.isalpha() and (text.isascii() or text.lower().isalpha()):
                letters[word] = text
            else:
                other.append(word)
        out = self._encode_each(other)
        if letters:
            encoding = self._tokenizer.encode_batch_fast([" ".join(letters.values())], add_special_tokens=False)[0]
            ids = np.asarray(encoding.ids, dtype="<u4")
            ends = 4 * (np.flatnonzero(self._ends[ids]) + 1)
            if len(ends) != len(letters):
                return out | self._encode_each(list(letters))
            raw, start = ids.tobytes(), 0
            for word, end in zip(letters, ends.tolist()):
                out[word] = raw[start:end]
                start = end
        return out

    @staticmethod
    def _stem(word: bytes) -> bytes:
        """What comes before the word's last run of punctuation, or the word if that run reaches further back."""
        stem = word.rstrip(ENDINGS)
        if len(stem) == len(word) or not stem or stem[-1:].isalnum():
            return stem
        # As the vocabulary sees it: a letter may end in a mark once it is lower case.
        last = unicodedata.normalize("NFC", stem.decode("utf-8")).lower()[-1]
        return stem if unicodedata.category(last)[0] in "LN" else word

    def _of_new(self, words: set[bytes]) -> dict[bytes, bytes]:
        parts = [(w, stem, w[len(stem) :]) for w in words for stem in (self._stem(w),)]
        stems = self._stems
        extra = self._encode([p for p in {p for part in parts for p in part[1:]}.difference(stems) if p])
        extra[b""] = b""
        stems.update(extra)
        found = {w: stems[stem] + stems[ending] for w, stem, ending in parts}
        if len(stems) > REMEMBERED[1]:
            for part in extra:
                del stems[part]
        return found

    @staticmethod
    def _words_of(text: str) -> list[bytes]:
        raw = text.encode("utf-8")
        if b"<|" not in raw:  # a special token's name keeps its case
            lower = raw.lower()
            # Lower case first, unless that lets a letter and a mark join that didn't before.
            if raw.isascii() or unicodedata.is_normalized("NFC", lower.decode("utf-8")):
                raw = lower
        return raw.split()

    def __call__(self, texts: list[str]) -> list[bytes]:
        known = self._words
        listed = [self._words_of(text) for text in texts]
        here = set().union(*listed)
        found = self._of_new(here.difference(known))
        if len(known) + len(found) <= REMEMBERED[0]:
            known.update(found)
        of = {w: found[w] if w in found else known[w] for w in here}
        out = [b"".join(map(of.__getitem__, words)) for words in listed]
        return out


@lru_cache(maxsize=2)
def word_ids(tokenizer_path: str) -> WordIds:
    """One per Python process and vocabulary, so that tasks share what is remembered."""
    return WordIds(tokenizer_path)


def token_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: the document's ids and the separator, cut every ``capacity`` ids."""

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids_of = word_ids(tokenizer_path)
        end = np.asarray([SEPARATOR_ID], dtype="<u4").tobytes()
        step = 4 * capacity
        for frame in text_slices(batches, "text", TEXT_BATCH):
            rows = []
            for doc_id, ids in zip(frame["doc_id"], ids_of(frame["text"].tolist())):
                ids += end
                for piece, at in enumerate(range(0, len(ids), step)):
                    part = ids[at : at + step]
                    rows.append((doc_id, piece, at // 4, len(part) // 4, zlib.crc32(part)))
            yield pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(filled_id(), F.coalesce("text", F.lit("")).alias("text")).mapInPandas(pieces, _PIECES)


def packing_plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Places for ``counts[length]`` pieces of each length, as rows of ranks.

    A row (length, rank_from, rank_to, seq_from, per_seq, offset_from) puts the pieces of
    that length with ranks from ``rank_from`` up to, not including, ``rank_to`` into the
    sequences from ``seq_from`` on, ``per_seq`` one after the other in each.
    """
    left = {n: c for n, c in counts.items() if c > 0}
    used = dict.fromkeys(left, 0)
    plan: list[tuple[int, int, int, int, int, int]] = []
    room: dict[int, list[tuple[int, int]]] = {}  # free ids of a sequence -> runs of sequences (first, how many)
    gaps: list[int] = []
    sequences = 0

    def keep(gap: int, first: int, many: int) -> None:
        if gap > 0 and many > 0:
            if gap not in room:
                room[gap] = []
                insort(gaps, gap)
            room[gap].append((first, many))

    def put(length: int, many: int, first: int, per: int, offset: int) -> None:
        plan.append((length, used[length], used[length] + many, first, per, offset))
        used[length] += many
        left[length] -= many

    large = sorted(n for n in left if 3 * n > capacity)
    while large:
        n = large[-1]
        while left[n]:
            at = bisect_left(large, capacity - n + 1) - 1
            while at >= 0 and not left[large[at]]:
                at -= 1
            mate = large[at] if at >= 0 else None
            if mate is None or (mate == n and left[n] == 1):
                at -= 1
                while mate is not None and at >= 0 and not left[large[at]]:
                    at -= 1
                mate = large[at] if mate is not None and at >= 0 else None
            pairs = left[n] if mate is None else left[n] // 2 if mate == n else min(left[n], left[mate])
            put(n, pairs, sequences, 1, 0)
            if mate is not None:
                put(mate, pairs, sequences, 1, n)
            keep(capacity - n - (mate or 0), sequences, pairs)
            sequences += pairs
        large.pop()

    for n in sorted((n for n in left if left[n]), reverse=True):
        while left[n]:
            at = bisect_left(gaps, n)
            if at == len(gaps):
                gap, (first, many) = capacity, (sequences, -(-left[n] // (capacity // n)))
                sequences += many
            else:
                gap = gaps[at]
                first, many = room[gap].pop()
                if not room[gap]:
                    del room[gap]
                    gaps.pop(at)
            per = gap // n
            full = min(many, left[n] // per)
            if full:
                put(n, full * per, first, per, capacity - gap)
                keep(gap - per * n, first, full)
            if full < many:
                rest = left[n]
                if rest:
                    put(n, rest, first + full, rest, capacity - gap)
                    keep(gap - rest * n, first + full, 1)
                    keep(gap, first + full + 1, many - full - 1)
                else:
                    keep(gap, first + full, many - full)
    return plan


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY) -> DataFrame:
    """Every piece of every document with its sequence and its offset there.

    A null or empty text is the separator alone. Repeated rows and repeated ids are
    documents of their own, each with its own place. Rows of equal length and
    ``doc_id`` are interchangeable. No documents give no rows; other columns are
    ignored. Sequences are numbered from 0; which piece lies where is decided by
    (length, bucket of the id, id, piece), so a rerun gives the same packing.
    """
    spark = docs.sparkSession
    pieces = written(token_pieces(docs, tokenizer_path, capacity), "pieces")
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    plan = packing_plan(counts, capacity)
    # One row per placed run: bounded by the capacity, not by the documents.
    places = F.broadcast(spark.createDataFrame(plan, _PLAN))
    buckets = max(1, -(-max(counts.values(), default=1) // ROWS_PER_BUCKET))
    bucketed = pieces.withColumn("__bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)).cast("int"))
    before = Window.partitionBy("length").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    # A row per length and bucket, of which a bucket stands for many rows.
    offsets = bucketed.groupBy("length", "__bucket").agg(F.count("*").alias("__n"))
    offsets = offsets.select("length", "__bucket", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    within = Window.partitionBy("length", "__bucket").orderBy("doc_id", "piece", "start", "ids_crc32")
    ranked = bucketed.withColumn("__row", F.row_number().over(within)).join(offsets, ["length", "__bucket"])
    ranked = ranked.withColumn("__rank", F.col("__before") + F.col("__row") - 1)
    place = ranked.join(places, "length").where("__rank >= rank_from AND __rank < rank_to")
    nth = F.col("__rank") - F.col("rank_from")
    return place.select(
        restored_id(),
        "piece",
        "start",
        F.col("length").cast("long").alias("length"),
        "ids_crc32",
        (F.col("seq_from") + F.floor(nth / F.col("per_seq"))).cast("long").alias("sequence_id"),
        (F.col("offset_from") + (nth % F.col("per_seq")) * F.col("length")).cast("long").alias("offset"),
    )
