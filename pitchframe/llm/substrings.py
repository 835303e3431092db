"""Removal of repeated passages: seed on winnowed anchors, extend both ways.

A window is ``min_words`` consecutive words. Anchors are hashes of ``anchor_words`` words;
winnowing picks one in every window, the smallest, so equal windows have equal anchors
in the same place, and a passage of ``min_words`` can't be missed. Consecutive windows with one
anchor are a seed: the anchor, and the words it extends over to the left and the right.

Documents are joined on shared anchors. Seeds with equal extensions are matched whole. Where
extensions differ, the match ends somewhere inside them; there it is followed window by
window. What is matched to a smaller ``doc_id`` adds up to the maximal repeats, each at
least ``min_words`` long. No step pairs documents: a seed needs only the smallest id that has it,
which is a grouped minimum, so a passage in n documents costs n rows.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitchframe.llm.common import ROW, RunHashes, filled_id, mix, restored_id, row_key, text_slices, word_hashes
from pitchframe.plans.scratch import written

MIN_WORDS = 50
ANCHOR_WORDS = 20
TEXT_BATCH = 2_000_000
_POSITION = np.uint64((1 << 24) - 1)

_KEY = ["doc_id", *ROW]
_SEEDS = "anchor long, extension long, doc_id long, row_a long, row_b long, first int, last int"
_WINDOWS = "anchor long, window long, doc_id long, row_a long, row_b long, first int"
_KEPT = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string"


def winnow(grams: np.ndarray, width: int) -> np.ndarray:
    """Place of the smallest gram of every window of ``width`` grams; the rightmost of equal ones.

    Grams are compared by their upper 40 bits; the lower ones hold the place, reversed.
    """
    places = np.arange(len(grams), dtype="uint64") & _POSITION
    low = (grams & ~_POSITION) | (_POSITION - places)
    have = 1
    while 2 * have <= width:
        low = np.minimum(low[:-have], low[have:])
        have *= 2
    if have < width:
        low = np.minimum(low[: len(low) - (width - have)], low[width - have :])
    starts = np.arange(len(low))
    seen = (_POSITION - (low & _POSITION)).astype("int64")
    # Places repeat after 2^24; the true one is the first such at or after the window's start.
    return starts + ((seen - starts) & int(_POSITION))


def seeds_of(words: list[bytes], min_words: int = MIN_WORDS, anchor_words: int = ANCHOR_WORDS) -> tuple[np.ndarray, ...]:
    """anchor, extension hash, first and last window of every seed of a document."""
    if len(words) < min_words:
        return (np.empty(0, "int64"),) * 4
    runs = RunHashes(word_hashes(words))
    grams = runs.every(anchor_words)
    at = winnow(grams, min_words - anchor_words + 1)
    new = np.flatnonzero(np.diff(at)) + 1
    first = np.concatenate([[0], new])
    last = np.concatenate([new, [len(at)]]) - 1
    anchor = at[first]
    sides = ((anchor - first) * min_words + (anchor - last)).astype("uint64")
    extension = mix(runs(first, last + min_words) ^ mix(sides + np.uint64(1)))
    return grams[anchor].view("int64"), extension.view("int64"), first, last


def _rows(docs: DataFrame) -> DataFrame:
    """doc_id, text and the ``ROW`` that tells rows of one id and different texts apart."""
    text = F.coalesce("text", F.lit(""))
    return docs.select(filled_id(), *row_key("text"), text.alias("text"))


def find_seeds(docs: DataFrame, min_words: int = MIN_WORDS, anchor_words: int = ANCHOR_WORDS) -> DataFrame:
    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in text_slices(batches, "text", TEXT_BATCH):
            found = [seeds_of(t.encode("utf-8").split(), min_words, anchor_words) for t in frame["text"]]
            many = [len(f[0]) for f in found]
            anchor, extension, first, last = (np.concatenate(c) for c in zip(*found))
            keys = {c: np.repeat(frame[c].to_numpy(), many) for c in _KEY}
            yield pd.DataFrame({"anchor": anchor, "extension": extension, **keys, "first": first, "last": last})

    return _rows(docs).mapInPandas(find, _SEEDS)


def _windows_of_seeds(docs: DataFrame, seeds: DataFrame, min_words: int) -> DataFrame:
    """One row per window of ``seeds``, with the hash of its words."""
    listed = seeds.groupBy(*_KEY).agg(F.collect_set(F.struct("anchor", "first", "last")).alias("seeds"))

    def follow(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in text_slices(batches, "text", TEXT_BATCH):
            parts = []
            for *key, text, seeds in zip(*[frame[c] for c in _KEY], frame["text"], frame["seeds"]):
                windows = RunHashes(word_hashes(text.encode("utf-8").split())).every(min_words).view("int64")
                many = [s["last"] - s["first"] + 1 for s in seeds]
                at = np.concatenate([np.arange(s["first"], s["last"] + 1) for s in seeds])
                anchors = np.repeat([s["anchor"] for s in seeds], many)
                parts.append(pd.DataFrame({"anchor": anchors, "window": windows[at], **dict(zip(_KEY, key)), "first": at}))
            yield pd.concat(parts)

    return _rows(docs).join(listed, _KEY).mapInPandas(follow, _WINDOWS)


def repeated_windows(docs: DataFrame, min_words: int = MIN_WORDS, anchor_words: int = ANCHOR_WORDS) -> DataFrame:
    """doc_id, ``ROW``, first, last: stretches of windows that also start in a document with a smaller id."""
    seeds = written(find_seeds(docs, min_words, anchor_words), "seeds")
    ids = (F.min("doc_id").alias("least"), F.max("doc_id").alias("most"))
    # What is joined back is a table first, so that the rows of a hot key can be split in the join.
    shared = written(seeds.groupBy("anchor").agg(*ids).where("least < most").select("anchor"), "shared-anchors")
    seeds = written(seeds.join(shared, "anchor"), "shared-seeds")
    sides = written(seeds.groupBy("anchor", "extension").agg(*ids), "extensions")
    unequal = sides.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor", F.lit(True).alias("unequal"))
    sides = sides.join(written(unequal, "unequal"), "anchor", "left").where("least < most OR unequal")
    matched = seeds.join(sides, ["anchor", "extension"]).select("anchor", *_KEY, "first", "last", "least", "unequal")
    matched = written(matched, "matched-seeds")
    whole = matched.where("doc_id > least").select(*_KEY, "first", "last")
    # The smallest id of each extension stands for it where extensions differ.
    windows = written(_windows_of_seeds(docs, matched.where("doc_id = least AND unequal"), min_words), "windows")
    earliest = windows.groupBy("anchor", "window").agg(*ids).where("least < most").select("anchor", "window", "least")
    single = windows.join(written(earliest, "earliest"), ["anchor", "window"]).where("doc_id > least")
    return whole.unionByName(single.select(*_KEY, "first", F.col("first").alias("last")))


def remove_repeats(docs: DataFrame, min_words: int = MIN_WORDS, anchor_words: int = ANCHOR_WORDS) -> DataFrame:
    """n_words, n_removed, the hash of the kept words and the kept words themselves, for every document.

    A word goes if a window over it, judged on the input, also starts in a document with a
    smaller ``doc_id``; repeats within one document, or among rows of one id, stay. Null, empty and
    short texts keep all their words. Ids that are null come before all others. Repeated
    rows give repeated results, no rows give none, other columns are ignored.
    """
    spans = repeated_windows(docs, min_words, anchor_words)
    spans = spans.groupBy(*_KEY).agg(F.collect_set(F.struct("first", "last")).alias("spans"))

    def keep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in text_slices(batches, "text", TEXT_BATCH):
            out = []
            for doc_id, text, found in zip(frame["doc_id"], frame["text"], frame["spans"]):
                words = text.encode("utf-8").split()
                kept = words
                if found is not None and len(found):
                    edges = np.zeros(len(words) + 1, dtype="int64")
                    np.add.at(edges, [s["first"] for s in found], 1)
                    np.add.at(edges, [s["last"] + min_words for s in found], -1)
                    kept = list(compress(words, np.cumsum(edges[:-1]) == 0))
                joined = b" ".join(kept)
                out.append((doc_id, len(words), len(words) - len(kept), hashlib.sha256(joined).hexdigest(), joined.decode("utf-8")))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in _KEPT.split(", ")])

    kept = _rows(docs).join(spans, _KEY, "left").mapInPandas(keep, _KEPT)
    return kept.select(restored_id(), "n_words", "n_removed", "kept_sha256", "kept")
