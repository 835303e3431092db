"""Quality scores: gradient-boosted trees on binned document statistics.

Statistics are counted over whole texts. Each is cut into bins once; a tree is grown
level by level from histograms of gradients per bin. The trees are kept as flat
arrays (feature, bin, value; children of node i at 2i + 1 and 2i + 2), so
a batch of documents goes down one level of a tree in three numpy steps.
"""
from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitchframe.llm.common import filled_id, restored_id, text_slices
from pitchframe.plans.scratch import written

#: Labelled documents the trees are fitted on, at most; those first by a hash of their id.
FIT_ROWS = 20_000
THRESHOLD = 0.3
TEXT_BATCH = 4_000_000

STATISTICS = (
    "log_bytes log_words word_bytes letters upper digits spaces other_ascii beyond_ascii bars "
    "symbols sentence_ends commas byte_entropy distinct_words short_words long_words "
    "lines repeated_lines line_bytes ended_lines ended_words all_upper_words"
).split()
_BAR, _UPPER, _DIGIT = ord("|"), slice(65, 91), slice(48, 58)
_SENTENCE = re.compile(rb"[.!?]\s")


def _mask(characters: bytes) -> np.ndarray:
    mask = np.zeros(256, dtype=bool)
    mask[list(characters)] = True
    return mask


_SYMBOLS, _SPACE = _mask(b"!#$%&*+/<=>?@\\^_`{}~[]"), _mask(b" \t\n\r\x0b\x0c")
_LETTER = _mask(bytes([*range(65, 91), *range(97, 123)]))


def statistics(text: str) -> list[float]:
    raw = text.encode("utf-8", "replace")
    n = len(raw)
    words = raw.split()
    if not words:
        return [float(np.log1p(n))] + [0.0] * (len(STATISTICS) - 1)
    histogram = np.bincount(np.frombuffer(raw, dtype=np.uint8), minlength=256)
    share = histogram[histogram > 0] / n
    lengths = np.fromiter(map(len, words), dtype="int64", count=len(words))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    return [
        float(np.log1p(n)),
        float(np.log1p(len(words))),
        float(lengths.mean()),
        float(histogram[_LETTER].sum() / n),
        float(histogram[_UPPER].sum() / n),
        float(histogram[_DIGIT].sum() / n),
        float(histogram[_SPACE].sum() / n),
        float((histogram[33:127].sum() - histogram[_LETTER].sum() - histogram[_DIGIT].sum()) / n),
        float(histogram[128:].sum() / n),
        float(histogram[_BAR] / n),
        float(histogram[_SYMBOLS].sum() / n),
        float(len(_SENTENCE.findall(raw)) / len(words)),
        float(histogram[ord(",")] / n),
        float(-(share * np.log2(share)).sum()),
        float(len(set(words)) / len(words)),
        float((lengths <= 3).mean()),
        float((lengths > 12).mean()),
        float(np.log1p(len(lines))),
        float(1.0 - len(set(lines)) / len(lines)),
        float(np.log1p(n / len(lines))),
        float(sum(x.rstrip()[-1:] in b".!?" for x in lines) / len(lines)),
        float(sum(x[-1] in b"!*#$%&" for x in words) / len(words)),
        float(sum(map(bytes.isupper, words)) / len(words)),
    ]


@dataclass(frozen=True)
class Trees:
    """``feature``, ``cut`` and ``value``: one row per tree, one column per node; a leaf has feature -1."""

    edges: list[np.ndarray]
    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray
    base: float
    depth: int

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(self.edges)], axis=1).astype(np.uint8)

    def raw_score(self, bins: np.ndarray) -> np.ndarray:
        rows = np.arange(len(bins))
        total = np.full(len(bins), self.base)
        for feature, cut, value in zip(self.feature, self.cut, self.value):
            node = np.zeros(len(bins), dtype="int64")
            for _ in range(self.depth):
                split = feature[node]
                right = bins[rows, np.maximum(split, 0)] > cut[node]
                node = np.where(split < 0, node, 2 * node + 1 + right)
            total += value[node]
        return total

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-self.raw_score(self.binned(x))))


def fit_trees(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.15, bins: int = 64, smooth: float = 1.0, least: float = 1.0) -> Trees:
    """Boosting for the logistic loss. No rows, or one class only, give a constant score."""
    if not len(y):
        return Trees([np.empty(0)] * len(STATISTICS), np.empty((0, 1), int), np.empty((0, 1), int), np.empty((0, 1)), 0.0, depth)
    quantiles = np.linspace(0, 1, bins + 1)[1:-1]
    edges = [np.unique(np.quantile(x[:, j], quantiles, method="lower")) for j in range(x.shape[1])]
    share = np.clip((y.sum() + 0.5) / (len(y) + 1.0), 1e-6, 1 - 1e-6)
    model = Trees(edges, np.empty((0, 0)), np.empty((0, 0)), np.empty((0, 0)), float(np.log(share / (1 - share))), depth)
    binned = model.binned(x).astype("int64")
    m, nodes = x.shape[1], 2 ** (depth + 1) - 1
    flat = binned + bins * np.arange(m)
    raw = np.full(len(y), model.base)
    grown: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for _ in range(trees if 0 < y.sum() < len(y) else 0):
        p = 1.0 / (1.0 + np.exp(-raw))
        gradient, hessian = y - p, np.maximum(p * (1 - p), 1e-9)
        feature, cut, value = np.full(nodes, -1), np.zeros(nodes, dtype="int64"), np.zeros(nodes)
        node = np.zeros(len(y), dtype="int64")
        for level in range(depth + 1):
            first, many = 2**level - 1, 2**level
            here = np.flatnonzero(node >= first)
            if not len(here):
                break
            at = node[here] - first
            g = np.bincount(at, gradient[here], many)
            h = np.bincount(at, hessian[here], many)
            value[first : first + many] = rate * g / (h + smooth)
            if level == depth:
                break
            cell = (at[:, None] * (m * bins) + flat[here]).ravel()
            by_g = np.bincount(cell, np.repeat(gradient[here], m), many * m * bins).reshape(many, m, bins).cumsum(axis=2)
            by_h = np.bincount(cell, np.repeat(hessian[here], m), many * m * bins).reshape(many, m, bins).cumsum(axis=2)
            other_g, other_h = g[:, None, None] - by_g, h[:, None, None] - by_h
            gain = by_g**2 / (by_h + smooth) + other_g**2 / (other_h + smooth) - (g**2 / (h + smooth))[:, None, None]
            gain[(by_h < least) | (other_h < least)] = -np.inf
            chosen = gain.reshape(many, -1).argmax(axis=1)
            for k in np.flatnonzero(gain.reshape(many, -1)[np.arange(many), chosen] > 1e-6):
                feature[first + k], cut[first + k] = divmod(int(chosen[k]), bins)
            split = feature[node[here]]
            right = binned[here, np.maximum(split, 0)] > cut[node[here]]
            node[here] = np.where(split < 0, node[here], 2 * node[here] + 1 + right)
        raw += value[node]
        grown.append((feature, cut, value))
    arrays = [np.stack(a) if a else np.empty((0, nodes), dtype="int64") for a in zip(*grown)] or [np.empty((0, nodes), dtype="int64")] * 3
    return Trees(edges, *arrays, model.base, depth)


def with_statistics(docs: DataFrame, keep: str = "") -> DataFrame:
    """doc_id, the columns of the schema string ``keep``, and ``x``, the statistics of the whole text."""
    kept = [c.split()[0] for c in keep.split(",") if c.strip()]

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in text_slices(batches, "text", TEXT_BATCH):
            yield frame.drop(columns="text").assign(x=[statistics(t) for t in frame["text"]])

    rows = docs.select(filled_id(), *kept, F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInPandas(count, ", ".join(filter(None, ["doc_id long", keep, "x array<double>"])))


def fit_quality(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, **options: float) -> Trees:
    """Trees fitted on labelled documents (``labels``: doc_id, quality), at most ``fit_rows`` of them.

    Labels without value or id are left out; of an id with several texts the first in order is taken.
    """
    known = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").select("doc_id", F.col("quality").cast("int").alias("quality"))
    chosen = written(known.orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(fit_rows), "labelled")
    # One row per id and label: an id that many rows share is one document here.
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(chosen, "doc_id").groupBy("doc_id", "quality").agg(F.min("text").alias("text"))
    rows = with_statistics(texts.limit(fit_rows), "quality int").orderBy("doc_id", "quality", "x").collect()
    x = np.asarray([r["x"] for r in rows], dtype="float64").reshape(len(rows), len(STATISTICS))
    return fit_trees(x, np.asarray([r["quality"] for r in rows], dtype="float64"), **options)


def quality_scores(docs: DataFrame, trees: Trees, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, ``score`` and ``predicted`` of every row of ``docs`` (doc_id, text).

    A null text counts as empty and is scored like any other. Rows are independent:
    repeated rows get equal scores. Without labelled rows every score is 0.5. Null ids
    stay null, no rows give none, other columns are ignored.
    """

    def predict(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in text_slices(batches, "text", TEXT_BATCH):
            score = trees.score(np.asarray([statistics(t) for t in frame["text"]], dtype="float64"))
            yield pd.DataFrame({"doc_id": frame["doc_id"].to_numpy(), "score": score})

    rows = docs.select(filled_id(), F.coalesce("text", F.lit("")).alias("text"))
    scored = rows.mapInPandas(predict, "doc_id long, score double")
    return scored.select(restored_id(), "score", (F.col("score") >= F.lit(threshold)).cast("int").alias("predicted"))
