"""Toxicity by the nearest labelled examples in TF-IDF space.

Terms are lower-cased words and the heads of longer words, so that inflected and compound words
share some. Of all terms of the examples those count whose spread over the labels can't be chance: of M
terms one in several tries would have a log-likelihood ratio of 2 ln M by chance. A document is the vector of their TF-IDF weights, of length 1.

The examples are kept in an inverted index of blocks: each term lists the blocks it occurs in,
with its highest weight in the block, and the postings of the block. What a document's terms can
reach in a block bounds its cosines there; blocks are read from the highest bound down, until
the bound falls below the k-th best cosine found. The neighbours are exact.

A vote of the neighbours, weighted by nearness, becomes a score by a logistic curve fitted on the
votes that every example gets from the others.
"""
from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pitchframe.llm.common import filled_id, restored_id, text_slices
from pitchframe.plans.scratch import written

#: Labelled documents that become examples, at most; those first by a hash of their id. Terms, at most.
FIT_ROWS, FIT_TERMS = 20_000, 20_000
#: Examples a term has to occur in.
LEAST_EXAMPLES = 3
HEADS = range(4, 9)
NEIGHBOURS = 15
#: A neighbour's vote weighs its cosine to this power; the share of toxic examples votes with this weight.
NEARNESS, PRIOR_WEIGHT = 2, 0.1
THRESHOLD = 0.5
BLOCK = 64
#: Blocks that are read between two looks at the bound.
BLOCKS_AT_ONCE = 8
TEXT_BATCH = 2_000_000
#: Characters of a long text that are read at a time, and entries of a term count or cache in a task.
SLICE, ENTRIES = 1_000_000, 400_000

_WORD = re.compile(r"[^\W\d_]+")
_GAP = re.compile(r"[\W\d_]")
_EVIDENCE = "array<struct<doc_id: long, cosine: double, toxic: int>>"


def word_counts(text: str) -> Counter:
    """How often each lower-cased word occurs; long texts are read piece by piece, between words."""
    counts: Counter = Counter()
    start = 0
    while start < len(text):
        stop = start + SLICE
        if stop < len(text):
            gap = _GAP.search(text, stop)
            stop = gap.start() if gap else len(text)
        counts.update(_WORD.findall(text[start:stop].lower()))
        start = stop
    return counts


def terms_of(word: str) -> list[str]:
    """The word, and its heads (with a hyphen, so that they are never words)."""
    return [word, *[word[:n] + "-" for n in HEADS if n < len(word)]]


@dataclass(frozen=True)
class Index:
    """Examples in blocks; term t has the entries ``starts[t]`` to ``starts[t + 1]``, one per block it occurs in."""

    terms: dict[str, int]
    idf: np.ndarray
    ids: np.ndarray
    labels: np.ndarray
    starts: np.ndarray
    entry_block: np.ndarray
    entry_most: np.ndarray
    entry_start: np.ndarray
    posting_example: np.ndarray
    posting_weight: np.ndarray
    #: Share of toxic examples, and the curve from votes to scores.
    prior: float = 0.0
    slope: float = 1.0
    offset: float = 0.0


def vector(counts: Counter, index_terms: dict[str, int], idf: np.ndarray, known: dict[str, tuple[int, ...]]) -> tuple[np.ndarray, np.ndarray]:
    """Terms (ascending) and weights of a document; none where it has no term of the index."""
    found: Counter = Counter()
    for word, n in counts.items():
        ids = known.get(word)
        if ids is None:
            if len(known) >= ENTRIES:
                known.clear()
            ids = known[word] = tuple(index_terms[t] for t in terms_of(word) if t in index_terms)
        for t in ids:
            found[t] += n
    terms = np.array(sorted(found), dtype="int64")
    weights = (1.0 + np.log(np.array([found[t] for t in terms.tolist()], dtype="float64"))) * idf[terms]
    norm = math.sqrt(float(weights @ weights))
    return (terms, weights / norm) if norm else (terms[:0], weights[:0])


def build_index(terms: list[str], idf: np.ndarray, ids: list[int], labels: list[int], vectors: list[tuple[np.ndarray, np.ndarray]], block: int = BLOCK) -> Index:
    """The index of examples in order of their heaviest term, so that blocks hold similar ones."""
    # Examples without a term have a cosine of 0 with everything.
    usable = [i for i, (t, _) in enumerate(vectors) if len(t)]
    order = sorted(usable, key=lambda i: (int(vectors[i][0][vectors[i][1].argmax()]), -float(vectors[i][1].max()), ids[i]))
    term = np.concatenate([vectors[i][0] for i in order]) if order else np.empty(0, dtype="int64")
    weight = np.concatenate([vectors[i][1] for i in order]) if order else np.empty(0)
    example = np.repeat(np.arange(len(order)), [len(vectors[i][0]) for i in order])
    sort = np.lexsort((example, term))
    term, weight, example = term[sort], weight[sort], example[sort]
    key = term * (len(order) // block + 1) + example // block
    entry = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.empty(0, dtype="int64")
    most = np.maximum.reduceat(weight, entry) if len(entry) else np.empty(0)
    kept = np.array(order, dtype="int64")
    return Index(
        dict(zip(terms, range(len(terms)))), idf, np.array(ids, dtype="int64")[kept], np.array(labels, dtype="int64")[kept],
        np.searchsorted(term[entry], np.arange(len(terms) + 1)), example[entry] // block, most, np.append(entry, len(term)), example, weight,
    )


def _flat_ranges(starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """The numbers of all ranges, one range after the other."""
    lengths = stops - starts
    return np.repeat(starts - np.cumsum(lengths) + lengths, lengths) + np.arange(lengths.sum())


def nearest(index: Index, terms: np.ndarray, weights: np.ndarray, k: int = NEIGHBOURS, skip: int | None = None) -> list[tuple[float, int]]:
    """(cosine, example) of the ``k`` examples with the highest cosines above 0, ties to smaller ids.

    ``skip`` is the id of an example that doesn't count, the document itself.
    """
    entries = [np.arange(index.starts[t], index.starts[t + 1]) for t in terms.tolist()]
    if not entries:
        return []
    entry = np.concatenate(entries)
    factor = np.repeat(weights, [len(e) for e in entries])
    bound = np.bincount(index.entry_block[entry], factor * index.entry_most[entry])
    order = np.argsort(-bound, kind="stable")
    order = order[: np.count_nonzero(bound > 0)]
    by_block = np.argsort(index.entry_block[entry], kind="stable")
    entry, factor = entry[by_block], factor[by_block]
    first = np.searchsorted(index.entry_block[entry], np.arange(len(bound) + 1))
    best: list[tuple[float, int, int]] = []
    for i in range(0, len(order), BLOCKS_AT_ONCE):
        # A bound is summed in another order than the cosines it bounds.
        least = -best[-1][0] - 1e-9 if len(best) == k else 0.0
        blocks = order[i : i + BLOCKS_AT_ONCE]
        blocks = blocks[bound[blocks] >= least]
        if not len(blocks):
            break
        some = _flat_ranges(first[blocks], first[blocks + 1])
        starts, stops = index.entry_start[entry[some]], index.entry_start[entry[some] + 1]
        posting = _flat_ranges(starts, stops)
        example, place = np.unique(index.posting_example[posting], return_inverse=True)
        scores = np.bincount(place, np.repeat(factor[some], stops - starts) * index.posting_weight[posting])
        hits = np.flatnonzero(scores >= least)
        # Cosines are rounded, so that equal ones tie whatever the order of their sums.
        found = zip(np.round(-scores[hits], 12).tolist(), index.ids[example[hits]].tolist(), example[hits].tolist())
        best = sorted(best + [f for f in found if f[1] != skip])[:k]
    return [(-score, int(example)) for score, _, example in best]


def vote(index: Index, neighbours: list[tuple[float, int]]) -> float:
    weight = [s**NEARNESS for s, _ in neighbours]
    toxic = sum(w * float(index.labels[e]) for w, (_, e) in zip(weight, neighbours))
    return (toxic + PRIOR_WEIGHT * index.prior) / (sum(weight) + PRIOR_WEIGHT)


def _logit(votes: np.ndarray | float) -> np.ndarray:
    return np.log((np.asarray(votes) + 0.02) / (1.02 - np.asarray(votes)))


def calibration(votes: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the logistic curve from votes to labels (Newton's method, slightly damped)."""
    x, beta = np.stack([_logit(votes), np.ones(len(votes))], axis=1), np.array([1.0, 0.0])
    for _ in range(50):
        p = 1.0 / (1.0 + np.exp(-np.clip(x @ beta, -30, 30)))
        gradient = x.T @ (labels - p) - 1e-2 * (beta - [1.0, 0.0])
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + 1e-2 * np.eye(2), gradient)
        beta = beta + step
        if np.abs(step).max() < 1e-9:
            break
    return float(beta[0]), float(beta[1])


def _chosen(docs: DataFrame, labels: DataFrame, fit_rows: int) -> DataFrame:
    """doc_id, text and toxic of the examples, one per id and text, at most ``fit_rows``."""
    known = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    first = [F.xxhash64("doc_id"), F.col("doc_id")]
    chosen = written(known.orderBy(*first).limit(fit_rows), "labelled")
    texts = docs.where("text IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(chosen, "doc_id")
    # An id may have several texts: one of each id is taken, and repeated rows are one.
    return written(texts.groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min("text").alias("text")), "examples")


def _term_table(examples: DataFrame) -> DataFrame:
    """term, in how many examples it is, and in how many toxic ones."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: Counter = Counter()
        toxic: Counter = Counter()

        def table() -> pd.DataFrame:
            out = pd.DataFrame({"term": list(seen), "n": list(seen.values()), "toxic": [toxic[t] for t in seen]})
            seen.clear()
            toxic.clear()
            return out

        for frame in text_slices(batches, "text", TEXT_BATCH):
            for text, label in zip(frame["text"], frame["toxic"]):
                terms = {t for word in word_counts(text) for t in terms_of(word)}
                seen.update(terms)
                if label:
                    toxic.update(terms)
                if len(seen) >= ENTRIES:
                    yield table()
        if seen:
            yield table()

    rows = examples.select("text", "toxic").mapInPandas(count, "term string, n long, toxic long")
    return rows.groupBy("term").agg(F.sum("n").alias("n"), F.sum("toxic").alias("toxic"))


def fit_toxicity(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, fit_terms: int = FIT_TERMS, k: int = NEIGHBOURS) -> Index:
    """The index of the labelled documents (``labels``: doc_id, toxic), at most ``fit_rows`` of them.

    What the driver gets is bounded by ``fit_rows`` and ``fit_terms``: weights, never texts.
    """
    examples = _chosen(docs, labels, fit_rows)
    rows, toxic_rows = examples.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    if not rows:
        return build_index([], np.empty(0), [], [], [])
    # The ratio is an expression of Spark here, so that only terms that reach it leave the executors.
    counted = written(_term_table(examples).where(F.col("n") >= LEAST_EXAMPLES), "terms")
    least = 2 * math.log(max(counted.count(), 1))
    n, t, non = F.col("n"), F.col("toxic"), rows - toxic_rows

    def part(seen: Column, expected: Column) -> Column:
        return F.when(seen > 0, seen * F.log(seen / expected)).otherwise(F.lit(0.0))

    ratio = part(t, n * toxic_rows / rows) + part(n - t, n * non / rows) + part(toxic_rows - t, (rows - n) * toxic_rows / rows) + part(non - n + t, (rows - n) * non / rows)
    chosen = counted.withColumn("ratio", 2 * ratio).where(F.col("ratio") >= least).orderBy(F.desc("ratio"), "term").limit(fit_terms).collect()
    terms = sorted(r["term"] for r in chosen)
    frequency = {r["term"]: r["n"] for r in chosen}
    idf = np.log((rows + 1.0) / (np.array([frequency[t] for t in terms], dtype="float64") + 1.0)) if terms else np.empty(0)
    number = dict(zip(terms, range(len(terms))))

    def weigh(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[str, tuple[int, ...]] = {}
        for frame in text_slices(batches, "text", TEXT_BATCH):
            vectors = [vector(word_counts(x), number, idf, known) for x in frame["text"]]
            yield pd.DataFrame({"doc_id": frame["doc_id"].to_numpy(), "toxic": frame["toxic"].to_numpy(), "terms": [v[0] for v in vectors], "weights": [v[1] for v in vectors]})

    weighed = examples.mapInPandas(weigh, "doc_id long, toxic int, terms array<long>, weights array<double>").orderBy("doc_id").collect()
    vectors = [(np.array(r["terms"], dtype="int64"), np.array(r["weights"], dtype="float64")) for r in weighed]
    labels_, ids = np.array([r["toxic"] for r in weighed], dtype="float64"), [r["doc_id"] for r in weighed]
    index = build_index(terms, idf, ids, labels_.astype("int64").tolist(), vectors)
    index = replace(index, prior=float(labels_.mean()))
    slope, offset = calibration(_votes_of_examples(docs.sparkSession, index, ids, vectors, k), labels_)
    return replace(index, slope=slope, offset=offset)


def _votes_of_examples(spark: SparkSession, index: Index, ids: list[int], vectors: list[tuple[np.ndarray, np.ndarray]], k: int) -> np.ndarray:
    """The vote every example gets from the others, found by the executors."""
    shared = spark.sparkContext.broadcast((index, vectors))

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index, vectors = shared.value
        for frame in batches:
            at = frame["id"].to_numpy()
            votes = [vote(index, nearest(index, *vectors[i], k, skip=ids[i])) for i in at]
            yield pd.DataFrame({"id": at, "vote": votes})

    rows = spark.range(len(ids)).mapInPandas(each, "id long, vote double").collect()
    out = np.zeros(len(ids))
    for r in rows:
        out[r["id"]] = r["vote"]
    return out


def toxicity_scores(docs: DataFrame, index: Index, threshold: float = THRESHOLD, k: int = NEIGHBOURS) -> DataFrame:
    """doc_id, ``score``, ``predicted`` and ``evidence`` of every row of ``docs`` (doc_id, text).

    The evidence is the nearest examples with their cosines and labels, nearest first. A null text counts as
    empty; a text without a term of the index has no neighbours, and the score of the prior
    alone. Whole texts are read. Rows are independent: repeated rows get equal scores. Without
    labelled rows the prior is 0, and every score low. No rows give none; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(index)

    def predict(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index, known = shared.value, {}
        for frame in text_slices(batches, "text", TEXT_BATCH):
            votes, evidence = [], []
            for text in frame["text"]:
                near = nearest(index, *vector(word_counts(text), index.terms, index.idf, known), k)
                votes.append(vote(index, near))
                evidence.append([{"doc_id": int(index.ids[e]), "cosine": s, "toxic": int(index.labels[e])} for s, e in near])
            score = 1.0 / (1.0 + np.exp(-(index.slope * _logit(np.array(votes)) + index.offset)))
            yield pd.DataFrame({"doc_id": frame["doc_id"].to_numpy(), "score": score, "evidence": evidence})

    rows = docs.select(filled_id(), F.coalesce("text", F.lit("")).alias("text"))
    scored = rows.mapInPandas(predict, f"doc_id long, score double, evidence {_EVIDENCE}")
    return scored.select(restored_id(), "score", (F.col("score") >= F.lit(threshold)).cast("int").alias("predicted"), "evidence")
