"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1. An n-gram is the product of its
letters' vectors, each rotated by its place (binding of permuted vectors); a document
is the sum of its n-grams (bundling); a language is the sum of its documents. A
document has the language whose vector is closest by cosine.

Letters are lower-cased; everything else is one gap between words, a symbol with a
vector of its own. Vectors are drawn from the code point, so no table of letters is
trained or kept.
"""
from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pitchframe.llm.common import arrow_slices, text_slices
from pitchframe.plans.scratch import written

DIMENSION = 1024
NGRAM = 3
SEED = 7
UNKNOWN = "und"
#: Labelled documents of a language that its profile is made of, at most.
FIT_ROWS_PER_LANGUAGE = 2_000
STRETCH_BITS = 14
#: Characters, and texts, that are bundled at a time; n-grams whose vectors are made at a time.
TEXT_BATCH, TEXTS, GRAMS = 120_000, 64, 2_048
GAP = 0


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Which code points are letters."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)


@lru_cache(maxsize=4_096)
def letter_vector(code: int, dimension: int, seed: int) -> np.ndarray:
    bits = np.random.Generator(np.random.PCG64([seed, code])).integers(0, 2, dimension, dtype=np.int8)
    return (2 * bits - 1).astype(np.float32)


def ngram_vectors(grams: np.ndarray, dimension: int, seed: int) -> np.ndarray:
    """One row per n-gram: its letters' vectors, rotated by their place, multiplied."""
    codes, where = np.unique(grams, return_inverse=True)
    where = where.reshape(grams.shape)
    letters = np.stack([letter_vector(int(c), dimension, seed) for c in codes])
    out = letters[where[:, -1]]
    for place in range(grams.shape[1] - 1):
        out *= np.roll(letters, grams.shape[1] - 1 - place, axis=1)[where[:, place]]
    return out


def document_vectors(texts: list[str], dimension: int = DIMENSION, n: int = NGRAM, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """The bundled vector of each text, and whether it has a letter at all.

    Few texts and few n-grams are taken at a time, so that the counts of n-grams by text stay small.
    """
    vectors, known = np.zeros((len(texts), dimension), dtype=np.float32), np.zeros(len(texts), dtype=bool)
    for i in range(0, len(texts), TEXTS):
        part = slice(i, i + TEXTS)
        distinct, where, owner, known[part] = _grams(texts[part], n)
        few = vectors[part]
        for g in range(0, len(distinct), GRAMS):
            grams = np.stack([(distinct[g : g + GRAMS] >> (21 * (n - 1 - place))) & 0x1FFFFF for place in range(n)], axis=1)
            here = (where >= g) & (where < g + GRAMS)
            counts = np.bincount(owner[here] * len(grams) + where[here] - g, minlength=len(few) * len(grams))
            few += counts.reshape(len(few), -1).astype(np.float32) @ ngram_vectors(grams, dimension, seed)
    return vectors, known


def _grams(texts: list[str], n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The distinct n-grams, the one of every place and the text it is in, and which texts have a letter."""
    # A gap before and after every text; lower case may change a text's length.
    texts = [f"\n{t.lower()}\n" for t in texts]
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype="<u4")
    owner = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    symbols = np.where(_letters()[codes], codes, GAP)
    # Gaps in a row are one.
    keep = np.ones(len(symbols), dtype=bool)
    keep[1:] = (symbols[1:] != GAP) | (symbols[:-1] != GAP) | (owner[1:] != owner[:-1])
    symbols, owner = symbols[keep].astype("int64"), owner[keep]
    has_letter = np.bincount(owner[symbols != GAP], minlength=len(texts)) > 0
    places = max(0, len(symbols) - n + 1)
    key = np.zeros(places, dtype="int64")
    for place in range(n):
        key = (key << 21) | symbols[place : places + place]
    inside = owner[n - 1 : n - 1 + places] == owner[:places]
    distinct, where = np.unique(key[inside], return_inverse=True)
    return distinct, where, owner[:places][inside], has_letter


def language_profiles(labelled: DataFrame, per_language: int = FIT_ROWS_PER_LANGUAGE, dimension: int = DIMENSION, n: int = NGRAM, seed: int = SEED) -> dict[str, list[float]]:
    """The profile of every ``lang`` of ``labelled`` (doc_id, text, lang).

    Texts without a letter say nothing of a language. A language with more than ``per_language`` documents is learned from that many, those
    first by a hash of their id, so that fitting costs the same whatever the corpus.
    """
    ids = labelled.where("lang IS NOT NULL AND doc_id IS NOT NULL").select("doc_id", "lang").distinct()
    ids = written(ids.select("doc_id", "lang", F.xxhash64("doc_id").alias("hash")), "labelled")
    # Ranges of hashes are counted, and a language's are taken up to the one that completes it;
    # few rows more than needed are then put in order. One row per language, like the profiles.
    stretch = F.shiftright("hash", 64 - STRETCH_BITS)
    before = Window.partitionBy("lang").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    counts = ids.groupBy("lang", stretch.alias("stretch")).agg(F.count("*").alias("n")).withColumn("before", F.sum("n").over(before))
    last = counts.where(F.coalesce("before", F.lit(0)) < per_language).groupBy("lang").agg(F.max("stretch").alias("last"))
    near = ids.join(F.broadcast(last), "lang").where(stretch <= F.col("last"))
    order = Window.partitionBy("lang").orderBy("hash", "doc_id")
    near = near.withColumn("n", F.row_number().over(order)).where(F.col("n") <= per_language).select("doc_id", "lang")
    chosen = labelled.select("doc_id", "lang", "text").where("text IS NOT NULL").join(written(near, "profiled"), ["doc_id", "lang"])

    def bundle(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, np.ndarray] = {}
        for frame in batches:
            for part in text_slices(iter([frame]), "text", TEXT_BATCH):
                vectors, known = document_vectors(part["text"].tolist(), dimension, n, seed)
                # A long document weighs no more than a short one.
                norms = np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)
                for lang, vector in zip(part["lang"][known], (vectors / norms)[known]):
                    sums[lang] = sums.get(lang, 0.0) + vector.astype("float64")
        # Without a letter in a task's texts there is nothing to add, and no type for its vectors.
        if sums:
            yield pd.DataFrame({"lang": list(sums), "vector": [v.tolist() for v in sums.values()]})

    partial = chosen.select("lang", "text").mapInPandas(bundle, "lang string, vector array<double>")
    each = partial.select("lang", F.posexplode("vector").alias("at", "x")).groupBy("lang", "at").agg(F.sum("x").alias("x"))
    rows = each.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("at", "x"))).alias("v")).collect()
    return {r["lang"]: [x for _, x in r["v"]] for r in rows}


def _predictor(profiles: dict[str, list[float]], dimension: int, n: int, seed: int) -> Callable[[pa.RecordBatch], tuple[np.ndarray, np.ndarray]]:
    """Language and score of every row of a batch with a column ``text``."""
    names = sorted(profiles)
    matrix = np.asarray([profiles[x] for x in names], dtype=np.float64).reshape(len(names), dimension)
    matrix = (matrix / np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-12)).astype(np.float32)
    labels = np.asarray([*names, UNKNOWN], dtype=object)

    def predict(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        texts = batch.column("text").to_pylist()
        vectors, known = document_vectors(["" if t is None else t for t in texts], dimension, n, seed)
        if not names:
            return labels[np.zeros(batch.num_rows, dtype="int64")], np.zeros(batch.num_rows)
        cosines = (vectors @ matrix.T) / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)
        best = np.where(known, cosines.argmax(axis=1), len(names))
        return labels[best], np.where(known, np.clip(cosines.max(axis=1), 0.0, 1.0), 0.0)

    return predict


def identify(docs: DataFrame, profiles: dict[str, list[float]], dimension: int = DIMENSION, n: int = NGRAM, seed: int = SEED) -> DataFrame:
    """doc_id, ``lang_pred`` and ``score`` of every row of ``docs``.

    The score is the cosine with the best profile, 0 at least. A null text or one without a
    letter is ``und`` with score 0, and so is everything where no profile was learned.
    Of languages with equal cosines the first by name is taken. Whole texts are
    read; rows are independent, so repeated rows get equal results. Null ids stay null, no rows give
    none, other columns are ignored.
    """
    predict = _predictor(profiles, dimension, n, seed)

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrow_slices(batches, "text", TEXT_BATCH):
            lang, score = predict(batch)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "lang_pred", "score"])

    rows = docs.select("doc_id", "text")
    return rows.mapInArrow(label, T.StructType([rows.schema["doc_id"], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]))


def with_language(docs: DataFrame, profiles: dict[str, list[float]], dimension: int = DIMENSION, n: int = NGRAM, seed: int = SEED) -> DataFrame:
    """The rows of ``docs`` that ``identify`` doesn't call ``und``, with all their columns, whatever their names.

    Texts go to Python and back once. Repeated rows stay or go together; no rows give none.
    """
    predict = _predictor(profiles, dimension, n, seed)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrow_slices(batches, "text", TEXT_BATCH):
            yield batch.filter(pa.array(predict(batch)[0] != UNKNOWN, pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)


def fit_on(held_out: Column, docs: DataFrame) -> dict[str, list[float]]:
    """Profiles from the documents that aren't ``held_out`` and have a ``lang``."""
    return language_profiles(docs.where(~held_out))
