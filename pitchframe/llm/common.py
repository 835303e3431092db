"""Small helpers the operators share."""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of the contracts: runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


#: Two hashes of a row's contents, 128 bits.
ROW = ("row_a", "row_b")


def row_key(*columns: str) -> list[Column]:
    """Tells rows of one id and different contents apart; a null isn't an empty text."""
    values = [x for c in columns for x in (F.col(c).isNull(), F.coalesce(F.col(c), F.lit("")))]
    return [F.xxhash64(F.lit(i), *values).alias(name) for i, name in enumerate(ROW)]


def crc32_bucket(key: str, modulus: int) -> Column:
    """crc32 of the key written as text, modulo ``modulus`` (a null key gives null)."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % F.lit(modulus)


#: Stands for a null id where rows pass through pandas, which has no null integers.
NO_ID = -(1 << 63)


def filled_id(name: str = "doc_id") -> Column:
    return F.coalesce(F.col(name).cast("long"), F.lit(NO_ID)).alias(name)


def restored_id(name: str = "doc_id") -> Column:
    return F.nullif(F.col(name), F.lit(NO_ID)).alias(name)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of unsigned 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def text_slices(batches: Iterator[pd.DataFrame], column: str, limit: int) -> Iterator[pd.DataFrame]:
    """The same rows in frames of about ``limit`` characters of ``column``, at least one row each."""
    for frame in batches:
        sizes = frame[column].str.len().fillna(0).to_numpy(dtype="int64")
        start, total = 0, 0
        for i, n in enumerate(sizes):
            if i > start and total + n > limit:
                yield frame.iloc[start:i]
                start, total = i, 0
            total += n
        if start < len(frame):
            yield frame.iloc[start:]


def arrow_slices(batches: Iterator[pa.RecordBatch], column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``limit`` bytes of the text ``column``, at least one row each."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        start, total = 0, 0
        for i, n in enumerate(sizes.tolist()):
            if i > start and total + n > limit:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += n
        if start < batch.num_rows:
            yield batch.slice(start)


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype="uint64", count=len(words))


class RunHashes:
    """Hashes of runs of consecutive items in O(1) each, from one pass over the items' hashes.

    Polynomials modulo 2^64: a running sum of ``hash x base^i``, and a run's part of it
    divided by the power it starts with.
    """

    _BASE = 0x9E3779B97F4A7C15
    _INVERSE = pow(_BASE, -1, 1 << 64)
    _powers = _inverses = np.ones(1, dtype="uint64")

    def __init__(self, hashes: np.ndarray):
        cls = type(self)
        if len(cls._powers) <= len(hashes):
            n = 2 * len(hashes) + 1024
            for name, base in (("_powers", cls._BASE), ("_inverses", cls._INVERSE)):
                steps = np.full(n, base, dtype="uint64")
                steps[0] = 1
                setattr(cls, name, np.cumprod(steps))
        self._sums = np.zeros(len(hashes) + 1, dtype="uint64")
        np.cumsum(hashes * cls._powers[: len(hashes)], out=self._sums[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self._sums[end] - self._sums[start]) * self._inverses[start])

    def every(self, length: int) -> np.ndarray:
        """Of every run of ``length`` items, by its start."""
        n = max(0, len(self._sums) - length)
        return mix((self._sums[length : length + n] - self._sums[:n]) * self._inverses[:n])
