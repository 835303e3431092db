"""Fill-in-the-middle documents: a text cut at two units and put together in another order.

A unit is a word with the white space before it, or the white space that ends a text. A
text is read as UTF-8 bytes in blocks of fixed length; of each block, the unit ends and
the code points are counted, and a Fenwick tree over the blocks holds both counts. The place
where the k-th unit ends is found by descending the tree in halving steps to its block, and by
looking into that block alone; the tree's sums on the way give the code points before it.

The order of the parts is a Spark expression of its own (``assembled``), and so is the way back
(``restored``): both stay in the JVM.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pitchframe.llm.common import arrow_slices

SEED = 42
#: Percent of the texts that are cut, and percent of these that begin with the suffix.
CUT_PERCENT, SUFFIX_FIRST_PERCENT = 50, 80
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
BLOCK_BYTES = 4096
TEXT_BATCH = 4_000_000
_CUTS = "units long, prefix_chars long, middle_chars long, prefix_bytes long, middle_bytes long"

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


class Fenwick:
    """Running sums over blocks of two counts, the first of which is searched."""

    def __init__(self, counts: np.ndarray):
        """``counts``: one row per block; every node holds the rows from the one after its parent on."""
        self.tree = np.zeros((len(counts) + 1, counts.shape[1]), dtype="int64")
        self.tree[1:] = counts
        step = 1
        while step < len(self.tree):
            # Nodes at odd multiples of a step hand their sums to the node one step further.
            giving = np.arange(step, len(self.tree) - step, 2 * step)
            self.tree[giving + step] += self.tree[giving]
            step *= 2

    def total(self) -> np.ndarray:
        return self.below(len(self.tree) - 1)

    def below(self, block: int) -> np.ndarray:
        """Sums of the first ``block`` blocks."""
        out = np.zeros(self.tree.shape[1], dtype="int64")
        while block:
            out += self.tree[block]
            block &= block - 1
        return out

    def find(self, k: int) -> tuple[int, np.ndarray]:
        """The block that holds the k-th (from 1), and the sums of the blocks before it."""
        block, before = 0, np.zeros(self.tree.shape[1], dtype="int64")
        step = 1 << (len(self.tree) - 1).bit_length()
        while step:
            ahead = block + step
            if ahead < len(self.tree) and before[0] + self.tree[ahead, 0] < k:
                block, before = ahead, before + self.tree[ahead]
            step >>= 1
        return block, before


class Units:
    """The units of one text, counted by block."""

    def __init__(self, raw: bytes, block_bytes: int = BLOCK_BYTES):
        self.raw, self.block_bytes = raw, block_bytes
        blocks = -(-len(raw) // block_bytes)
        counts = np.zeros((blocks, 2), dtype="int64")
        for b in range(blocks):
            ends, starts = self._marks(b)
            counts[b] = np.count_nonzero(ends), np.count_nonzero(starts)
        self.tree = Fenwick(counts)
        self.n, self.chars = map(int, self.tree.total())

    def _marks(self, block: int) -> tuple[np.ndarray, np.ndarray]:
        """Of a block's bytes: which end a unit, and which begin a code point."""
        start = block * self.block_bytes
        data = np.frombuffer(self.raw, dtype=np.uint8, count=min(self.block_bytes, len(self.raw) - start), offset=start)
        space = _SPACE[data]
        after = start + len(data)
        follows = np.append(space[1:], after == len(self.raw) or bool(_SPACE[self.raw[after]]))
        ends = ~space & follows
        if after == len(self.raw):
            ends[-1] = True
        return ends, (data & 0xC0) != 0x80

    def cut(self, k: int) -> tuple[int, int]:
        """Bytes and code points of the first ``k`` units."""
        if k == 0:
            return 0, 0
        block, before = self.tree.find(k)
        ends, starts = self._marks(block)
        at = int(np.flatnonzero(ends)[k - before[0] - 1])
        return block * self.block_bytes + at + 1, int(before[1] + np.count_nonzero(starts[: at + 1]))


def draw(number: int, seed: int = SEED) -> Column:
    """The ``number``-th 32-bit draw (from 0) of a document; a null id draws like an empty one."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    return F.conv(F.substring(digest, 8 * number + 1, 8), 16, 10).cast("long")


def planned(docs: DataFrame, seed: int = SEED, cut_percent: int = CUT_PERCENT, suffix_first_percent: int = SUFFIX_FIRST_PERCENT) -> DataFrame:
    """``doc_id``, ``text`` (null: empty), ``form`` and the two draws of every document."""
    text = F.coalesce(F.col("text"), F.lit(""))
    marked = F.lit(False)
    for mark in (PREFIX, SUFFIX, MIDDLE):
        marked = marked | F.contains(text, F.lit(mark))
    plain = (text == "") | marked | (draw(2, seed) % 100 >= cut_percent)
    form = F.when(plain, "plain").when(draw(3, seed) % 100 < suffix_first_percent, "spm").otherwise("psm")
    return docs.select("doc_id", text.alias("text"), form.alias("form"), draw(0, seed).alias("first"), draw(1, seed).alias("second"))


def cut_places(plan: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``plan`` with ``units`` of every text and the lengths of prefix and middle, null in plain ones."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrow_slices(batches, "text", TEXT_BATCH):
            rows = []
            columns = [batch.column(c).to_pylist() for c in ("form", "first", "second")]
            for text, form, first, second in zip(batch.column("text").cast(pa.binary()), *columns):
                units = Units(text.as_py(), block_bytes)
                if form == "plain":
                    rows.append((units.n, None, None, None, None))
                    continue
                low, high = sorted((first % (units.n + 1), second % (units.n + 1)))
                (a, a_chars), (b, b_chars) = units.cut(low), units.cut(high)
                rows.append((units.n, a_chars, b_chars - a_chars, a, b - a))
            added = [pa.array(x, pa.int64()) for x in zip(*rows)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], names=[*batch.schema.names, *names])

    schema = T.StructType([*plan.schema.fields, *T.StructType.fromDDL(_CUTS).fields])
    names = [f.name for f in T.StructType.fromDDL(_CUTS)]
    return plan.mapInArrow(cut, schema)


def assembled() -> Column:
    """The text of a document in its ``form``, cut at its byte lengths."""
    raw = F.col("text").cast("binary")

    def part(start: Column, length: Column | None = None) -> Column:
        piece = F.substr(raw, (start + 1).cast("int"), length.cast("int")) if length is not None else F.substr(raw, (start + 1).cast("int"))
        return piece.cast("string")

    prefix = part(F.lit(0), F.col("prefix_bytes"))
    middle = part(F.col("prefix_bytes"), F.col("middle_bytes"))
    suffix = part(F.col("prefix_bytes") + F.col("middle_bytes"))
    p, s, m = F.lit(PREFIX), F.lit(SUFFIX), F.lit(MIDDLE)
    return (
        F.when(F.col("form") == "psm", F.concat(p, prefix, s, suffix, m, middle))
        .when(F.col("form") == "spm", F.concat(s, suffix, p, prefix, m, middle))
        .otherwise(F.col("text"))
    )


def restored() -> Column:
    """The original text, from ``output`` and ``form`` alone.

    A text that is cut holds no marker, and no part of it can complete one with its neighbour.
    """
    parts = F.split(F.col("output"), f"{PREFIX}|{SUFFIX}|{MIDDLE}")
    return (
        F.when(F.col("form") == "psm", F.concat(parts[1], parts[3], parts[2]))
        .when(F.col("form") == "spm", F.concat(parts[2], parts[3], parts[1]))
        .otherwise(F.col("output"))
    )


def fill_in_middle(docs: DataFrame, seed: int = SEED, cut_percent: int = CUT_PERCENT, suffix_first_percent: int = SUFFIX_FIRST_PERCENT, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n (units), form, prefix_chars, middle_chars and ``output`` of every row of ``docs``.

    A null text counts as empty; an empty text, or one with a marker in it, is plain. Draws come
    from the seed and the id, so rows of one id draw alike, repeated rows give repeated results and
    reruns agree; a null id draws like the empty one. Whole texts are read, however long. No
    rows give none; other columns are ignored.
    """
    cuts = cut_places(planned(docs, seed, cut_percent, suffix_first_percent), block_bytes)
    return cuts.select("doc_id", F.col("units").alias("n"), "form", "prefix_chars", "middle_chars", assembled().alias("output"))
