"""Document fingerprints by winnowing, in column expressions only.

Words are hashed; k of them in a row make a gram, whose polynomial hash is rolled up by
doubling (1, 2, 4 ... words), so no gram is hashed from its text. Of every window of w
grams the smallest hash is kept, the rightmost of equal ones, with its position. Any run of
``w + k - 1`` words that two texts share leaves at least one gram in both
fingerprints: the match guarantee of winnowing.

Every step is a projection of its own: a step is used more than once by the next one, and
Spark evaluates a projection's columns once.
"""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pitchframe.plans.scratch import written

#: Words of a gram and grams of a window, powers of two.
GRAM_WORDS = 4
WINDOW_GRAMS = 8
#: Gram hashes are below this prime; a hash and a position share a 64-bit integer.
PRIME = (1 << 38) - 45
BASE = 9_223_373
FACTORS = (1 << 24) - 3
POSITION_BITS = 24
_POSITIONS = 1 << POSITION_BITS
_SPACE = r"[\x20\x09-\x0D]+"
#: Documents of a block that are put in order together, and blocks at most.
BLOCK_ROWS = 4_096
KNOTS = 64
MAX_BLOCKS_PER_KNOT = 1_024


def _pairs(column: str, apart: int, combine: Callable[..., Column]) -> Column:
    """``combine`` of every element and the one ``apart`` places behind it; none if there are fewer."""
    n = F.greatest(F.size(column) - apart, F.lit(0))
    return F.zip_with(F.slice(column, F.lit(1), n), F.slice(column, F.lit(apart + 1), n), combine)


def _joined(factor: int) -> Callable[[Column, Column], Column]:
    """The hash of two halves; the factor leaves room for it in 64 bits."""
    return lambda left, right: (left * F.lit(factor) + right) % F.lit(PRIME)


def with_picks(df: DataFrame, text: str, picks: str, gram_words: int = GRAM_WORDS, window_grams: int = WINDOW_GRAMS) -> DataFrame:
    """``df`` with ``picks``: the kept grams in order, as ``hash << 24 | reversed position``.

    A text of fewer than k words has one gram, all its words; one without words has none.
    Fewer than w grams are one window. Positions count words and repeat after 2^24 of them.
    """
    words = F.filter(F.split(F.col(text), _SPACE), lambda w: w != "")
    df = df.withColumn("__words", words)
    df = df.withColumn("__hash", F.transform("__words", lambda w: F.pmod(F.xxhash64(w), F.lit(PRIME))))
    df = df.withColumn("__gram", F.col("__hash"))
    width, factor = 1, BASE
    while width < gram_words:
        df = df.withColumn("__gram", _pairs("__gram", width, _joined(factor)))
        width, factor = 2 * width, factor * factor % FACTORS
    whole = F.array(F.pmod(F.xxhash64(F.array_join("__words", " ")), F.lit(PRIME)))
    few = (F.size("__words") > 0) & (F.size("__words") < gram_words)
    df = df.withColumn("__gram", F.when(few, whole).otherwise(F.col("__gram"))).drop("__words", "__hash")
    placed = F.transform("__gram", lambda h, i: h * F.lit(_POSITIONS) + (F.lit(_POSITIONS - 1) - i % F.lit(_POSITIONS)))
    df = df.withColumn("__placed", placed).withColumn("__low", F.col("__placed"))
    width = 1
    while width < window_grams:
        df = df.withColumn("__low", _pairs("__low", width, lambda a, b: F.least(a, b)))
        width *= 2
    one_window = (F.size("__placed") > 0) & (F.size("__placed") < window_grams)
    low = F.when(one_window, F.array(F.array_min("__placed"))).otherwise(F.array_distinct("__low"))
    return df.withColumn(picks, low).drop("__gram", "__placed", "__low")


def pick_hash(pick: Column) -> Column:
    return F.shiftright(pick, POSITION_BITS)


def as_text(picks: Column) -> Column:
    """``position:hash`` of every pick, in order; empty for a text without words."""
    place = lambda x: F.lit(_POSITIONS - 1) - x.bitwiseAND(F.lit(_POSITIONS - 1))
    return F.array_join(F.transform(picks, lambda x: F.concat(place(x).cast("string"), F.lit(":"), F.hex(pick_hash(x)))), ",")


def likeness(a: str, b: str) -> Column:
    """Shared among all different gram hashes of two columns of them; 1 if neither has any."""
    common = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - common
    return F.when(union == 0, F.lit(1.0)).otherwise(common / union)


def _blocks(docs: DataFrame) -> tuple[Callable[[DataFrame], DataFrame], DataFrame]:
    """What adds a ``block`` that grows with ``doc_id``, and per block its first id and the block before.

    Quantiles cut the ids into stretches of about equally many, and quantiles of its own cut each
    stretch into blocks, however its ids are spread: at most 65,536 blocks, so the cuts
    and the list of first ids can be broadcast.
    """
    steps = [i / KNOTS for i in range(1, KNOTS)]
    count, low, high, cuts = docs.agg(F.count("doc_id"), F.min("doc_id"), F.max("doc_id"), F.percentile_approx("doc_id", steps, 10_000)).first()
    knots = sorted({low, *(cuts or []), high} - {None}) or [0]
    cells = min(MAX_BLOCKS_PER_KNOT, max(1, -(-count // (KNOTS * BLOCK_ROWS))))
    at = F.size(F.filter(F.array(*[F.lit(k) for k in knots]), lambda k: k <= F.col("doc_id")))
    stretch = F.when(F.col("doc_id").isNull(), F.lit(-1)).otherwise(at).cast("long")
    if cells > 1:
        inner = [i / cells for i in range(1, cells)]
        inside = docs.where("doc_id IS NOT NULL").groupBy(at.cast("long").alias("stretch"))
        inside = written(inside.agg(F.percentile_approx("doc_id", inner, 10_000).alias("cuts")), "stretches")

    def place(rows: DataFrame) -> DataFrame:
        if cells == 1:
            return rows.withColumn("block", stretch)
        rows = rows.withColumn("stretch", stretch).join(F.broadcast(inside), "stretch", "left")
        cell = F.coalesce(F.size(F.filter("cuts", lambda cut: cut <= F.col("doc_id"))), F.lit(0))
        return rows.withColumn("block", F.col("stretch") * cells + F.when(F.col("doc_id").isNull(), F.lit(0)).otherwise(cell)).drop("stretch", "cuts")

    firsts = place(docs.select("doc_id")).groupBy("block").agg(F.min("doc_id").alias("first_id"))
    order = Window.orderBy("block")
    last = F.max("block").over(Window.partitionBy())
    firsts = firsts.select("first_id", F.coalesce(F.lag("block").over(order), last).alias("block_before"))
    return place, written(firsts, "firsts")


def with_next(docs: DataFrame, columns: list[str]) -> DataFrame:
    """``docs`` (doc_id, text, ...) with ``next_<column>`` of the row that follows by ``doc_id``; the first follows the last.

    Rows are ordered within blocks of ids; each block also gets a copy of the first row
    of the next one. Rows with equal ids follow each other in order of their text, those
    without id come first.
    """
    place, firsts = _blocks(docs.select("doc_id"))
    placed = place(docs).join(F.broadcast(firsts), F.col("doc_id").eqNullSafe(F.col("first_id")), "left")
    home = F.struct(F.col("block").alias("block"), F.lit(False).alias("guest"))
    guest = F.struct(F.col("block_before").alias("block"), F.lit(True).alias("guest"))
    copies = F.explode(F.when(F.col("block_before").isNull(), F.array(home)).otherwise(F.array(home, guest)))
    spread = placed.select(*docs.columns, copies.alias("at")).select(*docs.columns, "at.block", "at.guest")
    order = Window.partitionBy("block").orderBy("guest", "doc_id", "text")
    following = spread.select("*", *[F.lead(c).over(order).alias(f"next_{c}") for c in columns])
    return following.where(~F.col("guest")).drop("block", "guest")


def fingerprints(docs: DataFrame, gram_words: int = GRAM_WORDS, window_grams: int = WINDOW_GRAMS) -> DataFrame:
    """Fingerprint of every text and of its edited form, and how alike they are.

    A null text is empty; an empty text has the fingerprint '' and is wholly like another
    empty one. A single row is followed by itself. Repeated rows give repeated results, each
    compared with its own follower. No documents give no rows; other columns are ignored.
    """
    sizes = gram_words, window_grams
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    rows = with_picks(rows, "text", "picks", *sizes)
    rows = with_next(rows, ["text", "picks"])
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - half), F.substring("next_text", F.lit(1), half))
    rows = rows.select("doc_id", n.cast("long").alias("n_chars"), "picks", "next_picks", edited.alias("edited"))
    rows = with_picks(rows, "edited", "edited_picks", *sizes)
    for name in ("picks", "next_picks", "edited_picks"):
        rows = rows.withColumn(f"{name}_hashes", F.array_distinct(F.transform(name, pick_hash)))
    return rows.select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        as_text(F.col("picks")).alias("fingerprint"),
        as_text(F.col("edited_picks")).alias("edited_fingerprint"),
        likeness("picks_hashes", "edited_picks_hashes").alias("near_edited"),
        likeness("picks_hashes", "next_picks_hashes").alias("near_next"),
    )
