"""Self-join of documents by Jaccard similarity of word shingles, with PartEnum signatures.

Two sets are alike when ``100 x |A & B| >= percent x |A | B|``. Sets are put into bands of sizes;
within a band, like sets differ in at most ``k`` elements. The domain of shingles is
split by a hash into n1 parts, and each part into n2 smaller ones. Where two sets differ in k
elements at most, some part holds at most k2 of the differences, hence n2 - k2 of its
smaller parts are equal: each such choice of smaller parts gives one signature. Signatures of
like sets thus meet at least once, and every meeting is verified on the whole texts.

A choice that is empty says nothing: sets are to meet in what they share, never in what they
both lack. So there are m parts more than needed. Like sets then have m + 1 parts with few
enough differences, and where they don't meet, both have an empty choice in each of these.
A set with more than m parts with an empty choice is thus the only one that may miss another; it
also gets the signatures of another splitting, and after ``ROUNDS`` of them the first elements in
an order common to all sets, as many as like sets can't differ in (a prefix filter).

Copies are one node, the class of equal sets. Nodes that meet are compared with the smallest
node of the meeting, not with one another; only where nodes of different components
remain in a meeting are more of them compared, until none is left, and of these only
those whose sizes and sketches allow a link: a short sketch of every set, then for the pairs
that are left one that grows with the set. The components hold every link; pairs
within a component needn't be listed.
"""
from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pitchframe.llm.common import NO_ID, ROW, RunHashes, arrow_slices, filled_id, mix, restored_id, row_key, text_slices, word_hashes
from pitchframe.plans.scratch import dropped, written

SHINGLE_WORDS = 3
PERCENT = 90
#: Smaller parts of a part, and how many of them may differ.
PARTS, DIFFERENT = 2, 1
#: Largest over smallest size of a band, in percent.
BAND = 150
#: Splittings of a set before its signatures are single elements.
ROUNDS = 6
TEXT_BATCH = 2_000_000

#: Bits of a set's sketch, 64 to a word. Leaders of a meeting grow by this factor per round.
SKETCH_WORDS = 8
MORE_LEADERS = 16

#: Groups of nodes by hash, of which those that pairs name are broadcast.
NODE_GROUPS = 1 << 18

_NODE = ["doc_id", *ROW]
_SETS = "doc_id long, row_a long, row_b long, n_shingles long, d1 long, d2 long, sketch array<long>, fine binary"
#: Sets whose signatures a task has given out and won't give out again, at most.
REMEMBERED = 200_000


def shingle_set(text: str, shingle_words: int = SHINGLE_WORDS) -> np.ndarray:
    """Sorted distinct hashes of the shingles of a text, A-Z lower-cased."""
    words = text.encode("utf-8").lower().split()
    if not words:
        return np.empty(0, dtype="uint64")
    return np.unique(RunHashes(word_hashes(words)).every(min(shingle_words, len(words))))


def band_limits(size: int, percent: int = PERCENT, band: int = BAND) -> list[tuple[int, int]]:
    """(number, largest size) of the bands a set of ``size`` has signatures in.

    Its own, and the next ones as far as a like set may be large enough for them.
    """
    number, top = 0, 1
    while top < size:
        number, top = number + 1, max(top + 1, top * band // 100)
    out = [(number, top)]
    while 100 * size >= percent * (top + 1):
        number, top = number + 1, max(top + 1, top * band // 100)
        out.append((number, top))
    return out


def most_different(top: int, percent: int = PERCENT) -> int:
    """Elements in which two like sets of at most ``top`` elements can differ.

    |A ^ B| <= (1 - s) |A | B| and (1 + s) |A | B| <= |A| + |B|.
    """
    return (100 - percent) * 2 * top // (100 + percent)


@lru_cache(maxsize=4096)
def spare_parts(top: int, percent: int, parts: int, different: int, band: int) -> int | None:
    """Parts beyond those needed, so that few sets of the band have more with an empty choice.

    Reckoned for the smallest sets of the band; None if more would be needed than are spared.
    """
    needed, least = most_different(top, percent) // (different + 1) + 1, max(1, top * percent // band)
    spare = 0
    while spare <= needed:
        empty = math.exp(-least / ((needed + spare) * parts))
        share = sum(math.comb(parts, e) * empty**e * (1 - empty) ** (parts - e) for e in range(parts - different, parts + 1))
        many = (needed + spare) * share
        if many + math.sqrt(many) < spare + 1:
            return spare
        spare = int(many + math.sqrt(many))
    return None


def signatures(shingles: np.ndarray, percent: int = PERCENT, parts: int = PARTS, different: int = DIFFERENT, band: int = BAND) -> np.ndarray:
    """The signatures of a set, as unsigned 64-bit integers; an empty set has none."""
    out: list[np.ndarray] = []
    for number, top in band_limits(len(shingles), percent, band) if len(shingles) else []:
        k = most_different(top, percent)
        few = min(different, k)
        for again in range(ROUNDS):
            split = parts + again if few else 1
            spare = spare_parts(top, percent, split, few, band)
            if spare is None:
                continue
            found, empty = _enumerate(shingles, k // (few + 1) + 1 + spare, split, few, number * 64 + again + 1)
            out.append(found)
            if empty <= spare:
                break
        else:
            # Like sets share percent of the larger one, so two such prefixes can't be disjoint.
            least = -(-percent * len(shingles) // 100)
            out.append(np.sort(mix(shingles ^ mix(np.asarray([number * 64], dtype="uint64"))))[: len(shingles) - least + 1])
    return np.unique(np.concatenate(out)) if out else np.empty(0, dtype="uint64")


def _enumerate(shingles: np.ndarray, first: int, parts: int, different: int, number: int) -> tuple[np.ndarray, int]:
    """Signatures of the choices that hold an element, and how many of the ``first`` parts have one that doesn't."""
    salt = mix(np.asarray([number], dtype="uint64"))
    mixed = mix(shingles ^ salt)
    cell = (mixed % np.uint64(first * parts)).astype("int64")
    sums, counts = np.zeros(first * parts, dtype="uint64"), np.bincount(cell, minlength=first * parts)
    np.add.at(sums, cell, mix(mixed + salt))
    sums, counts = sums.reshape(first, parts), counts.reshape(first, parts)
    keys = np.arange(first, dtype="uint64") << np.uint64(16)
    out, whole = [], np.ones(first, dtype=bool)
    for choice, members in enumerate(combinations(range(parts), parts - different)):
        held = np.zeros(first, dtype="uint64")
        for m in members:
            held = mix(held + sums[:, m])
        full = counts[:, list(members)].sum(axis=1) > 0
        whole &= full
        out.append(mix(held ^ mix(keys + np.uint64(choice) + salt))[full])
    return np.concatenate(out), int(first - whole.sum())


def parity_sketch(shingles: np.ndarray) -> np.ndarray:
    """For each of the sketch's bits, whether an odd number of elements falls on it.

    An element that only one of two sets has turns one bit, so sketches differ in at most as
    many bits as the sets in elements.
    """
    return _parities(shingles, 64 * SKETCH_WORDS).view("int64")


def _parities(shingles: np.ndarray, cells: int) -> np.ndarray:
    odd = np.bincount((shingles >> np.uint64(20)).astype("int64") % cells, minlength=cells) & 1
    return np.packbits(odd.astype("uint8"))


def fine_sketch(shingles: np.ndarray) -> bytes | None:
    """The same with a bit for every element or more, a power of two; None where the short sketch has as many.

    The short one can't tell sets apart that may differ in as many elements as half its bits.
    """
    cells = 64 * SKETCH_WORDS
    if len(shingles) <= cells:
        return None
    return _parities(shingles, 1 << (len(shingles) - 1).bit_length()).tobytes()


def sketch_distance(a: bytes | None, b: bytes | None) -> int:
    """Bits in which two fine sketches differ, the longer one folded; 0 if a set has none."""
    if a is None or b is None:
        return 0
    short, long = sorted((np.frombuffer(x, dtype="uint8") for x in (a, b)), key=len)
    while len(long) > len(short):
        long = long[: len(long) // 2] ^ long[len(long) // 2 :]
    return int(np.bitwise_count(short ^ long).sum())


def alike(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> bool:
    small, large = sorted((len(a), len(b)))
    if 100 * small < percent * large:
        return False
    common = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * common >= percent * (len(a) + len(b) - common)


def _rows(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.select(filled_id(), *row_key("text"), text.alias("text"))


def _digest(shingles: np.ndarray, salt: int) -> int:
    return int(mix(shingles ^ np.uint64(salt)).sum(dtype="uint64").view("int64"))


_SALTS = 0xA0761D6478BD642F, 0xE7037ED1A0B428DB


def shingle_table(docs: DataFrame, shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """Set size, a 128-bit digest of the set, and its sketches, for every row."""

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in text_slices(batches, "text", TEXT_BATCH):
            sets = [shingle_set(t, shingle_words) for t in frame["text"]]
            yield pd.DataFrame(
                {
                    "doc_id": frame["doc_id"].to_numpy(),
                    **{c: frame[c].to_numpy() for c in ROW},
                    "n_shingles": [len(s) for s in sets],
                    "d1": [_digest(s, _SALTS[0]) for s in sets],
                    "d2": [_digest(s, _SALTS[1]) for s in sets],
                    "sketch": [parity_sketch(s) for s in sets],
                    "fine": [fine_sketch(s) for s in sets],
                }
            )

    return _rows(docs).mapInPandas(build, _SETS)


def meetings(docs: DataFrame, shingle_words: int = SHINGLE_WORDS, percent: int = PERCENT, parts: int = PARTS, different: int = DIFFERENT, band: int = BAND) -> DataFrame:
    """signature, d1: the sets (by half of their digest) of every signature that different sets have.

    Signatures are shuffled once, in order, and those of one set alone are dropped as they
    pass by. A task gives out the signatures of a set once, however many copies it reads.
    """

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given: set[int] = set()
        for batch in arrow_slices(batches, "text", TEXT_BATCH):
            found, owners = [np.empty(0, dtype="uint64")], []
            for text in batch.column("text").to_pylist():
                shingles = shingle_set(text, shingle_words)
                digest = _digest(shingles, _SALTS[0])
                if digest in given:
                    continue
                if len(given) < REMEMBERED:
                    given.add(digest)
                found.append(signatures(shingles, percent, parts, different, band))
                owners.append(digest)
            d1 = np.repeat(np.asarray(owners, dtype="int64"), [len(f) for f in found[1:]])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view("int64")), pa.array(d1)], names=["signature", "d1"])

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # The last pair seen, and whether it has been passed on.
        last, passed = (np.empty(0, dtype="int64"),) * 2, False
        for batch in batches:
            pairs = [np.append(held, batch.column(c).to_numpy()) for held, c in zip(last, ("signature", "d1"))]
            new = np.append(True, (pairs[0][1:] != pairs[0][:-1]) | (pairs[1][1:] != pairs[1][:-1]))
            signature, d1 = (p[new] for p in pairs)
            same = signature[1:] == signature[:-1]
            several = np.append(False, same) | np.append(same, False)
            out = several.copy()
            if len(last[0]):
                out[0] &= not passed
                several[0] |= passed
            last, passed = (signature[-1:], d1[-1:]), bool(several[-1]) if len(several) else passed
            yield pa.RecordBatch.from_arrays([pa.array(signature[out]), pa.array(d1[out])], names=["signature", "d1"])

    schema = "signature long, d1 long"
    signed = docs.select(F.coalesce("text", F.lit("")).alias("text")).mapInArrow(sign, schema)
    return signed.repartition("signature").sortWithinPartitions("signature", "d1").mapInArrow(shared, schema)


def _named(table: DataFrame, pairs: DataFrame) -> DataFrame:
    """The rows of ``table`` (node, ...) whose nodes ``pairs`` may name, found without a shuffle of them.

    What is broadcast are numbers of groups, ``NODE_GROUPS`` at most; where pairs name nodes of all groups, all rows stay.
    """
    group = lambda c: F.pmod(F.xxhash64(c), F.lit(NODE_GROUPS)).cast("int")
    nodes = pairs.select(F.explode(F.array("lead", "node")).alias("node"))
    groups = nodes.select(group("node").alias("__group")).distinct()
    return table.withColumn("__group", group("node")).join(F.broadcast(groups), "__group", "left_semi").drop("__group")


def _linked(pairs: DataFrame, texts: DataFrame, shingle_words: int, percent: int) -> DataFrame:
    """Those of the ``pairs`` (lead, node) whose whole texts are alike."""
    texts = _named(texts, pairs)
    sides = pairs.join(texts.select(F.col("node"), F.col("text").alias("text")), "node")
    sides = sides.join(texts.select(F.col("node").alias("lead"), F.col("text").alias("lead_text")), "lead")

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, held = None, None
        for frame in batches:
            keep = []
            for lead_text, text in zip(frame["lead_text"], frame["text"]):
                if lead_text != last:
                    last, held = lead_text, shingle_set(lead_text, shingle_words)
                keep.append(alike(held, shingle_set(text, shingle_words), percent))
            yield frame.loc[keep, [f"{side}_{c}" for side in ("lead", "node") for c in _NODE]]

    names = {side: [F.col(f"{side}.{c}").alias(f"{side}_{c}") for c in _NODE] for side in ("lead", "node")}
    flat = sides.select(*names["lead"], *names["node"], "lead_text", "text")
    found = flat.mapInPandas(verify, ", ".join(f"{side}_{c} long" for side in names for c in _NODE))
    return found.select(*[F.struct(*[F.col(f"{side}_{c}").alias(c) for c in _NODE]).alias(side) for side in names])


def components(links: DataFrame) -> DataFrame:
    """node, comp: the smallest node each linked node can be reached from (links: lead, node).

    Every round links a node to the smallest of its neighbours and those again to one another
    (alternating stars), until nothing changes; each round is a table in the shared folder.
    """
    edges = written(links.select("lead", "node").distinct(), "edges")
    while True:
        both = edges.unionByName(edges.select(F.col("node").alias("lead"), F.col("lead").alias("node")))
        # Large star: neighbours above a node move to the smallest node around it.
        least = both.groupBy("lead").agg(F.least(F.min("node"), F.first("lead")).alias("low"))
        large = both.where("node > lead").join(least, "lead").select(F.col("low").alias("lead"), "node").distinct()
        large = written(large, "stars")
        # Small star: a node and its smaller neighbours move to the smallest of them.
        below = large.groupBy("node").agg(F.min("lead").alias("low"))
        moved = large.join(below, "node").select("low", F.explode(F.array("lead", "node")).alias("node"))
        small = written(moved.where("low < node").select(F.col("low").alias("lead"), "node").distinct(), "stars")
        same = F.count("*"), F.sum(F.xxhash64("lead", "node").cast("decimal(38,0)"))
        still = small.agg(*same).first() == edges.agg(*same).first()
        dropped(large, edges)
        if still:
            return small.select("node", F.col("lead").alias("comp"))
        edges = small


def _components_of(docs: DataFrame, shingle_words: int, percent: int, parts: int, different: int, band: int) -> DataFrame:
    """doc_id and ``ROW`` of every document, its set size, and the smallest node of its component."""
    sets = written(shingle_table(docs, shingle_words), "shingle-sets")
    digest = ["d1", "d2", "n_shingles"]
    whose = F.struct(*_NODE)
    classes = sets.where("n_shingles > 0").groupBy(*digest)
    classes = classes.agg(F.min(whose).alias("node"), F.first("sketch").alias("sketch"), F.first("fine").alias("fine"))
    classes = written(classes, "set-classes")
    # The tables have no bound, so all joins sort and merge, at every size.
    several = written(meetings(docs, shingle_words, percent, parts, different, band), "shared-members")
    members = several.join(classes.select("d1", "node").hint("merge"), "d1")
    live = written(members.select("signature", "node"), "meetings")
    dropped(several)

    # Round one: the smallest node of every meeting against the others.
    lead = live.groupBy("signature").agg(F.min("node").alias("lead"), F.max("node").alias("last")).where("lead < last")
    lead = written(lead.select("signature", "lead"), "leads")
    met = live.join(lead.hint("merge"), "signature").where("node > lead").select("lead", "node").distinct()
    met = written(met, "met")
    # Sizes and sketches rule most unlike pairs out before any text is moved.
    marks = classes.select("node", "n_shingles", *[F.col("sketch")[i].alias(f"s{i}") for i in range(SKETCH_WORDS)])
    sides = met.join(marks.hint("merge"), "node")
    leads = marks.withColumnsRenamed({c: f"lead_{c}" for c in marks.columns if c != "node"} | {"node": "lead"})
    pairs = written(sides.join(leads.hint("merge"), "lead").where(_allowed(percent)).select("lead", "node"), "pairs")
    fine = classes.select("node", "n_shingles", "fine")
    pairs = written(_closer(pairs, fine, percent), "pairs")
    # Texts of all that meet: those ruled out here may be compared with others later.
    nodes = met.select(F.explode(F.array("lead", "node")).alias("node")).distinct()
    nodes = nodes.select(*[F.col(f"node.{c}").alias(c) for c in _NODE])
    texts = _rows(docs).join(nodes.hint("merge"), _NODE).dropDuplicates(_NODE)
    texts = written(texts.select(whose.alias("node"), "text"), "meeting-texts")
    links = written(_linked(pairs, texts, shingle_words, percent), "links")
    comps = written(components(links), "components")
    rest = live.join(lead, "signature").where("node > lead").select("signature", "node")
    leaders = 1
    # Where nodes of different components are left that weren't compared yet, more of them lead.
    while not (live := written(_unsettled(rest, comps), "meetings")).isEmpty():
        leaders *= MORE_LEADERS
        rank = F.row_number().over(Window.partitionBy("signature").orderBy("node"))
        ranked = written(live.withColumn("rank", rank).join(marks, "node"), "ranked")
        pairs = written(_possible(ranked, leaders, percent), "pairs")
        pairs = written(_closer(pairs, fine, percent), "pairs")
        # without pairs no text has to move
        if not pairs.isEmpty():
            found = written(_linked(pairs, texts, shingle_words, percent), "links")
            if not found.isEmpty():
                known = comps.select(F.col("comp").alias("lead"), "node").unionByName(found)
                comps = written(components(known), "components")
        rest = ranked.where(F.col("rank") > leaders).select("signature", "node")

    labelled = classes.join(comps.hint("merge"), "node", "left").select(*digest, F.coalesce("comp", "node").alias("comp"))
    out = sets.select(*_NODE, *digest).join(labelled.hint("merge"), digest, "left")
    return out.select(*_NODE, "n_shingles", F.coalesce("comp", whose).alias("comp"))


def _unsettled(members: DataFrame, comps: DataFrame) -> DataFrame:
    """signature, node, comp of the meetings that hold nodes of different components."""
    members = members.join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    several = members.groupBy("signature").agg(F.min("comp").alias("a"), F.max("comp").alias("b")).where("a < b")
    return members.join(written(several.select("signature"), "unsettled"), "signature")


def _allowed(percent: int) -> Column:
    """Whether sizes and sketches of two sets allow a link."""
    small, large = F.least("n_shingles", "lead_n_shingles"), F.greatest("n_shingles", "lead_n_shingles")
    apart = sum((F.bit_count(F.col(f"s{i}").bitwiseXOR(F.col(f"lead_s{i}"))) for i in range(SKETCH_WORDS)), F.lit(0))
    return (100 * small >= percent * large) & ((100 + percent) * apart <= (100 - percent) * (small + large))


def _possible(ranked: DataFrame, leaders: int, percent: int) -> DataFrame:
    """Pairs of a leading node and a later one of another component, as far as sizes and sketches allow a link."""
    sketch = [f"s{i}" for i in range(SKETCH_WORDS)]
    names = {c: f"lead_{c}" for c in ["comp", "n_shingles", *sketch]} | {"node": "lead"}
    lead = ranked.where(F.col("rank") <= leaders).drop("rank").withColumnsRenamed(names)
    meet = (ranked["signature"] == lead["signature"]) & (F.col("node") > F.col("lead")) & (F.col("comp") != F.col("lead_comp"))
    pairs = ranked.join(lead, meet & _allowed(percent))
    return pairs.select("lead", "node").distinct()


def _closer(pairs: DataFrame, fine: DataFrame, percent: int) -> DataFrame:
    """Those of the ``pairs`` (lead, node) whose fine sketches allow a link."""

    @F.pandas_udf("int")
    def apart(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([sketch_distance(x, y) for x, y in zip(a, b)], dtype="int32")

    fine = _named(fine, pairs)
    leads = fine.withColumnsRenamed({c: f"lead_{c}" for c in fine.columns if c != "node"} | {"node": "lead"})
    sides = pairs.join(fine.hint("merge"), "node").join(leads.hint("merge"), "lead")
    near = (100 + percent) * apart("fine", "lead_fine") <= (100 - percent) * (F.col("n_shingles") + F.col("lead_n_shingles"))
    return sides.where(near).select("lead", "node")


def near_duplicates(docs: DataFrame, shingle_words: int = SHINGLE_WORDS, percent: int = PERCENT, parts: int = PARTS, different: int = DIFFERENT, band: int = BAND) -> DataFrame:
    """doc_id, n_shingles, component_id of every document.

    A text of fewer words than a shingle is one shingle, all its words; a null text or one without
    words has an empty set, linked with nothing. Equal sets are linked, also of rows
    with equal ids. Null ids come before all others, and a component with one has a null
    id. Repeated rows give repeated results, no rows give none, other columns are ignored.
    """
    found = _components_of(docs, shingle_words, percent, parts, different, band)
    component = F.nullif(F.col("comp.doc_id"), F.lit(NO_ID))
    return found.select(restored_id(), "n_shingles", component.alias("component_id"))


def one_of_each(docs: DataFrame, shingle_words: int = SHINGLE_WORDS, percent: int = PERCENT, parts: int = PARTS, different: int = DIFFERENT, band: int = BAND) -> DataFrame:
    """The rows of ``docs`` that stay when of each component only the smallest id is kept.

    Repeated rows are copies of each other, so one stays; rows without words all stay.
    """
    found = written(_components_of(docs, shingle_words, percent, parts, different, band).where("n_shingles > 0"), "found")
    names = [f"__near_{c}" for c in _NODE]
    key = [F.col(c).alias(name) for c, name in zip(_NODE, names)]
    leads = F.struct(*_NODE) == F.col("comp")
    gone = written(found.where(~leads).select(*key).distinct(), "gone")
    again = written(found.where(leads).groupBy(*key).count().where("count > 1").select(*names), "repeated")
    # Neither list has a bound, so the documents are sorted and merged with them at every size.
    keyed = docs.withColumns(dict(zip(names, [filled_id(), *row_key("text")])))
    kept = keyed.join(gone.hint("merge"), names, "left_anti")
    if again.isEmpty():
        return kept.select(docs.columns)
    once = kept.join(again.hint("merge"), names, "left_semi").dropDuplicates(names)
    return kept.join(again.hint("merge"), names, "left_anti").unionByName(once).select(docs.columns)
