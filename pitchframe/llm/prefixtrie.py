"""The trie of conversations' common beginnings, what sharing them saves, and who ends where.

A conversation is a path of turns; a node is a distinct sequence of first turns. Paths are sorted
into ranges. A shard, some consecutive paths of a range, is a trie written as balanced
parentheses in preorder. A node's subtree ends at its closing parenthesis (``find_close``, by blocks of
minimal and maximal excess); the rank of the pairs ``()`` gives its leaves, running sums over
the opening parentheses its members and savings.

Sorted paths meet those of other shards only along the first and the last path of the shard. Nodes
off these two spines are done. The spines go on as paths themselves, each node with
what hangs off it in its shard, and are sorted and cut into shards again, until
one shard holds all: a reduction tree that merges shared spines.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pitchframe.llm.common import WORD, mix
from pitchframe.plans.scratch import written

#: A conversation begins with the first turns of the one whose id is the next multiple below; how many, out of so many.
PERIOD, MOST_BORROWED = 20, 4
#: Turns of a shard, and the paths it has at least.
SHARD_TURNS, SHARD_PATHS = 50_000, 8
#: Ids written into one row on the way to a node's digest.
CHUNK_IDS = 1_000
BLOCK = 64
NOBODY = (1 << 63) - 1
EMPTY_SHA256 = hashlib.sha256(b"").hexdigest()

_OWN = ("members", "first", "leaves", "children", "saved")
_NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
_KEYS = "key1 long, key2 long, parent1 long, parent2 long"
_PATH = "path array<struct<a: long, b: long>>, words array<long>, " + ", ".join(f"{c} array<long>" for c in _OWN) + ", ends array<string>"


class Parentheses:
    """Balanced parentheses (True opens) with the excess kept by blocks and a tree over these."""

    def __init__(self, opens: np.ndarray, block: int = BLOCK):
        self.opens, self.block = opens, block
        self.excess = np.cumsum(np.where(opens, 1, -1))
        blocks = -(-len(opens) // block)
        padded = np.append(self.excess, np.full(blocks * block - len(opens), self.excess[-1] if len(opens) else 0))
        self.rows = padded.reshape(blocks, block)
        self.low, self.high = [self.rows.min(axis=1)], [self.rows.max(axis=1)]
        while len(self.low[-1]) > 1:
            if len(self.low[-1]) % 2:
                self.low[-1], self.high[-1] = np.append(self.low[-1], NOBODY), np.append(self.high[-1], -NOBODY)
            self.low.append(self.low[-1].reshape(-1, 2).min(axis=1))
            self.high.append(self.high[-1].reshape(-1, 2).max(axis=1))

    def find_close(self, at: np.ndarray) -> np.ndarray:
        """Where the parentheses opened at ``at`` close."""
        target, block = self.excess[at] - 1, at // self.block
        out = self._inside(block, at % self.block + 1, target)
        left = np.flatnonzero(out < 0)
        node, target = block[left], target[left]
        level = np.full(len(left), -1)
        # Up, until a right sibling reaches the excess looked for.
        for up in range(len(self.low) - 1):
            here = level < 0
            right = np.minimum(node + 1, len(self.low[up]) - 1)
            found = here & (node % 2 == 0) & (self.low[up][right] <= target) & (target <= self.high[up][right])
            level[found], node[found] = up, node[found] + 1
            node = np.where(here & ~found, node // 2, node)
        # Down, to the first block that does.
        for down in range(len(self.low) - 1, 0, -1):
            here = np.flatnonzero(level == down)
            child = 2 * node[here]
            first = (self.low[down - 1][child] <= target[here]) & (target[here] <= self.high[down - 1][child])
            node[here], level[here] = np.where(first, child, child + 1), down - 1
        out[left] = self._inside(node, np.zeros(len(left), dtype="int64"), target)
        return out

    def _inside(self, block: np.ndarray, start: np.ndarray, target: np.ndarray) -> np.ndarray:
        """The first place of ``block`` from ``start`` on with the excess ``target``, else -1."""
        out = np.full(len(block), -1)
        for i in range(0, len(block), 8192):
            part = slice(i, i + 8192)
            hit = (self.rows[block[part]] == target[part, None]) & (np.arange(self.block) >= start[part, None])
            place = hit.argmax(axis=1)
            out[part] = np.where(hit.any(axis=1), block[part] * self.block + place, -1)
        return out


class ShardTrie:
    """The trie of sorted paths. Nodes are numbered in preorder; positions are (path, depth) in order."""

    def __init__(self, lengths: np.ndarray, a: np.ndarray, b: np.ndarray):
        n = len(lengths)
        offset = np.cumsum(lengths) - lengths
        # Turns a path shares with the one before it.
        self.shared = np.full(n, -1)
        common = np.minimum(lengths[1:], lengths[:-1])
        path = np.repeat(np.arange(1, n), common)
        j = np.arange(len(path)) - np.repeat(np.cumsum(common) - common, common)
        here, before = offset[path] + j, offset[path - 1] + j
        unlike = np.flatnonzero((a[here] != a[before]) | (b[here] != b[before]))
        self.shared[1:] = common
        first_path, first_at = np.unique(path[unlike], return_index=True)
        self.shared[first_path] = j[unlike][first_at]

        size = lengths + 1
        self.start = np.cumsum(size) - size
        path = np.repeat(np.arange(n), size)
        depth = np.arange(len(path)) - self.start[path]
        fresh = depth > self.shared[path]
        # A place that isn't fresh has the node of the last fresh one of its depth.
        order = np.argsort(depth, kind="stable")
        base = depth[order] * (len(path) + 1)
        node = np.maximum.accumulate(np.where(fresh, np.cumsum(fresh) - 1, -1)[order] + base) - base
        self.node = np.empty_like(node)
        self.node[order] = node
        places = np.flatnonzero(fresh)
        self.depth, self.place = depth[places], places
        self.parent = np.where(self.depth > 0, self.node[np.maximum(places - 1, 0)], -1)
        # Word counts stand one per turn: a place of depth d has the d-th turn of its path.
        self.turn = np.where(self.depth > 0, places - path[places] - 1, -1)

        opens = lengths - self.shared
        closes = np.append(lengths[:-1] - self.shared[1:], lengths[-1:] + 1)
        runs = np.stack([opens, closes], axis=1).ravel()
        self.bp = Parentheses(np.repeat(np.tile([True, False], n), runs))
        self.opened = np.flatnonzero(self.bp.opens)
        self.closed = self.bp.find_close(self.opened)
        #: The number of nodes opened when a node is closed, itself and its subtree included.
        self.stop = np.cumsum(self.bp.opens)[self.closed]

    def path_nodes(self, path: int, length: int) -> np.ndarray:
        return self.node[self.start[path] : self.start[path] + length + 1]

    def gathered(self, values: np.ndarray, how: np.ufunc, empty: int) -> np.ndarray:
        """The values of all places of a node, taken together."""
        out = np.full(len(self.depth), empty, dtype="int64")
        how.at(out, self.node, values)
        return out

    def subtree_sums(self, values: np.ndarray) -> np.ndarray:
        running = np.append(0, np.cumsum(values))
        return running[self.stop] - running[:-1]

    def subtree_leaves(self, leaf: np.ndarray) -> np.ndarray:
        """Pairs ``()`` of nodes that are a ``leaf``, by the difference of ranks."""
        pair = np.zeros(len(self.bp.opens) + 1, dtype="int64")
        pair[self.opened + 1] = leaf & ~np.append(self.bp.opens, False)[self.opened + 1]
        rank = np.cumsum(pair)
        return rank[self.closed] - rank[self.opened]

    def subtree_least(self, values: np.ndarray, apart: np.ndarray) -> np.ndarray:
        """The least value of a subtree; nodes ``apart`` don't count above themselves."""
        out = values.copy()
        order = np.argsort(-self.depth, kind="stable")
        order = order[(self.depth[order] > 0) & ~apart[order]]
        for level in np.split(order, np.flatnonzero(np.diff(self.depth[order])) + 1):
            np.minimum.at(out, self.parent[level], out[level])
        return out


def _flat(column: pa.Array, kind: str = "int64") -> np.ndarray:
    return pc.list_flatten(column).to_numpy(zero_copy_only=False).astype(kind)


def _prefix_keys(trie: ShardTrie, lengths: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits that tell the node of every place, in every shard."""
    out = []
    turn = np.ones(len(trie.node), dtype=bool)
    turn[trie.start] = False
    depth = np.arange(len(trie.node)) - np.repeat(trie.start, lengths + 1)
    for x in (a, b):
        steps = np.zeros(len(trie.node), dtype="uint64")
        steps[turn] = mix(x.view("uint64") ^ mix(depth[turn].astype("uint64")))
        running = np.cumsum(steps)
        out.append((running - np.repeat(running[trie.start], lengths + 1)).view("int64"))
    return out[0], out[1]


def _reduce_shard(batch: pa.RecordBatch, merged: bool, last: bool) -> pa.RecordBatch:
    """The finished nodes of a shard's trie, and its two spines as paths, unless it is the ``last``.

    ``merged`` says that the paths are spines themselves, whose nodes others may have for a parent.
    """
    column = {name: batch.column(name) for name in batch.schema.names}
    lengths = pc.list_value_length(column["path"]).to_numpy(zero_copy_only=False).astype("int64")
    turns = pc.list_flatten(column["path"])
    a, b = (turns.field(i).to_numpy(zero_copy_only=False).astype("int64") for i in (0, 1))
    words = np.append(_flat(column["words"]), 0)
    own = {c: _flat(column[c]) for c in _OWN}
    ends = np.asarray(pc.list_flatten(column["ends"]).to_pylist(), dtype=object)
    trie = ShardTrie(lengths, a, b)

    first_path, last_path = trie.path_nodes(0, lengths[0]), trie.path_nodes(len(lengths) - 1, lengths[-1])
    spine = np.zeros(len(trie.depth), dtype=bool)
    if not last:
        spine[first_path] = spine[last_path] = True
    held = {c: trie.gathered(own[c], np.add, 0) for c in _OWN if c != "first"}
    local = trie.parent[(trie.depth > 0) & ~spine]
    held["children"] += np.bincount(local, minlength=len(trie.depth))
    n = trie.subtree_sums(held["members"])
    first = trie.subtree_least(trie.gathered(own["first"], np.minimum, NOBODY), spine)
    leaves = trie.subtree_leaves(~spine & (held["children"] == 0)) + trie.subtree_sums(held["leaves"])
    saved = trie.subtree_sums(held["saved"] + np.where(spine, 0, (n - 1) * words[trie.turn]))
    ended = np.full(len(trie.depth), None, dtype=object)
    known = np.flatnonzero(ends != None)  # noqa: E711 - element by element
    ended[trie.node[known]] = ends[known]

    done = np.flatnonzero(~spine)
    parent = trie.parent[done]
    waits = (parent >= 0) & spine[parent]
    keys = _prefix_keys(trie, lengths, a, b)
    table = {
        "conv_id": pa.array(first[done]),
        "depth": pa.array(trie.depth[done]),
        "parent_conv_id": pa.array(first[parent], mask=waits | (parent < 0)),
        "n_convs": pa.array(n[done]),
        "n_children": pa.array(held["children"][done]),
        "n_leaves": pa.array(leaves[done]),
        "saved_tokens": pa.array(saved[done]),
        "ends_sha256": pa.array([EMPTY_SHA256 if x is None else x for x in ended[done]], pa.string()),
        **{f"key{i + 1}": pa.array(k[trie.place[done]], mask=np.full(len(done), not merged)) for i, k in enumerate(keys)},
        **{f"parent{i + 1}": pa.array(k[trie.place[np.maximum(parent, 0)]], mask=~waits) for i, k in enumerate(keys)},
    }
    out = {**{name: pa.array([], t) for name, t in _PATH_TYPES.items()}}
    if not last:
        totals = {"members": n, "leaves": leaves, "saved": saved}
        both = int((first_path[: len(last_path)] == last_path[: len(first_path)]).sum()) if len(lengths) > 1 else len(first_path)
        rows = []
        for which, nodes in [(0, first_path), (len(lengths) - 1, last_path)][: 1 + (len(lengths) > 1)]:
            mine = np.arange(len(nodes)) >= (both if which else 0)
            row = {"children": held["children"][nodes], "first": first[nodes]}
            for name, total in totals.items():
                row[name] = total[nodes].copy()
                row[name][:-1] -= total[nodes[1:]]
                if not which and len(lengths) > 1 and both < len(last_path):
                    row[name][both - 1] -= total[last_path[both]]
            row = {c: np.where(mine, row[c], NOBODY if c == "first" else 0).tolist() for c in _OWN}
            row["ends"] = [x if m else None for x, m in zip(ended[nodes], mine)]
            row |= {c: column[c][which].as_py() for c in ("path", "words")}
            rows.append(row)
        out = {name: pa.array([r[name] for r in rows], t) for name, t in _PATH_TYPES.items()}
    added = len(out["path"])
    columns = [pa.concat_arrays([c, pa.nulls(added, c.type)]) for c in table.values()]
    columns += [pa.concat_arrays([pa.nulls(len(done), c.type), c]) for c in out.values()]
    return pa.RecordBatch.from_arrays(columns, names=[*table, *out])


_PATH_TYPES = {
    "path": pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())])),
    "words": pa.list_(pa.int64()),
    **{c: pa.list_(pa.int64()) for c in _OWN},
    "ends": pa.list_(pa.string()),
}


def _shards(batches: Iterator[pa.RecordBatch], turns: int, least: int) -> Iterator[pa.RecordBatch]:
    """The paths in runs of about ``turns`` places, of ``least`` paths at least while there are that many."""
    held: list[pa.RecordBatch] = []
    paths = places = 0

    def all_held() -> pa.RecordBatch:
        return pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    for batch in batches:
        start = 0
        for i, n in enumerate(pc.list_value_length(batch.column("path")).to_pylist()):
            paths, places = paths + 1, places + n + 1
            if places >= turns and paths >= least:
                held.append(batch.slice(start, i + 1 - start))
                yield all_held()
                held, start, paths, places = [], i + 1, 0, 0
        if start < batch.num_rows:
            held.append(batch.slice(start))
    if held:
        yield all_held()


def rebuilt(conversations: DataFrame, period: int = PERIOD, most: int = MOST_BORROWED) -> DataFrame:
    """conv_id, ``path`` (digests of the turns) and ``words`` of every rebuilt conversation.

    Turns are in order of ``turn``, a null first; those alike in it by digests of role and text.
    """
    text, role = F.coalesce("text", F.lit("")), F.coalesce("role", F.lit(""))
    turn = F.struct(
        F.col("turn"),
        F.struct(*[F.xxhash64(F.lit(i), role, text).alias(c) for i, c in enumerate("ab")]).alias("key"),
        F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0)).alias("words"),
    )
    turns = conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), turn.alias("t"))
    whole = written(turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns")), "conversations")
    heads = whole.where(F.col("conv_id") % period == 0).select(F.col("conv_id").alias("base"), F.slice("turns", 1, most - 1).alias("head"))
    borrowed = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).cast("int")
    rows = whole.withColumn("base", F.col("conv_id") - F.col("conv_id") % period).join(heads, "base", "left")
    head = F.when(F.col("head").isNull(), F.slice("turns", 1, 0)).otherwise(F.slice("head", F.lit(1), borrowed))
    tail = F.slice("turns", borrowed + 1, F.size("turns"))
    rows = rows.select("conv_id", F.concat(head, tail).alias("turns"))
    return rows.select("conv_id", F.col("turns.key").alias("path"), F.col("turns.words").alias("words"))


def endings(paths: DataFrame, chunk_ids: int = CHUNK_IDS) -> DataFrame:
    """``class_id``, the smallest of the conversations with one and the same path, their number, and the
    digest of all their ids.

    Ids are sorted by ranges of (path, id), so that one path's may lie in many tasks. A path that
    lies in one task, within a chunk, is digested there; of others, chunks of ids are joined in order.
    """
    names = ["d1", "d2", "first_id", "n", "ids", "sha"]
    digests = [F.xxhash64(F.lit(i), "path").alias(c) for i, c in enumerate(names[:2])]
    order = ["d1", "d2", "conv_id"]
    sorted_ids = written(paths.select(*digests, "conv_id"), "path-digests").repartitionByRange(*order).sortWithinPartitions(*order)

    def row(key: tuple, ids: np.ndarray, digest: bool) -> dict:
        text = ",".join(map(str, ids.tolist())).encode()
        sha = hashlib.sha256(text).hexdigest() if digest else None
        return dict(zip(names, (*key, int(ids[0]), len(ids), None if digest else text, sha)))

    types = pa.schema([("d1", pa.int64()), ("d2", pa.int64()), ("first_id", pa.int64()), ("n", pa.int64()), ("ids", pa.binary()), ("sha", pa.string())])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, whole = None, np.empty(0, dtype="int64"), False
        for batch in batches:
            out = []
            d1, d2, ids = (batch.column(c).to_numpy() for c in order)
            cuts = np.flatnonzero((d1[1:] != d1[:-1]) | (d2[1:] != d2[:-1])) + 1
            for start, stop in zip([0, *cuts.tolist()], [*cuts.tolist(), len(ids)]):
                if (d1[start], d2[start]) != key:
                    if len(held):
                        out.append(row(key, held, whole))
                    # The first path of a task may have begun in the one before it.
                    whole = key is not None
                    key, held = (int(d1[start]), int(d2[start])), held[:0]
                held = np.append(held, ids[start:stop])
                while len(held) > chunk_ids:
                    out.append(row(key, held[:chunk_ids], False))
                    held, whole = held[chunk_ids:], False
            if out:
                yield pa.RecordBatch.from_pylist(out, types)
        if len(held):
            yield pa.RecordBatch.from_pylist([row(key, held, False)], types)

    schema = "d1 long, d2 long, first_id long, n long, ids binary, sha string"
    parts = written(sorted_ids.mapInArrow(digest, schema), "endings")
    chunks = parts.where("sha IS NULL").repartition("d1", "d2").sortWithinPartitions("d1", "d2", "first_id")

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = state = None
        first = n = 0
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                if (r["d1"], r["d2"]) != key:
                    if state:
                        out.append({"class_id": first, "n": n, "sha": state.hexdigest()})
                    key, state, first, n = (r["d1"], r["d2"]), hashlib.sha256(), r["first_id"], 0
                if n:
                    state.update(b",")
                state.update(r["ids"])
                n += r["n"]
            if out:
                yield pa.RecordBatch.from_pylist(out, joined)
        if state:
            yield pa.RecordBatch.from_pylist([{"class_id": first, "n": n, "sha": state.hexdigest()}], joined)

    joined = pa.schema([("class_id", pa.int64()), ("n", pa.int64()), ("sha", pa.string())])
    whole = parts.where("sha IS NOT NULL").select(F.col("first_id").alias("class_id"), "n", "sha")
    return whole.unionByName(chunks.mapInArrow(join, "class_id long, n long, sha string"))


def trie_nodes(paths: DataFrame, shard_turns: int = SHARD_TURNS, chunk_ids: int = CHUNK_IDS) -> DataFrame:
    """One row per node of the trie of ``paths`` (conv_id, path, words): see ``conversation_trie``."""
    paths = written(paths, "rebuilt")
    ends = endings(paths, chunk_ids).withColumnRenamed("class_id", "conv_id")
    # One path per class of equal ones; equal paths are never dealt to the shards.
    rows = written(paths.join(ends, "conv_id"), "paths")

    def at_end(value: Column | str, otherwise: Column) -> Column:
        value = F.col(value) if isinstance(value, str) else value
        return F.concat(F.array_repeat(otherwise, F.size("path")), F.array(value))

    zero = F.lit(0).cast("long")
    plain = [at_end(zero, zero).alias(c) for c in _OWN if c not in ("members", "first")]
    expanded = ["path", "words", at_end("n", zero).alias("members"), at_end("conv_id", F.lit(NOBODY)).alias("first"), *plain]
    expanded += [at_end("sha", F.lit(None).cast("string")).alias("ends")]
    order = [f.name for f in T.StructType.fromDDL(_PATH)]
    ranges = rows.repartitionByRange("path").sortWithinPartitions("path").select(*expanded).select(*order)

    levels, last = [], False
    while True:
        merged = bool(levels)

        def cut(batches: Iterator[pa.RecordBatch], merged: bool = merged, last: bool = last) -> Iterator[pa.RecordBatch]:
            for shard in _shards(batches, (1 << 62) if last else shard_turns, SHARD_PATHS):
                yield _reduce_shard(shard, merged, last)

        level = written(ranges.mapInArrow(cut, f"{_NODE}, {_KEYS}, {_PATH}"), "trie")
        levels.append(level.where("conv_id IS NOT NULL").drop(*order))
        spines = level.where("conv_id IS NULL").select(*order)
        count, places = spines.agg(F.count("*"), F.coalesce(F.sum(F.size("path") + 1), F.lit(0))).first()
        if not count:
            break
        last = places <= shard_turns or count <= SHARD_PATHS
        if last:
            ranges = spines.coalesce(1).sortWithinPartitions("path")
        else:
            # Enough spines in a range for shards that merge most of them.
            parts = max(1, min(places // shard_turns, count // (4 * SHARD_PATHS)))
            ranges = spines.repartitionByRange(parts, "path").coalesce(parts).sortWithinPartitions("path")

    nodes = reduce(DataFrame.unionByName, levels)
    names = [f.name for f in T.StructType.fromDDL(_NODE)]
    # Children that hang off a spine learn their parent's id once its node is done.
    spine = nodes.where("key1 IS NOT NULL").select((F.col("depth") + 1).alias("depth"), F.col("key1").alias("parent1"), F.col("key2").alias("parent2"), F.col("conv_id").alias("of_parent"))
    waiting = nodes.where("parent1 IS NOT NULL").drop("parent_conv_id").join(spine, ["depth", "parent1", "parent2"])
    return nodes.where("parent1 IS NULL").select(*names).unionByName(waiting.withColumnRenamed("of_parent", "parent_conv_id").select(*names))


def conversation_trie(conversations: DataFrame, period: int = PERIOD, most: int = MOST_BORROWED, shard_turns: int = SHARD_TURNS, chunk_ids: int = CHUNK_IDS) -> DataFrame:
    """conv_id (the smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens
    and ends_sha256 of every node of the trie of rebuilt conversations.

    ``conversations`` has conv_id, turn, role and text. Null roles and texts count as empty;
    turns alike in ``turn`` are ordered by digests of role and text, and a repeated row is
    a turn of its own. Rows without conv_id belong to no conversation and are left out. A conversation
    that is left without turns ends at the root. No rows give no nodes, not even the root; other
    columns are ignored. A task holds the digests of one conversation's turns, or of a shard's.
    """
    return trie_nodes(rebuilt(conversations, period, most), shard_turns, chunk_ids)
