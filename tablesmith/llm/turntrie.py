"""Prefix trie of conversations as balanced parentheses per shard.

A conversation is a path of turns; a turn is the MD5 of its role and text with the text's
length, so no text is shuffled. Conversations are sorted by their turn digests and
conv_id and cut into shards: key ranges, and inside a range blocks of at most ``BLOCK_TURNS``
turns. A shard holds a contiguous piece of the sorted list. Its trie is written as
balanced parentheses, an opening per node in preorder:

* ``RangeMinMax`` keeps the smallest excess of blocks of the sequence in a tree;
  ``findclose`` searches forward through it and delimits a node's subtree;
* the count of "()" pairs up to a position gives the leaves of a subtree as a difference;
* cumulative arrays over the preorder give members and savings of a subtree the same
  way, a sparse table its smallest member.

A node can lie in several shards only if it lies on the path of a shard's first or last
conversation, its spines. Spine nodes are merged by their prefix digest: members add up,
the smallest member is the smallest of all. Subtree sums need no walk up the tree: the
shards follow each other in preorder, so a running total over all spine events (every
opening and closing of a spine node, with what lies off the spines before it) gives a
merged node's sum as the total at its last closing less that at its first opening.

Hot groups: equal conversations differ by conv_id and are cut into as many shards as they
need; their ids travel as comma-joined strings per shard and are hashed in a stream. A
task holds one block and the ids of one shard's node, whatever the size of a group. One
conversation's turn digests (28 bytes a turn) are one value, so a conversation of more
than ``MAX_TURNS`` turns raises an error.

Defined results: rows without conv_id belong to no conversation and are left out; null role
or text counts as empty; a null turn comes first, equal turns are ordered by digest,
and repeated rows are turns of their own; a conversation without turns ends at
the root; an empty table has no members, so no root either; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablesmith.llm.common import stored
from tablesmith.operators.ranking import running_totals

DIGEST = 16
BLOCK_TURNS = 1 << 17
RANGE_TURNS = 1 << 18
MAX_TURNS = 1 << 24
HEADS = 100
HEAD_TURNS = 6
END_IDS = 4096


# --- conversations -----------------------------------------------------------------

def rebuilt(turns: DataFrame, heads: int = HEADS, head_turns: int = HEAD_TURNS) -> DataFrame:
    """(conv_id, turns array<struct<digest,chars>>) of every rebuilt conversation."""
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = turns.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.md5(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text)).alias("digest"),
        F.char_length(text).alias("chars"))
    own = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "digest", "chars"))).alias("own"))
    longest = F.when(F.size("own") > MAX_TURNS, F.raise_error(F.lit(f"a conversation of more than {MAX_TURNS} turns")))
    own = own.select("conv_id", F.coalesce(longest, F.transform("own", lambda t: F.struct(t["digest"], t["chars"]))).alias("own"))
    own = stored(own, "trie-conversations")
    head = own.where(F.col("conv_id") % heads == 0).select(
        F.col("conv_id").alias("head_id"), F.slice("own", 1, head_turns - 1).alias("head"))
    h = F.crc32(F.col("conv_id").cast("string")) % head_turns
    joined = own.withColumn("head_id", F.col("conv_id") - F.col("conv_id") % heads).join(head, "head_id", "left")
    start = F.coalesce(F.slice("head", F.lit(1), h.cast("int")), F.slice("own", 1, 0))
    rest = F.filter("own", lambda t, i: i >= h)
    return joined.select("conv_id", F.concat(start, rest).alias("turns"))


# --- one shard ---------------------------------------------------------------------

class RangeMinMax:
    """Excess of a balanced parenthesis sequence (1 opens, 0 closes), with the smallest excess of its blocks in a
    binary tree whose root is entry 1."""

    def __init__(self, bits: np.ndarray, block: int = 64):
        self.block = block
        blocks = -(-len(bits) // block)
        self.leaves = 1 << max(0, (blocks - 1).bit_length())
        self.excess = np.full(self.leaves * block, np.iinfo(np.int64).max)
        self.excess[:len(bits)] = np.cumsum(bits.astype(np.int64) * 2 - 1)
        self.low = np.empty(2 * self.leaves, dtype=np.int64)
        self.low[self.leaves:] = self.excess.reshape(self.leaves, block).min(axis=1)
        level = self.leaves // 2
        while level:
            self.low[level:2 * level] = self.low[2 * level:4 * level].reshape(level, 2).min(axis=1)
            level //= 2

    def findclose(self, opens: np.ndarray) -> np.ndarray:
        """Position of the closing parenthesis of each opening one: the first later place with a smaller excess."""
        goal = self.excess[opens] - 1
        found = self._scan(opens + 1, goal)
        left = np.flatnonzero(found < 0)
        goal = goal[left]
        node = (opens[left] + 1) // self.block + self.leaves
        climbing = np.arange(len(left))
        while len(climbing):  # up, to the first block range on the right that falls so low
            at = node[climbing]
            hit = (at % 2 == 0) & (self.low[np.minimum(at + 1, len(self.low) - 1)] <= goal[climbing])
            node[climbing] = np.where(hit, at + 1, at // 2)
            climbing = climbing[~hit]
        falling = np.flatnonzero(node < self.leaves)
        while len(falling):  # down, to its first block that does
            at = 2 * node[falling]
            node[falling] = np.where(self.low[at] <= goal[falling], at, at + 1)
            falling = falling[node[falling] < self.leaves]
        found[left] = self._scan((node - self.leaves) * self.block, goal)
        return found

    def _scan(self, start: np.ndarray, goal: np.ndarray) -> np.ndarray:
        """First place with the excess ``goal`` from ``start`` to the end of its block, or -1."""
        found = np.full(len(start), -1)
        index, at = np.arange(len(start)), start.copy()
        stop = (start // self.block + 1) * self.block
        while len(index):
            hit = self.excess[at] == goal[index]
            found[index[hit]] = at[hit]
            on = ~hit & (at + 1 < stop[index])
            index, at = index[on], at[on] + 1
        return found


class RangeMin:
    """Sparse table: smallest value of any range in two look-ups."""

    def __init__(self, values: np.ndarray):
        self.levels = [values]
        while (1 << len(self.levels)) <= len(values):
            last, half = self.levels[-1], 1 << (len(self.levels) - 1)
            self.levels.append(np.minimum(last[:-half], last[half:]))

    def smallest(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        out = np.empty(len(start), dtype=self.levels[0].dtype)
        level = np.frexp((stop - start).astype(float))[1] - 1
        for k in np.unique(level):
            of = level == k
            out[of] = np.minimum(self.levels[k][start[of]], self.levels[k][stop[of] - (1 << int(k))])
        return out


PART = ("kind int, shard long, node long, conv_id long, depth long, n_convs long, n_children long, n_leaves long, "
        "saved long, ends string, parent_conv long, parent_node long, key string, parent_key string, chars long, "
        "o long, c long, leaf_o long, leaf_c long, saved_o long, saved_c long")
NODE, SPINE, ENDS, SHARD = range(4)
COLUMNS = [f.split(" ")[0] for f in PART.split(", ")]


def _common(a: bytes, b: bytes) -> int:
    """Number of equal leading turns of two keys."""
    m = min(len(a), len(b)) // DIGEST
    if a[:m * DIGEST] == b[:m * DIGEST]:
        return m
    x, y = (np.frombuffer(k, dtype=np.uint64, count=2 * m) for k in (a, b))
    return int(np.argmax(x != y)) // 2


def _prefixes(key: bytes) -> list[str]:
    """Digest of every prefix of a key, the empty one first."""
    h = hashlib.md5(usedforsecurity=False)
    out = [h.hexdigest()]
    for at in range(0, len(key), DIGEST):
        h.update(key[at:at + DIGEST])
        out.append(h.hexdigest())
    return out


def _sha(ids) -> str:
    return hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()


def shard_parts(shard: int, conv_ids: np.ndarray, keys: list[bytes], chars: list[np.ndarray]) -> Iterator[pd.DataFrame]:
    """Rows of PART of one shard: its finished nodes, its spine nodes, the ids that end at them, and its totals."""
    depths = [len(k) // DIGEST for k in keys]
    parent, depth, node_chars, runs, ends = [-1], [0], [0], [1], []  # runs of openings and closings in turn
    path, left_spine = [0], None
    for i, (key, d) in enumerate(zip(keys, depths, strict=True)):
        lcp = _common(keys[i - 1], key) if i else 0
        closed = len(path) - 1 - lcp
        new = range(len(parent), len(parent) + d - lcp)
        if closed:
            runs += [closed, len(new)]
        else:
            runs[-1] += len(new)
        del path[lcp + 1:]
        if new:
            parent += [path[-1], *new[:-1]]
            depth += range(lcp + 1, d + 1)
            node_chars += chars[i][lcp:d].tolist()
            path += new
        ends.append(path[-1])
        if left_spine is None:
            left_spine = list(path)
    runs.append(len(path))
    parent, depth, node_chars, ends = (np.array(a, dtype=np.int64) for a in (parent, depth, node_chars, ends))
    n = len(parent)

    bits = np.repeat(np.arange(1, len(runs) + 1) % 2, runs).astype(np.int8)
    opens = np.flatnonzero(bits)
    closes = RangeMinMax(bits).findclose(opens)
    after = np.arange(n) + (closes - opens + 1) // 2  # subtree of v: nodes v to after[v] - 1
    pairs = np.r_[0, np.cumsum((bits[:-1] == 1) & (bits[1:] == 0))]  # rank: "()" that start before a place
    members = np.r_[0, np.cumsum(np.bincount(ends, minlength=n))]
    n_convs = members[after] - members[:-1]
    first, stop = np.searchsorted(ends, np.arange(n)), np.searchsorted(ends, after)
    conv = RangeMin(conv_ids).smallest(first, stop)

    spine = np.zeros(n, dtype=bool)
    spine[left_spine] = spine[path] = True
    off = ~spine
    n_children = np.bincount(parent[1:][off[1:]], minlength=n)  # off the spines
    leaves = np.r_[0, np.cumsum(np.where(off, after == np.arange(n) + 1, 0))]
    saved = np.r_[0, np.cumsum(np.where(off, (n_convs - 1) * node_chars, 0))]

    at = np.searchsorted(ends, np.arange(n), side="right")
    mine = np.flatnonzero(off)
    if len(mine):
        up = parent[mine]
        yield _part({
            "kind": NODE, "shard": shard, "conv_id": conv[mine], "depth": depth[mine], "n_convs": n_convs[mine],
            "n_children": n_children[mine], "n_leaves": pairs[closes[mine]] - pairs[opens[mine]],
            "saved": saved[after[mine]] - saved[mine], "ends": [_sha(conv_ids[a:b]) for a, b in zip(first[mine], at[mine], strict=True)],
            "parent_conv": pd.array(np.where(spine[up], 0, conv[up]), dtype="Int64"),
            "parent_node": pd.array(np.where(spine[up], up, -1), dtype="Int64")}, len(mine))
    digest = {}
    for key, nodes in ((keys[0], left_spine), (keys[-1], path)):
        digest |= dict(zip(nodes, _prefixes(key), strict=True))
    nodes = np.flatnonzero(spine)
    yield _part({
        "kind": SPINE, "shard": shard, "node": nodes, "conv_id": conv[nodes], "depth": depth[nodes], "n_convs": n_convs[nodes],
        "n_children": n_children[nodes], "key": [digest[v] for v in nodes],
        "parent_key": [digest.get(p) for p in parent[nodes]], "chars": node_chars[nodes], "o": opens[nodes], "c": closes[nodes],
        "leaf_o": leaves[nodes], "leaf_c": leaves[after[nodes]], "saved_o": saved[nodes], "saved_c": saved[after[nodes]]}, len(nodes))
    for v in nodes:
        for a in range(first[v], at[v], END_IDS):
            yield _part({"kind": ENDS, "shard": shard, "o": a, "key": digest[v],
                         "ends": ",".join(map(str, conv_ids[a:min(at[v], a + END_IDS)]))}, 1)
    yield _part({"kind": SHARD, "shard": shard, "n_leaves": leaves[-1], "saved": saved[-1]}, 1)


def _part(columns: dict, rows: int) -> pd.DataFrame:
    index = pd.RangeIndex(rows)
    return pd.DataFrame({c: columns.get(c) for c in COLUMNS}, index=index)


def parts_of(items: DataFrame, ranges: int, block_turns: int) -> DataFrame:
    """Rows of PART of all shards of (conv_id, key, chars)."""
    placed = items.repartitionByRange(ranges, "key", "conv_id").sortWithinPartitions("key", "conv_id").withColumn(
        "p", F.spark_partition_id())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shard, ids, keys, chars, held = None, [], [], [], 0
        for batch in batches:
            for p, c, k, n in zip(batch["p"], batch["conv_id"], batch["key"], batch["chars"], strict=True):
                if shard is None:
                    shard = int(p) << 32
                ids.append(int(c))
                keys.append(bytes(k))
                chars.append(np.asarray(n, dtype=np.int64))
                held += 1 + len(n)
                if held >= block_turns:
                    yield from shard_parts(shard, np.array(ids, dtype=np.int64), keys, chars)
                    shard, ids, keys, chars, held = shard + 1, [], [], [], 0
        if ids:
            yield from shard_parts(shard, np.array(ids, dtype=np.int64), keys, chars)

    return placed.mapInPandas(run, PART)


# --- shared spines -----------------------------------------------------------------

def _end_digests(ends: DataFrame) -> DataFrame:
    """(key, ends): SHA-256 over the joined ids of a spine node, fed shard by shard."""
    dealt = ends.select("key", "shard", "o", "ends").repartition("key").sortWithinPartitions("key", "shard", "o")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, h = None, None
        for batch in batches:
            done = []
            for key, ids in zip(batch["key"], batch["ends"], strict=True):
                if key != now:
                    if now is not None:
                        done.append((now, h.hexdigest()))
                    now, h = key, hashlib.sha256(ids.encode())
                else:
                    h.update(b"," + ids.encode())
            yield pd.DataFrame(done, columns=["key", "ends"])
        if now is not None:
            yield pd.DataFrame([(now, h.hexdigest())], columns=["key", "ends"])

    return dealt.mapInPandas(run, "key string, ends string")


def merged_spines(parts: DataFrame) -> DataFrame:
    """(key, conv_id, depth, parent_key, n_convs, n_children, n_leaves, saved) of every distinct spine node."""
    totals = running_totals(parts.where(F.col("kind") == SHARD).select("shard", "n_leaves", "saved"), [], ["shard"],
                            ["n_leaves", "saved"])
    before = totals.select("shard", (F.col("n_leaves_cum") - F.col("n_leaves")).alias("leaf_b"),
                           (F.col("saved_cum") - F.col("saved")).alias("saved_b"))
    spine = parts.where(F.col("kind") == SPINE).join(before, "shard").select(
        "key", "parent_key", "depth", "conv_id", "n_convs", "n_children", "chars",
        F.struct("shard", F.col("o").alias("at"), (F.col("leaf_o") + F.col("leaf_b")).alias("leaf"),
                 (F.col("saved_o") + F.col("saved_b")).alias("saved")).alias("open"),
        F.struct("shard", F.col("c").alias("at"), (F.col("leaf_c") + F.col("leaf_b")).alias("leaf"),
                 (F.col("saved_c") + F.col("saved_b")).alias("saved")).alias("close"))
    one = spine.groupBy("key").agg(
        F.min("parent_key").alias("parent_key"), F.min("depth").alias("depth"), F.min("conv_id").alias("conv_id"),
        F.sum("n_convs").alias("n_convs"), F.sum("n_children").alias("off_children"), F.min("chars").alias("chars"),
        F.min("open").alias("open"), F.max("close").alias("close"))
    one = stored(one, "trie-spines")
    below = one.where("parent_key IS NOT NULL").groupBy(F.col("parent_key").alias("key")).agg(F.count("*").alias("spine_children"))
    one = one.join(below, "key", "left").withColumn(
        "n_children", F.col("off_children") + F.coalesce("spine_children", F.lit(0))).withColumn(
        "own_leaf", (F.col("n_children") == 0).cast("long")).withColumn("own_saved", (F.col("n_convs") - 1) * F.col("chars"))
    # what the spine nodes weigh themselves, summed over the openings in preorder
    zero = F.lit(0).cast("long")
    events = one.select("key", F.explode(F.array(
        F.struct(F.col("open.shard").alias("shard"), F.col("open.at").alias("at"), F.lit(True).alias("opens"),
                 F.col("own_leaf").alias("leaf"), F.col("own_saved").alias("saved")),
        F.struct(F.col("close.shard").alias("shard"), F.col("close.at").alias("at"), F.lit(False).alias("opens"),
                 zero.alias("leaf"), zero.alias("saved")))).alias("e")).select("key", "e.*")
    own = running_totals(stored(events, "trie-events"), [], ["shard", "at"], ["leaf", "saved"]).groupBy("key").agg(
        *[F.sum(F.when(F.col("opens"), F.col(c) - F.col(c + "_cum")).otherwise(F.col(c + "_cum"))).alias("sum_" + c)
          for c in ("leaf", "saved")])
    return one.join(own, "key").select(
        "key", "conv_id", "depth", "parent_key", "n_convs", "n_children",
        (F.col("close.leaf") - F.col("open.leaf") + F.col("sum_leaf")).alias("n_leaves"),
        (F.col("close.saved") - F.col("open.saved") + F.col("sum_saved")).alias("saved"))


def prefix_trie(turns: DataFrame, block_turns: int = BLOCK_TURNS, range_turns: int = RANGE_TURNS) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    convs = rebuilt(turns)
    items = convs.select("conv_id", F.unhex(F.concat_ws("", F.transform("turns", lambda t: t["digest"]))).alias("key"),
                         F.transform("turns", lambda t: t["chars"]).alias("chars"))
    size = items.agg(F.sum(F.size("chars") + 1)).first()[0] or 0
    parts = stored(parts_of(items, size // range_turns + 1, block_turns), "trie-parts")
    spines = stored(merged_spines(parts), "trie-merged")
    names = spines.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("parent_conv"))
    ends = _end_digests(parts.where(F.col("kind") == ENDS))
    empty = F.lit(hashlib.sha256(b"").hexdigest())
    top = spines.join(names, "parent_key", "left").join(ends, "key", "left").withColumn("ends", F.coalesce("ends", empty))
    nodes = parts.where(F.col("kind") == NODE)
    inner = nodes.where("parent_node < 0")
    local = parts.where(F.col("kind") == SPINE).select("shard", F.col("node").alias("parent_node"), F.col("key").alias("parent_key"))
    hung = nodes.where("parent_node >= 0").drop("parent_conv", "parent_key").join(
        local.join(names, "parent_key").select("shard", "parent_node", "parent_conv"), ["shard", "parent_node"])
    columns = ["conv_id", "depth", F.col("parent_conv").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves",
               F.col("saved").alias("saved_tokens"), F.col("ends").alias("ends_sha256")]
    return inner.select(*columns).unionByName(hung.select(*columns)).unionByName(top.select(*columns))


def op13_prefix_trie(spark, sf_dir: str) -> DataFrame:
    """Contract digest of ``prefix_trie`` on the whole of ``conversations``."""
    return prefix_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
