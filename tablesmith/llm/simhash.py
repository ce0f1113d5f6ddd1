"""SimHash near-duplicates by BK-trees over shards of the fingerprints.

Only distinct fingerprints are compared. The 64 bits are cut into more bands than
the radius has bits, so two fingerprints within the radius agree on all bits of
some ``bands - radius`` bands. Each choice of that many bands deals every
fingerprint to the tree of its bits there, and the trees are dealt to shards of
about ``SHARD_ROWS`` fingerprints. In a BK-tree a child hangs below its parent
under their integer Hamming distance, and a search at distance d from a node
follows the edges d - radius to d + radius only. A shard sends its links as a
spanning forest, never as pairs; components are closed over the forests by
alternating star contraction. More fingerprints mean more bands to agree on, so a
tree stays small.

A tree of more than ``MAX_BLOCK`` fingerprints is split into blocks, and each pair
of blocks is its own shard: no link is lost and a task stays bounded. The shard
trees go to the tasks that search them by a shuffle, not by a broadcast: they grow
with the data, so no bound on their size holds.

Defined results: a text without words has fingerprint zero and is linked like any
other; a null id has a fingerprint and its component, whose name is the smallest
non-null id (null if there is none); repeated rows are copies; an empty table
gives an empty result; other columns are ignored (``keep_one`` keeps them).
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablesmith.llm.common import small_batches, stored

WIDTH = 4
RADIUS = 4
SHARD_ROWS = 4096
MAX_BLOCK = 8192
HASHES_AT_ONCE = 1 << 16


def fingerprint(text: str | None, width: int = WIDTH) -> int:
    """64 bits as a signed integer; see the contract of the module."""
    import xxhash

    parts = (text or "").encode("utf-8", errors="replace").lower().split()
    if not parts:
        return 0
    joined, digest = b" ".join(parts), xxhash.xxh64_intdigest
    ends = np.cumsum([len(p) + 1 for p in parts]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    if len(parts) >= width:
        starts, ends = starts[:len(parts) - width + 1], ends[width - 1:]
    else:
        starts, ends = starts[:1], ends[-1:]
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(starts), HASHES_AT_ONCE):
        h = np.array([digest(joined[a:b], 42) for a, b in zip(
            starts[at:at + HASHES_AT_ONCE].tolist(), ends[at:at + HASHES_AT_ONCE].tolist(), strict=True)],
            dtype="<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (ones * 2 > len(starts)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0].astype(np.int64))


def with_fingerprint(docs: DataFrame, width: int = WIDTH, name: str = "fp") -> DataFrame:
    @F.pandas_udf("long")
    def fp(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(t, width) for t in texts], dtype="int64")

    small_batches(docs.sparkSession)
    return docs.withColumn(name, fp(F.col("text").cast("string")))


class BKForest:
    """One BK-tree for each value of ``tree``, built level by level over arrays.
    The fingerprints of a tree are distinct."""

    def __init__(self, fps: np.ndarray, tree: np.ndarray):
        self.fps = fps
        _, first, of = np.unique(tree, return_index=True, return_inverse=True)
        self.root = first[of]
        at, keys, kids = self.root.copy(), [], []
        open_ = np.flatnonzero(at != np.arange(len(fps)))
        while len(open_):
            key = at[open_] * 128 + np.bitwise_count(fps[open_] ^ fps[at[open_]])
            edge, first, of = np.unique(key, return_index=True, return_inverse=True)
            child = open_[first]
            keys.append(edge)
            kids.append(child)
            at[open_] = child[of]
            open_ = open_[at[open_] != open_]
        keys_ = np.concatenate(keys) if keys else np.zeros(0, dtype=np.int64)
        order = np.argsort(keys_)
        self.keys, self.kids = keys_[order], (np.concatenate(kids) if kids else keys_)[order]

    def within(self, queries: np.ndarray, radius: int):
        """Yields (query, node) arrays of all pairs within the radius, a query's own node included."""
        q, node = queries, self.root[queries]
        while len(q):
            d = np.bitwise_count(self.fps[q] ^ self.fps[node]).astype(np.int64)
            near = d <= radius
            yield q[near], node[near]
            lo = np.searchsorted(self.keys, node * 128 + np.maximum(d - radius, 0), "left")
            n = np.searchsorted(self.keys, node * 128 + d + radius, "right") - lo
            q = np.repeat(q, n)
            node = self.kids[np.repeat(lo - np.cumsum(n) + n, n) + np.arange(len(q))]


def join_labels(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``labels`` (each item's smallest known fellow) after linking a with b."""
    while True:
        x, y = labels[a], labels[b]
        apart = x != y
        if not apart.any():
            return labels
        np.minimum.at(labels, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
        while (up := labels[labels]).tobytes() != labels.tobytes():
            labels = up
        a, b = a[apart], b[apart]


def forest_links(fps: np.ndarray, tree: np.ndarray, radius: int, step: int = 512) -> tuple[np.ndarray, np.ndarray]:
    """Links (item, representative) that join what the pairs within the radius join."""
    forest, labels = BKForest(fps, tree), np.arange(len(fps))
    for at in range(0, len(fps), step):
        for q, node in forest.within(np.arange(at, min(at + step, len(fps))), radius):
            labels = join_labels(labels, q, node)
    linked = np.flatnonzero(labels != np.arange(len(fps)))
    return linked, labels[linked]


def band_bits(bands: int) -> list[tuple[int, int]]:
    """(first bit, width) of each band."""
    edges = [round(64 * i / bands) for i in range(bands + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


def bands_for(count: int, radius: int) -> int:
    """More bands, and so longer keys, for more fingerprints; any number is exact."""
    bands = radius + 1
    while bands < 2 * radius + 4 and count > 1 << round(64 * (bands - radius) / bands + 9):
        bands += 1
    return bands


def _trees(fp: Column, bands: int, radius: int) -> Column:
    """array<struct<combo, tree>>: the bits of each choice of bands."""
    out, bits = [], band_bits(bands)
    for c, chosen in enumerate(combinations(bits, bands - radius)):
        value, shift = F.lit(0).cast("long"), 0
        for at, width in chosen:
            part = F.shiftrightunsigned(fp, at).bitwiseAND(F.lit((1 << width) - 1))
            value = value.bitwiseOR(F.shiftleft(part, shift))
            shift += width
        out.append(F.struct(F.lit(c).alias("combo"), value.alias("tree")))
    return F.array(*out)


def links(fps: DataFrame, count: int, radius: int = RADIUS) -> DataFrame:
    """(a, b) with a > b: links whose components are those of all pairs of ``fps.fp`` within the radius."""
    bands = bands_for(count, radius)
    dealt = fps.select("fp", F.inline(_trees(F.col("fp"), bands, radius)))
    shards = max(1, count // SHARD_ROWS)
    large = dealt.groupBy("combo", "tree").agg(F.count("*").alias("n")).where(F.col("n") > MAX_BLOCK).select(
        "combo", "tree", F.ceil(F.col("n") / MAX_BLOCK).cast("int").alias("blocks"))
    rows = dealt.join(large, ["combo", "tree"], "left")
    own = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    split = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.struct(
        F.col("tree").alias("shard"), F.least(own, j).alias("x"), F.greatest(own, j).alias("y")))
    whole = F.array(F.struct(F.pmod(F.xxhash64("tree"), F.lit(shards)).cast("long").alias("shard"),
                             F.lit(-1).alias("x"), F.lit(-1).alias("y")))
    rows = rows.select("fp", "combo", "tree", F.inline(F.when(F.col("blocks").isNull(), whole).otherwise(split)))

    def shard(pdf: pd.DataFrame) -> pd.DataFrame:
        signed = pdf["fp"].to_numpy()
        a, b = forest_links(signed.view(np.uint64), pdf["tree"].to_numpy(), radius)
        x, y = signed[a], signed[b]
        return pd.DataFrame({"a": np.maximum(x, y), "b": np.minimum(x, y)})

    return rows.groupBy("combo", "shard", "x", "y").applyInPandas(shard, "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every linked node but the roots, root being the smallest
    node of the component. ``edges`` are (a, b) with a > b."""
    edges, before = stored(edges, "links"), None
    while True:
        size = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(size) == before or size[0] == 0:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = tuple(size)
        both = edges.union(edges.select("b", "a"))
        low = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = stored(large, "large-star")
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = stored(small.union(low).distinct(), "small-star")


def dedup(docs: DataFrame, width: int = WIDTH, radius: int = RADIUS) -> DataFrame:
    """One row per document: doc_id, fp (signed fingerprint), text_hash, root (the
    component's smallest fingerprint), component_id (its smallest id)."""
    rows = stored(with_fingerprint(docs.select("doc_id", "text"), width).select(
        "doc_id", "fp", F.xxhash64("text").alias("text_hash")), "fingerprints")
    fps = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("low")), "distinct-fingerprints")
    roots = components(links(fps, fps.count(), radius))
    named = fps.join(roots, fps["fp"] == roots["node"], "left").select(
        "fp", "low", F.coalesce("root", "fp").alias("root"))
    lows = named.groupBy("root").agg(F.min("low").alias("component_id"))
    named = named.join(lows, "root").select("fp", "root", "component_id")
    return rows.join(named, "fp").select("doc_id", "fp", "text_hash", "root", "component_id")


def keep_one(docs: DataFrame, width: int = WIDTH, radius: int = RADIUS) -> DataFrame:
    """One document of each component, with the columns of ``docs``: the one of the
    smallest non-null id, then of the smallest fingerprint and text hash; of rows alike
    in all, any."""
    chosen = dedup(docs, width, radius).groupBy("root").agg(F.min(F.struct(
        F.col("doc_id").isNull().alias("unnamed"), "doc_id", "fp", "text_hash")).alias("k")).select(
        F.col("k.text_hash").alias("_s_hash"), F.to_json(F.struct(F.col("k.doc_id").alias("id"))).alias("_s_id"))
    # join and de-duplication use the same two columns, so the texts are shuffled once
    keyed = docs.withColumns({"_s_hash": F.xxhash64("text"), "_s_id": F.to_json(F.struct(F.col("doc_id").alias("id")))})
    kept = keyed.join(chosen.hint("merge"), ["_s_hash", "_s_id"], "left_semi").dropDuplicates(["_s_hash", "_s_id"])
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])


def op8_simhash(spark, sf_dir: str) -> DataFrame:
    """Contract digest of ``dedup`` on the whole of ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return dedup(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
