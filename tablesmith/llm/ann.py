"""Approximate nearest neighbours by an inverted multi-index.

Each vector is cut into two halves and each half is quantised by its own codebook,
so K + K centroids make K * K cells; K grows with half the square root of the number of vectors, up to
``MOST_CENTROIDS``. Codebooks are fitted on at most ``FIT_ROWS`` vectors (those of
the smallest id hashes); every vector is indexed. A query walks the centroid pairs
from the best sum of its two half products downwards with a heap (the
multi-sequence walk) until the cells hold enough vectors, and all entries of these
cells are ranked again by the exact inner product in double precision.

How many are enough is measured, not guessed: the true neighbours of ``SAMPLE`` vectors
are found by one pass over all rows, and the walk is as long as it must be to meet the share
``RECALL`` of them. It counts distinct vectors, so a cell of copies does not end it.

The K * K cell counts and the sample are all that is on the driver. Cells
are dealt to shards of about ``SHARD_ROWS`` entries; a larger cell is split by a
hash of the id, so a hot cell is spread. A query goes to shards that hold
one of its cells, in blocks of at most ``QUERY_BLOCK`` queries, with the sum at which its walk
ended, and comes back with its best k of the shard; the best k of all shards are
kept by a window.

Defined results: null, zero and non-finite vectors and vectors with such or null
components take no part, nor do rows without id. Equal rows (id and vector) count
once; of rows that share an id only, each is a candidate, also of the others, and
each is a query with ranks of its own. Vectors of different lengths are never
compared: each length (at most ``MOST_LENGTHS``) has its own index. Ties go to the
smaller id; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablesmith.llm.common import stored

K_NEAREST = 20
LEAST_CENTROIDS, MOST_CENTROIDS = 8, 512
FIT_ROWS = 20_000
FIT_ROUNDS = 12
SAMPLE = 256
RECALL = 0.94
MOST_LENGTHS = 64
STEP_ROWS = 4096
SHARD_ROWS = 16_384
QUERY_BLOCK = 4096


def clean(vectors: DataFrame) -> DataFrame:
    """(vec_id, v) of the vectors that take part, v as doubles; equal rows once."""
    v = F.col("embedding").cast("array<double>")
    good = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(
        "v", lambda x: x != 0)
    rows = vectors.select("vec_id", v.alias("v")).where(F.col("vec_id").isNotNull() & F.col("v").isNotNull())
    return stored(rows.where(good).dropDuplicates(["vec_id", "v"]), "vectors")


def kmeans(x: np.ndarray, k: int, rounds: int = FIT_ROUNDS) -> np.ndarray:
    """Centroids of the rows of x; starts from rows spread over the first component's order."""
    order = np.lexsort(x.T[::-1])
    c = x[order[np.linspace(0, len(x) - 1, min(k, len(x))).astype(int)]].copy()
    for _ in range(rounds):
        near = nearest(x, c)
        n = np.bincount(near, minlength=len(c))
        s = np.zeros_like(c)
        np.add.at(s, near, x)
        c = np.where(n[:, None] > 0, s / np.maximum(n, 1)[:, None], c)
    return c


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.argmin((c * c).sum(1)[None, :] - 2 * x @ c.T, axis=1)


def walk(a: np.ndarray, b: np.ndarray, held_by: np.ndarray, wanted: int) -> tuple[list[int], float]:
    """Cells i * K + j that hold any by falling a[i] + b[j] until they hold ``wanted`` entries, and the last sum.

    The heap has the best pair not yet seen of each row that has been entered; row i + 1 is entered with row i's first."""
    i_of, j_of = np.argsort(-a, kind="stable"), np.argsort(-b, kind="stable")
    av, bv, rows = a[i_of].tolist(), b[j_of].tolist(), (i_of * len(b)).tolist()
    columns, counts = j_of.tolist(), held_by.tolist()
    heap, out, held, last = [(-(av[0] + bv[0]), 0, 0)], [], 0, float("inf")
    while heap and held < wanted:
        negative, i, j = heap[0]
        cell = rows[i] + columns[j]
        if counts[cell]:
            out.append(cell)
            held += counts[cell]
            last = -negative
        if j + 1 < len(bv):
            heapq.heapreplace(heap, (-(av[i] + bv[j + 1]), i, j + 1))
        else:
            heapq.heappop(heap)
        if j == 0 and i + 1 < len(av):
            heapq.heappush(heap, (-(av[i + 1] + bv[0]), i + 1, 0))
    return out, last


def shards_of(counts: np.ndarray, rows: int = SHARD_ROWS) -> tuple[np.ndarray, np.ndarray]:
    """(first shard, number of shards) of each cell: small cells share a shard, a large one has several."""
    first, parts, shard, held = np.zeros(len(counts), int), np.ones(len(counts), int), 0, 0
    for cell, n in enumerate(counts.tolist()):
        if n > rows:
            shard += held > 0
            parts[cell] = -(-n // rows)
            first[cell] = shard
            shard, held = shard + parts[cell], 0
            continue
        if held + n > rows:
            shard, held = shard + 1, 0
        first[cell] = shard
        held += n
    return first, parts


def true_neighbours(rows: DataFrame, asked: pd.DataFrame, k: int) -> pd.DataFrame:
    """(q, cell, score) of the k nearest other vectors of each asked one (q: its position), by one pass over ``rows``."""
    points, own = np.stack(asked["v"].to_numpy()), asked["vec_id"].to_numpy()

    def best_of(batches):
        held = pd.DataFrame({"q": [], "vec_id": [], "cell": [], "score": []})
        for batch in batches:
            for start in range(0, len(batch), STEP_ROWS):
                part = batch.iloc[start:start + STEP_ROWS]
                ids, x = part["vec_id"].to_numpy(), np.stack(part["v"].to_numpy())
                s = points @ x.T
                s[own[:, None] == ids[None, :]] = -np.inf
                top = np.argpartition(-s, min(k, len(ids)) - 1, axis=1)[:, :k]
                q = np.repeat(np.arange(len(own)), top.shape[1])
                top = top.ravel()
                new = pd.DataFrame({"q": q, "vec_id": ids[top], "cell": part["cell"].to_numpy()[top], "score": s[q, top]})
                new = new[np.isfinite(new["score"])]
                held = (pd.concat([held, new]) if len(held) else new).sort_values(
                    ["score", "vec_id"], ascending=[False, True]).groupby("q").head(k)
        if len(held):
            yield held.astype({"q": "int64", "vec_id": "int64", "cell": "int64"})

    found = rows.select("vec_id", "v", "cell").mapInPandas(best_of, "q long, vec_id long, cell long, score double")
    w = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k).toPandas()  # SAMPLE * k rows at most


def walk_length(a: np.ndarray, b: np.ndarray, held_by: np.ndarray, true: pd.DataFrame, recall: float) -> int:
    """Number of vectors a walk must hold to meet the share ``recall`` of the true neighbours; row q of ``a`` and ``b``
    has the half products of query q."""
    needed = []
    for q, cells in true.groupby("q")["cell"]:
        order = np.argsort(-(a[q][:, None] + b[q][None, :]).ravel(), kind="stable")
        before = np.empty(len(order), np.int64)
        before[order] = np.cumsum(held_by[order]) - held_by[order]
        needed.extend((before[cells.to_numpy()] + 1).tolist())
    return sorted(needed)[int(np.ceil(recall * len(needed))) - 1] if needed else 1


def search(vectors: DataFrame, every: int, k: int = K_NEAREST, share: float | None = None,
           centroids: int | None = None, recall: float = RECALL) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each vector whose id ``every`` divides. The walk meets
    ``share`` of all distinct vectors, by default as many as ``recall`` asks for."""
    rows = clean(vectors)
    lengths = [r["d"] for r in rows.select(F.size("v").alias("d")).distinct().limit(MOST_LENGTHS + 1).collect()]
    if len(lengths) > MOST_LENGTHS:
        raise ValueError(f"vectors of more than {MOST_LENGTHS} different lengths")
    out = rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    for n, d in enumerate(sorted(lengths)):
        of_length = rows if len(lengths) == 1 else rows.where(F.size("v") == d)
        found = _search(of_length, d, every, k, share, centroids, recall)
        out = found if n == 0 else out.unionByName(found)
    return out


def _search(rows: DataFrame, d: int, every: int, k: int, share: float | None, centroids: int | None,
            recall: float) -> DataFrame:
    """``search`` among vectors of length d."""
    n = rows.count()
    centroids = centroids or int(min(MOST_CENTROIDS, max(LEAST_CENTROIDS, round(n ** 0.5 / 2))))
    fit = rows.orderBy(F.xxhash64("vec_id"), "vec_id", "v").limit(FIT_ROWS).select("vec_id", "v").toPandas()
    x = np.stack(fit["v"].to_numpy()).astype(np.float64)
    half = (d + 1) // 2
    books = kmeans(x[:, :half], centroids), kmeans(x[:, half:], centroids) if half < d else np.zeros((1, 0))
    width = len(books[1])

    def sums(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return m[:, :half] @ books[0].T, m[:, half:] @ books[1].T

    @F.pandas_udf("int")
    def cell_of(v: pd.Series) -> pd.Series:
        m = np.stack(v.to_numpy()).astype(np.float64)
        return pd.Series(nearest(m[:, :half], books[0]) * width + (
            nearest(m[:, half:], books[1]) if width > 1 else 0), dtype="int32")

    entries = stored(rows.withColumn("cell", cell_of("v")), "index")
    counts, held_by = np.zeros(len(books[0]) * width, np.int64), np.zeros(len(books[0]) * width, np.int64)
    per_vector = entries.groupBy("cell", F.xxhash64("v").alias("h")).agg(F.count(F.lit(1)).alias("n"))
    for r in per_vector.groupBy("cell").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("different")).collect():
        counts[r["cell"]], held_by[r["cell"]] = r["n"], r["different"]  # centroids ** 2 rows at most
    first, parts = shards_of(counts)
    total = int(held_by.sum())
    if share is None:
        wanted = walk_length(*sums(x[:SAMPLE]), held_by, true_neighbours(entries, fit[:SAMPLE], k), recall)
    else:
        wanted = int(np.ceil(share * total))
    wanted = min(total, max(wanted, k + 1))

    @F.pandas_udf("end double, shards array<int>")
    def walked(v: pd.Series) -> pd.DataFrame:
        a, b = sums(np.stack(v.to_numpy()).astype(np.float64))
        ends, shards = [], []
        for i in range(len(v)):
            cells, last = walk(a[i], b[i], held_by, wanted)
            ends.append(last - 1e-9 * (1.0 + abs(last)))  # the sum is taken again where the entries are
            at = np.array(cells)
            span = [np.unique(first[at])] + [np.arange(first[c], first[c] + parts[c]) for c in at[parts[at] > 1]]
            shards.append(np.unique(np.concatenate(span)).astype(np.int32))
        return pd.DataFrame({"end": ends, "shards": shards})

    queries = entries.where(F.col("vec_id") % every == 0)
    blocks = max(1, -(-queries.count() // QUERY_BLOCK))

    @F.pandas_udf("int")
    def shard_of(cell: pd.Series, spread: pd.Series) -> pd.Series:
        c = cell.to_numpy()
        return pd.Series(first[c] + spread.to_numpy() % parts[c], dtype="int32")

    spread = F.pmod(F.xxhash64("vec_id"), F.lit(1 << 30))
    dealt = entries.select(shard_of("cell", spread).alias("shard"), "vec_id", "v", "cell").select(
        "shard", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), "vec_id", "v", "cell")
    sent = queries.select(F.col("vec_id").alias("query_id"), "v", walked("v").alias("w")).select(
        F.explode("w.shards").alias("shard"), F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int").alias("block"),
        "query_id", "v", F.col("w.end").alias("end"), F.xxhash64("v").alias("of"))

    def rerank(own: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        """The best k of the shard for each query: exact products with the entries of the cells it walked."""
        none = pd.DataFrame({"query_id": [], "of": [], "vec_id": [], "score": []})
        if own.empty or asked.empty:
            return none
        m, ids = np.stack(own["v"].to_numpy()), own["vec_id"].to_numpy()
        cells, at = np.unique(own["cell"].to_numpy(), return_inverse=True)
        a, b = sums(np.stack(asked["v"].to_numpy()).astype(np.float64))
        found = []
        for i, (q, v, end, of) in enumerate(zip(asked["query_id"], asked["v"], asked["end"], asked["of"], strict=True)):
            pick = np.flatnonzero((a[i][cells // width] + b[i][cells % width] >= end)[at])
            same = pick[ids[pick] == q]
            if len(same):
                pick = np.setdiff1d(pick, same[(m[same] == v).all(axis=1)])  # the query's own row
            if not len(pick):
                continue
            s = (m[pick] * v).sum(axis=1)  # row by row: equal vectors get equal scores
            if len(pick) > k:
                near = s >= np.partition(s, len(s) - k)[len(s) - k]  # with all that tie at the k-th
                pick, s = pick[near], s[near]
            top = np.lexsort((ids[pick], -s))[:k]
            found.append(pd.DataFrame({"query_id": q, "of": of, "vec_id": ids[pick][top], "score": s[top]}))
        return pd.concat(found) if found else none

    best = dealt.groupBy("shard", "block").cogroup(sent.groupBy("shard", "block")).applyInPandas(
        rerank, "query_id long, of long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id", "of").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op10_ann(spark, sf_dir: str) -> DataFrame:
    """Contract query: every 20th vector against all of ``embeddings``."""
    return search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), every=20)
