"""Mixing sources to target weights by weighted fair queueing.

Every document of a source gets a place in a shuffled order. Its virtual finish
time is the source's running token count up to its end divided by the source's
target; the k-th repeat of a source starts where the previous one ended. Sorted
by finish time all sources advance at the rate of their targets, so cutting the
order at the total budget leaves each source within about one document of its
target.

Nothing is ordered as a whole. The shuffle position is a hash, cut into hash
ranges whose totals (one row per source and range) give the offset of each
range; the span of virtual time in which the budget ends is narrowed by small tables of
sums, however late it is, and only the places left in it are ordered row by row. The
number of hash ranges follows the row count, so a task's share does not grow with the data, and a hot
source is spread over all ranges.

The budget's end is one position in the global order, so whether a repeat is taken
is a comparison with that position and needs no join back to the rows.

Defined results: a null text has size 0 and is never taken; null sources are one
source that comes last; an empty table gives an empty result; fully equal rows
tie, and the rows may swap places but not change the result; more than
``MAX_SOURCES`` sources raise an error (their targets are settled on the driver);
other columns, whatever their names, are ignored by ``mix`` and kept by
``mixed_documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablesmith.llm.common import stored, word_count

WEIGHTS = (5.0, 2.0, 1.0)
MAX_REPEATS = 3
MAX_SOURCES = 100_000
ROWS_PER_RANGE = 512
MAX_RANGES = 65_536
STEPS = 4096
STEP_ROWS = 50_000


def water_fill(sizes: list[tuple[str | None, int]], weights=WEIGHTS, cap: int = MAX_REPEATS) -> dict:
    """Targets by weight that share all sizes; no target passes ``cap`` times its
    source's size, and what is over goes to the others by weight."""
    ordered = sorted(sizes, key=lambda s: (s[0] is None, s[0] or ""))
    open_ = {name: (size, weights[i % len(weights)]) for i, (name, size) in enumerate(ordered)}
    left, target = float(sum(s for _, s in sizes)), {}
    while open_:
        unit = left / sum(w for _, w in open_.values())
        full = [k for k, (size, w) in open_.items() if unit * w > cap * size]
        if not full:
            target |= {k: unit * w for k, (_, w) in open_.items()}
            break
        for k in full:
            target[k] = float(cap * open_.pop(k)[0])
            left -= target[k]
    return target


def targets_of(sizes: DataFrame, cap: int = MAX_REPEATS) -> DataFrame:
    """(_m_source, _m_sid, _m_source_size, _m_target), one row per source; at most MAX_SOURCES."""
    rows = sizes.groupBy("_m_source").agg(F.sum("_m_size").alias("n")).limit(MAX_SOURCES + 1).collect()
    if len(rows) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    target = water_fill([(r["_m_source"], r["n"]) for r in rows], cap=cap)
    return sizes.sparkSession.createDataFrame(
        [(r["_m_source"], i, r["n"], float(target[r["_m_source"]])) for i, r in enumerate(rows)],
        "_m_source string, _m_sid int, _m_source_size long, _m_target double")


def _sized(docs: DataFrame, keep: list[str]) -> DataFrame:
    return docs.select(
        *[F.col(f"`{c}`") for c in keep], F.col("source").cast("string").alias("_m_source"),
        word_count(F.col("text")).alias("_m_size"), F.xxhash64("doc_id", "text").alias("_m_place"))


def _placed(sized: DataFrame, targets: DataFrame, offsets: DataFrame | None, ranges: int) -> DataFrame:
    """Adds the targets and _m_end, the running words of the source up to the end of the row."""
    t = F.broadcast(targets)
    rows = sized.join(t, sized["_m_source"].eqNullSafe(t["_m_source"])).drop(t["_m_source"]).withColumn(
        "_m_part", F.pmod("_m_place", F.lit(ranges)))
    if offsets is None:
        return rows
    inside = Window.partitionBy("_m_sid", "_m_part").orderBy("_m_place").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("_m_inside", F.sum("_m_size").over(inside)).join(
        offsets, ["_m_sid", "_m_part"]).withColumn("_m_end", F.col("_m_offset") + F.col("_m_inside"))


def _finish(epoch):
    return F.try_divide(epoch * F.col("_m_source_size") + F.col("_m_end"), F.col("_m_target"))


def _order(epoch):
    return F.struct(_finish(epoch).alias("f"), F.col("_m_sid").alias("s"), F.col("_m_place").alias("p"),
                    F.col("_m_end").alias("n"), epoch.alias("e"))


def _end_of(queue: DataFrame, budget: float, steps: int = STEPS, rows: int = STEP_ROWS):
    """The first place (``at``) of the queue (_m_size, at) whose running words pass the budget; None if none does.
    The span of virtual time that holds it is cut into ``steps`` ranges again and again, one small table of sums a
    round, until at most ``rows`` places are in it or the span holds one time alone; these are ordered."""
    span = queue.agg(F.min("at.f"), F.max("at.f"), F.sum("_m_size")).first()
    if span[2] is None or span[2] <= budget:
        return None
    low, high, inside = span[0], span[1], F.lit(True)
    while low < high:
        step = F.least(F.floor((F.col("at.f") - low) / (high - low) * steps), F.lit(steps - 1))
        sums = queue.where(inside).groupBy(step.alias("step")).agg(
            F.sum("_m_size").alias("n"), F.count("*").alias("rows"), F.min("at.f").alias("low"), F.max("at.f").alias("high")
        ).orderBy("step").collect()  # at most ``steps`` rows
        for r in sums:
            if r["n"] > budget:
                break
            budget -= r["n"]
        low, high = r["low"], r["high"]
        inside = F.col("at.f").between(low, high)
        if r["rows"] <= rows:
            break
    cum = F.sum("_m_size").over(Window.orderBy("at").rowsBetween(Window.unboundedPreceding, 0))
    return queue.where(inside).withColumn("cum", cum).where(F.col("cum") > budget).agg(F.min("at")).first()[0]


def _copies(docs: DataFrame, cap: int, whole: bool) -> DataFrame:
    """doc_id, or with ``whole`` all columns, and the _m_ columns of every row, with
    _m_copies, how often the mix takes it."""
    sized = stored(_sized(docs, ["doc_id"]), "mix-sizes")
    targets = targets_of(sized, cap)
    ranges = min(MAX_RANGES, max(1, sized.count() // ROWS_PER_RANGE))
    upto = Window.partitionBy("_m_sid").orderBy("_m_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = stored(_placed(sized, targets, None, ranges).groupBy("_m_sid", "_m_part").agg(
        F.sum("_m_size").alias("n")).select("_m_sid", "_m_part", F.coalesce(
            F.sum("n").over(upto), F.lit(0)).alias("_m_offset")), "mix-offsets")

    queue = stored(_placed(sized, targets, offsets, ranges).where("_m_size > 0"), "mix-queue").withColumn(
        "e", F.explode(F.sequence(F.lit(0), F.lit(cap - 1)))).select("_m_size", _order(F.col("e")).alias("at"))
    end = _end_of(queue, (targets.agg(F.sum("_m_target")).first()[0] or 0.0) + 0.5)

    rows = _placed(_sized(docs, docs.columns) if whole else sized, targets, offsets, ranges)
    if end is None:  # no words at all
        taken = F.lit(0)
    else:
        stop = F.struct(*[F.lit(end[k]).cast(kind).alias(k) for k, kind in (
            ("f", "double"), ("s", "int"), ("p", "long"), ("n", "long"), ("e", "int"))])
        taken = sum((_order(F.lit(e)) < stop).cast("int") for e in range(cap))
    return rows.withColumn("_m_copies", F.when(F.col("_m_size") == 0, 0).otherwise(F.coalesce(taken, F.lit(0))))


def mix(docs: DataFrame, cap: int = MAX_REPEATS) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, copies (how often
    the mix takes it) and taken = copies * size."""
    rows = _copies(docs, cap, whole=False)
    return rows.select("doc_id", F.col("_m_size").alias("size"), F.col("_m_source_size").alias("source_size"),
                       F.col("_m_target").alias("target"), F.col("_m_copies").alias("copies"),
                       (F.col("_m_copies") * F.col("_m_size")).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, cap: int = MAX_REPEATS) -> DataFrame:
    """The documents the mix takes, each as often as it takes it, with the columns of ``docs``."""
    rows = _copies(docs, cap, whole=True).where("_m_copies > 0")
    return rows.withColumn("_m_e", F.explode(F.sequence(F.lit(1), F.col("_m_copies")))).select(
        *[F.col(f"`{c}`") for c in docs.columns])


def op4_mixing(spark, sf_dir: str) -> DataFrame:
    """Contract digest of ``mix`` on the whole of ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")
