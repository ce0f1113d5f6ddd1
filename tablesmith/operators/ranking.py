"""Running totals over a sorted key within groups, without one task per group.

A window ``sum() over (partition by g order by k)`` puts a whole group in one
task; fine for a few thousand keys, not for a column with 10^10 distinct
values. When any group is larger than ``max_task_rows`` the table is cut into
key ranges with ``repartitionByRange``; the cut is frozen with a reliable
checkpoint (so a lost executor recomputes the same ranges), per-range totals
(a table of ranges x groups rows) give each range its starting offset, and
the window runs inside each range only.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

DEFAULT_MAX_TASK_ROWS = 2_000_000


def running_totals(t: DataFrame, group: list[str], order: list[Column | str], weights: list[str],
                   max_task_rows: int = DEFAULT_MAX_TASK_ROWS, suffix: str = "_cum",
                   size: int | None = None) -> DataFrame:
    """Add ``<w><suffix>`` = sum of ``w`` over rows of the same group whose key
    sorts at or before this row's key (rows must be unique per group + key). ``size``, about the rows of a
    table of one group, saves the job that counts them; it decides only about the cut."""
    order_cols = [F.col(o) if isinstance(o, str) else o for o in order]
    if size is None:
        sizes = t.groupBy(*group).count().agg(F.max("count").alias("m"), F.sum("count").alias("n")).first()
        largest, total = (sizes["m"] or 0), (sizes["n"] or 0)
    else:
        largest = total = size
    upto = Window.unboundedPreceding, Window.currentRow
    if largest <= max_task_rows:
        w = Window.partitionBy(*group).orderBy(*order_cols).rowsBetween(*upto)
        return t.select("*", *[F.sum(c).over(w).alias(c + suffix) for c in weights])
    parts = max(2, math.ceil(total / max_task_rows))
    cut = cut_lineage(t.repartitionByRange(parts, *[F.col(g) for g in group], *order_cols)
                      .withColumn("_range", F.spark_partition_id()))
    per_range = cut.groupBy("_range", *group).agg(*[F.sum(c).alias("_t_" + c) for c in weights])
    before = Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_range.select("_range", *group,
                               *[F.coalesce(F.sum("_t_" + c).over(before), F.lit(0)).alias("_o_" + c)
                                 for c in weights])
    # offsets has at most (ranges + groups) rows: a size bound that does not grow with the data. A null group is
    # a group, as in the window above.
    offsets = offsets.toDF("_o_range", *[f"_og{i}" for i in range(len(group))], *["_o_" + c for c in weights])
    same = F.col("_range") == F.col("_o_range")
    for i, g in enumerate(group):
        same = same & F.col(g).eqNullSafe(F.col(f"_og{i}"))
    joined = cut.join(F.broadcast(offsets), same).drop("_o_range", *[f"_og{i}" for i in range(len(group))])
    w = Window.partitionBy("_range", *group).orderBy(*order_cols).rowsBetween(*upto)
    out = joined.select("*", *[(F.col("_o_" + c) + F.sum(c).over(w)).alias(c + suffix) for c in weights])
    return out.drop("_range", *["_o_" + c for c in weights])
