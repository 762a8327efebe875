"""Running sums over a whole table in the order of a number, without one task that holds all of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STRETCHES = 200


def running(rows: DataFrame, order: Column, sums: dict[str, str], by: list[str] | None = None) -> DataFrame:
    """``rows`` with, for each name in ``sums``, the sum of a column over the rows of a strictly smaller ``order``.

    ``order`` is a number that no two rows of a group (of ``by``) share, null not being one.  About STRETCHES
    quantiles cut the numbers into stretches; sums run inside each, and the totals of the stretches before
    (that many rows a group) are added.  Descending order is that of the number with its sign turned.
    """
    by = by or []
    rows = rows.withColumn("_o", order)
    cuts = rows.agg(F.percentile_approx("_o", F.array(*[F.lit(i / STRETCHES) for i in range(1, STRETCHES)]), F.lit(10 * STRETCHES)).alias("_cuts"))  # one row
    placed = rows.crossJoin(F.broadcast(cuts)).withColumn("_s", F.size(F.filter("_cuts", lambda c: c < F.col("_o")))).drop("_cuts")
    inside = Window.partitionBy(*by, "_s").orderBy("_o").rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy(*by).orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    zero = lambda c: F.coalesce(c, F.lit(0))
    totals = placed.groupBy(*by, "_s").agg(*[F.sum(c).alias(f"_t_{n}") for n, c in sums.items()])
    totals = totals.select(*by, "_s", *[zero(F.sum(f"_t_{n}").over(before)).alias(f"_b_{n}") for n in sums])
    out = placed.withColumns({f"_i_{n}": zero(F.sum(c).over(inside)) for n, c in sums.items()}).join(totals, [*by, "_s"])
    keep = [c for c in rows.columns if c != "_o"]
    return out.select(*keep, *[(F.col(f"_i_{n}") + F.col(f"_b_{n}")).alias(n) for n in sums])
