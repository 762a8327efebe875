"""Exact quantiles of columns of any size, by histograms that are refined around each wanted rank."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CELLS = 4096


def exact_quantiles(rows: DataFrame, wanted: dict[str, list[float]]) -> dict[str, list[float | None]]:
    """For each column the quantiles at the given shares, between neighbours in proportion, as ``percentile`` has them.

    Each round counts the values around a rank in CELLS cells of one width and goes on with the range of the cell that
    holds it, until that cell has one value.  A round reads the rows once for all columns and ranks, and
    what comes back is CELLS rows a rank at most, so memory doesn't grow with the table.  Nulls and NaN are left out; a
    column without other values has null quantiles.
    """
    value = {c: F.when(~F.isnan(F.col(c).cast("double")) & F.col(c).isNotNull(), F.col(c).cast("double")) for c in wanted}
    names = list(wanted)
    ends = rows.agg(*[f(value[c]).alias(f"{k}{i}") for i, c in enumerate(names) for k, f in (("n", F.count), ("lo", F.min), ("hi", F.max))]).first()
    open_, found = {}, {}  # (column, rank from 0) -> (least, greatest value of its cell, values before it)
    for i, c in enumerate(names):
        n, lo, hi = ends[f"n{i}"], ends[f"lo{i}"], ends[f"hi{i}"]
        for p in wanted[c] if n else []:
            for rank in {math.floor(p * (n - 1)), math.ceil(p * (n - 1))}:
                open_[c, rank] = (lo, hi, 0)
    while open_:
        for key, (lo, hi, _) in list(open_.items()):
            if lo == hi:
                found[key] = lo
                del open_[key]
        if not open_:
            break
        keys = list(open_)
        cells = []
        for k, (c, rank) in enumerate(keys):
            lo, hi, _ = open_[c, rank]
            half = hi / 2 - lo / 2  # the whole width may be more than a double can hold
            cell = F.least(F.floor((value[c] / 2 - lo / 2) / half * CELLS), F.lit(CELLS - 1)).cast("int")
            cells.append(F.when(value[c].between(lo, hi), F.struct(F.lit(k).alias("k"), cell.alias("cell"), value[c].alias("x"))))
        got = rows.select(F.explode(F.array_compact(F.array(*cells))).alias("e")).groupBy("e.k", "e.cell").agg(F.count("*").alias("n"), F.min("e.x").alias("lo"), F.max("e.x").alias("hi")).collect()
        by_key: dict[int, list] = {}
        for r in got:
            by_key.setdefault(r.k, []).append(r)
        for k, key in enumerate(keys):
            before = open_[key][2]
            for r in sorted(by_key[k], key=lambda r: r.cell):
                if before + r.n > key[1]:
                    open_[key] = (r.lo, r.hi, before)
                    break
                before += r.n
    out: dict[str, list[float | None]] = {}
    for i, c in enumerate(names):
        n, out[c] = ends[f"n{i}"], []
        for p in wanted[c]:
            at = p * (n - 1)
            a, b = (found.get((c, r)) for r in (math.floor(at), math.ceil(at)))
            out[c].append(None if not n else a if a == b else (math.ceil(at) - at) * a + (at - math.floor(at)) * b)
    return out
