"""A Merkle manifest of a data set: a tree of SHA-256 digests for each group, and one over the groups.

The rows of a group in their order are leaves; every ``fanout`` consecutive nodes become one
until one is left.  The tree is built by superblocks: row numbers divided by ``fanout ** levels``
are buckets, a task collapses a bucket by that many levels at once, and the buckets' roots
are the rows of the next round, so a group of any size takes a few rounds of equal, small tasks.
Proofs go the same way back: a bucket's own siblings, then those of its root.

* Row numbers come from one range sort, written to the shared folder, and counts of each
  range and group; no group is ever sorted in one task.
* A bucket has ``fanout ** levels`` rows at most (2,187 with the values here), however many a group has.
* The digests of siblings leave a task only in the result's rows; nothing shuffles them.
"""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citemill.llm import storage

FANOUT, LEVELS = 3, 7
_OWN = ("_subroot", "_root", "_before", "_after")
_PATH = "_before array<string>, _after array<string>, _subroot string, _root string"


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def _part(column: Column) -> Column:
    value = column.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value))


def leaf_digest(*columns: Column) -> Column:
    """SHA-256 in lower-case hex over the columns; each is ``-`` where null, else its UTF-8 byte count, ``:`` and its value."""
    return F.sha2(F.concat(*map(_part, columns)), 256)


def folded(leaf: Column) -> Column:
    """The root that ``leaf`` leads to with the siblings in ``_before`` and ``_after``."""
    return F.aggregate(F.arrays_zip("_before", "_after"), leaf, lambda node, side: F.sha2(F.concat(side["_before"], node, side["_after"]), 256))


def siblings() -> Column:
    """The digests of all siblings, level by level, left to right, as one text."""
    return F.array_join(F.flatten(F.zip_with("_before", "_after", lambda a, b: F.array(a, b))), "")


def _height(n: int, fanout: int) -> int:
    """Levels until ``n`` nodes are one."""
    levels = 0
    while n > 1:
        n, levels = -(-n // fanout), levels + 1
    return levels


def _upwards(nodes: list[str], fanout: int, levels: int) -> list[list[str]]:
    """``nodes`` and what they are after one to ``levels`` levels."""
    out = [nodes]
    for _ in range(levels):
        out.append([digest("".join(out[-1][i : i + fanout])) for i in range(0, len(out[-1]), fanout)])
    return out


def _collapse(fanout: int, levels: int):
    size = fanout**levels

    def bucket(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("_index")
        n = int(rows["_n"].iloc[0])
        top = _upwards(rows["_digest"].tolist(), fanout, min(levels, _height(n, fanout)))[-1]
        return pd.DataFrame({"_tree": rows["_tree"].iloc[:1], "_index": rows["_index"].iloc[0] // size, "_digest": top, "_n": -(-n // size)})

    return bucket


def _sides(fanout: int, levels: int, keep: list[str]):
    """Paths of a bucket's rows: their siblings inside it, then those of its root."""

    def bucket(rows: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("_index").reset_index(drop=True)
        grown = _upwards(rows["_digest"].tolist(), fanout, min(levels, _height(int(rows["_n"].iloc[0]), fanout)))
        top = above.iloc[0]
        before, after = [list(top["_before"])], [list(top["_after"])]
        for nodes in reversed(grown[:-1]):
            left, right = [], []
            for i in range(len(nodes)):
                run = i - i % fanout
                left.append(["".join(nodes[run:i]), *before[i // fanout]])
                right.append(["".join(nodes[i + 1 : run + fanout]), *after[i // fanout]])
            before, after = left, right
        out = rows[keep].copy()
        out["_before"], out["_after"], out["_subroot"], out["_root"] = before, after, top["_subroot"], top["_root"]
        return out

    return bucket


def _numbered(rows: DataFrame, *order: str) -> DataFrame:
    """``rows`` with ``_index`` (from 0 inside ``_tree``, by ``order``) and ``_n`` (rows of the tree), from the shared folder."""
    by = [F.col(c).asc_nulls_first() for c in ("_tree", *order)]
    rows = rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_at", F.monotonically_increasing_id())
    rows = storage.cut(rows, "merkle-sorted").withColumn("_range", F.shiftright("_at", 33))
    counts = rows.groupBy("_tree", "_range").agg(F.min("_at").alias("_first"), F.count("*").alias("_count"))
    tree = Window.partitionBy("_tree")
    before = F.sum("_count").over(tree.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select("_tree", "_range", (F.coalesce(before, F.lit(0)) - F.col("_first")).alias("_shift"), F.sum("_count").over(tree).alias("_n"))
    return rows.join(counts, ["_tree", "_range"]).withColumn("_index", F.col("_at") + F.col("_shift")).drop("_at", "_range", "_shift")


class _Tree:
    """All rounds of superblocks over numbered rows, from the leaves to one node a tree."""

    def __init__(self, leaves: DataFrame, fanout: int, levels: int):
        self.fanout, self.levels, self.size = fanout, levels, fanout**levels
        self.rounds = [leaves]
        most = leaves.agg(F.max("_n")).first()[0] or 0
        while most > 1:
            nodes = self.rounds[-1].select("_tree", "_index", "_digest", "_n")
            nodes = self._buckets(nodes).applyInPandas(_collapse(fanout, levels), "_tree string, _index long, _digest string, _n long")
            self.rounds.append(storage.cut(nodes, "merkle-round"))
            most = -(-most // self.size)

    def _buckets(self, nodes: DataFrame):
        return nodes.groupBy("_tree", F.expr(f"_index div {self.size}").alias("_bucket"))

    @property
    def tops(self) -> DataFrame:
        return self.rounds[-1].select("_tree", F.col("_digest").alias("_top"))

    def paths(self, tops: DataFrame, keep: list[str], schema: str) -> DataFrame:
        """Leaves (``keep``, of ``schema``) with their paths, from the tops' ones (_tree and _PATH)."""
        above = tops.withColumn("_index", F.lit(0).cast("long"))
        for i in range(len(self.rounds) - 2, -1, -1):
            names, kinds = (keep, schema) if i == 0 else (["_tree", "_index"], "_tree string, _index long")
            rows = self._buckets(self.rounds[i])
            above = rows.cogroup(above.groupBy("_tree", "_index")).applyInPandas(_sides(self.fanout, self.levels, names), f"{kinds}, {_PATH}")
        if len(self.rounds) == 1:
            return self.rounds[0].join(above.drop("_index"), "_tree").select(*keep, "_before", "_after", "_subroot", "_root")
        return above


def manifest(rows: DataFrame, group: str, order: str, leaf: str, fanout: int = FANOUT, levels: int = LEVELS) -> DataFrame:
    """``rows`` with ``_subroot`` of their group, ``_root`` of all, and the siblings on the way there.

    ``leaf`` is the column of leaf digests.  In a group rows ascend by ``order`` (null first),
    then by leaf; groups ascend by their name as UTF-8 bytes, null first.  ``_before`` and ``_after``
    have one text a level, from the leaf to the root: the digests left and right of the own node
    in its run, end to end, empty where there is none.

    Rows that repeat are a leaf each.  A group of one row has its leaf as subroot, and one group's
    subroot is the root.  A table without rows has no root and gives none.  Columns that are
    named as those added here are replaced; others stay, whatever their names.
    """
    rows = rows.drop(*_OWN)
    names = {c: f"_c{i}" for i, c in enumerate(rows.columns)}
    own = rows.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()])
    tree = F.coalesce(F.concat(F.lit("+"), F.col(names[group]).cast("string")), F.lit(""))  # "" is before all others
    own = own.withColumn("_tree", tree).withColumn("_digest", F.col(names[leaf]))
    leaves = _Tree(_numbered(own, names[order], "_digest"), fanout, levels)
    groups = leaves.tops.select(F.col("_tree").alias("_name"), F.col("_top").alias("_digest"), F.lit("").alias("_tree"))
    groups = _Tree(_numbered(groups, "_name"), fanout, levels)
    empty = F.array().cast("array<string>")
    root = groups.tops.select("_tree", empty.alias("_before"), empty.alias("_after"), F.lit("").alias("_subroot"), F.col("_top").alias("_root"))
    tops = groups.paths(root, ["_name", "_digest"], "_name string, _digest string")
    tops = tops.select(F.col("_name").alias("_tree"), "_before", "_after", F.col("_digest").alias("_subroot"), "_root")
    kinds = {n: own.schema[n].dataType.simpleString() for n in names.values()}
    out = leaves.paths(tops, list(kinds), ", ".join(f"{n} {k}" for n, k in kinds.items()))
    return out.select(*[F.col(n).alias(c) for c, n in names.items()], *_OWN)
