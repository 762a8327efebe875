"""Connected components and communities of weighted graphs (a, b, weight), by joins and by tasks of a bounded size."""

from __future__ import annotations

import random

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citemill.operators.metrics import ranked
from citemill.shared import remove, scratch

TASK_EDGES = 200_000  # of a component that one task solves
PATIENCE, LEAST_RISE = 3, 1e-6  # rounds of moves go on while one of so many raises the modularity by that much


class _Cuts:
    """Tables that end a lineage; all but the kept one go together."""

    def __init__(self, spark):
        self.spark, self.folders = spark, []

    def __call__(self, df: DataFrame) -> DataFrame:
        self.folders.append(scratch(self.spark, "graph"))
        df.write.parquet(self.folders[-1])
        return self.spark.read.schema(df.schema).parquet(self.folders[-1])

    def close(self) -> None:
        for folder in self.folders:
            remove(folder)


def components(edges: DataFrame, cut) -> DataFrame:
    """(v, root): the least node that each node of edges (a, b) can reach; ``cut`` writes a table and reads it again.

    Labels fall to the least one of the neighbours, then to that one's own label, until none falls.
    """
    both = cut(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = cut(both.groupBy(F.col("a").alias("v")).agg(F.least(F.min("b"), F.col("a")).alias("root")))
    while True:
        near = both.join(labels.select(F.col("v").alias("b"), "root"), "b").groupBy(F.col("a").alias("v")).agg(F.min("root").alias("near"))
        fallen = cut(labels.join(near, "v").select("v", F.least("root", "near").alias("to"), "root"))
        # only nodes that are no roots themselves have somewhere further to point to
        hops = fallen.where("v <> to").select(F.col("v").alias("to"), F.col("to").alias("further"))
        labels = cut(fallen.join(hops, "to", "left").select("v", F.coalesce("further", "to").alias("root"), (F.coalesce("further", "to") < F.col("root")).alias("fell")))
        if labels.where("fell").isEmpty():
            return labels.select("v", "root")
        labels = labels.select("v", "root")


def communities(edges: DataFrame, seed: int = 42, resolution: float = 1.0, most_edges: int = TASK_EDGES) -> DataFrame:
    """(id, community) of the nodes of edges (a, b, weight), communities numbered by size, then by their smallest id.

    Each connected component is solved in a task, by moving one node at a time to the neighbouring community of the largest
    gain in modularity and making communities the nodes of the next graph; several small ones share a task.  A component
    of more than ``most_edges`` edges is made smaller first: rounds of joins move a random half of the nodes that want
    to, for as long as modularity rises, and its communities become its nodes.  One that no longer shrinks stays as it
    is.  Communities that fall apart are split into their connected pieces, which never lowers modularity.

    Edges are one a pair of nodes; an empty graph has no communities.  The result depends on ``seed`` and the graph, not
    on the partitions.
    """
    spark = edges.sparkSession
    cut = _Cuts(spark)
    graph = cut(edges.select(F.least("a", "b").cast("long").alias("a"), F.greatest("a", "b").cast("long").alias("b"), F.col("weight").cast("double").alias("w")))
    total = 2 * (graph.agg(F.sum("w")).first()[0] or 0.0)
    member = cut(graph.select(F.explode(F.array("a", "b")).alias("id")).distinct().select("id", F.col("id").alias("c")))
    while True:
        roots = components(graph, cut)
        placed = cut(graph.join(roots.withColumnRenamed("v", "a"), "a"))
        sizes = placed.groupBy("root").agg(F.count("*").alias("n"))
        large = cut(sizes.where(F.col("n") > most_edges).select("root"))
        if large.isEmpty():
            break
        rest, big = placed.join(large, "root", "left_anti").select("a", "b", "w"), cut(placed.join(large, "root", "left_semi").select("a", "b", "w"))
        moved = _connected(big, _moves(big, total, seed, resolution, cut), cut)
        member = cut(member.join(moved.withColumnRenamed("v", "c"), "c", "left").select("id", F.coalesce("to", "c").alias("c")))
        ends = big.join(moved.select(F.col("v").alias("a"), F.col("to").alias("x")), "a").join(moved.select(F.col("v").alias("b"), F.col("to").alias("y")), "b")
        smaller = cut(ends.groupBy(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).agg(F.sum("w").alias("w")))
        if smaller.count() >= big.count():
            graph = cut(rest)
        else:
            graph = cut(rest.unionByName(smaller))
    bins = max(1, -(-placed.count() // most_edges))
    schema = "c long, to long"
    solved = placed.withColumn("bin", F.pmod(F.xxhash64("root"), F.lit(bins))).groupBy("bin").applyInPandas(_solver(seed, resolution, total or 1.0), schema)
    member = member.join(solved, "c", "left").select("id", F.coalesce("to", "c").alias("c"))
    folder = scratch(spark, "communities")
    member.write.parquet(folder)
    cut.close()
    member = spark.read.schema(member.schema).parquet(folder)
    sizes = member.groupBy("c").agg(F.count("*").alias("size"), F.min("id").alias("low"))
    numbered = ranked(sizes, "size", "low").select("c", (F.col("r") - 1).cast("int").alias("community"))
    return member.join(numbered, "c").select("id", "community")


def _connected(graph: DataFrame, moved: DataFrame, cut) -> DataFrame:
    """(v, to): communities (v, c) cut into connected pieces, each named by its least node."""
    c = lambda side, name: moved.select(F.col("v").alias(side), F.col("c").alias(name))
    inside = graph.join(c("a", "x"), "a").join(c("b", "y"), "b").where("x = y AND a <> b").select("a", "b")
    pieces = components(inside, cut)
    return cut(moved.join(pieces, "v", "left").select("v", F.coalesce("root", "v").alias("to")))


def _moves(graph: DataFrame, total: float, seed: int, resolution: float, cut) -> DataFrame:
    """(v, c): the best partition that rounds of moves came to; loops of the graph (a, b, w) count twice in a node's degree."""
    both = cut(graph.where("a <> b").unionByName(graph.where("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"), "w")))
    ends = graph.select(F.explode(F.array("a", "b")).alias("v"), "w")
    state = best = cut(ends.groupBy("v").agg(F.sum("w").alias("deg")).select("v", F.col("v").alias("c"), "deg"))
    highest, idle, r = float("-inf"), 0, 0
    while True:
        inside = state.groupBy("c").agg(F.sum("deg").alias("tot"))
        near = both.join(state.select(F.col("v").alias("b"), "c"), "b").groupBy("a", "c").agg(F.sum("w").alias("k"))
        near = near.unionByName(state.select(F.col("v").alias("a"), "c", F.lit(0.0).alias("k"))).groupBy("a", "c").agg(F.sum("k").alias("k"))
        full = cut(near.join(state.select(F.col("v").alias("a"), F.col("c").alias("own"), "deg"), "a").join(inside, "c"))
        within = full.where("c = own").agg(F.sum("k")).first()[0]
        modularity = within / total - resolution * (inside.agg(F.sum(F.col("tot") * F.col("tot"))).first()[0]) / total**2
        if modularity > highest + LEAST_RISE:
            highest, best, idle = modularity, state, 0
        else:
            idle += 1
        gain = F.col("k") - resolution * F.col("deg") * (F.col("tot") - F.when(F.col("c") == F.col("own"), F.col("deg")).otherwise(0.0)) / F.lit(total)
        choice = full.withColumn("gain", gain).groupBy("a", "own").agg(F.max(F.struct("gain", (-F.col("c")).alias("n"))).alias("best"), F.max(F.when(F.col("c") == F.col("own"), F.col("gain"))).alias("stay"))
        want = cut(choice.where(F.col("best.gain") > F.col("stay") + 1e-9).select(F.col("a").alias("v"), (-F.col("best.n")).alias("to")))
        if idle >= PATIENCE or want.isEmpty():
            return best.select("v", "c")
        while (go := want.where(F.pmod(F.xxhash64("v", F.lit(seed), F.lit(r)), F.lit(2)) == 0)).isEmpty():
            r += 1  # none of the few was drawn
        state, r = cut(state.join(go, "v", "left").select("v", F.coalesce("to", "c").alias("c"), "deg")), r + 1


def _solver(seed: int, resolution: float, total: float):
    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        out: dict[int, int] = {}
        for _, part in rows.groupby("root", sort=True):
            out.update(_louvain(list(zip(part["a"].tolist(), part["b"].tolist(), part["w"].tolist(), strict=True)), seed, resolution, total))
        return pd.DataFrame({"c": list(out), "to": list(out.values())}, dtype="int64")

    return solve


def _pieces(label: dict[int, int], near: dict[int, dict[int, float]]) -> dict[int, int]:
    """Labels cut into connected pieces, each named by its least node."""
    out: dict[int, int] = {}
    for v in sorted(label):
        if v in out:
            continue
        out[v], todo = v, [v]
        while todo:
            for u in near[todo.pop()]:
                if u not in out and label[u] == label[v]:
                    out[u] = v
                    todo.append(u)
    return out


def _louvain(rows: list[tuple[int, int, float]], seed: int, resolution: float, total: float) -> dict[int, int]:
    """node -> community of a component of edges (a, b, w), loops included, of a graph whose degrees sum to ``total``."""
    rng = random.Random(seed)
    loops: dict[int, float] = {}
    level: dict[int, dict[int, float]] = {}
    for a, b, w in sorted(rows):
        level.setdefault(a, {}), level.setdefault(b, {})
        if a == b:
            loops[a] = loops.get(a, 0.0) + w
        else:
            level[a][b] = level[a].get(b, 0.0) + w
            level[b][a] = level[b].get(a, 0.0) + w
    ground, member = level, {v: v for v in level}
    while True:
        where = {v: v for v in level}
        degree = {v: sum(near.values()) + 2 * loops.get(v, 0.0) for v, near in level.items()}
        inside, order, again = dict(degree), sorted(level), True
        rng.shuffle(order)
        while again:
            again = False
            for v in order:
                near: dict[int, float] = {}
                for u, w in level[v].items():
                    near[where[u]] = near.get(where[u], 0.0) + w
                old = where[v]
                inside[old] -= degree[v]
                value = lambda c: near.get(c, 0.0) - resolution * degree[v] * inside[c] / total  # noqa: B023, E731
                best = max(sorted(near), key=value, default=old)
                if value(best) > value(old) + 1e-12:
                    where[v], again = best, True
                inside[where[v]] += degree[v]
        where = _pieces(where, level)
        if len(set(where.values())) == len(level):
            return _pieces(member, ground)
        member = {v: where[c] for v, c in member.items()}
        merged: dict[int, dict[int, float]] = {c: {} for c in where.values()}
        kept: dict[int, float] = {}
        for v, near in level.items():
            c = where[v]
            kept[c] = kept.get(c, 0.0) + loops.get(v, 0.0)
            for u, w in near.items():
                if where[u] == c:
                    kept[c] += w / 2
                else:
                    merged[c][where[u]] = merged[c].get(where[u], 0.0) + w
        level, loops = merged, kept
