"""Connected components of an edge table: one form of DataFrame operations only, and one with work inside partitions."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citemill.llm.storage import cut


def _state(edges: DataFrame) -> tuple:
    return edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, component) for each node of ``edges`` (a, b): component is the smallest node reachable.

    Alternating large-star and small-star: each round hangs every node's neighbours on the
    smallest node near it.  The rounds end when the edges stay as they are; their number grows
    with the logarithm of a component's size.  Minima are pre-aggregated before the shuffle, and
    the join that hands them back is one that Spark can split where one node has many edges.
    Each round is written to the shared folder, so a lost executor costs one round at most.
    Edges with a null end and loops say nothing; a node with only those is not in the result.
    """
    edges = edges.select("a", "b").where("a IS NOT NULL AND b IS NOT NULL AND a <> b").distinct()
    edges = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name)
    state = _state(edges)
    while state[0]:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a AND b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a")
        small = small.select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e"))
        edges = cut(small.select("e.a", "e.b").where("a <> b").distinct(), name)
        if (now := _state(edges)) == state:
            break
        state = now
    root = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return edges.groupBy("a").agg(F.min("b").alias("component")).select(F.col("a").alias("node"), "component").unionByName(root)


LEAST_TASKS, EDGES_A_TASK = 4, 50_000


def _roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct nodes of some edges and the smallest node that each reaches over these."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[u], label[v])
        new = label.copy()
        np.minimum.at(new, label[u], low)
        np.minimum.at(new, label[v], low)
        while (further := new[new] != new).any():
            new[further] = new[new][further]
        if (new == label).all():
            return nodes, nodes[label]
        label = new


def local_components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, component) for each node of ``edges`` (a, b), both long: component is the smallest node reachable.

    Each round solves every partition on its own, deals out (node, root) by node, and joins the roots
    that a node has in several partitions to their smallest.  Then every node takes the root of its
    root, so paths shrink by half whatever partition they lie in.  A node has one root a partition at
    most, so none has more rows than there are partitions, however many edges it had; the join by root
    is one that Spark can split.  It ends when every node has one root everywhere.  Rounds are written
    to the shared folder.  Edges with a null end say nothing; a loop only makes its node known.
    """

    def solve(batches):
        a, b = [], []
        for batch in batches:
            a.append(batch.column("a").to_numpy())
            b.append(batch.column("b").to_numpy())
        if a:
            nodes, roots = _roots(np.concatenate(a), np.concatenate(b))
            yield pa.RecordBatch.from_pydict({"node": nodes, "root": roots})

    def meet(batches):
        last, root = None, 0  # the node whose rows the last batch ended in; rows are sorted
        for batch in batches:
            node, r = batch.column("node").to_numpy(), batch.column("root").to_numpy()
            if not len(node):
                continue
            fresh = np.append(True, node[1:] != node[:-1])
            begin = np.maximum.accumulate(np.where(fresh, np.arange(len(node)), 0))
            low = r[begin]
            if last is not None and node[0] == last:
                fresh[0] = False
                low = np.where(begin == 0, root, low)
            more = ~fresh & (r != low)
            yield pa.RecordBatch.from_pydict({"a": np.concatenate([node[fresh], r[more]]), "b": np.concatenate([low[fresh], low[more]]), "more": np.concatenate([np.zeros(int(fresh.sum()), bool), np.ones(int(more.sum()), bool)])})
            last, root = node[-1], low[-1]

    edges = cut(edges.select("a", "b").where("a IS NOT NULL AND b IS NOT NULL"), name)
    count = edges.count()
    while True:
        # few edges need few tasks; merging whole partitions leaves each node's rows together and in order
        tasks = max(LEAST_TASKS, -(-count // EDGES_A_TASK))
        dealt = edges.coalesce(tasks).mapInArrow(solve, "node long, root long").repartition("node").sortWithinPartitions("node", "root")
        found = cut(dealt.coalesce(tasks).mapInArrow(meet, "a long, b long, more boolean"), name)
        labels = found.where("NOT more").select("a", "b")
        if found.where("more").isEmpty():
            return labels.select(F.col("a").alias("node"), F.col("b").alias("component"))
        count = found.count()
        up = labels.where("a <> b").select(F.col("a").alias("b"), F.col("b").alias("c"))
        edges = labels.join(up, "b", "left").select("a", F.coalesce("c", "b").alias("b")).unionByName(found.where("more").select("a", "b"))
