"""References: document frequency, weights, coupling of articles with own works, authors and each other."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ROUND = 4


def document_frequency(refs: DataFrame, targets: DataFrame | None = None) -> DataFrame:
    """(ref, df): number of articles that cite each work, of ``targets`` only where given."""
    if targets is not None:
        refs = refs.join(targets.select("ref").distinct(), "ref", "left_semi")
    return refs.groupBy("ref").agg(F.countDistinct("id").alias("df"))


def idf(df: Column) -> Column:
    """1 / ln(1 + df), a work that nobody cites counting as cited once."""
    return 1.0 / F.log(1.0 + F.greatest(F.lit(1), F.coalesce(df, F.lit(1))))


def weighted_overlap(refs: DataFrame, index: DataFrame, df: DataFrame | None = None) -> DataFrame:
    """(id, n, score) of the articles that cite works of ``index``: how many, and the sum of their weights."""
    hits = refs.select("id", "ref").distinct().join(index.select("ref").distinct(), "ref", "left_semi")
    weight = F.lit(1.0)
    if df is not None:
        hits, weight = hits.join(df, "ref", "left"), idf(F.col("df"))
    return hits.groupBy("id").agg(F.count("*").alias("n"), F.sum(weight).alias("score"))


def own_coupling(ids: DataFrame, dois: DataFrame, own_ids: DataFrame, own_dois: DataFrame, df_ids: DataFrame, df_dois: DataFrame) -> DataFrame:
    """The larger of the scores by work ids and by DOIs, and the larger of the two counts."""
    a = weighted_overlap(ids, own_ids, df_ids).select("id", F.col("n").alias("n1"), F.col("score").alias("s1"))
    b = weighted_overlap(dois, own_dois, df_dois).select("id", F.col("n").alias("n2"), F.col("score").alias("s2"))
    z = lambda c: F.coalesce(c, F.lit(0))
    return a.join(b, "id", "full_outer").select("id", F.greatest(z(F.col("n1")), z(F.col("n2"))).alias("n"), F.round(F.greatest(z(F.col("s1")), z(F.col("s2"))), ROUND).alias("score"))


def set_difference(trigger: DataFrame, own: DataFrame) -> DataFrame:
    """(ref, authors): works that the followed authors cite and one's own works don't, and how many authors cite each."""
    return trigger.select("author", "ref").distinct().join(own.select("ref").distinct(), "ref", "left_anti").groupBy("ref").agg(F.countDistinct("author").alias("authors"))


def attribution(refs: DataFrame, own: DataFrame, works: int, vias: int) -> DataFrame:
    """(id, work, shared, via): for each article the own works that cite most of what it cites."""
    shared = refs.select("id", "ref").join(own.select("work", "ref"), "ref").groupBy("id", "work").agg(F.count("*").alias("shared"), F.slice(F.array_sort(F.collect_set("ref")), 1, vias).alias("via"))
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("shared"), "work"))
    return shared.withColumn("rank", rank).where(F.col("rank") <= works)


def coupling_edges(refs: DataFrame, low: int, high: int, least: int) -> DataFrame:
    """(a, b, shared, weight) of articles that share works cited by ``low`` to ``high`` articles: weight is the sum of ln(N / df).

    The cap bounds the pairs that one work can make before the self join; every work beyond it is
    excluded by definition, as in the measure itself, not to save time.
    """
    refs = refs.select("id", "ref").distinct()
    total = refs.agg(F.countDistinct("id").alias("total"))
    kept = refs.groupBy("ref").agg(F.count("*").alias("df")).where(F.col("df").between(low, high)).crossJoin(F.broadcast(total))  # one row
    rows = refs.join(kept.select("ref", F.log(F.col("total") / F.col("df")).alias("w")), "ref")
    pairs = rows.alias("x").join(rows.alias("y"), (F.col("x.ref") == F.col("y.ref")) & (F.col("x.id") < F.col("y.id")))
    return pairs.groupBy(F.col("x.id").alias("a"), F.col("y.id").alias("b")).agg(F.count("*").alias("shared"), F.sum("x.w").alias("weight")).where(F.col("shared") >= least)
