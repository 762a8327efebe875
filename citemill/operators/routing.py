"""The batch cascade, cost limits, review orders and samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citemill.operators.ordered import running
from citemill.views import VERDICTS


def effective(user: str = "user", agent: str = "agent") -> Column:
    return F.coalesce(F.nullif(F.col(user), F.lit("")), F.col(agent))


def rank(verdict: Column) -> Column:
    place = F.array_position(F.array(*map(F.lit, VERDICTS)), verdict)
    return F.when(place > 0, place - 1).otherwise(len(VERDICTS)).cast("int")


def digest(rows: DataFrame) -> DataFrame:
    """Articles that aren't archived, by verdict, then newest, then journal and title."""
    v = effective()
    return rows.where(~F.col("archived")).withColumns({"verdict": v, "rank": rank(v)}).orderBy("rank", F.desc("year"), "journal", "title")


def cascade(rows: DataFrame, stages: list[tuple[str, Column]], last: str) -> DataFrame:
    """``rows`` with stage, the first that claims a row; what nothing claims goes to ``last``."""
    stage = None
    for name, claims in stages:
        stage = F.when(claims, name) if stage is None else stage.when(claims, name)
    return rows.withColumn("stage", stage.otherwise(last) if stage is not None else F.lit(last))


def cost_breaker(rows: DataFrame, time: str, key: str, cost: str, limit: float, least: int = 3, by: list[str] | None = None) -> DataFrame:
    """Rows that still run, in the order of time and key: before each, cost so far and its mean must stay within the limit, once ``least`` have run.

    Sums run over points of time, then inside rows of one time, so a long ledger isn't in one task.
    """
    by = by or []
    per = rows.groupBy(*by, time).agg(F.sum(cost).alias("_cost"), F.count("*").alias("_n"))
    before = running(per, F.unix_micros(F.col(time).cast("timestamp")), {"_spent": "_cost", "_ran": "_n"}, by).drop("_cost", "_n")
    w = Window.partitionBy(*by, time).orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    out = rows.join(before, [*by, time])
    spent, n = F.col("_spent") + F.coalesce(F.sum(cost).over(w), F.lit(0.0)), F.col("_ran") + F.count("*").over(w)
    return out.withColumn("runs", ~((n >= least) & (spent + spent / n > limit))).drop("_spent", "_ran")


def blind_sample(rows: DataFrame, key: str, bucket: Column, quota: int, seed: int) -> DataFrame:
    """Up to ``quota`` rows of each bucket, by a seeded hash of the key."""
    w = Window.partitionBy("bucket").orderBy(F.xxhash64(F.lit(seed), key), key)
    return rows.withColumn("bucket", bucket).withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= quota).drop("_r")
