"""Evaluation of scores and labels by aggregation."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citemill.operators.ordered import running
from citemill.operators.quantiles import exact_quantiles


def per_class(rows: DataFrame, gold: str, pred: str, classes: list[str]) -> DataFrame:
    """(label, tp, precision, recall, f1); a measure without cases is 0."""
    counts = rows.groupBy(gold, pred).agg(F.count("*").alias("n"))
    lab = F.explode(F.array(*map(F.lit, classes))).alias("label")
    c = counts.select("*", lab)
    s = lambda cond: F.sum(F.when(cond, F.col("n")).otherwise(0))
    is_g, is_p = F.col(gold) == F.col("label"), F.col(pred) == F.col("label")
    g = c.groupBy("label").agg(s(is_g & is_p).alias("tp"), s(is_p).alias("pp"), s(is_g).alias("gp"))
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    g = g.withColumns({"precision": ratio(F.col("tp"), F.col("pp")), "recall": ratio(F.col("tp"), F.col("gp"))})
    total = F.col("precision") + F.col("recall")
    return g.withColumn("f1", F.when(total > 0, 2 * F.col("precision") * F.col("recall") / total).otherwise(0.0)).select("label", "tp", "precision", "recall", "f1")


def summary(rows: DataFrame, gold: str, pred: str, classes: list[str]) -> DataFrame:
    agree = rows.agg(F.avg((F.col(gold) == F.col(pred)).cast("double")).alias("agreement"))
    return per_class(rows, gold, pred, classes).agg(F.avg("f1").alias("macro_f1")).crossJoin(agree)


def by_score(rows: DataFrame, score: str, y: str) -> DataFrame:
    """(score, n, p, above_n, above_p): distinct scores with counts and what lies above them."""
    per = rows.groupBy(score).agg(F.count("*").alias("n"), F.sum(y).alias("p"))
    return running(per, -F.col(score), {"above_n": "n", "above_p": "p"})


def ranked(rows: DataFrame, score: str, key: str) -> DataFrame:
    """``rows`` with r, the place by score, ties by key: places before a score from counts, the rest inside equal scores."""
    per = running(rows.groupBy(score).agg(F.count("*").alias("_n")), -F.col(score), {"_a": "_n"})
    inside = F.row_number().over(Window.partitionBy(score).orderBy(key))
    total = rows.agg(F.count("*").alias("total"))
    return rows.join(per, score).withColumn("r", F.col("_a") + inside).drop("_a", "_n").crossJoin(F.broadcast(total))


def top_precision(rows: DataFrame, score: str, key: str, y: str, share: float) -> DataFrame:
    k = F.greatest(F.lit(1), F.round(F.col("total") * share))
    return ranked(rows, score, key).where(F.col("r") <= k).agg(F.count("*").alias("k"), F.avg(y).alias("precision"))


def recall_at_load(rows: DataFrame, score: str, key: str, y: str) -> DataFrame:
    """(load, recall, precision) at 10, 20 .. 100 % of the rows, best first."""
    pos = rows.agg(F.sum(y).alias("pos"))
    r = ranked(rows, score, key).withColumn("tenth", F.ceil(F.col("r") * 10 / F.col("total"))).groupBy("tenth").agg(F.sum(y).alias("p"), F.count("*").alias("n"))
    w = Window.orderBy("tenth")  # ten rows
    run = r.withColumns({"cp": F.sum("p").over(w), "cn": F.sum("n").over(w)}).crossJoin(F.broadcast(pos))
    return run.select((F.col("tenth") * 10).cast("int").alias("load"), F.round(F.col("cp") / F.col("pos"), 6).alias("recall"), F.round(F.col("cp") / F.col("cn"), 6).alias("precision"))


def auc(rows: DataFrame, score: str, y: str, group: str | None = None) -> DataFrame:
    """(auc, n, pos): chance that a positive scores higher than a negative, ties counting half."""
    keys = [group] if group else []
    per = rows.groupBy(*keys, score).agg(F.sum(y).alias("p"), F.sum(1 - F.col(y)).alias("q"))
    run = running(per, F.col(score), {"below": "q"}, keys)
    g = run.groupBy(*keys).agg(F.sum(F.col("p") * (F.col("below") + F.col("q") / 2.0)).alias("u"), F.sum("p").alias("pos"), F.sum("q").alias("neg"))
    return g.select(*keys, F.when((F.col("pos") > 0) & (F.col("neg") > 0), F.col("u") / (F.col("pos") * F.col("neg"))).alias("auc"), (F.col("pos") + F.col("neg")).alias("n"), "pos")


def calibration(rows: DataFrame, score: str, y: str, bins: int = 10) -> DataFrame:
    """(ece, brier) over bins of equal width."""
    b = F.least(F.floor(F.col(score) * bins), F.lit(bins - 1)).alias("b")
    total = rows.agg(F.count("*").alias("total"), F.avg(F.pow(F.col(score) - F.col(y), 2)).alias("brier"))
    g = rows.groupBy(b).agg(F.count("*").alias("n"), F.avg(score).alias("m"), F.avg(y).alias("o")).crossJoin(F.broadcast(total))
    return g.agg(F.sum(F.col("n") / F.col("total") * F.abs(F.col("o") - F.col("m"))).alias("ece"), F.max("brier").alias("brier"))


def isotonic(rows: DataFrame, score: str, y: str) -> DataFrame:
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.regression import IsotonicRegression

    data = rows.select("*", array_to_vector(F.array(F.col(score).cast("double"))).alias("features"), F.col(y).cast("double").alias("label"))
    model = IsotonicRegression().fit(data.select("features", "label"))
    return model.transform(data).withColumn("calibrated", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("prediction")))).drop("features", "label", "prediction")


def grid_search(rows: DataFrame, score: str, gold: str, classes: tuple[str, str, str], steps: int) -> DataFrame:
    """(low, high, macro_f1): the two quantile thresholds that separate three classes best; the first of equals.

    Counts by score and class are all that meets the grid.
    """
    qs = exact_quantiles(rows, {score: [(i + 0.5) / steps for i in range(steps)]})[score]
    points = rows.sparkSession.range(1).select(F.explode(F.array_distinct(F.array(*[F.round(F.lit(q).cast("double"), 6) for q in qs]))).alias("t")).where("t IS NOT NULL")
    grid = points.select(F.col("t").alias("low")).crossJoin(points.select(F.col("t").alias("high"))).where("low < high")  # steps squared at most
    counts = rows.groupBy(score, gold).agg(F.count("*").alias("n"))
    pred = F.when(F.col(score) < F.col("low"), classes[0]).when(F.col(score) < F.col("high"), classes[1]).otherwise(classes[2])
    x = counts.crossJoin(F.broadcast(grid)).withColumn("pred", pred)
    s = lambda cond: F.sum(F.when(cond, F.col("n")).otherwise(0))
    aggs = [a for c in classes for a in (s((F.col(gold) == c) & (F.col("pred") == c)).alias(f"tp_{c}"), s(F.col("pred") == c).alias(f"pp_{c}"), s(F.col(gold) == c).alias(f"gp_{c}"))]
    g = x.groupBy("low", "high").agg(*aggs)
    f1 = sum((F.when(F.col(f"pp_{c}") + F.col(f"gp_{c}") > 0, 2 * F.col(f"tp_{c}") / (F.col(f"pp_{c}") + F.col(f"gp_{c}"))).otherwise(0.0) for c in classes), F.lit(0.0)) / len(classes)
    return g.withColumn("macro_f1", F.round(f1, 6)).orderBy(F.desc("macro_f1"), "low", "high").limit(1).select("low", "high", "macro_f1")


def folds(rows: DataFrame, key: str, label: str, k: int = 5, seed: Column | int = 42) -> DataFrame:
    """``rows`` with fold, 0 to ``k`` - 1: the rows of each label, in an order shuffled by ``seed``, are dealt out in turn.

    So every fold has its share of every label, give or take one row; the order is that of a digest of seed and key.
    """
    shuffled = rows.withColumn("_seed", F.lit(seed) if isinstance(seed, int) else seed)
    digest = F.md5(F.concat_ws(":", F.col("_seed").cast("string"), F.col(key).cast("string")).cast("binary"))
    shuffled = shuffled.withColumns({"_h": F.conv(F.substring(digest, 1, 13), 16, 10).cast("long"), "_one": F.lit(1)})
    placed = running(shuffled, F.col("_h"), {"_r": "_one"}, ["_seed", label])
    return placed.withColumn("fold", F.pmod("_r", F.lit(k)).cast("int")).drop("_seed", "_h", "_one", "_r")


def out_of_fold_prior(rows: DataFrame, group: str, y: str, strength: float = 5.0, by: list[str] | None = None) -> DataFrame:
    """``rows``, which have fold, with oof: the rate of ``y`` in a row's group outside its fold, drawn towards the global rate there.

    A group that is in no other fold takes the global rate.  What a fold's rows are scored by comes from sums
    by group and fold, so the model is refitted for each fold without any row being read twice.  ``by`` names
    columns, such as a seed, whose values are runs of their own.
    """
    by = by or []
    cells = rows.groupBy(*by, group, "fold").agg(F.sum(y).alias("_y"), F.count("*").alias("_n"))
    over = lambda *c: Window.partitionBy(*by, *c)  # noqa: E731  (cells are folds times groups)
    total = cells.select(*by, group, "fold", *[(F.sum(c).over(over(group)) - F.col(c)).alias(f"{c}_g") for c in ("_y", "_n")])
    folds_ = cells.groupBy(*by, "fold").agg(F.sum("_y").alias("_y"), F.sum("_n").alias("_n"))
    folds_ = folds_.select(*by, "fold", ((F.sum("_y").over(over()) - F.col("_y")) / (F.sum("_n").over(over()) - F.col("_n"))).alias("_rate"))
    prior = total.join(folds_, [*by, "fold"]).select(*by, group, "fold", ((F.col("_y_g") + strength * F.col("_rate")) / (F.col("_n_g") + strength)).alias("oof"))
    return rows.join(prior, [*by, group, "fold"])


def stability(rows: DataFrame, value: str, sample: bool = False) -> DataFrame:
    """(mean, std, low, high) of a measure over repeated runs: the population's deviation, or the sample's."""
    std = F.stddev_samp(value) if sample else F.stddev_pop(value)
    return rows.agg(F.avg(value).alias("mean"), std.alias("std"), F.min(value).alias("low"), F.max(value).alias("high"))


def seed_stability(rows: DataFrame, key: str, group: str, y: str, seeds: int = 20, k: int = 5) -> DataFrame:
    """(mean, std, low, high) of the AUC of out-of-fold group rates, the folds dealt out anew for each of ``seeds`` seeds."""
    many = rows.withColumn("seed", F.explode(F.sequence(F.lit(0), F.lit(seeds - 1))))
    scored = out_of_fold_prior(folds(many, key, y, k, F.col("seed")), group, y, by=["seed"]).withColumn("oof", F.round("oof", 12))
    return stability(auc(scored, "oof", y, "seed"), "auc")


def repeat_noise(runs: DataFrame, run: str, verdict: str, gold: str, drop: str) -> DataFrame:
    """(mean, std, low, high) over repeated runs of the share of cases where a run drops what the gold verdict drops and keeps what it keeps."""
    same = (F.col(verdict) == drop) == (F.col(gold) == drop)
    return stability(runs.groupBy(run).agg(F.avg(same.cast("int")).alias("agreement")), "agreement", sample=True)


def group_auc(rows: DataFrame, group: str, score: str, y: str, least: int, positives: int) -> DataFrame:
    """Size-weighted mean of the AUC inside groups that are large enough."""
    return auc(rows, score, y, group).where((F.col("n") >= least) & (F.col("pos") >= positives) & F.col("auc").isNotNull()).agg((F.sum(F.col("auc") * F.col("n")) / F.sum("n")).alias("auc"), F.count("*").alias("groups"))


def majority_baseline(rows: DataFrame, gold: str, classes: list[str]) -> DataFrame:
    counts = rows.groupBy(gold).agg(F.count("*").alias("n"))
    top = counts.agg(F.max_by(gold, F.struct("n", gold)).alias("label"), F.max("n").alias("k"), F.sum("n").alias("t"))
    return top.select("label", F.round(2.0 * F.col("k") / (F.col("k") + F.col("t")) / len(classes), 6).alias("macro_f1"))


def random_baseline(rows: DataFrame, gold: str, classes: list[str], trials: int, seed: int, uniform: bool = False) -> DataFrame:
    """Mean macro-F1, over trials, of labels drawn by class frequency, or all alike; drawn from class counts, so the number of rows doesn't matter."""
    counts = rows.groupBy(gold).agg(F.count("*").alias("n")).agg(F.collect_list(F.struct(gold, "n")).alias("c"))  # a row of a few classes
    spread = counts.crossJoin(rows.sparkSession.range(trials))

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import numpy as np

        for pdf in batches:
            out = []
            for c, trial in zip(pdf["c"], pdf["id"], strict=True):
                have = {x[gold]: int(x["n"]) for x in c}
                n = np.array([have.get(k, 0) for k in classes])
                rng = np.random.default_rng(seed + int(trial))
                chance = np.full(len(n), 1 / len(n)) if uniform else n / n.sum()
                hits = np.stack([rng.multinomial(v, chance) for v in n])
                both = hits.sum(0) + n
                out.append(float(np.mean(np.divide(2 * np.diag(hits), both, out=np.zeros(len(n)), where=both > 0))))
            yield pd.DataFrame({"f1": out})

    return spread.mapInPandas(draw, "f1 double").agg(F.round(F.avg("f1"), 6).alias("macro_f1"))


def rule_quality(rows: DataFrame, fired: Column, y: str) -> DataFrame:
    """(fired, precision, recall, lift); nulls where a rule never fires."""
    g = rows.agg(F.count_if(fired).alias("fired"), F.count_if(fired & (F.col(y) == 1)).alias("tp"), F.sum(y).alias("pos"), F.count("*").alias("n"))
    p = F.when(F.col("fired") > 0, F.col("tp") / F.col("fired"))
    return g.select("fired", p.alias("precision"), (F.col("tp") / F.col("pos")).alias("recall"), (p / (F.col("pos") / F.col("n"))).alias("lift"))


def quota_sample(rows: DataFrame, key: str, rules: dict[str, Column], keep: Column, total: int, seed: int = 11) -> DataFrame:
    """(key, rule): ``total`` labelled cases, half of them by rules, none twice; the others, of rule null, are drawn by ``seed``.

    The rules, in their order, get each an equal quota, and of that kept and rejected rows (``keep`` true or
    false; null is no case) the first by key that no quota before took.  The draw is by a digest of seed and key.  What
    has been taken, ``total`` keys at most, goes through the driver.
    """
    per = max(1, (total // 2) // max(1, len(rules))) // 2 + 1
    cases, taken = rows.withColumn("_keep", keep).where("_keep IS NOT NULL"), []
    left = lambda: cases.where(~F.col(key).isin([k for k, _ in taken])) if taken else cases
    for name, rule in rules.items():
        for side in (True, False):
            got = left().where(rule & (F.col("_keep") == side)).select(key).orderBy(key).limit(per).collect()
            taken += [(r[0], name) for r in got]
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")).cast("binary"))
    rest = left().select(key).orderBy(digest).limit(max(0, total - len(taken))).withColumn("rule", F.lit(None).cast("string"))
    schema = f"{key} {rows.schema[key].dataType.simpleString()}, rule string"
    return rows.sparkSession.createDataFrame(taken, schema).unionByName(rest)
