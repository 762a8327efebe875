"""Queries of section H: evaluation metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from citemill import views as V
from citemill.operators import metrics as M
from citemill.plans.registry import query

QS = ", ".join(f"{(i + 0.5) / 9!r}" for i in range(9))
CLASSES = ["lesenswert", "scannen", "ignorieren"]
X = V.scored
R6 = lambda c, name: F.round(c, 6).alias(name)
_PRF = f"""WITH {V.SCORED}, k AS (SELECT unnest(['lesenswert', 'scannen', 'ignorieren']) AS label), c AS (SELECT label, count(*) FILTER (gold = label AND pred = label) AS tp, count(*) FILTER (pred = label) AS pp, count(*) FILTER (gold = label) AS gp FROM k, scored GROUP BY 1),
f AS (SELECT label, tp, CASE WHEN pp > 0 THEN tp::DOUBLE / pp ELSE 0 END AS p, CASE WHEN gp > 0 THEN tp::DOUBLE / gp ELSE 0 END AS r FROM c), g AS (SELECT *, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END AS f1 FROM f)"""


@query("h01_per_class_metrics", _PRF + " SELECT label, tp, round(p, 6) AS precision, round(r, 6) AS recall, round(f1, 6) AS f1 FROM g")
def h01(s: SparkSession, d: str) -> DataFrame:
    return M.per_class(X(s, d), "gold", "pred", CLASSES).select("label", "tp", *[R6(F.col(c), c) for c in ("precision", "recall", "f1")])


@query("h01_macro_f1_agreement", _PRF + " SELECT round(avg(f1), 6) AS macro_f1, (SELECT round(avg(CAST(gold = pred AS INT)), 6) FROM scored) AS agreement FROM g")
def h01m(s: SparkSession, d: str) -> DataFrame:
    return M.summary(X(s, d), "gold", "pred", CLASSES).select(R6(F.col("macro_f1"), "macro_f1"), R6(F.col("agreement"), "agreement"))


@query("h02_top_k_precision", f"WITH {V.SCORED}, r AS (SELECT y, row_number() OVER (ORDER BY s DESC, id) AS r, count(*) OVER () AS n FROM scored) SELECT count(*) AS k, round(avg(y), 6) AS precision FROM r WHERE r <= greatest(1, round(n * 0.15::DOUBLE))")
def h02(s: SparkSession, d: str) -> DataFrame:
    return M.top_precision(X(s, d), "s", "id", "y", 0.15).select("k", R6(F.col("precision"), "precision"))


@query("h03_recall_at_load", f"""WITH {V.SCORED}, r AS (SELECT y, row_number() OVER (ORDER BY s DESC, id) AS r, count(*) OVER () AS n FROM scored), t AS (SELECT CAST(ceil(r * 10.0::DOUBLE / n) AS INT) AS t, sum(y) AS p, count(*) AS k FROM r GROUP BY 1)
SELECT t * 10 AS load, round(sum(p) OVER (ORDER BY t)::DOUBLE / (SELECT sum(y) FROM scored), 6) AS recall, round(sum(p) OVER (ORDER BY t)::DOUBLE / sum(k) OVER (ORDER BY t), 6) AS precision FROM t""")
def h03(s: SparkSession, d: str) -> DataFrame:
    return M.recall_at_load(X(s, d), "s", "id", "y")


@query("h04_roc_auc", f"WITH {V.SCORED} SELECT round(sum(CASE WHEN p.s > n.s THEN 1.0::DOUBLE WHEN p.s = n.s THEN 0.5 ELSE 0 END) / count(*), 6) AS auc FROM scored p JOIN scored n ON p.y = 1 AND n.y = 0")
def h04(s: SparkSession, d: str) -> DataFrame:
    return M.auc(X(s, d), "s", "y").select(R6(F.col("auc"), "auc"))


@query("h05_calibration_error", f"WITH {V.SCORED}, b AS (SELECT least(floor(s * 10), 9) AS b, count(*) AS n, avg(s) AS m, avg(y) AS o FROM scored GROUP BY 1) SELECT round(sum(n::DOUBLE / (SELECT count(*) FROM scored) * abs(o - m)), 6) AS ece, (SELECT round(avg((s - y) * (s - y)), 6) FROM scored) AS brier FROM b")
def h05(s: SparkSession, d: str) -> DataFrame:
    return M.calibration(X(s, d), "s", "y").select(R6(F.col("ece"), "ece"), R6(F.col("brier"), "brier"))


# the fit at a score is the largest, over starts up to it, of the smallest mean of a stretch that ends from there on
@query("h06_isotonic_calibration", f"""WITH {V.SCORED}, p AS (SELECT s, sum(y) AS sy, count(*) AS n, row_number() OVER (ORDER BY s) AS i FROM scored GROUP BY s), c AS (SELECT *, sum(sy) OVER (ORDER BY i) AS cy, sum(n) OVER (ORDER BY i) AS cn FROM p),
m AS (SELECT a.i AS j, b.i AS k, (b.cy - a.cy + a.sy)::DOUBLE / (b.cn - a.cn + a.n) AS m FROM c a JOIN c b ON a.i <= b.i), w AS (SELECT j, k AS i, min(m) OVER (PARTITION BY j ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS v FROM m),
f AS (SELECT i, max(v) AS v FROM w GROUP BY i) SELECT id, round(v, 6) AS calibrated FROM scored JOIN p USING (s) JOIN f USING (i)""")
def h06(s: SparkSession, d: str) -> DataFrame:
    return M.isotonic(X(s, d), "s", "y").select("id", R6(F.col("calibrated"), "calibrated"))


@query("h07_threshold_grid", f"""WITH {V.SCORED}, q AS (SELECT DISTINCT round(unnest(quantile_cont(s, [{QS}])), 6) AS t FROM scored), g AS (SELECT a.t AS low, b.t AS high FROM q a JOIN q b ON a.t < b.t), x AS (SELECT low, high, gold, CASE WHEN s < low THEN 'ignorieren' WHEN s < high THEN 'scannen' ELSE 'lesenswert' END AS pred FROM scored, g),
k AS (SELECT unnest(['lesenswert', 'scannen', 'ignorieren']) AS c), f AS (SELECT low, high, c, 2.0::DOUBLE * count(*) FILTER (gold = c AND pred = c) / nullif(count(*) FILTER (gold = c) + count(*) FILTER (pred = c), 0) AS f FROM x, k GROUP BY 1, 2, 3), m AS (SELECT low, high, round(sum(coalesce(f, 0)) / 3, 6) AS macro_f1 FROM f GROUP BY 1, 2)
SELECT low, high, macro_f1 FROM m ORDER BY macro_f1 DESC, low, high LIMIT 1""")
def h07(s: SparkSession, d: str) -> DataFrame:
    return M.grid_search(X(s, d), "s", "gold", ("ignorieren", "scannen", "lesenswert"), 9)


@query("h08_missed_positive_recovery", f"WITH {V.SCORED} SELECT count(*) AS missed, round(avg(CAST(t >= 0.5 AS INT)), 6) AS recovered FROM scored WHERE gold = 'lesenswert' AND pred <> 'lesenswert'")
def h08(s: SparkSession, d: str) -> DataFrame:
    return X(s, d).where("gold = 'lesenswert' AND pred <> 'lesenswert'").agg(F.count("*").alias("missed"), R6(F.avg((F.col("t") >= 0.5).cast("int")), "recovered"))


_DIGEST = "CAST(('0x' || substr(md5({seed} || ':' || id), 1, 13)) AS BIGINT)"
_FOLDS = "f AS (SELECT *, CAST((row_number() OVER (PARTITION BY {by}y ORDER BY {digest}) - 1) % 5 AS INT) AS fold FROM {rows})"
_OOF = """c AS (SELECT {by}grp, fold, sum(y) AS sy, count(*) AS n FROM f GROUP BY ALL), g AS (SELECT {by}fold, (sum(sum(sy)) OVER ({over}) - sum(sy))::DOUBLE / (sum(sum(n)) OVER ({over}) - sum(n)) AS rate FROM c GROUP BY {by}fold),
p AS (SELECT {by}grp, fold, (sum(sy) OVER (PARTITION BY {by}grp) - sy + 5 * rate) / (sum(n) OVER (PARTITION BY {by}grp) - n + 5) AS oof FROM c JOIN g USING ({by}fold)), o AS (SELECT f.*, oof FROM f JOIN p USING ({by}grp, fold))"""


@query("h09_folds", f"WITH {V.SCORED}, {_FOLDS.format(by='', digest=_DIGEST.format(seed=42), rows='scored')}, {_OOF.format(by='', over='')} SELECT id, y, fold, round(oof, 6) AS oof FROM o")
def h09(s: SparkSession, d: str) -> DataFrame:
    return M.out_of_fold_prior(M.folds(X(s, d), "id", "y"), "grp", "y").select("id", "y", "fold", R6(F.col("oof"), "oof"))


@query("h10_group_auc", f"""WITH {V.SCORED}, p AS (SELECT a.grp, sum(CASE WHEN a.s > b.s THEN 1.0::DOUBLE WHEN a.s = b.s THEN 0.5 ELSE 0 END) / count(*) AS auc FROM scored a JOIN scored b ON a.grp = b.grp AND a.y = 1 AND b.y = 0 GROUP BY 1), n AS (SELECT grp, count(*) AS n, sum(y) AS pos FROM scored GROUP BY 1)
SELECT round(sum(auc * n) / sum(n), 6) AS auc, count(*) AS groups FROM p JOIN n USING (grp) WHERE n >= 10 AND pos >= 5""")
def h10(s: SparkSession, d: str) -> DataFrame:
    return M.group_auc(X(s, d), "grp", "s", "y", 10, 5).select(R6(F.col("auc"), "auc"), "groups")


@query("h11_seed_stability", f"""WITH {V.SCORED}, m AS (SELECT *, unnest(range(20)) AS seed FROM scored), {_FOLDS.format(by='seed, ', digest=_DIGEST.format(seed='seed'), rows='m')}, {_OOF.format(by='seed, ', over='PARTITION BY seed')},
k AS (SELECT seed, y, rank() OVER (PARTITION BY seed ORDER BY round(oof, 12)) + (count(*) OVER (PARTITION BY seed, round(oof, 12)) - 1) / 2.0::DOUBLE AS r FROM o), a AS (SELECT seed, (sum(r) FILTER (y = 1) - sum(y) * (sum(y) + 1) / 2.0::DOUBLE) / (sum(y) * sum(1 - y)) AS v FROM k GROUP BY seed)
SELECT round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std, round(min(v), 6) AS low, round(max(v), 6) AS high FROM a""")
def h11(s: SparkSession, d: str) -> DataFrame:
    return M.seed_stability(X(s, d), "id", "grp", "y").select(*[R6(F.col(c), c) for c in ("mean", "std", "low", "high")])


@query("h12_error_overlap", f"WITH {V.SCORED}, o AS (SELECT gold = pred AS a_ok, (t >= 0.5) = (y = 1) AS b_ok FROM scored) SELECT a_ok, b_ok, count(*) AS n, round(count(*)::DOUBLE / (SELECT count(*) FROM scored), 6) AS share FROM o GROUP BY 1, 2")
def h12(s: SparkSession, d: str) -> DataFrame:
    x = X(s, d)
    total = x.agg(F.count("*").alias("t_"))
    g = x.groupBy((F.col("gold") == F.col("pred")).alias("a_ok"), ((F.col("t") >= 0.5) == (F.col("y") == 1)).alias("b_ok")).agg(F.count("*").alias("n"))
    return g.crossJoin(F.broadcast(total)).select("a_ok", "b_ok", "n", R6(F.col("n") / F.col("t_"), "share"))


@query("h13_rule_quality", f"WITH {V.SCORED} SELECT count(*) FILTER (t > 0.7) AS fired, round(count(*) FILTER (t > 0.7 AND y = 1)::DOUBLE / count(*) FILTER (t > 0.7), 6) AS precision, round(count(*) FILTER (t > 0.7 AND y = 1)::DOUBLE / sum(y), 6) AS recall, round(count(*) FILTER (t > 0.7 AND y = 1)::DOUBLE / count(*) FILTER (t > 0.7) / avg(y), 6) AS lift FROM scored")
def h13(s: SparkSession, d: str) -> DataFrame:
    return M.rule_quality(X(s, d), F.col("t") > 0.7, "y").select("fired", *[R6(F.col(c), c) for c in ("precision", "recall", "lift")])


@query("h14_group_base_rates", f"WITH {V.SCORED} SELECT mode, count(*) FILTER (gold = 'lesenswert') AS lesenswert, count(*) FILTER (gold = 'scannen') AS scannen, count(*) FILTER (gold = 'ignorieren') AS ignorieren, round(avg(y), 6) AS rate FROM scored GROUP BY 1")
def h14(s: SparkSession, d: str) -> DataFrame:
    kinds = [F.count_if(F.col("gold") == c).alias(c) for c in CLASSES]
    return X(s, d).groupBy("mode").agg(*kinds, R6(F.avg("y"), "rate"))


@query("h15_majority_baseline", f"WITH {V.SCORED}, c AS (SELECT gold, count(*) AS n FROM scored GROUP BY 1) SELECT max_by(gold, (n, gold)) AS label, round(2.0::DOUBLE * max(n) / (max(n) + sum(n)) / 3, 6) AS macro_f1 FROM c")
def h15(s: SparkSession, d: str) -> DataFrame:
    return M.majority_baseline(X(s, d), "gold", CLASSES)


@query("h15_random_baseline")
def h15r(s: SparkSession, d: str) -> DataFrame:
    one = lambda name, uniform: M.random_baseline(X(s, d), "gold", CLASSES, 2000, 42, uniform).select(F.lit(name).alias("kind"), "macro_f1")
    return one("by class frequency", False).unionByName(one("all classes alike", True))


_RUNS = "u AS (SELECT run, id, gold, CASE WHEN (id * 7 + run * 13) % 10 = 0 THEN CASE pred WHEN 'ignorieren' THEN 'scannen' ELSE 'ignorieren' END ELSE pred END AS verdict FROM scored, (SELECT unnest(range(3)) AS run))"


@query("h16_repeat_run_noise", f"WITH {V.SCORED}, {_RUNS}, a AS (SELECT run, avg(CAST((verdict = 'ignorieren') = (gold = 'ignorieren') AS INT)) AS v FROM u GROUP BY 1) SELECT round(stddev_samp(v), 6) AS std, round(min(v), 6) AS low, round(max(v), 6) AS high, round(avg(v), 6) AS mean FROM a")
def h16(s: SparkSession, d: str) -> DataFrame:
    # three runs that judge every case, each of them changing its mind about other ones
    runs = X(s, d).withColumn("run", F.explode(F.sequence(F.lit(0), F.lit(2))))
    other = F.when(F.col("pred") == "ignorieren", "scannen").otherwise("ignorieren")
    runs = runs.withColumn("verdict", F.when((F.col("id") * 7 + F.col("run") * 13) % 10 == 0, other).otherwise(F.col("pred")))
    return M.repeat_noise(runs, "run", "verdict", "gold", "ignorieren").select(*[R6(F.col(c), c) for c in ("std", "low", "high", "mean")])


def _quota_sql() -> str:
    """Quotas one after the other, each without what those before it took; then a draw."""
    steps = []
    for i, (rule, side) in enumerate((r, s) for r in ("s < 0.3", "z = 1", "grp IN ('src1', 'src2')") for s in ("y = 1", "y = 0")):
        before = "".join(f" AND id NOT IN (SELECT id FROM q{j})" for j in range(i))
        steps.append(f"q{i} AS MATERIALIZED (SELECT id, {i // 2} AS k FROM scored WHERE {rule} AND {side}{before} ORDER BY id LIMIT 4)")
    taken = " UNION ALL ".join(f"SELECT id, k FROM q{i}" for i in range(6))
    rest = "SELECT id, NULL FROM scored WHERE id NOT IN (SELECT id FROM t) ORDER BY md5('11:' || id) LIMIT (SELECT 40 - count(*) FROM t)"
    return f"WITH {V.SCORED}, {', '.join(steps)}, t AS (SELECT id, ['low', 'toxic', 'sources'][k + 1] AS rule FROM ({taken})) SELECT id, rule FROM t UNION ALL ({rest})"


@query("h17_quota_sampling", _quota_sql())
def h17(s: SparkSession, d: str) -> DataFrame:
    rules = {"low": F.col("s") < 0.3, "toxic": F.col("z") == 1, "sources": F.col("grp").isin("src1", "src2")}
    return M.quota_sample(X(s, d), "id", rules, F.col("y") == 1, 40)

