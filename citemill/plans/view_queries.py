"""Queries of section I: views, ordering and orchestration; and of the primitives in section J."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citemill import views as V
from citemill.operators import parsing
from citemill.operators import routing as R
from citemill.plans.registry import query
from citemill.streaming import ledger

A = V.articles
_EFF = "coalesce(nullif(\"user\", ''), agent)"
_RK = "CASE {c} WHEN 'pflichtlektuere' THEN 0 WHEN 'lesenswert' THEN 1 WHEN 'scannen' THEN 2 WHEN 'ignorieren' THEN 3 ELSE 4 END"


@query("i01_digest_ordering", f"WITH {V.ART} SELECT id, {_EFF} AS verdict, CAST({_RK.format(c=_EFF)} AS INT) AS rank FROM art WHERE id % 10 <> 0")
def i01(s: SparkSession, d: str) -> DataFrame:
    return R.digest(A(s, d).withColumn("archived", F.col("id") % 10 == 0)).select("id", "verdict", "rank")


@query("i02_project_grouping", f"WITH {V.ART} SELECT coalesce(CASE WHEN segment IN ('MACHINERY', 'BUILDING') THEN segment END, 'rest') AS project, count(*) AS n FROM art GROUP BY 1")
def i02(s: SparkSession, d: str) -> DataFrame:
    keys = F.filter(F.array("segment"), lambda x: x.isin("MACHINERY", "BUILDING"))
    return A(s, d).groupBy(F.coalesce(F.try_element_at(keys, F.lit(1)), F.lit("rest")).alias("project")).agg(F.count("*").alias("n"))


@query("i03_review_queue", f"WITH {V.ART} SELECT id, agent FROM art WHERE coalesce(\"user\", '') = '' ORDER BY CASE agent WHEN 'lesenswert' THEN 0 WHEN 'scannen' THEN 1 ELSE 2 END, id LIMIT 100")
def i03(s: SparkSession, d: str) -> DataFrame:
    order = F.when(F.col("agent") == "lesenswert", 0).when(F.col("agent") == "scannen", 1).otherwise(2)
    return A(s, d).where(F.coalesce("user", F.lit("")) == "").orderBy(order, "id").limit(100).select("id", "agent")


@query("i04_override_view", f"WITH {V.ART} SELECT id, CASE WHEN {_RK.format(c='\"user\"')} < {_RK.format(c='agent')} THEN 'up' WHEN {_RK.format(c='\"user\"')} > {_RK.format(c='agent')} THEN 'down' ELSE 'confirm' END AS direction FROM art WHERE \"user\" <> ''")
def i04(s: SparkSession, d: str) -> DataFrame:
    u, a = R.rank(F.col("user")), R.rank(F.col("agent"))
    return A(s, d).where("user <> ''").select("id", F.when(u < a, "up").when(u > a, "down").otherwise("confirm").alias("direction"))


@query("i05_blind_sample", f"WITH {V.ART}, b AS (SELECT CASE WHEN cost < 100000 THEN 'low' ELSE 'high' END AS bucket, count(*) AS n FROM art GROUP BY 1) SELECT bucket, least(n, 25) AS n FROM b")
def i05(s: SparkSession, d: str) -> DataFrame:
    out = R.blind_sample(A(s, d), "id", F.when(F.col("cost") < 100000, "low").otherwise("high"), 25, 42)
    return out.groupBy("bucket").agg(F.count("*").alias("n"))


@query("i06_batch_cascade", f"""WITH {V.ART} SELECT CASE WHEN id % 23 = 0 THEN 'junk' WHEN author % 50 = 0 THEN 'own' WHEN id % 9 = 0 THEN 'no_abstract' WHEN cost > 400000 THEN 'auto_pass' WHEN agent = 'ignorieren' AND year < 1997 THEN 'prefilter' WHEN agent = 'ignorieren' THEN 'screened_out' WHEN segment = 'HOUSEHOLD' AND agent = 'scannen' THEN 'tier_c' ELSE 'agent' END AS stage, count(*) AS n FROM art GROUP BY 1""")
def i06(s: SparkSession, d: str) -> DataFrame:
    c = F.col
    stages = [
        ("junk", c("id") % 23 == 0), ("own", c("author") % 50 == 0), ("no_abstract", c("id") % 9 == 0), ("auto_pass", c("cost") > 400000), ("prefilter", (c("agent") == "ignorieren") & (c("year") < 1997)),
        ("screened_out", c("agent") == "ignorieren"), ("tier_c", (c("segment") == "HOUSEHOLD") & (c("agent") == "scannen")),
    ]
    return R.cascade(A(s, d), stages, "agent").groupBy("stage").agg(F.count("*").alias("n"))


@query("i07_cost_breaker", f"WITH {V.CALL}, r AS (SELECT endpoint, id, coalesce(sum(cost) OVER w, 0) AS spent, count(*) OVER w AS n FROM call WINDOW w AS (PARTITION BY endpoint ORDER BY ts, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) SELECT endpoint, count(*) AS ran FROM r WHERE NOT (n >= 3 AND spent + spent / n > 5000) GROUP BY 1")
def i07(s: SparkSession, d: str) -> DataFrame:
    return R.cost_breaker(V.calls(s, d), "ts", "id", "cost", 5000.0, by=["endpoint"]).where("runs").groupBy("endpoint").agg(F.count("*").alias("ran"))


@query("i08_available_now_job", f"WITH {V.CALL} SELECT strftime(ts, '%Y-%m-%d') AS day, endpoint, count(*) AS calls FROM call GROUP BY 1, 2")
def i08(s: SparkSession, d: str) -> DataFrame:
    return ledger.daily_job(s, d)


@query("i09_model_output_columns", "SELECT event_type AS verdict, count(*) AS n FROM events WHERE event_id % 3 < 2 GROUP BY 1")
def i09(s: SparkSession, d: str) -> DataFrame:
    raw = F.when(F.col("event_id") % 3 < 2, F.concat(F.lit("<VERDICT>\n"), "event_type", F.lit("</VERDICT>"))).otherwise("nothing")
    return V.table(s, d, "events").select(parsing.tag_body(raw, "verdict").alias("verdict")).where("verdict <> ''").groupBy("verdict").agg(F.count("*").alias("n"))


@query("i10_markdown_report", f"WITH {V.ART}, g AS (SELECT journal, count(*) AS n, round(avg(cost), 2) AS m FROM art GROUP BY 1) SELECT '| ' || journal || ' | ' || n || ' |' AS line FROM g")
def i10(s: SparkSession, d: str) -> DataFrame:
    g = A(s, d).groupBy("journal").agg(F.count("*").alias("n"))
    return g.select(F.concat(F.lit("| "), "journal", F.lit(" | "), F.col("n").cast("string"), F.lit(" |")).alias("line"))


@query("j01_grouping_sets", f"WITH {V.CALL} SELECT endpoint, model, count(*) AS calls, round(sum(cost), 4) AS cost FROM call GROUP BY GROUPING SETS ((endpoint), (model), (endpoint, model))")
def j01(s: SparkSession, d: str) -> DataFrame:
    c = V.calls(s, d)
    return c.groupingSets([[c.endpoint], [c.model], [c.endpoint, c.model]], c.endpoint, c.model).agg(F.count("*").alias("calls"), F.round(F.sum("cost"), 4).alias("cost"))


@query("j02_schema_evolution", f"WITH {V.ART} SELECT id, agent, CASE WHEN year >= 1999 THEN segment END AS segment FROM art")
def j02(s: SparkSession, d: str) -> DataFrame:
    a = A(s, d)
    return a.where("year < 1999").select("id", "agent").unionByName(a.where("year >= 1999").select("id", "agent", "segment"), allowMissingColumns=True)


@query("z01_stream_daily_rollup", f"WITH {V.CALL} SELECT strftime(ts, '%Y-%m-%d') AS day, endpoint, count(*) AS calls FROM call WHERE date_trunc('day', ts) < (SELECT date_trunc('day', max(ts) - INTERVAL 1 DAY) FROM call) GROUP BY 1, 2")
def z01(s: SparkSession, d: str) -> DataFrame:
    return ledger.stream_rollup(s, d)


@query("z02_stream_dedup", "SELECT DISTINCT user_id, event_type FROM events")
def z02(s: SparkSession, d: str) -> DataFrame:
    return ledger.stream_dedup(s, d)


@query("z03_stream_upsert", "SELECT user_id, count(*) AS n, max(event_id) AS last_event FROM events GROUP BY 1")
def z03(s: SparkSession, d: str) -> DataFrame:
    return ledger.stream_upsert(s, d)


@query("z04_stream_waves", """WITH g AS (SELECT user_id, ts, value, CASE WHEN ts <= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events), w AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS wave FROM g)
SELECT user_id AS key, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS calls, round(sum(value), 4) AS cost FROM w GROUP BY user_id, wave HAVING max(ts) + INTERVAL 6 HOUR <= (SELECT max(ts) - INTERVAL 1 DAY FROM events)""")
def z04(s: SparkSession, d: str) -> DataFrame:
    return ledger.stream_waves(s, d).select("key", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "calls", F.round("cost", 4).alias("cost"))


@query("z05_stream_cache", """WITH RECURSIVE f(user_id, ts) AS (SELECT user_id, min(ts) FROM events GROUP BY 1 UNION ALL SELECT user_id, ts FROM (SELECT e.user_id, e.ts, row_number() OVER (PARTITION BY e.user_id ORDER BY e.ts) AS n FROM f JOIN events e ON e.user_id = f.user_id AND e.ts > f.ts + INTERVAL 21 DAY) WHERE n = 1)
SELECT event_id AS id, NOT EXISTS (SELECT 1 FROM f WHERE f.user_id = e.user_id AND f.ts = e.ts) AS hit FROM events e""")
def z05(s: SparkSession, d: str) -> DataFrame:
    return ledger.stream_cache(s, d)
