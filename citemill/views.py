"""The library's roles (articles, references, verdicts, calls, ...) played by the driver's tables.

Each function has its SQL twin, a common table expression for the oracle's queries.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# fixed values: the verdict labels, best first, and those that keep an article
VERDICTS = ("pflichtlektuere", "lesenswert", "scannen", "ignorieren")
KEEP = VERDICTS[:3]
AS_OF = 2001  # the last year of the articles


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, year, journal, cluster, author, agent and user verdicts, cost, fetched timestamp, title, doi."""
    t = lambda n: table(spark, sf_dir, n)
    # nation and region are dimensions of a fixed size
    places = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    rows = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(F.broadcast(places), F.col("c_nationkey") == F.col("n_nationkey"))
    status, prio = F.col("o_orderstatus"), F.col("o_orderpriority")
    return rows.select(
        F.col("o_orderkey").alias("id"), F.year("o_orderdate").alias("year"), F.col("n_name").alias("journal"), F.col("r_name").alias("cluster"), F.col("o_custkey").alias("author"), F.col("c_name").alias("author_name"), F.col("c_mktsegment").alias("segment"),
        F.when(status == "F", "ignorieren").when(status == "O", "scannen").otherwise("lesenswert").alias("agent"),
        F.when(prio == "1-URGENT", "pflichtlektuere").when(prio == "5-LOW", "ignorieren").when(prio == "2-HIGH", "").alias("user"),
        F.col("o_totalprice").alias("cost"), F.col("o_orderdate").alias("fetched"),
        F.concat(F.col("c_mktsegment"), F.lit(" study "), F.col("o_orderkey").cast("string")).alias("title"),
    )


ART = """art AS (SELECT o_orderkey AS id, CAST(year(o_orderdate) AS INT) AS year, n_name AS journal, r_name AS cluster, o_custkey AS author, c_name AS author_name, c_mktsegment AS segment,
  CASE o_orderstatus WHEN 'F' THEN 'ignorieren' WHEN 'O' THEN 'scannen' ELSE 'lesenswert' END AS agent,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'pflichtlektuere' WHEN '5-LOW' THEN 'ignorieren' WHEN '2-HIGH' THEN '' END AS "user",
  o_totalprice AS cost, o_orderdate AS fetched, c_mktsegment || ' study ' || o_orderkey AS title
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""


def references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, ref): each work that an article cites, once."""
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_partkey").alias("ref")).distinct()


REF = "ref AS (SELECT DISTINCT l_orderkey AS id, l_partkey AS ref FROM lineitem)"


def works(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cited works: ref, title, brand, topic, year, doi (as sources spell it)."""
    p = table(spark, sf_dir, "part")
    key = F.col("p_partkey").cast("string")
    doi = F.concat(F.element_at(F.array(F.lit("https://doi.org/10.5555/"), F.lit("DOI:10.5555/"), F.lit("http://dx.doi.org/10.5555/")), (F.col("p_partkey") % 3 + 1).cast("int")), F.upper(F.translate("p_brand", "#", "-")), F.lit("."), key, F.when(F.col("p_partkey") % 2 == 0, F.lit(".")).otherwise(F.lit("")))
    return p.select(F.col("p_partkey").alias("ref"), F.col("p_name").alias("title"), F.col("p_brand").alias("brand"), F.col("p_type").alias("topic"), F.col("p_size").alias("size"), (F.lit(1990) + F.col("p_size") % 30).cast("int").alias("year"), doi.alias("doi"))


WORK = """work AS (SELECT p_partkey AS ref, p_name AS title, p_brand AS brand, p_type AS topic, p_size AS size, CAST(1990 + p_size % 30 AS INT) AS year,
  CASE p_partkey % 3 WHEN 0 THEN 'https://doi.org/10.5555/' WHEN 1 THEN 'DOI:10.5555/' ELSE 'http://dx.doi.org/10.5555/' END || upper(replace(p_brand, '#', '-')) || '.' || p_partkey || CASE WHEN p_partkey % 2 = 0 THEN '.' ELSE '' END AS doi FROM part)"""


def citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Free-text citations of works: (ref, raw), of several house styles."""
    w = works(spark, sf_dir)
    year, title = F.col("year").cast("string"), F.initcap("title")
    name = F.concat(F.lit("Maker"), F.substring("brand", 7, 3))
    styles = [
        F.concat(name, F.lit(", K. ("), year, F.lit("a). "), title, F.lit(". Springer Verlag, 12(3), 45-67. https://doi.org/10.1/x")),
        F.concat(F.lit("J. "), name, F.lit(" & A. Other ("), year, F.lit("). "), title, F.lit(": results. In Proceedings of Things, pp. 3-9.")),
        F.concat(name, F.lit(", B., "), year, F.lit(", "), title, F.lit(", Vol. 7, ISBN 978-3-16")),
        F.concat(title, F.lit(" without any date")),
    ]
    return w.select("ref", F.element_at(F.array(*styles), (F.col("ref") % 4 + 1).cast("int")).alias("raw"))


CITE = """cite AS (SELECT ref, CASE ref % 4
  WHEN 0 THEN 'Maker' || substr(brand, 7, 3) || ', K. (' || year || 'a). ' || cap || '. Springer Verlag, 12(3), 45-67. https://doi.org/10.1/x'
  WHEN 1 THEN 'J. Maker' || substr(brand, 7, 3) || ' & A. Other (' || year || '). ' || cap || ': results. In Proceedings of Things, pp. 3-9.'
  WHEN 2 THEN 'Maker' || substr(brand, 7, 3) || ', B., ' || year || ', ' || cap || ', Vol. 7, ISBN 978-3-16'
  ELSE cap || ' without any date' END AS raw
  FROM (SELECT *, array_to_string(list_transform(string_split(title, ' '), lambda x: upper(x[1]) || lower(x[2:])), ' ') AS cap FROM work))"""


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A ledger of model calls: id, ts, endpoint, model, cost, tokens in and cached, status."""
    e = table(spark, sf_dir, "events")
    tokens = F.get_json_object("props", "$.k").cast("long")
    return e.select(
        F.col("event_id").alias("id"), "ts", F.col("event_type").alias("endpoint"), F.concat(F.lit("model-"), (F.col("user_id") % 3).cast("string")).alias("model"), F.col("value").alias("cost"),
        tokens.alias("tokens_in"), F.when(F.col("event_id") % 4 == 0, F.lit(0)).otherwise(tokens * 5).cast("long").alias("tokens_cached"), F.when(F.col("event_id") % 11 == 0, "error").when(F.col("event_id") % 5 == 0, F.lit(None)).otherwise("ok").alias("status"),
    )


CALL = """call AS (SELECT event_id AS id, ts, event_type AS endpoint, 'model-' || (user_id % 3) AS model, value AS cost, CAST(json_extract_string(props, '$.k') AS BIGINT) AS tokens_in,
  CASE WHEN event_id % 4 = 0 THEN 0 ELSE CAST(json_extract_string(props, '$.k') AS BIGINT) * 5 END AS tokens_cached,
  CASE WHEN event_id % 11 = 0 THEN 'error' WHEN event_id % 5 = 0 THEN NULL ELSE 'ok' END AS status FROM events)"""


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled rows with two scores in [0, 1]: id, grp, y, s, t, folded classes gold and pred."""
    d, lab = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    rows = lab.join(d.select("doc_id", "source", "n_chars", "lang"), "doc_id")
    s = F.col("n_chars") % 1000 / 1000.0
    t = F.col("doc_id") * 37 % 500 / 500.0
    return rows.select(
        F.col("doc_id").alias("id"), F.col("source").alias("grp"), F.col("lang").alias("mode"), F.col("quality").alias("y"), F.col("toxic").alias("z"), s.alias("s"), t.alias("t"),
        F.when(F.col("toxic") == 1, "ignorieren").when(F.col("quality") == 1, "lesenswert").otherwise("scannen").alias("gold"), F.when(s < 0.2, "ignorieren").when(s < 0.4, "scannen").otherwise("lesenswert").alias("pred"),
    )


SCORED = """scored AS (SELECT l.doc_id AS id, d.source AS grp, d.lang AS mode, l.quality AS y, l.toxic AS z, n_chars % 1000 / 1000.0::DOUBLE AS s, l.doc_id * 37 % 500 / 500.0::DOUBLE AS t,
  CASE WHEN toxic = 1 THEN 'ignorieren' WHEN quality = 1 THEN 'lesenswert' ELSE 'scannen' END AS gold,
  CASE WHEN n_chars % 1000 / 1000.0::DOUBLE < 0.2 THEN 'ignorieren' WHEN n_chars % 1000 / 1000.0::DOUBLE < 0.4 THEN 'scannen' ELSE 'lesenswert' END AS pred
  FROM labels l JOIN documents d USING (doc_id))"""
