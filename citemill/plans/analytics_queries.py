"""Queries of section F: aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from citemill import views as V
from citemill.operators import analytics as A
from citemill.operators import coupling as C
from citemill.operators.graphs import communities
from citemill.operators import search as S
from citemill.operators.ordered import running
from citemill.plans.join_queries import _DF, _OWN, BRIDGE, bridge, own
from citemill.plans.registry import query
from citemill.shared import scratch

T = V.table
count = lambda *c: F.count("*").alias(*(c or ("n",)))
art_refs = lambda s, d: V.references(s, d).join(V.articles(s, d).select("id", "author", "journal", "year", "cluster"), "id")
AR = "ar AS (SELECT ref.id, ref.ref, author, journal, year, cluster FROM ref JOIN art USING (id))"


@query("f01_cited_work_ranking", f"""WITH {V.ART}, {V.REF}, {AR}, c AS (SELECT ref, count(*) AS n, count(DISTINCT author) AS citers FROM ar GROUP BY ref HAVING count(*) >= 3),
r AS (SELECT *, row_number() OVER (ORDER BY n DESC, ref) AS r, count(*) OVER () AS t FROM c) SELECT ref, n, citers FROM r WHERE r <= greatest(1, CAST(floor(t * 0.1) AS BIGINT))""")
def f01(s: SparkSession, d: str) -> DataFrame:
    return A.cited_works(art_refs(s, d), 2, 0.1)


@query("f01_cited_work_details", f"""WITH {V.ART}, {V.REF}, {AR}, {V.WORK}, c AS (SELECT ref, count(*) AS n, count(DISTINCT author) AS citers FROM ar GROUP BY ref HAVING count(*) >= 3),
r AS (SELECT *, row_number() OVER (ORDER BY n DESC, ref) AS r, count(*) OVER () AS t FROM c), k AS (SELECT ref, n, citers FROM r WHERE r <= greatest(1, CAST(floor(t * 0.1) AS BIGINT))), a AS (SELECT ar.*, work.title || ' in ' || ar.id AS raw, row_number() OVER (PARTITION BY ar.ref ORDER BY ar.id) AS place FROM ar JOIN work USING (ref)),
y AS (SELECT ref, string_agg(year || ':' || n, ',' ORDER BY year) AS years FROM (SELECT ref, year, count(*) AS n FROM a GROUP BY 1, 2) GROUP BY ref)
SELECT k.ref, k.n, k.citers, any_value(years) AS years, min(CASE WHEN place = 1 THEN id % 3 END) AS seen, string_agg(raw, '|' ORDER BY place) FILTER (place <= 3) AS samples, md5(string_agg(DISTINCT author::VARCHAR, ',' ORDER BY author::VARCHAR)) AS citing FROM k JOIN a USING (ref) JOIN y USING (ref) GROUP BY 1, 2, 3""")
def f01_details(s: SparkSession, d: str) -> DataFrame:
    refs = art_refs(s, d)
    raw = F.concat("title", F.lit(" in "), F.col("id").cast("string"))
    told = refs.withColumnRenamed("year", "citing_year").join(V.works(s, d).select("ref", "title", "doi"), "ref").withColumns({"raw": raw, "year": F.col("id") % 3}).withColumn("author", F.col("author").cast("string"))
    out = A.cited_work_details(A.cited_works(refs, 2, 0.1), told)
    years = F.array_join(F.transform(F.map_entries("years"), lambda e: F.concat(e["key"].cast("string"), F.lit(":"), e["value"].cast("string"))), ",")
    return out.select("ref", "n", "citers", years.alias("years"), F.col("seen.year").alias("seen"), F.array_join("samples", "|").alias("samples"), F.md5(F.array_join("citing", ",").cast("binary")).alias("citing"))


@query("f02_trend_label", f"""WITH {V.ART}, {V.REF}, {AR}, c AS (SELECT ref, year, count(*) AS n FROM ar GROUP BY 1, 2), g AS (SELECT ref, count(*) AS ys, sum(n) AS t, min(year) AS a, max(year) AS z, max_by(year, (n, year)) AS p, max(n) AS m FROM c GROUP BY ref)
SELECT ref, CASE WHEN ys < 3 OR t < 5 THEN CASE WHEN ys = 1 THEN 'only ' || a ELSE '' END WHEN p = z THEN 'rising' WHEN p = a THEN 'falling' WHEN m::DOUBLE / t > 0.5 THEN 'peak ' || p ELSE 'stable' END AS trend FROM g""")
def f02(s: SparkSession, d: str) -> DataFrame:
    c = art_refs(s, d).groupBy("ref", "year").agg(count())
    return A.trend(c, "ref", "year", "n")


_SPELL = "CASE l_linenumber % 3 WHEN 0 THEN 'The ' || s_name WHEN 1 THEN upper(s_name) || '.' ELSE s_name END"


@query("f03_cited_journals", f"""WITH r AS (SELECT l_orderkey, {_SPELL} AS raw, lower(s_name) AS journal, l_suppkey FROM lineitem JOIN supplier ON l_suppkey = s_suppkey), k AS (SELECT journal, raw, count(*) AS k FROM r GROUP BY 1, 2)
SELECT r.journal, count(*) AS n, count(DISTINCT l_orderkey) AS articles, (SELECT max_by(raw, (k, raw)) FROM k WHERE k.journal = r.journal) AS spelling, max(l_suppkey) % 4 = 0 AS tracked FROM r GROUP BY r.journal""")
def f03(s: SparkSession, d: str) -> DataFrame:
    sup = T(s, d, "supplier")
    k, name = F.col("l_linenumber") % 3, F.col("s_name")
    raw = F.when(k == 0, F.concat(F.lit("The "), name)).when(k == 1, F.concat(F.upper(name), F.lit("."))).otherwise(name)
    rows = T(s, d, "lineitem").join(sup, F.col("l_suppkey") == F.col("s_suppkey")).select("l_orderkey", raw.alias("raw"))
    return A.cited_journals(rows, "raw", "l_orderkey", sup.where("s_suppkey % 4 = 0").select(name.alias("name")))


@query("f04_topic_trajectories", f"""WITH {V.ART}, {V.REF}, {V.WORK}, x AS (SELECT DISTINCT art.id, journal, topic, CASE WHEN art.year BETWEEN 1995 AND 1997 THEN 'e' WHEN art.year BETWEEN 1999 AND 2001 THEN 'l' END AS w FROM art JOIN ref USING (id) JOIN work USING (ref)), r AS (SELECT * FROM x WHERE w IS NOT NULL),
p AS (SELECT journal, count(DISTINCT id) FILTER (w = 'e') AS ne, count(DISTINCT id) FILTER (w = 'l') AS nl FROM r GROUP BY 1 HAVING count(DISTINCT id) FILTER (w = 'e') >= 30 AND count(DISTINCT id) FILTER (w = 'l') >= 30),
c AS (SELECT topic, journal, ne, nl, count(DISTINCT id) FILTER (w = 'e') AS ke, count(DISTINCT id) FILTER (w = 'l') AS kl FROM r JOIN p USING (journal) GROUP BY ALL)
SELECT topic, round(sum(kl::DOUBLE / nl - ke::DOUBLE / ne) / (SELECT count(*) FROM p), 6) AS within, round(sum(kl)::DOUBLE / (SELECT sum(nl) FROM p) - sum(ke)::DOUBLE / (SELECT sum(ne) FROM p), 6) AS pooled FROM c GROUP BY topic HAVING sum(ke) + sum(kl) >= 40""")
def f04(s: SparkSession, d: str) -> DataFrame:
    rows = V.articles(s, d).select("id", "journal", "year").join(V.references(s, d), "id").join(V.works(s, d).select("ref", "topic"), "ref")
    out = A.trajectories(rows, (1995, 1997), (1999, 2001), 30, 3, 40)
    return out.select("topic", F.round("within", 6).alias("within"), F.round("pooled", 6).alias("pooled"))


EDGES = f"""d AS (SELECT ref, count(*) AS df FROM ref GROUP BY ref HAVING count(*) BETWEEN 2 AND 50), k AS (SELECT id, ref.ref, ln((SELECT count(DISTINCT id) FROM ref)::DOUBLE / df) AS w FROM ref JOIN d ON d.ref = ref.ref),
e AS (SELECT a.id AS a, b.id AS b, count(*) AS shared, sum(a.w) AS weight FROM k a JOIN k b ON a.ref = b.ref AND a.id < b.id GROUP BY 1, 2 HAVING count(*) >= 2)"""


def edges(s: SparkSession, d: str) -> DataFrame:
    return C.coupling_edges(V.references(s, d), 2, 50, 2)


@query("f05_coupling_edges", f"WITH {V.REF}, {EDGES} SELECT a, b, shared, round(weight, 6) AS weight FROM e")
def f05(s: SparkSession, d: str) -> DataFrame:
    return edges(s, d).select("a", "b", "shared", F.round("weight", 6).alias("weight"))


@query("f05_communities")
def f05c(s: SparkSession, d: str) -> DataFrame:
    return communities(edges(s, d))


@query("f06_community_profile", f"""WITH {V.ART}, {BRIDGE}, m AS (SELECT CAST(author % 40 AS INT) AS community, journal, year FROM art), j AS (SELECT community, journal, count(*) AS k FROM m GROUP BY 1, 2), t AS (SELECT community, max_by(journal, (k, journal)) AS top_journal, max(k) AS tn FROM j GROUP BY 1),
s AS (SELECT community, count(*) AS size, list_sort(list(year)) AS y FROM m GROUP BY 1), c AS (SELECT community, cluster, sum(k) AS k FROM j JOIN bridge USING (journal) GROUP BY 1, 2), x AS (SELECT community, count(DISTINCT cluster) AS f FROM c JOIN s USING (community) WHERE cluster IN ('AFRICA', 'ASIA', 'EUROPE', 'REGION_1', 'REGION_2', 'REGION_3') AND k::DOUBLE / size >= 0.25 GROUP BY 1)
SELECT community, size, top_journal, round(tn::DOUBLE / size, 6) AS concentration, coalesce(f, 0) >= 2 AS cross_field, y[CAST(round((size - 1) * 0.5::DOUBLE) AS INT) + 1] AS median, y[CAST(round((size - 1) * 0.25::DOUBLE) AS INT) + 1] AS q1, y[CAST(round((size - 1) * 0.75::DOUBLE) AS INT) + 1] AS q3 FROM s JOIN t USING (community) LEFT JOIN x USING (community)""")
def f06(s: SparkSession, d: str) -> DataFrame:
    m = V.articles(s, d).select((F.col("author") % 40).cast("int").alias("community"), "journal", "year")
    return A.community_profile(m, bridge(s, d), ["AFRICA", "ASIA", "EUROPE", "REGION_1", "REGION_2", "REGION_3"])


def _ranked_sql(by: str, parts: dict[str, tuple[str, int | None]], extra: str = "") -> str:
    """SQL for facets: each a query of (by, value, weight), with the number of values to keep."""
    rows = " UNION ALL ".join(f"SELECT {by}, '{name}' AS facet, CAST(value AS VARCHAR) AS value, round(sum(weight), 6) AS weight FROM ({sql}) WHERE value IS NOT NULL GROUP BY 1, 3" for name, (sql, _) in parts.items())
    kept = " OR ".join(f"(facet = '{name}'{'' if most is None else f' AND rank <= {most}'})" for name, (_, most) in parts.items())
    return f"fr AS ({rows}), fk AS (SELECT *, CAST(row_number() OVER (PARTITION BY {by}, facet ORDER BY weight DESC, value) AS INT) AS rank FROM fr), facets AS (SELECT * FROM fk WHERE {kept})"


_COMMUNITY = _ranked_sql("community", {"journal": ("SELECT author % 40 AS community, journal AS value, 1.0::DOUBLE AS weight FROM ar0", 5), "topic": ("SELECT author % 40 AS community, topic AS value, 1.0::DOUBLE AS weight FROM ar JOIN work USING (ref)", 6), "base": ("SELECT author % 40 AS community, ref AS value, 1.0::DOUBLE AS weight FROM ar", 10)})


@query("f06_community_facets", f"""WITH {V.ART}, {V.REF}, {V.WORK}, {AR}, ar0 AS (SELECT * FROM art), {_COMMUNITY}, z AS (SELECT author % 40 AS community, count(*) AS size FROM art GROUP BY 1)
SELECT community, facet, value, weight, rank, round(weight / size, 6) AS share FROM facets JOIN z USING (community) WHERE facet <> 'base' OR weight >= 2""")
def f06_facets(s: SparkSession, d: str) -> DataFrame:
    """Journals, topics and cited works that a community has most of, with their share of its articles."""
    community = (F.col("author") % 40).alias("community")
    arts, refs = V.articles(s, d).select(community, "journal"), art_refs(s, d).join(V.works(s, d).select("ref", "topic"), "ref").select(community, "topic", "ref")
    found = A.facets(arts, "community", {"journal": (A.single(F.col("journal")), 5)}).unionByName(A.facets(refs, "community", {"topic": (A.single(F.col("topic")), 6), "base": (A.single(F.col("ref")), 10)}))
    size = arts.groupBy("community").agg(count("size"))
    return found.where("facet <> 'base' OR weight >= 2").join(size, "community").withColumn("share", F.round(F.col("weight") / F.col("size"), 6)).drop("size")


@query("f07_document_frequency", f"WITH {V.ART}, {V.REF}, {_OWN} SELECT ref, count(DISTINCT id) AS df FROM ref WHERE ref IN (SELECT ref FROM own) GROUP BY ref")
def f07(s: SparkSession, d: str) -> DataFrame:
    return C.document_frequency(V.references(s, d), own(s, d))


@query("f08_idf_weight", f"WITH {V.REF}, {V.WORK}, {_DF} SELECT work.ref, round(1 / ln(1 + greatest(1, coalesce(df, 1))), 6) AS w FROM work LEFT JOIN df ON df.ref = work.ref")
def f08(s: SparkSession, d: str) -> DataFrame:
    return V.works(s, d).select("ref").join(C.document_frequency(V.references(s, d)), "ref", "left").select("ref", F.round(C.idf(F.col("df")), 6).alias("w"))


def _topics(s: SparkSession, d: str) -> DataFrame:
    """(cluster, id, concept, score): concepts of articles, a missing score counting one half."""
    li = T(s, d, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_partkey").alias("ref"), F.when(F.col("l_linenumber") % 4 == 0, F.lit(0.5)).otherwise(F.col("l_discount") * 10).alias("score"))
    return li.join(V.works(s, d).select("ref", F.col("title").alias("concept")), "ref").join(V.articles(s, d).select("id", "cluster", "year", "journal"), "id")


_TOPICS = "tp AS (SELECT cluster, journal, art.year, art.id, work.title AS concept, CASE WHEN l_linenumber % 4 = 0 THEN 0.5 ELSE l_discount * 10 END AS score FROM lineitem JOIN work ON l_partkey = ref JOIN art ON l_orderkey = art.id)"


@query("f09_cluster_profile", f"WITH {V.ART}, {V.WORK}, {_TOPICS}, c AS (SELECT cluster, concept, round(sum(score), 4) AS score FROM tp GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY score DESC, concept) AS r FROM c) SELECT cluster, concept, score FROM r WHERE r <= 20")
def f09(s: SparkSession, d: str) -> DataFrame:
    c = _topics(s, d).groupBy("cluster", "concept").agg(F.round(F.sum("score"), 4).alias("score"))
    return c.withColumn("r", F.row_number().over(Window.partitionBy("cluster").orderBy(F.desc("score"), "concept"))).where("r <= 20").drop("r")


_CLUSTER = _ranked_sql("cluster", {
    "concept": ("SELECT cluster, concept AS value, score AS weight FROM tp", 20), "key_term": ("SELECT cluster, lower(concept) AS value, 1.0::DOUBLE AS weight FROM tp WHERE lower(concept) IN (SELECT lower(title) FROM work WHERE ref < 60)", 15),
    "verdict": ("SELECT cluster, coalesce(nullif(\"user\", ''), 'unverarbeitet') AS value, 1.0::DOUBLE AS weight FROM art", None), "year": ("SELECT cluster, year AS value, 1.0::DOUBLE AS weight FROM art", None),
})


@query("f09_cluster_facets", f"WITH {V.ART}, {V.WORK}, {_TOPICS}, {_CLUSTER} SELECT * FROM facets")
def f09_facets(s: SparkSession, d: str) -> DataFrame:
    """Of each cluster the weightiest concepts, those that are key terms of own works, verdicts and years."""
    keys = V.works(s, d).where("ref < 60").select(F.lower("title").alias("key")).distinct()
    topics = _topics(s, d).join(keys, F.lower("concept") == F.col("key"), "left")
    of_topics = A.facets(topics, "cluster", {"concept": (A.single(F.col("concept"), F.col("score")), 20), "key_term": (A.single(F.col("key")), 15)})
    verdict = F.coalesce(F.nullif("user", F.lit("")), F.lit("unverarbeitet"))
    return of_topics.unionByName(A.facets(V.articles(s, d), "cluster", {"verdict": (A.single(verdict), None), "year": (A.single(F.col("year")), None)}))


@query("f10_cross_cutting_concepts", f"WITH {V.ART}, {V.WORK}, {_TOPICS}, c AS (SELECT concept, cluster, sum(score) AS s FROM tp GROUP BY 1, 2 HAVING sum(score) >= 1) SELECT concept, count(*) AS clusters, round(sum(s), 3) AS total FROM c GROUP BY 1 HAVING count(*) >= 3 AND sum(s) >= 5")
def f10(s: SparkSession, d: str) -> DataFrame:
    return A.cross_cutting(_topics(s, d), "concept", "cluster", "score").withColumn("total", F.round("total", 3))


def _tokens(s: SparkSession, d: str) -> DataFrame:
    """(id, journal, token): different words of documents; texts are cut once, into a table that all steps read."""
    docs, folder = T(s, d, "documents"), scratch(s, "tokens")
    found = F.array_distinct(F.filter(F.split(F.lower("text"), "[^a-z]+"), lambda w: F.length(w) >= 5))
    docs.select(F.col("doc_id").alias("id"), F.col("source").alias("journal"), found.alias("tokens")).write.parquet(folder)
    return s.read.schema("id long, journal string, tokens array<string>").parquet(folder).select("id", "journal", F.explode("tokens").alias("token"))


_TOK = "tk AS (SELECT DISTINCT doc_id AS id, source AS journal, unnest(list_filter(regexp_split_to_array(lower(text), '[^a-z]+'), lambda w: length(w) >= 5)) AS token FROM documents)"
_MOTIF = "n AS (SELECT count(DISTINCT id) FILTER (id % 4 = 0) AS nc, count(DISTINCT id) FILTER (id % 4 > 0) AS nb FROM tk), g AS (SELECT token, count(*) FILTER (id % 4 = 0) AS a, count(*) FILTER (id % 4 > 0) AS b, count(DISTINCT journal) FILTER (id % 4 = 0) AS j FROM tk GROUP BY 1), m AS (SELECT token, a AS articles, (a::DOUBLE / nc) / ((b + 1)::DOUBLE / (nb + 1)) AS lift FROM g, n WHERE a >= 3 AND j >= 2 AND (a::DOUBLE / nc) / ((b + 1)::DOUBLE / (nb + 1)) >= 2)"


@query("f11_emergent_motifs", f"""WITH {_TOK}, {_MOTIF}, p AS (SELECT x.token, y.token AS mate, m.articles, count(*) AS t FROM tk x JOIN m ON m.token = x.token JOIN (SELECT tk.* FROM tk JOIN g USING (token), n WHERE (a::DOUBLE / nc) / ((b + 1)::DOUBLE / (nb + 1)) >= 1.8) y ON x.id = y.id AND x.token <> y.token GROUP BY ALL HAVING count(*) >= 0.4 * m.articles),
b AS (SELECT token, max_by(mate, (t, mate)) AS mate, max(t) AS together FROM p GROUP BY 1) SELECT m.token, articles, round(lift, 5) AS lift, b.mate, b.together FROM m LEFT JOIN b USING (token)""")
def f11(s: SparkSession, d: str) -> DataFrame:
    tk = _tokens(s, d)
    m, mates = A.motifs(tk, F.col("id") % 4 == 0), A.motifs(tk, F.col("id") % 4 == 0, 1, 0, 1.8)
    return m.join(A.companions(tk, m, mates), "token", "left").select("token", "articles", F.round("lift", 5).alias("lift"), "mate", "together")


@query("f11_motif_choice", f"""WITH RECURSIVE {_TOK}, {_MOTIF}, y AS (SELECT tk.* FROM tk JOIN g USING (token), n WHERE (a::DOUBLE / nc) / ((b + 1)::DOUBLE / (nb + 1)) >= 1.8),
p AS (SELECT x.token, y.token AS mate, m.articles, count(*) AS t FROM tk x JOIN m ON m.token = x.token JOIN y ON x.id = y.id AND x.token <> y.token GROUP BY ALL HAVING count(*) >= 0.4 * m.articles),
b AS (SELECT token, max_by(mate, (t, mate)) AS mate FROM p GROUP BY 1), k AS (SELECT list_filter([token, mate], lambda w: w IS NOT NULL) AS ws, row_number() OVER (ORDER BY articles * lift DESC, token) AS i FROM m LEFT JOIN b USING (token)),
r(rank, i, taken) AS (SELECT 0, CAST(0 AS BIGINT), CAST([] AS VARCHAR[][]) UNION ALL
  SELECT rank + 1, k.i, list_append(taken, ws) FROM r, k WHERE rank < 4 AND k.i = (SELECT min(z.i) FROM k z WHERE len(list_filter(r.taken, lambda c: list_has_all(c, z.ws) OR list_has_all(z.ws, c))) = 0))
SELECT rank, array_to_string(list_sort(taken[-1]), ' ') AS motif FROM r WHERE rank > 0""")
def f11g(s: SparkSession, d: str) -> DataFrame:
    tk = _tokens(s, d)
    m, mates = A.motifs(tk, F.col("id") % 4 == 0), A.motifs(tk, F.col("id") % 4 == 0, 1, 0, 1.8)
    best = A.greedy_motifs(m.join(A.companions(tk, m, mates), "token", "left").withColumn("score", F.col("articles") * F.col("lift")))
    return s.createDataFrame([(i + 1, x) for i, x in enumerate(best)], "rank int, motif string")


@query("f12_store_statistics", f"WITH {V.ART} SELECT journal, coalesce(nullif(\"user\", ''), agent) AS verdict, count(*) AS n, round(sum(cost), 2) AS cost FROM art GROUP BY 1, 2")
def f12(s: SparkSession, d: str) -> DataFrame:
    return V.articles(s, d).groupBy("journal", F.coalesce(F.nullif("user", F.lit("")), "agent").alias("verdict")).agg(count(), F.round(F.sum("cost"), 2).alias("cost"))


@query("f13_scan_scope", f"WITH {V.ART} SELECT journal, count(*) FILTER (agent <> 'lesenswert') AS processed, count(*) FILTER (agent = 'lesenswert') AS pending, round(count(*) FILTER (agent = 'lesenswert') * 0.05::DOUBLE, 4) AS estimate FROM art WHERE year BETWEEN 1996 AND 2000 GROUP BY 1")
def f13(s: SparkSession, d: str) -> DataFrame:
    pending = F.count_if(F.col("agent") == "lesenswert")
    return V.articles(s, d).where(F.col("year").between(1996, 2000)).groupBy("journal").agg(F.count_if(F.col("agent") != "lesenswert").alias("processed"), pending.alias("pending"), F.round(pending * 0.05, 4).alias("estimate"))


@query("f14_recent_average", f"""WITH {V.CALL}, a AS (SELECT avg(cost) AS a, count(*) AS n FROM (SELECT cost FROM call WHERE cost > 0 AND endpoint = 'error' ORDER BY ts DESC, id LIMIT 200)), b AS (SELECT avg(cost) AS b, count(*) AS m FROM (SELECT cost FROM call WHERE cost > 0 ORDER BY ts DESC, id LIMIT 200))
SELECT round(CASE WHEN n >= 5 THEN a WHEN m >= 5 THEN b ELSE 0.05 END, 6) AS estimate FROM a, b""")
def f14(s: SparkSession, d: str) -> DataFrame:
    out = A.mean_or_fallback(V.calls(s, d), "cost", F.col("endpoint") == "error", [F.desc("ts"), F.col("id")], 200, 5, 0.05)
    return out.select(F.round("estimate", 6).alias("estimate"))


@query("f15_distinct_years", f"WITH {V.ART} SELECT DISTINCT year FROM art UNION SELECT DISTINCT CAST(year(l_shipdate) AS INT) FROM lineitem")
def f15(s: SparkSession, d: str) -> DataFrame:
    return V.articles(s, d).select("year").union(T(s, d, "lineitem").select(F.year("l_shipdate"))).distinct().orderBy(F.desc("year"))


@query("f16_ledger_rollup", f"WITH {V.CALL} SELECT strftime(ts, '%Y-%m-%d') AS key, count(*) AS calls, round(sum(cost), 4) AS cost, CAST(sum(tokens_in) AS BIGINT) AS tokens FROM call WHERE strftime(ts, '%Y-%m-%d') BETWEEN '2024-01-02' AND '2024-01-20' GROUP BY 1")
def f16(s: SparkSession, d: str) -> DataFrame:
    return A.rollup_calls(V.calls(s, d), "day", "2024-01-02", "2024-01-20")


@query("f17_cost_since", f"WITH {V.CALL} SELECT round(coalesce(sum(cost), 0), 4) AS cost FROM call WHERE strftime(ts, '%Y-%m-%d') >= '2024-01-15'")
def f17(s: SparkSession, d: str) -> DataFrame:
    return V.calls(s, d).where(F.date_format("ts", "yyyy-MM-dd") >= "2024-01-15").agg(F.round(F.coalesce(F.sum("cost"), F.lit(0.0)), 4).alias("cost"))


@query("f18_cache_effectiveness", f"""WITH {V.CALL}, g AS (SELECT endpoint, model, count(*) AS calls, sum(tokens_cached) AS h, sum(tokens_in) AS m, avg(cost) AS c FROM call WHERE status IS NULL OR status = 'ok' GROUP BY 1, 2)
SELECT endpoint, model, calls, round(CASE WHEN h + m > 0 THEN h::DOUBLE / (h + m) ELSE 0 END, 6) AS hit_rate, round(c, 6) AS mean_cost, h::DOUBLE / (h + m) < 0.8 AND calls >= 20 AND endpoint IN ('view', 'click') AS warning FROM g""")
def f18(s: SparkSession, d: str) -> DataFrame:
    return A.cache_hits(V.calls(s, d), ["view", "click"])


@query("f19_coverage_by_bucket", f"WITH {V.ART} SELECT segment, CASE WHEN year < 1997 THEN 'old' WHEN year < 2000 THEN 'mid' ELSE 'new' END AS bucket, count(DISTINCT author) AS authors, count(*) FILTER (agent = 'lesenswert') AS kept FROM art GROUP BY 1, 2")
def f19(s: SparkSession, d: str) -> DataFrame:
    y = F.col("year")
    return V.articles(s, d).groupBy("segment", F.when(y < 1997, "old").when(y < 2000, "mid").otherwise("new").alias("bucket")).agg(F.countDistinct("author").alias("authors"), F.count_if(F.col("agent") == "lesenswert").alias("kept"))


@query("f20_source_status", "SELECT l_suppkey, count(*) AS n, count(DISTINCT l_partkey) AS works, max(l_shipdate) AS last_seen FROM lineitem GROUP BY 1")
def f20(s: SparkSession, d: str) -> DataFrame:
    return T(s, d, "lineitem").groupBy("l_suppkey").agg(count(), F.countDistinct("l_partkey").alias("works"), F.max("l_shipdate").alias("last_seen"))


@query("f21_verdict_bars", f"WITH {V.ART} SELECT cluster, count(*) AS total, count(*) FILTER (agent = 'lesenswert') AS lesenswert, count(*) FILTER (agent = 'scannen') AS scannen, count(*) FILTER (agent = 'ignorieren') AS ignorieren FROM art GROUP BY 1")
def f21(s: SparkSession, d: str) -> DataFrame:
    kinds = ["lesenswert", "scannen", "ignorieren"]
    p = V.articles(s, d).groupBy("cluster").pivot("agent", kinds).agg(F.count("id")).na.fill(0, kinds)
    return p.select("cluster", (F.col("lesenswert") + F.col("scannen") + F.col("ignorieren")).alias("total"), *kinds)


@query("f22_pool_summary", f"WITH {V.ART}, g AS (SELECT segment, list_sort(list(cost)) AS c, count(*) AS n, max(cost) AS m FROM art GROUP BY 1) SELECT segment, n, c[CAST(n // 2 AS INT) + 1] AS upper_median, m AS top FROM g")
def f22(s: SparkSession, d: str) -> DataFrame:
    # the upper median is the first value that more than half of the rows lie up to, so no group is gathered or ranked in one task
    per = V.articles(s, d).groupBy("segment", "cost").agg(count("k"))
    size = per.groupBy("segment").agg(F.sum("k").alias("n"), F.max("cost").alias("top"))
    run = running(per, F.col("cost"), {"below": "k"}, ["segment"]).join(size, "segment")
    return run.where(F.col("below") + F.col("k") > F.floor(F.col("n") / 2)).groupBy("segment", "n", "top").agg(F.min("cost").alias("upper_median"))


_POOL = _ranked_sql("segment", {"mode": ("SELECT segment, cluster AS value, 1.0::DOUBLE AS weight FROM art", None), "verdict": ("SELECT segment, agent AS value, 1.0::DOUBLE AS weight FROM art", None), "indicator": ("SELECT segment, coalesce(nullif(\"user\", ''), '(none)') AS value, 1.0::DOUBLE AS weight FROM art", None), "journal": ("SELECT segment, journal AS value, 1.0::DOUBLE AS weight FROM art", 10)})


@query("f22_pool_facets", f"WITH {V.ART}, {_POOL} SELECT * FROM facets")
def f22_facets(s: SparkSession, d: str) -> DataFrame:
    """Counts of a pool by mode, verdict and indicator, and its ten most frequent journals."""
    none = F.coalesce(F.nullif("user", F.lit("")), F.lit("(none)"))
    return A.facets(V.articles(s, d), "segment", {"mode": (A.single(F.col("cluster")), None), "verdict": (A.single(F.col("agent")), None), "indicator": (A.single(none), None), "journal": (A.single(F.col("journal")), 10)})


_RANK = "CASE {c} WHEN 'pflichtlektuere' THEN 0 WHEN 'lesenswert' THEN 1 WHEN 'scannen' THEN 2 ELSE 3 END"


def rank(c: str):
    col = F.col(c)
    return F.when(col == "pflichtlektuere", 0).when(col == "lesenswert", 1).when(col == "scannen", 2).otherwise(3)


@query("f23_override_analysis", f"""WITH {V.ART} SELECT agent AS src, "user" AS dst, CASE WHEN {_RANK.format(c='"user"')} < {_RANK.format(c='agent')} THEN 'upgrade' WHEN {_RANK.format(c='"user"')} > {_RANK.format(c='agent')} THEN 'downgrade' ELSE 'confirm' END AS direction, count(*) AS n FROM art WHERE "user" <> '' GROUP BY 1, 2, 3""")
def f23(s: SparkSession, d: str) -> DataFrame:
    a = V.articles(s, d).where("user <> ''")
    direction = F.when(rank("user") < rank("agent"), "upgrade").when(rank("user") > rank("agent"), "downgrade").otherwise("confirm")
    return a.groupBy(F.col("agent").alias("src"), F.col("user").alias("dst"), direction.alias("direction")).agg(count())


@query("f24_rule_candidates", f"""WITH {V.ART}, g AS (SELECT journal, count(*) FILTER ({_RANK.format(c='"user"')} < {_RANK.format(c='agent')}) AS up, count(*) FILTER ({_RANK.format(c='"user"')} > {_RANK.format(c='agent')}) AS down FROM art WHERE "user" <> '' GROUP BY 1)
SELECT journal, up, down, CASE WHEN up >= 5 AND up >= 2 * down THEN 'loosen' WHEN down >= 5 AND down >= 2 * up THEN 'tighten' ELSE 'keep' END AS guidance FROM g""")
def f24(s: SparkSession, d: str) -> DataFrame:
    g = V.articles(s, d).where("user <> ''").groupBy("journal").agg(F.count_if(rank("user") < rank("agent")).alias("up"), F.count_if(rank("user") > rank("agent")).alias("down"))
    up, down = F.col("up"), F.col("down")
    return g.withColumn("guidance", F.when((up >= 5) & (up >= 2 * down), "loosen").when((down >= 5) & (down >= 2 * up), "tighten").otherwise("keep"))


_HIER = "h AS (SELECT p_brand AS domain, p_type AS field, CAST(p_size % 3 AS VARCHAR) AS subfield, p_name || ' ' || p_partkey AS name, p_retailprice / 1000 AS score FROM part)"


@query("f25_topic_hierarchy", f"WITH {_HIER} SELECT domain, field, subfield, round(sum(greatest(score, 1)), 4) AS weight, count(*) AS n, array_to_string(list(name ORDER BY -score, name)[1:8], '; ') AS names FROM h GROUP BY 1, 2, 3")
def f25(s: SparkSession, d: str) -> DataFrame:
    return A.topic_groups(_hier(s, d)).withColumn("weight", F.round("weight", 4))


def _hier(s: SparkSession, d: str) -> DataFrame:
    p = T(s, d, "part")
    return p.select(F.col("p_brand").alias("domain"), F.col("p_type").alias("field"), (F.col("p_size") % 3).cast("string").alias("subfield"), F.concat_ws(" ", "p_name", F.col("p_partkey").cast("string")).alias("name"), (F.col("p_retailprice") / 1000).alias("score"))


@query("f26_inferred_signals", f"WITH {_HIER} SELECT 'tint' AS label, count(DISTINCT name) AS n FROM h WHERE contains(lower(name), 'red') OR contains(lower(name), 'blue') UNION ALL SELECT 'metal', count(DISTINCT name) FROM h WHERE contains(lower(name), 'bolt')")
def f26(s: SparkSession, d: str) -> DataFrame:
    return A.inferred_signals(_hier(s, d), {"tint": ["red", "blue"], "metal": ["bolt"], "none": ["zzz"]})


def _stances(s: SparkSession, d: str) -> DataFrame:
    li = T(s, d, "lineitem")
    stance = F.when(F.col("l_returnflag") == "A", "affirms").when(F.col("l_returnflag") == "R", "contrasts").otherwise("uses")
    return li.join(V.articles(s, d).select("id", "year"), F.col("l_orderkey") == F.col("id")).select(F.col("id").alias("work"), "year", F.col("l_suppkey").alias("key"), F.col("l_linestatus").alias("label"), stance.alias("stance"), F.when(F.col("l_discount") > 0.05, -1).otherwise(1).alias("sign"))


_STANCE = "st AS (SELECT id AS work, year, l_suppkey AS key, l_linestatus AS label, CASE l_returnflag WHEN 'A' THEN 'affirms' WHEN 'R' THEN 'contrasts' ELSE 'uses' END AS stance, CASE WHEN l_discount > 0.05 THEN -1 ELSE 1 END AS sign FROM lineitem JOIN art ON l_orderkey = id)"
_FORM = """p AS (SELECT key, work, year, stance, count(*) AS k FROM st GROUP BY ALL), o AS (SELECT key, work, year, min_by(stance, (-k, stance)) AS dom FROM p GROUP BY 1, 2, 3), e AS (SELECT key, min_by(dom, (year, work)) AS first, max_by(dom, (year, work)) AS last FROM o GROUP BY 1),
lb AS (SELECT key, min_by(label, (-k, label)) AS label FROM (SELECT key, label, count(*) AS k FROM st GROUP BY 1, 2) GROUP BY 1), t AS (SELECT key, count(DISTINCT work) AS works, count(*) FILTER (sign > 0) AS plus, count(*) FILTER (sign < 0) AS minus FROM st GROUP BY 1),
form AS (SELECT t.key, works, plus, minus, first, last, label, first <> last AS shifted FROM t JOIN e USING (key) JOIN lb USING (key))"""


@query("f29_profile_form", f"WITH {V.ART}, {_STANCE}, {_FORM} SELECT * FROM form")
def f29(s: SparkSession, d: str) -> DataFrame:
    return A.profile_form(_stances(s, d))


@query("f30_source_cooccurrence", f"WITH {V.ART}, {_STANCE}, r AS (SELECT DISTINCT work, key FROM st) SELECT a.key AS a, b.key AS b, count(*) AS n FROM r a JOIN r b ON a.work = b.work AND a.key < b.key GROUP BY 1, 2")
def f30(s: SparkSession, d: str) -> DataFrame:
    return A.cooccurrence(_stances(s, d), "work", "key")


@query("f31_period_blocks", f"""WITH {V.ART}, {V.REF}, r AS (SELECT DISTINCT CAST(floor((year - (SELECT min(year) FROM art)) / 2) AS BIGINT) AS period, ref FROM art JOIN ref USING (id) WHERE year NOT IN (1999, 2000)), i AS (SELECT period, dense_rank() OVER (ORDER BY period) AS i FROM (SELECT DISTINCT period FROM r)), b AS (SELECT i, period, ref FROM r JOIN i USING (period))
SELECT period, (SELECT count(*) FROM b x WHERE x.i = i.i) AS n, CASE WHEN i > 1 THEN (SELECT count(*) FROM b x WHERE x.i = i.i AND ref NOT IN (SELECT ref FROM b y WHERE y.i = i.i - 1)) END AS new, CASE WHEN i > 1 THEN (SELECT count(*) FROM b y WHERE y.i = i.i - 1 AND ref NOT IN (SELECT ref FROM b x WHERE x.i = i.i)) END AS dropped FROM i""")
def f31(s: SparkSession, d: str) -> DataFrame:
    return A.periods(art_refs(s, d).where("year NOT IN (1999, 2000)"), "year", "ref", 2)


@query("f32_citation_density", f"WITH {V.WORK}, {V.CITE}, h AS (SELECT unnest(regexp_extract_all(raw, '(Maker[0-9]+)[^(]*\\(\\d{{4}}', 1)) AS name FROM cite) SELECT name, count(*) AS n, count(*) >= 3 AS operative FROM h GROUP BY 1")
def f32(s: SparkSession, d: str) -> DataFrame:
    h = V.citations(s, d).select(F.explode(F.regexp_extract_all("raw", F.lit(r"(Maker[0-9]+)[^(]*\(\d{4}"), F.lit(1))).alias("name"))
    return h.groupBy("name").agg(count(), (F.count("*") >= 3).alias("operative"))


@query("f33_trigger_neighbourhood", f"WITH {V.ART}, {V.REF}, {_OWN}, t AS (SELECT ref, count(*) AS n FROM ref JOIN art USING (id) WHERE regexp_matches(author_name, '7$') GROUP BY 1), o AS (SELECT DISTINCT ref FROM own) SELECT coalesce(t.ref, o.ref) AS ref, greatest(coalesce(n, 0), CASE WHEN o.ref IS NULL THEN 0 ELSE 1 END) AS n FROM t FULL JOIN o ON t.ref = o.ref")
def f33(s: SparkSession, d: str) -> DataFrame:
    t = V.references(s, d).join(V.articles(s, d).where(F.col("author_name").rlike("7$")).select("id"), "id").groupBy("ref").agg(count())
    o = own(s, d).select("ref").distinct().withColumn("o", F.lit(1))
    return t.join(o, "ref", "full_outer").select("ref", F.greatest(F.coalesce("n", F.lit(0)), F.coalesce("o", F.lit(0))).alias("n"))


@query("f34_concept_profile", f"WITH {V.ART}, {V.WORK}, {_TOPICS} SELECT concept, round(avg(score) * count(DISTINCT id) / (SELECT count(*) FROM art), 8) AS weight FROM tp GROUP BY 1")
def f34(s: SparkSession, d: str) -> DataFrame:
    n = V.articles(s, d).agg(F.count("*").alias("total"))
    g = _topics(s, d).groupBy("concept").agg(F.avg("score").alias("m"), F.countDistinct("id").alias("k"))
    return g.crossJoin(F.broadcast(n)).select("concept", F.round(F.col("m") * F.col("k") / F.col("total"), 8).alias("weight"))


@query("f35_bucket_crosstab", f"WITH {V.SCORED} SELECT CASE WHEN s < 0.25 THEN 'low' WHEN s < 0.75 THEN 'mid' ELSE 'high' END AS bucket, count(*) FILTER (y = 1) AS pos, count(*) FILTER (y = 0) AS neg, round(avg(y), 6) AS share FROM scored GROUP BY 1")
def f35(s: SparkSession, d: str) -> DataFrame:
    x = F.col("s")
    return V.scored(s, d).groupBy(F.when(x < 0.25, "low").when(x < 0.75, "mid").otherwise("high").alias("bucket")).agg(F.count_if(F.col("y") == 1).alias("pos"), F.count_if(F.col("y") == 0).alias("neg"), F.round(F.avg("y"), 6).alias("share"))


@query("f36_author_count_network", f"""WITH {V.ART}, {V.REF}, {AR}, g AS (SELECT cluster, ref, count(DISTINCT author) AS authors, count(*) AS freq FROM ar GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY authors DESC, freq DESC, ref) AS r FROM g) SELECT cluster, ref, authors, freq FROM r WHERE r <= 50""")
def f36(s: SparkSession, d: str) -> DataFrame:
    g = art_refs(s, d).groupBy("cluster", "ref").agg(F.countDistinct("author").alias("authors"), F.count("*").alias("freq"))
    return g.withColumn("r", F.row_number().over(Window.partitionBy("cluster").orderBy(F.desc("authors"), F.desc("freq"), "ref"))).where("r <= 50").drop("r")


@query("f36_network_counts", f"WITH {V.ART}, {V.REF}, {AR}, g AS (SELECT cluster, ref, count(DISTINCT author) AS authors FROM ar GROUP BY 1, 2) SELECT cluster, count(*) AS refs, count(*) FILTER (authors >= 2) AS by_two, count(*) FILTER (authors >= 3) AS by_three, max(authors) AS most FROM g GROUP BY 1")
def f36_counts(s: SparkSession, d: str) -> DataFrame:
    g = art_refs(s, d).groupBy("cluster", "ref").agg(F.countDistinct("author").alias("authors"))
    return g.groupBy("cluster").agg(count("refs"), F.count_if(F.col("authors") >= 2).alias("by_two"), F.count_if(F.col("authors") >= 3).alias("by_three"), F.max("authors").alias("most"))


@query("f37_keyword_classes", f"WITH {V.WORK} SELECT ref, concat_ws(',', CASE WHEN contains(lower(topic), 'econ') OR contains(title, 'gear') THEN 'a' END, CASE WHEN contains(title, 'red') THEN 'b' END) AS classes FROM work")
def f37(s: SparkSession, d: str) -> DataFrame:
    rules = {"a": ["econ", "gear"], "b": ["red"]}
    return V.works(s, d).select("ref", F.array_join(S.labels(F.concat_ws(" ", F.lower("topic"), "title"), rules), ",").alias("classes"))


@query("f38_saturation", f"""WITH {V.ART}, w AS (SELECT author, id, cluster AS grp, row_number() OVER (PARTITION BY author ORDER BY fetched DESC, id) AS r, row_number() OVER (PARTITION BY author ORDER BY cost DESC, id) AS c FROM art), b AS (SELECT author, grp, min(CASE WHEN id % 7 = 0 THEN least(r, c) END) AS need FROM w GROUP BY 1, 2)
SELECT CAST(l AS INT) AS level, grp, round(avg(CASE WHEN need <= l THEN 1.0 ELSE 0.0 END), 6) AS rate FROM b, (SELECT unnest([1, 2, 4, 8]) AS l) GROUP BY 1, 2""")
def f38(s: SparkSession, d: str) -> DataFrame:
    a = V.articles(s, d)
    works = a.select("author", F.col("id").alias("work"), F.col("cluster").alias("grp"), F.col("fetched").alias("date"), F.col("cost").alias("cited"))
    return A.saturation(works, works.where("work % 7 = 0"), [1, 2, 4, 8]).withColumn("rate", F.round("rate", 6))


@query("f39_systematic_sample", f"WITH {V.ART}, r AS (SELECT cluster, id, row_number() OVER (PARTITION BY cluster ORDER BY id) - 1 AS i, count(*) OVER (PARTITION BY cluster) AS n FROM art) SELECT cluster, id FROM r WHERE i % greatest(1, n // 40) = 0 AND i // greatest(1, n // 40) < 40")
def f39(s: SparkSession, d: str) -> DataFrame:
    a = V.articles(s, d).select("cluster", "id").withColumn("one", F.lit(1))
    r = running(a, F.col("id"), {"i": "one"}, ["cluster"]).join(a.groupBy("cluster").agg(F.count("*").alias("n")), "cluster")
    step = F.greatest(F.lit(1), F.floor(F.col("n") / 40))
    return r.where((F.col("i") % step == 0) & (F.floor(F.col("i") / step) < 40)).select("cluster", "id")


@query("f40_candidate_rollup", """SELECT l_suppkey AS source, count(*) AS matches, round(sum(1 + l_discount), 4) AS support, max_by(l_partkey, (l_discount, l_partkey)) AS best, max(l_discount) AS fit FROM lineitem GROUP BY 1""")
def f40(s: SparkSession, d: str) -> DataFrame:
    g = T(s, d, "lineitem").groupBy(F.col("l_suppkey").alias("source")).agg(F.count("*").alias("matches"), F.round(F.sum(1 + F.col("l_discount")), 4).alias("support"), F.max_by("l_partkey", F.struct("l_discount", "l_partkey")).alias("best"), F.max("l_discount").alias("fit"))
    return g.orderBy(F.col("source") % 4 != 0, F.desc("fit"), F.desc("matches"), F.desc("support"), "source")


@query("f41_group_board", f"""WITH {V.ART}, x AS (SELECT cluster AS grp, segment, id, year, agent, {_RANK.format(c='agent')} AS rk FROM art WHERE segment <> 'MACHINERY' OR year >= (SELECT max(year) FROM art) - 2), r AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY rk, id % 2, -year, id) AS r FROM x)
SELECT grp, count(*) AS n, count(*) FILTER (id % 2 = 0) AS strong, string_agg(CAST(id AS VARCHAR), ',' ORDER BY r) FILTER (r <= 3) AS top FROM r GROUP BY 1""")
def f41(s: SparkSession, d: str) -> DataFrame:
    a = V.articles(s, d)
    cut = a.agg(F.max("year").alias("top_year"))  # one row
    x = a.crossJoin(F.broadcast(cut)).where((F.col("segment") != "MACHINERY") | (F.col("year") >= F.col("top_year") - 2)).withColumn("rk", rank("agent"))
    r = x.withColumn("r", F.row_number().over(Window.partitionBy("cluster").orderBy("rk", F.col("id") % 2, -F.col("year"), "id")))
    first = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("r") <= 3, F.struct("r", F.col("id").cast("string").alias("i"))))), lambda z: z["i"]), ",")
    return r.groupBy(F.col("cluster").alias("grp")).agg(F.count("*").alias("n"), F.count_if(F.col("id") % 2 == 0).alias("strong"), first.alias("top"))


@query("f42_profile_digest", f"WITH {V.ART}, {_STANCE}, {_FORM}, r AS (SELECT *, row_number() OVER (ORDER BY works DESC, key) AS r FROM form WHERE works >= 500 AND key % 7 <> 0) SELECT key, works, last AS dominant, shifted FROM r WHERE r <= 12")
def f42(s: SparkSession, d: str) -> DataFrame:
    f = A.profile_form(_stances(s, d)).where("works >= 500 AND key % 7 <> 0")
    return f.orderBy(F.desc("works"), "key").limit(12).select("key", "works", F.col("last").alias("dominant"), "shifted")
