"""Queries of section B: upserts, deduplication and identity."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citemill import views as V
from citemill.operators import merging as M
from citemill.plans.registry import query


@query("b01_content_id", f"""WITH {V.WORK}, x AS (SELECT ref, CASE WHEN ref % 3 = 0 THEN doi WHEN ref % 3 = 1 THEN ' ' END AS doi, CASE WHEN ref % 2 = 0 THEN 'http://x/' || ref END AS url, brand, title FROM work)
SELECT ref, substr(sha256(coalesce(lower(nullif(trim(doi), '')), nullif(trim(url), ''), brand || '::' || title)), 1, 32) AS content_id FROM x""")
def b01(s: SparkSession, d: str) -> DataFrame:
    r = F.col("ref")
    w = V.works(s, d).withColumns({"doi": F.when(r % 3 == 0, F.col("doi")).when(r % 3 == 1, " "), "url": F.when(r % 2 == 0, F.concat(F.lit("http://x/"), r.cast("string")))})
    return w.select("ref", M.content_id(F.col("doi"), F.col("url"), F.col("brand"), F.col("title")).alias("content_id"))


def _old_new(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    p = V.works(s, d)
    old = p.where("ref % 3 <> 0").select("ref", "title", F.col("year").cast("long").alias("year"), F.col("brand").alias("venue"), F.lit("kept").alias("verdict"), F.col("size").cast("long").alias("chars"))
    new = p.where("ref % 2 = 0").select("ref", F.when(F.col("ref") % 4 == 0, " ").otherwise(F.upper("title")).alias("title"), F.when(F.col("ref") % 10 == 0, F.lit(None)).otherwise(F.col("year") + 1).cast("long").alias("year"), F.lower("brand").alias("venue"), (F.col("size") * 2 % 37).cast("long").alias("chars"))
    return old, new


_ON = f"""WITH {V.WORK}, o AS (SELECT ref, title, CAST(year AS BIGINT) AS year, brand AS venue, 'kept' AS verdict, CAST(size AS BIGINT) AS chars FROM work WHERE ref % 3 <> 0),
n AS (SELECT ref, CASE WHEN ref % 4 = 0 THEN ' ' ELSE upper(title) END AS title, CASE WHEN ref % 10 = 0 THEN NULL ELSE CAST(year + 1 AS BIGINT) END AS year, lower(brand) AS venue, CAST(size * 2 % 37 AS BIGINT) AS chars FROM work WHERE ref % 2 = 0)"""


@query("b02_metadata_upsert", _ON + """ SELECT coalesce(n.ref, o.ref) AS ref, CASE WHEN n.ref IS NOT NULL THEN n.title ELSE o.title END AS title, CASE WHEN n.ref IS NOT NULL THEN n.year ELSE o.year END AS year, o.verdict FROM o FULL JOIN n ON o.ref = n.ref""")
def b02(s: SparkSession, d: str) -> DataFrame:
    old, new = _old_new(s, d)
    return M.upsert(old, new, "ref", {"title": "incoming", "year": "incoming", "verdict": "keep"})


@query("b03_prefer_non_empty", _ON + """ SELECT coalesce(n.ref, o.ref) AS ref, CASE WHEN length(trim(n.title)) > 0 THEN n.title ELSE o.title END AS title, coalesce(n.year, o.year) AS year, CASE WHEN length(trim(n.venue)) > 0 THEN n.venue ELSE o.venue END AS venue FROM o FULL JOIN n ON o.ref = n.ref""")
def b03(s: SparkSession, d: str) -> DataFrame:
    old, new = _old_new(s, d)
    return M.upsert(old, new, "ref", {"title": "prefer_text", "year": "coalesce", "venue": "prefer_text"})


@query("b04_coalescing_upsert", _ON + """ SELECT coalesce(n.ref, o.ref) AS ref, CASE WHEN n.ref IS NOT NULL THEN n.title ELSE o.title END AS title, coalesce(n.year, o.year) AS year, coalesce(n.venue, o.venue) AS venue, greatest(o.chars, n.chars) AS chars FROM o FULL JOIN n ON o.ref = n.ref""")
def b04(s: SparkSession, d: str) -> DataFrame:
    old, new = _old_new(s, d)
    return M.upsert(old, new, "ref", {"title": "incoming", "year": "coalesce", "venue": "coalesce", "chars": "greatest"})


@query("b05_provenance_upsert", "SELECT l_partkey, l_suppkey, l_returnflag, l_linestatus, min(l_shipdate) AS first_seen, max(l_shipdate) AS last_seen FROM lineitem GROUP BY ALL")
def b05(s: SparkSession, d: str) -> DataFrame:
    return M.first_seen(V.table(s, d, "lineitem"), ["l_partkey", "l_suppkey", "l_returnflag", "l_linestatus"], "l_shipdate")


@query("b06_replace_children", f"WITH {V.REF} SELECT id, ref FROM ref WHERE id NOT IN (SELECT id FROM ref WHERE ref % 50 = 0) UNION ALL SELECT DISTINCT id, ref + 1000000 FROM ref WHERE ref % 50 = 0")
def b06(s: SparkSession, d: str) -> DataFrame:
    old = V.references(s, d)
    return M.replace_children(old, old.where("ref % 50 = 0").select("id", (F.col("ref") + 1000000).alias("ref")), "id")


@query("b07_canonical_id", rf"""WITH {V.WORK}, x AS (SELECT ref, CASE WHEN ref % 2 = 0 THEN regexp_replace(regexp_replace(lower(doi), '[.,;:)\]]+$', ''), '^(https?://(dx\.)?doi\.org/|doi:)', '') ELSE '' END AS nd, title, year, brand FROM work)
SELECT ref, CASE WHEN nd <> '' THEN 'doi:' || nd ELSE 'hash:' || substr(sha1(title || '|' || year || '|' || trim(regexp_replace(lower(brand), '[^a-z0-9]+', ' ', 'g'))), 1, 16) END AS canonical_id FROM x""")
def b07(s: SparkSession, d: str) -> DataFrame:
    return V.works(s, d).select("ref", M.canonical_id(F.when(F.col("ref") % 2 == 0, F.col("doi")), F.col("title"), F.col("year"), F.concat("brand", F.lit(", X."))).alias("canonical_id"))


_PUBS = "p AS (SELECT ref, ref % 5 = 0 AS has_doi, title || ' ' || brand AS t, CASE WHEN ref % 4 = 0 THEN NULL ELSE year END AS y, CASE WHEN ref % 3 = 0 THEN '' ELSE topic END AS a FROM work)"


_MERGED = "m AS (SELECT x.ref, min(q.ref) AS target FROM p x JOIN p q ON x.t = q.t AND (x.y IS NULL OR q.y IS NULL OR x.y = q.y) AND (x.a = '' OR q.a = '' OR x.a = q.a) WHERE NOT x.has_doi AND q.has_doi GROUP BY x.ref)"


def _merge(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    r = F.col("ref")
    pubs = V.works(s, d).select("ref", (r % 5 == 0).alias("has_doi"), F.concat_ws(" ", "title", "brand").alias("t"), F.when(r % 4 != 0, F.col("year")).alias("y"), F.when(r % 3 == 0, "").otherwise(F.col("topic")).alias("a"))
    return pubs, M.merge_hashed(pubs, "ref", "has_doi", "t", "y", "a")


@query("b08_duplicate_merge", f"""WITH {V.WORK}, {_PUBS}, {_MERGED} SELECT p.ref, coalesce(m.target, p.ref) AS target FROM p LEFT JOIN m USING (ref)""")
def b08(s: SparkSession, d: str) -> DataFrame:
    return _merge(s, d)[1]


@query("b08_merge_effects", f"""WITH {V.WORK}, {V.REF}, {_PUBS}, {_MERGED}, c AS (SELECT DISTINCT l_partkey AS ref, l_suppkey AS child FROM lineitem)
SELECT 'publication' AS kind, ref, NULL::BIGINT AS other FROM p WHERE ref NOT IN (SELECT ref FROM m) UNION ALL SELECT DISTINCT 'provenance', coalesce(m.target, ref.ref), ref.id FROM ref LEFT JOIN m ON m.ref = ref.ref UNION ALL SELECT 'reference', ref, child FROM c WHERE ref NOT IN (SELECT ref FROM m)""")
def b08_effects(s: SparkSession, d: str) -> DataFrame:
    """Articles that hold a publication are where it came from; suppliers stand for its own references."""
    pubs, mapping = _merge(s, d)
    children = V.table(s, d, "lineitem").select(F.col("l_partkey").alias("ref"), F.col("l_suppkey").alias("other")).distinct()
    parts = M.merge_effects(mapping, pubs, V.references(s, d).select("ref", F.col("id").alias("other")), children, "ref")
    tagged = [p.select(F.lit(k).alias("kind"), "ref", F.col("other") if "other" in p.columns else F.lit(None).cast("long").alias("other")) for k, p in zip(("publication", "provenance", "reference"), parts, strict=True)]
    return tagged[0].unionByName(tagged[1]).unionByName(tagged[2])


@query("b09_seen_set", "SELECT DISTINCT e.user_id, e.event_type FROM events e WHERE event_id >= 500 AND NOT EXISTS (SELECT 1 FROM events o WHERE o.event_id < 500 AND o.user_id = e.user_id AND o.event_type = e.event_type)")
def b09(s: SparkSession, d: str) -> DataFrame:
    e = V.table(s, d, "events").select("event_id", "user_id", "event_type")
    return e.where("event_id >= 500").dropDuplicates(["user_id", "event_type"]).join(e.where("event_id < 500"), ["user_id", "event_type"], "left_anti").select("user_id", "event_type")


@query("b10_recent_and_cited", f"""WITH {V.ART}, r AS (SELECT author, id, row_number() OVER (PARTITION BY author ORDER BY fetched DESC, id) AS r, row_number() OVER (PARTITION BY author ORDER BY cost DESC, id) AS c FROM art)
SELECT author, id, CASE WHEN r <= 3 AND c <= 3 THEN 'both' WHEN r <= 3 THEN 'recent' ELSE 'cited' END AS selection FROM r WHERE r <= 3 OR c <= 3""")
def b10(s: SparkSession, d: str) -> DataFrame:
    return M.recent_and_cited(V.articles(s, d), "author", "fetched", "cost", "id", 3).select("author", "id", "selection")


@query("b11_skip_complete", "SELECT o_orderkey AS id FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R' AND l_quantity > 10)")
def b11(s: SparkSession, d: str) -> DataFrame:
    done = V.table(s, d, "lineitem").where("l_returnflag = 'R' AND l_quantity > 10").select(F.col("l_orderkey").alias("id"))
    return V.table(s, d, "orders").select(F.col("o_orderkey").alias("id")).join(done, "id", "left_anti")


@query("b12_only_if_empty", f"WITH {V.ART} SELECT id, coalesce(nullif(\"user\", ''), agent || '*') AS verdict FROM art")
def b12(s: SparkSession, d: str) -> DataFrame:
    return V.articles(s, d).select("id", F.coalesce(F.nullif("user", F.lit("")), F.concat("agent", F.lit("*"))).alias("verdict"))


@query("b13_changed_files", """WITH f AS (SELECT p_partkey AS k, p_retailprice AS m FROM part), o AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE p_retailprice + p_partkey % 3 - 1 END AS m FROM part WHERE p_partkey % 5 <> 0)
SELECT f.k AS file FROM f LEFT JOIN o ON f.k = o.k WHERE o.m IS NULL OR f.m > o.m""")
def b13(s: SparkSession, d: str) -> DataFrame:
    p = V.table(s, d, "part").select(F.col("p_partkey").alias("file"), F.col("p_retailprice").alias("m"))
    seen = p.where("file % 5 <> 0").withColumn("m", F.when(F.col("file") % 7 != 0, F.col("m") + F.col("file") % 3 - 1))
    return M.changed(p, seen, "file", "m").select("file")
