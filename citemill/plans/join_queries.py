"""Queries of section E: joins and matching."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citemill import views as V
from citemill.operators import coupling as C
from citemill.operators import matching as M
from citemill.plans.registry import query

OWN, TRIGGER = "Brand#3", ("Brand#3", "Brand#5", "Brand#7")


def own(s: SparkSession, d: str) -> DataFrame:
    """References of the own works: those of articles by authors whose number divides by 50."""
    a = V.articles(s, d).where("author % 50 = 0").select("id")
    return V.references(s, d).join(a, "id").select(F.col("id").alias("work"), "ref")


_OWN = "own AS (SELECT ref.id AS work, ref.ref FROM ref JOIN art USING (id) WHERE author % 50 = 0)"
_DF = "df AS (SELECT ref, count(DISTINCT id) AS df FROM ref GROUP BY ref)"


FIRST, LAST = "Karl", "Maker13"  # the person whose publications are looked for: the works of one brand


def _hits(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """References in articles' lists, in several house styles, and the person's publications."""
    w = V.works(s, d)
    name, year = F.concat(F.lit("Maker"), F.substring("brand", 7, 3)), F.concat(F.lit(" ("), F.col("year").cast("string"), F.lit("). "))
    styles = [F.concat(name, F.lit(", K."), year, "title"), F.concat(F.lit("[7] "), name, year, "title"), F.concat(F.lit("J. "), name, F.lit(" & A. Other"), year, "title"), F.concat(F.lit("Karl "), name, F.lit(", "), "title", F.lit(", no date")), F.concat(F.lit("Karl "), name, year, F.lit("A book"))]
    raw = F.element_at(F.array(*styles), (F.col("ref") % 5 + 1).cast("int"))
    doi = lambda c: F.concat(F.lit("10.1/"), c.cast("string"))
    refs = w.select(F.expr("ref div 10").alias("id"), F.col("ref").alias("pos"), raw.alias("raw"), F.array(F.lit("A. Other")).alias("authors"), F.lit(None).cast("int").alias("year"), F.when(F.col("ref") % 9 == 0, F.upper(doi(F.col("ref") % 900))).alias("doi"))
    pubs = w.where("brand = 'Brand#13'").select(F.col("ref").alias("pub"), "title", "year", doi(F.col("ref")).alias("doi"))
    return refs, pubs


_FILL = ", ".join(f"'{w}'" for w in M.TITLE_FILLERS)


@query("e01_author_cites", rf"""WITH {V.WORK}, n AS (SELECT *, 'Maker' || substr(brand, 7, 3) AS name, ' (' || year || '). ' AS y FROM work),
r AS (SELECT ref // 10 AS id, ref AS pos, CASE ref % 5 WHEN 0 THEN name || ', K.' || y || title WHEN 1 THEN '[7] ' || name || y || title WHEN 2 THEN 'J. ' || name || ' & A. Other' || y || title WHEN 3 THEN 'Karl ' || name || ', ' || title || ', no date' ELSE 'Karl ' || name || y || 'A book' END AS raw, CASE WHEN ref % 9 = 0 THEN '10.1/' || ref % 900 END AS doi FROM n),
t AS (SELECT *, raw || ' A. Other' AS b, TRY_CAST(regexp_extract(raw, '\b((?:19|20)\d\d)\b', 1) AS INT) AS year FROM r),
p AS (SELECT ref AS pub, year, '10.1/' || ref AS doi, list_filter(list_distinct(regexp_extract_all(lower(title), '[\p{{L}}\p{{N}}_]{{4,}}')), lambda w: w NOT IN ({_FILL})) AS words FROM work WHERE brand = 'Brand#13'),
g AS (SELECT *, CASE WHEN NOT contains(lower(b), lower('{LAST}')) THEN 'reject' WHEN regexp_matches(b, '(?i)Karl\s+{LAST}|K\.\s*{LAST}|{LAST},\s*Karl|{LAST},\s*K\.') THEN 'strong' WHEN regexp_matches(b, '(?i)[a-z][a-zà-ÿ]*\.?\s+{LAST}|{LAST},?\s*[a-z]') THEN 'reject' ELSE 'weak' END AS tier FROM t),
s AS (SELECT id, pos, raw, pub, 'doi' AS match, 3 AS rank FROM g JOIN p USING (doi)),
o AS (SELECT g.*, pub, len(list_filter(words, lambda w: contains(lower(raw), w))) AS o FROM g LEFT JOIN p ON g.year = p.year WHERE tier <> 'reject' AND pos NOT IN (SELECT pos FROM s)),
k AS (SELECT *, max(CASE WHEN o >= 2 THEN o ELSE 0 END) OVER (PARTITION BY pos) AS top FROM o),
c AS (SELECT *, count(*) OVER (PARTITION BY pos) AS rivals FROM k WHERE CASE WHEN o >= 2 THEN o ELSE 0 END = top),
u AS (SELECT * FROM s UNION ALL SELECT id, pos, raw, pub, CASE WHEN pub IS NULL THEN 'author_only' WHEN top > 0 THEN 'author_year_title' ELSE 'author_year' END, CASE WHEN tier = 'weak' OR pub IS NULL THEN 1 WHEN rivals = 1 THEN 3 ELSE 2 END FROM c),
f AS (SELECT *, row_number() OVER (PARTITION BY id, CASE WHEN pub IS NULL THEN left(raw, 80) ELSE pub::VARCHAR END ORDER BY rank DESC, pos) AS n FROM u)
SELECT id, pub, raw, match, CASE rank WHEN 3 THEN 'high' WHEN 2 THEN 'medium' ELSE 'low' END AS confidence FROM f WHERE n = 1""")
def e01(s: SparkSession, d: str) -> DataFrame:
    return M.author_citations(*_hits(s, d), FIRST, LAST)


@query("e02_library_overlap", f"""WITH {V.WORK}, i AS (SELECT ref AS item, string_split(title || ' ' || lower(topic) || ' ' || lower(brand), ' ') AS t, '10.1/' || ref AS doi FROM work WHERE ref % 40 = 0),
r AS (SELECT ref, string_split(title || ' ' || lower(topic) || ' ' || lower(brand), ' ') AS t, CASE WHEN ref % 80 = 0 THEN '10.1/' || ref END AS doi FROM work),
x AS (SELECT ref, item, 'doi' AS via FROM r JOIN i USING (doi)), e AS (SELECT DISTINCT ref, unnest(t) AS w FROM r WHERE ref NOT IN (SELECT ref FROM x)), f AS (SELECT DISTINCT item, unnest(t) AS w FROM i)
SELECT * FROM x UNION ALL SELECT ref, item, 'title' FROM e JOIN f USING (w) WHERE length(w) >= 4 GROUP BY ref, item HAVING count(*) >= 3""")
def e02(s: SparkSession, d: str) -> DataFrame:
    w = V.works(s, d).select("ref", F.concat_ws(" ", "title", F.lower("topic"), F.lower("brand")).alias("title"), F.concat(F.lit("10.1/"), F.col("ref").cast("string")).alias("doi"))
    items = w.where("ref % 40 = 0").withColumnRenamed("ref", "item")
    return M.library_overlap(w.withColumn("doi", F.when(F.col("ref") % 80 == 0, F.col("doi"))), items)


@query("e03_own_coupling", f"""WITH {V.ART}, {V.REF}, {_OWN}, {_DF}, h AS (SELECT ref.id, ref.ref, 1 / ln(1 + greatest(1, df)) AS w FROM ref JOIN df USING (ref) WHERE ref.ref IN (SELECT ref FROM own))
SELECT id, greatest(count(*), count(*) FILTER (ref % 2 = 0)) AS n, round(greatest(sum(w), coalesce(sum(w) FILTER (ref % 2 = 0), 0)), 4) AS score FROM h GROUP BY id""")
def e03(s: SparkSession, d: str) -> DataFrame:
    refs, o = V.references(s, d), own(s, d)
    df = C.document_frequency(refs)
    even = refs.where("ref % 2 = 0")
    return C.own_coupling(refs, even, o, o, df, df)


@query("e04_own_index", f"WITH {V.ART}, {V.REF}, {_OWN} SELECT DISTINCT ref FROM own")
def e04(s: SparkSession, d: str) -> DataFrame:
    return own(s, d).select("ref").distinct()


@query("e05_inverse_lookup", f"WITH {V.ART}, {V.REF}, {_OWN} SELECT DISTINCT work FROM own WHERE ref % 97 = 0")
def e05(s: SparkSession, d: str) -> DataFrame:
    return own(s, d).where("ref % 97 = 0").select("work").distinct()


@query("e06_attribution", f"""WITH {V.ART}, {V.REF}, {_OWN}, j AS (SELECT ref.id, own.work, count(*) AS shared, min(ref.ref) AS first_via FROM ref JOIN own USING (ref) GROUP BY 1, 2),
k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY shared DESC, work) AS rank FROM j) SELECT id, work, shared, first_via, CAST(rank AS INT) AS rank FROM k WHERE rank <= 3""")
def e06(s: SparkSession, d: str) -> DataFrame:
    return C.attribution(V.references(s, d), own(s, d), 3, 4).select("id", "work", "shared", F.element_at("via", 1).alias("first_via"), "rank")


@query("e07_author_neighbourhood", f"""WITH {V.ART}, {V.REF}, {_OWN}, j AS (SELECT DISTINCT own.work, art.author FROM ref JOIN art USING (id) JOIN own ON own.ref = ref.ref WHERE author % 50 <> 0)
SELECT work, author, count(*) AS n FROM (SELECT own.work, art.author, ref.ref FROM own JOIN ref ON own.ref = ref.ref JOIN art ON art.id = ref.id WHERE author % 50 <> 0) GROUP BY 1, 2 HAVING count(*) >= 2""")
def e07(s: SparkSession, d: str) -> DataFrame:
    author_refs = V.references(s, d).join(V.articles(s, d).select("id", "author"), "id").select("author", "ref")
    seeds = V.articles(s, d).where("author % 50 = 0").select("author").distinct()
    return M.neighbourhood(own(s, d), author_refs, seeds).where("n >= 2")


@query("e08_author_references", f"WITH {V.ART}, {V.REF} SELECT author, count(DISTINCT ref) AS n_refs FROM ref JOIN art USING (id) GROUP BY author")
def e08(s: SparkSession, d: str) -> DataFrame:
    rows = V.references(s, d).join(V.articles(s, d).select("id", "author"), "id")
    return rows.select("author", "ref").distinct().groupBy("author").agg(F.count("*").alias("n_refs"))


@query("e09_author_coupling", f"""WITH {V.ART}, {V.REF}, {_OWN}, {_DF}, a AS (SELECT DISTINCT author, ref FROM ref JOIN art USING (id)) SELECT author, round(sum(1 / ln(1 + greatest(1, df))), 4) AS strength FROM a JOIN df USING (ref) WHERE ref IN (SELECT ref FROM own) GROUP BY author""")
def e09(s: SparkSession, d: str) -> DataFrame:
    refs = V.references(s, d)
    by_author = refs.join(V.articles(s, d).select("id", "author"), "id").select(F.col("author").alias("id"), "ref")
    return C.weighted_overlap(by_author, own(s, d), C.document_frequency(refs)).select(F.col("id").alias("author"), F.round("score", 4).alias("strength"))


@query("e10_best_match", f"""WITH {V.WORK}, c AS (SELECT ref AS cand, year, topic, string_split(title, ' ') AS t FROM work), r AS (SELECT ref, year, topic, string_split(title || ' extra', ' ') AS t FROM work),
j AS (SELECT ref, cand, len(list_intersect(r.t, list_distinct(c.t)))::DOUBLE / len(list_distinct(c.t)) AS score FROM r JOIN c ON r.topic = c.topic AND abs(r.year - c.year) <= 1 WHERE len(list_distinct(c.t)) >= 2)
SELECT ref, min_by(cand, (-score, cand)) AS cand, round(max(score), 6) AS score FROM j WHERE score >= 0.85 GROUP BY ref""")
def e10(s: SparkSession, d: str) -> DataFrame:
    w = V.works(s, d)
    refs = w.select("ref", "year", F.col("topic").alias("author"), F.concat("title", F.lit(" extra")).alias("title"))
    return M.best_match(refs, w.select(F.col("ref").alias("cand"), "year", F.col("topic").alias("author"), "title"), 1, 0.85)


@query("e11_title_equivalence", f"""WITH {V.WORK}, t AS (SELECT ref, string_split(lower(title || ' for ' || topic || ' ' || brand || ' ' || size), ' ') AS w FROM work)
SELECT a.ref AS a, b.ref AS b FROM t a JOIN t b ON a.ref < b.ref AND a.w[1] = b.w[1] WHERE a.w[1:5] = b.w[1:5] OR (len(list_intersect(a.w, b.w)) >= 4 AND len(list_intersect(a.w, b.w)) >= 0.7 * least(len(list_distinct(a.w)), len(list_distinct(b.w))))""")
def e11(s: SparkSession, d: str) -> DataFrame:
    w = F.split(F.lower(F.concat_ws(" ", "title", F.lit("for"), "topic", "brand", F.col("size").cast("string"))), " ")
    return M.equal_titles(V.works(s, d).select("ref", w.alias("w")), "ref", "w")


@query("e12_abbreviation_match", f"""WITH {V.WORK}, n AS (SELECT DISTINCT title AS name, string_split(title, ' ') AS w FROM work), b AS (SELECT DISTINCT title AS full_name, substr(w1, 1, 3) || ' ' || substr(w2, 1, 4) AS short FROM (SELECT title, string_split(title, ' ')[1] AS w1, string_split(title, ' ')[2] AS w2 FROM work)),
s AS (SELECT DISTINCT short, string_split(short, ' ') AS v FROM b)
SELECT short, name FROM s JOIN n ON len(v) = len(w) AND len(v) >= 2 AND (starts_with(w[1], v[1]) OR starts_with(v[1], w[1])) AND (starts_with(w[2], v[2]) OR starts_with(v[2], w[2]))""")
def e12(s: SparkSession, d: str) -> DataFrame:
    names = V.works(s, d).select(F.col("title").alias("name")).distinct()
    w = F.split("name", " ")
    shorts = names.select(F.concat_ws(" ", F.substring(w[0], 1, 3), F.substring(w[1], 1, 4)).alias("short")).distinct()
    return M.abbreviations(shorts, names)


_W3 = lambda c: f"list_distinct(regexp_extract_all({c}, '[\\p{{L}}\\p{{N}}_]{{3,}}'))"


@query("e13_source_scoring", f"""WITH {V.WORK}, q AS (SELECT DISTINCT lower(topic) AS q FROM work), t AS (SELECT ref, lower(topic || CASE WHEN ref % 2 = 0 THEN ' ' || title ELSE '' END) AS name, brand FROM work),
j AS (SELECT *, len(list_intersect({_W3('name')}, {_W3('q')})) AS shared FROM t JOIN q ON true)
SELECT ref, q AS name, CASE WHEN name = q THEN 10 WHEN contains(name, q) THEN 5 WHEN contains(q, name) THEN 3 ELSE 0 END + 4 * (shared::DOUBLE / greatest(len({_W3('q')}), 1)) + CASE WHEN ref % 50 = 0 THEN 20 ELSE 0 END + CASE WHEN brand > 'Brand#2' THEN 1 ELSE 0 END AS score FROM j""")
def e13(s: SparkSession, d: str) -> DataFrame:
    w = V.works(s, d)
    sources = w.select("ref", F.lower(F.concat("topic", F.when(F.col("ref") % 2 == 0, F.concat(F.lit(" "), "title")).otherwise(""))).alias("cand"), (F.col("ref") % 50 == 0).alias("hint"), (F.col("brand") > "Brand#2").alias("type_ok"))
    return M.source_scores(sources, w.select(F.lower("topic").alias("name")))


@query("e14_name_resolution", f"WITH {V.WORK}, {V.REF}, r AS (SELECT ref, 'W' || ref AS work_id FROM work WHERE ref % 4 <> 0) SELECT ref.id, count(*) AS n, count(work_id) AS resolved FROM ref LEFT JOIN r USING (ref) GROUP BY ref.id")
def e14(s: SparkSession, d: str) -> DataFrame:
    known = V.works(s, d).where("ref % 4 <> 0").select("ref", F.concat(F.lit("W"), F.col("ref").cast("string")).alias("work_id"))
    return V.references(s, d).join(known, "ref", "left").groupBy("id").agg(F.count("*").alias("n"), F.count("work_id").alias("resolved"))


@query("e15_cluster_mapping", "SELECT r_name AS cluster, n_name AS journal FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey % 6 <> 0 UNION SELECT r_name, n_name FROM nation JOIN region ON (n_nationkey * 2 % 5) = r_regionkey WHERE n_nationkey % 6 <> 0")
def e15(s: SparkSession, d: str) -> DataFrame:
    return bridge(s, d)


def bridge(s: SparkSession, d: str) -> DataFrame:
    """(cluster, journal) of enabled journals; a journal may be in two clusters."""
    n, r = V.table(s, d, "nation").where("n_nationkey % 6 <> 0"), V.table(s, d, "region")
    one = n.join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    two = n.join(r, F.col("n_nationkey") * 2 % 5 == F.col("r_regionkey"))
    pick = lambda x: x.select(F.col("r_name").alias("cluster"), F.col("n_name").alias("journal"))
    return pick(one).union(pick(two)).distinct()


BRIDGE = "bridge AS (SELECT r_name AS cluster, n_name AS journal FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey % 6 <> 0 UNION SELECT r_name, n_name FROM nation JOIN region ON (n_nationkey * 2 % 5) = r_regionkey WHERE n_nationkey % 6 <> 0)"


@query("e16_cluster_overlap", f"WITH {BRIDGE} SELECT a.cluster AS a, b.cluster AS b, count(DISTINCT a.journal) AS shared FROM bridge a JOIN bridge b ON a.journal = b.journal AND a.cluster <> b.cluster GROUP BY 1, 2")
def e16(s: SparkSession, d: str) -> DataFrame:
    b = bridge(s, d)
    return b.select(F.col("cluster").alias("a"), "journal").join(b.select(F.col("cluster").alias("b"), "journal"), "journal").where("a <> b").groupBy("a", "b").agg(F.countDistinct("journal").alias("shared"))


@query("e17_near_duplicate_files", f"""WITH {V.WORK}, f AS (SELECT ref, lower(title || ' ' || topic || ' ' || brand) AS t FROM work), w AS (SELECT DISTINCT ref, unnest(regexp_extract_all(t, '[\\p{{L}}\\p{{N}}_]{{5,}}')) AS w FROM f)
SELECT a.ref AS a, b.ref AS b FROM w a JOIN w b ON a.w = b.w AND a.ref < b.ref GROUP BY 1, 2 HAVING count(*) >= 3 OR (count(*) = 2 AND max(length(a.w)) >= 8)""")
def e17(s: SparkSession, d: str) -> DataFrame:
    files = V.works(s, d).select("ref", F.concat_ws(" ", "title", "topic", "brand").alias("name"))
    return M.similar_names(files, "ref", "name")


@query("e18_shared_author_probe", f"""WITH {V.ART}, {V.REF}, a AS (SELECT DISTINCT author, ref FROM ref JOIN art USING (id)), y AS (SELECT author, count(DISTINCT year) AS years FROM art GROUP BY author), p AS (SELECT DISTINCT author AS l, author + 1 AS r FROM art),
n AS (SELECT author, count(*) AS n FROM a GROUP BY author), k AS (SELECT x.author AS l, count(*) AS shared FROM a x JOIN a y ON y.author = x.author + 1 AND y.ref = x.ref GROUP BY x.author)
SELECT p.l, p.r, coalesce(shared, 0) AS shared, coalesce(n.n, 0) - coalesce(shared, 0) AS only_l, coalesce(y.years, 0) AS years_l FROM p LEFT JOIN k ON k.l = p.l LEFT JOIN n ON n.author = p.l LEFT JOIN y ON y.author = p.l""")
def e18(s: SparkSession, d: str) -> DataFrame:
    art = V.articles(s, d)
    refs = V.references(s, d).join(art.select("id", "author"), "id").select("author", "ref").distinct()
    years = art.groupBy("author").agg(F.countDistinct("year").alias("years_l"))
    pairs = art.select(F.col("author").alias("l")).distinct().withColumn("r", F.col("l") + 1)
    return M.probe(pairs, refs).join(years, F.col("l") == F.col("author"), "left").select("l", "r", "shared", "only_l", F.coalesce("years_l", F.lit(0)).alias("years_l"))


