"""Queries of section D: predicates, filters and search."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citemill import views as V
from citemill.functions.text import tokens
from citemill.operators import fulltext
from citemill.operators import matching as M
from citemill.operators import search as S
from citemill.operators.automaton import terms_in
from citemill.plans.registry import query
from citemill.shared import scratch

DOCS = lambda s, d: V.table(s, d, "documents")
_WORD = lambda c, w: f"regexp_matches({c}, '(?i)(^|[^\\p{{L}}\\p{{N}}_])' || '{w}' || '($|[^\\p{{L}}\\p{{N}}_])')"


@query("d01_whole_word_search", f"WITH b AS (SELECT doc_id, source || ' ' || text AS b FROM documents) SELECT doc_id FROM b WHERE {_WORD('b', 'than')} AND {_WORD('b', 'and the')} ORDER BY doc_id LIMIT 100")
def d01(s: SparkSession, d: str) -> DataFrame:
    return DOCS(s, d).where(S.matches(S.blob(["source", "text"]), 'than "and the"')).select("doc_id").orderBy("doc_id").limit(100)


@query("d01_indexed_search", f"""WITH b AS (SELECT doc_id, source || ' ' || text AS b FROM documents), q(query) AS (VALUES ('than "and the"'), ('Src5 of'), ('"that of and"'), ('nowhere than'))
SELECT query, doc_id FROM b JOIN q ON CASE query WHEN 'than "and the"' THEN {_WORD('b', 'than')} AND {_WORD('b', 'and the')} WHEN 'Src5 of' THEN {_WORD('b', 'src5')} AND {_WORD('b', 'of')} WHEN '"that of and"' THEN {_WORD('b', 'that of and')} ELSE false END""")
def d01_indexed(s: SparkSession, d: str) -> DataFrame:
    """Whole words and phrases by a positional index instead of a scan of all texts."""
    docs, path = DOCS(s, d), scratch(s, "fulltext")
    fulltext.build_index(docs, "doc_id", ["source", "text"], path)
    found = [fulltext.search(docs, "doc_id", ["source", "text"], path, q).select(F.lit(q).alias("query"), "doc_id") for q in ('than "and the"', "Src5 of", '"that of and"', "nowhere than")]
    return reduce(DataFrame.unionByName, found)


@query("d02_regex_search", "SELECT doc_id FROM documents WHERE regexp_matches(text, '(?is)th[aeo]n\\s+(and|of)')")
def d02(s: SparkSession, d: str) -> DataFrame:
    return DOCS(s, d).where(S.matches(F.col("text"), r"th[aeo]n\s+(and|of)", regex=True)).select("doc_id")


@query("d03_fuzzy_candidates", "SELECT doc_id FROM documents WHERE source IS NOT NULL AND (contains(lower(text), 'thean') OR contains(lower(text), 'ouver') OR contains(lower(source), 'src19')) ORDER BY doc_id DESC LIMIT 220")
def d03(s: SparkSession, d: str) -> DataFrame:
    return DOCS(s, d).where(F.col("source").isNotNull() & S.any_term(["text", "source"], ["thean", "ouver", "src19"])).orderBy(F.desc("doc_id")).limit(220).select("doc_id")


_T = [("ring", 2.2), ("bolt", 2.08), ("media", 1.96 * 0.55), ("small ring", 3.0)]


@query("d04_weighted_scoring", f"""WITH {V.WORK}, f AS (SELECT ref, title, topic AS topics, lower(brand) AS abstract, 2015 + ref % 12 AS y, CASE ref % 4 WHEN 0 THEN 'pflichtlektuere' WHEN 1 THEN 'lesenswert' WHEN 2 THEN 'scannen' ELSE 'ignorieren' END AS v FROM work),
s AS (SELECT ref, v, CASE v WHEN 'pflichtlektuere' THEN 6 WHEN 'lesenswert' THEN 4 WHEN 'scannen' THEN 1 ELSE -4 END + greatest(least((y - 2018) * 0.15::DOUBLE, 1.5), 0) + {' + '.join(f"CASE WHEN contains(lower({c}), '{t}') THEN {w * x!r}::DOUBLE ELSE 0 END" for t, w in _T for c, x in (('title', 5), ('topics', 4), ('abstract', 2)))} AS score FROM f)
SELECT ref, v AS verdict, round(score, 6) AS score FROM s WHERE score > 0 ORDER BY v = 'ignorieren', round(score, 6) DESC, ref LIMIT 300""")
def d04(s: SparkSession, d: str) -> DataFrame:
    r = F.col("ref")
    verdict = F.when(r % 4 == 0, "pflichtlektuere").when(r % 4 == 1, "lesenswert").when(r % 4 == 2, "scannen").otherwise("ignorieren")
    rows = V.works(s, d).withColumn("verdict", verdict)
    score = S.weighted_score({"title": F.col("title"), "topics": F.col("topic"), "abstract": F.lower("brand")}, ["ring", "bolt", "media"], ["small ring"], F.col("verdict"), r % 12 + 2015)
    return S.ranked(rows.withColumn("score", score), "score", "verdict", "ref", 300).select("ref", "verdict", F.round("score", 6).alias("score"))


@query("d05_argument_units", f"""WITH {V.WORK}, u(unit, terms) AS (VALUES ('a', ['ring', 'red', 'brand#1']), ('b', ['bolt', 'small', 'brand#2'])), s AS (SELECT unit, ref, len(list_filter(terms, lambda t: contains(lower(title || ' ' || brand), t))) AS hits FROM work, u),
r AS (SELECT *, row_number() OVER (PARTITION BY unit ORDER BY hits DESC, ref) AS r FROM s WHERE hits > 0) SELECT unit, ref, CAST(hits AS INT) AS hits FROM r WHERE r <= 25""")
def d05(s: SparkSession, d: str) -> DataFrame:
    units = {"a": ["ring", "red", "brand#1"], "b": ["bolt", "small", "brand#2"]}
    return S.top_per_unit(V.works(s, d).withColumn("t", F.concat_ws(" ", "title", "brand")), "t", "ref", units, 25)


@query("d06_verdict_listing", f"WITH {V.ART} SELECT id, agent FROM art WHERE agent IN ('lesenswert', 'scannen') ORDER BY fetched DESC, id LIMIT 150")
def d06(s: SparkSession, d: str) -> DataFrame:
    return V.articles(s, d).where(F.col("agent").isin("lesenswert", "scannen")).orderBy(F.desc("fetched"), "id").limit(150).select("id", "agent")


@query("d07_literal_grep", f"WITH {V.ART} SELECT id FROM art WHERE contains(title, 'study 1') ORDER BY nullif(\"user\", '') IS NOT NULL DESC, year DESC, id LIMIT 80")
def d07(s: SparkSession, d: str) -> DataFrame:
    return V.articles(s, d).where(F.contains("title", F.lit("study 1"))).orderBy(F.nullif("user", F.lit("")).isNotNull().desc(), F.desc("year"), "id").limit(80).select("id")


_TERMS = ["other", "under", "thing", "eauou", "those", "tions", "which"]
_LIST = "[" + ", ".join(f"'{t}'" for t in sorted(_TERMS)) + "]"


@query("d08_key_term_hits", f"SELECT doc_id, array_to_string(list_filter({_LIST}, lambda t: contains(lower(text), t)), ',') AS hits FROM documents")
def d08(s: SparkSession, d: str) -> DataFrame:
    return DOCS(s, d).select("doc_id", F.array_join(S.term_hits(F.col("text"), _TERMS), ",").alias("hits"))


@query("d09_catchword_hits", f"WITH {V.WORK}, t AS (SELECT unnest(['red', 'small ring', 'maker', 'brand#11', 'gear']) AS w EXCEPT SELECT 'red') SELECT ref, string_agg(w, ',' ORDER BY w) AS hits FROM work JOIN t ON contains(lower(title || ' ' || brand), w) GROUP BY ref")
def d09(s: SparkSession, d: str) -> DataFrame:
    words = [w for w in ("red", "small ring", "maker", "brand#11", "gear") if w not in ("red",)]
    hits = S.term_hits(F.concat_ws(" ", "title", "brand"), words)
    return V.works(s, d).select("ref", F.array_join(hits, ",").alias("hits")).where("hits <> ''")


@query("d08_key_term_table", r"""WITH t AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]{5,}')) AS term FROM benchmark), h AS (SELECT doc_id, term FROM documents JOIN t ON contains(lower(text), term))
SELECT doc_id, count(term) AS n, md5(coalesce(string_agg(term, ',' ORDER BY term), '')) AS terms_md5 FROM documents LEFT JOIN h USING (doc_id) GROUP BY doc_id""")
def d08_table(s: SparkSession, d: str) -> DataFrame:
    """All words of the test items as key terms, whatever their number."""
    terms = V.table(s, d, "benchmark").select(F.explode(tokens(F.col("text"), 5)).alias("term"))
    hits = terms_in(DOCS(s, d).select("doc_id", F.lower("text").alias("text")), "text", terms)
    return hits.select("doc_id", F.size("_terms").cast("long").alias("n"), F.md5(F.array_join("_terms", ",").cast("binary")).alias("terms_md5"))


@query("d09_catchword_table", f"""WITH {V.WORK}, t AS (SELECT DISTINCT lower(unnest(string_split(title || ' ' || topic, ' '))) AS w FROM work WHERE ref % 2 = 1), x AS (SELECT ref, lower(title || ' ' || topic || ' ' || brand) AS t FROM work)
SELECT ref, string_agg(w, ',' ORDER BY w) AS hits FROM x JOIN t ON contains(t, w) GROUP BY ref""")
def d09_table(s: SparkSession, d: str) -> DataFrame:
    """Catchwords that are words of other works."""
    w = V.works(s, d)
    terms = w.where("ref % 2 = 1").select(F.explode(F.split(F.lower(F.concat_ws(" ", "title", "topic")), " ")).alias("term"))
    hits = terms_in(w.select("ref", F.lower(F.concat_ws(" ", "title", "topic", "brand")).alias("t")), "t", terms)
    return hits.select("ref", F.array_join("_terms", ",").alias("hits")).where("hits <> ''")


@query("d10_junk_titles", "WITH t AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'Editorial: ' WHEN 1 THEN 'Erratum' WHEN 2 THEN 'Editorials of ' ELSE '' END || p_name AS t FROM part) SELECT p_partkey, regexp_matches(trim(lower(t)), '^(editorial|erratum|corrigendum|book review|table of contents|contributors|index|masthead|call for papers|obituary)(:| |$)') AS junk FROM t")
def d10(s: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey") % 4
    return V.table(s, d, "part").select("p_partkey", S.junk_title(F.concat(F.when(k == 0, "Editorial: ").when(k == 1, "Erratum").when(k == 2, "Editorials of ").otherwise(""), "p_name")).alias("junk"))


@query("d11_missing_abstract", f"WITH {V.ART} SELECT id FROM art WHERE coalesce(\"user\", '') = '' AND agent <> 'scannen' AND year >= 1997 AND journal = 'NATION_3'")
def d11(s: SparkSession, d: str) -> DataFrame:
    return V.articles(s, d).where((F.coalesce("user", F.lit("")) == "") & (F.col("agent") != "scannen") & (F.col("year") >= 1997) & (F.col("journal") == "NATION_3")).select("id")


@query("d12_stale_reset", f"WITH {V.ART} SELECT id, CASE WHEN agent = 'ignorieren' AND \"user\" <> '' THEN NULL ELSE agent END AS agent, CASE WHEN agent = 'ignorieren' AND \"user\" <> '' THEN NULL ELSE cost END AS cost FROM art")
def d12(s: SparkSession, d: str) -> DataFrame:
    stale = (F.col("agent") == "ignorieren") & (F.col("user") != "")
    return V.articles(s, d).select("id", *[F.when(stale, F.lit(None)).otherwise(F.col(c)).alias(c) for c in ("agent", "cost")])


_TITLE = "title || ' of the ' || brand || CASE ref % 3 WHEN 0 THEN ': a <i>study</i> of care, and of repair in schools and other places' ELSE '' END"
_PLAIN = lambda c: f"trim(lower(regexp_replace(regexp_replace(regexp_replace({c}, '<[^>]+>', '', 'g'), '[^\\p{{L}}\\p{{N}}_\\s]', ' ', 'g'), '\\s+', ' ', 'g')))"


@query("d13_own_publication", f"""WITH {V.WORK}, a AS (SELECT ref AS id, CASE WHEN ref % 7 = 0 THEN '10.1/' || (ref % 70) END AS doi, lower('A. ' || topic) AS s, {_PLAIN(_TITLE)} AS t FROM work),
p AS (SELECT ref AS pub, '10.1/' || ref AS doi, lower(topic) AS s, {_PLAIN(_TITLE)} AS t FROM work WHERE ref < 70),
u AS (SELECT id, pub, 0 AS o FROM a JOIN p USING (doi) UNION ALL SELECT id, pub, 1 FROM a JOIN p ON contains(a.s, p.s) AND length(a.t) >= 20 AND p.t <> '' AND (contains(p.t, a.t[1:60]) OR contains(a.t, p.t[1:60]))) SELECT id, min_by(pub, (o, pub)) AS pub FROM u GROUP BY id""")
def d13(s: SparkSession, d: str) -> DataFrame:
    tail = F.when(F.col("ref") % 3 == 0, ": a <i>study</i> of care, and of repair in schools and other places").otherwise("")
    w = V.works(s, d).select("ref", F.col("topic").alias("surname"), F.concat("title", F.lit(" of the "), "brand", tail).alias("title"))
    num = lambda c: F.concat(F.lit("10.1/"), c.cast("string"))
    arts = w.withColumn("doi", F.when(F.col("ref") % 7 == 0, num(F.col("ref") % 70))).withColumn("authors", F.array(F.concat(F.lit("A. "), "surname"))).withColumnRenamed("ref", "id")
    return M.own_publication(arts, w.where("ref < 70").withColumn("doi", num(F.col("ref"))).withColumnRenamed("ref", "pub"))


@query("d14_cue_match", "SELECT doc_id, regexp_matches(lower(text), '\\bthan\\b') AS word_hit, contains(lower(text), 'and the') AS phrase_hit FROM documents WHERE lang = 'en'")
def d14(s: SparkSession, d: str) -> DataFrame:
    return DOCS(s, d).where("lang = 'en'").select("doc_id", S.cue_hit("than", F.col("text")).alias("word_hit"), S.cue_hit("and the", F.col("text")).alias("phrase_hit"))


@query("d15_project_match", f"""WITH {V.WORK}, t AS (SELECT ref, lower(title || ' ' || topic || ' ' || brand) AS t FROM work), c AS (SELECT ref, t, CASE WHEN contains(t, 'small ring') THEN 2 ELSE 0 END + CASE WHEN regexp_matches(t, '\\bbolt\\b') THEN 1 ELSE 0 END AS p1, CASE WHEN regexp_matches(t, '\\beconomy\\b') THEN 1 ELSE 0 END + CASE WHEN regexp_matches(t, '\\bsmall\\b') THEN 1 ELSE 0 END AS o1, regexp_matches(t, '\\bred\\b') AND NOT regexp_matches(t, '\\blarge\\b') AS b1,
  CASE WHEN regexp_matches(t, '\\bgear\\b') THEN 1 ELSE 0 END AS p2, CASE WHEN regexp_matches(t, '\\bblue\\b') THEN 1 ELSE 0 END + CASE WHEN regexp_matches(t, '\\bsmall\\b') THEN 1 ELSE 0 END AS o2, regexp_matches(t, '\\bpromo\\b') AS h2 FROM t),
s AS (SELECT ref, CASE WHEN NOT b1 AND p1 + o1 >= 2 AND (p1 > 0 OR p1 + o1 >= 4) THEN p1 + o1 END AS s1, CASE WHEN NOT h2 AND p2 + o2 >= 2 AND (p2 > 0 OR p2 + o2 >= 4) THEN p2 + o2 END AS s2 FROM c)
SELECT ref, CASE WHEN s1 IS NULL THEN coalesce(CASE WHEN s2 IS NOT NULL THEN 'two' END, '') WHEN s2 IS NULL THEN 'one' WHEN s2 > s1 THEN 'two,one' ELSE 'one,two' END AS projects FROM s""")
def d15(s: SparkSession, d: str) -> DataFrame:
    projects = {"one": {"phrases": ["small ring", "bolt"], "overlap": ["economy", "small"], "block": ["red"], "rescue": ["large"]}, "two": {"phrases": ["gear"], "overlap": ["blue", "small"], "hard_block": ["promo"]}}
    return V.works(s, d).select("ref", F.array_join(S.project_hits(F.concat_ws(" ", "title", "topic", "brand"), projects), ",").alias("projects"))


@query("d16_pattern_labels", f"WITH {V.WORK}, t AS (SELECT ref, title || ' | ' || topic AS t FROM work) SELECT ref, concat_ws(',', CASE WHEN regexp_matches(t, '(?i)bolt|gear') THEN 'parts' END, CASE WHEN regexp_matches(t, '(?i)^(red|blue)') THEN 'tinted' END, CASE WHEN regexp_matches(t, '(?i)small') THEN 'tiny' END) AS labels FROM t")
def d16(s: SparkSession, d: str) -> DataFrame:
    rules = {"tinted": ["^(red|blue)"], "parts": ["bolt", "gear"], "tiny": ["small"]}
    return V.works(s, d).select("ref", F.array_join(S.labels(F.concat_ws(" | ", "title", "topic"), rules), ",").alias("labels"))


@query("d17_abstract_choice", "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN event_type WHEN event_id % 3 = 0 THEN 'second' END AS abstract FROM events")
def d17(s: SparkSession, d: str) -> DataFrame:
    i = F.col("event_id")
    return V.table(s, d, "events").select("event_id", S.abstract_choice(F.when(i % 2 == 0, F.col("event_type")).otherwise(F.col("props")), F.when(i % 3 == 0, "second").otherwise(" ")).alias("abstract"))


