"""Queries of section G: scoring, ranking and top-k; and F27, F28, which need the same similarity."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from citemill import views as V
from citemill.operators import coupling as C
from citemill.operators import scoring as S
from citemill.operators import search as Q
from citemill.operators.automaton import terms_in
from citemill.operators.ordered import running
from citemill.operators.profiles import parse_profiles
from citemill.operators.quantiles import exact_quantiles
from citemill.operators.text_cosine import tfidf_similarity
from citemill.plans.join_queries import _DF, _OWN, own
from citemill.plans.registry import query

T = V.table
R6 = lambda c, name: F.round(c, 6).alias(name)


def trigger_refs(s: SparkSession, d: str) -> DataFrame:
    a = V.articles(s, d).where("author % 50 = 7").select("id", "author")
    return V.references(s, d).join(a, "id").select("author", "ref")


_TRIG = "trig AS (SELECT author, ref FROM ref JOIN art USING (id) WHERE author % 50 = 7)"
_GAP = "gap AS (SELECT ref, count(DISTINCT author) AS authors FROM trig WHERE ref NOT IN (SELECT ref FROM own) GROUP BY ref)"
BASE = f"WITH {V.ART}, {V.REF}, {_OWN}, {_TRIG}, {_GAP}, {_DF}"


@query("g01_blind_spot_coupling", BASE + " SELECT id, count(*) AS n, round(sum(1 / ln(1 + greatest(1, df))), 4) AS score FROM ref JOIN df USING (ref) WHERE ref IN (SELECT ref FROM gap) GROUP BY id")
def g01(s: SparkSession, d: str) -> DataFrame:
    refs = V.references(s, d)
    return C.weighted_overlap(refs, C.set_difference(trigger_refs(s, d), own(s, d)), C.document_frequency(refs)).withColumn("score", F.round("score", 4))


@query("g02_set_difference_index", BASE + " SELECT ref, authors FROM gap")
def g02(s: SparkSession, d: str) -> DataFrame:
    return C.set_difference(trigger_refs(s, d), own(s, d))


def signals(s: SparkSession, d: str) -> DataFrame:
    """One record an article: its own and blind-spot coupling beside the facts that decisions rest on; what it cites is read once for both."""
    refs = V.references(s, d)
    mine = own(s, d).select("ref").distinct().withColumn("mine", F.lit(True))
    gap = C.set_difference(trigger_refs(s, d), own(s, d)).select("ref", F.lit(True).alias("gap"))
    flags = mine.join(gap, "ref", "full_outer").join(C.document_frequency(refs), "ref").select("ref", "mine", "gap", C.idf(F.col("df")).alias("w"))
    of = lambda flag, c: F.sum(F.when(F.col(flag), c))
    hits = refs.join(flags, "ref").groupBy("id").agg(F.round(of("mine", F.col("w")), 4).alias("own"), of("mine", F.lit(1)).alias("own_n"), (F.round(of("gap", F.col("w")), 4) * 4).alias("blind"))
    a = V.articles(s, d).select("id", "agent", "author", "segment", "year")
    z = lambda c: F.coalesce(c, F.lit(0.0)).alias(c)
    return a.join(hits, "id", "left").select("id", "agent", "author", "segment", "year", z("own"), F.coalesce("own_n", F.lit(0)).alias("own_n"), z("blind"))


_SIG = """o AS (SELECT id, round(sum(1 / ln(1 + greatest(1, df))), 4) AS own, count(*) AS own_n FROM ref JOIN df USING (ref) WHERE ref IN (SELECT ref FROM own) GROUP BY id), b AS (SELECT id, round(sum(1 / ln(1 + greatest(1, df))), 4) * 4 AS blind FROM ref JOIN df USING (ref) WHERE ref IN (SELECT ref FROM gap) GROUP BY id),
sig AS (SELECT art.id, agent, author, segment, year, coalesce(o.own, 0) AS own, coalesce(own_n, 0) AS own_n, coalesce(blind, 0) AS blind FROM art LEFT JOIN o USING (id) LEFT JOIN b USING (id))"""


@query("g03_composite_signals", f"{BASE}, {_SIG} SELECT id, agent, round(own, 4) AS own, own_n, round(blind, 4) AS blind FROM sig")
def g03(s: SparkSession, d: str) -> DataFrame:
    return signals(s, d).select("id", "agent", F.round("own", 4).alias("own"), "own_n", F.round("blind", 4).alias("blind"))


_INDIC = """CASE WHEN agent IN ('pflichtlektuere', 'lesenswert') OR own >= 1.5 OR blind >= 8 OR (agent = 'scannen' AND segment = 'MACHINERY' AND (id % 6 = 0 OR own_n > 2)) THEN 'starker_indikator'
 WHEN own >= 0.6 OR blind >= 3 OR (agent = 'scannen' AND segment = 'MACHINERY') OR (agent = 'ignorieren' AND segment = 'MACHINERY' AND (id % 6 = 0 OR own_n > 3)) OR id % 6 = 0 OR own_n > 2 OR agent = 'scannen' THEN 'schwacher_indikator' ELSE 'kein_indikator' END"""


def _decided(s: SparkSession, d: str) -> DataFrame:
    x = signals(s, d)
    proj, remark, n = F.col("segment") == "MACHINERY", F.col("id") % 6 == 0, F.greatest(F.col("own_n") - 2, F.lit(0))
    ind = S.indicator(F.col("agent"), F.col("own"), F.col("blind"), proj, remark, n)
    x = x.withColumn("indicator", ind)
    explicit = F.when(F.col("id") % 97 == 0, "manual")
    mode = S.selection_mode(explicit, F.col("author") % 90 == 1, F.col("author") % 50 == 7, F.col("own"), F.col("blind"), proj, F.col("id") % 4 == 1, F.col("id") % 5 == 1, F.when(F.col("id") % 7 > 0, F.col("agent")), F.col("indicator"))
    return x.withColumn("mode", mode)


_MODE = f"""dec AS (SELECT *, {_INDIC} AS indicator FROM sig), md AS (SELECT *, CASE WHEN id % 97 = 0 THEN 'manual' WHEN author % 90 = 1 THEN 'citation' WHEN author % 50 = 7 THEN 'trigger' WHEN own >= 0.6 THEN 'own_coupling' WHEN blind >= 8 THEN 'adversarial'
 WHEN segment = 'MACHINERY' AND id % 4 = 1 AND indicator <> 'kein_indikator' THEN 'mixed' WHEN segment = 'MACHINERY' AND indicator <> 'kein_indikator' THEN 'complementarity' WHEN id % 4 = 1 OR id % 5 = 1 THEN 'similarity' WHEN id % 7 > 0 THEN 'screening' ELSE 'none' END AS mode FROM dec)"""


@query("g04_selection_mode", f"{BASE}, {_SIG}, {_MODE} SELECT id, mode FROM md")
def g04(s: SparkSession, d: str) -> DataFrame:
    return _decided(s, d).select("id", "mode")


@query("g05_indicator", f"{BASE}, {_SIG}, {_MODE} SELECT id, indicator FROM md")
def g05(s: SparkSession, d: str) -> DataFrame:
    return _decided(s, d).select("id", "indicator")


@query("g06_double_hit_lift", f"{BASE}, {_SIG}, {_MODE} SELECT id, CASE WHEN mode = 'citation' AND own_n >= 2 THEN 'starker_indikator' ELSE indicator END AS indicator FROM md")
def g06(s: SparkSession, d: str) -> DataFrame:
    return _decided(s, d).select("id", S.lift_double_hit(F.col("mode"), F.col("indicator"), F.col("own_n")).alias("indicator"))


@query("g07_subgroup_choice", f"""WITH {V.WORK}, t AS (SELECT ref, lower(title || ' ' || topic) AS t FROM work), c AS (SELECT ref, CASE WHEN contains(t, 'gear') THEN 2 ELSE 0 END + CASE WHEN contains(t, 'red gear') THEN 3 ELSE 0 END AS a, CASE WHEN contains(t, 'red') THEN 2 ELSE 0 END + CASE WHEN contains(t, 'economy') THEN 2 ELSE 0 END AS b FROM t)
SELECT ref, CASE WHEN a = 0 AND b = 0 THEN NULL WHEN b > a THEN 'tinted' WHEN a > b THEN 'wheels' ELSE 'tinted' END AS name, round(CASE WHEN a > 0 OR b > 0 THEN least(0.95, 0.35 + greatest(a, b) / 10.0::DOUBLE) END, 6) AS confidence FROM c""")
def g07(s: SparkSession, d: str) -> DataFrame:
    cues = {"wheels": (["gear"], ["red gear"]), "tinted": (["red", "economy"], [])}
    return V.works(s, d).select("ref", S.subgroup(F.concat_ws(" ", "title", "topic"), cues).alias("g")).select("ref", "g.name", R6(F.col("g.confidence"), "confidence"))


def _emb(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    e = T(s, d, "embeddings")
    rows = e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), F.col("label").alias("title"))
    return rows, e.where("vec_id % 40 = 3").select(F.col("vec_id").alias("near"), F.col("embedding").alias("u"), F.col("label").alias("near_title"))


_COS = """ev AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings), nm AS (SELECT vec_id, sqrt(sum(x * x)) AS m FROM ev GROUP BY 1),
cs AS (SELECT a.vec_id AS id, b.vec_id AS near, any_value(a.label) AS title, any_value(b.label) AS near_title, sum(a.x * b.x) / greatest(any_value(p.m) * any_value(q.m), 1e-12) AS sim FROM ev a JOIN ev b ON a.i = b.i AND b.vec_id % 40 = 3 JOIN nm p ON p.vec_id = a.vec_id JOIN nm q ON q.vec_id = b.vec_id GROUP BY 1, 2)"""


@query("g08_text_similarity", f"WITH {_COS} SELECT id, round(max(sim), 5) AS sim FROM cs GROUP BY 1")
def g08(s: SparkSession, d: str) -> DataFrame:
    return S.nearest(*_emb(s, d), 1, skip_same=False).select("id", F.round("sim", 5).alias("sim"))


@query("g09_empirical_bayes_prior", f"WITH {V.SCORED} SELECT grp, round((sum(y) + (SELECT avg(y) FROM scored) * 5) / (count(*) + 5), 6) AS prior FROM scored GROUP BY 1")
def g09(s: SparkSession, d: str) -> DataFrame:
    return S.eb_prior(V.scored(s, d), "grp", "y").select("grp", R6(F.col("prior"), "prior"))


@query("g10_frozen_min_max", f"WITH {V.SCORED} SELECT id, round(greatest(0, least(1, (s - 0.2) / (0.6 + 1e-9))), 6) AS z FROM scored")
def g10(s: SparkSession, d: str) -> DataFrame:
    return V.scored(s, d).select("id", R6(S.unit(F.col("s"), 0.2, 0.8), "z"))


def _composite(s: SparkSession, d: str) -> DataFrame:
    x = V.scored(s, d)
    p = S.eb_prior(x, "grp", "y").select("grp", "prior")
    score = S.composite(F.col("s"), F.col("prior"), F.col("z") == 1, {"g": 0.8, "lift_max": 0.1, "lo": 0.1, "hi": 0.9, "mc": 1.5})
    return x.join(p, "grp").withColumn("score", score)


_COMPOSITE = f"""WITH {V.SCORED}, pr AS (SELECT grp, (sum(y) + (SELECT avg(y) FROM scored) * 5) / (count(*) + 5) AS prior FROM scored GROUP BY 1),
cp AS (SELECT scored.*, round(greatest(0, least(1, (greatest(0, least(1, (s - 0.1) / (0.8 + 1e-9))) + 0.5 * greatest(0, least(1, greatest(0, prior - 0.8) / (0.1 + 1e-9)))) / (1.5 + 1e-9))) + CASE WHEN z = 1 THEN 1 ELSE 0 END, 4) AS score FROM scored JOIN pr USING (grp))"""


@query("g11_composite_zones", _COMPOSITE + " SELECT id, score, CASE WHEN id % 9 = 0 THEN 'no_abstract' WHEN score < 0.25 THEN 'drop' ELSE 'mid' END AS zone FROM cp")
def g11(s: SparkSession, d: str) -> DataFrame:
    return _composite(s, d).select("id", "score", S.zone(F.col("score"), F.col("id") % 9 != 0, 0.25).alias("zone"))


@query("g12_vote_combination", """WITH v AS (SELECT l_orderkey AS id, CASE WHEN l_linenumber = 7 THEN NULL WHEN l_returnflag = 'A' THEN 'lesenswert' WHEN l_returnflag = 'R' AND l_quantity > 25 THEN 'scannen' ELSE 'ignorieren' END AS v FROM lineitem), g AS (SELECT id, bool_or(v <> 'ignorieren') AS k, count(v) AS n, min(CASE v WHEN 'lesenswert' THEN 2 WHEN 'scannen' THEN 3 ELSE 4 END) FILTER (v IS NOT NULL) AS m FROM v GROUP BY 1)
SELECT id, coalesce(k, true) AS keep, n AS votes, n < 2 AS flagged, CASE WHEN NOT coalesce(k, true) THEN 'ignorieren' WHEN m = 2 THEN 'lesenswert' ELSE 'scannen' END AS verdict FROM g""")
def g12(s: SparkSession, d: str) -> DataFrame:
    f, q = F.col("l_returnflag"), F.col("l_quantity")
    v = F.when(F.col("l_linenumber") == 7, None).when(f == "A", "lesenswert").when((f == "R") & (q > 25), "scannen").otherwise("ignorieren")
    return S.combine_votes(T(s, d, "lineitem").select(F.col("l_orderkey").alias("id"), v.alias("v")), "id", "v")


@query("g13_linear_filter", """WITH e AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings), m AS (SELECT vec_id, sum((x - 0.01) / 0.5 * ((i % 5) - 2)) AS x FROM e GROUP BY 1)
SELECT vec_id, round(1 / (1 + exp(-(0.7 * x - 0.1))), 5) AS p, 1 / (1 + exp(-(0.7 * x - 0.1))) < 0.3 AS dropped FROM m""")
def g13(s: SparkSession, d: str) -> DataFrame:
    p = S.linear_score(F.col("embedding"), [float((i + 1) % 5 - 2) for i in range(64)], [0.01] * 64, [0.5] * 64, 0.7, -0.1)
    return T(s, d, "embeddings").select("vec_id", p.alias("p")).select("vec_id", F.round("p", 5).alias("p"), (F.col("p") < 0.3).alias("dropped"))


@query("g14_loss_threshold", f"WITH {V.SCORED}, p AS (SELECT s, sum(y) AS p FROM scored GROUP BY 1), b AS (SELECT s, coalesce(sum(p) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM p) SELECT max(s) AS threshold FROM b WHERE b <= 0.05::DOUBLE * (SELECT sum(y) FROM scored)")
def g14(s: SparkSession, d: str) -> DataFrame:
    return S.loss_threshold(V.scored(s, d), "s", "y", 0.05)


@query("g14_platt_fit")
def g14p(s: SparkSession, d: str) -> DataFrame:
    a, b = S.platt(V.scored(s, d), "s", "y")
    return s.createDataFrame([(round(a, 6), round(b, 6))], "a double, b double")


@query("g15_nearest_examples", f"WITH {_COS}, r AS (SELECT id, near, row_number() OVER (PARTITION BY id ORDER BY round(sim, 6) DESC, near) AS rank FROM cs WHERE title <> near_title) SELECT id, near, CAST(rank AS INT) AS rank FROM r WHERE rank <= 3")
def g15(s: SparkSession, d: str) -> DataFrame:
    return S.nearest(*_emb(s, d), 3).select("id", "near", "rank")


@query("g16_escalation_priority", f"""{BASE}, {_SIG}, {_MODE} SELECT id, round(own + blind + CASE WHEN indicator = 'starker_indikator' THEN 0.5 ELSE 0 END + CASE agent WHEN 'scannen' THEN 0.2 WHEN 'ignorieren' THEN -0.5 ELSE 0 END, 4) AS prio FROM md WHERE agent <> 'lesenswert' ORDER BY prio DESC, id LIMIT 50""")
def g16(s: SparkSession, d: str) -> DataFrame:
    p = S.priority(F.col("own"), F.col("blind"), F.col("indicator"), F.col("agent"))
    return _decided(s, d).where("agent <> 'lesenswert'").select("id", F.round(p, 4).alias("prio")).orderBy(F.desc("prio"), "id").limit(50)


@query("g17_three_zones", f"WITH {V.SCORED}, p AS (SELECT t, sum(y) AS p, count(*) AS n FROM scored GROUP BY 1), r AS (SELECT *, sum(p) OVER w AS rp, sum(n) OVER w AS rn FROM p WINDOW w AS (ORDER BY t DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) SELECT min(t) FILTER (p > 0) AS drop_below, min(t) FILTER (rn >= 3 AND rp::DOUBLE / rn >= 0.86) AS keep_from FROM r")
def g17(s: SparkSession, d: str) -> DataFrame:
    return S.three_zones(V.scored(s, d), "t", "y", 0.86)


@query("g18_jaccard_scores", f"WITH {V.ART}, {V.REF}, {_OWN}, i AS (SELECT ref.id, own.work, count(*) AS k FROM ref JOIN own USING (ref) GROUP BY 1, 2), z AS (SELECT id, count(*) AS n FROM ref GROUP BY 1) SELECT i.id, round(max(k::DOUBLE / (a.n + b.n - k)), 6) AS score FROM i JOIN z a ON a.id = i.id JOIN z b ON b.id = i.work GROUP BY 1")
def g18(s: SparkSession, d: str) -> DataFrame:
    refs, o = V.references(s, d), own(s, d)
    size = refs.groupBy("id").agg(F.count("*").alias("n"))
    both = refs.join(o, "ref").groupBy("id", "work").agg(F.count("*").alias("k"))
    j = both.join(size, "id").join(size.select(F.col("id").alias("work"), F.col("n").alias("m")), "work")
    return j.groupBy("id").agg(R6(F.max(F.col("k") / (F.col("n") + F.col("m") - F.col("k"))), "score"))


@query("g18_tfidf_scores", r"""WITH t AS (SELECT doc_id AS id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]{2,}') AS w FROM documents), g AS (SELECT id, unnest(list_concat(w, list_transform(generate_series(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1]))) AS term FROM t),
n AS (SELECT id, term, 1 + ln(count(*)) AS w FROM g GROUP BY 1, 2), o AS (SELECT count(*) AS k FROM documents WHERE doc_id % 50 = 0), f AS (SELECT term, count(*) AS df FROM n WHERE id % 50 = 0 GROUP BY 1), v AS (SELECT term, ln((1 + k)::DOUBLE / (1 + df)) + 1 AS idf FROM f, o WHERE df <= 0.95 * k),
x AS (SELECT id, term, w * idf AS x FROM n JOIN v USING (term)), l AS (SELECT id, sqrt(sum(x * x)) AS m FROM x GROUP BY id), d AS (SELECT a.id, b.id AS near, sum(a.x * b.x) AS dot FROM x a JOIN x b ON a.term = b.term AND b.id % 50 = 0 GROUP BY 1, 2),
s AS (SELECT d.id, max(dot / (p.m * q.m)) AS score FROM d JOIN l p ON p.id = d.id JOIN l q ON q.id = near GROUP BY 1) SELECT doc_id, round(coalesce(score, 0), 6) AS score FROM documents LEFT JOIN s ON s.id = doc_id""")
def g18t(s: SparkSession, d: str) -> DataFrame:
    docs = T(s, d, "documents").select(F.col("doc_id").alias("id"), "text")
    scores = tfidf_similarity(docs, docs.where("id % 50 = 0"))  # the own works' texts, as authors whose number divides by 50 are own
    return scores.select(F.col("id").alias("doc_id"), R6("score", "score"))


@query("g19_embedding_features", f"WITH {_COS}, r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY sim DESC) AS r FROM cs) SELECT id, round(max(sim), 5) AS top, round(avg(sim), 5) AS mean, round(avg(sim) FILTER (r <= 5), 5) AS top_mean, count(*) FILTER (sim >= 0.2) AS above_20, count(*) FILTER (sim >= 0.6) AS above_60 FROM r GROUP BY 1")
def g19(s: SparkSession, d: str) -> DataFrame:
    f = S.similarity_features(*_emb(s, d), levels=(0.2, 0.6))
    return f.select("id", *[F.round(c, 5).alias(c) for c in ("top", "mean", "top_mean")], "above_20", "above_60")


@query("g19_kmeans_centroids")
def g19k(s: SparkSession, d: str) -> DataFrame:
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    x = T(s, d, "embeddings").select("vec_id", "embedding")
    own_x = x.where("vec_id % 40 = 3").select(array_to_vector(F.col("embedding")).alias("features"))
    model = KMeans(k=8, seed=42, maxIter=10).fit(own_x)
    f = S.centroid_features(x, "embedding", [c.tolist() for c in model.clusterCenters()])
    return f.select("vec_id", "cluster", R6(F.col("nearest"), "nearest"), R6(F.col("spread"), "spread"), "n_high")


@query("g20_cascade_overrides", f"""WITH {V.SCORED}, q AS (SELECT quantile_cont(s, 0.1) AS qs, quantile_cont(t, 0.1) AS qt FROM scored) SELECT id, CASE WHEN t >= 0.95 THEN 'lesenswert' WHEN z = 1 AND pred = 'ignorieren' THEN 'scannen' WHEN s <= qs AND t <= qt AND pred <> 'lesenswert' THEN 'ignorieren' ELSE pred END AS verdict FROM scored, q""")
def g20(s: SparkSession, d: str) -> DataFrame:
    x = V.scored(s, d)
    low = exact_quantiles(x, {"s": [0.1], "t": [0.1]})
    veto = (F.col("s") <= F.lit(low["s"][0])) & (F.col("t") <= F.lit(low["t"][0])) & (F.col("pred") != "lesenswert")
    v = F.when(F.col("t") >= 0.95, "lesenswert").when((F.col("z") == 1) & (F.col("pred") == "ignorieren"), "scannen").when(veto, "ignorieren").otherwise(F.col("pred"))
    return x.select("id", v.alias("verdict"))


@query("g21_log_damped_overlap", f"{BASE}, {_SIG} SELECT id, round(ln(1 + own_n), 6) AS damped FROM sig")
def g21(s: SparkSession, d: str) -> DataFrame:
    return signals(s, d).select("id", R6(F.log1p("own_n"), "damped"))


@query("g22_two_thresholds", f"WITH {V.SCORED} SELECT id, CASE WHEN t < 0.3 THEN 'ignorieren' WHEN t < 0.7 THEN 'scannen' ELSE 'lesenswert' END AS label FROM scored")
def g22(s: SparkSession, d: str) -> DataFrame:
    t = F.col("t")
    return V.scored(s, d).select("id", F.when(t < 0.3, "ignorieren").when(t < 0.7, "scannen").otherwise("lesenswert").alias("label"))


@query("g23_feature_extraction", f"""{BASE}, {_SIG}, rc AS (SELECT id, count(*) AS refs FROM ref GROUP BY 1), ac AS (SELECT author, count(*) AS arts FROM art GROUP BY 1) SELECT sig.id, round(own, 4) AS own, own_n, round(blind, 4) AS blind, coalesce(refs, 0) AS refs, arts, year - 1995 AS age, CAST(agent <> 'ignorieren' AS INT) AS keep FROM sig LEFT JOIN rc USING (id) JOIN ac USING (author)""")
def g23(s: SparkSession, d: str) -> DataFrame:
    rc = V.references(s, d).groupBy("id").agg(F.count("*").alias("refs"))
    x = signals(s, d)
    ac = V.articles(s, d).groupBy("author").agg(F.count("*").alias("arts"))
    return x.join(rc, "id", "left").join(ac, "author").select("id", F.round("own", 4).alias("own"), "own_n", F.round("blind", 4).alias("blind"), F.coalesce("refs", F.lit(0)).alias("refs"), "arts", (F.col("year") - 1995).alias("age"), (F.col("agent") != "ignorieren").cast("int").alias("keep"))


@query("g24_verbatim_gate", r"""WITH x AS (SELECT doc_id, text, substr(text, 5, 30) || ' ... ' || CASE WHEN doc_id % 2 = 0 THEN 'never said any of this' ELSE substr(text, 50, 25) END AS q FROM documents), p AS (SELECT doc_id, text, list_filter(regexp_split_to_array(q, '\s*(?:\[\.\.\.\]|…|\.\.\.)\s*'), lambda p: length(p) >= 12) AS ps FROM x),
s AS (SELECT doc_id, list_sum(list_transform(ps, lambda p: length(p))) AS t, coalesce(list_sum(list_transform(list_filter(ps, lambda p: contains(text, p)), lambda p: length(p))), 0) AS h FROM p)
SELECT doc_id, round(CASE WHEN t > 0 THEN h::DOUBLE / t ELSE 1 END, 6) AS share, CASE WHEN t > 0 THEN h::DOUBLE / t ELSE 1 END >= 0.6 AS passes FROM s""")
def g24(s: SparkSession, d: str) -> DataFrame:
    quote = F.concat(F.substring("text", 5, 30), F.lit(" ... "), F.when(F.col("doc_id") % 2 == 0, "never said any of this").otherwise(F.substring("text", 50, 25)))
    share = S.verbatim_share(quote, F.col("text"))
    return T(s, d, "documents").select("doc_id", share.alias("x")).select("doc_id", R6(F.col("x"), "share"), (F.col("x") >= 0.6).alias("passes"))


@query("g25_rank_percentile", f"WITH {V.SCORED}, r AS (SELECT grp, (rank() OVER (ORDER BY s) - 1)::DOUBLE / count(*) OVER () AS p FROM scored) SELECT grp, round(avg(p), 6) AS pct FROM r GROUP BY 1")
def g25(s: SparkSession, d: str) -> DataFrame:
    return S.percentile_rank(V.scored(s, d), "s").groupBy("grp").agg(R6(F.avg("pct"), "pct"))


@query("g26_two_path_balance", f"""WITH {V.SCORED}, p AS (SELECT *, CASE WHEN id % 5 = 0 THEN 'b' ELSE 'a' END AS path FROM scored), r AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY s DESC, id) AS r, count(*) OVER (PARTITION BY path) AS n FROM p)
SELECT path, count(*) AS n, CAST(sum(y) FILTER (path = 'b' OR r <= floor(n * 0.3)) AS BIGINT) AS caught FROM r GROUP BY 1""")
def g26(s: SparkSession, d: str) -> DataFrame:
    p = V.scored(s, d).withColumn("path", F.when(F.col("id") % 5 == 0, "b").otherwise("a"))
    per = p.where("path = 'a'").groupBy("s").agg(F.count("*").alias("k"))
    above = running(per, -F.col("s"), {"above": "k"}).select("s", "above")
    n = p.groupBy("path").agg(F.count("*").alias("n"))
    r = p.where("path = 'a'").join(above, "s").withColumn("r", F.col("above") + F.row_number().over(Window.partitionBy("s").orderBy("id")))
    best = r.join(n, "path").where(F.col("r") <= F.floor(F.col("n") * 0.3)).groupBy("path").agg(F.sum("y").alias("caught"))
    caught = best.unionByName(p.where("path = 'b'").groupBy("path").agg(F.sum("y").alias("caught")))
    return n.join(caught, "path", "left").select("path", "n", F.col("caught").cast("long").alias("caught"))


CONTEXT = """## Fokus
- the education of there
## Schlüsselbegriffe
- than that which; learning
- other
## Something else
- never taken
## Empirischer/methodischer Kontext
- methods between them
"""
STOP = {"which", "there", "that", "the", "and"}


QUESTIONS = [(1, "A methodological question of 2020: education", CONTEXT), (2, "Kritik of THAT: them_other", CONTEXT), (3, "the education", None)]
# what the plans of these questions come to
_PLANNED = "(1, 'methods', ['methods', 'between', 'them', 'than', 'other', 'methodological', 'question', 'learning', 'education']), (2, 'counter', ['education', 'than', 'learning', 'other', 'kritik', 'them']), (3, 'general', ['education'])"


@query("g27_search_plan", f"""WITH p(question_id, intent, terms) AS (VALUES {_PLANNED}), t AS (SELECT question_id, intent, unnest(terms) AS term FROM p)
SELECT question_id, intent, lang, count(DISTINCT doc_id) AS n FROM t JOIN documents ON contains(lower(text), term) GROUP BY ALL""")
def g27(s: SparkSession, d: str) -> DataFrame:
    """Documents, by language, that hold a term of a question's plan; the plans are a table like the documents."""
    plans = S.search_plans(s.createDataFrame(QUESTIONS, "question_id int, question string, context string"), STOP, set(Q.GENERIC_TERMS)).select("question_id", "intent", F.explode("terms").alias("term"))
    hits = terms_in(T(s, d, "documents").select("doc_id", "lang", F.lower("text").alias("text")), "text", plans)
    return hits.select("doc_id", "lang", F.explode("_terms").alias("term")).join(plans, "term").groupBy("question_id", "intent", "lang").agg(F.countDistinct("doc_id").alias("n"))


@query("g28_graph_parser", f"""WITH {V.WORK}, w AS (SELECT *, ref % 3 = 0 AS stated, CASE ref % 2 WHEN 0 THEN 'extends' ELSE 'rejects' END AS rel, CASE ref % 2 WHEN 0 THEN '+' ELSE '-' END AS sign FROM work)
SELECT ref, 'node' AS kind, 'position:self' AS name, 'position' AS type, CASE WHEN stated THEN 'to care' ELSE '(Selbstposition nicht explizit)' END AS label, NULL AS source, NULL AS target, NULL AS sigma, CASE WHEN stated THEN 'a quote' END AS quote, NULL AS address FROM w
UNION ALL SELECT ref, 'node', 'source:' || title, 'source', title, NULL, NULL, NULL, NULL, 'p. 3' FROM w
UNION ALL SELECT ref, 'edge', rel, NULL, NULL, 'position:self', 'source:' || title, sign, NULL, 'p. 3' FROM w
UNION ALL SELECT ref, 'unparsed', NULL, NULL, unnest(['Preface', 'QUELLE: Nobody | RELATION: unclear']), NULL, NULL, NULL, NULL, NULL FROM w
UNION ALL SELECT ref, 'node', 'term:' || topic, 'term', topic, NULL, NULL, NULL, NULL, NULL FROM w
UNION ALL SELECT ref, 'edge', 'coins', NULL, NULL, 'source:' || title, 'term:' || topic, NULL, NULL, NULL FROM w
UNION ALL SELECT ref, 'node', 'term:glue', 'term', 'glue', NULL, NULL, NULL, NULL, NULL FROM w
UNION ALL SELECT ref, 'edge', 'coins', NULL, NULL, 'position:self', 'term:glue', NULL, NULL, NULL FROM w
UNION ALL SELECT ref, 'node', 'own:0', 'source', brand, NULL, NULL, NULL, NULL, NULL FROM w
UNION ALL SELECT ref, 'edge', 'trajectory', NULL, NULL, 'position:self', 'own:0', NULL, NULL, NULL FROM w""")
def g28(s: SparkSession, d: str) -> DataFrame:
    even = F.col("ref") % 2 == 0
    stated = F.when(F.col("ref") % 3 == 0, "ZIEL: to care | BELEG: «a quote»\n").otherwise("")
    relation = F.when(even, "**extends** (rather than rejects)").otherwise("rejects, not affirms")
    text = F.concat(
        F.lit("Preface\n[SELBSTPOSITION]\n"), stated, F.lit("**[QUELLEN]**\n- QUELLE: "), "title", F.lit(" | RELATION: "), relation, F.lit(" | ADRESSE: p. 3\nQUELLE: Nobody | RELATION: unclear\n—\n[BEGRIFFE]\nBEGRIFF: "), "topic", F.lit(" | HERKUNFT: after "), F.upper("title"),
        F.lit("\nBEGRIFF: glue | HERKUNFT: eigene Arbeit\n[TRAJEKTORIE]\nSELBSTBEZUG: "), "brand",
    )
    return parse_profiles(V.works(s, d).select("ref", text.alias("t")), "ref", "t").drop("density")


@query("g29_jaccard_coupling", f"WITH {V.ART}, {V.REF}, {_OWN}, o AS (SELECT DISTINCT ref FROM own), g AS (SELECT id, count(*) AS n, count(o.ref) AS k FROM ref LEFT JOIN o USING (ref) GROUP BY 1) SELECT id, round(k::DOUBLE / (n + (SELECT count(*) FROM o) - k), 6) AS jaccard, round(ln(1 + k), 6) AS damped FROM g")
def g29(s: SparkSession, d: str) -> DataFrame:
    o = own(s, d).select("ref").distinct()
    total = o.agg(F.count("*").alias("m"))
    g = V.references(s, d).join(o.withColumn("y", F.lit(1)), "ref", "left").groupBy("id").agg(F.count("*").alias("n"), F.count("y").alias("k")).crossJoin(F.broadcast(total))
    return g.select("id", R6(F.col("k") / (F.col("n") + F.col("m") - F.col("k")), "jaccard"), R6(F.log1p("k"), "damped"))


_PROFILE = [("red gears", 2.0), ("small bolts", 1.0), ("blue ring", 1.0)]


@query("f27_profile_fit")
def f27(s: SparkSession, d: str) -> DataFrame:
    src = V.works(s, d).select(F.col("brand").alias("source"), F.col("title").alias("topic")).distinct()
    return S.profile_fit(src, _PROFILE)


@query("f28_query_routing")
def f28(s: SparkSession, d: str) -> DataFrame:
    src = V.works(s, d).select(F.col("brand").alias("source"), F.col("title").alias("topic")).distinct()
    fit = S.profile_fit(src, _PROFILE)
    share = V.works(s, d).groupBy(F.col("brand").alias("source")).agg((100 * F.avg((F.col("topic") == "ECONOMY").cast("int"))).alias("cluster"), F.avg("size").alias("prior"))
    return fit.join(share, "source").select("source", S.route(F.col("fit"), F.col("cluster"), F.col("prior")).alias("r")).select("source", "r.score", "r.depth")
