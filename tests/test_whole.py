"""Queries that must take in whole tables and texts, on hand-made cases."""

import pytest

from citemill.plans import registry

QUERIES = registry.queries()

def test_words_far_into_a_text(spark, tmp_path):
    text = ". " * 400 + "Änderung großer Other Things mattered"
    spark.createDataFrame([(1, text)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {name: QUERIES[name](spark, str(tmp_path)).first().asDict() for name in ("c05_title_key", "c09_text_fold", "c15_abstract_rebuild", "d08_key_term_hits")}
    assert got["c05_title_key"]["title_key"] == "änderung großer other things"
    assert got["c09_text_fold"] == {"doc_id": 1, "spelled": "aenderung grosser other things mattered", "bare": "anderung grosser other things mattered"}
    assert got["c15_abstract_rebuild"]["abstract"] == text
    assert got["d08_key_term_hits"]["hits"] == "other,thing"


def test_coupling_over_works_of_31_to_50_articles(spark, tmp_path, monkeypatch):
    from citemill.plans import analytics_queries

    refs = spark.createDataFrame([(i, r) for r, n in ((1, 40), (2, 50), (3, 51)) for i in range(n)], "id long, ref long")
    monkeypatch.setattr(analytics_queries.V, "references", lambda s, d: refs)
    edges = analytics_queries.edges(spark, str(tmp_path)).collect()
    assert len(edges) == 40 * 39 // 2 and {e.shared for e in edges} == {2}
    assert len({r.community for r in QUERIES["f05_communities"](spark, str(tmp_path)).collect()}) == 1


def test_rare_trends_and_dropped_works(spark, tmp_path, monkeypatch):
    from citemill.plans import analytics_queries

    cites = [(3, 1990, 4), (3, 1991, 2), (3, 1992, 1), (6, 1990, 3), (9, 1990, 1), (9, 1991, 1), (9, 1993, 4), (12, 1990, 1), (12, 1991, 5), (12, 1993, 1)]
    rows = spark.createDataFrame([(ref, year, i) for ref, year, n in cites for i in range(n)], "ref long, year int, id long")
    monkeypatch.setattr(analytics_queries, "art_refs", lambda s, d: rows)
    trends = {r.ref: r.trend for r in QUERIES["f02_trend_label"](spark, str(tmp_path)).collect()}
    assert trends == {3: "falling", 6: "only 1990", 9: "rising", 12: "peak 1991"}
    blocks = sorted(map(tuple, QUERIES["f31_period_blocks"](spark, str(tmp_path)).select("period", "n", "new", "dropped").collect()))
    assert blocks == [(0, 4, None, None), (1, 3, 0, 1)]


def test_tfidf_is_the_cosine_to_own_texts(spark, tmp_path):
    import math
    import re
    from collections import Counter

    texts = {0: "alpha beta gamma alpha", 50: "the delta beta epsilon", 100: "the zeta", 1: "alpha beta", 2: "nothing known", 3: "x " * 2500 + "delta beta epsilon epsilon", 4: "", 5: None}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.score for r in QUERIES["g18_tfidf_scores"](spark, str(tmp_path)).collect()}

    def count(t):
        w = re.findall(r"\w{2,}", (t or "").lower())
        return Counter(w + [f"{a} {b}" for a, b in zip(w, w[1:])])

    own = [count(texts[i]) for i in (0, 50, 100)]
    df = Counter(g for c in own for g in c)

    def vector(c):
        v = {g: (1 + math.log(n)) * (math.log(4 / (1 + df[g])) + 1) for g, n in c.items() if 0 < df[g] <= 0.95 * 3}
        m = math.sqrt(sum(x * x for x in v.values())) or 1
        return {g: x / m for g, x in v.items()}

    want = {i: max(sum(x * o.get(g, 0) for g, x in vector(count(t)).items()) for o in map(vector, own)) for i, t in texts.items()}
    assert got == pytest.approx(want, abs=1e-6)
    assert got[3] > 0.5 and got[2] == got[4] == got[5] == 0


@pytest.mark.parametrize("broadcast", [True, False])
def test_every_source_is_scored_for_every_wanted_name(spark, tmp_path, broadcast):
    """As many rows as parts times different types, and equal to the SQL on nulls, empty names and types in two spellings."""
    from tests.oracle import assert_same, connect

    rows = [
        (0, "cold gear", "Brand#3", "PROMO"), (1, "cold gear", "Brand#1", "promo"), (2, "", "Brand#25", "LARGE PROMO"), (50, "promo ring", "Brand#2", ""), (100, None, "Brand#4", "Größe"),
        (101, None, None, "Größe"), (102, "cold gear", None, None), (103, "x", "Brand#9", "GE"), (None, "ring", "Brand#9", "LARGE"), (150, "a\u0301bc cold", "Brand#1", "a\u0301bcd"), (150, "a\u0301bc cold", "Brand#1", "a\u0301bcd"),
    ]
    spark.createDataFrame([(*r, 1, 1.0) for r in rows], "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double").write.parquet(f"{tmp_path}/part.parquet")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before if broadcast else "-1")
    try:
        df = QUERIES["e13_source_scoring"](spark, str(tmp_path))
        assert df.count() == len(rows) * len({r[3] and r[3].lower() for r in rows})
        assert_same(df, connect(tmp_path), registry.oracle_sql()["e13_source_scoring"])
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
