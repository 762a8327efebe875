"""Invariants of the operators on small inputs made by hand."""

import json
import math
import random
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F

from citemill.functions import text as X
from citemill.operators import analytics, coupling, graphs, merging, metrics, parsing, routing, scoring, search
from citemill.operators.ordered import running
from citemill.sources import readers


def rows(df):
    return [tuple(r) for r in df.collect()]


def one(spark, expr, **cols):
    schema = ", ".join(f"{k} string" for k in cols)
    return spark.createDataFrame([tuple(cols.values())], schema).select(expr).first()[0]


def test_composition_change_is_no_trend(spark):
    data = []

    def add(journal, year, counts):
        for topic, n in counts.items():
            data.extend((f"{journal}{year}{topic}{i}", journal, year, topic) for i in range(n))

    add("AIJ", 2016, {"T": 5})
    add("AIJ", 2022, {"T": 40})
    for j, early, late in (("J1", (1, 9), (8, 2)), ("J2", (2, 8), (9, 1)), ("J3", (0, 8), (0, 8)), ("J4", (0, 2), (10, 0))):
        add(j, 2016, {"U": early[0], "F": early[1]})
        add(j, 2022, {"U": late[0], "F": late[1]})
    df = spark.createDataFrame(data, "id string, journal string, year int, topic string")
    out = {r.topic: r for r in analytics.trajectories(df, (2016, 2017), (2022, 2023), 5, 2, 4).collect()}
    assert out["T"].within == pytest.approx(0) and out["T"].pooled == pytest.approx(40 / 68 - 5 / 33)
    assert out["U"].within == pytest.approx(0.35)


def test_coupling_groups_separate(spark):
    data = []
    for i in range(6):
        data += [(i, r) for r in ("A1", "A2", "A3", "U", f"a{i}")]
        data += [(10 + i, r) for r in ("B1", "B2", "B3", "U", f"b{i}")]
    data += [(20, "A1"), (20, "c1"), (20, "c2")]
    refs = spark.createDataFrame(data, "id long, ref string")
    edges = coupling.coupling_edges(refs, 2, 6, 2)
    got = edges.collect()
    assert len(got) == 30 and all(r.shared in (2, 3) for r in got)
    assert {round(r.weight, 6) for r in got} == {round(2 * math.log(13 / 6), 6), round(3 * math.log(13 / 6), 6)}
    for most in (graphs.TASK_EDGES, 1):  # in one place, and by rounds of joins
        groups = {}
        for r in graphs.communities(edges, most_edges=most).collect():
            groups.setdefault(r.community, set()).add(r.id)
        assert sorted(map(sorted, groups.values())) == [list(range(6)), list(range(10, 16))]
    assert graphs.communities(edges.where("false")).count() == 0


def test_one_shared_reference_makes_no_edge(spark):
    refs = spark.createDataFrame([(1, "x"), (2, "x"), (1, "y")], "id long, ref string")
    assert coupling.coupling_edges(refs, 2, 9, 2).count() == 0


def test_set_difference(spark):
    trig = spark.createDataFrame([("p", "a1"), ("p", "s"), ("q", "a2"), ("q", "s"), ("r", "a3")], "author string, ref string")
    own = spark.createDataFrame([("s",), ("b1",)], "ref string")
    assert sorted(rows(coupling.set_difference(trig, own))) == [("a1", 1), ("a2", 1), ("a3", 1)]


def test_cache_rate_is_weighted_by_tokens(spark):
    calls = spark.createDataFrame([("e", "m", 100, 100, 0.1, "ok"), ("e", "m", 10000, 0, 0.1, None), ("e", "m", 5, 500, 0.1, "error")], "endpoint string, model string, tokens_in long, tokens_cached long, cost double, status string")
    r = analytics.cache_hits(calls, ["e"], least=1).first()
    assert r.hit_rate == pytest.approx(100 / 10200, abs=1e-6) and r.warning


def test_whole_word_search(spark):
    df = spark.createDataFrame([("Art of war", ""), ("Party startup", ""), ("C++ and more", "art"), ("", None)], "title string, abstract string")
    blob = search.blob(["title", "abstract"])
    assert df.where(search.matches(blob, "art")).count() == 2
    assert df.where(search.matches(blob, "C++ art")).count() == 1
    assert df.where(search.matches(blob, '"of war"')).count() == 1
    with pytest.raises(search.SearchError):
        search.matches(blob, "(", regex=True)


def test_votes(spark):
    v = spark.createDataFrame([(1, "lesenswert"), (1, "ignorieren"), (2, "ignorieren"), (2, "ignorieren"), (3, "scannen"), (4, None)], "id long, v string")
    out = {r[0]: tuple(r)[1:] for r in scoring.combine_votes(v, "id", "v").collect()}
    assert out == {1: (True, 2, False, "lesenswert"), 2: (False, 2, False, "ignorieren"), 3: (True, 1, True, "scannen"), 4: (True, 0, True, "scannen")}


def test_prior_shrinks(spark):
    data = [("A", 1)] * 2 + [("B", 0)] * 8
    out = {r.g_: r.prior for r in scoring.eb_prior(spark.createDataFrame(data, "g_ string, y int"), "g_", "y").collect()}
    assert out == {"A": pytest.approx(3 / 7), "B": pytest.approx(1 / 13)}


def test_auc_and_classes(spark):
    df = spark.createDataFrame([(0.9, 1), (0.5, 1), (0.5, 0), (0.1, 0)], "s double, y int")
    assert metrics.auc(df, "s", "y").first().auc == pytest.approx(0.875)
    lab = spark.createDataFrame([("a", "a"), ("a", "b"), ("c", "c")], "g string, p string")
    out = {r.label: r.f1 for r in metrics.per_class(lab, "g", "p", ["a", "b", "c"]).collect()}
    assert out == {"a": pytest.approx(2 / 3), "b": 0.0, "c": 1.0}


def test_empty_metrics(spark):
    df = spark.createDataFrame([], "s double, y int")
    assert metrics.auc(df, "s", "y").first().auc is None


def test_identifiers(spark):
    assert one(spark, X.doi_full(F.col("a")), a=" HTTPS://dx.doi.org/10.1/AB.) ") == "10.1/ab"
    assert one(spark, X.doi_full(F.col("a")), a=None) == ""
    assert one(spark, X.surname_key(F.col("a")), a="Smith, J.") == "smith"
    assert one(spark, X.surname_key(F.col("a")), a="J. Smith; Other") == "smith"
    assert one(spark, X.title_key(F.col("a")), a="The Making of a New World in Art") == "making new world art"
    assert one(spark, X.fold(F.col("a")), a="Größe & Café") == "groesse cafe"
    assert one(spark, merging.canonical_id(F.lit(None).cast("string"), F.col("a"), F.lit(2000), F.lit("X, Y")), a="T") == one(spark, merging.canonical_id(F.lit(""), F.col("a"), F.lit(2000), F.lit("X")), a="t!")


def test_citations(spark):
    r = one(spark, X.parsed_citation(F.col("a")), a="Barad, K. (2007). Meeting the universe half- way. Duke University Press.")
    assert (r.author, r.year, r.title) == ("Barad", 2007, "Meeting the universe halfway. Duke")
    assert one(spark, X.parsed_citation(F.col("a")), a="too short (2007)") is None
    text = "Smith, J. (2000) One long title\n  that goes on here\nJones, K. (2001) Another title\n\nshort"
    df = spark.createDataFrame([(1, text)], "id long, t string")
    assert sorted(r.citation for r in parsing.split_citations(df, "id", "t").collect()) == ["Jones, K. (2001) Another title", "Smith, J. (2000) One long title that goes on here"]


def test_repair(spark):
    raw = [(1, '{"refs": ["a "b" c"], "core": "x"}'), (2, '{"refs": "p; q", "summary": "s"}'), (3, "{"), (4, None)]
    out = {r.id: (r.refs, r.core, r.repair) for r in parsing.repair_entries(spark.createDataFrame(raw, "id long, raw string"), "raw").collect()}
    assert out[1] == (['a "b" c'], "x", "quotes") and out[2] == (["p", "q"], "s", "split") and out[3][2] == out[4][2] == "unparsable"


def test_upsert_keeps_analysis(spark):
    old = spark.createDataFrame([(1, "a", "v"), (2, "b", "w")], "id long, t string, verdict string")
    new = spark.createDataFrame([(2, " "), (3, "c")], "id long, t string")
    out = merging.upsert(old, new, "id", {"t": "prefer_text", "verdict": "keep"})
    assert sorted(rows(out)) == [(1, "a", "v"), (2, "b", "w"), (3, "c", None)]
    again = merging.upsert(out, new, "id", {"t": "prefer_text", "verdict": "keep"})
    assert sorted(rows(again)) == sorted(rows(out))


def test_scraper(spark):
    html = "<div class='it'><h2>A <b>title</b></h2><a class=l href='/x'>go</a><p>Ada One, Bo Two and Cy</p></div><div class=it></div>"
    df = spark.createDataFrame([("http://h/p", html), ("http://h/q", None)], "u string, h string")
    out = readers.scrape(df, "u", "h", {"container": "div.it", "title": "h1, h2", "link": "a.l@href", "authors": "p"})
    assert rows(out.select("title", "url", "authors")) == [("A title", "http://h/x", ["Ada One", "Bo Two"])]
    with pytest.raises(ValueError):
        readers.check_config({"title": "h1"})
    with pytest.raises(ValueError):
        readers.reader_for({"type": "fax"})


def test_cascade_order(spark):
    df = spark.createDataFrame([(1,), (6,), (5,)], "x int")
    out = routing.cascade(df, [("even", F.col("x") % 2 == 0), ("big", F.col("x") > 4)], "rest")
    assert sorted(rows(out)) == [(1, "rest"), (5, "big"), (6, "even")]


def test_nulls_and_empty_tables(spark):
    none = spark.createDataFrame([], "ref long, id long, author long")
    assert analytics.cited_works(none, 3, 0.5).count() == 0
    assert coupling.coupling_edges(none.select("id", "ref"), 2, 5, 2).count() == 0
    df = spark.createDataFrame([(None,), ("",)], "t string")
    assert df.select(X.tokens(F.col("t")), X.dois_in(F.col("t")), X.strip_tags(F.col("t")), X.head_and_tail(F.col("t"), 5)).count() == 2


def test_communities_by_rounds_are_about_as_good(spark):
    """Planted groups with noise: modularity of the joined rounds against that of moving one node at a time."""
    rng = random.Random(3)
    data = [(a, b, 1.0 + rng.random()) for a in range(120) for b in range(a + 1, 120) if rng.random() < (0.5 if a // 20 == b // 20 else 0.02)]
    edges = spark.createDataFrame(data, "a long, b long, weight double")

    def quality(most):
        of = {r.id: r.community for r in graphs.communities(edges, most_edges=most).collect()}
        total, deg = 2 * sum(w for *_, w in data), {}
        for a, b, w in data:
            deg[a], deg[b] = deg.get(a, 0) + w, deg.get(b, 0) + w
        within = {}
        for v, c in of.items():
            within[c] = within.get(c, 0) + deg[v]
        return 2 * sum(w for a, b, w in data if of[a] == of[b]) / total - sum(x * x for x in within.values()) / total**2

    assert quality(1) > 0.97 * quality(graphs.TASK_EDGES) > 0.5


def test_components_and_connected_communities(spark):
    """Roots of chains, rings and stars; each community holds together inside, by tasks and by rounds of joins."""
    rng = random.Random(5)
    chain, star = [(i, i + 1) for i in range(100, 160)], [(200, i) for i in range(201, 240)]
    noise = [(rng.randrange(300, 420), rng.randrange(300, 420)) for _ in range(110)]
    data = sorted({(min(e), max(e)) for e in [*chain, *star, *noise] if e[0] != e[1]})
    near = {}
    for a, b in data:
        near.setdefault(a, set()).add(b), near.setdefault(b, set()).add(a)

    def reach(v, within):
        seen, todo = {v}, [v]
        while todo:
            new = (near[todo.pop()] & within) - seen
            seen |= new
            todo += new
        return seen

    edges = spark.createDataFrame([(*e, rng.random()) for e in data], "a long, b long, weight double")
    cut = graphs._Cuts(spark)
    roots = {r.v: r.root for r in graphs.components(edges, cut).collect()}
    cut.close()
    assert roots == {v: min(reach(v, set(near))) for v in near}
    for most in (graphs.TASK_EDGES, 20):
        groups = {}
        for r in graphs.communities(edges, most_edges=most).collect():
            groups.setdefault(r.community, set()).add(r.id)
        assert set().union(*groups.values()) == set(near)
        assert all(reach(min(g), g) == g for g in groups.values())
        assert [len(groups[c]) for c in sorted(groups)] == sorted(map(len, groups.values()), reverse=True)


def test_running_sums(spark):
    rng = random.Random(4)
    data = [(g, x, rng.randrange(9)) for g in "ab" for x in rng.sample(range(5000), 700)]
    df = spark.createDataFrame(data, "g string, x long, n long")
    got = {(r.g, r.x): r.before for r in running(df, -F.col("x"), {"before": "n"}, ["g"]).collect()}
    assert got == {(g, x): sum(n for h, y, n in data if h == g and y > x) for g, x, _ in data}
    assert running(df.where("false"), F.col("x"), {"before": "n"}).count() == 0


def test_folds_are_stratified_and_unseen(spark):
    data = [(i, f"g{i % 7}", int(i % 4 == 0)) for i in range(203)] + [(500, "alone", 1)]
    rows_ = metrics.out_of_fold_prior(metrics.folds(spark.createDataFrame(data, "id long, grp string, y int"), "id", "y"), "grp", "y").collect()
    assert len(rows_) == len(data)
    for y in (0, 1):
        sizes = [sum(r.fold == f and r.y == y for r in rows_) for f in range(5)]
        assert max(sizes) - min(sizes) <= 1
    for r in rows_:
        rest = [x for x in rows_ if x.fold != r.fold]
        rate = sum(x.y for x in rest) / len(rest)
        own = [x.y for x in rest if x.grp == r.grp]
        assert r.oof == pytest.approx((sum(own) + 5 * rate) / (len(own) + 5))


def test_chance_baselines(spark):
    df = spark.createDataFrame([("a",)] * 600 + [("b",)] * 300 + [("c",)] * 100, "g string")
    for uniform, p in ((False, (0.6, 0.3, 0.1)), (True, (1 / 3,) * 3)):
        want = sum(2 * n * q / (n + 1000 * q) for n, q in zip((600, 300, 100), p, strict=True)) / 3
        assert metrics.random_baseline(df, "g", ["a", "b", "c"], 400, 42, uniform).first()[0] == pytest.approx(want, abs=0.004)


def test_isotonic_pools_adjacent_violators(spark):
    df = spark.createDataFrame([(i, float(i), y) for i, y in enumerate([0, 0, 1, 0, 1, 1, 0, 1])], "id int, s double, y int")
    got = [r.calibrated for r in metrics.isotonic(df, "s", "y").orderBy("id").collect()]
    assert got == pytest.approx([0, 0, 0.5, 0.5, 2 / 3, 2 / 3, 2 / 3, 1])


def test_platt_fit(spark):
    """At the maximum of the likelihood, residuals sum to nothing and don't lean on the margin."""
    rng = random.Random(1)
    data = [(m := rng.uniform(-3, 3), int(rng.random() < 1 / (1 + math.exp(-(1.4 * m - 0.5))))) for _ in range(1500)]
    a, b = scoring.platt(spark.createDataFrame(data, "m double, y int"), "m", "y")
    rest = [y - 1 / (1 + math.exp(-(a * m + b))) for m, y in data]
    assert abs(sum(rest)) < 0.1 and abs(sum(r * m for r, (m, _) in zip(rest, data, strict=True))) < 0.1 and 1.1 < a < 1.7


def test_search_plans(spark):
    """Several questions at once: sections by intent and quota, special words before general ones, thin parts filled up."""
    stop, generic = {"the", "and", "von"}, set(search.GENERIC_TERMS)
    context = "## Fokus\n- post-digital practices\n## Schlüsselbegriffe\n- glitch art\n- x\n## Unknown\n- hidden\n## Offene  Anschlussstellen\n- missing bodies\n"
    rows = [(1, "Which criticism: counter 2020 positions?", context), (2, "Welche Artikel sind da?", None), (3, "zzz", ""), (4, "digital art", None), (5, None, None)]
    plans = {r.question_id: r for r in scoring.search_plans(spark.createDataFrame(rows, "question_id int, question string, context string"), stop, generic).collect()}
    assert (plans[1].intent, plans[1].phrases) == ("counter", ["post-digital practices", "missing bodies", "glitch art"])
    assert plans[1].terms == ["post", "practices", "missing", "bodies", "glitch", "which", "criticism", "counter", "positions", "digital", "art"]
    assert [plans[i].intent for i in (2, 3, 4, 5)] == ["relevant", "general", "general", "general"]
    assert plans[4].terms == ["digital", "art"] and plans[5].terms == [] and plans[5].phrases == []
    many = " ".join(f"term{chr(97 + i)}" for i in range(12)) + " art culture media"
    units = scoring.argument_plans(spark.createDataFrame([(1, "Glitch bodies", context), (2, many, context), (3, None, None)], "unit_id int, unit string, context string"), stop, generic)
    units = {r.unit_id: r for r in units.collect()}
    assert units[1].terms == ["glitch", "bodies", "missing", "art"] and units[1].phrases == ["Glitch bodies"]
    assert units[2].terms == [f"term{chr(97 + i)}" for i in range(8)] + ["art", "culture"]
    assert units[3].terms == [] and units[3].phrases == []


def test_titles_of_citations_word_by_word(spark):
    cases = {
        "Smith, J. (2001). Old tools, new: uses. Taylor & Francis, 50(10), 893-899.": "Old tools new uses",
        "Smith (1999b) Tools. Cambridge: University Press. doi:10.1/x-y": "Tools",
        "Lee 2010 Walls, Vol. 3, p. 12, ISBN 978-3-16-1": "Walls",
        "Lee 2010 Press freedom": "freedom",
        "no year here": "no year here",
        "(2000)": "",
    }
    df = spark.createDataFrame([(k,) for k in cases], "t string").select("t", X.title_of_citation(F.col("t")).alias("x"))
    assert {r.t: r.x for r in df.collect()} == cases
    venues = {
        "Barad, K. (2007). Meeting halves. In: Some Book, Duke.": "Meeting halves",
        "Barad, K. (2007). Wissen. Koennen. Bielefeld: Transcript.": "Wissen. Koennen",
        "Barad, K. (2007). Things (Eds.) of many kinds": "Things",
        "Barad, K. (2007). Journal of things, 3(1), 4-9.": "Journal of things",
    }
    df = spark.createDataFrame([(k,) for k in venues], "t string").select("t", X.parsed_citation(F.col("t"))["title"].alias("x"))
    assert {r.t: r.x for r in df.collect()} == venues


def test_greedy_motifs(spark):
    df = spark.createDataFrame([("a", "b", 9.0), ("b", "a", 8.0), ("b", None, 7.5), ("c", None, 7.0), ("c", "d", 6.0), ("e", "a", 5.0), ("f", None, 4.0), ("g", None, 3.0)], "token string, mate string, score double")
    assert analytics.greedy_motifs(df) == ["a b", "c", "a e", "f"]


def test_profile_fit_and_route(spark):
    src = spark.createDataFrame([("s", "red gears"), ("s", "x"), ("t", "unlike")], "source string, topic string")
    fit = {r.source: (r.fit, r.tier) for r in scoring.profile_fit(src, [("red gears", 3.0), ("blue ring", 1.0)]).collect()}
    assert fit["s"] == (75.0, "A") and fit["t"][1] == "C"
    r = spark.range(1).select(scoring.route(F.lit(80.0), F.lit(50.0), F.lit(200.0)).alias("r"), scoring.route(F.lit(10.0), F.lit(20.0), F.lit(10.0)).alias("q")).first()
    assert (r.r.score, r.r.depth, r.q.score, r.q.depth) == (86.0, "deep", 12.0, "medium")


def test_similarity_by_blocks(spark, monkeypatch):
    rng = random.Random(2)
    vec = lambda: [rng.gauss(0, 1) for _ in range(5)]
    a, b = [(i, vec(), f"t{i % 4}") for i in range(60)], [(100 + i, vec(), f"t{i % 4}") for i in range(30)] + [(99, [0.0] * 5, "z")]
    cos = lambda x, y: sum(p * q for p, q in zip(x, y, strict=True)) / max(math.hypot(*x) * math.hypot(*y), 1e-12)
    rows_, own = spark.createDataFrame(a, "id long, v array<double>, title string"), spark.createDataFrame(b, "near long, u array<double>, near_title string").repartition(3)
    want = {i: sorted((-round(cos(v, u), 6), n) for n, u, name in b if name != t)[:3] for i, v, t in a}
    got = {}
    for r in scoring.nearest(rows_, own, 3).orderBy("id", "rank").collect():
        got.setdefault(r.id, []).append((-round(r.sim, 6), r.near))
    assert got == want
    f = {r.id: r for r in scoring.similarity_features(rows_, own, (0.2,)).collect()}
    for i, v, _ in a:
        sims = sorted((cos(v, u) for _, u, _ in b), reverse=True)
        assert (f[i].top, f[i].mean, f[i].top_mean) == pytest.approx((sims[0], sum(sims) / 31, sum(sims[:5]) / 5)) and f[i].above_20 == sum(x >= 0.2 for x in sims)


def test_centroid_features(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 1.0]), (3, [0.0, 2.0])], "id int, v array<double>")
    got = {r.id: (round(r.nearest, 6), round(r.spread, 6), r.cluster, r.n_high) for r in scoring.centroid_features(df, "v", [[2.0, 0.0], [0.0, 1.0]]).collect()}
    assert got == {1: (1.0, 1.0, 0, 1), 2: (0.707107, 0.0, 0, 2), 3: (1.0, 1.0, 1, 1)}


def test_archives_hold_raw_columns_only(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", "v", 2.0), (None, "b", "v", 1.0), (3, None, None, None)], "id long, title string, verdict string, cost double").repartition(2)
    made = readers.export_archive(df, f"file://{tmp_path}/out")
    assert sum(r["count"] for r in made.collect()) == 3
    for r in made.collect():
        with zipfile.ZipFile(r.path.removeprefix("file://")) as z:
            assert sorted(z.namelist()) == ["articles.jsonl", "manifest.json"]
            assert json.loads(z.read("manifest.json"))["article_count"] == r["count"] and b"verdict" not in z.read("articles.jsonl")
    back = readers.import_archive(made, df.select("id", "title").schema, spark.createDataFrame([(3,)], "id long"), "id")
    assert sorted(((r.id, r.title, r.outcome) for r in back.collect()), key=str) == sorted([(1, "a", "created"), (None, "b", "skipped"), (3, None, "updated")], key=str)
    with zipfile.ZipFile(f"{tmp_path}/bad.zip", "w") as z:
        z.writestr("other", "x")
    with pytest.raises(Exception, match=r"articles\.jsonl"):
        readers.zip_lines(spark.createDataFrame([(f"file://{tmp_path}/bad.zip",)], "path string")).count()


def test_scraper_strategies(spark):
    art = lambda t: f"<li><b>{t}</b></li>"
    pages = spark.createDataFrame([("http://p/l", art("one")), ("http://p/l/page/2", art("two")), ("http://p/l/page/3", "<p>none"), ("http://p/l/page/4", art("four"))], "url string, body string")
    config = {"strategy": "paginated", "start": "http://p/l", "pagination": {"type": "url_suffix", "max_pages": 9}, "container": "li", "title": "b"}
    assert sorted(r.title for r in readers.scrape(pages, "url", "body", config).collect()) == ["one", "two"]
    assert [r.title for r in readers.scrape(pages, "url", "body", {"start": "http://p/l/page/4", "container": "li", "title": "b"}).collect()] == ["four"]
    assert readers.page_urls({"start": "http://p/?a=1", "pagination": {"max_pages": 99}})[-1] == "http://p/?a=1&page=20"
    issues = spark.createDataFrame([("http://q/all", "<a href='/i/1'>No 1 (2019)</a><a href='/i/2'>No 2 (2021)</a><a href='i/3'>No 3</a><a>x</a>"), ("http://q/i/1", art("old")), ("http://q/i/2", art("new")), ("http://q/i/3", art("undated"))], "url string, body string")
    config = {"strategy": "issue_list", "issues": {"url": "http://q/all", "link_selector": "a"}, "container": "li", "title": "b", "since": 2020}
    assert sorted((r.title, r.issue) for r in readers.scrape(issues, "url", "body", config).collect()) == [("new", "No 2 (2021)"), ("undated", "No 3")]
    for wrong in ({"strategy": "paginated"}, {"strategy": "issue_list"}, {"strategy": "issue_list", "issues": {"url": "u"}}, {"strategy": "other"}):
        with pytest.raises(ValueError):
            readers.check_config({"container": "li", "title": "b"} | wrong)


def test_dates_and_bylines(spark):
    dates = {"Mar 17, 2026": "2026-03-17", "December 1 2020": "2020-12-01", "Foo 2, 2021": "2021-01-02", "in 2019": "2019", "no date": ""}
    assert {t: one(spark, readers.month_day_date(F.col("a")), a=t) for t in dates} == dates
    assert one(spark, readers.byline_names(F.col("a")), a="Written by: Ada One, Bo Two &amp; Cy <b>Three</b> and X") == ["Ada One", "Bo Two", "Cy Three"]
    assert one(spark, readers.byline_names(F.col("a")), a=None) == []


def test_html_connector(spark):
    pages = spark.createDataFrame([("http://h/a", "<article><h1>T</h1><p>one</p><p>two</p></article><article><p>no title</p></article>"), ("http://h/b", None)], "url string, body string")
    out = readers.reader_for({"type": "html", "container": "article", "title": "h1", "abstract": "p"})(pages).collect()
    assert [(r.title, r.url, r.abstract) for r in out] == [("T", "http://h/a", "one")]


def test_works_filter():
    assert readers.works_filter("issn:1234-567x", "2024-03-01", 30) == ("primary_location.source.issn:1234-567X", "2024-01-31", None)
    assert readers.works_filter("https://host/S42", "2024-03-01", since=2020, until=2021) == ("primary_location.source.id:S42", "2020-01-01", "2021-12-31")
    with pytest.raises(ValueError):
        readers.works_filter("nothing", "2024-03-01")


def test_document_texts_by_kind(spark):
    stream = zlib.compress(b"BT /F1 12 Tf 72 700 Td (Hello \\(wor) Tj (ld\\)) Tj 0 -14 Td [(Se) -20 (cond)] TJ T* <4869> Tj ET")
    pdf = b"%PDF-1.4\n1 0 obj\n<< /Length 99 /Filter /FlateDecode >>\nstream\n" + stream + b"\nendstream\nendobj\n<< /X 1 >>\nstream\nnothing\nendstream"
    files = [("/a.pdf", pdf), ("/b.docx", b"no zip"), ("/c.txt", "ü".encode()), ("/d.pdf", b"%PDF"), ("/e.txt", None)]
    got = {r.path: (r.text, r.status) for r in readers.document_texts(spark.createDataFrame(files, "path string, content binary")).collect()}
    assert got["/b.docx"] == (None, "failed: BadZipFile") and got["/c.txt"] == ("ü", "ok") and got["/e.txt"] == ("", "ok")
    try:
        import pypdf  # noqa: F401
    except ImportError:
        assert got["/a.pdf"] == ("Hello (world)\nSecond\nHi", "ok") and got["/d.pdf"] == (None, "no text")


def test_label_keys(spark):
    keys = {"see **van der Berg** (2001), p. 3": "van der berg:2001", "Source: *Smith* (1999)": "smith:1999"}
    assert {k: one(spark, parsing.source_key(F.col("a")), a=k) for k in keys} == keys


def test_degenerate(spark):
    texts = {"x" * 40: False, "y" + "x" * 41: True, " " * 41: True, "\n" * 50: False, "go " * 8: True, "go " * 7: False, "a b " * 20: False, "": False}
    assert {t: one(spark, X.degenerate(F.col("a")), a=t) for t in texts} == texts


def test_inverted_index_round_trip(spark):
    df = spark.createDataFrame([(["b", "a", "b", "c"],), ([],), (["x"],)], "w array<string>")
    got = df.select(parsing.inverted_index(F.col("w")).alias("e"), parsing.rebuilt(parsing.inverted_index(F.col("w"))).alias("t")).collect()
    assert [(x.word, x.positions) for x in got[0].e] == [("a", [1]), ("b", [0, 2]), ("c", [3])] and [r.t for r in got] == ["b a b c", "", "x"]
    clash = spark.range(1).select(parsing.rebuilt(F.expr("array(struct('a' AS word, array(0, 1) AS positions), struct('b' AS word, array(1) AS positions))")))
    assert clash.first()[0] == "a b"


def test_own_publication_with_and_without_subtitle(spark):
    """A title inside the other's head either way, a short one, a namesake, and an equal DOI."""
    from citemill.operators import matching

    head = "Learning in networks of care and repair"
    arts = [
        (1, None, ["Ada Berg"], head),
        (2, "", ["X", "BERG, A."], f"{head}: a study of schools and of much else that has to do with them"),
        (3, None, ["C. Other"], head),
        (4, "10.5/ABC.", ["C. Other"], "Quite another"),
        (5, None, ["A. Berg"], "Too short"),
        (6, None, ["A. Berg"], "<b>Learning</b> in networks – of CARE and repair"),
        (7, None, None, head),
        (8, None, ["A. Berg"], None),
        (9, None, ["A. Berg"], "On the many uses of old tools in new places"),
    ]
    pubs = [(20, None, "Berg", f"{head}: a study of schools"), (21, "10.5/abc", "Berg", "The uses"), (22, None, "Berg", None), (23, None, "Berg", "old tools")]
    a = spark.createDataFrame(arts, "id long, doi string, authors array<string>, title string")
    p = spark.createDataFrame(pubs, "pub long, doi string, surname string, title string")
    # the second's first 60 characters go beyond the publication's title, whose own head isn't in it
    assert sorted((r.id, r.pub) for r in matching.own_publication(a, p).collect()) == [(1, 20), (2, 20), (4, 21), (6, 20), (9, 23)]
    assert matching.own_publication(a.where("false"), p).count() == 0


def test_containing_equals_all_pairs(spark):
    import random

    from citemill.operators import matching

    rng = random.Random(2)
    texts = ["".join(rng.choices("ab ", k=rng.randint(0, 30))) for _ in range(300)] + ["x" * 5000, None]
    needles = ["".join(rng.choices("ab ", k=rng.randint(0, 12))) for _ in range(200)] + ["x" * 4999, "nowhere to be found", None]
    got = matching.containing(spark.createDataFrame([(x,) for x in needles], "needle string"), spark.createDataFrame([(x,) for x in texts], "text string")).collect()
    assert sorted(map(tuple, got)) == sorted({(n, t) for n in needles for t in texts if n and t and n in t})


def test_name_tiers(spark):
    from citemill.operators import matching

    cases = {"Meier, K. (1999)": "strong", "K. Meier": "strong", "Karl Meier": "strong", "Meier, Karl": "strong", "J. Meier": "reject", "Meier, Jo": "reject", "(1999) Meier: Things": "weak", "Other": "reject", "": "reject"}
    df = spark.createDataFrame([(c,) for c in cases], "t string").select("t", matching.name_tier(F.col("t"), "Karl", "Meier").alias("tier"))
    assert {r.t: r.tier for r in df.collect()} == cases
    umlaut = spark.createDataFrame([("M. Mobius",), ("M. Möbius",)], "t string").select(matching.name_tier(F.col("t"), "Max", "Möbius"))
    assert [r[0] for r in umlaut.collect()] == ["strong", "strong"]


def test_author_citations_by_tier(spark):
    """Certain, doubtful and low hits; a weak name is low whatever the title says; the surest of an article stays."""
    from citemill.operators import matching

    pubs = [(1, "Learning networks among weavers", 1999, "10.1/a"), (2, "Learning networks among potters", 1999, None), (3, "Old tools", 2001, None), (4, "Painted walls speaking", 1999, None)]
    refs = [
        (1, 1, "any", None, None, "10.1/A"),
        (2, 1, "Meier, K. (1999) Learning networks among weavers", None, None, None),
        (3, 1, "Meier, K. (1999) Learning networks", None, None, None),
        (4, 1, "Meier, K. (2001) A book", None, None, None),
        (5, 1, "[3] Meier (1999): Learning networks among weavers", None, None, None),
        (6, 1, "Meier, K. Learning networks", None, None, None),
        (7, 1, "J. Meier (1999) Learning networks among weavers", None, None, None),
        (8, 1, None, ["Karl Meier"], 2001, None),
        (9, 1, "[3] Meier (2001)", None, None, None),
        (9, 2, "Meier, K. (2001) Old tools", None, None, None),
        (10, 1, "Meier, K. (1999) Things", None, None, None),
    ]
    out = matching.author_citations(spark.createDataFrame(refs, "id long, pos int, raw string, authors array<string>, year int, doi string"), spark.createDataFrame(pubs, "pub long, title string, year int, doi string"), "Karl", "Meier")
    assert sorted((r.id, r.pub or 0, r.match, r.confidence) for r in out.collect()) == [
        (1, 1, "doi", "high"), (2, 1, "author_year_title", "high"), (3, 1, "author_year_title", "medium"), (3, 2, "author_year_title", "medium"), (4, 3, "author_year", "high"), (5, 1, "author_year_title", "low"), (6, 0, "author_only", "low"),
        (8, 3, "author_year", "high"), (9, 3, "author_year", "high"), (10, 1, "author_year", "medium"), (10, 2, "author_year", "medium"), (10, 4, "author_year", "medium"),
    ]


def test_exact_quantiles(spark):
    """Against sorting: ties, far-off values, signs, nulls, NaN, one value, none; cells are refined several times."""
    from citemill.operators.quantiles import exact_quantiles

    rng = random.Random(7)
    a = [rng.choice([rng.gauss(0, 1), rng.gauss(0, 1e-9), 1e300, -1e300, 0.25, 0.25]) for _ in range(3000)]
    rows = [(x, float(i % 7), 5.0, None, float("nan") if i % 3 else 1.0 * i) for i, x in enumerate(a)] + [(None, None, None, None, None)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double, e double").repartition(3)
    shares = [0.0, 0.05, 0.25, 0.5, 0.77, 0.999, 1.0]
    got = exact_quantiles(df, {c: shares for c in "abcde"})
    for i, c in enumerate("abcde"):
        values = sorted(r[i] for r in rows if r[i] is not None and r[i] == r[i])
        for p, q in zip(shares, got[c], strict=True):
            if not values:
                assert q is None
                continue
            at = p * (len(values) - 1)
            lo, hi = values[math.floor(at)], values[math.ceil(at)]
            assert q == (lo if lo == hi else (math.ceil(at) - at) * lo + (at - math.floor(at)) * hi)


def test_profiles_by_hand(spark):
    """Blocks, list marks, first relation word, twice the same source, coiners, densities, lines without form, no position."""
    from citemill.operators.profiles import parse_profiles

    text = """Vocabulary: affirms
- **[QUELLEN]**
* QUELLE: Brown (2015) | RELATION: contrasts, then affirms | ADRESSE: ch. 2 | BELEG: « so it is »
QUELLE: Brown (2015) | RELATION: Affirms
QUELLE: Ames | RELATION: affirmsx
QUELLE: | RELATION: extends
[BEGRIFFE]
BEGRIFF: late | HERKUNFT: Clark
BEGRIFF: glitch | HERKUNFT: von Brown
BEGRIFF: own | HERKUNFT: Anschluss an Brown
[UNBEKANNT]
ZIEL: never
[TRAJEKTORIE]
SELBSTBEZUG: Clark, early
SELBSTBEZUG: later
[BEGRIFFE]
BEGRIFF: again | HERKUNFT: CLARK"""
    rows = spark.createDataFrame([(1, text), (2, None), (3, ""), (4, "[SELBSTPOSITION]\nZIEL: one\nZIEL: two")], "k int, t string")
    topology = spark.createDataFrame([(1, "Brown", 7), (1, "Other", 3)], "k int, author string, density int")
    out = parse_profiles(rows, "k", "t", topology).collect()
    assert sorted((r.k, r.name, r.label, r.density) for r in out if r.kind == "node") == [
        (1, "own:0", "Clark, early", None), (1, "own:1", "later", None), (1, "position:self", "(Selbstposition nicht explizit)", None), (1, "source:Brown (2015)", "Brown (2015)", 7),
        (1, "term:again", "again", None), (1, "term:glitch", "glitch", None), (1, "term:late", "late", None), (1, "term:own", "own", None), (4, "position:self", "one", None),
    ]
    me, brown = "position:self", "source:Brown (2015)"
    assert sorted((r.name, r.source, r.target, r.sigma or "", r.quote or "", r.address or "") for r in out if r.kind == "edge") == [
        ("affirms", me, brown, "+", "", ""), ("coins", "own:0", "term:again", "", "", ""), ("coins", me, "term:late", "", "", ""), ("coins", me, "term:own", "", "", ""), ("coins", brown, "term:glitch", "", "", ""),
        ("contrasts", me, brown, "-", "so it is", "ch. 2"), ("trajectory", me, "own:0", "", "", ""), ("trajectory", me, "own:1", "", "", ""),
    ]
    assert sorted(r.label for r in out if r.kind == "unparsed") == ["QUELLE: Ames | RELATION: affirmsx", "QUELLE: | RELATION: extends", "Vocabulary: affirms", "ZIEL: never"]


def test_companions_with_any_number_of_counters(spark):
    """Counters that pairs share only let more through: the choice is that of counting all pairs."""
    rng = random.Random(11)
    docs = {i: {rng.choice("abcdefghij") * 2 for _ in range(rng.randint(1, 8))} for i in range(60)}
    tokens = spark.createDataFrame([(i, t) for i, ts in docs.items() for t in ts] + [(0, t) for t in docs[0]], "id long, token string")
    own = {t: sum(t in ts for ts in docs.values()) for t in ("aa", "bb", "cc")}
    motif = spark.createDataFrame(list(own.items()), "token string, articles long")
    mates = spark.createDataFrame([(c * 2,) for c in "abcdefg"], "token string")
    want = {}
    for t, n in own.items():
        together = {m: sum(t in ts and m in ts for ts in docs.values()) for m in (c * 2 for c in "abcdefg") if m != t}
        k, m = max((k, m) for m, k in together.items())
        if k >= 0.4 * n:
            want[t] = (m, k)
    for buckets in (1 << 20, 7, 1):
        assert {r.token: (r.mate, r.together) for r in analytics.companions(tokens, motif, mates, buckets=buckets).collect()} == want


def test_source_scores_of_all_pairs(spark):
    """Each source has a score for each wanted name, whatever their names share; equal to a plain scoring of all pairs."""
    import re

    from citemill.operators import matching

    sources = [
        (1, "journal of care", False, True), (2, "journal of care studies", False, False), (3, "painted walls", True, False), (3, "painted walls", True, False), (4, "of", False, True),
        (5, "", True, True), (6, None, True, True), (7, "cafe\u0301 noir", None, None), (8, "walls walls", False, True), (9, "x", False, False),
    ]
    wanted = ["journal of care", "journal of care", "walls", "cafe club", "ab", "", None]

    def score(c, n, hint, kind):
        if c is None:
            return None
        a, b = (set(re.findall(r"\w{3,}", x or "")) for x in (c, n))
        base = 0 if n is None else 10 if c == n else 5 if n in c else 3 if c in n else 0
        return base + 4 * len(a & b) / max(len(b), 1) + 20 * bool(hint) + bool(kind)

    out = matching.source_scores(spark.createDataFrame(sources, "ref long, cand string, hint boolean, type_ok boolean"), spark.createDataFrame([(n,) for n in wanted], "name string"))
    key = lambda r: tuple(map(str, r))
    want = [(r, n, None if (x := score(c, n, h, k)) is None else float(x)) for r, c, h, k in sources for n in set(wanted)]
    assert sorted(map(tuple, out.collect()), key=key) == sorted(want, key=key)
    assert (3, "journal of care", 20.0) in want and (9, "walls", 0.0) in want
