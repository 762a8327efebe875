"""Scores, decisions, votes, priors and features of articles."""

from __future__ import annotations

import difflib
import re
from collections.abc import Callable
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from citemill.functions.text import squeeze, words
from citemill.operators.ordered import running
from citemill.shared import scratch

# fixed values: thresholds of the coupling scores
OWN_WEAK, OWN_STRONG, BLIND_WEAK, BLIND_STRONG = 0.6, 1.5, 3.0, 8.0
EPS = 1e-9


def selection_mode(explicit: Column, cites: Column, trigger: Column, own: Column, blind: Column, projects: Column, relations: Column, overlap: Column, verdict: Column, indicator: Column) -> Column:
    """How an article came to be selected, by the first rule that holds."""
    return (
        F.when(explicit.isNotNull(), explicit)
        .when(cites, "citation")
        .when(trigger, "trigger")
        .when(own >= OWN_WEAK, "own_coupling")
        .when(blind >= BLIND_STRONG, "adversarial")
        .when(projects & relations & (indicator != "kein_indikator"), "mixed")
        .when(projects & (indicator != "kein_indikator"), "complementarity")
        .when(relations | overlap, "similarity")
        .when(verdict.isNotNull(), "screening")
        .otherwise("none")
    )


def indicator(verdict: Column, own: Column, blind: Column, projects: Column, remark: Column, signals: Column) -> Column:
    """Strength of an article's link to one's discourse, by ordered thresholds."""
    strong = verdict.isin("pflichtlektuere", "lesenswert") | (own >= OWN_STRONG) | (blind >= BLIND_STRONG) | ((verdict == "scannen") & projects & (remark | (signals > 0)))
    weak = (
        (own >= OWN_WEAK) | (blind >= BLIND_WEAK) | ((verdict == "scannen") & projects)
        | ((verdict == "ignorieren") & projects & (remark | (signals > 1))) | remark | (signals > 0) | (verdict == "scannen")
    )
    return F.when(strong, "starker_indikator").when(weak, "schwacher_indikator").otherwise("kein_indikator")


def lift_double_hit(mode: Column, indicator_: Column, hits: Column) -> Column:
    return F.when((mode == "citation") & (hits >= 2), "starker_indikator").otherwise(indicator_)


def subgroup(text: Column, cues: dict[str, tuple[list[str], list[str]]]) -> Column:
    """struct(name, confidence) of the best subgroup: 3 a phrase cue, 2 a word cue; ties by name; null without a hit."""
    scored = []
    for name, (words, phrases) in cues.items():
        hit = lambda c, w: F.when(F.contains(F.lower(text), F.lit(c)), w).otherwise(0)
        score = reduce(lambda a, b: a + b, [hit(c, 2) for c in words] + [hit(c, 3) for c in phrases])
        scored.append(F.struct((-score).alias("s"), F.lit(name).alias("n")))
    best = F.array_min(F.array(*scored))
    return F.when(best["s"] < 0, F.struct(best["n"].alias("name"), F.least(F.lit(0.95), 0.35 - best["s"] / 10.0).alias("confidence")))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / F.greatest(norm(a) * norm(b), F.lit(1e-12))


ROWS_AT_ONCE, OWN_AT_ONCE = 512, 4096  # of a matrix of similarities


def _unit_rows(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    x = np.array(column.to_pylist(), float).reshape(len(column), -1)
    return x, np.sqrt((x * x).sum(1))


def _by_blocks(rows: DataFrame, own: DataFrame, finish: Callable, schema: str, skip_same: bool, k: int, levels: tuple[float, ...] = ()) -> DataFrame:
    """What ``finish`` makes of each row's similarities to all of ``own``: its best ``k`` (rounded, id), and their sum and counts from ``levels`` up.

    ``own`` is written once to the shared folder.  A task reads it block by block for each batch of its
    rows and multiplies matrices, so neither side has to fit in memory, nothing is sent to all tasks and
    no pair leaves the task.
    """
    folder = scratch(rows.sparkSession, "own")
    own.select("near", "u", "near_title").write.parquet(folder)

    def run(batches):
        from pyarrow import dataset, fs

        system, path = fs.FileSystem.from_uri(folder)
        files = dataset.dataset(path, filesystem=system, format="parquet")
        for batch in batches:
            if not batch.num_rows:
                continue
            x, size = _unit_rows(batch.column("v"))
            titles = np.array(batch.column("title").to_pylist(), object)
            best = [[] for _ in range(len(x))]
            total, count, above = np.zeros(len(x)), np.zeros(len(x), int), np.zeros((len(x), len(levels)), int)
            for block in files.to_batches(batch_size=OWN_AT_ONCE):
                if not block.num_rows:
                    continue
                u, norm = _unit_rows(block.column("u"))
                ids, names = block.column("near").to_numpy(), np.array(block.column("near_title").to_pylist(), object)
                for i in range(0, len(x), ROWS_AT_ONCE):
                    part = slice(i, i + ROWS_AT_ONCE)
                    sims = x[part] @ u.T / np.maximum(size[part, None] * norm[None, :], 1e-12)
                    use = np.array([[a is not None and b is not None and a != b for b in names] for a in titles[part]]) if skip_same else np.ones(sims.shape, bool)
                    total[part] += np.where(use, sims, 0).sum(1)
                    count[part] += use.sum(1)
                    for j, level in enumerate(levels):
                        above[part, j] += (use & (sims >= level)).sum(1)
                    near = np.where(use, np.round(sims, 6), -np.inf)
                    kth = np.partition(near, max(0, near.shape[1] - k), axis=1)[:, max(0, near.shape[1] - k)]
                    for r, c in zip(*np.nonzero(use & (near >= kth[:, None])), strict=True):
                        best[i + r].append((-near[r, c], int(ids[c]), sims[r, c]))
                best = [sorted(b)[:k] for b in best]
            yield finish(batch.column("id"), best, total, count, above)

    return rows.select("id", "v", "title").mapInArrow(run, schema)


def nearest(rows: DataFrame, own: DataFrame, k: int, skip_same: bool = True) -> DataFrame:
    """(id, near, sim, rank): the ``k`` nearest of ``own`` by cosine, ties to the smaller id, those of the same title passed over."""

    def finish(ids, best, *_):
        flat = [(i, n, s, r) for i, b in zip(ids.to_pylist(), best, strict=True) for r, (_, n, s) in enumerate(b, 1)]
        cols = list(zip(*flat, strict=True)) or [[], [], [], []]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.float64(), pa.int32()), strict=True)], names=["id", "near", "sim", "rank"])

    return _by_blocks(rows, own, finish, "id long, near long, sim double, rank int", skip_same, k)


def similarity_features(rows: DataFrame, own: DataFrame, levels: tuple[float, ...] = (0.6, 0.7), top: int = 5) -> DataFrame:
    """(id, top, mean, top_mean, above_..): largest and mean similarity to ``own``, mean of the ``top`` largest, and how many reach each level."""
    names = [f"above_{round(100 * x)}" for x in levels]

    def finish(ids, best, total, count, above):
        first = [b[0][2] if b else None for b in best]
        few = [sum(x[2] for x in b) / len(b) if b else None for b in best]
        columns = [ids.cast(pa.int64()), pa.array(first, pa.float64()), pa.array(np.divide(total, count, out=np.zeros(len(total)), where=count > 0)), pa.array(few, pa.float64()), *(pa.array(above[:, j], pa.int64()) for j in range(len(levels)))]
        return pa.RecordBatch.from_arrays(columns, names=["id", "top", "mean", "top_mean", *names])

    return _by_blocks(rows, own, finish, "id long, top double, mean double, top_mean double, " + ", ".join(f"{n} long" for n in names), False, top, levels)


def centroid_features(rows: DataFrame, vector: str, centroids: list[list[float]], high: float = 0.55) -> DataFrame:
    """``rows`` with cosines to each centroid, the largest, its lead over the second, its number and how many reach ``high``.

    The centroids of a k-means model are k short vectors, so they are literals of the plan.
    """
    cos = F.array(*[cosine(F.col(vector), F.array(*map(F.lit, c))) for c in centroids])
    ordered = F.sort_array("cosines", asc=False)
    out = rows.withColumn("cosines", cos)
    spread = F.when(F.size("cosines") > 1, ordered[0] - ordered[1])
    return out.withColumns({"nearest": ordered[0], "spread": spread, "cluster": F.array_position("cosines", ordered[0]).cast("int") - 1, "n_high": F.size(F.filter("cosines", lambda x: x >= high))})


def eb_prior(rows: DataFrame, group: str, y: str, k: float = 5.0) -> DataFrame:
    """(group, prior): keep rates drawn towards the global one; unseen groups take the global rate ``g``."""
    g = rows.agg(F.avg(y).alias("g"))
    per = rows.groupBy(group).agg(F.sum(y).alias("s"), F.count("*").alias("n"))
    return per.crossJoin(F.broadcast(g)).select(group, ((F.col("s") + F.col("g") * k) / (F.col("n") + k)).alias("prior"), "g")


def unit(v: Column, lo: float, hi: float) -> Column:
    """Position between frozen bounds, clipped to 0 and 1."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (v - lo) / (hi - lo + EPS)))


def composite(sim: Column, prior: Column, biblio: Column, p: dict[str, float]) -> Column:
    lift = unit(F.greatest(F.lit(0.0), prior - p["g"]), 0.0, p["lift_max"])
    return F.round(unit(unit(sim, p["lo"], p["hi"]) + 0.5 * lift, 0.0, p["mc"]) + F.when(biblio, 1.0).otherwise(0.0), 4)


def zone(score: Column, has_abstract: Column, low: float) -> Column:
    return F.when(~has_abstract, "no_abstract").when(score < low, "drop").otherwise("mid")


def combine_votes(votes: DataFrame, key: str, verdict: str) -> DataFrame:
    """(key, keep, votes, flagged, verdict): kept if any vote keeps; dropped only if all drop; fewer than two votes are flagged."""
    from citemill.views import KEEP, VERDICTS

    v = F.col(verdict)
    level = F.array_position(F.array(*map(F.lit, VERDICTS)), v)
    g = votes.where(v.isNotNull()).groupBy(key).agg(F.max(v.isin(*KEEP).cast("int")).alias("k"), F.count("*").alias("votes"), F.min_by(verdict, level).alias("top"))
    out = votes.select(key).distinct().join(g, key, "left")
    keep = F.coalesce(F.col("k") == 1, F.lit(True))
    return out.select(key, keep.alias("keep"), F.coalesce("votes", F.lit(0)).alias("votes"), (F.coalesce("votes", F.lit(0)) < 2).alias("flagged"), F.when(keep, F.coalesce("top", F.lit("scannen"))).otherwise("ignorieren").alias("verdict"))


def linear_score(v: Column, weights: list[float], means: list[float], scales: list[float], a: float, b: float) -> Column:
    """Calibrated probability of a linear filter over standardised features: sigmoid(a * x + b)."""
    std = F.zip_with(F.zip_with(v, F.array(*map(F.lit, means)), lambda x, m: x.cast("double") - m), F.array(*map(F.lit, scales)), lambda x, s: x / s)
    x = dot(std, F.array(*map(F.lit, weights)))
    return 1.0 / (1.0 + F.exp(-(a * x + b)))


def platt(rows: DataFrame, margin: str, y: str) -> tuple[float, float]:
    """(a, b) of a logistic fit of ``y`` on out-of-fold margins."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    data = rows.select(array_to_vector(F.array(F.col(margin).cast("double"))).alias("features"), F.col(y).cast("double").alias("label"))
    model = LogisticRegression(maxIter=50, regParam=0.0, standardization=False).fit(data)
    return float(model.coefficients[0]), float(model.intercept)


def loss_threshold(rows: DataFrame, score: str, y: str, allowed: float) -> DataFrame:
    """(threshold): the highest score below which at most ``allowed`` of the positives lie; running sums over distinct scores."""
    per = rows.groupBy(score).agg(F.sum(y).alias("p"))
    total = per.agg(F.sum("p").alias("t"))
    return running(per, F.col(score), {"b": "p"}).crossJoin(F.broadcast(total)).where(F.col("b") <= allowed * F.col("t")).agg(F.max(score).alias("threshold"))


def priority(own: Column, blind: Column, indicator_: Column, verdict: Column) -> Column:
    return own + blind + F.when(indicator_ == "starker_indikator", 0.5).otherwise(0.0) + F.when(verdict == "scannen", 0.2).when(verdict == "ignorieren", -0.5).otherwise(0.0)


def three_zones(rows: DataFrame, score: str, y: str, precision: float = 0.8, least: int = 3) -> DataFrame:
    """(drop_below, keep_from): below all positives, and the lowest score from which precision holds up over ``least`` rows or more."""
    per = rows.groupBy(score).agg(F.sum(y).alias("p"), F.count("*").alias("n"))
    run = running(per, -F.col(score), {"ap": "p", "an": "n"}).withColumns({"rp": F.col("ap") + F.col("p"), "rn": F.col("an") + F.col("n")})
    return run.agg(F.min(F.when(F.col("p") > 0, F.col(score))).alias("drop_below"), F.min(F.when((F.col("rn") >= least) & (F.col("rp") / F.col("rn") >= precision), F.col(score))).alias("keep_from"))


def jaccard(a: Column, b: Column) -> Column:
    u = F.size(F.array_union(a, b))
    return F.when(u > 0, F.size(F.array_intersect(a, b)) / u).otherwise(0.0)


def verbatim_share(quote: Column, text: Column, least: int = 12) -> Column:
    """Share, by length, of a quotation's pieces of ``least`` characters or more that the text holds; 1 without any."""
    pieces = F.filter(F.split(quote, r"\s*(?:\[\.\.\.\]|…|\.\.\.)\s*"), lambda p: F.length(p) >= least)
    total = F.aggregate(pieces, F.lit(0), lambda s, p: s + F.length(p))
    held = F.aggregate(F.filter(pieces, lambda p: F.contains(text, p)), F.lit(0), lambda s, p: s + F.length(p))
    return F.when(total > 0, held / total).otherwise(1.0)


def percentile_rank(rows: DataFrame, score: str) -> DataFrame:
    """``rows`` with pct, the share of rows of a strictly smaller score; ranks come from counts by score."""
    per = rows.groupBy(score).agg(F.count("*").alias("_n"))
    total = per.agg(F.sum("_n").alias("_t"))
    table = running(per, F.col(score), {"_b": "_n"}).crossJoin(F.broadcast(total)).select(score, (F.col("_b") / F.col("_t")).alias("pct"))
    return rows.join(table, score)


@F.pandas_udf(DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Twice the matching characters over all characters; there is no built-in for it."""
    return pd.Series([difflib.SequenceMatcher(None, x or "", y or "").ratio() for x, y in zip(a, b, strict=True)])


def label_similarity(a: Column, b: Column) -> Column:
    ta, tb = F.array_distinct(F.split(F.lower(a), " ")), F.array_distinct(F.split(F.lower(b), " "))
    inside = 0.9 * F.size(F.array_intersect(ta, tb)) / F.least(F.size(ta), F.size(tb))
    return F.greatest(jaccard(ta, tb), inside, 0.55 * sequence_ratio(F.lower(a), F.lower(b)))


def profile_fit(sources: DataFrame, profile: list[tuple[str, float]], least: float = 0.24) -> DataFrame:
    """(source, fit, tier): weighted mean of each profile topic's best match among a source's topics, in percent; A from 45, B from 20.

    The profile is the caller's list of a person's topics, so it is a literal of the plan.  A topic is
    compared once, however many sources have it.
    """
    topics = sources.select("topic").distinct().withColumn("p", F.explode(F.array(*[F.struct(F.lit(t).alias("wanted"), F.lit(float(w)).alias("weight")) for t, w in profile])))
    pairs = topics.select("topic", "p.*").withColumn("sim", label_similarity(F.col("topic"), F.col("wanted")))
    best = sources.join(pairs, "topic").groupBy("source", "wanted", "weight").agg(F.max("sim").alias("sim"))
    fit = best.groupBy("source").agg(F.round(100 * F.sum(F.when(F.col("sim") >= least, F.col("sim") * F.col("weight")).otherwise(0.0)) / F.sum("weight"), 4).alias("fit"))
    return fit.withColumn("tier", F.when(F.col("fit") >= 45, "A").when(F.col("fit") >= 20, "B").otherwise("C"))


def route(topic: Column, cluster: Column, prior: Column) -> Column:
    """struct(score, depth): 70 % topic, 20 % cluster, 10 % prior, at most 100; deep from 24, medium from 12."""
    score = F.least(F.lit(100.0), 0.7 * topic + 0.2 * cluster + 0.1 * prior)
    return F.struct(F.round(score, 4).alias("score"), F.when(score >= 24, "deep").when(score >= 12, "medium").otherwise("light").alias("depth"))


# fixed values: what a question is after, by the first of these that it holds a part of
INTENTS = {
    "methods": ("methode", "methodisch", "zugang", "methodological", "method"),
    "counter": ("gegenargument", "widerspruch", "kritik", "counter", "opposition"),
    "missing_refs": ("fehl", "referenz", "zitation", "missed"),
    "relevant": ("relevant", "anschluss", "welche artikel", "relevante artikel", "bezüge zu", "bezug zu"),
}
# fixed values: for each intent, the sections of a context that add to a search, with numbers of phrases and of lines for terms
QUOTAS = {
    "methods": (("methods", 5, 5), ("keywords", 4, 6)),
    "counter": (("focus", 4, 5), ("gaps", 4, 5), ("keywords", 4, 5)),
    "missing_refs": (("gaps", 5, 5), ("references", 4, 4), ("keywords", 5, 6), ("focus", 3, 4)),
    "other": (("keywords", 6, 8), ("focus", 4, 5)),
}
# fixed values: headings of a context and the sections that they begin
HEADINGS = {
    "argumentationseinheiten": "argument_units", "argumentative einheiten": "argument_units", "argumenteinheiten": "argument_units", "argumentationskomplexe": "argument_units", "fokus": "focus", "schlüsselbegriffe": "keywords",
    "schlusselbegriffe": "keywords", "vorhandene referenzen und debatten": "references", "empirischer/methodischer kontext": "methods", "offene anschlussstellen": "gaps",
}


# fixed values: sections that fill up a part of an argument with few words of its own
SUPPLIES = ("keywords", "references", "methods", "gaps")


def _intent(question: Column) -> Column:
    low = squeeze(F.lower(question))
    tests = [(reduce(lambda a, b: a | b, [F.contains(low, F.lit(p)) for p in parts]), name) for name, parts in INTENTS.items()]
    return F.coalesce(*[F.when(test, name) for test, name in tests], F.lit("general"))


def _context_lines(questions: DataFrame, key: str) -> DataFrame:
    """(key, section, line, text): lines of the known sections of ``context``, numbered from 0, without their list marks."""
    blocks = F.posexplode(F.slice(F.split(F.concat(F.lit("\n"), F.coalesce("context", F.lit(""))), r"\n[ \t]*## "), 2, 1 << 30)).alias("_block", "body")
    lines = F.transform(F.split("body", r"\n"), F.trim)
    known = F.create_map(*[F.lit(x) for kv in HEADINGS.items() for x in kv])
    rows = questions.select(key, blocks).select(key, "_block", F.try_element_at(known, squeeze(F.lower(lines[0]))).alias("section"), F.filter(F.slice(lines, 2, 1 << 30), lambda x: x != "").alias("lines"))
    rows = rows.where("section IS NOT NULL").select(key, "section", "_block", F.posexplode("lines").alias("_line", "text"))
    place = Window.partitionBy(key, "section").orderBy("_block", "_line")
    return rows.select(key, "section", (F.row_number().over(place) - 1).alias("line"), F.trim(F.regexp_replace("text", "^- ", "")).alias("text"))


def _ranked_terms(candidates: DataFrame, key: str, generic: set[str], enough: int, special: int, general: int, most: int) -> DataFrame:
    """(key, terms): candidates (key, text, place) cut into words, each once at its first place, and one cut of their ranking.

    Where a question has ``enough`` special words, its first ``special`` ones rank before its first ``general`` general
    ones and the others are out; else all rank by place.
    """
    found = F.filter(words(F.lower("text"), r"[^\s/_.,;:!?()\"\'-]{3,}"), lambda w: ~w.rlike(r"^\d+$"))
    terms = candidates.select(key, "place", "stop", F.posexplode(found).alias("at", "term")).where(~F.array_contains("stop", F.col("term")))
    terms = terms.groupBy(key, "term").agg(F.min(F.struct("place", "at")).alias("place")).withColumn("general", F.col("term").isin(sorted(generic)))
    own = Window.partitionBy(key)
    ranked = terms.withColumns({"n": F.count_if(~F.col("general")).over(own), "r": F.row_number().over(Window.partitionBy(key, "general").orderBy("place"))})
    split = F.col("n") >= enough
    kept = ranked.where(~split | F.when(F.col("general"), F.col("r") <= general).otherwise(F.col("r") <= special))
    kept = kept.withColumn("order", F.struct((split & F.col("general")).cast("int"), "place"))
    kept = kept.withColumn("rank", F.row_number().over(own.orderBy("order"))).where(F.col("rank") <= most)
    return kept.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "term"))), lambda x: x["term"]).alias("terms"))


def search_plans(questions: DataFrame, stop: set[str], generic: set[str], key: str = "question_id") -> DataFrame:
    """(key, intent, terms, phrases) of each question (key, question, context): 14 terms and 8 phrases at most.

    Lines of the context's sections that go with the intent come first, each section by its quotas, then the
    question's own words; empty contexts add nothing, and a question without words has no terms.
    """
    rows = questions.select(key, F.coalesce("question", F.lit("")).alias("question"), "context").withColumn("intent", _intent(F.col("question")))
    quotas = [(i, n, r, p, t) for i in [*INTENTS, "general"] for r, (n, p, t) in enumerate(QUOTAS.get(i, QUOTAS["other"]))]
    table = rows.sparkSession.createDataFrame(quotas, "intent string, section string, rank int, most_phrases int, most_lines int")
    lines = _context_lines(rows, key).join(rows.select(key, "intent"), key).join(table, ["intent", "section"])
    stops = F.array(*map(F.lit, sorted(stop))).cast("array<string>").alias("stop")
    place = lambda a, b: F.struct(a.cast("int").alias("a"), b.cast("int").alias("b")).alias("place")
    own = rows.select(key, F.col("question").alias("text"), place(F.lit(1 << 20), F.lit(0)), stops)
    terms = _ranked_terms(lines.where("line < most_lines").select(key, "text", place(F.col("rank"), F.col("line")), stops).unionByName(own), key, generic, 4, 10, 2, 14)
    phrases = lines.where("line < most_phrases AND length(text) >= 4").groupBy(key, "text").agg(F.min(F.struct("rank", "line")).alias("place"))
    phrases = phrases.groupBy(key).agg(F.transform(F.slice(F.array_sort(F.collect_list(F.struct("place", "text"))), 1, 8), lambda x: x["text"]).alias("phrases"))
    none = F.array().cast("array<string>")
    out = rows.select(key, "intent").join(terms, key, "left").join(phrases, key, "left")
    return out.select(key, "intent", F.coalesce("terms", none).alias("terms"), F.coalesce("phrases", none).alias("phrases"))


def argument_plans(units: DataFrame, stop: set[str], generic: set[str], key: str = "unit_id", few: int = 5, full: int = 8) -> DataFrame:
    """(key, terms, phrases) of each part of an argument (key, unit, context): 10 terms at most, and the part itself as phrase.

    One with fewer than ``few`` different words of its own is filled up to ``full`` from the first four lines of each of SUPPLIES.
    """
    stops = F.array(*map(F.lit, sorted(stop))).cast("array<string>").alias("stop")
    rows = units.select(key, F.trim(F.coalesce("unit", F.lit(""))).alias("text"), "context")
    own = F.array_distinct(F.filter(words(F.lower("text"), r"[^\s/_.,;:!?()\"\'-]{3,}"), lambda w: ~w.isin(sorted(stop)) & ~w.rlike(r"^\d+$")))
    thin = rows.where(F.size(own) < few)
    order = F.array_position(F.array(*map(F.lit, SUPPLIES)), F.col("section"))
    more = _context_lines(thin, key).where((order > 0) & (F.col("line") < 4))
    place = lambda a, b: F.struct(a.cast("int").alias("a"), b.cast("int").alias("b")).alias("place")
    mine = rows.select(key, "text", place(F.lit(0), F.lit(0)), stops)
    filled = mine.unionByName(more.select(key, "text", place(order, F.col("line")), stops))
    # the filling is a cut of its own, before special and general words are told apart
    first = _ranked_terms(filled, key, set(), 1 << 20, 0, 0, 1 << 20)
    cut = F.when(F.size(own) < few, F.slice("terms", 1, full)).otherwise(F.col("terms"))
    chosen = first.join(rows.select(key, "text"), key).select(key, F.posexplode(cut).alias("i", "text"))
    terms = _ranked_terms(chosen.select(key, "text", place(F.col("i"), F.lit(0)), F.array().cast("array<string>").alias("stop")), key, generic, 3, 8, 2, 10)
    none = F.array().cast("array<string>")
    return rows.join(terms, key, "left").select(key, F.coalesce("terms", none).alias("terms"), F.when(F.col("text") != "", F.array("text")).otherwise(none).alias("phrases"))
