"""Rankings, roll-ups, trajectories and profiles of a corpus."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citemill.functions.text import journal_name
from citemill.operators.ordered import running
from citemill.shared import scratch

FLOOR = 3  # a work counts as cited from here on, whatever smaller floor is asked for
MIN_TREND_YEARS, MIN_TREND_COUNT = 3, 5


def cited_works(refs: DataFrame, least: int, share: float) -> DataFrame:
    """(ref, n, citers) of the top ``share`` of works by citations, then ordered by different citers; ``refs`` has ref, id, author.

    How many works have each count says where the top ends, so only those of the last count are put in order.
    """
    counted = refs.groupBy("ref").agg(F.count("*").alias("n"), F.countDistinct("author").alias("citers")).where(F.col("n") >= max(least, FLOOR))
    per = counted.groupBy("n").agg(F.count("*").alias("k"))  # as many rows as there are different counts
    down = Window.orderBy(F.desc("n"))
    per = per.select("n", "k", F.sum("k").over(down).alias("upto"), F.sum("k").over(Window.partitionBy()).alias("all")).withColumn("top", F.greatest(F.lit(1), F.floor(F.col("all") * share)))
    cut = per.where("upto >= top").orderBy(F.desc("n")).first()
    if cut is None:
        return counted.where("false")
    last = counted.where(F.col("n") == cut.n).orderBy("ref").limit(cut.top - cut.upto + cut.k)
    return counted.where(F.col("n") > cut.n).unionByName(last).orderBy(F.desc("citers"), F.desc("n"), "ref")


def cited_work_details(ranking: DataFrame, refs: DataFrame, samples: int = 3, most: int = 200) -> DataFrame:
    """``ranking`` (ref, n, citers) with ``years`` (a map of counts by citing year), ``citing`` (the different authors, sorted), and of the first citing article (least id)
    ``seen`` (title, year, doi as it has them) and up to ``samples`` texts of at most ``most`` characters, in the order of articles.

    ``refs`` has ref, id, author, citing_year, raw, title, year, doi.  Missing years and authors count nowhere, missing texts are no sample.
    """
    own = refs.join(ranking.select("ref"), "ref", "left_semi")
    years = own.where("citing_year IS NOT NULL").groupBy("ref", "citing_year").agg(F.count("*").alias("k")).groupBy("ref").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("citing_year", "k")))).alias("years"))
    first = own.groupBy("ref").agg(F.array_sort(F.collect_set("author")).alias("citing"), F.min_by(F.struct("title", "year", "doi"), "id").alias("seen"))
    place = F.row_number().over(Window.partitionBy("ref").orderBy("id", "raw"))
    texts = own.where("raw <> ''").withColumn("place", place).where(F.col("place") <= samples)
    texts = texts.groupBy("ref").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", F.left("raw", F.lit(most)).alias("t")))), lambda x: x["t"]).alias("samples"))
    return ranking.join(years, "ref", "left").join(first, "ref").join(texts, "ref", "left")


def trend(counts: DataFrame, key: str, year: str, n: str) -> DataFrame:
    """(key, trend): rising or falling where the latest or earliest year has most, a peak where one year has over half, else stable.

    Fewer than three years or five citations say nothing, but for the one year that there is.  Of equal
    years the latest counts as the peak.
    """
    g = counts.groupBy(key).agg(F.count("*").alias("years"), F.sum(n).alias("total"), F.min(year).alias("first"), F.max(year).alias("last"), F.max_by(year, F.struct(n, year)).alias("peak"), F.max(n).alias("most"))
    thin = (F.col("years") < MIN_TREND_YEARS) | (F.col("total") < MIN_TREND_COUNT)
    label = (
        F.when(thin & (F.col("years") == 1), F.concat(F.lit("only "), F.col("first").cast("string")))
        .when(thin, "")
        .when(F.col("peak") == F.col("last"), "rising")
        .when(F.col("peak") == F.col("first"), "falling")
        .when(F.col("most") / F.col("total") > 0.5, F.concat(F.lit("peak "), F.col("peak").cast("string")))
        .otherwise("stable")
    )
    return g.select(key, label.alias("trend"))


def cited_journals(refs: DataFrame, name: str, article: str, tracked: DataFrame) -> DataFrame:
    """(journal, n, articles, spelling, tracked) for each normalised journal name: its most frequent spelling and whether it is followed."""
    rows = refs.withColumn("journal", journal_name(F.col(name))).where("journal <> ''")
    spelled = rows.groupBy("journal", name).agg(F.count("*").alias("k")).groupBy("journal").agg(F.max_by(name, F.struct("k", name)).alias("spelling"))
    counted = rows.groupBy("journal").agg(F.count("*").alias("n"), F.countDistinct(article).alias("articles"))
    known = tracked.select(journal_name(F.col("name")).alias("journal"), F.lit(True).alias("_y")).distinct()
    return counted.join(spelled, "journal").join(known, "journal", "left").select("journal", "n", "articles", "spelling", F.coalesce("_y", F.lit(False)).alias("tracked"))


def trajectories(rows: DataFrame, early: tuple[int, int], late: tuple[int, int], least_journal: int, least_panel: int, least_topic: int) -> DataFrame:
    """(topic, within, pooled) changes of share between two windows.

    ``rows`` has id, journal, year and topic, one row a topic of an article.  Within is the mean of the
    changes inside the journals that have ``least_journal`` articles in both windows, so that a change in
    what journals are covered is not taken for a change of topics; pooled is the plain change, for contrast.
    """
    when = F.when(F.col("year").between(*early), "e").when(F.col("year").between(*late), "l")
    rows = rows.withColumn("w", when).where("w IS NOT NULL").select("id", "journal", "topic", "w").distinct()
    count = lambda w: F.count_if(F.col("w") == w)
    panel = rows.select("id", "journal", "w").distinct().groupBy("journal").agg(count("e").alias("ne"), count("l").alias("nl")).where((F.col("ne") >= least_journal) & (F.col("nl") >= least_journal))
    size = panel.agg(F.count("*").alias("journals"), F.sum("ne").alias("te"), F.sum("nl").alias("tl"))
    cells = rows.join(panel, "journal").groupBy("topic", "journal", "ne", "nl").agg(count("e").alias("ke"), count("l").alias("kl"))
    # journals without a topic count as a change of nothing: their number divides the sum
    out = cells.groupBy("topic").agg(F.sum(F.col("kl") / F.col("nl") - F.col("ke") / F.col("ne")).alias("s"), F.sum("ke").alias("ke"), F.sum("kl").alias("kl")).where(F.col("ke") + F.col("kl") >= least_topic)
    out = out.crossJoin(F.broadcast(size)).where(F.col("journals") >= least_panel)
    return out.select("topic", (F.col("s") / F.col("journals")).alias("within"), (F.col("kl") / F.col("tl") - F.col("ke") / F.col("te")).alias("pooled"))


def quantiles(rows: DataFrame, group: str, value: str, shares: dict[str, float]) -> DataFrame:
    """(group, size, ..): the values at the given shares of each group's sorted values, by rounding the place; from counts by value."""
    per = rows.groupBy(group, value).agg(F.count("*").alias("_n"))
    w = Window.partitionBy(group)
    run = per.withColumns({"_upto": F.sum("_n").over(w.orderBy(value)), "size": F.sum("_n").over(w)})
    at = lambda p: F.round((F.col("size") - 1) * F.lit(p))
    return run.groupBy(group, "size").agg(*[F.min(F.when(F.col("_upto") > at(p), F.col(value))).alias(n) for n, p in shares.items()])


def community_profile(members: DataFrame, clusters: DataFrame, thematic: list[str], share: float = 0.25) -> DataFrame:
    """For each community: size, concentration on its largest journal, whether it joins two thematic clusters, median and quartiles of its years."""
    by_journal = members.groupBy("community", "journal").agg(F.count("*").alias("k"))
    top = by_journal.groupBy("community").agg(F.max_by("journal", F.struct("k", "journal")).alias("top_journal"), F.max("k").alias("top_n"))
    size = quantiles(members, "community", "year", {"median": 0.5, "q1": 0.25, "q3": 0.75})
    parts = by_journal.join(clusters, "journal").groupBy("community", "cluster").agg(F.sum("k").alias("k"))
    parts = parts.join(size.select("community", "size"), "community").where(F.col("cluster").isin(thematic) & (F.col("k") / F.col("size") >= share))
    cross = parts.groupBy("community").agg(F.countDistinct("cluster").alias("fields"))
    out = size.join(top, "community").join(cross, "community", "left")
    return out.select("community", "size", "top_journal", F.round(F.col("top_n") / F.col("size"), 6).alias("concentration"), (F.coalesce("fields", F.lit(0)) >= 2).alias("cross_field"), "median", "q1", "q3")


def cross_cutting(rows: DataFrame, concept: str, cluster: str, score: str, least: float = 1.0, clusters: int = 3, total: float = 5.0) -> DataFrame:
    per = rows.groupBy(concept, cluster).agg(F.sum(score).alias("s")).where(F.col("s") >= least)
    return per.groupBy(concept).agg(F.count("*").alias("clusters"), F.sum("s").alias("total")).where((F.col("clusters") >= clusters) & (F.col("total") >= total))


def motifs(tokens: DataFrame, candidate: Column, least: int = 3, journals: int = 2, lift: float = 2.0) -> DataFrame:
    """(token, articles, lift) of tokens more frequent among candidate articles than elsewhere; ``tokens`` has id, journal, token."""
    rows = tokens.select("id", "journal", "token", candidate.alias("c")).distinct()
    n = rows.agg(F.countDistinct(F.when(F.col("c"), F.col("id"))).alias("nc"), F.countDistinct(F.when(~F.col("c"), F.col("id"))).alias("nb"))
    g = rows.groupBy("token").agg(F.count(F.when(F.col("c"), 1)).alias("articles"), F.count(F.when(~F.col("c"), 1)).alias("back"), F.countDistinct(F.when(F.col("c"), F.col("journal"))).alias("journals"))
    value = (F.col("articles") / F.col("nc")) / ((F.col("back") + 1) / (F.col("nb") + 1))
    return g.crossJoin(F.broadcast(n)).withColumn("lift", value).where((F.col("articles") >= least) & (F.col("journals") >= journals) & (F.col("lift") >= lift)).select("token", "articles", "lift")


PAIR_BUCKETS = 1 << 20


def companions(tokens: DataFrame, motif: DataFrame, mates: DataFrame, share: float = 0.4, buckets: int = PAIR_BUCKETS) -> DataFrame:
    """(token, mate, together): for each motif the token that most of its articles have too, if ``share`` of them do; ``mates`` has the tokens distinctive enough to be one.

    Pairs are counted in two passes over the motifs and mates of each article. The first adds up hashed pairs in at most ``buckets``
    counters, which all tasks then get; a pair whose counter doesn't reach the share can't either, so only the
    others are shuffled and counted by themselves.
    """
    flags = tokens.select("id", "token").distinct().join(motif.select("token", "articles"), "token", "left").join(mates.select("token", F.lit(True).alias("mate")).distinct(), "token", "left")
    flags = flags.where("articles IS NOT NULL OR mate")
    folder = scratch(tokens.sparkSession, "marked")  # read in both passes
    lists = lambda cond, value: F.collect_list(F.when(cond, value))
    flags.groupBy("id").agg(lists(F.col("articles").isNotNull(), F.struct("token", "articles")).alias("ms"), lists(F.col("mate"), F.col("token")).alias("ts")).where("size(ms) > 0 AND size(ts) > 0").write.parquet(folder)
    marked = tokens.sparkSession.read.schema(f"id {tokens.schema['id'].dataType.simpleString()}, ms array<struct<token:string,articles:bigint>>, ts array<string>").parquet(folder)
    pairs = marked.select(F.explode("ms").alias("m"), "ts").select("m.token", "m.articles", F.explode("ts").alias("mate")).where("token <> mate")
    pairs = pairs.withColumn("bucket", F.pmod(F.xxhash64("token", "mate"), F.lit(buckets)))
    counters = pairs.groupBy("bucket").agg(F.count("*").alias("n"))  # ``buckets`` rows at most
    hopeful = pairs.join(F.broadcast(counters), "bucket").where(F.col("n") >= share * F.col("articles"))
    counted = hopeful.groupBy("token", "mate", "articles").agg(F.count("*").alias("together")).where(F.col("together") >= share * F.col("articles"))
    best = counted.groupBy("token").agg(F.max_by(F.struct("mate", "together"), F.struct("together", "mate")).alias("m"))
    return best.select("token", "m.mate", "m.together")


def greedy_motifs(rows: DataFrame, limit: int = 4) -> list[str]:
    """The best-scored motifs of which none is part of another chosen before: each time the best of all rows that are still apart from the chosen ones."""
    words = F.array_compact(F.array("token", "mate"))
    folder = scratch(rows.sparkSession, "motifs")  # worked out once, then read again for each choice
    rows.select("token", "score", words.alias("words")).write.parquet(folder)
    left, out = rows.sparkSession.read.parquet(folder), []
    while len(out) < limit and (best := left.orderBy(F.desc("score"), "token").first()):
        out.append(" ".join(sorted(set(best.words))))
        chosen = F.array(*map(F.lit, best.words))
        left = left.where((F.size(F.array_except("words", chosen)) > 0) & (F.size(F.array_except(chosen, F.col("words"))) > 0))
    return out


def single(value: Column, weight: Column | None = None) -> Column:
    """One value of a facet, of weight 1 unless given; null is none."""
    entry = F.struct(value.cast("string").alias("value"), (F.lit(1.0) if weight is None else weight.cast("double")).alias("weight"))
    return F.when(value.isNotNull(), F.array(entry))


def several(values: Column) -> Column:
    """Each element of an array as a value of a facet, of weight 1."""
    return F.transform(values, lambda v: F.struct(v.cast("string").alias("value"), F.lit(1.0).alias("weight")))


def facets(rows: DataFrame, by: str, parts: dict[str, tuple[Column, int | None]]) -> DataFrame:
    """(by, facet, value, weight, rank): what each group of rows has most of, for several facets at once.

    A facet is made by single() or several(), with the number of values to keep, all where None.  Weights are summed; equal
    ones rank by value.  All facets of a row leave it together and are summed before and after one shuffle; a null facet
    adds nothing.  The rank is within a group and facet, of which there are as many rows as it has different values.
    """
    tagged = [F.transform(values, _entry(name)) for name, (values, _) in parts.items()]
    found = rows.select(by, F.explode(F.flatten(F.array_compact(F.array(*tagged)))).alias("e")).groupBy(by, "e.facet", "e.value").agg(F.round(F.sum("e.weight"), 6).alias("weight"))
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy(by, "facet").orderBy(F.desc("weight"), "value")))
    kept = [F.col("facet").eqNullSafe(name) if most is None else (F.col("facet") == name) & (F.col("rank") <= most) for name, (_, most) in parts.items()]
    return ranked.where(reduce(lambda a, b: a | b, kept))


def _entry(name: str):
    return lambda e: F.struct(F.lit(name).alias("facet"), e["value"].alias("value"), e["weight"].alias("weight"))


def mean_or_fallback(rows: DataFrame, value: str, scope: Column, order: list[Column], recent: int, least: int, default: float) -> DataFrame:
    """(estimate): mean of the ``recent`` latest positive values in scope if there are enough, else of all, else ``default``."""
    positive = rows.where(F.col(value) > 0)
    last = positive.where(scope).orderBy(*order).limit(recent).agg(F.count("*").alias("n"), F.avg(value).alias("a"))
    every = positive.orderBy(*order).limit(recent).agg(F.count("*").alias("m"), F.avg(value).alias("b"))
    return last.crossJoin(every).select(F.when(F.col("n") >= least, F.col("a")).when(F.col("m") >= least, F.col("b")).otherwise(F.lit(default)).alias("estimate"))


def rollup_calls(calls: DataFrame, by: str, start: str | None = None, end: str | None = None) -> DataFrame:
    """(key, calls, cost, tokens) by endpoint, model or day, bounds inclusive, all statuses."""
    day = F.date_format("ts", "yyyy-MM-dd")
    key = {"endpoint": F.col("endpoint"), "model": F.col("model"), "day": day}[by]
    rows = calls.where(day >= start) if start else calls
    rows = rows.where(day <= end) if end else rows
    return rows.groupBy(key.alias("key")).agg(F.count("*").alias("calls"), F.round(F.sum("cost"), 4).alias("cost"), F.sum("tokens_in").alias("tokens"))


def cache_hits(calls: DataFrame, critical: list[str], floor: float = 0.8, least: int = 20) -> DataFrame:
    """Token-weighted hit rate by endpoint and model over calls that succeeded, and whether a critical one is too low."""
    g = calls.where(F.col("status").isNull() | (F.col("status") == "ok")).groupBy("endpoint", "model").agg(F.count("*").alias("calls"), F.sum("tokens_cached").alias("hit"), F.sum("tokens_in").alias("miss"), F.avg("cost").alias("mean_cost"))
    rate = F.when(F.col("hit") + F.col("miss") > 0, F.col("hit") / (F.col("hit") + F.col("miss"))).otherwise(0.0)
    warn = (rate < floor) & (F.col("calls") >= least) & F.col("endpoint").isin(critical)
    return g.select("endpoint", "model", "calls", F.round(rate, 6).alias("hit_rate"), F.round("mean_cost", 6).alias("mean_cost"), warn.alias("warning"))


def topic_groups(topics: DataFrame, names: int = 8) -> DataFrame:
    """(domain, field, subfield, weight, n, names): topics by their place in the hierarchy, at least 1 a topic, and the names of the best."""
    place = ["domain", "field", "subfield"]
    total = topics.groupBy(*place).agg(F.sum(F.greatest("score", F.lit(1.0))).alias("weight"), F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy(*place).orderBy(F.desc("score"), "name"))
    best = topics.withColumn("_r", rank).where(F.col("_r") <= names).groupBy(*place).agg(F.array_sort(F.collect_list(F.struct("_r", "name"))).alias("b"))
    return total.join(best, place).select(*place, "weight", "n", F.array_join(F.transform("b", lambda x: x["name"]), "; ").alias("names"))


def inferred_signals(topics: DataFrame, needles: dict[str, list[str]]) -> DataFrame:
    out = None
    for label, words in needles.items():
        hit = F.lit(False)
        for w in words:
            hit = hit | F.contains(F.lower("name"), F.lit(w))
        one = topics.where(hit).agg(F.countDistinct("name").alias("n")).select(F.lit(label).alias("label"), "n")
        out = one if out is None else out.unionByName(one)
    return out.where("n > 0")


def profile_form(rows: DataFrame) -> DataFrame:
    """For each source key over all works: works, stances, the most frequent label, first and last dominant stance and whether it shifted.

    ``rows`` has work, year, key, label, stance, sign.  The dominant stance of a work is its most frequent, ties by name.
    """
    per = rows.groupBy("key", "work", "year", "stance").agg(F.count("*").alias("k")).groupBy("key", "work", "year").agg(F.min_by("stance", F.struct(-F.col("k"), "stance")).alias("dominant"))
    ends = per.groupBy("key").agg(F.min_by("dominant", F.struct("year", "work")).alias("first"), F.max_by("dominant", F.struct("year", "work")).alias("last"))
    label = rows.groupBy("key", "label").agg(F.count("*").alias("k")).groupBy("key").agg(F.min_by("label", F.struct(-F.col("k"), "label")).alias("label"))
    total = rows.groupBy("key").agg(F.countDistinct("work").alias("works"), F.count(F.when(F.col("sign") > 0, 1)).alias("plus"), F.count(F.when(F.col("sign") < 0, 1)).alias("minus"))
    return total.join(ends, "key").join(label, "key").withColumn("shifted", F.col("first") != F.col("last"))


def cooccurrence(rows: DataFrame, work: str, key: str) -> DataFrame:
    """(a, b, n): how many works name both sources."""
    r = rows.select(work, key).distinct()
    return r.select(work, F.col(key).alias("a")).join(r.select(work, F.col(key).alias("b")), work).where("a < b").groupBy("a", "b").agg(F.count("*").alias("n"))


def periods(rows: DataFrame, year: str, key: str, size: int) -> DataFrame:
    """(period, n, new, dropped): keys of blocks of years against the last block that has any; the first has no change."""
    low = rows.agg(F.min(year).alias("low"))
    blocks = rows.crossJoin(F.broadcast(low)).withColumn("period", F.floor((F.col(year) - F.col("low")) / size)).select("period", key).distinct()
    order = Window.orderBy("period")
    names = blocks.select("period").distinct().withColumn("i", F.dense_rank().over(order))  # a row a period
    b = blocks.join(F.broadcast(names), "period")
    prev = b.select((F.col("i") + 1).alias("i"), key, F.lit(1).alias("was"))
    both = b.select("i", key, F.lit(1).alias("now")).join(prev, ["i", key], "full_outer")
    g = both.groupBy("i").agg(F.count("now").alias("n"), F.count(F.when(F.col("was").isNull(), 1)).alias("new"), F.count(F.when(F.col("now").isNull(), 1)).alias("dropped"))
    return g.join(F.broadcast(names), "i").select("period", "n", F.when(F.col("i") > 1, F.col("new")).alias("new"), F.when(F.col("i") > 1, F.col("dropped")).alias("dropped"))


def saturation(works: DataFrame, coupled: DataFrame, levels: list[int]) -> DataFrame:
    """(level, grp, rate): share of authors coupled when only their first N recent and N most cited works count."""
    w = Window.partitionBy("author")
    ranked = works.withColumns({"r": F.row_number().over(w.orderBy(F.desc("date"), "work")), "c": F.row_number().over(w.orderBy(F.desc("cited"), "work"))})
    hit = ranked.join(coupled.select("work").distinct().withColumn("y", F.lit(1)), "work", "left")
    best = hit.groupBy("author", "grp").agg(F.min(F.when(F.col("y") == 1, F.least("r", "c"))).alias("need"))
    at = best.withColumn("level", F.explode(F.array(*map(F.lit, levels))))
    return at.groupBy("level", "grp").agg(F.avg(F.when(F.col("need") <= F.col("level"), 1.0).otherwise(0.0)).alias("rate"))
