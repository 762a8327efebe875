"""Search over articles: whole words, patterns, weighted terms, classification by patterns."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# fixed values: what a verdict and a field weigh, and terms too general to count fully
VERDICT_SCORE = {"pflichtlektuere": 6, "lesenswert": 4, "scannen": 1, "ignorieren": -4}
FIELD_WEIGHTS = {"title": 5, "authors": 4, "topics": 4, "concepts": 3, "signal_group": 3, "subgroup": 3, "abstract": 2, "entry": 1}
GENERIC_TERMS = "art arts bildung creative creativity culture cultural digital education educational kunst learning media school".split()
# fixed values: titles that are no articles
STOCK_TITLES = "editorial,erratum,corrigendum,book review,table of contents,contributors,index,masthead,call for papers,obituary".split(",")


class SearchError(ValueError):
    """A query that is no valid pattern."""


def blob(columns: Sequence[str]) -> Column:
    """All fields as one text; missing ones are empty."""
    return F.concat_ws(" ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])


def parts(query: str) -> list[str]:
    """Tokens and quoted phrases of a query."""
    return [a or b for a, b in re.findall(r'"([^"]+)"|(\S+)', query)]


def patterns(query: str) -> list[str]:
    """A whole-word pattern for each token and quoted phrase of a query."""
    return [rf"(?isU)(?<!\w){re.escape(p)}(?!\w)" for p in parts(query)]


def matches(text: Column, query: str, regex: bool = False) -> Column:
    """The text has all tokens as whole words; in pattern mode, it matches the query as it stands."""
    if regex:
        try:
            re.compile(query)
        except re.error as e:
            raise SearchError(str(e)) from e
        return text.rlike(f"(?is){query}")
    found = patterns(query)
    return reduce(lambda a, b: a & b, [text.rlike(p) for p in found]) if found else F.lit(False)


def any_term(columns: Sequence[str], terms: Sequence[str]) -> Column:
    low = [F.lower(F.coalesce(F.col(c), F.lit(""))) for c in columns]
    return reduce(lambda a, b: a | b, [F.contains(c, F.lit(t)) for t in terms for c in low])


def weighted_score(fields: dict[str, Column], terms: Sequence[str], phrases: Sequence[str], verdict: Column, year: Column) -> Column:
    """Verdict, field and term weights, recency; three less where only general terms hit."""
    weight = {t: max(0.45, 2.2 - 0.12 * i) * (0.55 if t in GENERIC_TERMS else 1.0) for i, t in enumerate(terms)}
    weight |= {p: max(1.6, 3.0 - 0.2 * i) for i, p in enumerate(phrases)}
    hit = lambda c, t: F.when(F.contains(F.lower(c), F.lit(t)), 1.0).otherwise(0.0)
    total = reduce(lambda a, b: a + b, [hit(c, t) * FIELD_WEIGHTS.get(f, 1) * w for f, c in fields.items() for t, w in weight.items()])
    special = reduce(lambda a, b: a + b, [hit(c, t) for c in fields.values() for t in weight if t not in GENERIC_TERMS], F.lit(0.0))
    general = reduce(lambda a, b: a + b, [hit(c, t) for c in fields.values() for t in weight if t in GENERIC_TERMS], F.lit(0.0))
    base = reduce(lambda a, kv: a.when(verdict == kv[0], kv[1]), list(VERDICT_SCORE.items())[1:], F.when(verdict == "pflichtlektuere", 6)).otherwise(0)
    recent = F.greatest(F.least((year - 2018) * 0.15, F.lit(1.5)), F.lit(0.0))
    return base + total + recent + F.when((special == 0) & (general > 0), -3.0).otherwise(0.0)


def ranked(rows: DataFrame, score: str, verdict: str, key: str, k: int) -> DataFrame:
    """The ``k`` best positive scores, articles that aren't to be ignored first."""
    return rows.where(F.col(score) > 0).orderBy((F.col(verdict) == "ignorieren").asc(), F.desc(F.round(score, 6)), key).limit(k)


def top_per_unit(rows: DataFrame, text: str, key: str, units: dict[str, list[str]], k: int) -> DataFrame:
    """(unit, key, hits): the ``k`` rows of each argument unit with most of its terms; the units of a question are literals of the plan."""
    low = F.lower(F.col(text))
    scores = F.array(*[F.struct(F.lit(u).alias("unit"), F.size(F.filter(F.array(*map(F.lit, terms)), lambda t: F.contains(low, t))).alias("hits")) for u, terms in units.items()])
    scored = rows.select(key, F.explode(F.filter(scores, lambda x: x["hits"] > 0)).alias("x")).select("x.unit", key, "x.hits")
    return scored.withColumn("r", F.row_number().over(Window.partitionBy("unit").orderBy(F.desc("hits"), key))).where(F.col("r") <= k).drop("r")


def term_hits(text: Column, terms: Sequence[str]) -> Column:
    """The terms that the text contains, sorted."""
    return F.array_sort(F.filter(F.array(*map(F.lit, terms)), lambda t: F.contains(F.lower(text), t)))


def junk_title(title: Column) -> Column:
    return F.trim(F.lower(title)).rlike(rf"^({'|'.join(map(re.escape, STOCK_TITLES))})(:| |$)")


def cue_hit(cue: str, text: Column) -> Column:
    """A single word must stand alone; a phrase may stand anywhere."""
    cue = cue.strip().lower()
    return F.contains(F.lower(text), F.lit(cue)) if " " in cue and len(cue) > 3 else F.lower(text).rlike(rf"\b{re.escape(cue)}\b")


def labels(text: Column, rules: dict[str, list[str]]) -> Column:
    """All labels of which a pattern matches, sorted."""
    return F.array_sort(F.array_compact(F.array(*[F.when(reduce(lambda a, b: a | b, [text.rlike(f"(?i){p}") for p in ps]), k) for k, ps in rules.items()])))


def project_hits(text: Column, projects: dict[str, dict]) -> Column:
    """The two best projects: phrases (2 with several words, else 1) and overlap and context within limits, behind gates."""
    found = []
    for key, p in projects.items():
        count = lambda words, w=1: reduce(lambda a, b: a + b, [F.when(cue_hit(x, text), w(x) if callable(w) else w).otherwise(0) for x in words], F.lit(0))
        phrase = count(p["phrases"], lambda x: 2 if " " in x else 1)
        score = phrase + F.least(count(p.get("overlap", [])), F.lit(4)) + F.least(count(p.get("context", [])), F.lit(2))
        hard = count(p.get("hard_block", [])) > 0
        blocked = (count(p.get("block", [])) > 0) & (count(p.get("rescue", [])) == 0)
        ok = ~hard & ~blocked & (score >= p.get("least", 2)) & ((phrase > 0) | (score >= p.get("strong", 4)))
        found.append(F.when(ok, F.struct((-score).alias("s"), F.lit(key).alias("k"))))
    return F.transform(F.slice(F.array_sort(F.array_compact(F.array(*found))), 1, 2), lambda x: x["k"])


def abstract_choice(*sources: Column) -> Column:
    """The first source that isn't blank; text that is raw JSON doesn't count."""
    return F.coalesce(*[F.when((F.length(F.trim(c)) > 0) & ~F.startswith(F.trim(c), F.lit("{")), c) for c in sources])
