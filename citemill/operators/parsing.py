"""Parsers of texts, pages and model output, as DataFrame operations."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citemill.functions.text import boilerplate, squeeze, strip_tags

# fixed values: words that may lead a source's label, and particles that belong to a surname
LEADING = ("see", "source", "cf", "vgl", "the", "der", "die", "das", "in", "nach", "term")
PARTICLES = ("van", "von", "de", "der", "den", "del", "di", "la", "le", "du", "ten")


def _plain(c: Column) -> Column:
    return squeeze(F.regexp_replace(F.regexp_replace(c, r"[*_`#]+", ""), r"^\s*[A-Za-z]+:\s*", ""))


def source_key(label: Column) -> Column:
    """``surname:year`` of a label, whatever markup, prefix or function word leads it; particles stay with the name."""
    plain = F.lower(_plain(label))
    lead = "|".join(LEADING)
    start = F.regexp_replace(plain, rf"^((?:{lead})\s+)+(?=(?:{'|'.join(PARTICLES)})\s|\S)", "")
    name = F.regexp_extract(start, rf"(?U)^((?:(?:{'|'.join(PARTICLES)})\s+)*[\w'-]+)", 1)
    year = F.regexp_extract(start, r"\b((?:1[6-9]|20)\d{2})\b", 1)
    return F.when(name != "", F.concat(name, F.lit(":"), year)).otherwise(year)


def term_key(label: Column) -> Column:
    return F.regexp_replace(F.lower(_plain(label)), r"(?U)[^\w ]+", "")


def inverted_index(words: Column) -> Column:
    """array of struct(word, positions) of an array of words, by one sort inside the row."""
    pairs = F.sort_array(F.transform(words, lambda w, i: F.struct(w.alias("word"), i.alias("p"))))
    head = lambda s: F.filter(F.sequence(F.lit(1), F.size(s)), lambda i: (i == 1) | (F.element_at(s, i)["word"] != F.element_at(s, F.greatest(i - 1, F.lit(1)))["word"]))
    entry = lambda s, a, b: F.struct(F.element_at(s, a)["word"].alias("word"), F.transform(F.sequence(a, b - 1), lambda i: F.element_at(s, i)["p"]).alias("positions"))
    # one-element arrays name what the next step uses twice, so that it is worked out once
    sorted_ = F.transform(F.array(pairs), lambda s: F.struct(s.alias("s"), F.when(F.size(s) > 0, head(s)).otherwise(F.array().cast("array<int>")).alias("h")))
    runs = F.transform(sorted_, lambda x: F.transform(x["h"], lambda a, i: entry(x["s"], a, F.coalesce(F.get(x["h"], i + 1), F.size(x["s"]) + 1))))
    return F.element_at(runs, 1)


def rebuilt(entries: Column) -> Column:
    """The text of struct(word, positions) entries, words in the order of their positions; of two words at one place the later wins."""
    pairs = F.sort_array(F.flatten(F.transform(entries, lambda e: F.transform(e["positions"], lambda p: F.struct(p.alias("p"), e["word"].alias("w"))))))
    kept = F.transform(F.array(pairs), lambda s: F.filter(s, lambda x, i: F.coalesce(F.get(s, i + 1)["p"] != x["p"], F.lit(True))))
    return F.array_join(F.transform(F.element_at(kept, 1), lambda x: x["w"]), " ")


def html_abstract(html: Column, patterns: list[str], metas: list[str], least: int = 100) -> Column:
    """The longest text of more than ``least`` characters that a pattern finds, else the first such meta tag; null without."""
    hits = F.array(*[F.regexp_replace(strip_tags(F.regexp_extract(html, p, 1)), r"^Abstract\s*", "") for p in patterns])
    good = F.filter(hits, lambda t: (F.length(t) > least) & ~boilerplate(t))
    longest = F.array_max(F.transform(good, lambda t: F.struct(F.length(t).alias("n"), t.alias("t"))))["t"]
    found = []
    for m in metas:
        for p in (rf"""(?is)<meta\s[^>]*?(?:name|property)=["']{re.escape(m)}["']\s+content=["'](.*?)["']""", rf"""(?is)<meta\s+content=["'](.*?)["']\s[^>]*?(?:name|property)=["']{re.escape(m)}["']"""):
            t = strip_tags(F.regexp_extract(html, p, 1))
            found.append(F.when((F.length(t) > least) & ~boilerplate(t), t))
    return F.coalesce(longest, *found)


def html_references(pages: DataFrame, html: str, families: list[str], least: int = 20) -> DataFrame:
    """A row for each list item, of the first family of items that a page has, with its text and first DOI."""
    lists = [F.regexp_extract_all(F.col(html), F.lit(p), F.lit(1)) for p in families]
    chosen = F.coalesce(*[F.when(F.size(x) > 0, x) for x in lists])
    rows = pages.withColumn("_li", F.explode(chosen)).withColumn("reference", strip_tags(F.col("_li")))
    doi = F.lower(F.regexp_extract("_li", r"(10\.\d{4,9}/[^\s\"<>]+)", 1))
    return rows.where(F.length("reference") > least).withColumn("doi", doi).drop("_li", html)


def _lines(rows: DataFrame, text: str) -> DataFrame:
    return rows.select("*", F.posexplode(F.split(text, "\n")).alias("_i", "_line"))


def reference_section(rows: DataFrame, key: str, text: str, header: str, toc: str, volume: str | None) -> DataFrame:
    """Where the references begin: after the last header past 30 % of the lines, or the first one of a volume's parts;
    else the last quarter of 40 lines or more."""
    lines = F.split(text, "\n")
    n = F.size(lines)
    trimmed = F.transform(lines, lambda x, i: F.struct(i.alias("i"), F.trim(x).alias("t")))
    heads = F.filter(trimmed, lambda x: (x["i"] >= F.floor(n * 0.3)) & x["t"].rlike(header) & ~x["t"].rlike(toc))
    last = F.array_max(F.transform(heads, lambda x: x["i"]))
    at = last if volume is None else F.coalesce(F.array_min(F.transform(F.filter(heads, lambda x: x["t"].rlike(volume)), lambda x: x["i"])), last)
    found = F.when(at.isNotNull(), "header").when(n >= 40, "fallback").otherwise("none")
    first = F.when(at.isNotNull(), at + 1).when(n >= 40, F.floor(n * 0.75)).cast("long")
    rows = rows.withColumns({"first_line": first, "found": found})
    return rows.withColumn("section", F.when(F.col("first_line").isNotNull(), F.array_join(F.slice(F.split(text, "\n"), (F.col("first_line") + 1).cast("int"), F.size(F.split(text, "\n"))), "\n")))


def cut_at_line(text: Column, pattern: str) -> Column:
    """The text up to the first line that matches, without it."""
    lines = F.split(text, "\n")
    at = F.array_min(F.transform(F.filter(F.transform(lines, lambda x, i: F.struct(i.alias("i"), x.alias("t"))), lambda x: x["t"].rlike(pattern)), lambda x: x["i"]))
    return F.when(at.isNull(), text).otherwise(F.array_join(F.slice(lines, F.lit(1), at), "\n"))


def split_citations(rows: DataFrame, key: str, text: str, least: int = 20) -> DataFrame:
    """(key, citation): lines are joined to the last line that begins with a surname; blank lines end a citation."""
    lines = _lines(rows.select(key, text), text)
    blank = F.trim("_line") == ""
    start = F.col("_line").rlike(r"(?U)^[ \t]{0,3}\p{Lu}[\p{L}-]+(,| and | & )")
    number = F.sum(F.when(blank | start, 1).otherwise(0)).over(Window.partitionBy(key).orderBy("_i"))
    grouped = lines.withColumn("_g", number).where(~blank).groupBy(key, "_g").agg(F.array_sort(F.collect_list(F.struct("_i", F.trim("_line").alias("t")))).alias("_l"))
    return grouped.select(key, squeeze(F.array_join(F.transform("_l", lambda x: x["t"]), " ")).alias("citation")).where(F.length("citation") >= least)


def text_damage(rows: DataFrame, text: str) -> DataFrame:
    """Share of wide-gap lines, line-end hyphens and glued words per 1000 characters, and a label."""
    t = F.col(text)
    long_ = F.filter(F.split(t, "\n"), lambda x: F.length(F.trim(x)) > 40)
    wide = F.size(F.filter(long_, lambda x: x.rlike(r"\S {3,}\S")))
    share = F.when(F.size(long_) > 0, wide / F.size(long_)).otherwise(F.lit(0.0))
    chars = F.greatest(F.length(t), F.lit(1))
    rate = lambda p: F.lit(1000.0) * F.regexp_count(t, F.lit(p)) / chars
    rows = rows.withColumns({"wide_share": share, "hyphens": rate(r"\p{L}-\n"), "glue": rate(r"\p{Ll}\p{Lu}")})
    return rows.withColumn("label", F.when(F.col("wide_share") > 0.2, "columns").when(F.col("glue") > 2, "glued").when(F.col("hyphens") > 3, "hyphenated").otherwise("fine"))


def _repair(raw: str | None) -> tuple[list[str], str | None, str]:
    """Lists as lists, the core statement by a fixed order of fields, and how the text had to be mended."""
    how, entry = "none", None
    for method, candidate in (("none", raw), ("quotes", raw and re.sub(r'(?<=[^\[{:,\s\\])"(?=[^\]}:,\s])|(?<=\s)"(?=\w+"\s)|(?<=\w)"(?=\s\w)', r"\"", raw))):
        try:
            entry = json.loads(candidate or "")
            how = method
            break
        except ValueError:
            continue
    if not isinstance(entry, dict):
        return [], None, "unparsable"
    refs = entry.get("refs") or []
    if isinstance(refs, str):
        refs, how = [x.strip() for x in re.split(r"[;\n]", refs) if x.strip()], "split"
    core = next((str(entry[k]) for k in ("core", "thesis", "summary", "reason") if entry.get(k)), None)
    return [str(x) for x in refs], core, how


def repair_entries(rows: DataFrame, raw: str) -> DataFrame:
    """``rows`` with refs, core and repair, parsed from model output that may be damaged."""

    @F.pandas_udf("refs array<string>, core string, repair string")
    def run(s: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_repair(x) for x in s], columns=["refs", "core", "repair"])

    return rows.withColumn("_r", run(raw)).select(*[c for c in rows.columns if c != raw], "_r.refs", "_r.core", "_r.repair")


def fields(c: Column) -> Column:
    """``KEY: value | KEY: value`` as a map."""
    return F.str_to_map(F.regexp_replace(F.regexp_replace(c, r"\s*\|\s*", "|"), r":\s*", ":"), F.lit(r"\|"), F.lit(":"))


def tag_body(c: Column, tag: str) -> Column:
    return F.regexp_extract(c, rf"(?is)<{tag}>\s*(.*?)\s*</{tag}>", 1)


def verdict_lines(rows: DataFrame, batch: DataFrame, key: str) -> DataFrame:
    """Lines ``[id] verdict — reason`` of ids that the batch asked for."""
    pattern = r"^\[(\d+)\]\s*([A-Za-z]+)\s*(?:—|-)\s*(.+)$"
    g = lambda i: F.regexp_extract("line", pattern, i)
    out = rows.where(F.col("line").rlike(pattern)).withColumns({key: g(1).cast("long"), "verdict": F.lower(g(2)), "reason": F.trim(g(3))})
    return out.join(batch, key, "left_semi")
