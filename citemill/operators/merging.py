"""Identity, upserts and duplicate merging as joins and aggregations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citemill.functions.text import blank_as_null, doi_full, first_author_surname, fold


def content_id(doi: Column, url: Column, journal: Column, title: Column) -> Column:
    """First 32 hex digits of the SHA-256 of the DOI, else the address, else journal and title."""
    seed = F.coalesce(F.lower(blank_as_null(F.trim(doi))), blank_as_null(F.trim(url)), F.concat_ws("::", F.coalesce(journal, F.lit("")), F.coalesce(title, F.lit(""))))
    return F.substring(F.sha2(seed, 256), 1, 32)


def canonical_id(doi: Column, title: Column, year: Column, author: Column) -> Column:
    norm = doi_full(doi)
    seed = F.concat_ws("|", fold(F.coalesce(title, F.lit(""))), F.coalesce(year.cast("string"), F.lit("")), fold(first_author_surname(author)))
    return F.when(norm != "", F.concat(F.lit("doi:"), norm)).otherwise(F.concat(F.lit("hash:"), F.substring(F.sha1(seed), 1, 16)))


def upsert(old: DataFrame, new: DataFrame, key: str, rules: dict[str, str]) -> DataFrame:
    """``old`` with the rows of ``new``: one full outer join, a rule for each column.

    Rules: incoming (wins whatever it is), keep (existing wins), prefer_text (incoming unless blank),
    prefer_list (incoming unless empty), coalesce (incoming unless null), greatest, earliest.
    """
    a, b = old.alias("a"), new.alias("b")
    joined = a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}"), "full_outer")
    is_new, has_old = F.col(f"b.{key}").isNotNull(), F.col(f"a.{key}").isNotNull()
    out = [F.coalesce(F.col(f"b.{key}"), F.col(f"a.{key}")).alias(key)]
    for c, rule in rules.items():
        x, y = F.col(f"a.{c}"), F.col(f"b.{c}") if c in new.columns else F.lit(None)
        value = {
            "incoming": F.when(is_new, y).otherwise(x),
            "keep": F.when(has_old, x).otherwise(y),
            "prefer_text": F.when(is_new & (F.length(F.trim(y.cast("string"))) > 0), y).otherwise(x),
            "coalesce": F.coalesce(y, x),
            "greatest": F.greatest(x, y),
            "earliest": F.least(x, y),
        }.get(rule)
        if value is None:
            value = F.when(F.size(y) > 0, y).otherwise(x)
        out.append(value.alias(c))
    return joined.select(*out)


def replace_children(old: DataFrame, new: DataFrame, parent: str) -> DataFrame:
    """Children of the parents in ``new`` are replaced as a set; the others stay."""
    return old.join(new.select(parent).distinct(), parent, "left_anti").unionByName(new, allowMissingColumns=True)


def first_seen(rows: DataFrame, keys: list[str], at: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.min(at).alias("first_seen"), F.max(at).alias("last_seen"))


def merge_hashed(pubs: DataFrame, key: str, has_doi: str, title: str, year: str, author: str) -> DataFrame:
    """(key, target): items without DOI go to the first DOI item of equal title, equal or missing year and compatible author.

    The join is an equi join on the title; null years and blank authors are settled in the filter after it.
    """
    a = pubs.where(~F.col(has_doi)).select(F.col(key).alias("_k"), F.col(title).alias("_t"), F.col(year).alias("_y"), F.col(author).alias("_a"))
    b = pubs.where(F.col(has_doi)).select(F.col(key).alias("target"), F.col(title).alias("_t"), F.col(year).alias("_y2"), F.col(author).alias("_a2"))
    fits = (F.col("_y").isNull() | F.col("_y2").isNull() | (F.col("_y") == F.col("_y2"))) & ((F.col("_a") == "") | (F.col("_a2") == "") | (F.col("_a") == F.col("_a2")))
    first = a.join(b, "_t").where(fits).groupBy("_k").agg(F.min("target").alias("target"))
    return pubs.select(F.col(key)).join(first, F.col(key) == F.col("_k"), "left").select(key, F.coalesce("target", key).alias("target"))


def merge_effects(mapping: DataFrame, pubs: DataFrame, provenance: DataFrame, refs: DataFrame, key: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What a merge (``key``, target) leaves: publications, their provenance and their references.

    A merged publication goes; where it came from is known of its target from then on, once each; its references go
    with it, as the target has its own.  Rows of publications that the mapping doesn't have stay as they are.
    """
    gone = mapping.where(F.col(key) != F.col("target"))
    away = gone.select(key)
    moved = provenance.join(gone, key, "left").withColumn(key, F.coalesce("target", key)).select(*provenance.columns).distinct()
    return pubs.join(away, key, "left_anti"), moved, refs.join(away, key, "left_anti")


def recent_and_cited(works: DataFrame, by: str, date: str, cited: str, key: str, n: int) -> DataFrame:
    """The ``n`` most recent and ``n`` most cited works of each group, with a tag that says which."""
    w = Window.partitionBy(by)
    ranked = works.withColumns({"_r": F.row_number().over(w.orderBy(F.desc(date), key)), "_c": F.row_number().over(w.orderBy(F.desc(cited), key))})
    tag = F.when((F.col("_r") <= n) & (F.col("_c") <= n), "both").when(F.col("_r") <= n, "recent").otherwise("cited")
    return ranked.where((F.col("_r") <= n) | (F.col("_c") <= n)).withColumn("selection", tag).drop("_r", "_c")


def changed(files: DataFrame, seen: DataFrame, key: str, mtime: str) -> DataFrame:
    """Files that are new, of unknown time, or newer than when they were last read."""
    old = seen.select(key, F.col(mtime).alias("_m"))
    return files.join(old, key, "left").where(F.col("_m").isNull() | F.col(mtime).isNull() | (F.col(mtime) > F.col("_m"))).drop("_m")
