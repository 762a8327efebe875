"""URL rules whose block decisions reach aliases: redirects and canonical links join URLs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citemill.llm.components import components
from citemill.llm.storage import cut, temporary

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MOST_LITERAL_RULES = 2000
# fixed values: entities that stand in addresses inside attributes, the ampersand's last
ENTITIES = (("&quot;", '"'), ("&#34;", '"'), ("&#39;", "'"), ("&#x27;", "'"), ("&#47;", "/"), ("&#x2F;", "/"), ("&#38;", "&"), ("&#x26;", "&"), ("&amp;", "&"))
Rule = tuple[str, str, str]  # host, path, allow or block


def _after(url: Column) -> Column:
    """What follows the first ``://``; null without one."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(_after(url), r"^[^/?#]*", 0), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_after(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def _key(url: Column) -> Column:
    """What two spellings of one address share: scheme, letter case of the host and fragment don't count."""
    return F.when(_after(url).isNotNull(), F.concat(host_of(url), F.regexp_extract(_after(url), r"^[^/?#]*([^#]*)", 1)))


def _suffixes(host: Column) -> Column:
    """The host and its parent domains."""
    parts = F.split(host, r"\.", -1)
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))


def _check(rules: list[Rule]) -> list[Rule]:
    for host, path, verdict in rules:
        if verdict not in ("allow", "block") or not host or not path.startswith("/"):
            raise ValueError(f"not a rule: {(host, path, verdict)}")
    return rules


def match_rules(pages: DataFrame, rules: list[Rule], url: str = "url") -> DataFrame:
    """``pages`` with _host, _path and _rule, the longest rule that fits as struct(rule, verdict), or null.

    The list is a parameter on the driver.  Up to MOST_LITERAL_RULES of them become a map literal
    that each row looks its domains up in, so nothing is shuffled; more are joined by domain.
    """
    pages = pages.withColumns({"_host": host_of(F.col(url)), "_path": path_of(F.col(url))})
    rules = _check(rules)
    if not rules:
        return pages.withColumn("_rule", F.lit(None).cast("struct<rule:string,verdict:string>"))
    by_host: dict[str, list[Rule]] = {}
    for r in rules:
        by_host.setdefault(r[0], []).append(r)
    best = lambda c: F.struct(c["size"], (c["verdict"] == "allow").alias("allows"), c["rule"], c["verdict"], c["path"])
    if len(rules) <= MOST_LITERAL_RULES:
        entries = []
        for host, own in by_host.items():
            items = [F.struct(F.lit(len(h + p)).alias("size"), F.lit(v == "allow").alias("allows"), F.lit(h + p).alias("rule"), F.lit(v).alias("verdict"), F.lit(p).alias("path")) for h, p, v in own]
            entries += [F.lit(host), F.array(*items)]
        table = F.create_map(*entries)
        near = F.flatten(F.filter(F.transform(_suffixes(F.col("_host")), lambda s: F.try_element_at(table, s)), lambda x: x.isNotNull()))
        top = F.array_max(F.filter(near, lambda r: F.startswith(F.col("_path"), r["path"])))
        return pages.withColumn("_rule", F.when(top.isNotNull(), F.struct(top["rule"].alias("rule"), top["verdict"].alias("verdict"))))
    spark = pages.sparkSession
    known = spark.createDataFrame([(h, p, v, h + p, len(h + p)) for h, p, v in rules], "h string, path string, verdict string, rule string, size int")
    hosts = pages.select("_host", "_path").distinct()
    near = hosts.withColumn("h", F.explode(_suffixes(F.col("_host")))).join(known, "h").where(F.startswith(F.col("_path"), F.col("path")))
    top = near.groupBy("_host", "_path").agg(F.max(best(near)).alias("top"))
    top = top.select("_host", "_path", F.struct(F.col("top.rule").alias("rule"), F.col("top.verdict").alias("verdict")).alias("_rule"))
    return pages.join(top, ["_host", "_path"], "left")


def _plain(path: Column) -> Column:
    """A path without its segments ``.`` and ``..``, as RFC 3986 removes them."""
    parts = F.split(path, "/", -1)
    step = lambda done, x: F.when(x == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(1)))).when(x == ".", done).otherwise(F.concat(done, F.array(x)))
    kept = F.array_join(F.aggregate(F.slice(parts, 2, F.size(parts)), F.array(F.lit("")), step), "/")
    ends = F.element_at(parts, -1)
    out = F.when((ends == ".") | (ends == ".."), F.concat(kept, F.lit("/"))).otherwise(kept)
    return F.when(out == "", "/").otherwise(out)


def _unescaped(text: Column) -> Column:
    """``text`` with the entities that addresses hold replaced by their characters."""
    for entity, char in ENTITIES:
        text = F.replace(text, F.lit(entity), F.lit(char))
    return text


def _resolve(href: Column, scheme: Column, host: Column, path: Column, query: Column) -> Column:
    """The address that ``href`` leads to from the page at the given parts, by the rules of RFC 3986; null where it names none with a host."""
    href = F.trim(_unescaped(href))
    own, rest = F.regexp_extract(href, r"^[^?#]*", 0), F.regexp_extract(href, r"^[^?#]*(.*)", 1)
    at = F.concat(scheme, F.lit("://"), host)
    folder = F.when(path == "", "/").otherwise(F.regexp_replace(path, r"[^/]*$", ""))
    far = F.concat(F.regexp_extract(own, r"^(//[^/]*)", 1), _plain(F.concat(F.lit("/"), F.regexp_extract(own, r"^//[^/]*/?(.*)", 1))), rest)
    return (
        F.when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*://"), href)
        .when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), None)
        .when(href.startswith("//"), F.concat(scheme, F.lit(":"), far))
        .when(href.startswith("/"), F.concat(at, _plain(own), rest))
        .when(own == "", F.concat(at, path, F.when(rest.startswith("?"), rest).otherwise(F.concat(query, rest))))
        .otherwise(F.concat(at, _plain(F.concat(folder, own)), rest))
    )


def alias_edges(pages: DataFrame, url: str = "url", html: str = "html", redirect: str | None = None) -> DataFrame:
    """(a, b) address keys: each page and where its canonical link, its refresh or its redirect column leads."""
    text, at = F.col(html), F.col(url)
    rel = r"""(?:"(?:[^">]*\s)?canonical(?:\s[^">]*)?"|'(?:[^'>]*\s)?canonical(?:\s[^'>]*)?'|canonical(?=[\s/>]))"""
    link = r"(?is)<link\b(?=[^>]*\brel\s*=\s*" + rel + r""")[^>]*?\bhref\s*=\s*["']?([^"'\s>]+)"""
    move = r"""(?is)<meta\b(?=[^>]*\bhttp-equiv\s*=\s*["']?refresh\b)[^>]*\bcontent\s*=\s*["']?[^"'>]*?url\s*=\s*([^"'\s>]+)"""
    small = F.lower(text)
    targets = [
        F.when(F.contains(small, F.lit("canonical")), F.nullif(F.regexp_extract(text, link, 1), F.lit(""))),
        F.when(F.contains(small, F.lit("http-equiv")), F.nullif(F.regexp_extract(text, move, 1), F.lit(""))),
    ]
    if redirect:
        targets.append(F.col(redirect))
    links = pages.select(at.alias("u"), F.explode(F.filter(F.array(*targets), lambda x: F.length(F.trim(x)) > 0)).alias("href"))
    links = cut(links, "alias-links")  # few; so that the scan of the pages carries no more than this
    u = F.col("u")
    links = links.withColumns({"host": host_of(u), "path": path_of(u), "scheme": F.substring_index(u, "://", 1), "query": F.regexp_extract(_after(u), r"^[^?#]*(\?[^#]*)", 1)}).where("host <> ''")
    links = links.select("u", _resolve(*(F.col(c) for c in ("href", "scheme", "host", "path", "query"))).alias("to"))
    return cut(links.select(_key(F.col("u")).alias("a"), _key(F.col("to")).alias("b")).where("b IS NOT NULL").distinct(), "alias-edges")


def judge_urls(pages: DataFrame, rules: list[Rule], url: str = "url", html: str | None = "html", redirect: str | None = None) -> DataFrame:
    """``pages`` with _host, _path, _rule (its text or null), _verdict and _via (rule, alias or default).

    A page takes the verdict of the longest rule that fits it, allow before block.  A page that
    no rule fits is blocked where redirects and canonical links join it, over any number of steps,
    to a page that a rule blocks; an explicit allow is never overruled.  All others are allowed.

    Null or relative urls have no host and match nothing.  Repeated rows are each judged; null or
    very long html only lacks or delays links; an empty table gives an empty result.  Columns of
    ``pages`` stay, except those that start with an underscore and clash with the new names.
    Addresses are resolved against the page's own; a link that names no host leads nowhere.
    """
    pages = pages.drop("_host", "_path", "_rule", "_verdict", "_via", "_key")
    judged = match_rules(pages, rules, url)
    own = F.col("_rule.verdict")
    if html is None and redirect is None:
        blocked = None
    else:
        source = pages if html is not None else pages.withColumn("_html", F.lit(None).cast("string"))
        with temporary() as made:
            edges = alias_edges(source, url, html or "_html", redirect)
            blocked = None
            if not edges.isEmpty():
                comps = cut(components(edges, "aliases"), "alias-components")
                bad = judged.where(own == "block").select(_key(F.col(url)).alias("node")).where("node IS NOT NULL").distinct()
                # links also name addresses that are no page of the table; rules hold for them too
                named = match_rules(comps.select("node", F.concat(F.lit("http://"), F.col("node")).alias("u")), rules, "u").where(own == "block").select("node")
                hit = comps.join(bad.unionByName(named).distinct(), "node", "left_semi").select("component").distinct()
                blocked = comps.join(hit, "component", "left_semi").select(F.col("node").alias("_key"), F.lit(True).alias("_alias"))
            made.keep("alias-components")
    if blocked is None:
        judged = judged.withColumn("_alias", F.lit(None).cast("boolean"))
    else:
        # addresses without a host get keys of their own, so that they don't all meet in one task
        none = F.concat(F.lit("\0"), F.monotonically_increasing_id().cast("string"))
        judged = judged.withColumn("_key", F.coalesce(_key(F.col(url)), none)).join(blocked, "_key", "left")
    verdict = F.coalesce(own, F.when(F.col("_alias"), "block"), F.lit("allow"))
    via = F.when(own.isNotNull(), "rule").when(F.col("_alias"), "alias").otherwise("default")
    return judged.withColumns({"_verdict": verdict, "_via": via}).withColumn("_rule", F.col("_rule.rule")).drop("_key", "_alias")
