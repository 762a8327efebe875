"""Queries of section A: sources, scans and connectors."""

from __future__ import annotations

import io
import zipfile
from html import escape

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from citemill import views as V
from citemill.plans.registry import query
from citemill.shared import scratch
from citemill.sources import readers as R


def _scratch(s: SparkSession) -> str:
    return scratch(s, "sources")


def _processed(s: SparkSession, d: str) -> DataFrame:
    return V.articles(s, d).withColumn("processed", F.when(F.col("agent") == "lesenswert", F.lit(None)).when(F.col("user") == "", "").otherwise("done"))


_PROC = "pr AS (SELECT *, CASE WHEN agent = 'lesenswert' THEN NULL WHEN \"user\" = '' THEN '' ELSE 'done' END AS processed FROM art)"


@query("a01_window_scan", f"WITH {V.ART}, {_PROC} SELECT id, year, journal FROM pr WHERE year BETWEEN 1997 AND 1999 AND journal IN ('NATION_1', 'NATION_7') AND processed IS NOT NULL")
def a01(s: SparkSession, d: str) -> DataFrame:
    return R.window_scan(_processed(s, d), 1997, 1999, ["NATION_1", "NATION_7"], True).select("id", "year", "journal")


@query("a02_queue_scan", f"WITH {V.ART}, {_PROC} SELECT id, year, journal FROM pr WHERE (processed IS NULL OR processed = '') AND year >= 1998 ORDER BY fetched DESC, id LIMIT 200")
def a02(s: SparkSession, d: str) -> DataFrame:
    return R.queue_scan(_processed(s, d), 200, since=1998).select("id", "year", "journal")


@query("a03_point_lookup", "SELECT c_custkey, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) AS has_articles FROM customer WHERE c_custkey % 100 = 7")
def a03(s: SparkSession, d: str) -> DataFrame:
    c = V.table(s, d, "customer").where("c_custkey % 100 = 7").select("c_custkey")
    seen = V.table(s, d, "orders").select(F.col("o_custkey").alias("c_custkey"), F.lit(True).alias("y")).distinct()
    return c.join(seen, "c_custkey", "left").select("c_custkey", F.coalesce("y", F.lit(False)).alias("has_articles"))


@query("a04_row_decode", "SELECT event_id, CASE WHEN event_id % 5 = 0 THEN -1 ELSE CAST(json_extract_string(props, '$.k') AS BIGINT) END AS k, coalesce(CASE WHEN event_id % 3 > 0 THEN event_type END, '') AS kind FROM events")
def a04(s: SparkSession, d: str) -> DataFrame:
    raw = F.when(F.col("event_id") % 5 == 0, "{broken").otherwise(F.col("props"))
    k = R.decode(raw, "k bigint", F.struct(F.lit(None).cast("bigint").alias("k")))["k"]
    return V.table(s, d, "events").select("event_id", F.coalesce(k, F.lit(-1)).alias("k"), F.coalesce(F.when(F.col("event_id") % 3 > 0, F.col("event_type")), F.lit("")).alias("kind"))


@query("a05_archive_exchange", "SELECT CASE WHEN o_orderkey % 10 = 0 THEN 'skipped' WHEN o_orderkey % 2 = 0 THEN 'updated' ELSE 'created' END AS outcome, count(*) AS n, count(*) AS titles, CAST(0 AS BIGINT) AS verdicts FROM orders GROUP BY 1")
def a05(s: SparkSession, d: str) -> DataFrame:
    o = V.table(s, d, "orders").select(F.when(F.col("o_orderkey") % 10 != 0, F.col("o_orderkey")).alias("id"), F.col("o_orderpriority").alias("title"), F.col("o_orderstatus").alias("verdict"))
    known = V.table(s, d, "orders").where("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("id"))
    back = R.import_archive(R.export_archive(o, _scratch(s)), T.StructType.fromDDL("id long, title string, verdict string"), known, "id")
    return back.groupBy("outcome").agg(F.count("*").alias("n"), F.count("title").alias("titles"), F.count("verdict").alias("verdicts"))


@query("a06_csv_json_export", f"WITH {V.ART} SELECT id, title, author_name || ', ' || segment AS authors, CASE WHEN id % 2 = 0 THEN cluster || '/' || journal ELSE journal END AS journal, year, agent AS verdict FROM art")
def a06(s: SparkSession, d: str) -> DataFrame:
    a = V.articles(s, d).select("id", "title", F.array("author_name", "segment").alias("authors"), F.when(F.col("id") % 2 == 0, F.concat_ws("/", "cluster", "journal")).otherwise("").alias("journal_full"), F.col("journal").alias("journal_short"), "year", F.col("agent").alias("verdict"))
    out = _scratch(s)
    R.export_columns(a).write.option("header", True).csv(out)
    return s.read.option("header", True).schema("id long, title string, authors string, journal string, year int, verdict string").csv(out)


def _landed_works(s: SparkSession, d: str) -> DataFrame:
    w = V.works(s, d)
    body = F.concat(F.lit('{"results":[{"id":"W'), F.col("ref").cast("string"), F.lit('","title":"'), F.when(F.col("ref") % 6 == 0, "").otherwise(F.col("title")), F.lit('","doi":"https://doi.org/10.1/'), F.col("ref").cast("string"), F.lit('","publication_date":"'), F.col("year").cast("string"), F.lit('-01-02","authorships":[{"author":{"display_name":"A B"}}],"abstract_inverted_index":{"one":[0,2],"two":[1]}}]}'))
    return w.select(body.alias("body"))


@query("a07_works_connector", f"WITH {V.WORK} SELECT title, 'W' || ref AS url, '10.1/' || ref AS doi, year || '-01-02' AS published, 'one two one' AS abstract FROM work WHERE ref % 6 <> 0")
def a07(s: SparkSession, d: str) -> DataFrame:
    return R.reader_for({"type": "works"})(_landed_works(s, d)).select("title", "url", "doi", "published", "abstract")


@query("a07_works_pages", "SELECT n_name AS title, '10.1/' || n_nationkey AS doi, (2000 + n_nationkey) || '-05-01' AS published FROM nation WHERE 2000 + n_nationkey BETWEEN 2003 AND 2021")
def a07p(s: SparkSession, d: str) -> DataFrame:
    """Pages of ten nations, each naming the next, read by the data source within bounds of years."""
    n = V.table(s, d, "nation")
    work = F.concat(F.lit('{"id":"W'), F.col("n_nationkey").cast("string"), F.lit('","title":"'), "n_name", F.lit('","doi":"https://doi.org/10.1/'), F.col("n_nationkey").cast("string"), F.lit('","publication_date":"'), (2000 + F.col("n_nationkey")).cast("string"), F.lit('-05-01"}'))
    pages = n.groupBy(F.floor(F.col("n_nationkey") / 10).alias("p")).agg(F.array_join(F.collect_list(work), ",").alias("works")).withColumn("last", F.col("p") == 2)
    folder = _scratch(s)

    def land(batches):
        for pdf in batches:
            for p, works, last in zip(pdf["p"], pdf["works"], pdf["last"], strict=True):
                with R._open(f"{folder}/{p}.json", "w") as f:
                    f.write(f'{{"meta":{{"next_cursor":{"null" if last else f'"{p + 1}.json"'}}},"results":[{works}]}}'.encode())
            yield pdf[["p"]]

    pages.mapInPandas(land, "p long").count()
    _, first, last = R.works_filter("issn:1234-567X", "2024-01-01", since=2003, until=2021)
    s.dataSource.register(R.landed_source())
    landed = s.read.format("landed_works").option("first", f"{folder}/0.json").option("from", first).option("to", last).load()
    return R.works_from_json(landed, "body").select("title", "doi", "published")


@query("a07_works_stream", f"WITH {V.WORK} SELECT ref % 3 AS run, count(*) AS works, count(DISTINCT title) AS titles FROM work WHERE ref % 6 <> 0 GROUP BY 1")
def a07_stream(s: SparkSession, d: str) -> DataFrame:
    """Pages that land between three runs of one stream: each run reads on from the checkpoint of the last."""
    folder = _scratch(s)
    s.dataSource.register(R.landing_source())

    def land(batches):
        for pdf in batches:
            for run, part, body in zip(pdf["run"], pdf["part"], pdf["body"], strict=True):
                with R._open(f"{folder}/in/{run:04}-{part:04}.json", "w") as f:
                    f.write(body.encode())
            yield pdf[["part"]]

    pages = V.works(s, d).select((F.col("ref") % 3).alias("run"), F.expr("ref div 500").alias("part"), F.to_json(F.struct(F.concat(F.lit("W"), "ref").alias("id"), F.when(F.col("ref") % 6 == 0, "").otherwise(F.col("title")).alias("title"), F.lit("2001-01-01").alias("publication_date"))).alias("work"))
    pages = pages.groupBy("run", "part").agg(F.concat(F.lit('{"results":['), F.array_join(F.collect_list("work"), ","), F.lit("]}")).alias("body"))
    for run in range(3):
        pages.where(F.col("run") == run).mapInPandas(land, "part long").count()
        landed = s.readStream.format("landing_works").option("folder", f"{folder}/in").load().withColumn("run", F.lit(run))
        q = landed.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
        q.awaitTermination()
    out = s.read.schema("name string, body string, run int").parquet(f"{folder}/out")
    works = R.works_from_json(out.where(F.substring("name", 1, 4).cast("int") == F.col("run")), "body")
    return works.groupBy((F.substring("url", 2, 20).cast("long") % 3).alias("run")).agg(F.count("*").alias("works"), F.countDistinct("title").alias("titles"))


@query("a08_feed_connector", f"WITH {V.WORK} SELECT title, 'http://j/' || ref AS url, CASE WHEN ref % 2 = 0 THEN '10.5555/x' || ref END AS doi, 'about ' || brand AS abstract FROM work")
def a08(s: SparkSession, d: str) -> DataFrame:
    w = V.works(s, d)
    ref = F.col("ref").cast("string")
    body = F.concat(F.lit("<rss><channel><title>J</title><item><title><![CDATA["), "title", F.lit("]]></title><link>http://j/"), ref, F.lit("</link><guid>"), F.when(F.col("ref") % 2 == 0, F.concat(F.lit("doi:10.5555/x"), ref)).otherwise("-"), F.lit("</guid><description>about <b>"), "brand", F.lit("</b></description></item></channel></rss>"))
    return R.reader_for({"type": "rss"})(w.select(body.alias("body"))).select("title", "url", "doi", "abstract")


@query("a09_html_connector")
def a09(s: SparkSession, d: str) -> DataFrame:
    pages = V.table(s, d, "pages").select("url", F.col("html").alias("body"))
    return R.reader_for({"type": "html", "container": "article", "title": "h1", "abstract": "p"})(pages)


def _issue_pages(s: SparkSession, d: str, base: str, index: str, before: str, link: str, item, extra=None) -> DataFrame:
    """Landed pages of a journal: regions are its issues, nations their articles; an index page lists the issues."""
    region, nation = V.table(s, d, "region"), V.table(s, d, "nation")  # dimensions of a fixed size
    key = F.col("r_regionkey").cast("string")
    label = F.concat(F.lit("Volume "), key, F.lit(" ("), (1995 + F.col("r_regionkey")).cast("string"), F.lit("-6)"))
    links = F.concat(F.lit(f'{link}<a href="/v/'), key, F.lit('">'), label, F.lit("</a>"))
    first = region.agg(F.concat(F.lit(before), F.array_join(F.collect_list(links), "")).alias("body")).select(F.lit(index).alias("url"), "body")
    n = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    pages = n.groupBy("r_regionkey").agg(F.array_join(F.collect_list(item), "").alias("body")).select(F.concat(F.lit(f"{base}/v/"), F.col("r_regionkey").cast("string")).alias("url"), "body")
    out = first.unionByName(pages)
    return out.unionByName(extra(n)) if extra else out


_N = lambda: F.col("n_nationkey").cast("string")


@query("a10_configured_scraper", """SELECT n_name AS title, 'http://j.example/n/' || n_nationkey AS url, 'Ada ' || n_name || '; Bo Two' AS names, CASE WHEN n_nationkey % 2 = 0 THEN 'short ' ELSE 'all of ' END || n_name AS abstract, 'Volume ' || r_regionkey || ' (' || (1995 + r_regionkey) || '-6)' AS issue
FROM nation JOIN region ON n_regionkey = r_regionkey WHERE 1995 + r_regionkey BETWEEN 1996 AND 1998""")
def a10(s: SparkSession, d: str) -> DataFrame:
    item = F.concat(F.lit("<ul><li class=art><b> "), "n_name", F.lit('</b><a class=x href="n/'), _N(), F.lit('">more</a><i>Ada '), "n_name", F.lit(" and Bo Two, X</i>"), F.when(F.col("n_nationkey") % 2 == 0, F.concat(F.lit("<p>short "), "n_name", F.lit("</p>"))).otherwise(""), F.lit("</ul>"))
    details = lambda n: n.select(F.concat(F.lit("http://j.example/n/"), _N()).alias("url"), F.concat(F.lit("<html><div class=abs>all of "), "n_name", F.lit("</div></html>")).alias("body"))
    pages = _issue_pages(s, d, "http://j.example", "http://j.example/issues", "<nav>", "<p class=issue>", item, details)
    config = {"type": "custom", "strategy": "issue_list", "base_url": "http://j.example/", "issues": {"url": "http://j.example/issues", "link_selector": "p.issue a", "year_regex": r"\((\d{4})"}, "since": 1996, "until": 1998}
    config |= {"container": "li.art", "title": "h2, b", "link": "a.none@href, a.x@href", "authors": "i", "abstract": "p", "detail": {"abstract": "div.abs"}}
    return R.reader_for(config)(pages).select("title", "url", F.array_join("authors", "; ").alias("names"), "abstract", "issue")


@query("a10_paginated_scraper", "SELECT n_name AS title, 'http://p.example/list' || CASE WHEN n_nationkey >= 10 THEN '?page=' || (n_nationkey // 10 + 1) ELSE '' END AS url FROM nation")
def a10p(s: SparkSession, d: str) -> DataFrame:
    """Three pages of a list; the fourth has no articles, so the fifth is not reached."""
    n = V.table(s, d, "nation").select("n_nationkey", "n_name")
    rows = n.unionByName(n.where("n_nationkey < 5").withColumn("n_nationkey", F.col("n_nationkey") + 40))
    pages = rows.groupBy((F.floor(F.col("n_nationkey") / 10) + 1).alias("p")).agg(F.concat_ws("", F.collect_list(F.concat(F.lit("<li><b>"), "n_name", F.lit("</b>")))).alias("body"))
    url = F.concat(F.lit("http://p.example/list"), F.when(F.col("p") > 1, F.concat(F.lit("?page="), F.col("p").cast("string"))).otherwise(""))
    pages = pages.select(url.alias("url"), "body")
    config = {"type": "custom", "strategy": "paginated", "start": "http://p.example/list", "pagination": {"type": "query_param", "param": "page", "max_pages": 30}, "container": "li", "title": "b"}
    return R.reader_for(config)(pages).select("title", "url")


@query("a11_year_window", f"WITH {V.WORK}, {V.CITE} SELECT ref FROM cite WHERE coalesce(TRY_CAST(regexp_extract(raw, '((?:19|20)\\d{{2}})', 1) AS INT) BETWEEN 1995 AND 2005, true)")
def a11(s: SparkSession, d: str) -> DataFrame:
    return V.citations(s, d).where(R.in_year_window(F.col("raw"), 1995, 2005)).select("ref")


@query("a12_site_scraper", """SELECT n_name AS title, 'http://volumes.example/pdf/' || n_nationkey || '.pdf' AS url, (1995 + r_regionkey) || '-03-' || lpad(CAST(n_nationkey % 28 + 1 AS VARCHAR), 2, '0') AS published, 'Ada ' || n_name || '; Bo Two; Cy Three' AS names, 'about ' || n_name AS abstract
FROM nation JOIN region ON n_regionkey = r_regionkey WHERE 1995 + r_regionkey >= 1997""")
def a12(s: SparkSession, d: str) -> DataFrame:
    day, year = (F.col("n_nationkey") % 28 + 1).cast("string"), (1995 + F.col("r_regionkey")).cast("string")
    item = F.concat(F.lit('<div class="item"><h3>'), "n_name", F.lit('</h3><a class="pdf" href="/pdf/'), _N(), F.lit('.pdf">PDF</a><span class="by">Written by: Ada '), "n_name", F.lit(", Bo Two &amp; Cy Three</span><p>about "), "n_name", F.lit("</p><time>March "), day, F.lit(", "), year, F.lit("</time></div>"))
    pages = _issue_pages(s, d, "http://volumes.example", "http://volumes.example/browse", '<div class="volumes">', "", item)
    return R.reader_for({"type": "site", "site": "volumes", "since": 1997})(pages).select("title", "url", "published", F.array_join("authors", "; ").alias("names"), "abstract")


@query("a13_reader_registry", f"WITH {V.WORK} SELECT 'works' AS source, count(*) AS n FROM work WHERE ref % 6 <> 0 UNION ALL SELECT 'listing', CAST(sum(len(regexp_extract_all(html, '<li>\\s*<a'))) AS BIGINT) FROM pages")
def a13(s: SparkSession, d: str) -> DataFrame:
    pages = V.table(s, d, "pages").select("url", F.col("html").alias("body"))
    sources = [("works", {"type": "works"}, _landed_works(s, d)), ("listing", {"type": "site", "site": "listing"}, pages)]
    out = None
    for name, config, rows in sources:
        n = R.reader_for(config)(rows).agg(F.count("*").alias("n")).select(F.lit(name).alias("source"), "n")
        out = n if out is None else out.unionByName(n)
    return out


@query("a14_watchlist_table", f"WITH {V.WORK} SELECT title AS journal, brand AS reason, 'Maker, ' || topic AS names FROM work WHERE ref % 3 <> 0")
def a14(s: SparkSession, d: str) -> DataFrame:
    line = F.when(F.col("ref") % 3 == 0, "|---|:--|--|").otherwise(F.concat(F.lit("| **"), "title", F.lit("** | "), "brand", F.lit(" | Maker; "), "topic", F.lit(" |")))
    return R.markdown_table(V.works(s, d).select(line.alias("line")), "line").select("journal", "reason", F.array_join("names", ", ").alias("names"))


@query("a15_folder_source", f"WITH {V.WORK} SELECT '/lib/' || brand || '/' || replace(title, ' ', '_') || '_' || year || '.pdf' AS path, '/lib/' || brand AS source_key, title, year FROM work")
def a15(s: SparkSession, d: str) -> DataFrame:
    path = F.concat(F.lit("/lib/"), "brand", F.lit("/"), F.replace("title", F.lit(" "), F.lit("_")), F.lit("_"), F.col("year").cast("string"), F.lit(".pdf"))
    return R.folder_items(V.works(s, d).select(path.alias("path")), "path").select("path", "source_key", "title", "year")


def _office(kind: str, text: str) -> bytes:
    """A DOCX or ODT file with a paragraph for each line, as small as can be."""
    name, line = ("word/document.xml", "<w:p><w:r><w:t>{}</w:t></w:r></w:p>") if kind == "docx" else ("content.xml", "<text:p>{}</text:p>")
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr(name, "<body>" + "".join(line.format(escape(x)) for x in text.split("\n")) + "</body>")
    return out.getvalue()


@query("a16_document_text", r"SELECT doc_id, md5(CASE WHEN doc_id % 3 < 2 THEN regexp_replace(regexp_replace(text, '^\s+', ''), '\s+$', '') ELSE text END) AS text_md5, 'ok' AS status FROM documents")
def a16(s: SparkSession, d: str) -> DataFrame:
    def files(batches):
        for pdf in batches:
            kinds = [("docx", "odt", "txt")[i % 3] for i in pdf["doc_id"]]
            data = [t.encode() if k == "txt" else _office(k, t) for k, t in zip(kinds, pdf["text"], strict=True)]
            yield pd.DataFrame({"path": [f"/lib/{i}.{k}" for i, k in zip(pdf["doc_id"], kinds, strict=True)], "content": data})

    made = V.table(s, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInPandas(files, "path string, content binary")
    got = R.document_texts(made)
    return got.select(F.regexp_extract("path", r"(\d+)\.", 1).cast("long").alias("doc_id"), F.md5(F.col("text").cast("binary")).alias("text_md5"), "status")


@query("a17_fulltext_chain", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'cache' WHEN doc_id % 2 = 0 THEN 'library' WHEN doc_id % 5 = 0 THEN 'open' ELSE 'none' END AS provider, CAST(coalesce(CASE WHEN doc_id % 3 = 0 OR doc_id % 2 = 0 OR doc_id % 5 = 0 THEN length(text) END, 0) AS INT) AS n FROM documents")
def a17(s: SparkSession, d: str) -> DataFrame:
    t = V.table(s, d, "documents").select("doc_id", "text")
    cache = t.withColumn("text", F.when(F.col("doc_id") % 3 == 0, F.col("text")).otherwise(" "))
    out = R.fulltext_chain(t.select("doc_id"), "doc_id", [("cache", cache), ("library", t.where("doc_id % 2 = 0")), ("open", t.where("doc_id % 5 = 0"))])
    return out.select("doc_id", "provider", F.coalesce(F.length("text"), F.lit(0)).alias("n"))


@query("a18_snapshot_restore", "SELECT 'nation' AS name, count(*) AS n FROM nation UNION ALL SELECT 'region', count(*) FROM region")
def a18(s: SparkSession, d: str) -> DataFrame:
    folder = _scratch(s)
    R.snapshot({n: V.table(s, d, n) for n in ("nation", "region")}, folder, "v1")
    back = R.restore(s, folder, "v1")
    return back["nation"].agg(F.count("*").alias("n")).select(F.lit("nation").alias("name"), "n").unionByName(back["region"].agg(F.count("*").alias("n")).select(F.lit("region").alias("name"), "n"))
