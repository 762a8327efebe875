"""Readers of articles: tables, feeds, pages, archives, folders; and the registry that picks one by a source's type."""

from __future__ import annotations

import io
import itertools
import json
import re
import uuid
import zipfile
import zlib
from collections.abc import Callable, Iterator
from html import unescape
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ARTICLE = "title string, url string, doi string, published string, authors array<string>, abstract string, issue string"


def window_scan(articles: DataFrame, start: int, end: int, journals: list[str] | None = None, only_processed: bool = False) -> DataFrame:
    """Articles of a span of years, newest first; no journals, or an empty list, means all of them."""
    out = articles.where(F.col("year").between(start, end))
    if journals:
        out = out.where(F.col("journal").isin(journals))
    if only_processed:
        out = out.where(F.col("processed").isNotNull())
    return out.orderBy(F.desc("year"), F.desc("fetched"))


def queue_scan(articles: DataFrame, limit: int = 0, journals: list[str] | None = None, since: int | None = None, until: int | None = None) -> DataFrame:
    """Articles whose marker of processing is null or empty; a limit of 0 is none."""
    out = articles.where(F.col("processed").isNull() | (F.col("processed") == ""))
    for given, test in ((journals, F.col("journal").isin(journals or [])), (since, F.col("year") >= F.lit(since)), (until, F.col("year") <= F.lit(until))):
        out = out.where(test) if given else out
    out = out.orderBy(F.desc("fetched"), "id")
    return out.limit(limit) if limit else out


def decode(c: Column, schema: str, empty: Column) -> Column:
    """JSON text as a typed column; broken or missing text is ``empty``."""
    return F.coalesce(F.from_json(c, schema, {"mode": "PERMISSIVE"}), empty)


# fixed values: the columns of an archive; verdicts, entries, memos and costs are left out
RAW_COLUMNS = ("id", "title", "authors", "abstract", "url", "doi", "journal", "year", "published", "fetched")
ARCHIVE_VERSION = 1


def export_archive(rows: DataFrame, folder: str) -> DataFrame:
    """Articles as ZIP archives of JSON lines with a manifest, one archive a task; (path, count) of each.

    Only the raw columns go out.  An archive is written under a fresh name by the task that reads the
    rows, streaming, so nothing is gathered; what an earlier attempt of a task left is in no list.
    """
    rows = rows.select(*[c for c in RAW_COLUMNS if c in rows.columns])
    names = rows.columns
    lines = rows.select(F.to_json(F.struct(*names), {"ignoreNullFields": "false"}).alias("line"))

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first = next((b for b in batches if len(b)), None)
        if first is None:
            return
        path, count = f"{folder}/articles-{uuid.uuid4().hex}.zip", 0
        with _open(path, "w") as out, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            with z.open("articles.jsonl", "w", force_zip64=True) as f:
                for pdf in itertools.chain([first], batches):
                    count += len(pdf)
                    f.write("".join(f"{line}\n" for line in pdf["line"]).encode())
            z.writestr("manifest.json", json.dumps({"schema_version": ARCHIVE_VERSION, "article_count": count, "columns": names}))
        yield pd.DataFrame({"path": [path], "count": [count]})

    made = lines.mapInPandas(write, "path string, count long")
    made.write.parquet(f"{folder}/_list")
    return rows.sparkSession.read.parquet(f"{folder}/_list")


def _open(uri: str, mode: str):
    """A file of any storage that pyarrow knows, for reading or for writing."""
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(uri)
    if mode == "r":
        return system.open_input_file(path)
    system.create_dir(path.rsplit("/", 1)[0], recursive=True)
    return system.open_output_stream(path)


def import_archive(archives: DataFrame, schema: T.StructType, known: DataFrame, key: str) -> DataFrame:
    """Rows of archives (path) with the column outcome: created, updated or skipped (no key).

    A line that is no JSON has nulls, so it is skipped for want of a key.
    """
    rows = zip_lines(archives).select(F.from_json("line", schema).alias("r")).select("r.*")
    seen = known.select(F.col(key).alias("_known")).distinct()
    outcome = F.when(F.col(key).isNull() | (F.col(key).cast("string") == ""), "skipped").when(F.col("_known").isNotNull(), "updated").otherwise("created")
    return rows.join(seen, F.col(key) == F.col("_known"), "left").withColumn("outcome", outcome).drop("_known")


def zip_lines(archives: DataFrame, member: str = "articles.jsonl") -> DataFrame:
    """(path, line) of a member of ZIP archives (path), each opened where it is read; blank lines are passed over."""

    def lines(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for p in pdf["path"]:
                with _open(p, "r") as data, zipfile.ZipFile(data) as z:
                    if member not in z.namelist():
                        raise ValueError(f"{p} has no {member}")
                    with z.open(member) as f:
                        stream = (x for x in (line.rstrip("\n") for line in io.TextIOWrapper(f, "utf-8")) if x.strip())
                        while part := list(itertools.islice(stream, 10_000)):
                            yield pd.DataFrame({"path": p, "line": part})

    return archives.select("path").mapInPandas(lines, "path string, line string")


def export_columns(articles: DataFrame) -> DataFrame:
    """The export's projection: names joined, the journal's full name where there is one."""
    return articles.select("id", "title", F.array_join("authors", ", ").alias("authors"), F.coalesce(F.nullif("journal_full", F.lit("")), "journal_short").alias("journal"), "year", "verdict")


def rebuild_text(inverted: Column) -> Column:
    """Text of a map from words to their positions."""
    pairs = F.flatten(F.transform(F.map_entries(inverted), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("p"), e["key"].alias("w")))))
    return F.array_join(F.transform(F.array_sort(pairs), lambda x: x["w"]), " ")


def works_from_json(rows: DataFrame, column: str) -> DataFrame:
    """Articles of landed pages of a works interface, a JSON text for each page; works without title are left out."""
    schema = "results array<struct<id:string,title:string,display_name:string,doi:string,publication_date:string,authorships:array<struct<author:struct<display_name:string>>>,abstract_inverted_index:map<string,array<int>>>>"
    w = rows.select(F.explode(F.from_json(column, schema)["results"]).alias("w")).select("w.*")
    title = F.coalesce(F.nullif("title", F.lit("")), "display_name")
    return w.where(F.length(title) > 0).select(
        title.alias("title"), F.col("id").alias("url"), F.regexp_replace("doi", r"^https?://(dx\.)?doi\.org/", "").alias("doi"), F.col("publication_date").alias("published"),
        F.transform("authorships", lambda a: a["author"]["display_name"]).alias("authors"), rebuild_text(F.col("abstract_inverted_index")).alias("abstract"),
    )


def feed_items(rows: DataFrame, column: str) -> DataFrame:
    """Articles of RSS texts, one text a row: tags out of the summary, the first DOI of link, id or summary."""
    item = F.explode(F.regexp_extract_all(column, F.lit(r"(?is)<item\b[^>]*>(.*?)</item>"), F.lit(1))).alias("item")
    part = lambda tag: F.nullif(F.trim(F.regexp_replace(F.regexp_extract("item", rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}>", 1), r"(?s)^\s*<!\[CDATA\[(.*)\]\]>\s*$", "$1")), F.lit(""))
    text = F.trim(F.regexp_replace(F.regexp_replace(part("description"), "<[^>]+>", " "), r"\s+", " "))
    doi = F.nullif(F.regexp_extract(F.concat_ws(" ", part("link"), part("guid"), part("description")), r"(10\.\d{4,9}/[^\s\"<>]+)", 1), F.lit(""))
    names = F.filter(F.split(F.coalesce(part("dc:creator"), part("author"), F.lit("")), r"\s*[,;]\s*"), lambda a: a != "")
    return rows.select(item).select(part("title").alias("title"), part("link").alias("url"), doi.alias("doi"), part("pubDate").alias("published"), names.alias("authors"), text.alias("abstract"))


def in_year_window(published: Column, start: int | None, end: int | None) -> Column:
    """The first year of a free-text date lies in the window; dates that have none stay in."""
    year = F.regexp_extract(published, r"((?:19|20)\d{2})", 1).try_cast("int")
    return year.isNull() | year.between(start if start is not None else 0, end if end is not None else 9999)


# -- pages and selectors ---------------------------------------------------------------------------

_VOID = set("area base br col embed hr img input link meta source track wbr".split())


class _Node:
    def __init__(self, tag: str, attrs: dict[str, str], parent: _Node | None):
        self.tag, self.attrs, self.parent, self.children = tag, attrs, parent, []

    def text(self) -> str:
        return "".join(c if isinstance(c, str) else c.text() for c in self.children if isinstance(c, str) or c.tag not in ("script", "style"))

    def walk(self) -> Iterator[_Node]:
        for c in self.children:
            if not isinstance(c, str):
                yield c
                yield from c.walk()


class _Tree(HTMLParser):
    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.root = self.at = _Node("", {}, None)
        self.feed(html)

    def handle_starttag(self, tag, attrs):
        node = _Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.children.append(node)
        if tag not in _VOID:
            self.at = node

    def handle_endtag(self, tag):
        node = self.at
        while node.parent is not None and node.tag != tag:
            node = node.parent
        if node.parent is not None:
            self.at = node.parent

    def handle_data(self, data):
        self.at.children.append(data)


def _step(node: _Node, simple: str) -> bool:
    m = re.fullmatch(r"([\w-]*|\*)((?:[.#][\w-]+|\[[^\]]+\])*)", simple)
    if not m or (m[1] not in ("", "*") and node.tag != m[1].lower()):
        return False
    for x in re.findall(r"[.#][\w-]+|\[[^\]]+\]", m[2]):
        if x[0] == "." and x[1:] not in node.attrs.get("class", "").split() or x[0] == "#" and node.attrs.get("id") != x[1:]:
            return False
        if x[0] == "[":
            key, eq, value = x[1:-1].partition("=")
            if key not in node.attrs or eq and node.attrs[key] != value.strip("\"'"):
                return False
    return True


def select(node: _Node, css: str) -> list[_Node]:
    """Nodes below ``node`` that a selector of tags, classes, ids and attributes with descendant steps finds."""
    steps = css.split()
    out = []
    for x in node.walk():
        if steps and _step(x, steps[-1]):
            up, k = x.parent, len(steps) - 2
            while k >= 0 and up is not None:
                if _step(up, steps[k]):
                    k -= 1
                up = up.parent
            if k < 0:
                out.append(x)
    return out


def pick(node: _Node, selectors: str) -> str:
    """The first non-empty result of comma-separated selectors; ``css@attribute`` takes an attribute."""
    for one in selectors.split(","):
        css, _, attribute = one.strip().partition("@")
        for x in select(node, css) if css else [node]:
            value = x.attrs.get(attribute, "") if attribute else re.sub(r"\s+", " ", x.text())
            if value.strip():
                return unescape(value.strip())
    return ""


STRATEGIES = ("single_page", "paginated", "issue_list")
MOST_PAGES = 20
PARTS = ("title", "link", "authors", "abstract", "date", "doi")


def check_config(config: dict) -> dict:
    """A scraper's configuration, or a ValueError that names what is wrong with it."""
    strategy = config.get("strategy", "single_page")
    wrong = [k for k in ("container", "title") if not config.get(k)]
    if strategy not in STRATEGIES:
        wrong.append(f"strategy {strategy}")
    if strategy == "paginated" and not config.get("start"):
        wrong.append("start")
    if strategy == "issue_list":
        wrong += [f"issues.{k}" for k in ("url", "link_selector") if not config.get("issues", {}).get(k)]
    if wrong:
        raise ValueError(f"not a scraper configuration: {wrong}")
    return config


def split_authors(text: str) -> list[str]:
    return [a.strip() for a in re.split(r",|;|&|\band\b|\bund\b", text) if len(a.strip()) > 2]


def page_urls(config: dict) -> list[str]:
    """Addresses of a paginated source in order, MOST_PAGES at most: the start, then pages by a parameter or by a suffix."""
    start, how = config["start"], config.get("pagination", {})
    if how.get("type", "query_param") == "url_suffix":
        later = lambda n: start.rstrip("/") + how.get("pattern", "/page/{n}").replace("{n}", str(n))
    else:
        later = lambda n: f"{start}{'&' if '?' in start else '?'}{how.get('param', 'page')}={n}"
    return [start, *(later(n) for n in range(2, min(how.get("max_pages", 5), MOST_PAGES) + 1))]


def _issue_links(index: DataFrame, config: dict) -> DataFrame:
    """(u, issue): addresses and labels of the issues that an index page lists, of years in the window; labels without a year stay in."""
    from urllib.parse import urljoin

    issues = config["issues"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for base, text in zip(pdf["u"], pdf["h"], strict=True):
                for a in select(_Tree(text or "").root, issues["link_selector"]):
                    if a.attrs.get("href"):
                        rows.append((urljoin(config.get("base_url") or base, a.attrs["href"]), re.sub(r"\s+", " ", a.text()).strip()))
            yield pd.DataFrame(rows, columns=["u", "issue"])

    links = index.mapInPandas(run, "u string, issue string").distinct()
    year = F.regexp_extract("issue", issues.get("year_regex", r"(20\d{2})"), 1).try_cast("int")
    return links.where(year.isNull() | year.between(config.get("since", 0), config.get("until", 9999)))


def _articles(landed: DataFrame, config: dict) -> DataFrame:
    """Articles of landed pages (u, h, issue, n) with n and the raw text of the byline."""
    from urllib.parse import urljoin

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for base, text, issue, n in zip(pdf["u"], pdf["h"], pdf["issue"], pdf["n"], strict=True):
                for box in select(_Tree(text or "").root, config["container"]):
                    got = {k: pick(box, config[k]) if config.get(k) else "" for k in PARTS}
                    if got["title"]:
                        url = urljoin(config.get("base_url") or base or "", got["link"]) if got["link"] else base
                        rows.append((n, got["authors"], got["title"], url, got["doi"] or None, got["date"] or None, split_authors(got["authors"]), got["abstract"][:2000], issue))
            yield pd.DataFrame(rows, columns=["n", "byline", "title", "url", "doi", "published", "authors", "abstract", "issue"])

    return landed.select("u", "h", "issue", "n").mapInPandas(run, f"n int, byline string, {ARTICLE}")


def scrape(pages: DataFrame, url: str, html: str, config: dict) -> DataFrame:
    """Articles on landed pages by a declarative configuration.

    container, title, link, authors, abstract, date and doi are selectors.  A single page is that at
    ``start``, or every page without it.  Paginated sources are read page by page until one has no
    articles or is not there.  An issue list names the pages to read, and each article its issue.
    ``detail`` selects the abstract on an article's own page where the listing has none; ``since`` and
    ``until`` bound the years; ``dates`` and ``names`` may be month_day and byline.
    """
    config = check_config(config)
    strategy = config.get("strategy", "single_page")
    pages = pages.select(F.col(url).alias("u"), F.col(html).alias("h"))
    landed = pages.withColumns({"issue": F.lit(None).cast("string"), "n": F.lit(1)})
    if strategy == "issue_list":
        links = _issue_links(pages.where(F.col("u") == config["issues"]["url"]), config)
        landed = landed.drop("issue").join(links, "u")
    elif strategy == "paginated":
        listed = pages.sparkSession.createDataFrame(list(enumerate(page_urls(config), 1)), "n int, u string")
        landed = landed.drop("n").join(F.broadcast(listed), "u")  # MOST_PAGES rows at most
    elif config.get("start"):
        landed = landed.where(F.col("u") == config["start"])
    out = _articles(landed, config)
    if strategy == "paginated":
        gap = listed.join(out.select("n").distinct(), "n", "left_anti").agg(F.min("n").alias("gap"))  # one row
        out = out.crossJoin(F.broadcast(gap)).where("gap IS NULL OR n < gap").drop("gap")
    if config.get("dates") == "month_day":
        out = out.withColumn("published", month_day_date(F.col("published")))
    if config.get("names") == "byline":
        out = out.withColumn("authors", byline_names(F.col("byline")))
    out = out.drop("n", "byline")
    if config.get("since") is not None or config.get("until") is not None:
        out = out.where(in_year_window(F.coalesce("published", F.lit("")), config.get("since"), config.get("until")))
    if config.get("detail"):
        one = {"container": config["detail"].get("container", "html"), "title": config["detail"]["abstract"], "abstract": config["detail"]["abstract"]}
        full = _articles(pages.withColumns({"issue": F.col("u"), "n": F.lit(1)}), one).groupBy("issue").agg(F.first("abstract").alias("_more"))
        out = out.join(full.withColumnRenamed("issue", "url"), "url", "left").withColumn("abstract", F.when(F.col("abstract") == "", F.coalesce("_more", F.lit(""))).otherwise(F.col("abstract"))).drop("_more")
    return out.select(*[x.split()[0] for x in ARTICLE.split(", ")])


MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")


def month_day_date(c: Column) -> Column:
    """``Mar 17, 2026`` as 2026-03-17; of other texts the first year from 2000 on, else empty.  An unknown month counts as the first."""
    part = lambda i: F.regexp_extract(F.trim(c), r"^(\w+)\s+(\d+),?\s+(\d{4})", i)
    month = F.greatest(F.array_position(F.array(*map(F.lit, MONTHS)), F.lower(F.left(part(1), F.lit(3)))), F.lit(1))
    day = F.concat_ws("-", part(3), F.lpad(month.cast("string"), 2, "0"), F.lpad(part(2), 2, "0"))
    return F.coalesce(F.when(part(1) != "", day).otherwise(F.regexp_extract(c, r"(20\d{2})", 1)), F.lit(""))


def byline_names(c: Column) -> Column:
    """Names of ``Written by: A, B & C``; parts of two characters or fewer are none."""
    text = F.regexp_replace(F.regexp_replace(F.replace(c, F.lit("&amp;"), F.lit("&")), r"(?i)written\s*(by\s*)?:?\s*", ""), r"(?:<[^>]+>|\s)+", " ")
    return F.coalesce(F.filter(F.transform(F.split(text, r"[,&]|\s+and\s+"), lambda a: F.trim(a)), lambda a: F.length(a) > 2), F.array().cast("array<string>"))


#: Sites with a layout of their own, as configurations of the same scraper; an index of volumes leads to their articles.
SITES = {
    "articles": {"container": "article", "title": "h1,h2", "link": "a@href", "abstract": "p", "date": "time@datetime"},
    "listing": {"container": "li", "title": "a", "link": "a@href"},
    "volumes": {
        "strategy": "issue_list", "issues": {"url": "http://volumes.example/browse", "link_selector": "div.volumes a", "year_regex": r"\((\d{4})"},
        "container": "div.item", "title": "h3", "link": "a.pdf@href", "authors": "span.by", "abstract": "p", "date": "time", "dates": "month_day", "names": "byline",
    },
    "issues": {
        "strategy": "issue_list", "issues": {"url": "http://issues.example/all", "link_selector": "div.entry-content ol li a", "year_regex": r"(\d{4})"},
        "container": "div.entry-content li", "title": "a", "link": "a@href", "authors": "em",
    },
}


def markdown_table(rows: DataFrame, line: str) -> DataFrame:
    """(journal, reason, names) of the rows of Markdown tables; heads and rules are passed over."""
    cells = F.transform(F.filter(F.split(F.trim(F.regexp_replace(F.col(line), r"^\s*\||\|\s*$", "")), r"\|"), lambda c: c.isNotNull()), lambda c: F.trim(F.regexp_replace(c, r"[*_`]", "")))
    ok = F.col(line).rlike(r"^\s*\|") & ~F.col(line).rlike(r"^\s*\|[\s:|\-]+$") & ~F.lower(F.try_element_at(cells, F.lit(1))).isin("journal", "name", "zeitschrift")
    names = F.filter(F.split(F.coalesce(F.try_element_at(cells, F.lit(3)), F.lit("")), r"\s*[,;]\s*"), lambda n: n != "")
    return rows.where(ok).select(F.try_element_at(cells, F.lit(1)).alias("journal"), F.try_element_at(cells, F.lit(2)).alias("reason"), names.alias("names")).where("journal <> ''")


def folder_items(files: DataFrame, path: str) -> DataFrame:
    """``files`` with source_type, source_key, title and year, read off the file's name where nothing better is known."""
    name = F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[A-Za-z0-9]{1,5}$", "")
    spaced = F.regexp_replace(name, r"[_\-]+", " ")
    year = F.regexp_extract(spaced, r"\b((?:19|20)\d{2})\b", 1).try_cast("int")
    title = F.trim(F.regexp_replace(spaced, r"\s*\b(?:19|20)\d{2}\b\s*", " "))
    return files.withColumns({"source_type": F.lit("folder"), "source_key": F.regexp_replace(path, r"/[^/]*$", ""), "source_item_id": F.sha1(F.col(path).cast("binary")), "title": title, "year": year})


_PDF_STREAM = re.compile(rb"<<(.*?)>>\s*stream\r?\n(.*?)\r?\n?endstream", re.S)
_PDF_PIECE = re.compile(rb"\(((?:\\.|[^\\()])*)\)|<([0-9A-Fa-f\s]+)>|(T\*|TD|Td|Tm|ET|'|\")", re.S)
_PDF_ESCAPE = {b"n": "\n", b"r": "\r", b"t": "\t", b"b": "\b", b"f": "\f"}


def pdf_text(data: bytes) -> str:
    """Strings that a PDF's content streams show, a line for each move of the text position; fonts of one byte a character only."""
    lines: list[list[str]] = [[]]
    for head, body in _PDF_STREAM.findall(data):
        if b"FlateDecode" in head:
            try:
                body = zlib.decompress(body)
            except zlib.error:
                continue
        for block in re.findall(rb"\bBT\b(.*?\bET\b)", body, re.S):
            for literal, digits, move in _PDF_PIECE.findall(block):
                if move:
                    lines.append([])
                elif digits:
                    lines[-1].append(bytes.fromhex(re.sub(r"\s", "", digits.decode())).decode("latin-1"))
                else:
                    plain = re.sub(rb"\\([0-7]{1,3}|\r?\n|.)", lambda m: _PDF_ESCAPE.get(m[1], chr(int(m[1], 8)) if m[1].isdigit() else m[1].strip().decode("latin-1")).encode("latin-1"), literal, flags=re.S)
                    lines[-1].append(plain.decode("latin-1"))
    return "\n".join(x for x in ("".join(line) for line in lines) if x.strip())


def document_texts(files: DataFrame) -> DataFrame:
    """(path, text, status) of binary files: DOCX and ODT by their XML, PDF by pypdf where it is there and else by its plain strings, other files as they are."""

    def text(path: str, data: bytes) -> tuple[str | None, str]:
        kind = path.rsplit(".", 1)[-1].lower()
        try:
            if kind in ("docx", "odt"):
                with zipfile.ZipFile(io.BytesIO(data)) as z:
                    xml = z.read("word/document.xml" if kind == "docx" else "content.xml").decode()
                xml = re.sub(r"</(?:w:p|text:p|text:h)>", "\n", xml)
                return unescape(re.sub(r"<[^>]+>", "", xml)).strip(), "ok"
            if kind == "pdf":
                try:
                    from pypdf import PdfReader
                except ImportError:
                    found = pdf_text(data)
                    return (found, "ok") if found else (None, "no text")
                return "\n".join(p.extract_text() or "" for p in PdfReader(io.BytesIO(data)).pages), "ok"
            return data.decode("utf-8", "replace"), "ok"
        except (zipfile.BadZipFile, KeyError, ValueError) as e:
            return None, f"failed: {type(e).__name__}"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            got = [text(p, d or b"") for p, d in zip(pdf["path"], pdf["content"], strict=True)]
            yield pd.DataFrame({"path": pdf["path"], "text": [g[0] for g in got], "status": [g[1] for g in got]})

    return files.select("path", "content").mapInPandas(run, "path string, text string, status string")


def fulltext_chain(ids: DataFrame, key: str, providers: list[tuple[str, DataFrame]]) -> DataFrame:
    """(key, text, provider) by the first provider, in order, that has a text that isn't blank."""
    out, texts, names = ids, [], []
    for i, (name, rows) in enumerate(providers):
        out = out.join(rows.select(key, F.col("text").alias(f"_t{i}")), key, "left")
        good = F.length(F.trim(f"_t{i}")) > 0
        texts.append(F.when(good, F.col(f"_t{i}")))
        names.append(F.when(good, F.lit(name)))
    return out.select(key, F.coalesce(*texts).alias("text"), F.coalesce(*names, F.lit("none")).alias("provider"))


def snapshot(tables: dict[str, DataFrame], folder: str, version: str) -> None:
    """A version of tables: Parquet for each and, last of all, the manifest that makes it complete."""
    spark = next(iter(tables.values())).sparkSession
    counts = []
    for name, df in tables.items():
        df.write.parquet(f"{folder}/{version}/{name}")
        counts.append((name, json.dumps(df.schema.jsonValue())))
    spark.createDataFrame(counts, "name string, schema string").coalesce(1).write.json(f"{folder}/{version}/_manifest")


def restore(spark: SparkSession, folder: str, version: str) -> dict[str, DataFrame]:
    names = spark.read.schema("name string, schema string").json(f"{folder}/{version}/_manifest").collect()
    return {r.name: spark.read.schema(T.StructType.fromJson(json.loads(r.schema))).parquet(f"{folder}/{version}/{r.name}") for r in names}


Reader = Callable[[DataFrame], DataFrame]


def reader_for(config: dict) -> Reader:
    """The reader of a source's landed rows, by its type; an unknown type is an error."""
    kind = config.get("type")
    readers: dict[str, Reader] = {
        "rss": lambda rows: feed_items(rows, "body"),
        "ojs": lambda rows: feed_items(rows, "body"),
        "works": lambda rows: works_from_json(rows, "body"),
        "html": lambda rows: scrape(rows, "url", "body", config),
        "custom": lambda rows: scrape(rows, "url", "body", config),
        "site": lambda rows: scrape(rows, "url", "body", SITES[config["site"]] | {k: v for k, v in config.items() if k in ("since", "until")}),
    }
    if kind not in readers:
        raise ValueError(f"unknown type of source: {kind}")
    return readers[kind]


def works_filter(source: str, today: str, days: int = 90, since: int | None = None, until: int | None = None) -> tuple[str, str, str | None]:
    """(source filter, first day, last day) of a works request: an ISSN or a source's id, and a rolling window or bounds of years."""
    from datetime import date, timedelta

    source = source.strip()
    issn = re.fullmatch(r"(?:issn:)?(\d{4}-\d{3}[\dXx])", source)
    name = re.search(r"(S\d+)$", source)
    if not issn and not name:
        raise ValueError(f"neither an ISSN nor an id of a source: {source}")
    first = f"{since}-01-01" if since else str(date.fromisoformat(today) - timedelta(days=days))
    by = f"primary_location.source.issn:{issn[1].upper()}" if issn else f"primary_location.source.id:{name[1]}"
    return by, first, f"{until}-12-31" if until is not None else None


def landed_source():
    """A Python data source (``format("landed_works")``) of landed pages of a works interface.

    Option ``first`` names the files of the first page of each request, separated by commas; a page names
    the file of the next one in ``meta.next_cursor``, until one has none.  A request is a partition, as its
    pages can only be found one after the other.  Options ``from`` and ``to`` (days) leave out works
    published outside them.
    """
    from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

    class LandedReader(DataSourceReader):
        def __init__(self, options):
            self.first = [p for p in options.get("first", "").split(",") if p]
            self.low, self.high = options.get("from", ""), options.get("to", "9999")

        def partitions(self):
            return [InputPartition(p) for p in self.first]

        def read(self, partition):
            path, seen = partition.value, set()
            while path and path not in seen:
                seen.add(path)
                with _open(path if "://" in path else f"file://{path}", "r") as f:
                    page = json.loads(f.read())
                works = [w for w in page.get("results", []) if self.low <= (w.get("publication_date") or "") <= self.high]
                yield (path, json.dumps({"results": works}))
                cursor = (page.get("meta") or {}).get("next_cursor")
                path = f"{path.rsplit('/', 1)[0]}/{cursor}" if cursor else None

    class LandedWorks(DataSource):
        @classmethod
        def name(cls):
            return "landed_works"

        def schema(self):
            return "path string, body string"

        def reader(self, schema):
            return LandedReader(self.options)

    return LandedWorks


def landing_source():
    """A streaming data source (``format("landing_works")``) of the pages that land in a folder of a works interface.

    Option ``folder`` names it.  Pages are taken in the order of their names, which must ascend as they land; the offset is
    the last name taken, so a stream that starts again from its checkpoint reads only what has landed since.  A file is a
    partition.  An empty folder has no rows yet.
    """
    from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

    class Landing(DataSourceStreamReader):
        def __init__(self, options):
            self.folder = options["folder"]

        def _names(self):
            from pyarrow import fs

            system, path = fs.FileSystem.from_uri(self.folder if "://" in self.folder else f"file://{self.folder}")
            found = system.get_file_info(fs.FileSelector(path, allow_not_found=True))
            return sorted(f.base_name for f in found if f.type == fs.FileType.File and f.base_name.endswith(".json"))

        def initialOffset(self):
            return {"after": ""}

        def latestOffset(self):
            return {"after": max(self._names(), default="")}

        def partitions(self, start, end):
            return [InputPartition(f"{self.folder}/{n}") for n in self._names() if start["after"] < n <= end["after"]]

        def read(self, partition):
            path = partition.value
            with _open(path if "://" in path else f"file://{path}", "r") as f:
                yield (path.rsplit("/", 1)[1], f.read().decode())

        def commit(self, end):
            pass

    class LandingWorks(DataSource):
        @classmethod
        def name(cls):
            return "landing_works"

        def schema(self):
            return "name string, body string"

        def streamReader(self, schema):
            return Landing(self.options)

    return LandingWorks
