"""Profiles of works, as models write them: four blocks of ``KEY: value | KEY: value`` lines become nodes and edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# fixed values: headings of the blocks, words for a relation with their signs, names of nodes, and what says that a term is the work's own
BLOCKS = {"SELBSTPOSITION": "position", "QUELLEN": "source", "BEGRIFFE": "term", "TRAJEKTORIE": "own"}
LEADS = {"position": "ZIEL", "source": "QUELLE", "term": "BEGRIFF", "own": "SELBSTBEZUG"}
RELATIONS = {"affirms": "+", "extends": "+", "contrasts": "-", "reserves": "-", "rejects": "-"}
SELF, UNSTATED = "position:self", "(Selbstposition nicht explizit)"
OWN_WORDS = ("werk selbst", "selbst", "eigen", "anschluss", "anlehnung", "angelehnt", "umakzentuiert", "umformuliert")
_LETTERS = "a-zäöüßéèàóíú"


def _strip(c: Column, marks: str = r"\s") -> Column:
    return F.regexp_replace(c, f"^[{marks}]+|[{marks}]+$", "")


def _field(line: Column, name: str) -> Column:
    """The value of the last field of that name; null where there is none or it is empty."""
    cut = F.transform(F.split(line, r"\|"), lambda p: F.split(p, ":", 2))
    own = F.filter(cut, lambda p: (F.size(p) == 2) & (F.upper(_strip(p[0])) == name))
    return F.nullif(_strip(_strip(_strip(F.try_element_at(own, F.lit(-1))[1]), "«»")), F.lit(""))


def _tokens(c: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(c), f"[^{_LETTERS}]+"), lambda t: F.length(t) > 2))


def _relation(c: Column) -> Column:
    """The relation that the text names first."""
    low = F.lower(F.coalesce(c, F.lit("")))
    places = F.array(*[F.struct(F.regexp_instr(low, F.lit(rf"\b{k}\b")).alias("at"), F.lit(k).alias("name")) for k in RELATIONS])
    return F.array_min(F.filter(places, lambda p: p["at"] > 0))["name"]


def parse_profiles(rows: DataFrame, key: str, text: str, topology: DataFrame | None = None) -> DataFrame:
    """(key, kind, name, type, label, source, target, sigma, quote, address, density) of profiles.

    Nodes have kind ``node`` and as name their key in the work (``position:self``, ``source:..``, ``term:..``, ``own:0`` and
    on), of lines with one key the first; edges have kind ``edge``, their relation as name, and source and target;
    ``unparsed`` lines have the line as label: those without the form, in no known block, without the block's leading
    field, or of a source without a known relation.  Emphasis and list marks are taken off first.

    A source's relation is the known word that comes first.  A term is the work's own unless its origin names a source
    that an earlier line has, by a common word; the first such source coins it.  Edges from a position that no
    line states get a node that says so.  ``topology`` (key, author, density) gives sources the density of
    the first author whose name is one of their words.  Null and empty texts have no rows; the same key in
    several rows is one profile whose lines lie side by side, so keys should be of one row.
    """
    line = _strip(F.col("raw"))
    line = F.regexp_replace(F.replace(line, F.lit("**"), F.lit("")), r"^[-•*]\s+", "")
    lines = rows.select(F.col(key).alias("_k"), F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), "\n")).alias("at", "raw")).select("_k", "at", line.alias("line")).where("line NOT IN ('', '—')")
    head = F.regexp_extract("line", r"^\[([A-ZÄÖÜ]+)\]$", 1)
    known = F.create_map(*[F.lit(x) for kv in BLOCKS.items() for x in kv])
    heading = F.when(head != "", F.struct(F.try_element_at(known, head).alias("block")))
    so_far = Window.partitionBy("_k").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    lines = lines.withColumns({"head": head, "block": F.last(heading, ignorenulls=True).over(so_far)["block"]}).where("head = ''")
    formed = F.col("line").rlike(r"^[A-ZÄÖÜ]+\s*:")
    lead = F.coalesce(*[F.when(F.col("block") == b, _field(F.col("line"), name)) for b, name in LEADS.items()])
    relation = F.when(F.col("block") == "source", _relation(_field(F.col("line"), "RELATION")))
    lines = lines.withColumns({"lead": F.when(formed, lead), "relation": relation})
    ok = F.col("lead").isNotNull() & ((F.col("block") != "source") | F.col("relation").isNotNull())
    quote, address, origin = (_field(F.col("line"), name) for name in ("BELEG", "ADRESSE", "HERKUNFT"))
    parsed = lines.where(ok).select("_k", "at", "block", "lead", "relation", quote.alias("quote"), address.alias("address"), origin.alias("origin"))
    number = F.row_number().over(Window.partitionBy("_k", "block").orderBy("at")) - 1
    name = F.when(F.col("block") == "position", F.lit(SELF)).when(F.col("block") == "own", F.concat(F.lit("own:"), number.cast("string"))).otherwise(F.concat("block", F.lit(":"), "lead"))
    parsed = parsed.withColumn("name", name)

    none = F.lit(None).cast("string")
    first = F.row_number().over(Window.partitionBy("_k", "name").orderBy("at"))
    kind = F.when(F.col("block") == "own", "source").otherwise(F.col("block"))
    nodes = parsed.withColumn("n", first).where("n = 1").select("_k", "at", "name", kind.alias("type"), "lead", "quote", "address")

    own = F.col("origin").isNull() | F.lower("origin").rlike("|".join(OWN_WORDS))
    coined = parsed.where((F.col("block") == "term") & ~own).select("_k", "at", F.explode(_tokens(F.col("origin"))).alias("t"))
    sources = nodes.where("type = 'source'").select("_k", F.col("at").alias("there"), F.col("name").alias("coiner"), F.explode(_tokens(F.col("lead"))).alias("t"))
    coiners = coined.join(sources, ["_k", "t"]).where("there < at").groupBy("_k", "at").agg(F.min_by("coiner", "there").alias("coiner"))
    edges = parsed.where("block <> 'position'").join(coiners, ["_k", "at"], "left")
    edge = F.when(F.col("block") == "term", "coins").when(F.col("block") == "own", "trajectory").otherwise(F.col("relation"))
    sign = F.try_element_at(F.create_map(*[F.lit(x) for kv in RELATIONS.items() for x in kv]), F.col("relation"))
    edges = edges.select("_k", edge.alias("name"), F.coalesce("coiner", F.lit(SELF)).alias("source"), F.col("name").alias("target"), sign.alias("sigma"), "quote", "address")

    stated = nodes.where(F.col("name") == SELF).select("_k")
    missing = edges.where(F.col("source") == SELF).select("_k").distinct().join(stated, "_k", "left_anti")
    nodes = nodes.unionByName(missing.select("_k", F.lit(-1).alias("at"), F.lit(SELF).alias("name"), F.lit("position").alias("type"), F.lit(UNSTATED).alias("lead"), none.alias("quote"), none.alias("address")))
    density = F.lit(None).cast("int").alias("density")
    if topology is not None:
        authors = topology.select(F.col(key).alias("_k"), F.lower("author").alias("t"), F.col("author").alias("who"), F.col("density").cast("int").alias("density"))
        words = nodes.where("type = 'source' AND name NOT LIKE 'own:%'").select("_k", "name", F.explode(_tokens(F.col("lead"))).alias("t"))
        dense = words.join(authors, ["_k", "t"]).groupBy("_k", "name").agg(F.min_by("density", "who").alias("density"))
        nodes, density = nodes.join(dense, ["_k", "name"], "left"), F.col("density")
    columns = ["type", "label", "source", "target", "sigma", "quote", "address"]
    out = nodes.select("_k", F.lit("node").alias("kind"), "name", "type", F.col("lead").alias("label"), none.alias("source"), none.alias("target"), none.alias("sigma"), "quote", "address", density)
    gone = F.lit(None).cast("int").alias("density")
    out = out.unionByName(edges.select("_k", F.lit("edge").alias("kind"), "name", none.alias("type"), none.alias("label"), "source", "target", "sigma", "quote", "address", gone))
    left = lines.where(~F.coalesce(ok, F.lit(False)))
    out = out.unionByName(left.select("_k", F.lit("unparsed").alias("kind"), none.alias("name"), none.alias("type"), F.col("line").alias("label"), *[none.alias(c) for c in columns[2:]], gone))
    return out.withColumnRenamed("_k", key)
