"""The operators applied to their whole tables with production parameters, and SQL for those that SQL can express."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citemill.llm import bpe, decontam, dialogues, linededup, merkle, minhash, packing, quality, separators, storage, tokenfiles, urlfilter, vafile, warc

RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]
LEAST_SCORE = 0.3


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    storage.small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, shards = tokenfiles.write_token_files(_table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.json"), 0)
    return tokenfiles.read_token_files(spark, shards).select("doc_id", "start", "n_tokens", "ids_crc32")


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.read_warc(spark, *warc.write_warc(_table(spark, sf_dir, "pages")))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = urlfilter.judge_urls(_table(spark, sf_dir, "pages"), RULES)
    return judged.select("page_id", F.col("_host").alias("host"), F.col("_path").alias("path"), F.col("_rule").alias("rule"), F.col("_verdict").alias("verdict"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return separators.token_counts(_table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.json"), 65535)  # 50256 is <|endoftext|>, which a text may quote


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = linededup.drop_repeated_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_dropped").alias("n_dropped"), F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def held_out(doc_id: str = "doc_id"):
    return F.crc32(F.col(doc_id).cast("string")) % 5 == 0


def quality_model(spark: SparkSession, docs: DataFrame, sf_dir: str) -> quality.Additive:
    return quality.train(docs, _table(spark, sf_dir, "labels").where(~held_out()))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    out = quality.score(docs, quality_model(spark, docs, sf_dir))
    return out.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= LEAST_SCORE).cast("int").alias("predicted"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), _tokenizer("word_bpe_49k.json"), 2).drop("ids")


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    out = decontam.find_contamination(docs, _table(spark, sf_dir, "benchmark"))
    names = F.array_join(F.array_sort(F.transform("_items", lambda x: x.cast("string"))), ",")
    return out.select("doc_id", F.col("_n_words").alias("n_words"), F.col("_n_hit").alias("n_hit"), F.size("_items").cast("long").alias("n_items"), F.sha2(names.cast("binary"), 256).alias("items_sha256"), decontam.is_contaminated().alias("contaminated"))


def op10_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vafile.top_k(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    others = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    leaf = merkle.leaf_digest(*others, F.col("text"))
    tampered = merkle.leaf_digest(*others, F.replace("text", F.lit("\n"), F.lit("")))
    even = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    rows = docs.select("doc_id", "source", leaf.alias("leaf"), F.when(even, tampered).alias("tampered"))
    out = merkle.manifest(rows, "source", "doc_id", "leaf").withColumn("folded_root", merkle.folded(F.coalesce("tampered", "leaf")))
    proof = F.sha2(merkle.siblings(), 256)
    return out.select("doc_id", "leaf", F.col("_subroot").alias("subroot"), F.col("_root").alias("root"), proof.alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("_root")).alias("verified"))


def damaged(rows: DataFrame) -> DataFrame:
    """``conversations`` with the damage that the contract deals out; ``_dropped`` marks the rows that it takes away."""
    filled = {c: F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn", "role", "text")}
    kind = F.crc32(F.concat(filled["conv_id"], F.lit(":"), filled["turn"])) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.translate(filled["text"], ".!?", "")).otherwise(filled["text"])
    role = F.when(kind == 4, "user").otherwise(filled["role"])
    times = F.explode(F.array_repeat(F.lit(0), F.when(kind == 3, 2).otherwise(1))).alias("_time")
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (kind == 0).alias("_dropped"), times)


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    audits, mended = dialogues.repair(damaged(_table(spark, sf_dir, "conversations")), dropped=F.col("_dropped"))
    hashes = dialogues.transcripts(mended).withColumnRenamed("_conv", "_of")
    out = audits.join(hashes, F.col("_conv").eqNullSafe(F.col("_of")), "left")
    return out.select(F.col("_conv").alias("conv_id"), "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", F.coalesce("_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))


def _token_digests(batches):
    """A row for each document, from the parts of its ids and of its decoded text."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])
    n, ids_hash, text_hash = 0, hashlib.sha256(), hashlib.sha256()
    for batch in batches:
        done = []
        at, flat = batch.column("_ids").offsets.to_pylist(), batch.column("_ids").values.to_numpy().tolist()
        for i, (doc_id, last, text) in enumerate(zip(batch.column("doc_id").to_pylist(), batch.column("_last").to_pylist(), batch.column("_text").to_pylist(), strict=True)):
            ids = flat[at[i] : at[i + 1]]
            if n and ids:
                ids_hash.update(b",")
            ids_hash.update(",".join(map(str, ids)).encode())
            text_hash.update(text.encode())
            n += len(ids)
            if last:
                done.append((doc_id, n, ids_hash.hexdigest(), text_hash.hexdigest()))
                n, ids_hash, text_hash = 0, hashlib.sha256(), hashlib.sha256()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done, strict=True), schema, strict=True)], schema=schema)


def op13_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _tokenizer("byte_bpe_50k.json")
    docs = _table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long"), "text")
    steps = lambda batches: _token_digests(bpe.decode_batches(bpe.encode_batches(batches, path, "text"), path))
    return docs.mapInArrow(steps, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_minhash_near_dedup, op2_token_files, op3_warc, op4_url_filter, op5_token_counts, op6_line_dedup, op7_quality_classifier, op8_packing, op9_decontamination, op10_exact_top_k, op11_merkle_manifest, op12_conversation_repair, op13_bpe_round_trip)
}

_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE: dict[str, str] = {
    "op1_minhash_near_dedup": rf"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array({_LOW}, '[ \t\n\v\f\r]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + least(5, len(w)) - 1], ' ') AS g FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - 4, 1))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
sym AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r(doc_id, root) AS (SELECT doc_id, doc_id FROM n UNION SELECT sym.b, r.root FROM r JOIN sym ON sym.a = r.doc_id WHERE r.root < sym.b),
m AS (SELECT doc_id, min(root) AS root FROM r GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(m.root, d.doc_id) AS component_id, coalesce(m.root, d.doc_id) = d.doc_id AS kept FROM d LEFT JOIN n USING (doc_id) LEFT JOIN m USING (doc_id)""",
    "op9_decontamination": rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOW}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (SELECT item_id, regexp_extract_all({_LOW}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
k AS (SELECT item_id, w, least(13, len(w)) AS k FROM i WHERE len(w) > 0),
v AS (SELECT DISTINCT item_id, k, array_to_string(w[j : j + k - 1], ' ') AS s FROM (SELECT item_id, w, k, unnest(generate_series(1, len(w) - k + 1)) AS j FROM k)),
x AS (SELECT doc_id, k, j, array_to_string(w[j : j + k - 1], ' ') AS s FROM (SELECT doc_id, w, k, unnest(generate_series(1, len(w) - k + 1)) AS j FROM d, (SELECT DISTINCT k FROM k) WHERE len(w) >= k)),
h AS (SELECT doc_id, j, k, item_id FROM x JOIN v USING (k, s)),
p AS (SELECT doc_id, count(DISTINCT spot) AS n FROM (SELECT doc_id, unnest(generate_series(j, j + k - 1)) AS spot FROM (SELECT DISTINCT doc_id, j, k FROM h)) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n, string_agg(name, ',' ORDER BY name) AS names FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS name FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(p.n, 0) AS n_hit, coalesce(t.n, 0) AS n_items, sha256(coalesce(t.names, '')) AS items_sha256, coalesce(p.n, 0) > 0 AND 20 * coalesce(p.n, 0) >= len(w) AS contaminated
FROM d LEFT JOIN p USING (doc_id) LEFT JOIN t USING (doc_id)""",
    "op3_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
d AS (SELECT page_id, octet_length(encode(body)) AS payload_bytes, sha1(body) AS payload_digest FROM p),
m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS top FROM d)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 1000 AND page_id <> top THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND page_id <> top THEN top END AS refers_to
FROM m""",
    "op4_url_filter": r"""
WITH u AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
r(rhost, rpath, v) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
m AS (SELECT h.page_id, max_by(rhost || rpath, length(rhost || rpath)) AS rule, max_by(v, length(rhost || rpath)) AS v
  FROM h JOIN r ON (h.host = rhost OR ends_with(h.host, '.' || rhost)) AND starts_with(h.path, rpath) GROUP BY h.page_id)
SELECT h.page_id, h.host, h.path, m.rule, coalesce(m.v, 'allow') AS verdict FROM h LEFT JOIN m USING (page_id)""",
    "op6_line_dedup": r"""
WITH s AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM s),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
g AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
j AS (SELECT k.*, g.keeper IS NOT NULL AND g.keeper <> k.doc_id AS gone FROM k LEFT JOIN g USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM j GROUP BY doc_id""",
    "op10_exact_top_k": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
e AS (SELECT vec_id, unnest(e) AS x, generate_subscripts(e, 1) AS d FROM v),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(sum(q.x * c.x) AS BIGINT) AS score FROM e q JOIN e c ON q.d = c.d AND q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0 GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5""",
}


def _crc32(text: str) -> str:
    """SQL for the unsigned CRC-32 of an ASCII text."""
    byte = "lambda d, _: xor(d >> 1, (d & 1) * 3988292384)"
    codes = f"list_transform(range(1, length({text}) + 1), lambda i: CAST(ascii(substr({text}, i, 1)) AS BIGINT))"
    return f"xor(list_reduce({codes}, lambda c, b: list_reduce(range(8), {byte}, xor(c, b)), CAST(4294967295 AS BIGINT)), 4294967295)"


def _merkle_sql(levels: int = 13) -> str:
    """Trees of up to 3 ** levels leaves, level by level; nodes are those of the groups (n), then those over the groups (m)."""
    part = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE octet_length(encode(CAST({c} AS VARCHAR))) || ':' || {c} END"
    leaf = lambda text: "sha256(" + " || ".join(map(part, ("doc_id", "source", "lang", "n_chars", text))) + ")"
    steps = [
        f"""l AS MATERIALIZED (SELECT *, CASE WHEN {_crc32("CAST(doc_id AS VARCHAR)")} % 2 = 0 THEN {leaf("replace(text, chr(10), '')")} ELSE leaf END AS f
FROM (SELECT *, {leaf("text")} AS leaf, coalesce('+' || source, '') AS g FROM documents))""",
        "p0 AS MATERIALIZED (SELECT doc_id, leaf, g, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, f, '' AS proof FROM l)",
        "n0 AS MATERIALIZED (SELECT g, i, leaf AS d, count(*) OVER (PARTITION BY g) AS n FROM p0)",
    ]

    def grow(nodes: str, paths: str) -> None:
        for k in range(levels):
            side = lambda a, b, k=k: f"coalesce(string_agg(d, '') OVER (PARTITION BY g, i // 3 ORDER BY i ROWS BETWEEN {a} AND {b}), '')"
            steps.append(f"s{nodes}{k} AS MATERIALIZED (SELECT g, i, n, {side('UNBOUNDED PRECEDING', '1 PRECEDING')} AS b, {side('1 FOLLOWING', 'UNBOUNDED FOLLOWING')} AS a FROM {nodes}{k})")
            steps.append(f"{paths}{k + 1} AS MATERIALIZED (SELECT p.* REPLACE (i // 3 AS i, CASE WHEN n > 1 THEN sha256(b || f || a) ELSE f END AS f, CASE WHEN n > 1 THEN proof || b || a ELSE proof END AS proof) FROM {paths}{k} p JOIN s{nodes}{k} s USING (g, i))")
            steps.append(f"{nodes}{k + 1} AS MATERIALIZED (SELECT g, i // 3 AS i, CASE WHEN any_value(n) > 1 THEN sha256(string_agg(d, '' ORDER BY i)) ELSE any_value(d) END AS d, (any_value(n) + 2) // 3 AS n FROM {nodes}{k} GROUP BY g, i // 3)")

    grow("n", "p")
    steps.append(f"m0 AS MATERIALIZED (SELECT '' AS g, row_number() OVER (ORDER BY g) - 1 AS i, d, count(*) OVER () AS n, g AS own FROM n{levels})")
    steps.append(f"q0 AS MATERIALIZED (SELECT p.doc_id, p.leaf, '' AS g, m0.i, p.f, p.proof, m0.d AS subroot FROM p{levels} p JOIN m0 ON p.g = m0.own)")
    grow("m", "q")
    return f"WITH {', '.join(steps)}\nSELECT doc_id, leaf, subroot, d AS root, sha256(proof) AS proof_sha256, f AS folded_root, f = d AS verified FROM q{levels}, m{levels}"


def _repair_sql() -> str:
    """Least cost and audit from each of four states to the end, last row first; ``000012KKD`` is cost 12, so the least text is the least cost, then the least audit."""
    add = lambda v, cost, edit: f"lpad(CAST(CAST({v}[1:6] AS INTEGER) + {cost} AS VARCHAR), 6, '0') || '{edit}' || {v}[7:]"
    far = "'900000'"
    keeps = {"b": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}  # b: nothing yet
    given = {"b": "u", "s": "u", "u": "a", "a": "u"}
    stays = "CASE WHEN cut THEN 3 ELSE 0 END"
    moves = {}
    for q, to in keeps.items():
        kept = " ".join(f"WHEN initial = '{c}' THEN {add(t, stays, 'K')}" for c, t in to.items())
        moves[q] = f"least({add(q, 4, 'D')}, CASE WHEN gone THEN {far} ELSE least({add(given[q], '3 + ' + stays, 'R')}, CASE {kept} ELSE {far} END) END)"
    inserted = lambda: ", ".join(f"least({q}, {add(given[q], 3, 'I')}) AS {q}" for q in keeps)
    step = f"SELECT c, i - 1 AS i, {', '.join(f'{m} AS {q}' for q, m in moves.items())} FROM z JOIN y USING (c, i)"
    for _ in range(3):
        step = f"SELECT c, i, {inserted()} FROM ({step})"
    start = "SELECT c, n AS i, '000000' AS b, '900000' AS s, '900000' AS u, '000000' AS a FROM counts"
    for _ in range(3):
        start = f"SELECT c, i, {inserted()} FROM ({start})"
    return rf"""
WITH RECURSIVE d AS (SELECT coalesce(CAST(conv_id AS VARCHAR), ' ') AS c, conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(turn AS VARCHAR), ' ') AS t FROM conversations),
k AS MATERIALIZED (SELECT *, {_crc32("(c || ':' || t)")} % 20 AS kind FROM d),
e AS (SELECT c, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS copy FROM k WHERE kind <> 0),
o AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, role, sha256(role || chr(0) || text)) AS i FROM e),
x AS (SELECT *, row_number() OVER (PARTITION BY c, role, text ORDER BY i) > 1 AS again, NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank, NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') AS cut_off, role[1:1] AS initial FROM o),
y AS MATERIALIZED (SELECT *, blank OR again AS gone, NOT blank AND NOT again AND cut_off AS cut, lag(initial) OVER (PARTITION BY c ORDER BY i) || initial AS pair FROM x),
counts AS MATERIALIZED (SELECT c, any_value(conv_id) AS conv_id, count(y.i) AS n, coalesce(max(y.turn) - min(y.turn) + 1 - count(DISTINCT y.turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (NOT blank AND again) AS duplicate, count(*) FILTER (cut) AS truncated,
  count(*) FILTER (pair IS NOT NULL AND pair NOT IN ('su', 'ua', 'au')) AS illegal FROM (SELECT DISTINCT c, conv_id FROM k) LEFT JOIN y USING (c) GROUP BY c),
z AS ({start} UNION ALL {step}),
a AS MATERIALIZED (SELECT c, CAST(b[1:6] AS BIGINT) AS cost, b[7:] AS audit FROM z WHERE i = 0),
w AS (SELECT *, edit <> 'I' AS own, sum(CAST(edit <> 'I' AS INTEGER)) OVER (PARTITION BY c ORDER BY spot) AS i FROM (SELECT c, unnest(string_split(audit, '')) AS edit, generate_subscripts(string_split(audit, ''), 1) AS spot FROM a WHERE audit <> '')),
v AS (SELECT w.*, y.role, CASE WHEN own THEN y.text ELSE '' END AS text, row_number() OVER (PARTITION BY w.c ORDER BY spot) AS place, first_value(edit = 'K' AND y.initial = 's') OVER (PARTITION BY w.c ORDER BY spot) AS led FROM w LEFT JOIN y ON y.c = w.c AND y.i = w.i WHERE edit <> 'D'),
r AS (SELECT c, string_agg(CASE WHEN edit = 'K' THEN role WHEN (place + CAST(led AS INTEGER)) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || text, chr(10) ORDER BY place) AS lines FROM v GROUP BY c)
SELECT conv_id, CAST(gaps AS BIGINT) AS gaps, blank, duplicate, truncated, illegal, cost, audit, sha256(coalesce(lines, '')) AS repaired_sha256 FROM counts JOIN a USING (c) LEFT JOIN r USING (c)"""


ORACLE |= {"op11_merkle_manifest": _merkle_sql(), "op12_conversation_repair": _repair_sql()}
