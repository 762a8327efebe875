"""The registered queries against their SQL or a plain version, and the pipeline stage by stage."""

import math
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from citemill.llm import quality, queries
from tests.llm import brute
from tests.oracle import assert_same, connect

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_matches_sql(spark, name):
    assert_same(queries.QUERIES[name](spark, SF), connect(SF), queries.ORACLE[name])


def _documents(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]


def _encoded(spark, name, end):
    from tokenizers import Tokenizer

    import public_tokenizers

    lib = Tokenizer.from_file(public_tokenizers.path(name))
    return {i: np.array([*lib.encode(t or "", add_special_tokens=False).ids, end], "<u4") for i, t in sorted(_documents(spark))}


def test_token_queries(spark):
    """Ids of the registered queries, with their vocabularies and ends, against the library alone."""
    ids = _encoded(spark, "byte_bpe_50k.json", 0)
    files = {r.doc_id: r for r in queries.op2_token_files(spark, SF).collect()}
    counts = {r.doc_id: r.n_tokens for r in queries.op5_token_counts(spark, SF).collect()}
    at = 0
    for i, x in ids.items():
        assert (files[i].start, files[i].n_tokens, files[i].ids_crc32) == (at, len(x), zlib.crc32(x.tobytes()))
        at += len(x)
    assert counts == {i: len(x) for i, x in ids.items()} and len(files) == len(ids)


def test_packing_query(spark):
    ids = _encoded(spark, "word_bpe_49k.json", 2)
    done, room = {}, {}
    for r in queries.op8_packing(spark, SF).orderBy("doc_id", "start").collect():
        own = ids[r.doc_id][r.start : r.start + r.length]
        assert r.start == done.get(r.doc_id, 0) and r.doc_tokens == len(ids[r.doc_id]) and r.ids_crc32 == zlib.crc32(own.tobytes())
        done[r.doc_id] = r.start + r.length
        room.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert done == {i: len(x) for i, x in ids.items()}
    for pieces in room.values():
        ends = np.cumsum([n for _, n in sorted(pieces)]).tolist()
        assert [o for o, _ in sorted(pieces)] == [0, *ends[:-1]] and ends[-1] <= 4096
    assert sum(sum(n for _, n in x) < 4096 for x in room.values()) <= 1


def test_quality_query_against_plain_scores(spark):
    """Scores, folds and predictions computed row by row from the model's tables."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = queries.quality_model(spark, docs, SF)
    out = {r.doc_id: r for r in queries.op7_quality_classifier(spark, SF).collect()}
    assert len(out) == docs.count()
    for i, t in _documents(spark):
        x = quality.features(pa.array([t], pa.string()))[0]
        z = model.start
        for j, (edges, table) in enumerate(zip(model.edges, model.tables, strict=True)):
            z += table[sum(e <= x[j] for e in edges)]
        for (a, b), table in zip(model.pairs, model.pair_tables, strict=True):
            z += table[sum(e <= x[a] for e in model.pair_edges[a]), sum(e <= x[b] for e in model.pair_edges[b])]
        s = 1 / (1 + math.exp(-z))
        assert out[i].score == pytest.approx(s, abs=1e-9) and out[i].predicted == int(out[i].score >= 0.3) and out[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0)


def test_no_label_of_a_held_out_document_is_learned(spark, monkeypatch):
    """Other labels for the held-out documents change nothing."""
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    turned = labels.withColumn("quality", F.when(queries.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    before = queries.op7_quality_classifier(spark, SF).orderBy("doc_id").collect()
    monkeypatch.setattr(queries, "_table", lambda s, d, name, f=queries._table: turned if name == "labels" else f(s, d, name))
    assert queries.op7_quality_classifier(spark, SF).orderBy("doc_id").collect() == before


def test_quality_query_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    out = queries.op7_quality_classifier(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out")
    right = out.agg(F.avg((F.col("predicted") == F.col("quality")).cast("int"))).first()[0]
    assert right > 0.95


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, SF).cache()
        assert after.columns == columns
        n = after.count()
        rows = [(r.doc_id, r.text) for r in docs.collect()]
        if name == "line_dedup":
            assert {r.doc_id: (r.text, r.n_chars) for r in after.collect()} == {i: (t, len(t)) for i, (_, _, t) in brute.lines(rows).items()}
        elif name == "near_dedup":
            assert sorted(r.doc_id for r in after.collect()) == sorted(i for i, (_, c) in brute.components(rows).items() if c == i)
        elif name == "decontamination":
            items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
            bad = {i for i, (w, h, _) in brute.contamination(rows, items).items() if h and 20 * h >= w}
            assert {r.doc_id for r in after.collect()} == {i for i, _ in rows} - bad
        assert n <= before
        docs, before = after, n
    pieces = corpus_pipeline.run(spark, SF).select("doc_id", "length", "doc_tokens").collect()
    assert {r.doc_id for r in pieces} == {r.doc_id for r in docs.collect()}


def test_pipeline_of_odd_rows(spark, tmp_path):
    """Null and empty texts, repeated rows and an empty table pass all stages."""
    good = spark.read.parquet(f"{SF}/documents.parquet")
    schema = good.schema
    rows = [(900001, None, "en", "s", 0), (900002, "", "en", "s", 0), (900003, " \n ", None, None, None), (900004, "one two", "en", "s", 7)]
    for name, docs in (("odd", good.unionByName(good.limit(5)).unionByName(spark.createDataFrame(rows, schema))), ("none", good.where("false"))):
        docs.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        for other in ("labels", "benchmark"):
            table = spark.read.parquet(f"{SF}/{other}.parquet")
            (table if name == "odd" else table.where("false")).write.parquet(f"{tmp_path}/{name}/{other}.parquet")
        pieces = corpus_pipeline.run(spark, f"{tmp_path}/{name}").select("doc_id", "start", "length").collect()
        assert bool(pieces) == (name == "odd") and {r.doc_id for r in pieces} <= {r.doc_id for r in docs.select("doc_id").collect()}
