"""Operators of the subpackage against plain versions, on inputs with nulls, ties, copies, long and empty texts."""

import math
import random
import zlib
from fractions import Fraction

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from citemill.llm import bytescan, components, decontam, linededup, minhash, packing, quality, separators, storage, tokenfiles, tokens, urlfilter, vafile, warc
from tests.llm import brute

BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")


def texts(seed=1, n=60):
    """Random prose with copies, near copies, shared lines, and the odd cases."""
    rng = random.Random(seed)
    vocab = ["".join(rng.choice("abcdeéñß") for _ in range(rng.randint(1, 8))) for _ in range(300)]
    shared = [" ".join(rng.choices(vocab, k=12)) for _ in range(4)]
    out = []
    for _ in range(n):
        ls = [" ".join(rng.choices(vocab, k=rng.randint(1, 30))) for _ in range(rng.randint(1, 6))]
        if rng.random() < 0.5:
            ls.insert(rng.randint(0, len(ls)), rng.choice(["", "\t ", "  "]) + rng.choice(shared).upper() + " ")
        out.append("\n".join(ls))
    for _ in range(n // 2):
        w = rng.choice(out[:n]).split(" ")
        if rng.random() < 0.7:
            w[rng.randrange(len(w))] = "changed"
        out.append(" ".join(w))
    out += [None, "", " \n ", "one", "one two", "ONE two", "a b c d e", "x " * 9000, out[0], out[0], "中文 字 " + out[1], "\n\n\n"]
    return out


@pytest.fixture(scope="module")
def docs(spark):
    rows = list(enumerate(texts()))
    df = spark.createDataFrame([(i, t, "keep", i % 3) for i, t in rows], "doc_id long, text string, _text string, n int").repartition(5)
    return rows, df


@pytest.mark.parametrize("path", [BYTES, WORDS])
def test_encoder_equals_library(path):
    rng = random.Random(3)
    parts = ["a", "b", "é", "ß", "'", "s", "t", "re", " ", "  ", "\n", "\t", "1", "23", ".", "!", "Œ", "×", "\u00a0", "中", "ll", "<|endoftext|>", "e\u0301", "İ", "\r\n", "VE", "'ve", " '", "\x1c", "ſ"]
    rows = ["".join(rng.choices(parts, k=rng.randint(0, 14))) for _ in range(5000)] + [None, "", "ab" * 3000 + " x", "it's, we'll 'tis"]
    enc = tokens.Encoder(path)
    ids, at = enc.encode(pa.array(rows))
    want = [x.ids for x in enc.lib.encode_batch([r or "" for r in rows], add_special_tokens=False)]
    assert [ids[at[i] : at[i + 1]].tolist() for i in range(len(rows))] == want


def test_hash_table():
    t, h = bytescan.Table(4), bytescan.mix(np.arange(1, 5001, dtype=np.uint64))
    assert (t.find(h) == -1).all()
    at = np.concatenate([t.insert(h[:100]), t.insert(h[100:])])
    assert (t.find(h) == at).all() and sorted(at) == list(range(5000))


def test_near_duplicates(docs):
    rows, df = docs
    want = brute.components(rows)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(df).collect()}
    assert got == {i: (n, c, c == i) for i, (n, c) in want.items()}
    assert sorted(r.doc_id for r in minhash.drop_near_duplicates(df).collect()) == sorted(i for i, (_, c) in want.items() if c == i)


def test_near_duplicates_of_a_large_group(spark):
    rng = random.Random(5)
    base = [f"w{rng.randrange(10**6)}" for _ in range(120)]
    rows = []
    for i in range(150):
        w = list(base)
        for _ in range(rng.randint(0, 5)):
            w[rng.randrange(120)] = f"v{rng.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    rows += [(1000 + i, " ".join(base[:60]) + " " + " ".join(f"u{i}x{k}" for k in range(60))) for i in range(30)]
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(7)).collect()}
    assert got == {i: c for i, (_, c) in brute.components(rows).items()}


def test_near_duplicates_without_rows_or_ids(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert minhash.near_duplicates(none).count() == 0
    df = spark.createDataFrame([(None, "a b c d e f"), (3, "a b c d e f"), (None, None), (5, None)], "doc_id long, text string")
    got = sorted(((r.doc_id, r.component_id, r.kept) for r in minhash.near_duplicates(df).collect()), key=str)
    assert got == sorted([(None, 3, False), (3, 3, True), (None, None, True), (5, 5, True)], key=str)


def test_signatures_under_the_threshold_meet(spark):
    """Two signatures that differ in 2 * CHUNKS - 1 symbols, at worst places, share a bucket."""
    a = [(1, 9, 0, 1, *([0] * minhash.CHUNKS))]
    b = [(2, 9, 0, 2, *([0xFF00FF] * (minhash.CHUNKS - 1)), 0xFF)]
    df = spark.createDataFrame(a + b, "rep long, n long, f0 long, f1 long, " + ", ".join(f"{c} long" for c in minhash.SIG))
    pairs = [(r.a, r.b) for r in minhash._candidates(df).where("b IS NOT NULL").distinct().collect()]
    assert pairs == [(1, 2)]
    assert minhash._close(spark.createDataFrame(pairs, "a long, b long"), df).first().d == 2 * minhash.CHUNKS - 1


@pytest.mark.parametrize("solve", [components.components, components.local_components])
def test_components(spark, solve):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5000, 5000 + i) for i in range(1, 90)] + [(None, 3), (7, None)]
    got = {r.node: r.component for r in solve(spark.createDataFrame(edges, "a long, b long").repartition(6)).collect()}
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    assert {k: v for k, v in got.items() if k in root} == {k: find(k) for k in root}
    assert solve(spark.createDataFrame([], "a long, b long")).count() == 0


def test_token_files(spark, docs):
    rows, df = docs
    folder, shards = tokenfiles.write_token_files(df, BYTES, 0)
    lib = tokens.encoder(BYTES).lib
    at = 0
    got = {r.doc_id: r for r in tokenfiles.read_token_files(spark, shards).collect()}
    for i, t in rows:
        ids = np.array([*lib.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        r = got[i]
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(ids.tobytes()))
        shard = tokenfiles.ShardReader(f"{folder}/{r.shard}")
        assert shard.find(i) == [r.position] and shard.read(r.position).tolist() == ids.tolist()
        at += len(ids)
    assert tokenfiles.read_token_files(spark, tokenfiles.write_token_files(df.where("false"), BYTES, 0)[1]).count() == 0


def test_token_file_needs_its_dictionary(spark, docs):
    folder, shards = tokenfiles.write_token_files(docs[1], BYTES, 0)
    name = tokenfiles.ShardReader(shards[0][0])
    assert name.count
    import glob

    with open(glob.glob(folder.removeprefix("file://") + "/*.dict")[0], "ab") as f:
        f.write(b"x")
    with pytest.raises(ValueError):
        tokenfiles.ShardReader(shards[0][0])


def test_token_counts(spark, docs):
    rows, df = docs
    lib = tokens.encoder(BYTES).lib
    want = {i: len(lib.encode(t or "", add_special_tokens=False).ids) + 1 for i, t in rows}
    for block in (64, 1 << 20):  # blocks far smaller than a document, and one for all
        got = {r.doc_id: r.n_tokens for r in separators.token_counts(df, BYTES, 50256, block_bytes=block).collect()}
        assert got == want


def test_scan_without_last_end(spark):
    folder = storage.fresh(spark, "test")
    ids = [1, 2, 9, 9, 3, 3, 3, 3, 3, 9, 4]
    storage.write_bytes(f"{folder}/a", np.array(ids, "<u2").tobytes())
    storage.write_bytes(f"{folder}/b", b"")
    files = spark.createDataFrame([("a",), ("b",)], "file string")
    got = sorted((r.ordinal, r.n_tokens) for r in separators.count_tokens(spark, folder, files, 9, 4).collect())
    assert got == [(0, 3), (1, 1), (2, 6), (3, 1)]


def test_warc_round_trip(spark):
    big = "p" * 1500
    fake = "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\nWARC/1.0\r\nContent-Length: 99999\r\n\r\n" + "WARC/1.1\r\nno colon"
    rows = [(1, "http://a", big), (2, "http://b\r\nX: y", big), (3, None, big), (4, "u", "small"), (5, "u", "small"), (6, "u", None), (7, "u", ""), (8, "u", fake * 40), (9, "ü", "é" * 600), (9, "ü", "é" * 600), (None, "n", big), (10, "u", fake * 40)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    import hashlib

    for block in (256, 1000, 1 << 20):
        got = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.read_warc(spark, *warc.write_warc(df), block).collect()), key=str)
        top = {}
        for p, _, t in rows:
            if p is not None:
                top[t] = max(p, top.get(t, p))
        want = []
        for p, _, t in rows:
            b = (t or "").encode()
            again = len(b) >= 1000 and p != top[t]
            want.append((p, len(b), hashlib.sha1(b).hexdigest(), "revisit" if again else "response", top[t] if again else None))
        assert got == sorted(want, key=str)
    assert warc.read_warc(spark, *warc.write_warc(df.where("false"))).count() == 0


def test_warc_that_breaks_off(spark):
    folder = storage.fresh(spark, "test")
    storage.write_bytes(f"{folder}/x.warc", warc._record(1, "u", b"abc", None)[:-5])
    with pytest.raises(ValueError):
        warc.reachable(warc.candidate_links(spark, folder, ["x.warc"]), 1)


RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block")]


def test_url_rules(spark):
    rows = [
        ("http://WWW.Example.com/en/x?y", "www.example.com", "/en/x", "www.example.com/en/", "allow"), ("https://m.example.com/en/#a", "m.example.com", "/en/", "example.com/en/", "block"), ("http://notexample.com/en/", "notexample.com", "/en/", "com/", "allow"),
        ("http://a.net/es", "a.net", "/es", None, "allow"), ("http://a.net/es/?q", "a.net", "/es/", "net/es/", "block"), ("a.net/es/", "", "", None, "allow"), (None, "", "", None, "allow"), ("x://", "", "", None, "allow"), ("http://h?x://y/", "h", "", None, "allow"),
    ]
    df = spark.createDataFrame([(i, r[0], None) for i, r in enumerate(rows)], "page_id long, url string, html string")
    many = RULES + [(f"h{i}.org", "/", "block") for i in range(urlfilter.MOST_LITERAL_RULES)]
    for rules in (RULES, many):
        got = [tuple(r) for r in urlfilter.judge_urls(df, rules).orderBy("page_id").select("url", "_host", "_path", "_rule", "_verdict").collect()]
        assert got == rows
    assert {r._verdict for r in urlfilter.judge_urls(df, []).collect()} == {"allow"}


def test_blocks_reach_aliases(spark):
    link = lambda h: f'<html><link href="{h}" rel="canonical"><p>t</p>'
    rows = [
        (1, "http://bad.net/es/1", "<p>"), (2, "http://ok.org/a?x=1#f", link("http://bad.net/es/1#z")), (3, "https://ok.org/b", '<META HTTP-EQUIV="Refresh" content="0; URL=/a?x=1">'), (4, "http://good.com/en/", link("//bad.net/es/1")), (5, "http://ok.org/c", link("d")), (6, "http://ok.org/d", None),
        (7, "http://only.org/x", link("http://gone.net/es/none")), (8, None, link("http://bad.net/es/1")),
    ]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: (r._verdict, r._via) for r in urlfilter.judge_urls(df, RULES).collect()}
    assert got == {1: ("block", "rule"), 2: ("block", "alias"), 3: ("block", "alias"), 4: ("allow", "rule"), 5: ("allow", "default"), 6: ("allow", "default"), 7: ("block", "alias"), 8: ("allow", "default")}
    moved = df.withColumn("html", F.lit(None).cast("string")).withColumn("to", F.when(F.col("page_id") == 6, "http://bad.net/es/1"))
    assert {r.page_id for r in urlfilter.judge_urls(moved, RULES, redirect="to").where("_verdict = 'block'").collect()} == {1, 6}


def test_line_dedup(docs):
    rows, df = docs
    want = brute.lines(rows)
    out = linededup.drop_repeated_lines(df)
    assert out.columns == [*df.columns, "_n_lines", "_n_dropped"]
    assert {r.doc_id: (r._n_lines, r._n_dropped, r.text) for r in out.collect()} == want
    assert sum(x[1] for x in want.values()) > 0
    assert linededup.drop_repeated_lines(df.where("false")).count() == 0


def test_perfect_hash():
    keys = bytescan.mix(np.arange(1, 20001, dtype=np.uint64))
    index = linededup.PerfectHash.build(keys)
    assert sorted(index.find(keys)) == list(range(len(keys)))
    shard = linededup.LineShard.load(linededup.LineShard.build(keys, keys + np.uint64(1), np.ones(len(keys), np.int64), np.arange(len(keys))).dump())
    assert (shard.keeper[shard.probe(keys, keys + np.uint64(1))] == np.arange(len(keys))).all()
    assert (shard.probe(keys + np.uint64(5), keys) == -1).all()
    twice = linededup.LineShard.load(linededup.LineShard.build(np.array([7, 9, 7, 7], np.uint64), np.array([1, 2, 3, 4], np.uint64), np.ones(4, np.int64), np.array([10, 20, 30, 40])).dump())
    at = twice.probe(np.array([7, 7, 7, 9, 7, 9], np.uint64), np.array([4, 3, 1, 2, 5, 1], np.uint64))
    assert [int(twice.keeper[i]) if i >= 0 else None for i in at] == [40, 30, 10, 20, None, None]


def test_shard_numbers_follow_spark(spark):
    keys = [0, 1, -1, 1 << 40, -(1 << 62), 12345]
    df = spark.createDataFrame([(k,) for k in keys], "k long")
    assert [r[0] for r in df.select(F.xxhash64("k")).collect()] == bytescan.spark_hash(np.array(keys, np.int64).view(np.uint64)).tolist()


def test_additive_model_learns_an_interaction():
    rng = np.random.default_rng(1)
    x = rng.random((4000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    m = quality.fit(x[:3000], y[:3000])
    assert ((m.score(x[3000:]) > 0.5) == y[3000:]).mean() > 0.9
    assert quality.fit(np.zeros((0, 3)), np.zeros(0)).score(x[:2]).tolist() == [0.5, 0.5]


def test_quality_scores(spark, docs):
    rows, df = docs
    labels = spark.createDataFrame([(i, i % 2) for i, _ in rows if i != 3] + [(None, 1), (4, None), (99999, 1), (5, 7)], "doc_id long, quality int")
    model = quality.train(df, labels)
    out = quality.score(df, model).collect()
    assert len(out) == len(rows) and all(0 <= r._score <= 1 for r in out)
    assert quality.score(df, quality.train(df, labels.where("false"))).first()._score == pytest.approx(0.5)
    assert quality.features(pa.array([None, ""])).tolist() == [[0.0] * len(quality.FEATURES)] * 2


def test_packing(spark, docs):
    rows, df = docs
    lib = tokens.encoder(WORDS).lib
    for size in (64, 4096):
        got = packing.pack(df, WORDS, 2, size).collect()
        by_doc, by_seq = {}, {}
        for r in got:
            by_doc.setdefault(r.doc_id, []).append(r)
            by_seq.setdefault(r.sequence_id, []).append(r)
        assert sorted(by_doc) == [i for i, _ in rows]
        for i, t in rows:
            ids = np.array([*lib.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
            at = 0
            for r in sorted(by_doc[i], key=lambda r: r.start):
                own = ids[at : at + r.length]
                assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(own.tobytes()) and r.ids == own.tolist()
                at += r.length
            assert at == len(ids)
        padded = 0
        for seq in by_seq.values():
            at = 0
            for r in sorted(seq, key=lambda r: r.offset):
                assert r.offset == at
                at += r.length
            assert at <= size
            padded += at & (at - 1) != 0 and at != size
        assert padded <= 1
    assert packing.pack(df.where("false"), WORDS, 2).count() == 0


@pytest.mark.parametrize("most", [1, 5000])
def test_layout_places_all_once(most):
    rng = np.random.default_rng(4)
    hist = np.bincount(np.minimum(rng.geometric(1 / 60, 3000), 255), minlength=256) * most
    layout = packing.Layout(hist, 256)
    assert (layout.left == 0).all() and (layout.given == layout.made).all()
    total = int((hist * np.arange(256)).sum())
    assert layout.sequences == -(-total // 256) and layout.solved > 0.9 * layout.sequences and layout.cuts < 0.05 * layout.sequences
    if most == 1:
        ids = np.zeros(layout.sequences * 256, int)
        for a in np.flatnonzero(hist).tolist():
            which, start, size, seq, off = layout.place(a, np.arange(hist[a]))
            assert (np.bincount(which, size) == a).all()
            for s, k in zip((seq * 256 + off).tolist(), size.tolist(), strict=True):
                ids[s : s + k] += 1
        assert ids.max() == 1 and ids.sum() == total and ids[:total].all()


def test_layout_of_few_pieces():
    for lengths in ([], [3], [255, 255], [1] * 300, [200] * 7):
        hist = np.bincount(lengths, minlength=256)
        layout = packing.Layout(hist, 256)
        assert (layout.left == 0).all() and layout.sequences == -(-sum(lengths) // 256)


def test_decontamination(spark, docs):
    rows, df = docs
    rng = random.Random(8)
    items = [(i, " ".join(brute.words(rng.choice(rows[:50])[1])[2:20])) for i in range(12)] + [(100, "one"), (101, "ONE-two"), (102, None), (103, "..."), (104, "one"), (105, "never seen here at all")]
    table = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, extra string")
    want = brute.contamination(rows, items)
    got = {r.doc_id: (r._n_words, r._n_hit, r._items) for r in decontam.find_contamination(df, table).collect()}
    assert got == want and any(x[1] for x in want.values())
    none = decontam.find_contamination(df, table.where("false")).agg(F.sum("_n_hit"), F.max(F.size("_items"))).first()
    assert tuple(none) == (0, 0)


def test_top_k(spark):
    rng = random.Random(6)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(8)]) for i in range(120)]
    rows += [(200 + i, rows[i][1]) for i in range(20)] + [(300, None), (350, [float("nan")] * 8), (400, [None] + [0.5] * 7), (450, []), (500, [0.1] * 5), (550, [0.1] * 5), (601, [float("inf")] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(4)
    f32 = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    want = brute.top(f32, [i for i, _ in rows if i % 50 == 0], 5)
    got = {}
    for r in vafile.top_k(df, F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert got == {q: v for q, v in want.items() if v}
    assert vafile.top_k(df.where("false"), F.col("vec_id") % 50 == 0).count() == 0


def test_buckets_compare_what_hashes_cannot_tell():
    """Windows that end with one block, some with equal prefix hashes: only the bytes decide."""
    texts = pa.array(["a b c d", "x b c d", "a b c d e c d", "q q c d"])
    low, starts, lens, first = decontam.words_of(pa.array(["a b c d", "x b c d", "z z c d"]))
    p = decontam.Patterns(low, starts, lens, 4, np.array([0, 4, 8]), [["i"], ["j"], ["k"]])
    doc = decontam.words_of(texts)
    h = bytescan.hash_runs(*doc[:3])
    want = [(0, 0), (4, 1), (8, 0)]
    assert sorted(zip(*(c.tolist() for c in p.hits(*doc, h)), strict=True)) == want
    p.prefix[:], p.which[:] = 0, np.arange(3)
    p._sum = lambda h: np.zeros(len(h), np.uint64)  # as if all prefixes had one hash
    assert sorted(zip(*(c.tolist() for c in p.hits(*doc, h)), strict=True)) == want


def test_decontamination_without_documents_and_with_repeats(spark):
    docs = spark.createDataFrame([(1, "a b c d", "x"), (1, "a b c d", "y"), (2, None, "z"), (3, "", "z")], "doc_id long, text string, _items string")
    items = spark.createDataFrame([(5, "b c"), (5, "b c"), (6, "B, C")], "item_id int, text string")
    got = sorted((r.doc_id, r._n_words, r._n_hit, r._items) for r in decontam.find_contamination(docs, items).collect())
    assert got == [(1, 4, 2, [5, 6]), (1, 4, 2, [5, 6]), (2, 0, 0, []), (3, 0, 0, [])]
    assert decontam.find_contamination(docs.where("false"), items).count() == 0


def test_line_dedup_counts_documents(spark):
    """Ids on several rows count once; rows without an id count each; a column of a new name goes."""
    a, b, c = "a line that repeats often", "another line that repeats", "a third line that repeats"
    rows = [(1, a), (1, a), (2, a), (3, b), (3, b), (4, b + "\n" + b), (5, b), (None, c), (None, c), (6, c + "\n" + a[:5]), (7, None), (7, "")]
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, _n_lines int")
    got = sorted(((r.doc_id, r.text, r._n_lines, r._n_dropped) for r in linededup.drop_repeated_lines(df).collect()), key=str)
    want = [(1, a, 1, 0), (1, a, 1, 0), (2, a, 1, 0), (3, "", 1, 1), (3, "", 1, 1), (4, "", 2, 2), (5, b, 1, 0), (None, "", 1, 1), (None, "", 1, 1), (6, c + "\n" + a[:5], 2, 0), (7, "", 1, 0), (7, "", 1, 0)]
    assert got == sorted(want, key=str)


def test_top_k_of_any_size_of_numbers(spark):
    """Numbers beyond exact doubles and beyond longs, several rows with one id, and vectors of two lengths."""
    rng = random.Random(7)
    rows = [(i, [rng.uniform(-1, 1) * 10.0 ** rng.choice([0, 0, 0, 3, 9, 20, 38]) for _ in range(6)]) for i in range(90)]
    rows += [(50, rows[3][1]), (7, rows[8][1]), (7, rows[8][1]), (100, [1e38] * 6), (101, [-3e38] * 6), (102, [3e38] * 6), (150, [0.5, 0.25]), (151, [0.5, 0.25]), (152, [0.25, 9.0]), (None, [1.0] * 6)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
    got = {}
    for r in vafile.top_k(df, F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    whole = [(i, [math.floor(Fraction(x) * 256) for x in v]) for i, v in rows if i is not None]
    want = {}
    for q in {i for i, _ in whole if i % 50 == 0}:
        best = {}
        for i, v in whole:
            if i != q:
                for j, u in whole:
                    if j == q and len(u) == len(v):
                        s = sum(a * b for a, b in zip(u, v, strict=True))
                        best[i] = max(s, best.get(i, s))
        want[q] = [(i, max(min(s, (1 << 63) - 1), -(1 << 63))) for i, s in sorted(best.items(), key=lambda x: (-x[1], x[0]))[:5]]
    assert got == want


def test_bounds_hold_and_save_reads(tmp_path):
    rng = np.random.default_rng(5)
    x, q = np.floor(rng.normal(0, 60, (4000, 32))), np.floor(rng.normal(0, 60, (20, 32)))
    vafile.write_file(f"file://{tmp_path}/x", np.arange(4000), x)
    file = vafile.VaFile(f"file://{tmp_path}/x")
    score, far = file.bounds(q)
    assert (np.abs(score - q @ x.T) <= far[:, None]).all()
    got = file.search(q, np.full(20, -1), 5)
    want = [(i, int(j), int((q @ x.T)[i, j])) for i in range(20) for j in np.lexsort((np.arange(4000), -(q @ x.T)[i]))[:5]]
    assert got == want and file.read < 20 * 60


def test_links_resolve(spark):
    base = "https://Host.org/a/b/c.html?q=1#f"
    want = {
        "g": "host.org/a/b/g", "./g": "host.org/a/b/g", "g/": "host.org/a/b/g/", "/g": "host.org/g", "//h.net": "h.net/", "?y": "host.org/a/b/c.html?y", "g?y=./x": "host.org/a/b/g?y=./x", "#s": "host.org/a/b/c.html?q=1",
        "../g": "host.org/a/g", "../../g": "host.org/g", "../../../g": "host.org/g", "..": "host.org/a/", ".": "host.org/a/b/", "/./g/../h": "host.org/h", "x&amp;y": "host.org/a/b/x&y", "?a=1&amp;amp;b": "host.org/a/b/c.html?a=1&amp;b",
        "//h.net/x/../y": "h.net/y", "HTTP://X.org/p": "x.org/p", "mailto:a@b": None, "javascript:go()": None,
    }
    df = spark.createDataFrame([(h, base) for h in want], "h string, u string")
    parts = [F.substring_index("u", "://", 1), urlfilter.host_of(F.col("u")), urlfilter.path_of(F.col("u")), F.lit("?q=1")]
    assert {r.h: r.k for r in df.select("h", urlfilter._key(urlfilter._resolve(F.col("h"), *parts)).alias("k")).collect()} == want
    bare = spark.createDataFrame([("g", "http://h.org")], "h string, u string").select(urlfilter._key(urlfilter._resolve(F.col("h"), F.lit("http"), F.lit("h.org"), F.lit(""), F.lit(""))))
    assert bare.first()[0] == "h.org/g"


def test_blocks_reach_aliases_over_thousands_of_pages(spark):
    """Canonical links in many spellings and refreshes, against a recursive SQL closure of the links that were meant."""
    import duckdb

    rng = random.Random(12)
    spell = [
        lambda p: f'<link rel="canonical" href="http://s.org/p/{p}">', lambda p: f"<LINK href='/p/{p}' rel='nofollow canonical x'>", lambda p: f'<link rel=canonical href={p}>', lambda p: f'<link rel="canonical" href="./x/../{p}#top">',
        lambda p: f'<meta http-equiv="refresh" content="0; url=//s.org/p/{p}">', lambda p: f"<meta content='5;URL=../p/{p}' http-equiv=refresh>",
    ]
    other = ['<link rel="canonicals" href="/p/1">', '<link rel="next" href="/p/2">', '<meta name="refresh" content="0; url=/p/3">', "", None]
    rows, links = [], []
    for i in range(4000):
        to = rng.randrange(4000) if rng.random() < 0.55 else None
        html = rng.choice(other) if to is None else "<head>" + rng.choice(spell)(to) + "x" * rng.randrange(60)
        rows.append((i, f"http://{rng.choice(['s.org', 'S.ORG'])}/p/{i}" + rng.choice(["", "#a"]), html, "theirs"))
        if to is not None:
            links.append((i, to))
    rules = [("s.org", "/p/39", "block"), ("s.org", "/p/12", "allow")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, _via string").repartition(6)
    got = {r.page_id: (r._verdict, r._via) for r in urlfilter.judge_urls(df, rules).collect()}
    con = duckdb.connect()
    con.execute("CREATE TABLE e (a BIGINT, b BIGINT)")
    con.executemany("INSERT INTO e VALUES (?, ?)", links)
    reached = {r[0] for r in con.execute("""WITH RECURSIVE n AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
      r(i) AS (SELECT range FROM range(4000) WHERE starts_with(CAST(range AS VARCHAR), '39') UNION SELECT n.b FROM r JOIN n ON n.a = r.i) SELECT i FROM r""").fetchall()}
    rule = lambda i: "block" if str(i).startswith("39") else "allow" if str(i).startswith("12") else None
    assert got == {i: (rule(i), "rule") if rule(i) else ("block", "alias") if i in reached else ("allow", "default") for i in range(4000)}
    assert urlfilter.judge_urls(df.where("false"), rules).count() == 0


def test_token_files_of_odd_rows(spark):
    rows = [(None, "no id"), (None, None), (-(1 << 63), "least id"), (5, "five"), (5, "five"), (5, "other five"), (0, "")]
    df = spark.createDataFrame([(i, t, 7) for i, t in rows], "doc_id long, text string, start int").repartition(3)
    folder, shards = tokenfiles.write_token_files(df, BYTES, 0)
    got = tokenfiles.read_token_files(spark, shards).orderBy("start").collect()
    lib = tokens.encoder(BYTES).lib
    assert [r.doc_id for r in got] == [None, None, -(1 << 63), 0, 5, 5, 5]
    crc = lambda t: zlib.crc32(np.array([*lib.encode(t or "", add_special_tokens=False).ids, 0], "<u4").tobytes())
    assert sorted((str(r.doc_id), r.ids_crc32) for r in got) == sorted((str(i), crc(t)) for i, t in rows)
    shard = tokenfiles.ShardReader(f"{folder}/{got[0].shard}")
    assert len(shard.find(None)) == 2


def test_token_counts_of_odd_rows(spark):
    rows = [(1, "a b"), (1, "a b"), (None, "c"), (2, ""), (3, None)]
    df = spark.createDataFrame([(i, t, 9) for i, t in rows], "doc_id long, text string, n_tokens int")
    assert sorted((str(r.doc_id), r.n_tokens) for r in separators.token_counts(df, BYTES, 70000).collect()) == [("1", 3), ("1", 3), ("2", 1), ("3", 1), ("None", 2)]
    assert separators.token_counts(df.where("false"), BYTES, 65535).count() == 0


def test_warc_of_odd_rows(spark):
    long = "y" * 3_000_000
    rows = [(1, "u", long), (1, "u", long), (2, "u", long), (None, "v", "s"), (None, "v", None)]
    df = spark.createDataFrame([(i, u, t, "mine") for i, u, t in rows], "page_id long, url string, html string, payload string")
    got = sorted(((r.page_id, r.record_type, r.refers_to, r.payload_bytes) for r in warc.read_warc(spark, *warc.write_warc(df)).collect()), key=str)
    assert got == sorted([(1, "revisit", 2, 3_000_000), (1, "revisit", 2, 3_000_000), (2, "response", None, 3_000_000), (None, "response", None, 1), (None, "response", None, 0)], key=str)


def test_packing_of_odd_rows(spark):
    rows = [(1, "a b"), (1, "a b"), (None, "c d e"), (2, None), (3, "x y z " * 9000)]
    df = spark.createDataFrame([(i, t, 9) for i, t in rows], "doc_id long, text string, offset int")
    got = packing.pack(df, WORDS, 2).collect()
    lib = tokens.encoder(WORDS).lib
    want = {}
    for i, t in rows:
        want.setdefault(i, []).append(len(lib.encode(t or "", add_special_tokens=False).ids) + 1)
    seen = {}
    for r in got:
        seen[r.doc_id] = seen.get(r.doc_id, 0) + r.length
    assert seen == {i: sum(v) for i, v in want.items()}
    assert sum(r.length for r in got) <= 4096 * len({r.sequence_id for r in got}) < sum(r.length for r in got) + 4096


def test_quality_of_odd_rows(spark):
    rows = [(1, "A good text. It has sentences."), (1, "A good text. It has sentences."), (2, None), (3, ""), (None, "x " * 50000)]
    df = spark.createDataFrame([(i, t, 0.5) for i, t in rows], "doc_id long, text string, _score double")
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 0), (3, 0)], "doc_id long, quality int")
    out = quality.score(df, quality.train(df, labels)).collect()
    assert len(out) == 5 and out[0]._score == out[1]._score and out[2]._score == out[3]._score and all(0 <= r._score <= 1 for r in out)
    assert quality.score(df.where("false"), quality.train(df.where("false"), labels)).count() == 0


@pytest.mark.parametrize("line", ["WARC/1.1", "x: WARC/1.1", "WARC/1.1\r\nContent-Length: 5", "x: WARC/1.1\r\nContent-Length: 5\r\n"])
def test_warc_of_pages_full_of_magic(spark, line):
    """Megabytes of magic, with and without colons and blank lines, cost what other text costs; blocks end inside."""
    import time

    bodies = [(f"{line}\r\n" * (4_000_000 // (len(line) + 2))), "plain " * 500, "WARC/1.0\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n" * 300]
    df = spark.createDataFrame([(i, f"http://x/{i}", b) for i, b in enumerate(bodies)], "page_id long, url string, html string")
    folder, files = warc.write_warc(df)
    start = time.time()
    got = {r.page_id: bytes(r.payload).decode() for r in warc.read_warc(spark, folder, files, 1 << 20).collect()}
    assert got == dict(enumerate(bodies)) and time.time() - start < 60


def test_warc_boundaries_in_linear_time():
    import time

    data = b"x: WARC/1.1\r\n" * 320_000
    start = time.time()
    assert warc._possible(data, len(data)) == ([], True)
    assert warc._possible(data + b"\r\n", len(data)) == ([], False)
    found, _ = warc._possible(data + b"Content-Length: 7\r\n\r\n", len(data))
    assert len(found) == 320_000 and found[0] == (3, len(data) - 3 + 21 + 7 + 4)
    assert time.time() - start < 20


def test_warc_refuses_endless_headers(monkeypatch):
    monkeypatch.setattr(warc, "HEADER_BYTES", 1000)
    with pytest.raises(ValueError, match="header"):
        warc._record(1, "http://x/" + "a" * 2000, b"", None)


@pytest.mark.parametrize("path", [BYTES, WORDS])
def test_encoder_cuts_long_texts(path, monkeypatch):
    """Ids of texts that are worked on in small parts are those of the library; a text without a place to cut stays whole."""
    monkeypatch.setattr(tokens, "MOST_BYTES", 40)
    rng = random.Random(9)
    parts = ["a", "é", "'s", " ", "  ", " re", "\n", "12", ".", "中", "Word word ", " <|endoftext|> ", "e\u0301 x", " \u0301"]
    rows = ["".join(rng.choices(parts, k=rng.randint(0, 200))) for _ in range(300)] + [None, "", "x" * 3000, "plain words " * 100]
    enc = tokens.Encoder(path)
    ids, at = enc.encode(pa.array(rows))
    want = [x.ids for x in enc.lib.encode_batch([r or "" for r in rows], add_special_tokens=False)]
    assert [ids[at[i] : at[i + 1]].tolist() for i in range(len(rows))] == want
