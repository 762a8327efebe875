"""Merkle manifest, conversation repair and byte-pair encoding against plain versions."""

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from citemill.llm import bpe, dialogues, merkle, queries

SF = "/root/testdata/sf0.001"
BYTES = public_tokenizers.path("byte_bpe_50k.json")
H = lambda *x: hashlib.sha256("".join(x).encode()).hexdigest()


def levels(nodes, fanout):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([H(*out[-1][i : i + fanout]) for i in range(0, len(out[-1]), fanout)])
    return out


def sides(grown, i, fanout):
    out = []
    for nodes in grown[:-1]:
        run = i - i % fanout
        out.append(("".join(nodes[run:i]), "".join(nodes[i + 1 : run + fanout])))
        i //= fanout
    return out


def plain_manifest(rows, fanout):
    """rows of (group, key, leaf) -> sorted (group, key, leaf, subroot, root, sides)."""
    groups = {}
    for g, k, d in rows:
        groups.setdefault(g, []).append((k is not None, k or 0, d, k))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: levels([x[2] for x in sorted(groups[g], key=lambda x: x[:3])], fanout) for g in names}
    top = levels([trees[g][-1][0] for g in names], fanout)
    out = []
    for j, g in enumerate(names):
        for i, (_, _, d, k) in enumerate(sorted(groups[g], key=lambda x: x[:3])):
            out.append((str(g), str(k), d, trees[g][-1][0], top[-1][0], [*sides(trees[g], i, fanout), *sides(top, j, fanout)]))
    return sorted(out)


@pytest.mark.parametrize("fanout,deep", [(3, 1), (3, 2), (2, 3), (3, 7)])
def test_manifest(spark, fanout, deep):
    """Several rounds of superblocks, one hot group, groups of one row, null groups and keys, ties and repeated rows."""
    rng = random.Random(fanout * deep)
    rows = [("hot", i, H(str(i))) for i in range(130)] + [(rng.choice([None, "a", "é", "zz", ""]), rng.choice([None, rng.randrange(9)]), H(str(rng.randrange(20)))) for _ in range(70)]
    rows += [("one", 1, H("x"))] + [(f"g{i}", i, H("same")) for i in range(11)]
    rng.shuffle(rows)
    df = spark.createDataFrame([(*r, "kept", "lost") for r in rows], "g string, k long, d string, _index string, _root string").repartition(7)
    out = merkle.manifest(df, "g", "k", "d", fanout, deep)
    assert out.columns == ["g", "k", "d", "_index", "_subroot", "_root", "_before", "_after"]
    got = [(str(r.g), str(r.k), r.d, r._subroot, r._root, list(zip(r._before, r._after, strict=True))) for r in out.collect()]
    assert sorted(got) == plain_manifest(rows, fanout)
    assert out.where(merkle.folded(F.col("d")) != F.col("_root")).count() == 0
    assert out.where(merkle.folded(F.lit("0" * 64)) == F.col("_root")).count() == 0


def test_manifest_of_little(spark):
    schema = "g string, k long, d string"
    assert merkle.manifest(spark.createDataFrame([], schema), "g", "k", "d").collect() == []
    (row,) = merkle.manifest(spark.createDataFrame([(None, None, "ab")], schema), "g", "k", "d").collect()
    assert (row._subroot, row._root, row._before, row._after) == ("ab", "ab", [], [])
    long = "x\n" * 3_000_000
    (leaf,) = spark.createDataFrame([(1, None, long)], "a long, b string, c string").select(merkle.leaf_digest(F.col("a"), F.col("b"), F.col("c"))).first()
    assert leaf == H("1:1", "-", f"{len(long)}:", long)


def faults(rows):
    """(initial, sign) of each (role, text) in order."""
    seen, out = set(), []
    for role, text in rows:
        if not re.search("[^\x20\x09-\x0d]", text):
            fault = "blank"
        elif (role, text) in seen:
            fault = "duplicate"
        else:
            fault = "" if text.rstrip(" \t\n\v\f\r")[-1] in ".!?" else "truncated"
        seen.add((role, text))
        out.append(fault)
    return out


def all_repairs(rows, marks):
    """Every (cost, audit, repaired rows) with at most two insertions in a row."""
    added = [[(c, r) for r in itertools.product(("user", "assistant"), repeat=n)] for n, c in ((0, 0), (1, 3), (2, 6))]
    added = [x for part in added for x in part]

    def go(i):
        tails = [(0, "", ())] if i == len(rows) else []
        if i < len(rows):
            (role, text), extra = rows[i], 3 * (marks[i] == "truncated")
            ways = [(4, "D", ())]
            if marks[i] not in ("blank", "duplicate"):
                ways += [(extra, "K", ((role, text),))] + [(3 + extra, "R", ((r, text),)) for r in ("user", "assistant")]
            rest = go(i + 1)
            tails = [(c + d, e + f, x + y) for c, e, x in ways for d, f, y in rest]
        return [(c + d, "I" * len(r) + e, tuple((x, "") for x in r) + y) for c, r in added for d, e, y in tails]

    return [x for x in go(0) if re.fullmatch("(s?(ua)+)?", "".join(r[:1] or "-" for r, _ in x[2]))]


def plain_repair(rows):
    """Least (cost, audit) by comparing whole audits from the last row on, and the rows that it gives."""
    marks = faults(rows)
    best = {"": (0, "", ()), "s": None, "u": None, "a": (0, "", ())}

    def close(at):
        for _ in range(4):
            for q, nxt in (("", "u"), ("s", "u"), ("u", "a"), ("a", "u")):
                if at[nxt] is not None:
                    c, e, x = at[nxt]
                    new = (c + 3, "I" + e, (({"u": "user", "a": "assistant"}[nxt], ""), *x))
                    if at[q] is None or new[:2] < at[q][:2]:
                        at[q] = new
        return at

    best = close(best)
    for (role, text), mark in reversed(list(zip(rows, marks, strict=True))):
        new = {}
        for q in best:
            ways = []
            if best[q]:
                ways.append((best[q][0] + 4, "D" + best[q][1], best[q][2]))
            extra = 3 * (mark == "truncated")
            for to in {"": "su", "s": "u", "u": "a", "a": "u"}[q]:
                if mark in ("blank", "duplicate") or best[to] is None:
                    continue
                c, e, x = best[to]
                if role[:1] == to:
                    ways.append((c + extra, "K" + e, ((role, text), *x)))
                if to != "s":
                    ways.append((c + 3 + extra, "R" + e, (({"u": "user", "a": "assistant"}[to], text), *x)))
            new[q] = min(ways, key=lambda w: w[:2]) if ways else None
        best = close(new)
    return best[""]


def conversation(rng, n):
    pool = [("user", "Hi."), ("assistant", "Yes!"), ("system", "Be good."), ("user", "cut off"), ("assistant", "cut\t"), ("user", " \n"), ("tool", "x?"), ("assistant", "No. "), ("", "odd."), ("system", "cut")]
    return [rng.choice(pool) for _ in range(n)]


def test_repair_is_the_cheapest_of_all():
    rng = random.Random(4)
    for n in (0, 1, 1, 1, 2, 2, 2, 2, 2, 2, 3, 3):
        rows = conversation(rng, n)
        least = min(all_repairs(rows, faults(rows)), key=lambda x: x[:2])
        assert plain_repair(rows) == least


def test_repair(spark):
    """Random conversations, and one of 3,000 rows; nulls, ties, dropped rows and a conversation without an id."""
    rng = random.Random(5)
    convs = {i: conversation(rng, rng.randint(1, 9)) for i in range(400)} | {1000: conversation(rng, 3000), None: conversation(rng, 5)}
    data = [(c, t, r, x, False, "x") for c, rows in convs.items() for t, (r, x) in enumerate(rows)]
    data += [(2000, 1, "user", "gone.", True, "x"), (2001, None, None, None, False, "x"), (2002, 5, "user", "A.", False, "x"), (2002, 9, "assistant", "B.", False, "x"), (2002, None, "system", "C.", False, "x"), (1, 77, "user", "gone too.", None, "x"), (1, 78, "user", "x", True, "x")]
    convs[1] = [*convs[1], ("user", "gone too.")]
    convs |= {2000: [], 2001: [(" ", " ")], 2002: [("system", "C."), ("user", "A."), ("assistant", "B.")]}
    rng.shuffle(data)
    df = spark.createDataFrame(data, "c long, t long, role string, text string, d boolean, _conv string").repartition(5)
    audits, mended = dialogues.repair(df, "c", "t", dropped=F.col("d"))
    mended = mended.collect()
    found = {r._conv: r for r in audits.collect()}
    assert set(found) == set(convs) and audits.count() == len(convs)
    for c, rows in convs.items():
        cost, audit, repaired = plain_repair(rows)
        marks = faults(rows)
        initials = [r[:1] for r, _ in rows]
        r = found[c]
        assert (r.cost, r.audit) == (cost, audit)
        assert [r.blank, r.duplicate, r.truncated] == [marks.count(x) for x in ("blank", "duplicate", "truncated")]
        assert r.illegal == sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initials))
        assert r.gaps == {2002: 3, 1: 77 - (len(rows) - 1)}.get(c, 0)
        mine = sorted((x._position, x.role, x.text) for x in mended if x._conv == c)
        assert [x[1:] for x in mine] == list(repaired) and [x[0] for x in mine] == list(range(len(mine)))
    hashes = {r._conv: r._sha256 for r in dialogues.transcripts(dialogues.repair(df, "c", "t", dropped=F.col("d"))[1]).collect()}
    assert hashes == {c: H("\n".join(f"{r}:{t}" for r, t in plain_repair(rows)[2])) for c, rows in convs.items() if plain_repair(rows)[2]}


def test_repair_of_no_rows_and_of_named_conversations(spark):
    schema = "conv_id string, turn int, role string, text string"
    for rows, want in (([], []), ([("a", 1, "user", "Hi."), ("b", 1, "assistant", "Oh.")], [("a", 3, "KI"), ("b", 3, "IK")])):
        audits, mended = dialogues.repair(spark.createDataFrame(rows, schema))
        assert sorted((r._conv, r.cost, r.audit) for r in audits.collect()) == want
        assert mended.count() == 2 * len(rows)


def test_very_long_turn(spark):
    text = "word. " * 500_000
    audits, mended = dialogues.repair(spark.createDataFrame([(1, 0, "user", text), (1, 1, "assistant", text)], "conv_id long, turn long, role string, text string"))
    assert [(r.cost, r.audit) for r in audits.collect()] == [(0, "KK")]
    assert [r._sha256 for r in dialogues.transcripts(mended).collect()] == [H(f"user:{text}\nassistant:{text}")]


def test_trie_shares_layers():
    trie = dialogues.Trie()
    trie.solve("uauaua")
    before = len(trie.parent)
    trie.solve("uaua")  # an ending of the first
    assert len(trie.parent) == before
    trie.solve("Uauaua")
    assert len(trie.parent) == before + 1


def test_damage(spark):
    rows = [(c, t, "assistant", "One. Two!") for c in range(40) for t in range(6)] + [(None, None, None, None), (7, None, "system", "Hm")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    want = []
    for c, t, r, x in rows:
        n = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        x = " " if x is None else x
        x = {1: "", 2: re.sub("[.!?]", "", x)}.get(n, x)
        want += [(str(c), str(t), "user" if n == 4 else r or " ", x, n == 0)] * (2 if n == 3 else 1)
    got = [(str(r.conv_id), str(r.turn), r.role, r.text, r._dropped) for r in queries.damaged(df).collect()]
    assert sorted(got) == sorted(want)


def odd_texts(n=3000):
    rng = random.Random(3)
    parts = ["a", "b", "é", "ß", "'", "s", "t", "re", " ", "  ", "\n", "\t", "1", "23", ".", "!", "Œ", "×", " ", "中", "ll", "<|endoftext|>", "<|endof", "text|>", "é", "İ", "\r\n", "VE", "'ve", " '", "\x1c", "\x00", "ſ", "　", "😀", "½", "aaaa", "the", "՘", "࢏"]
    return ["".join(rng.choices(parts, k=rng.randint(0, 14))) for _ in range(n)] + [None, "", "ab" * 3000 + " x", "it's, we'll 'tis", "a" * 1001, "中" * 900, " " * 500]


def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(BYTES)


def test_bpe_equals_library(spark):
    texts, lib = odd_texts(), library()
    want = [x.ids for x in lib.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    df = spark.createDataFrame([(i, t, "lost", "kept") for i, t in enumerate(texts)], "i long, text string, _ids string, _index string").repartition(3)
    parts = bpe.encode(df, BYTES)
    assert parts.columns == ["i", "_index", "_part", "_last", "_ids"]
    got = {r.i: (r._ids, r._text) for r in bpe.decode(parts, BYTES).collect()}
    assert got == {i: (w, lib.decode(w, skip_special_tokens=False)) for i, w in enumerate(want)}
    assert {i: t for i, (_, t) in got.items()} == {i: t or "" for i, t in enumerate(texts)}
    assert bpe.decode(bpe.encode(df.where("false"), BYTES), BYTES).collect() == []


@pytest.mark.parametrize("most", [7, 64, 1000])
def test_bpe_cuts_long_texts(monkeypatch, most):
    """Texts cut into small parts have the ids of the whole; a part without a place to cut stays whole."""
    monkeypatch.setattr(bpe, "MOST_BYTES", most)
    lib = library()
    texts = ["".join(t or "" for t in odd_texts(200)), "don't  we'll\n\n'tis <|endoftext|>12'3 " * 40, "x" * 5000, None, "short"]
    rows = {}
    for batch in bpe.encode_batches(iter([pa.RecordBatch.from_pydict({"i": list(range(len(texts))), "text": texts})]), BYTES, "text"):
        for r in batch.to_pylist():
            assert r["_part"] == len(rows.setdefault(r["i"], []))
            rows[r["i"]].append(r)
    for i, t in enumerate(texts):
        assert [x for r in rows[i] for x in r["_ids"]] == lib.encode(t or "", add_special_tokens=False).ids
        assert [r["_last"] for r in rows[i]] == [False] * (len(rows[i]) - 1) + [True]
    assert len(rows[0]) > 3 and len(rows[2]) == 1


def test_pieces_of_one_hash_are_told_apart(monkeypatch):
    monkeypatch.setattr(bpe, "hash_runs", lambda buf, starts, lens, seed=0: (lens % 3).astype(np.uint64) + np.uint64(1))
    own, texts = bpe.Model(BYTES), ["one two three four", "five six", "one two seven"]
    buf, offsets = bpe.strings(pa.array(texts))
    for _ in range(2):
        ids, at = own.encode(buf, offsets)
        assert [ids[at[i] : at[i + 1]].tolist() for i in range(3)] == [x.ids for x in library().encode_batch(texts, add_special_tokens=False)]


def test_decoding_of_broken_bytes():
    own = bpe.model(BYTES)
    lib, rng = library(), random.Random(8)
    ids = [[rng.randrange(256) for _ in range(9)] for _ in range(300)]
    batch = pa.RecordBatch.from_pydict({"_part": pa.array([0] * 300, pa.int32()), "_last": [True] * 300, "_ids": pa.array(ids, pa.list_(pa.int32()))})
    (out,) = bpe.decode_batches(iter([batch]), BYTES)
    assert out.column("_text").to_pylist() == [lib.decode(x, skip_special_tokens=False) for x in ids]
    assert own.decode(np.array([-1, 10**6])) == b""


def test_token_query(spark):
    lib = library()
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = {r.doc_id: r for r in queries.op13_bpe_round_trip(spark, SF).collect()}
    assert set(got) == set(docs)
    for i, t in docs.items():
        ids = lib.encode(t or "", add_special_tokens=False).ids
        assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == (len(ids), H(",".join(map(str, ids))), H(lib.decode(ids, skip_special_tokens=False)))


def test_queries_of_odd_rows(spark, tmp_path):
    """Nulls in all columns and empty tables, against the SQL where there is one."""
    from tests.oracle import assert_same, connect

    docs = [(1, None, None, None, None), (2, "", "en", None, 0), (2, "a\nb", "en", "s", 3), (2, "a\nb", "en", "s", 3), (None, "x", None, "s", None), (4, "é\n", "de", "", 2)]
    talks = [(1, 0, "user", None), (1, None, None, "Hm."), (2, 3, "assistant", "Yes."), (2, 3, "assistant", "Yes."), (None, 1, "user", "Hi."), (5, None, "user", "")]
    for name, n in (("odd", None), ("none", 0)):
        spark.createDataFrame(docs[:n], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/{name}/documents.parquet")
        spark.createDataFrame(talks[:n], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/{name}/conversations.parquet")
        for q in ("op11_merkle_manifest", "op12_conversation_repair"):
            assert_same(queries.QUERIES[q](spark, f"{tmp_path}/{name}"), connect(f"{tmp_path}/{name}"), queries.ORACLE[q])
        assert queries.op13_bpe_round_trip(spark, f"{tmp_path}/{name}").count() == (len(docs) if n is None else 0)
