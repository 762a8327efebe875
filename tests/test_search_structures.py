"""The index, the automaton and the joins of texts against scans and all pairs."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from citemill.operators import automaton, fulltext, search


def prose(seed=1, n=250):
    rng = random.Random(seed)
    vocab = ["mental", "health", "environmental", "C++", "straße", "STRASSE", "ŒUVRE", "İl", "ſo", "so", "Kelvin", "K", "ὈΔΥΣΣΕΎΣ", "the", "and", "x_1", "don't", "a-b", "中文", "é"]
    out = []
    for _ in range(n):
        words = rng.choices(vocab, k=rng.randint(0, 40))
        out.append("".join(w.upper() if rng.random() < 0.2 else w for w in (x + rng.choice([" ", "  ", "\n", ", ", "-"]) for x in words)))
    return [*out, None, "", "+++", "the " * 20_000 + "mental health"]


QUERIES = ["mental", "mental health", '"mental health"', "C++", '"the and"', '"and the and"', "strasse", "straße", "œuvre", "il", "so", "k", "ὀδυσσεύς", '"don\'t a-b"', "a-b", "++", "absent the", '"mental  health"', "中文", "x_1 É", '"so so"']


def test_index_finds_what_a_scan_finds(spark, tmp_path):
    rows = [(i, t, "extra", "blue") for i, t in enumerate(prose())]
    df = spark.createDataFrame(rows, "id long, text string, _key string, colour string").repartition(3)
    path = f"file://{tmp_path}/index"
    fulltext.build_index(df, "id", ["text", "colour"], path)
    blob = search.blob(["text", "colour"])
    for q in [*QUERIES, "blue mental", '"health blue"']:
        got = sorted(r.id for r in fulltext.search(df, "id", ["text", "colour"], path, q).collect())
        assert got == sorted(r.id for r in df.where(search.matches(blob, q)).collect()), q
    near = fulltext.candidates(spark, path, '"mental health"').count()
    assert near < df.where(F.lower("text").contains("mental")).count()
    with pytest.raises(search.SearchError):
        search.matches(blob, "(", regex=True)


def test_index_of_nothing(spark, tmp_path):
    empty = spark.createDataFrame([], "id long, text string")
    fulltext.build_index(empty, "id", ["text"], f"file://{tmp_path}/none")
    assert fulltext.search(empty, "id", ["text"], f"file://{tmp_path}/none", "word").count() == 0


def test_packed_numbers():
    rng = random.Random(2)
    values = np.array([0, 1, 127, 128, 16383, 16384, 2**31, 2**62, *[rng.getrandbits(rng.randint(1, 62)) for _ in range(2000)]])
    assert fulltext.unpack(fulltext.pack(values)[0]).tolist() == values.tolist()
    assert fulltext.unpack(fulltext.pack(np.zeros(0, np.int64))[0]).tolist() == []


@pytest.mark.parametrize("alphabet", ["ab", "abcdé中"])
def test_automaton_equals_contains(alphabet):
    rng = random.Random(3)
    terms = sorted({"".join(rng.choices(alphabet, k=rng.randint(1, 9))) for _ in range(300)} | {alphabet[0] * 700})
    texts = ["".join(rng.choices(alphabet + " ", k=rng.choice([0, 5, 50, 4000]))) for _ in range(120)] + [alphabet[0] * 5000]
    raw = [t.encode() for t in texts]
    own = automaton.Automaton.load(automaton.Automaton([t.encode() for t in terms]).save())
    found = own.find(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])]))
    assert found.tolist() == [[i, k] for i, t in enumerate(texts) for k, w in enumerate(terms) if w in t]


def test_terms_of_a_long_list(spark):
    """More terms than a shard takes; nulls, empty terms and repeats; null, empty and long texts; one term in most texts."""
    rng = random.Random(4)
    terms = ["".join(rng.choices("abcdefgh", k=rng.randint(3, 12))) for _ in range(30_000)] + ["common", "common", None, "", "é"]
    texts = [" ".join(rng.choices(terms[:30_001], k=20)) + (" common" if i % 5 else "") for i in range(150)] + [None, "", "common " * 100_000, "É é"]
    df = spark.createDataFrame([(i, t, "kept", "lost") for i, t in enumerate(texts)], "id int, t string, name string, _terms string").repartition(3)
    listed = spark.createDataFrame([(t,) for t in terms], "term string").repartition(2)
    out = automaton.terms_in(df, "t", listed)
    assert out.columns == ["id", "t", "name", "_terms"]
    known = sorted({t for t in terms if t}, key=str.encode)
    for r in out.collect():
        assert r._terms == [t for t in known if t in (texts[r.id] or "")]
    assert [r._terms for r in automaton.terms_in(df.limit(2), "t", listed.where("false")).collect()] == [[], []]
    assert automaton.terms_in(df.where("false"), "t", listed).count() == 0


def test_largest_cosine_with_bounds(spark, monkeypatch):
    """Against all pairs, for one block and several; copies, null and empty texts, repeated ids, a term of all own texts."""
    import math
    import re
    from collections import Counter

    from citemill.operators import text_cosine

    rng = random.Random(6)
    vocab = [f"w{i}" for i in range(60)]
    texts = [(i % 90, "always " + " ".join(rng.choices(vocab[: rng.choice([8, 60])], k=rng.randint(0, 40)))) for i in range(120)] + [(200, None), (201, ""), (202, "unknown words"), (203, "x")]
    own = [t for _, t in texts[:25]] + ["always", None, "solo"]

    def grams(t):
        w = re.findall(r"\w{2,}", (t or "").lower())
        return Counter(w + [f"{a} {b}" for a, b in zip(w, w[1:])])

    df = Counter(g for t in own for g in grams(t))
    idf = {g: math.log((1 + len(own)) / (1 + n)) + 1 for g, n in df.items() if n <= 0.95 * len(own)}
    vector = lambda t: {g: (1 + math.log(n)) * idf[g] for g, n in grams(t).items() if g in idf}
    norm = lambda v: math.sqrt(sum(x * x for x in v.values()))
    cos = lambda a, b: sum(x * b.get(g, 0) for g, x in a.items()) / (norm(a) * norm(b)) if a and b else 0
    want = sorted((i, round(max(cos(vector(t), vector(o)) for o in own), 9)) for i, t in texts)
    rows = spark.createDataFrame(texts, "id long, text string").repartition(3)
    mine = spark.createDataFrame([(t,) for t in own], "text string").repartition(2)
    for block in (2_000_000, 150):
        monkeypatch.setattr(text_cosine, "BLOCK", block)
        assert sorted((r.id, round(r.score, 9)) for r in text_cosine.tfidf_similarity(rows, mine).collect()) == want
    assert {r.score for r in text_cosine.tfidf_similarity(rows, mine.where("false")).collect()} == {0.0}
