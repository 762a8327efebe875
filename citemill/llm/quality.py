"""A quality classifier: an additive model with pairwise terms, whose scores are sums of table entries."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from citemill.llm.bytescan import LOWER, SPACE, U64, hash_runs, mix, runs, slices, strings

FEATURES = (
    "log_bytes", "log_words", "word_bytes", "upper", "digits", "marks", "symbols", "accents", "breaks", "distinct_words",
    "top_word", "same_next", "distinct_lines", "line_bytes", "longest_line", "ends_in_mark", "no_lower", "stops", "bars", "bangs", "inner_marks",
)
MOST_ROWS = 20_000  # labelled rows that a model is fitted on, those whose ids hash lowest
BINS, PAIR_BINS, ROUNDS, PAIRS, PAIR_ROUNDS, RATE = 64, 8, 160, 8, 40, 0.1

_UPPER, _DIGIT, _HIGH, _LETTER, _MARK, _SYMBOL = (np.zeros(256, bool) for _ in range(6))
_UPPER[65:91] = _DIGIT[48:58] = _HIGH[128:] = True
_LETTER[65:91] = _LETTER[97:123] = True
_LETTER |= _HIGH
_MARK[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True
_SYMBOL[[*b"#$%&*+/<=>@[\\]^_`{|}~"]] = True


def features(column: pa.Array) -> np.ndarray:
    """A row of FEATURES for each text, of the whole text; null and empty texts have zeros."""
    buf, offsets = strings(column)
    count, n = len(offsets) - 1, int(offsets[-1])
    low, byte = LOWER[buf], buf[:n]
    size = np.diff(offsets).astype(float)
    owner = np.repeat(np.arange(count), np.diff(offsets))
    per = lambda flags: np.bincount(owner[flags], minlength=count).astype(float)
    share = lambda a, b: np.divide(a, b, out=np.zeros(count), where=b > 0)

    starts, lens, first = runs(~SPACE[buf], offsets)
    words = np.diff(first).astype(float)
    wd = np.repeat(np.arange(count), np.diff(first))
    by_word = lambda flags: np.bincount(wd[flags], minlength=count).astype(float)
    h = hash_runs(low, starts, lens)
    own = h ^ mix(wd.astype(U64) + U64(1))
    kinds, at, times = np.unique(own, return_index=True, return_counts=True)
    distinct = np.bincount(wd[at], minlength=count).astype(float)
    top = np.zeros(count)
    np.maximum.at(top, wd[at], times.astype(float))
    again = np.zeros(len(h), bool)
    again[1:] = (h[1:] == h[:-1]) & (wd[1:] == wd[:-1])
    last = buf[starts + lens - 1] if len(starts) else np.zeros(0, np.uint8)
    lower = (low[:n] == byte) & _LETTER[byte]
    has_lower = np.diff(np.concatenate([[0], np.cumsum(lower)])[np.stack([starts, starts + lens])], axis=0)[0] if len(starts) else np.zeros(0)

    ls, ll, lf = runs(buf != 10, offsets)
    ld = np.repeat(np.arange(count), np.diff(lf))
    lines = np.diff(lf).astype(float)
    lh = np.unique(hash_runs(buf, ls, ll) ^ mix(ld.astype(U64) + U64(7)), return_index=True)[1]
    longest = np.zeros(count)
    np.maximum.at(longest, ld, ll.astype(float))
    marks = per(_MARK[byte])
    ends = by_word(_MARK[last])
    columns = [
        np.log1p(size), np.log1p(words), share(size, words), share(per(_UPPER[byte]), size), share(per(_DIGIT[byte]), size), share(marks, size),
        share(per(_SYMBOL[byte]), size), share(per(_HIGH[byte]), size), share(lines, words), share(distinct, words), share(top, words), share(by_word(again), words),
        share(np.bincount(ld[lh], minlength=count).astype(float), lines), np.log1p(share(size, lines)), np.log1p(longest), share(ends, words), share(by_word(has_lower == 0), words),
        share(by_word((last == 46) | (last == 63) | (last == 33)), words), share(per(byte == 124), size), share(per(byte == 33), size), share(marks - ends, words),
    ]
    return np.stack(columns, axis=1) if count else np.zeros((0, len(FEATURES)))


@dataclass
class Additive:
    """log-odds = start + a table entry for each feature's bin + one for each chosen pair's bins."""

    start: float
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    pairs: list[tuple[int, int]]
    pair_edges: list[np.ndarray]
    pair_tables: list[np.ndarray]

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.start)
        for j, (edges, table) in enumerate(zip(self.edges, self.tables, strict=True)):
            z += table[np.searchsorted(edges, x[:, j], "right")]
        for (a, b), table in zip(self.pairs, self.pair_tables, strict=True):
            z += table[np.searchsorted(self.pair_edges[a], x[:, a], "right"), np.searchsorted(self.pair_edges[b], x[:, b], "right")]
        return 1 / (1 + np.exp(-z))


def _edges(values: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(values, np.arange(1, bins) / bins)) if len(values) else np.zeros(0)


def _tree(g: np.ndarray, h: np.ndarray, depth: int, ridge: float) -> np.ndarray:
    """The step of each bin by a tree over the bins' order, of ``depth`` levels, on sums of gradient and curvature."""
    whole = -g.sum() / (h.sum() + ridge)
    if depth == 0 or len(g) < 2:
        return np.full(len(g), whole)
    gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gr, hr = g.sum() - gl, h.sum() - hl
    gain = gl**2 / (hl + ridge) + gr**2 / (hr + ridge)
    gain[(hl < 1) | (hr < 1)] = -1
    i = int(np.argmax(gain))
    if gain[i] <= g.sum() ** 2 / (h.sum() + ridge) + 1e-9:
        return np.full(len(g), whole)
    return np.concatenate([_tree(g[: i + 1], h[: i + 1], depth - 1, ridge), _tree(g[i + 1 :], h[i + 1 :], depth - 1, ridge)])


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 2.0) -> Additive:
    """Boosts one shallow tree a feature in turn, round after round; then the pairs that explain most of what is left."""
    n, d = x.shape
    mean = (y.sum() + 1) / (n + 2)
    model = Additive(float(np.log(mean / (1 - mean))), [_edges(x[:, j], BINS) for j in range(d)], [], [], [_edges(x[:, j], PAIR_BINS) for j in range(d)], [])
    bins = [np.searchsorted(e, x[:, j], "right") for j, e in enumerate(model.edges)]
    coarse = [np.searchsorted(e, x[:, j], "right") for j, e in enumerate(model.pair_edges)]
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    z = np.full(n, model.start)

    def slopes():
        p = 1 / (1 + np.exp(-z))
        return p - y, np.maximum(p * (1 - p), 1e-6)

    for _ in range(ROUNDS if n else 0):
        for j in range(d):
            g, h = slopes()
            size = len(model.tables[j])
            step = RATE * _tree(np.bincount(bins[j], g, size), np.bincount(bins[j], h, size), 2, ridge)
            model.tables[j] += step
            z += step[bins[j]]
    if n:
        g, h = slopes()
        gains = []
        for a in range(d):
            for b in range(a + 1, d):
                cell, size = coarse[a] * PAIR_BINS + coarse[b], PAIR_BINS * PAIR_BINS
                gc, hc = np.bincount(cell, g, size), np.bincount(cell, h, size)
                gains.append((float((gc**2 / (hc + 10 * ridge)).sum()), a, b))
        model.pairs = [(a, b) for _, a, b in sorted(gains, reverse=True)[:PAIRS]]
    model.pair_tables = [np.zeros((PAIR_BINS, PAIR_BINS)) for _ in model.pairs]
    for _ in range(PAIR_ROUNDS):
        for (a, b), table in zip(model.pairs, model.pair_tables, strict=True):
            g, h = slopes()
            cell, size = coarse[a] * PAIR_BINS + coarse[b], PAIR_BINS * PAIR_BINS
            gc, hc = np.bincount(cell, g, size).reshape(table.shape), np.bincount(cell, h, size).reshape(table.shape)
            rows = np.argmax([_cut_gain(gc[: i + 1], hc[: i + 1], ridge) + _cut_gain(gc[i + 1 :], hc[i + 1 :], ridge) for i in range(PAIR_BINS - 1)])
            step = np.empty_like(table)  # one cut of the first feature, then each part by trees over the second
            for part in (slice(0, rows + 1), slice(rows + 1, PAIR_BINS)):
                step[part] = _tree(gc[part].sum(0), hc[part].sum(0), 1, 5 * ridge)
            table += RATE * step
            z += RATE * step[coarse[a], coarse[b]]
    return model


def _cut_gain(g: np.ndarray, h: np.ndarray, ridge: float) -> float:
    gl, hl = np.cumsum(g.sum(0))[:-1], np.cumsum(h.sum(0))[:-1]
    return float((gl**2 / (hl + 5 * ridge) + (g.sum() - gl) ** 2 / (h.sum() - hl + 5 * ridge)).max())


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", text: str = "text", doc_id: str = "doc_id", most_rows: int = MOST_ROWS) -> Additive:
    """Fits a model on at most ``most_rows`` rows of ``labels`` (doc_id, label) that have a document.

    The sample is the bound that keeps the fit on the driver: it takes features of that many rows,
    never texts.  Labels other than 0 and 1 and null ids are passed over, and of several labels of an
    id the larger counts; rows with one id and different texts are examples each.  Without any labelled
    document the model gives every text the same score of one half.
    """
    known = labels.select(F.col(doc_id).cast("long").alias("d"), F.col(label).cast("int").alias("y")).where("d IS NOT NULL AND y IN (0, 1)")
    known = known.groupBy("d").agg(F.max("y").alias("y"))
    picked = known.orderBy(F.xxhash64("d"), "d").limit(most_rows)  # bounded, so the join below may send it to every task
    rows = docs.select(F.col(doc_id).cast("long").alias("d"), F.col(text).alias("t")).join(F.broadcast(picked), "d")

    def measure(batches):
        for batch in batches:
            for i, j in slices(batch, "t"):
                part = batch.slice(i, j - i)
                if part.num_rows:
                    x = features(part.column("t"))
                    yield pa.RecordBatch.from_pydict({"d": part.column("d"), "y": part.column("y"), "x": pa.array(list(x), pa.list_(pa.float64()))})

    found = rows.mapInArrow(measure, "d long, y int, x array<double>").dropDuplicates(["d", "x"]).orderBy(F.xxhash64("d"), "d", "x").limit(most_rows).collect()
    x = np.array([r.x for r in found]).reshape(-1, len(FEATURES))
    return fit(x, np.array([r.y for r in found], float))


def score(docs: DataFrame, model: Additive, text: str = "text") -> DataFrame:
    """``docs`` with _score, the probability of label 1, from the whole texts; nothing is shuffled.

    Null and empty texts are scored alike, by features of zero; repeated rows get equal scores; an empty
    table stays empty; a column that is named _score is replaced.
    """
    docs = docs.drop("_score")
    schema = T.StructType([*docs.schema.fields, T.StructField("_score", T.DoubleType())])

    def add(batches):
        for batch in batches:
            for i, j in slices(batch, text):
                part = batch.slice(i, j - i)
                if part.num_rows:
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(model.score(features(part.column(text))))], names=schema.names)

    return docs.mapInArrow(add, schema)
