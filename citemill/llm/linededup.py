"""Line deduplication: documents probe sharded minimal perfect hashes of the lines that repeat."""

from __future__ import annotations

import io
import uuid
from collections import OrderedDict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from citemill.llm import storage
from citemill.llm.bytescan import LOWER, SPACE, U64, hash_runs, mix, slices, spark_hash, spread, strings

LEAST_CHARS, LEAST_DOCS = 20, 3
SHARD_KEYS = 1 << 17
CACHE_BYTES = 96 << 20
GATHER_BYTES, SLICE_BYTES = 128 << 20, 16 << 20  # of texts that meet a shard together; of texts cut into lines at once
GAMMA, LEVELS = 2.0, 40


class PerfectHash:
    """A minimal perfect hash of distinct 64-bit keys: bitmaps of the places that one key alone takes, level by level.

    A key's index is the rank of its bit.  Keys that share a place go to the next level with
    another hash; the few that are left after LEVELS are kept in a sorted list.
    """

    def __init__(self, sizes: np.ndarray, words: np.ndarray, rest: np.ndarray):
        self.sizes, self.words, self.rest = sizes, words, rest
        self.first = np.concatenate([[0], np.cumsum((sizes + 63) // 64)]).astype(np.int64)
        counts = np.bitwise_count(words).astype(np.int64)
        self.rank = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
        self.n = int(self.rank[-1]) + len(rest)

    @staticmethod
    def _place(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        return (mix(keys + U64(0x9E3779B97F4A7C15 * (level + 1) % (1 << 64))) % U64(size)).astype(np.int64)

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        sizes, words, left = [], [], keys
        while len(left) and len(sizes) < LEVELS:
            size = max(64, int(GAMMA * len(left)))
            at = cls._place(left, len(sizes), size)
            alone = np.bincount(at, minlength=size)[at] == 1
            bits = np.zeros((size + 63) // 64 * 64, bool)
            bits[at[alone]] = True
            words.append(np.packbits(bits, bitorder="little").view("<u8"))
            sizes.append(size)
            left = left[~alone]
        return cls(np.array(sizes, np.int64), np.concatenate(words) if words else np.zeros(0, U64), np.sort(left))

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Index of each key; for a key that was not built in, -1 or any index."""
        out = np.full(len(keys), -1, np.int64)
        live = np.arange(len(keys))
        for level, size in enumerate(self.sizes.tolist()):
            if not live.size:
                break
            at = self._place(keys[live], level, size)
            word, bit = self.first[level] + (at >> 6), (at & 63).astype(U64)
            hit = (self.words[word] >> bit) & U64(1) == 1
            got = live[hit]
            below = self.words[word[hit]] & ((U64(1) << bit[hit]) - U64(1))
            out[got] = self.rank[word[hit]] + np.bitwise_count(below)
            live = live[~hit]
        if live.size and len(self.rest):
            at = np.searchsorted(self.rest, keys[live])
            same = (at < len(self.rest)) & (self.rest[np.minimum(at, len(self.rest) - 1)] == keys[live])
            out[live[same]] = int(self.rank[-1]) + at[same]
        return out


class LineShard:
    """Fingerprints, counts and the document that keeps the line, in the order of a perfect hash.

    Lines that share a 64-bit key with another line come after these, in the order of their keys.
    """

    def __init__(self, index: PerfectHash, prints: np.ndarray, counts: np.ndarray, keeper: np.ndarray, more: np.ndarray):
        self.index, self.prints, self.counts, self.keeper, self.more = index, prints, counts, keeper, more

    @classmethod
    def build(cls, keys, prints, counts, keeper) -> LineShard:
        alone, first = np.unique(keys, return_index=True)
        index = PerfectHash.build(alone)
        order = np.empty(len(keys), np.int64)
        order[index.find(alone)] = first
        others = np.setdiff1d(np.arange(len(keys)), first)
        order[len(alone) :] = others = others[np.argsort(keys[others], kind="stable")]
        return cls(index, prints[order], counts[order], keeper[order], keys[others])

    def dump(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, sizes=self.index.sizes, words=self.index.words, rest=self.index.rest, prints=self.prints, counts=self.counts, keeper=self.keeper, more=self.more)
        return out.getvalue()

    @classmethod
    def load(cls, data: bytes) -> LineShard:
        x = np.load(io.BytesIO(data))
        return cls(PerfectHash(x["sizes"], x["words"], x["rest"]), x["prints"], x["counts"], x["keeper"], x["more"])

    def probe(self, keys: np.ndarray, prints: np.ndarray) -> np.ndarray:
        """Place of each line in the arrays, -1 for lines that aren't in the shard."""
        if not self.index.n:
            return np.full(len(keys), -1, np.int64)
        at = self.index.find(keys)
        at = np.where((at >= 0) & (self.prints[np.maximum(at, 0)] == prints), at, -1)
        for k in np.flatnonzero((at < 0) & np.isin(keys, self.more)).tolist() if len(self.more) else ():
            same = np.flatnonzero((self.more == keys[k]) & (self.prints[self.index.n :] == prints[k]))
            at[k] = self.index.n + same[0] if len(same) else -1
        return at


_shards: OrderedDict[str, tuple[LineShard, int]] = OrderedDict()


def _shard(uri: str) -> LineShard:
    """A shard by its address; the worker keeps those used last, CACHE_BYTES of them."""
    if uri not in _shards:
        data = storage.read_bytes(uri)
        _shards[uri] = (LineShard.load(data), len(data))
        while len(_shards) > 1 and sum(x[1] for x in _shards.values()) > CACHE_BYTES:
            _shards.popitem(last=False)
    _shards.move_to_end(uri)
    return _shards[uri][0]


def lines_of(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text number of every line, in order; a text has one line at least."""
    n = int(offsets[-1])
    breaks = np.flatnonzero(buf[:n] == 10)
    owner = np.searchsorted(offsets, breaks, "right") - 1
    texts = np.arange(len(offsets) - 1)
    doc = np.concatenate([texts, owner])
    starts, ends = np.concatenate([offsets[:-1], breaks + 1]), np.concatenate([offsets[1:], breaks])
    order = np.lexsort((starts, doc))
    last = np.lexsort((ends, doc))
    return starts[order], ends[last], doc[order]


def keyed_lines(buf: np.ndarray, offsets: np.ndarray, least_chars: int):
    """Lines (start, end, text) and, for those long enough, their numbers, keys and fingerprints."""
    starts, ends, doc = lines_of(buf, offsets)
    n = int(offsets[-1])
    ink = np.flatnonzero(~SPACE[buf[:n]])
    i, j = np.searchsorted(ink, starts), np.searchsorted(ink, ends)
    some = j > i
    a = np.where(some, np.append(ink, 0)[np.minimum(i, len(ink))], starts)
    b = np.where(some, np.append(ink, 0)[np.maximum(j - 1, 0)] + 1, starts)
    chars = np.concatenate([[0], np.cumsum((buf[:n] & 0xC0) != 0x80)])
    number = np.flatnonzero(chars[b] - chars[a] >= least_chars)
    low = LOWER[buf]
    a, size = a[number], (b - a)[number]
    return starts, ends, doc, number, hash_runs(low, a, size, 1), hash_runs(low, a, size, 2)


def repeated_lines(docs: DataFrame, text: str, doc_id: str, least_chars: int, least_docs: int) -> DataFrame:
    """(key, print, docs, keeper) of the lines found in ``least_docs`` documents or more."""

    def scan(batches):
        for batch in batches:
            for i, j in slices(batch, "t"):
                part = batch.slice(i, j - i)
                if not part.num_rows:
                    continue
                buf, offsets = strings(part.column("t"))
                _, _, doc, number, key, print_ = keyed_lines(buf, offsets, least_chars)
                once = np.unique(np.stack([doc[number].astype(U64), key, print_]), axis=1) if len(number) else np.zeros((3, 0), U64)
                owner = part.column("d").take(pa.array(once[0].astype(np.int64)))
                yield pa.RecordBatch.from_pydict({"key": once[1].view(np.int64), "print": once[2].view(np.int64), "d": owner})

    rows = docs.select(F.col(doc_id).cast("long").alias("d"), F.col(text).alias("t")).mapInArrow(scan, "key long, print long, d long")
    found = rows.groupBy("key", "print").agg(F.count("*").alias("docs"), F.max("d").alias("keeper")).where(F.col("docs") >= least_docs)
    again = storage.cut(docs.select(F.col(doc_id).cast("long").alias("d")).where("d IS NOT NULL").groupBy("d").agg(F.count("*").alias("c")).where("c > 1").select("d"), "line-ids")
    if again.isEmpty():
        return found
    # an id on several rows counts once: what it is too many is taken off
    extra = rows.join(again, "d", "left_semi").groupBy("key", "print", "d").agg((F.count("*") - 1).alias("x")).where("x > 0").groupBy("key", "print").agg(F.sum("x").alias("x"))
    return found.join(extra, ["key", "print"], "left").withColumn("docs", F.col("docs") - F.coalesce("x", F.lit(0))).where(F.col("docs") >= least_docs).drop("x")


def build_index(repeated: DataFrame) -> list[str]:
    """Writes the shards of an index of ``repeated``; their addresses, by number. Each task builds one bounded shard."""
    spark = repeated.sparkSession
    repeated = storage.cut(repeated, "lines")
    count = repeated.count()
    shards = max(1, -(-count // SHARD_KEYS))
    folder = storage.fresh(spark, "line-index")

    def build(key, pdf):
        u = lambda c: pdf[c].to_numpy(np.int64).view(U64)
        none = pdf["keeper"].isna().to_numpy()
        keeper = np.where(none, np.iinfo(np.int64).min, pdf["keeper"].fillna(0).astype(np.int64))
        uri = f"{folder}/{int(key[0])}-{uuid.uuid4().hex}.npz"
        storage.write_bytes(uri, LineShard.build(u("key"), u("print"), pdf["docs"].to_numpy(np.int64), keeper).dump())
        import pandas as pd

        return pd.DataFrame({"shard": [int(key[0])], "uri": [uri]})

    numbered = repeated.withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(shards)).cast("int"))
    made = {r.shard: r.uri for r in numbered.groupBy("shard").applyInPandas(build, "shard int, uri string").collect()}
    return [made.get(i, "") for i in range(shards)]


def _shard_number(keys: np.ndarray, shards: int) -> np.ndarray:
    return np.zeros(len(keys), np.int64) if shards == 1 else spark_hash(keys) % shards


def _hits(held: list[tuple], lookup: list[str]) -> list[np.ndarray]:
    """For each slice's lines, whether they go: the lines of all slices meet each shard once."""
    drop = [np.zeros(len(lines[0]), bool) for _, lines, _ in held]
    keys, prints = (np.concatenate([lines[k] for _, lines, _ in held]) for k in (4, 5))
    own = np.concatenate([own for _, _, own in held])
    piece = np.repeat(np.arange(len(held)), [len(lines[3]) for _, lines, _ in held])
    number = np.concatenate([lines[3] for _, lines, _ in held])
    shard = _shard_number(keys, len(lookup))
    order = np.argsort(shard, kind="stable")
    edges = np.searchsorted(shard[order], np.arange(len(lookup) + 1))
    for s in np.flatnonzero(np.diff(edges)).tolist():
        if lookup[s]:
            mine, index = order[edges[s] : edges[s + 1]], _shard(lookup[s])
            at = index.probe(keys[mine], prints[mine])
            gone = mine[at >= 0][index.keeper[at[at >= 0]] != own[mine[at >= 0]]]
            for k in np.unique(piece[gone]).tolist():
                drop[k][number[gone[piece[gone] == k]]] = True
    return drop


def drop_repeated_lines(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS) -> DataFrame:
    """``docs`` with repeated lines gone from ``text``, and the columns _n_lines and _n_dropped.

    A line's key is the line without ASCII white space at its ends and with A-Z lower-cased.  Keys of
    ``least_chars`` code points or more that ``least_docs`` documents hold stay only in the document
    with the largest id among these, there every time they occur.  Null and empty texts are one
    empty line, and a null text comes back empty.  Rows that share an id are one document: they count
    once, and all rows with the largest id keep the line.  Each row without an id counts as a document
    of its own, smaller than any other; where no holder has an id, all keep the line.  An empty table
    gives an empty result; columns of the new names are replaced, all others stay.

    Only hashes of lines are shuffled, pre-aggregated; texts stay where they are and probe the index.
    A worker gathers the hashes of GATHER_BYTES of texts, so that it loads a shard once for all of
    them, and keeps CACHE_BYTES of shards, so memory does not grow with the index.
    """
    with storage.temporary() as made:
        lookup = build_index(repeated_lines(docs, text, doc_id, least_chars, least_docs))
        made.keep("line-index")
    docs = docs.drop("_n_lines", "_n_dropped")
    schema = T.StructType([*docs.schema.fields, T.StructField("_n_lines", T.LongType()), T.StructField("_n_dropped", T.LongType())])

    def probe(batches):
        held: list[tuple] = []
        for batch in batches:
            for i, j in slices(batch, text, SLICE_BYTES):
                part = batch.slice(i, j - i)
                if not part.num_rows:
                    continue
                lines = keyed_lines(*strings(part.column(text)), least_chars)
                own = part.column(doc_id).cast(pa.int64()).fill_null(np.iinfo(np.int64).min).to_numpy(zero_copy_only=False)[lines[2]]
                held.append((part, lines, own[lines[3]]))
                if sum(x.nbytes for x, _, _ in held) > GATHER_BYTES:
                    yield from rewritten(held)
                    held = []
        if held:
            yield from rewritten(held)

    def rewritten(held):
        for (part, (starts, ends, doc, *_), _), drop in zip(held, _hits(held, lookup), strict=True):
            out = part.column(text).fill_null("") if part.column(text).null_count else part.column(text)
            gone = np.bincount(doc[drop], minlength=part.num_rows)
            if drop.any():
                buf = strings(part.column(text))[0]
                s, e, d = starts[~drop], ends[~drop], doc[~drop]
                size = e - s
                size[:-1] += d[:-1] == d[1:]  # with its line break, where another line follows
                flat = buf[spread(s, size)]
                total = np.bincount(d, size, minlength=part.num_rows).astype(np.int64)
                at = np.concatenate([[0], np.cumsum(total)]).astype(np.int64)
                out = pa.LargeStringArray.from_buffers(part.num_rows, pa.py_buffer(at), pa.py_buffer(flat)).cast(part.schema.field(text).type)
            columns = [out if name == text else part.column(name) for name in part.schema.names]
            lines = np.bincount(doc, minlength=part.num_rows)
            yield pa.RecordBatch.from_arrays([*columns, pa.array(lines, pa.int64()), pa.array(gone, pa.int64())], names=schema.names)

    return docs.mapInArrow(probe, schema)
