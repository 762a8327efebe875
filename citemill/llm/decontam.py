"""Benchmark decontamination: Wu-Manber search for word windows of test items in whole documents."""

from __future__ import annotations

import pickle
import uuid
from collections import OrderedDict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from citemill.llm import storage
from citemill.llm.bytescan import LOWER, U64, Table, hash_runs, mix, runs, slices, spread, strings

WINDOW = 13
SHARD_ITEMS, SHARD_BYTES = 20_000, 16 << 20
CACHE_BYTES = 128 << 20
SEGMENT = 256  # words that one cursor covers
#: Bytes of words: digits, lower-case letters and everything beyond ASCII.
WORD = np.zeros(256, bool)
WORD[48:58] = WORD[97:123] = WORD[128:] = True


def words_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes, starts and lengths of all words, and each text's first word (one entry more than texts)."""
    buf, offsets = strings(column)
    low = LOWER[buf]
    return low, *runs(WORD[low], offsets)


class Patterns:
    """Shift, bucket and prefix tables for windows of one number of words.

    The letters of this search are words, as 64-bit hashes, and a block is two neighbouring words (one,
    where windows have one).  The shift table says how far the window may move when a block ends it: to
    the block's last place in any window, or past it.  Where the shift is zero, the block's hash selects
    the bucket of the windows that end with it.  A bucket is ordered by the hashes of the words before
    the block, so those that fit lie together; each of these is compared with the text byte by byte.
    """

    def __init__(self, low: np.ndarray, starts: np.ndarray, lens: np.ndarray, size: int, at: np.ndarray, items: list[list]):
        """``at`` has the first word of each different window among the words given, ``items`` the ids of those that hold it."""
        self.size, self.block, self.items = size, min(2, size), items
        self.low, self.starts, self.lens, self.at = low, starts, lens, at
        h = hash_runs(low, starts, lens)[at[:, None] + np.arange(size)]
        blocks = self._blocks(h)  # a column for each place where a block may begin
        far = blocks.shape[1]
        known = np.unique(blocks)
        self.shift, self.default = np.full(len(known), far, np.int64), far
        for place in range(far):
            self.shift[np.searchsorted(known, blocks[:, place])] = far - 1 - place
        self.table = Table()
        self.table.insert(known)  # a block's place there is its row in the arrays of shifts and buckets
        prefix, bucket = self._sum(h[:, : size - self.block]), np.searchsorted(known, blocks[:, -1])
        self.which = np.lexsort((prefix, bucket))
        self.prefix = prefix[self.which]
        self.first = np.searchsorted(bucket[self.which], np.arange(len(known) + 1))
        self.bytes = low.nbytes + 16 * len(starts) + 24 * len(at) + 48 * len(known)

    def _blocks(self, h: np.ndarray) -> np.ndarray:
        return h if self.block == 1 else mix(h[..., :-1] * U64(0x9E3779B97F4A7C15) + h[..., 1:])

    @staticmethod
    def _sum(h: np.ndarray) -> np.ndarray:
        out = np.zeros(len(h), U64)
        for i in range(h.shape[1]):
            out = (out + U64(i + 1)) * U64(0xD6E8FEB86659FD93) + h[:, i]
        return mix(out)

    def hits(self, low: np.ndarray, starts: np.ndarray, lens: np.ndarray, first: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First word and window number of each occurrence; cursors over all texts move together."""
        size, counts = self.size, np.diff(first)
        # a cursor for each stretch of SEGMENT places where a window may end
        places = np.maximum(counts - size + 1, 0)
        pieces = -(-places // SEGMENT)
        text = np.repeat(np.arange(len(counts)), pieces)
        nth = np.arange(len(text)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        at = first[text] + size - 1 + nth * SEGMENT
        stop = np.minimum(at + SEGMENT, first[text + 1])
        found: list[tuple[np.ndarray, np.ndarray]] = []
        while len(at):
            block = h[at] if self.block == 1 else mix(h[at - 1] * U64(0x9E3779B97F4A7C15) + h[at])
            got = self.table.find(block)
            shift = np.where(got >= 0, self.shift[np.maximum(got, 0)], self.default)
            if (zero := shift == 0).any():
                found.append((at[zero] - size + 1, got[zero]))
            at = at + np.maximum(shift, 1)
            live = at < stop
            at, stop = at[live], stop[live]
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        for begin, bucket in found:
            for i in range(0, len(begin), 1 << 15):
                out.append(self._bucket(low, starts, lens, h, begin[i : i + (1 << 15)], bucket[i : i + (1 << 15)]))
        return tuple(np.concatenate(c) for c in zip(*out, strict=True))

    def _bucket(self, low, starts, lens, h, begin: np.ndarray, bucket: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The occurrences among places whose last block ends windows of a bucket."""
        prefix = self._sum(h[begin[:, None] + np.arange(self.size - self.block)])
        a, b = self.first[bucket].copy(), self.first[bucket + 1]
        high = b.copy()
        while (open_ := a < high).any():  # the first of each bucket whose prefix is not smaller
            mid = (a + high) >> 1
            less = open_ & (self.prefix[np.minimum(mid, len(self.prefix) - 1)] < prefix)
            a = np.where(less, mid + 1, a)
            high = np.where(open_ & ~less, mid, high)
        place, number = [], []
        live = np.flatnonzero(a < b)
        while len(live := live[self.prefix[a[live]] == prefix[live]]):
            g = self.which[a[live]]
            same = self._same(low, starts, lens, begin[live], g)
            place.append(begin[live[same]])
            number.append(g[same])
            a[live] += 1
            live = live[a[live] < b[live]]
        return (np.concatenate(place), np.concatenate(number)) if place else (np.zeros(0, np.int64), np.zeros(0, np.int64))

    def _same(self, low, starts, lens, begin: np.ndarray, g: np.ndarray) -> np.ndarray:
        """Whether the words from ``begin`` on are those of the windows ``g``, letter by letter."""
        mine, theirs = begin[:, None] + np.arange(self.size), self.at[g][:, None] + np.arange(self.size)
        same = (lens[mine] == self.lens[theirs]).all(1)
        some = np.flatnonzero(same)
        x, y = mine[some].ravel(), theirs[some].ravel()
        differ = low[spread(starts[x], lens[x])] != self.low[spread(self.starts[y], self.lens[y])]
        owner = np.repeat(np.repeat(some, self.size), lens[x])
        same[owner[differ]] = False
        return same


def _shards(items: DataFrame, item_id: str, text: str, window: int) -> list[str]:
    """Pattern tables of bounded numbers of items, in the shared folder; their addresses."""
    spark = items.sparkSession
    items = items.select(F.col(item_id).alias("i"), F.col(text).alias("t"))
    folder = storage.fresh(spark, "patterns")

    def build(batches):
        held: list[pa.RecordBatch] = []
        for batch in batches:
            for i, j in slices(batch, "t", SHARD_BYTES // 4):
                held.append(batch.slice(i, j - i))
                if sum(x.nbytes for x in held) > SHARD_BYTES:
                    yield write(held)
                    held = []
        if held:
            yield write(held)

    def write(held):
        table = pa.Table.from_batches(held).combine_chunks()
        low, starts, lens, first = words_of(table.column("t"))
        windows: dict[int, dict[tuple[bytes, ...], tuple[int, list]]] = {}
        for k, item in enumerate(table.column("i").to_pylist()):
            a, b = int(first[k]), int(first[k + 1])
            words = [low[s : s + n].tobytes() for s, n in zip(starts[a:b].tolist(), lens[a:b].tolist(), strict=True)]
            size = min(window, len(words))
            for w in range(len(words) - size + 1) if size else ():
                own = windows.setdefault(size, {}).setdefault(tuple(words[w : w + size]), (a + w, []))[1]
                if not own or own[-1] != item:
                    own.append(item)
        uri = f"{folder}/{uuid.uuid4().hex}.patterns"
        made = [Patterns(low, starts, lens, size, np.array([x[0] for x in w.values()]), [x[1] for x in w.values()]) for size, w in sorted(windows.items())]
        storage.write_bytes(uri, pickle.dumps(made))
        return pa.RecordBatch.from_pydict({"uri": [uri]})

    parts = max(1, -(-items.count() // SHARD_ITEMS))
    return sorted(r.uri for r in items.repartition(parts).mapInArrow(build, "uri string").collect())


_tables: OrderedDict[str, list[Patterns]] = OrderedDict()


def _patterns(uri: str) -> list[Patterns]:
    """A shard's tables; the worker keeps those used last, CACHE_BYTES of them."""
    if uri not in _tables:
        _tables[uri] = pickle.loads(storage.read_bytes(uri))
        while len(_tables) > 1 and sum(p.bytes for t in _tables.values() for p in t) > CACHE_BYTES:
            _tables.popitem(last=False)
    _tables.move_to_end(uri)
    return _tables[uri]


def find_contamination(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """``docs`` with _n_words, _n_hit (words inside an occurrence of a window) and _items, the sorted ids of items found.

    An item's windows are its runs of ``window`` words, or all its words where it has fewer; an item
    without words has none, and so has a null text.  Overlapping occurrences count a word once.
    Items with equal windows are all found, repeated items once.  A null item id is reported as null,
    first in the list.  Every row of ``docs`` is searched, repeated ones each; an empty table of either
    kind gives no rows or no hits.  Columns of ``docs`` that have the new names are replaced.
    The documents are not shuffled.  The items' tables lie in the shared folder in parts of a
    bounded size, and each batch of documents meets one part after the other.
    """
    docs = docs.drop("_n_words", "_n_hit", "_items")
    kind = items.schema[item_id].dataType
    shards = _shards(items, item_id, item_text, window)
    added = [T.StructField("_n_words", T.LongType()), T.StructField("_n_hit", T.LongType()), T.StructField("_items", T.ArrayType(kind))]
    schema = T.StructType([*docs.schema.fields, *added])

    def search(batches):
        for batch in batches:
            for i, j in slices(batch, text):
                part = batch.slice(i, j - i)
                if not part.num_rows:
                    continue
                low, starts, lens, first = words_of(part.column(text))
                h = hash_runs(low, starts, lens)
                hit = np.zeros(len(starts) + 1, np.int64)
                items_of: list[set] = [set() for _ in range(part.num_rows)]
                for uri in shards:
                    for patterns in _patterns(uri):
                        w, g = patterns.hits(low, starts, lens, first, h)
                        np.add.at(hit, w, 1)
                        np.add.at(hit, w + patterns.size, -1)
                        doc = np.searchsorted(first, w, "right") - 1
                        for d, k in np.unique(np.stack([doc, g]), axis=1).T.tolist():
                            items_of[d].update(patterns.items[k])
                covered = np.concatenate([[0], np.cumsum(np.cumsum(hit[:-1]) > 0)])
                ids = [sorted(x, key=lambda v: (v is not None, v)) for x in items_of]
                columns = [pa.array(np.diff(first), pa.int64()), pa.array(np.diff(covered[first]), pa.int64())]
                yield pa.RecordBatch.from_arrays([*part.columns, *columns, pa.array(ids, pa.list_(_arrow(kind)))], names=schema.names)

    return docs.mapInArrow(search, schema)


def _arrow(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def is_contaminated():
    """The rule: at least one hit, and hits make a twentieth of the words or more."""
    return (F.col("_n_hit") > 0) & (20 * F.col("_n_hit") >= F.col("_n_words"))
