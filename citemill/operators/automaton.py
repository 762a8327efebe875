"""Substring search for long lists of terms: automata over bytes, in shards, scanned in lockstep.

The list is a table.  A shard of it becomes a trie whose links also cover mismatches, so a text is read
once whatever the number of terms.  Shards lie in the shared folder; each has ``MOST_STATES`` states or little
more, and a task holds one at a time.  Texts are cut into overlapping stretches that advance side by side,
one array operation a byte.
"""

from __future__ import annotations

import io

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from citemill.shared import open_file, scratch

MOST_STATES = 1 << 17
STRETCH, SLICE = 512, 4 << 20  # bytes of a stretch, and of text in hand at a time


class Automaton:
    """Terms (bytes, different, none empty) as arrays: where each state goes with each kind of byte, and what ends there."""

    def __init__(self, terms: list[bytes]):
        lens = np.array([len(t) for t in terms], np.int64)
        self.longest = int(lens.max(initial=1))
        flat, at = np.frombuffer(b"".join(terms), np.uint8), np.cumsum(lens) - lens
        used = np.unique(flat)
        self.kind = np.zeros(256, np.int32)  # 0: bytes that no term has
        self.kind[used] = np.arange(1, len(used) + 1)
        width = len(used) + 1
        state, parent, by, levels, count = np.zeros(len(terms), np.int64), [np.zeros(1, np.int64)], [np.zeros(1, np.int64)], [np.zeros(1, np.int64)], 1
        for depth in range(self.longest):
            live = np.flatnonzero(lens > depth)
            keys, inverse = np.unique(state[live] * width + self.kind[flat[at[live] + depth]], return_inverse=True)
            parent.append(keys // width)
            by.append(keys % width)
            levels.append(np.arange(count, count + len(keys)))
            state[live] = count + inverse
            count += len(keys)
        parent, by = np.concatenate(parent), np.concatenate(by)
        self.ends = np.full(count, -1, np.int32)
        self.ends[state] = np.arange(len(terms))
        self.go = np.zeros((count, width), np.int32)
        self.shorter = np.full(count, -1, np.int32)  # the next shorter state where a term ends
        fail = np.zeros(count, np.int64)
        for depth, nodes in enumerate(levels):
            if depth > 1:
                fail[nodes] = self.go[fail[parent[nodes]], by[nodes]]
            if depth:
                self.go[nodes] = self.go[fail[nodes]]
                self.shorter[nodes] = np.where(self.ends[fail[nodes]] >= 0, fail[nodes], self.shorter[fail[nodes]])
            if depth + 1 < len(levels):
                below = levels[depth + 1]
                self.go[parent[below], by[below]] = below
        self.hits = (self.ends >= 0) | (self.shorter >= 0)

    def find(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Rows (text, term), once each and sorted, of texts that lie end to end in ``data``."""
        stretch, over = max(STRETCH, 4 * self.longest), self.longest - 1
        sizes = np.diff(offsets)
        count = np.maximum(1, -(-sizes // stretch))
        text = np.repeat(np.arange(len(sizes)), count)
        start = offsets[text] + (np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)) * stretch
        length = np.minimum(offsets[text + 1], start + stretch + over) - start
        order = np.argsort(-length, kind="stable")
        text, start, length = text[order], start[order], length[order]
        kinds = self.kind[data]
        state, found, held = np.zeros(len(text), np.int64), [], 0
        for step in range(int(length.max(initial=0))):
            n = int(np.searchsorted(-length, -step, "left"))  # those that have a byte left
            state[:n] = self.go[state[:n], kinds[start[:n] + step]]
            hit = np.flatnonzero(self.hits[state[:n]])
            if hit.size:
                found.append(text[hit] * len(self.ends) + state[hit])
                held += hit.size
                if held > 1 << 20:
                    found = [np.unique(np.concatenate(found))]
                    held = 0
        if not found:
            return np.zeros((0, 2), np.int64)
        keys = np.unique(np.concatenate(found))
        text, state, pairs = keys // len(self.ends), keys % len(self.ends), []
        while len(state):
            ends = self.ends[state] >= 0
            pairs.append(np.stack([text[ends], self.ends[state[ends]]], 1))
            on = self.shorter[state] >= 0
            text, state = text[on], self.shorter[state[on]]
        return np.unique(np.concatenate(pairs), axis=0)

    def save(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, longest=self.longest, kind=self.kind, ends=self.ends, go=self.go, shorter=self.shorter)
        return out.getvalue()

    @classmethod
    def load(cls, raw: bytes) -> Automaton:
        own, arrays = cls.__new__(cls), np.load(io.BytesIO(raw))
        own.longest, own.kind, own.ends, own.go, own.shorter = int(arrays["longest"]), arrays["kind"], arrays["ends"], arrays["go"], arrays["shorter"]
        own.hits = (own.ends >= 0) | (own.shorter >= 0)
        return own


def _shards(terms: DataFrame, folder: str) -> list[str]:
    """Writes the automata of a list of terms; the shards' names."""

    def build(batches):
        import uuid

        held, size = [], 0

        def put(held):
            name = uuid.uuid4().hex
            with open_file(f"{folder}/{name}.terms", "w") as f:
                f.write("\0".join(held).encode())
            with open_file(f"{folder}/{name}.npz", "w") as f:
                f.write(Automaton([t.encode() for t in held]).save())
            return pa.RecordBatch.from_pydict({"name": [name]})

        for batch in batches:
            for term in batch.column(0).to_pylist():
                held.append(term)
                size += len(term.encode())
                if size > MOST_STATES:
                    yield put(held)
                    held, size = [], 0
        if held:
            yield put(held)

    # neighbours in order share prefixes, so a range of terms has the fewest states
    ranged = terms.repartitionByRange("term").sortWithinPartitions("term")
    return sorted(r.name for r in ranged.mapInArrow(build, "name string").collect())


def terms_in(texts: DataFrame, text: str, terms: DataFrame, term: str = "term", name: str = "_terms") -> DataFrame:
    """``texts`` with ``name``: which of the terms each text contains as it stands, each once, sorted by their UTF-8 bytes.

    ``terms`` may have any number of rows; null and empty ones and repeats count nothing, and no terms are found in a null or
    empty text.  Terms must hold no NUL.  A text may be of any length; memory is that of one shard and ``SLICE`` bytes of
    text, or one longer text.  A column of that name is replaced.
    """
    texts = texts.drop(name)
    folder = scratch(texts.sparkSession, "terms")
    listed = terms.select(F.col(term).alias("term")).where("term <> ''").distinct()
    shards = _shards(listed, folder)
    schema = StructType([*texts.schema, StructField(name, ArrayType(StringType()))])

    def scan(batches):
        loaded: dict[str, tuple] = {}

        def shard(x):
            if x not in loaded:
                if len(loaded) > 1:
                    loaded.clear()
                with open_file(f"{folder}/{x}.npz") as f:
                    automaton = Automaton.load(f.read())
                with open_file(f"{folder}/{x}.terms") as f:
                    loaded[x] = automaton, f.read().decode().split("\0")
            return loaded[x]

        for batch in batches:
            column = batch.column(text).fill_null("").cast(pa.large_string())
            raw, offsets = column.buffers()[2], np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
            data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
            found: list[list[str]] = [[] for _ in range(len(column))]
            for x in shards:
                automaton, names = shard(x)
                at = 0
                while at < len(column):
                    to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + SLICE, "right")) - 1)
                    to = min(to, len(column))
                    part = data[offsets[at] : offsets[to]]
                    for i, k in automaton.find(part, offsets[at : to + 1] - offsets[at]).tolist():
                        found[at + i].append(names[k])
                    at = to
            for f in found:
                f.sort(key=str.encode)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.list_(pa.string()))], names=[*batch.schema.names, name])

    return texts.mapInArrow(scan, schema)
