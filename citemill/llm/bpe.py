"""Byte-level byte-pair encoding by an index of pair occurrences, and decoding.

The different pieces (pre-tokens) of a stretch of a partition lie end to end as symbols with links to their
neighbours.  An index maps each pair that has a rank to all its positions.  Active ranks are taken in
ascending order; all positions of one are merged at once, and only the pairs beside them enter the index
anew.  As every merged symbol is made by one merge and used by later ones only, that order is
the one in which each piece alone would be merged; a file where that doesn't hold is refused.

Pieces that were met before keep their ids in a table of at most ``MOST_PIECES``, compared byte by byte.
The file's own pre-tokenizer is asked once for the class of each different character, as its version of Unicode
decides that; where pieces begin follows from the classes by array operations.
"""

from __future__ import annotations

import codecs
import heapq
import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

from citemill.llm.bytescan import Table, hash_runs, slices, spread, strings

MOST_BYTES = 2 << 20  # text that is worked on at a time; longer texts are cut where pieces end anyway
MOST_PIECES = 1 << 20
_W, _L, _N, _P, _UNKNOWN = range(5)
_SPACE, _APOSTROPHE = 32, 39
#: Fixed: endings that are pieces of their own after an apostrophe.
_ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")
_PARTS = "_part int, _last boolean, _ids array<int>"


def _byte_of() -> dict[str, int]:
    """The byte for which a byte-level vocabulary writes each character."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def _flat(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes end to end, with where each part starts and its length."""
    lens = np.array([len(x) for x in parts], np.int64)
    return np.frombuffer(b"".join(parts), np.uint8), np.cumsum(lens) - lens, lens


class Model:
    """A byte-level vocabulary with its merges, read from a file of the tokenizers library."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, before = spec["model"], spec.get("pre_tokenizer") or {}
        plain = model["type"] == "BPE" and not any(model.get(x) for x in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
        if not plain or spec.get("normalizer") or before.get("type") != "ByteLevel" or not before.get("use_regex") or before.get("add_prefix_space"):
            raise ValueError(f"{path} is no plain byte-level BPE file")
        if any(x["lstrip"] or x["rstrip"] or x["single_word"] for x in spec["added_tokens"]):
            raise ValueError(f"{path} has added tokens with conditions")
        self._classes_of = Tokenizer.from_file(path).pre_tokenizer.pre_tokenize_str
        vocab, byte = model["vocab"], _byte_of()
        special = {x["content"].encode(): x["id"] for x in spec["added_tokens"]}
        self.special = sorted(special.items(), key=lambda x: -len(x[0]))
        raw = {i: bytes(byte[c] for c in s) for s, i in vocab.items()} | {i: s for s, i in special.items()}
        self.size = max(raw) + 1
        self.bytes, self.at, self.lens = _flat([raw.get(i, b"") for i in range(self.size)])
        self.byte_id = np.array([vocab[c] for c in sorted(byte, key=byte.get)], np.int64)
        pairs = [x.split(" ") if isinstance(x, str) else x for x in model["merges"]]
        left, right = (np.array([vocab[p[i]] for p in pairs], np.int64) for i in (0, 1))
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        born = np.full(self.size, -1, np.int64)
        born[self.made] = np.arange(len(pairs))
        if len(np.unique(self.made)) < len(pairs) or (np.maximum(born[left], born[right]) >= np.arange(len(pairs))).any():
            raise ValueError(f"{path} has merges that aren't in the order of their making")
        keys = left * self.size + right
        self.order = np.argsort(keys)
        self.keys, self.left, self.right = keys[self.order], left, right
        self.kinds = np.full(0x110000, _UNKNOWN, np.uint8)
        self.kinds[_SPACE] = _W
        self._forget()

    def _forget(self) -> None:
        self.table, self.slot = Table(16), np.zeros(0, np.int64)
        self.pool, self.ids = _Pool(np.uint8), _Pool(np.int32)

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, -1 where it has none."""
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.order[at], -1) if len(self.keys) else np.full(len(key), -1)

    def merge(self, buf: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces of ``buf``, end to end, and how many each has."""
        symbol = self.byte_id[buf[spread(starts, lens)]]
        n, ends = len(symbol), np.cumsum(lens)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        after[ends - 1], before[ends - lens] = -1, -1
        index: dict[int, list[np.ndarray]] = {}  # rank -> positions of the pair's left symbol
        active: list[int] = []

        def note(positions: np.ndarray) -> None:
            rank = self._ranks(symbol[positions], symbol[after[positions]])
            has = rank >= 0
            positions, rank = positions[has], rank[has]
            if not len(rank):
                return
            order = np.argsort(rank, kind="stable")
            positions, rank = positions[order], rank[order]
            cuts = np.flatnonzero(np.diff(rank)) + 1
            for r, group in zip(rank[np.concatenate([[0], cuts])].tolist(), np.split(positions, cuts), strict=True):
                if r not in index:
                    index[r] = []
                    heapq.heappush(active, r)
                index[r].append(group)

        note(np.flatnonzero(after >= 0))
        while active:
            rank = heapq.heappop(active)
            groups = index.pop(rank)
            at = np.unique(np.concatenate(groups)) if len(groups) > 1 else groups[0]
            at = at[(symbol[at] == self.left[rank]) & (after[at] >= 0)]
            at = at[symbol[after[at]] == self.right[rank]]
            if self.left[rank] == self.right[rank] and len(at) > 1:  # of pairs that overlap, every other one from the left
                chained = np.concatenate([[False], at[1:] == after[at[:-1]]])
                first = np.maximum.accumulate(np.where(chained, 0, np.arange(len(at))))
                at = at[(np.arange(len(at)) - first) % 2 == 0]
            if not len(at):
                continue
            gone = after[at]
            symbol[at], symbol[gone] = self.made[rank], -1
            after[at] = after[gone]
            follows = after[at] >= 0
            before[after[at][follows]] = at[follows]
            beside = before[at]
            beside = np.concatenate([beside[beside >= 0], at[follows]])
            note(beside[symbol[beside] >= 0])
        live = symbol >= 0
        counts = np.concatenate([[0], np.cumsum(live)])
        return symbol[live].astype(np.int32), counts[ends] - counts[ends - lens]

    def _classes(self, code: np.ndarray) -> np.ndarray:
        kinds = self.kinds[code]
        if (kinds == _UNKNOWN).any():
            for c in np.unique(code[kinds == _UNKNOWN]).tolist():
                around = [x for x, _ in self._classes_of(f"a{chr(c)}1")]
                if len(around) == 2:
                    self.kinds[c] = _L if len(around[0]) > 1 and around[1] == "1" else _N
                else:
                    self.kinds[c] = _P if len(self._classes_of(f"!{chr(c)}!")) == 1 else _W
            kinds = self.kinds[code]
        return kinds

    def _specials(self, data: bytes, offsets: np.ndarray) -> list[tuple[int, int, int]]:
        """(start, end, id) of added tokens' strings inside texts, leftmost and longest first, none over another."""
        found = []
        for mark, i in self.special:
            at = data.find(mark)
            while at >= 0:
                found.append((at, -len(mark), i))
                at = data.find(mark, at + 1)
        out, done = [], 0
        for at, size, i in sorted(found):
            k = int(np.searchsorted(offsets, at, "right"))
            if at >= done and at - size <= offsets[k]:
                out.append((at, at - size, i))
                done = at - size
        return out

    def _pieces(self, buf: np.ndarray, offsets: np.ndarray, specials) -> np.ndarray:
        """Where pieces start, as byte positions; ``buf`` has the texts alone."""
        if not len(buf):
            return np.zeros(0, np.int64)
        place = np.flatnonzero((buf & 0xC0) != 0x80)
        code = np.frombuffer(buf.tobytes().decode().encode("utf-32-le"), np.uint32)
        kind, n = self._classes(code), len(code)
        heads = np.concatenate([offsets[:-1][np.diff(offsets) > 0], [x for s in specials for x in s[:2]]]).astype(np.int64)
        head = np.zeros(n + 1, bool)
        head[np.searchsorted(place, heads)] = True
        head[n] = True
        start = head[:n].copy()
        start[1:] |= kind[1:] != kind[:-1]
        gap = np.flatnonzero((kind[:-1] == _W) & (kind[1:] != _W) & ~head[1:n])  # white space before something else
        start[gap] = True
        start[gap[code[gap] == _SPACE] + 1] = False
        ticks = np.flatnonzero((code == _APOSTROPHE) & start)
        for ending in _ENDINGS:
            size = len(ending)
            own = ticks[ticks + size < n]
            for i, c in enumerate(ending, 1):
                own = own[(code[own + i] == ord(c)) & ~head[own + i]]
            start[own + 1] = False
            own = own[own + size + 1 < n]
            start[own + size + 1] = True
        return place[start]

    def encode(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts that lie end to end in ``buf`` (eight spare bytes follow), and where each text's ids start."""
        if len(self.pool.starts) > MOST_PIECES:
            self._forget()
        n = int(offsets[-1])
        specials = self._specials(buf[:n].tobytes(), offsets)
        starts = self._pieces(buf[:n], offsets, specials)
        lens = np.diff(np.append(starts, n))
        mark = np.full(len(starts), -1, np.int64)
        if specials:
            at = np.array([s for s, _, _ in specials])
            mark[np.searchsorted(starts, at)] = [i for _, _, i in specials]
            last = np.searchsorted(at, starts, "right") - 1
            end = np.array([e for _, e, _ in specials])
            keep = (mark >= 0) | (last < 0) | (starts >= end[last])  # pieces inside a mark go
            starts, mark = starts[keep], mark[keep]
            lens = np.diff(np.append(starts, n))
        known = self._known(buf, starts, lens, mark < 0)
        sizes = np.where(mark >= 0, 1, self.ids.lens[known])
        ids = np.empty(int(sizes.sum()), np.int32)
        first = np.cumsum(sizes) - sizes
        words = np.flatnonzero(mark < 0)
        ids[spread(first[words], sizes[words])] = self.ids.data[spread(self.ids.starts[known[words]], sizes[words])]
        ids[first[mark >= 0]] = mark[mark >= 0]
        ends = np.append(first, len(ids))
        return ids, ends[np.searchsorted(starts, offsets)]

    def _known(self, buf, starts, lens, wanted) -> np.ndarray:
        """Entry of each wanted piece in the table; those that are new are merged first."""
        out = np.zeros(len(starts), np.int64)
        rows = np.flatnonzero(wanted)
        if not len(self.pool.starts):
            self._add(buf, np.zeros(1, np.int64), np.zeros(1, np.int64))  # the empty piece is entry 0
        if not rows.size:
            return out
        h = hash_runs(buf, starts[rows], lens[rows])
        at = self.table.find(h)
        new = np.flatnonzero(at < 0)
        if new.size:
            hashes, pick = np.unique(h[new], return_index=True)
            pick = rows[new[pick]]
            first = len(self.pool.starts)
            self.table.insert(hashes)
            self.slot = np.concatenate([self.slot, first + np.arange(len(hashes))])
            self._add(buf, starts[pick], lens[pick])
            at[new] = self.table.find(h[new])
        at = self.slot[at]
        size = lens[rows]
        same = self.pool.lens[at] == size
        ok = np.flatnonzero(same)
        if not np.array_equal(self.pool.data[spread(self.pool.starts[at[ok]], size[ok])], buf[spread(starts[rows[ok]], size[ok])]) or len(ok) < len(same):
            for i, row in enumerate(rows.tolist()):  # other pieces of the same hash
                s, k, e = int(starts[row]), int(lens[row]), int(at[i])
                if self.pool.bytes_of(e) != buf[s : s + k].tobytes():
                    at[i] = len(self.pool.starts)
                    self._add(buf, starts[row : row + 1], lens[row : row + 1])
        out[rows] = at
        return out

    def _add(self, buf, starts, lens) -> None:
        full = lens > 0
        ids, sizes = self.merge(buf, starts[full], lens[full])
        counts = np.zeros(len(lens), np.int64)
        counts[full] = sizes
        self.pool.add(buf[spread(starts, lens)], lens)
        self.ids.add(ids, counts)

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of ids, end to end; an id that the vocabulary lacks has none."""
        ids = ids[(ids >= 0) & (ids < self.size)]
        return self.bytes[spread(self.at[ids], self.lens[ids])].tobytes()

    def cut(self, text: np.ndarray, start: int, most: int) -> int:
        """End of a part of about ``most`` bytes from ``start``: a place where a piece ends whatever is around.

        That is between a letter, a digit or a sign that is no apostrophe and a character of
        another of these classes, or before a single space; never inside an added token's string.
        """
        n, size = len(text), most
        while start + size < n:
            reach = 4096
            while True:
                low, high = max(start, start + size - reach), start + size
                while low > start and text[low] & 0xC0 == 0x80:
                    low -= 1
                while high > low and text[high] & 0xC0 == 0x80:
                    high -= 1
                window = text[low:high]
                place = np.flatnonzero((window & 0xC0) != 0x80)
                code = np.frombuffer(window.tobytes().decode().encode("utf-32-le"), np.uint32)
                kind = self._classes(code)
                solid = kind != _W
                good = solid[:-1] & solid[1:] & (kind[:-1] != kind[1:]) & (code[:-1] != _APOSTROPHE)
                if len(code) > 2:
                    good[:-1] |= solid[:-2] & (code[1:-1] == _SPACE) & solid[2:]
                for i in np.flatnonzero(good)[::-1].tolist():
                    at = low + int(place[i + 1])
                    if not any(text[max(start, at - len(m) + 1) : at + len(m) - 1].tobytes().find(m) >= 0 for m, _ in self.special):
                        return at
                if low == start:
                    break
                reach *= 8
            size *= 2
        return n


class _Pool:
    """Runs of numbers end to end, in arrays that double."""

    def __init__(self, kind):
        self.data, self.n = np.zeros(1 << 12, kind), 0
        self.starts, self.lens = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, flat: np.ndarray, lens: np.ndarray) -> None:
        while self.n + len(flat) > len(self.data):
            self.data = np.concatenate([self.data, np.zeros_like(self.data)])
        self.data[self.n : self.n + len(flat)] = flat
        self.starts = np.concatenate([self.starts, self.n + np.cumsum(lens) - lens])
        self.lens = np.concatenate([self.lens, lens])
        self.n += len(flat)

    def bytes_of(self, i: int) -> bytes:
        return self.data[self.starts[i] : self.starts[i] + self.lens[i]].tobytes()


_models: dict[str, Model] = {}


def model(path: str) -> Model:
    """This process's model of a file; workers keep it from task to task."""
    if path not in _models:
        _models[path] = Model(path)
    return _models[path]


def encode_batches(batches: Iterator[pa.RecordBatch], path: str, text: str) -> Iterator[pa.RecordBatch]:
    """Batches with ``_part``, ``_last`` and ``_ids`` in place of ``text``."""
    own = model(path)
    for batch in batches:
        others = [c for c in batch.schema.names if c != text]
        for first, last in slices(batch, text, MOST_BYTES):
            buf, offsets = strings(batch.column(text).slice(first, last - first))
            size, parts = int(offsets[-1]), []
            if last - first > 1 or size <= MOST_BYTES:
                parts.append((buf, offsets, 0, True))
            else:
                parts = _cut_parts(own, buf[:size])
            for buf, offsets, part, end in parts:
                ids, at = own.encode(buf, offsets)
                n = len(offsets) - 1
                made = [pa.array(np.full(n, part, np.int32)), pa.array(np.full(n, end)), pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids))]
                rest = batch.select(others).slice(first, last - first)
                yield pa.RecordBatch.from_arrays([*rest.columns, *made], names=[*others, "_part", "_last", "_ids"])


def _cut_parts(own: Model, text: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, int, bool]]:
    at = part = 0
    while at < len(text):
        to = own.cut(text, at, MOST_BYTES)
        yield np.concatenate([text[at:to], np.zeros(8, np.uint8)]), np.array([0, to - at]), part, to == len(text)
        at, part = to, part + 1


def decode_batches(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    """Batches with ``_text``, the part of a text that its ``_ids`` stand for."""
    own, rest = model(path), None
    for batch in batches:
        ids = batch.column("_ids")
        at = ids.offsets.to_numpy()
        flat = ids.values.to_numpy(zero_copy_only=False)
        texts = []
        for i, (part, last) in enumerate(zip(batch.column("_part").to_pylist(), batch.column("_last").to_pylist(), strict=True)):
            if part == 0:
                rest = codecs.getincrementaldecoder("utf-8")("replace")
            texts.append(rest.decode(own.decode(flat[at[i] : at[i + 1]]), last))
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, "_text"])


def encode(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """``docs`` less ``text``, with ``_ids`` of it as the file at ``path`` makes them, without special tokens added.

    A text of more than ``MOST_BYTES`` gives several rows in order, ``_part`` from 0, ``_last`` true at the end, so
    memory is bounded by that and the longest piece without a place to cut (a run of one class of characters).
    Null and empty texts have one row without ids.  The string of an added token becomes its id.  Repeated rows
    are rows each, an empty table stays empty, and columns named like those added are replaced.
    """
    docs = docs.drop("_part", "_last", "_ids")
    kept = StructType([f for f in docs.schema if f.name != text])
    schema = StructType([*kept, *StructType.fromDDL(_PARTS)])
    return docs.mapInArrow(lambda batches: encode_batches(batches, path, text), schema)


def decode(parts: DataFrame, path: str) -> DataFrame:
    """Rows of :func:`encode` in their order, with ``_text`` of each part; bytes that are no UTF-8 become U+FFFD."""
    parts = parts.drop("_text")
    return parts.mapInArrow(lambda batches: decode_batches(batches, path), StructType([*parts.schema, *StructType.fromDDL("_text string")]))
