"""Packing into fixed windows: length combinations chosen by non-negative least squares."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from citemill.llm import storage
from citemill.llm.bytescan import slices
from citemill.llm.tokens import encoder

SIZE = 4096
DEPTH = 12  # pieces of a combination
TRIES = 16  # combinations that are begun with each length
STEPS = 120
ROUNDS = 8


def combinations(hist: np.ndarray, size: int, seed: int = 0) -> np.ndarray:
    """Shallow combinations that fill ``size`` exactly: a row each of up to DEPTH lengths, zeros after the last.

    TRIES of them begin with each length that there is.  They go on with lengths drawn as often as they
    occur among those that still fit, and end as soon as, by a toss, what is left is itself a length.
    Combinations that use a length more often than it occurs are left out.
    """
    lengths = np.flatnonzero(hist)
    out = np.zeros((len(lengths) * TRIES, DEPTH), np.int64)
    if not len(lengths):
        return out
    rng = np.random.default_rng(seed)
    below = np.cumsum(hist)  # pieces of at most a length
    out[:, 0] = np.repeat(lengths, TRIES)
    rest = size - out[:, 0]
    for k in range(1, DEPTH):
        live = np.flatnonzero(rest)
        left = np.minimum(rest[live], size - 1)
        ends = (hist[left] > 0) & (rest[live] == left) & (rng.random(len(live)) < 0.5)
        ends |= k == DEPTH - 1
        take = np.searchsorted(below, rng.random(len(live)) * below[left], "right")
        take = np.where(ends, rest[live], np.minimum(take, left))
        out[live, k] = take
        rest[live] -= take
    out = -np.sort(-out, axis=1)
    known = (out == 0) | ((out < size) & (hist[np.minimum(out, size - 1)] > 0))
    same = np.ones(len(out), np.int64)
    often = np.zeros(len(out), bool)  # a length more often than it occurs
    for k in range(1, DEPTH):
        same = np.where((out[:, k] == out[:, k - 1]) & (out[:, k] > 0), same + 1, 1)
        often |= same > np.where(out[:, k] > 0, hist[np.minimum(out[:, k], size - 1)], same)
    return np.unique(out[(out.sum(1) == size) & known.all(1) & ~often], axis=0)


def solve(patterns: np.ndarray, hist: np.ndarray) -> np.ndarray:
    """Repeat counts x >= 0 that minimise the squared difference between the pieces they use and ``hist``.

    By multiplicative steps, which stay non-negative and need no step size.
    """
    if not len(patterns):
        return np.zeros(0)
    used = patterns > 0
    owner, length = np.nonzero(used)[0], patterns[used]
    use = lambda x: np.bincount(length, x[owner], len(hist))
    back = lambda r: np.bincount(owner, r[length], len(patterns))
    x = np.full(len(patterns), (hist * np.arange(len(hist))).sum() / patterns[0].sum() / len(patterns))
    want = back(hist)
    for _ in range(STEPS):
        x *= want / np.maximum(back(use(x)), 1e-12)
    return x


class Layout:
    """Where the r-th remainder of each length goes: in windows that combinations fill, then in windows packed greedily."""

    def __init__(self, hist: np.ndarray, size: int = SIZE):
        self.size, self.sequences = size, 0
        self.left = hist.astype(np.int64).copy()  # pieces of each length that have no place yet
        self.given = np.zeros(size, np.int64)
        self.made = self.left.copy()  # all pieces of each length, those that cuts have made included
        self._slots: dict[int, list[tuple[int, int, int, int, int]]] = {}
        for seed in range(ROUNDS):  # what rounding leaves over is solved for again
            if self._fill(seed) < hist.sum() // 100 + 1:
                break
        self.solved = self.sequences  # windows that the least squares have planned
        self.cuts = self._pack()
        self.slots = {a: tuple(np.array(c, np.int64) for c in zip(*v, strict=True)) for a, v in self._slots.items()}

    def _give(self, length: int, times: int, sequence: int, at: int, take: int = 0) -> None:
        """The next ``times`` pieces of a length lie in as many windows; if only their first ``take`` ids do, the others are pieces of their own."""
        base = -1
        if take:
            base = int(self.made[length - take])
            self.made[length - take] += times
            self.left[length - take] += times
        self._slots.setdefault(length, []).append((times, sequence, at, take or length, base))
        self.left[length] -= times
        self.given[length] += times

    def _fill(self, seed: int) -> int:
        """Rounds the repeat counts of combinations, carrying fractions along, and uses no more pieces than there are; their number."""
        patterns = combinations(self.left, self.size, seed)
        x = solve(patterns, self.left.astype(float))
        order = np.argsort(-x, kind="stable")
        whole = np.diff(np.floor(np.cumsum(x[order]) + 0.5), prepend=0).astype(np.int64)
        before = int(self.left.sum())
        for row, want in zip(patterns[order[whole > 0]].tolist(), whole[whole > 0].tolist(), strict=True):
            parts = [p for p in row if p]
            n = min([want, *(int(self.left[p]) // parts.count(p) for p in set(parts))])
            if n > 0:
                at = 0
                for p in parts:
                    self._give(p, n, self.sequences, at)
                    at += p
                self.sequences += n
        return before - int(self.left.sum())

    def _pack(self) -> int:
        """Best fit: the longest piece that still fits, until none does; what a window then lacks is cut from the longest piece left."""
        cuts = 0
        mask = 0  # a bit for each length that there are pieces of
        for a in np.flatnonzero(self.left).tolist():
            mask |= 1 << a
        while mask:
            room, parts, own, open_ = self.size, [], {}, mask
            while room and (fit := open_ & ((2 << room) - 1)):
                a = fit.bit_length() - 1
                parts.append(a)
                own[a] = own.get(a, 0) + 1
                if own[a] == self.left[a]:
                    open_ &= ~(1 << a)
                room -= a
            n = min(int(self.left[a]) // k for a, k in own.items())
            donor = open_.bit_length() - 1 if room and open_ else 0  # whatever is left is longer than the room
            if donor:
                n = max(1, min(n, int(self.left[donor]) // (own.get(donor, 0) + 1)))
            elif room:
                n = 1
            at = 0
            for a in parts:
                self._give(a, n, self.sequences, at)
                at += a
            if donor:
                self._give(donor, n, self.sequences, at, room)
                mask |= 1 << (donor - room)
                cuts += n
            self.sequences += n
            for a in {*own, donor} - {0}:
                if self.left[a] == 0:
                    mask &= ~(1 << a)
        return cuts

    def place(self, length: int, ranks: np.ndarray) -> tuple[np.ndarray, ...]:
        """Pieces (which of ``ranks``, start, length, sequence, offset) of remainders of one length."""
        n, first, at, take, base = self.slots[length]
        ends = np.cumsum(n)
        k = np.searchsorted(ends, ranks, "right")
        inside = ranks - (ends[k] - n[k])
        out = [(np.arange(len(ranks)), np.zeros(len(ranks), np.int64), take[k], first[k] + inside, at[k])]
        for t in np.unique(take[k][take[k] < length]).tolist():
            mine = np.flatnonzero(take[k] == t)
            which, start, size, seq, off = self.place(length - t, base[k[mine]] + inside[mine])
            out.append((mine[which], start + t, size, seq, off))
        return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def tokenize(docs: DataFrame, tokenizer: str, end_id: int, size: int, text: str, doc_id: str) -> DataFrame:
    """(doc_id, part, n, rank, before, ids) of each document: ids of its whole text and the end id.

    Part is the task that made them; rank counts the earlier documents of the task whose full windows
    leave as many ids over, and before counts the full windows of all its earlier documents.
    """

    def encode(batches):
        from pyspark import TaskContext

        part_id, seen, full = TaskContext.get().partitionId(), np.zeros(size, np.int64), 0
        for batch in batches:
            for i, j in slices(batch, "t"):
                part = batch.slice(i, j - i)
                if not part.num_rows:
                    continue
                ids, at = encoder(tokenizer).encode(part.column("t"))
                ids = np.insert(ids, at[1:], end_id).astype("<u4")
                at = at + np.arange(len(at))
                small = ids.astype("<u2") if end_id < 1 << 16 and (not len(ids) or ids.max() < 1 << 16) else ids
                wide, count = small.itemsize, part.num_rows
                data = pa.LargeBinaryArray.from_buffers(pa.large_binary(), count, [None, pa.py_buffer(at * wide), pa.py_buffer(small)])
                n = np.diff(at)
                rem = n % size
                order = np.argsort(rem, kind="stable")
                first = np.searchsorted(rem[order], rem[order])
                rank = np.empty(count, np.int64)
                rank[order] = np.arange(count) - first
                rank += seen[rem]
                seen += np.bincount(rem, minlength=size)
                before = full + np.cumsum(n // size) - n // size
                full += int((n // size).sum())
                yield pa.RecordBatch.from_pydict({"doc_id": part.column("d"), "part": pa.array([part_id] * count, pa.int32()), "n": n, "rank": rank, "before": before, "ids": data.cast(pa.binary())})

    rows = docs.select(F.col(doc_id).cast("long").alias("d"), F.col(text).alias("t"))
    return storage.cut(rows.mapInArrow(encode, "doc_id long, part int, n long, rank long, before long, ids binary"), "packed-ids")


def _bases(tokens: DataFrame, size: int) -> tuple[np.ndarray, str]:
    """Number of documents by what their full windows leave over; and a table (part, rems, bases): how many of each come in earlier parts.

    Entry ``size`` of rems stands for full windows.  A part has ``size`` + 1 numbers at most.
    """
    slim = tokens.select("part", (F.col("n") % size).alias("rem"), F.floor(F.col("n") / size).alias("full"))
    counts = storage.cut(slim.groupBy("part", "rem").agg(F.count("*").alias("c"), F.sum("full").alias("full")), "packed-counts")
    hist = np.zeros(size, np.int64)
    for r in counts.groupBy("rem").agg(F.sum("c").alias("c")).collect():  # size rows at most
        hist[r.rem] = r.c
    hist[0] = 0
    every = counts.select("part", "rem", "c").unionByName(counts.groupBy("part").agg(F.lit(size).cast("long").alias("rem"), F.sum("full").alias("c")))
    before = Window.partitionBy("rem").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = every.withColumn("base", F.coalesce(F.sum("c").over(before), F.lit(0)))
    lists = base.groupBy("part").agg(F.array_sort(F.collect_list(F.struct("rem", "base"))).alias("x")).select("part", F.col("x.rem").alias("rems"), F.col("x.base").alias("bases"))
    uri = storage.fresh(tokens.sparkSession, "packed-base")
    lists.repartitionByRange("part").sortWithinPartitions("part").write.parquet(uri)
    return hist, uri


def _base(uri: str, part: int, size: int) -> np.ndarray:
    row = storage.read_table(uri, "part", part)
    out = np.zeros(size + 1, np.int64)
    out[row.column("rems")[0].values.to_numpy()] = row.column("bases")[0].values.to_numpy()
    return out


def pack(docs: DataFrame, tokenizer: str, end_id: int, size: int = SIZE, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Pieces (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids) of all documents in sequences of ``size`` tokens at most.

    A document's full windows are sequences of their own.  What remains of it has one of ``size`` - 1
    lengths.  Least squares over the histogram of these lengths (that many numbers, whatever the input)
    choose how often combinations of lengths fill a window exactly; the pieces that rounding leaves are
    packed best fit, and a window that stays short takes the start of one more piece, whose rest is a
    piece again.  So at most one sequence has padding.  Each remainder takes the place that its rank
    among its equals gives it.

    Null and empty texts are one piece of the end id; repeated rows are packed each, and so are rows
    with a null id; an empty table gives no pieces; columns other than the two named are not read.
    Ranks come from counts of each task's rows and a numbering inside the task, which are read where the
    ids lie, so ids are not shuffled and no length, however frequent, has to be in one place.
    """
    with storage.temporary() as made:
        tokens = tokenize(docs, tokenizer, end_id, size, text, doc_id)
        hist, bases = _bases(tokens, size)
        made.keep("packed-ids", "packed-base")
    layout = Layout(hist, size)
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids array<int>"
    names = [x.split()[0] for x in schema.split(", ")]

    def cut_pieces(batches):
        base_of: dict[int, np.ndarray] = {}
        for batch in batches:
            part, n, rank, before = (batch.column(c).to_numpy() for c in ("part", "n", "rank", "before"))
            full, rem = n // size, n % size
            full_at, place = np.empty(len(n), np.int64), np.empty(len(n), np.int64)
            for p in np.unique(part).tolist():
                if p not in base_of:
                    base_of = {p: _base(bases, p, size)}
                mine = part == p
                full_at[mine] = layout.sequences + base_of[p][size] + before[mine]
                place[mine] = base_of[p][rem[mine]] + rank[mine]
            doc = np.repeat(np.arange(len(n)), full)
            nth = np.arange(len(doc)) - np.repeat(np.cumsum(full) - full, full)
            found = [(doc, nth * size, np.full(len(doc), size), full_at[doc] + nth, np.zeros(len(doc), np.int64))]
            for a in np.unique(rem[rem > 0]).tolist():
                mine = np.flatnonzero(rem == a)
                which, start, length, seq, off = layout.place(a, place[mine])
                found.append((mine[which], full[mine[which]] * size + start, length, seq, off))
            doc, start, length, seq, off = (np.concatenate(c) for c in zip(*found, strict=True))
            order = np.lexsort((start, doc))
            doc, start, length, seq, off = (c[order] for c in (doc, start, length, seq, off))
            raw, edges = batch.column("ids"), np.searchsorted(doc, np.arange(len(n) + 1))
            at = 0
            while at < len(n):  # some documents at a time
                to = at + max(1, int(np.searchsorted(np.cumsum(n[at:]), 1 << 20, "right")))
                crc, flat = [], []
                for i in range(at, min(to, len(n))):
                    data = raw[i].as_py()
                    ids = np.frombuffer(data, f"<u{len(data) // int(n[i])}").astype("<u4")
                    flat.append(ids)
                    crc += [zlib.crc32(ids[s : s + k].tobytes()) for s, k in zip(start[edges[i] : edges[i + 1]].tolist(), length[edges[i] : edges[i + 1]].tolist(), strict=True)]
                some = slice(edges[at], edges[min(to, len(n))])
                ends = np.concatenate([[0], np.cumsum(length[some])]).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(flat).view(np.int32)))
                columns = [batch.column("doc_id").take(pa.array(doc[some])), start[some], length[some], np.array(crc, np.int64), n[doc[some]], seq[some], off[some], ids]
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, pa.int64()) for c in columns], names=names)
                at = to

    return tokens.mapInArrow(cut_pieces, schema)
