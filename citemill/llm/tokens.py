"""Ids of whole texts by a file of the tokenizers library, with its work shared between equal pieces.

A byte-pair model never merges across pre-tokens, so the ids of a text are those of
its pieces end to end, whenever pieces end only where pre-tokens end whatever follows.
``Encoder`` finds such pieces with array operations, asks the library once for each
different piece and looks the rest up.  Texts with bytes that this rule does not cover
(white space or letters outside Latin script, marks, special tokens' strings) go to the
library whole, and so does everything for a file of another kind than the two known.
"""

from __future__ import annotations

import json
import os

import numpy as np
import pyarrow as pa

from citemill.llm.bytescan import Table, hash_runs, spread, strings

_W, _L, _N, _P, _ODD = range(5)
_CLASS = np.full(256, _P, np.uint8)
_CLASS[[32, *range(9, 14)]] = _W
_CLASS[48:58] = _N
_CLASS[65:91] = _CLASS[97:123] = _L
_CLASS[0x80:0xC0] = _CLASS[0xC3:0xC6] = _L  # U+00C0 to U+017F, less three that _odd finds
_CLASS[0xC0:0xC3] = _CLASS[0xC6:] = _ODD
_CLASS[28:32] = _ODD  # white space to some libraries only
MOST_BYTES = 4 << 20  # of a text that is worked on at a time
_PLAIN = (_CLASS == _N) | (_CLASS == _L) & (np.arange(256) < 128)
MOST_PIECES = 1 << 20  # then the table starts anew, so that its memory stays bounded


def _alphabet() -> dict[int, str]:
    """The printable character that byte-level models have for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


def _cut(buf: np.ndarray, start: int, end: int) -> int:
    """End of a part of about MOST_BYTES from ``start``: before a space between ASCII letters or digits, where pieces end whatever is around; ``end`` where there is none."""
    size = MOST_BYTES
    while start + size < end:
        window = buf[start : start + size + 1]
        good = np.flatnonzero((window[1:-1] == 32) & _PLAIN[window[:-2]] & _PLAIN[window[2:]]) + 1
        if len(good):
            return start + int(good[-1])
        size *= 2
    return end


class Encoder:
    """``encode(column)``: flat ids (unsigned 32-bit) and each text's offsets; null is the empty text."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        before, norm = spec.get("pre_tokenizer") or {}, spec.get("normalizer")
        steps = [x.get("type") for x in (norm or {}).get("normalizers", [])]
        self.kind = None
        if spec["model"]["type"] == "BPE" and not spec["model"].get("dropout"):
            if norm is None and before.get("type") == "ByteLevel" and before.get("use_regex") and not before.get("add_prefix_space"):
                self.kind = "spaced"
            elif steps == ["NFC", "Replace", "Lowercase"] and [x["type"] for x in before.get("pretokenizers", [])] == ["Split", "ByteLevel"]:
                self.kind = "words"
        self.special = [x["content"].encode() for x in spec.get("added_tokens", [])]
        self.chars = _alphabet()
        self._clear()

    def _clear(self) -> None:
        self.table, self.used = Table(16), 0
        self.ids, self.at, self.size = np.zeros(1 << 16, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(x.ids, np.uint32) for x in self.lib.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Texts of more than MOST_BYTES are worked on in parts, so besides the texts and their ids memory is that of a part."""
        buf, offsets = strings(column)
        if self.kind is None or int(np.diff(offsets).max(initial=0)) <= MOST_BYTES:
            return self._encode(buf, offsets)
        parts, sizes = [], np.zeros(len(offsets) - 1, np.int64)
        for i, (start, end) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
            while start < end:
                to = _cut(buf, start, end)
                parts.append(self._encode(np.concatenate([buf[start:to], np.zeros(8, np.uint8)]), np.array([0, to - start]))[0])
                sizes[i] += len(parts[-1])
                start = to
        return np.concatenate(parts), np.concatenate([[0], np.cumsum(sizes)])

    def _encode(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        count = len(offsets) - 1
        odd = np.ones(count, bool) if self.kind is None else self._odd(buf, offsets)
        if self.table.n > MOST_PIECES:
            self._clear()
        if odd.all():
            quick, sizes = np.zeros(0, np.uint32), np.zeros(count, np.int64)
        else:
            quick, sizes = self._quick(buf, offsets, odd)
        if odd.any():
            rows = np.flatnonzero(odd)
            whole = self._whole([buf[offsets[i] : offsets[i + 1]].tobytes().decode() for i in rows])
            starts = np.cumsum(sizes) - sizes
            parts, done = [], 0
            for i, ids in zip(rows, whole, strict=True):  # _quick gives these texts no ids
                parts += [quick[done : starts[i]], ids]
                done = starts[i]
                sizes[i] = len(ids)
            quick = np.concatenate([*parts, quick[done:]])
        return quick, np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)

    def _odd(self, buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Texts that the rule for pieces does not cover."""
        n = int(offsets[-1])
        bad = _CLASS[buf[:n]] == _ODD
        sign = np.flatnonzero(buf[:n] == 0xC3)
        sign = sign[(buf[sign + 1] == 0x97) | (buf[sign + 1] == 0xB7)]
        bad[sign] = True
        sign = np.flatnonzero(buf[:n] == 0xC4)
        bad[sign[buf[sign + 1] == 0xB0]] = True  # its lower case has a mark
        data = buf[:n].tobytes()
        for mark in self.special:
            i = data.find(mark)
            while i >= 0:
                bad[i] = True
                i = data.find(mark, i + 1)
        return np.diff(np.searchsorted(np.flatnonzero(bad), offsets)) > 0

    def _quick(self, buf: np.ndarray, offsets: np.ndarray, odd: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = int(offsets[-1])
        if n == 0:
            return np.zeros(0, np.uint32), np.zeros(len(offsets) - 1, np.int64)
        kind, byte = _CLASS[buf[:n]], buf[:n]
        start = np.ones(n, bool)
        start[1:] = kind[1:] != kind[:-1]
        heads = offsets[:-1][np.diff(offsets) > 0]
        joined = np.ones(n, bool)  # False at a text's first byte
        joined[heads] = False
        apostrophe = np.flatnonzero((byte[:-1] == 39) & (kind[1:] == _L) & joined[1:]) + 1
        start[apostrophe] = False  # a contraction, perhaps: the library splits this piece
        if self.kind == "spaced":
            after = np.flatnonzero((kind[:-1] == _W) & (kind[1:] != _W) & joined[1:]) + 1
            start[after - 1] = True
            start[after[byte[after - 1] == 32]] = False
        else:
            start |= kind == _N
        start[heads] = True
        starts = np.flatnonzero(start)
        lens = np.diff(np.append(starts, n))
        keep = ~np.repeat(odd, np.diff(np.searchsorted(starts, offsets)))
        if self.kind == "words":
            keep &= kind[starts] != _W
        starts, lens = starts[keep], lens[keep]
        h = hash_runs(buf, starts, lens)
        index = self.table.find(h)
        missing = np.flatnonzero(index < 0)
        if missing.size:
            new, first = np.unique(h[missing], return_index=True)
            self._learn(buf, kind, starts[missing[first]], lens[missing[first]], new)
            index[missing] = self.table.find(h[missing])
        sizes = self.size[index]
        ids = self.ids[spread(self.at[index], sizes)]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        return ids, np.diff(ends[np.searchsorted(starts, offsets)])

    def _learn(self, buf, kind, starts, lens, hashes) -> None:
        found: list[list[int]] = []
        others: list[tuple[int, str]] = []
        model, table = self.lib.model, self.chars
        lower = self.kind == "words"
        for s, k in zip(starts.tolist(), lens.tolist(), strict=True):
            raw = buf[s : s + k].tobytes()
            if kind[s + k - 1] == _L and kind[s + (k > 1 and raw[0] == 32)] == _L and 39 not in raw and not (lower and not raw.isascii()):
                text = (raw.lower() if lower else raw).decode("latin-1").translate(table)
                found.append([t.id for t in model.tokenize(text)])
            else:
                others.append((len(found), raw.decode()))
                found.append([])
        if others:
            for (i, _), ids in zip(others, self._whole([x for _, x in others]), strict=True):
                found[i] = ids.tolist()
        sizes = np.array([len(x) for x in found], np.int64)
        flat = np.array([y for x in found for y in x], np.uint32)
        while self.used + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(len(self.ids), np.uint32)])
        self.ids[self.used : self.used + len(flat)] = flat
        self.table.insert(hashes)
        self.at = np.concatenate([self.at, self.used + np.cumsum(sizes) - sizes])
        self.size = np.concatenate([self.size, sizes])
        self.used += len(flat)


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """This process's encoder of a file; workers keep it from task to task."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
