"""A positional inverted index for whole-word search, as Parquet sorted by term.

Texts are indexed in segments of about a million words.  A row has one term's postings in one segment: which
texts hold it and where, as packed differences from the least text number.  The table is
range-sorted by term with small row groups, so that a search reads the pages of its own terms only.  Words of a
query meet by segment, the rarest first; segments that lack it are never unpacked.  What the index proposes
is verified on the text, so results are those of a scan.
"""

from __future__ import annotations

from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citemill.operators.batches import parts as in_parts
from citemill.operators.search import blob, matches, parts
from citemill.shared import remove, scratch

_ROW = "term string, segment long, texts int, first long, ids binary, counts binary, positions binary"
ROW_GROUP, SEGMENT = 1 << 20, 1_000_000  # bytes of a row group, words of a segment


def tokens_of(c: Column) -> Column:
    """All words as they stand, in order, also repeated ones."""
    return F.regexp_extract_all(c, F.lit(r"(?U)(\w+)"), F.lit(1))


def folded(word: str) -> str:
    """The form that two words share whenever a search that ignores case takes them for the same, letter by letter."""
    return word.lower() if word.isascii() else "".join(map(_letter, word))


@lru_cache(1 << 16)
def _letter(c: str) -> str:
    upper = c.upper()
    return (upper if len(upper) == 1 else c).lower()[0]


def pack(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers from 0 up, seven bits a byte, the lowest first, the high bit clear at the end of each; and where each ends."""
    values = values.astype(np.uint64)
    size = np.ones(len(values), np.int64)
    for k in range(1, 10):
        size += (values >> np.uint64(7 * k)) > 0
    ends = np.cumsum(size)
    at = ends - size
    out = np.zeros(int(size.sum()), np.uint8)
    for k in range(int(size.max(initial=0))):
        has = np.flatnonzero(size > k)
        byte = (values[has] >> np.uint64(7 * k)) & np.uint64(127)
        out[at[has] + k] = byte.astype(np.uint8) | np.where(size[has] > k + 1, 128, 0).astype(np.uint8)
    return out, ends


def unpack(data: np.ndarray) -> np.ndarray:
    """The numbers of :func:`pack`."""
    ends = np.flatnonzero(data < 128)
    starts = np.concatenate([[0], ends[:-1] + 1]) if len(ends) else ends
    out = np.zeros(len(ends), np.uint64)
    for k in range(int((ends - starts).max(initial=-1)) + 1):
        has = np.flatnonzero(ends - starts >= k)
        out[has] |= (data[starts[has] + k] & np.uint8(127)).astype(np.uint64) << np.uint64(7 * k)
    return out.astype(np.int64)


def _packed_column(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """A binary value for each stretch of ``values`` between two bounds."""
    data, ends = pack(values)
    offsets = np.concatenate([[0], ends])[bounds].astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(data)])


def _unpacked_column(column: pa.Array) -> np.ndarray:
    return unpack(np.frombuffer(b"".join(column.to_pylist()), np.uint8))


def _differences(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Steps from each value to the next; where ``first`` is true, the value itself."""
    out = values.copy()
    out[1:][~first[1:]] -= values[:-1][~first[1:]]
    return out


def _sums(steps: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Running sums that start anew in each stretch of the given sizes, none of them empty."""
    total, ends = np.cumsum(steps), np.cumsum(sizes)
    return total - np.repeat(np.concatenate([[0], total])[ends - sizes], sizes)


def _postings(batches):
    part = TaskContext.get().partitionId()
    for number, batch in enumerate(in_parts(batches, "_tokens", SEGMENT)):
        tokens = batch.column("_tokens")
        offsets = tokens.offsets.to_numpy()
        words = tokens.values.slice(offsets[0], offsets[-1] - offsets[0]).dictionary_encode()
        keys = batch.column("_key").to_numpy(zero_copy_only=False)
        order = np.argsort(keys, kind="stable")
        rank = np.empty(len(keys), np.int64)
        rank[order] = np.arange(len(keys))
        sizes = np.diff(offsets)
        row = np.repeat(np.arange(len(sizes)), sizes)
        position = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        names = pa.array([folded(w) for w in words.dictionary.to_pylist()], pa.string()).dictionary_encode()
        code = names.indices.to_numpy(zero_copy_only=False)[words.indices.to_numpy(zero_copy_only=False)].astype(np.int64)
        at = np.lexsort((position, rank[row], code))
        code, text, position = code[at], rank[row][at], position[at]
        if not len(code):
            continue
        new_pair = np.concatenate([[True], (code[1:] != code[:-1]) | (text[1:] != text[:-1])])
        pair = np.flatnonzero(new_pair)
        new_term = np.concatenate([[True], code[pair][1:] != code[pair][:-1]])
        term = np.append(np.flatnonzero(new_term), len(pair))
        ids, spots = keys[order][text[pair]], np.append(pair, len(code))
        steps = _differences(ids, new_term)
        steps[new_term] = 0  # the first one is a column of its own
        columns = {
            "term": names.dictionary.take(pa.array(code[pair[term[:-1]]])),
            "segment": pa.array(np.full(len(term) - 1, (part << 24) + number)),
            "texts": pa.array(np.diff(term).astype(np.int32)),
            "first": pa.array(ids[term[:-1]]),
            "ids": _packed_column(steps, term),
            "counts": _packed_column(np.diff(spots), term),
            "positions": _packed_column(_differences(position, new_pair), spots[term]),
        }
        yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


def build_index(rows: DataFrame, key: str, columns: list[str], path: str) -> None:
    """Writes the index of ``rows`` (a long ``key``, the same in no two rows; texts in ``columns``) to ``path``.

    Missing texts are empty; a text without words is in no posting.  Rows without a key are left out.
    """
    words = rows.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("_key"), tokens_of(blob(columns)).alias("_tokens"))
    loose = scratch(rows.sparkSession, "postings")  # read twice: to find the ranges, and to sort
    words.mapInArrow(_postings, _ROW).write.option("compression", "zstd").parquet(loose)
    index, sort = rows.sparkSession.read.schema(_ROW).parquet(loose), ["term", "segment"]
    index.repartitionByRange(*sort).sortWithinPartitions(*sort).write.options(**{"compression": "zstd", "parquet.block.size": ROW_GROUP}).parquet(path)
    remove(loose)


def _runs(part: str, spark) -> list[str]:
    """The words of a token or phrase, as the index has them."""
    return [folded(w) for w in spark.createDataFrame([(part,)], "part string").select(tokens_of(F.col("part"))).first()[0]]


def _unpacked(batches):
    """(word, segment, text, places) of postings."""
    for batch in batches:
        if not batch.num_rows:
            continue
        word, segment, texts, first = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("word", "segment", "texts", "first"))
        ids = _sums(_unpacked_column(batch.column("ids")), texts) + np.repeat(first, texts)
        counts = _unpacked_column(batch.column("counts"))
        places = _sums(_unpacked_column(batch.column("positions")), counts)
        bounds = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(bounds), pa.array(places.astype(np.int32)))
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(word, texts)), pa.array(np.repeat(segment, texts)), pa.array(ids), lists], names=["word", "segment", "text", "places"])


def _moved(places: Column, by: int) -> Column:
    return F.transform(places, lambda p: p - by)


def candidates(spark, path: str, query: str) -> DataFrame | None:
    """(text): the keys of texts with all words of the query, and its phrases' words one after the other; null where the query has no word."""
    wanted = [r for r in (_runs(p, spark) for p in parts(query)) if r]
    words = sorted({w for run in wanted for w in run})
    if not words:
        return None
    index = spark.read.parquet(path).where(F.col("term").isin(words))
    number = F.array_position(F.array(*map(F.lit, words)), F.col("term")).cast("int")
    postings = index.select(number.alias("word"), "segment", "texts", "first", "ids", "counts", "positions")
    # one number a word: which is the rarest decides what is unpacked of the others
    sizes = {r.word: r.n for r in postings.groupBy("word").agg(F.sum("texts").alias("n")).collect()}
    if len(sizes) < len(words):
        return spark.createDataFrame([], "text long")
    rarest = min(sizes, key=sizes.get)
    segments = postings.where(F.col("word") == rarest).select("segment").distinct()
    rows = postings.join(segments, "segment", "left_semi").select("word", "segment", "texts", "first", "ids", "counts", "positions")
    found = rows.mapInArrow(_unpacked, "word int, segment long, text long, places array<int>")
    each = found.groupBy("segment", "text").agg(F.map_from_entries(F.collect_list(F.struct("word", "places"))).alias("m")).where(F.size("m") == len(words))
    follows = []
    for run in wanted:
        at = [words.index(w) + 1 for w in run]
        if len(run) > 1:  # a place from which each further word is as many places away
            heads = [_moved(F.col("m")[w], i) for i, w in enumerate(at)]
            follows.append(F.size(reduce(F.array_intersect, heads)) > 0)
    return each.where(reduce(lambda a, b: a & b, follows, F.lit(True))).select("text")


def search(rows: DataFrame, key: str, columns: list[str], path: str, query: str) -> DataFrame:
    """The rows that a scan with ``matches`` finds, by way of the index at ``path``; a query without words is scanned."""
    near = candidates(rows.sparkSession, path, query)
    if near is not None:
        rows = rows.join(near.withColumnRenamed("text", key), key, "left_semi")
    return rows.where(matches(blob(columns), query))
