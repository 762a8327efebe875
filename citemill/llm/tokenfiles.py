"""Token files: one compressed frame per document, a shared dictionary, an index of offsets.

Layout of a shard, all numbers little-endian::

    magic | length of header, unsigned 32-bit | header, JSON
    frames: each document's ids, 2 or 4 bytes each, compressed alone with the dictionary
    index: frame offsets (count + 1 unsigned 64-bit), sizes in ids (count unsigned 32-bit), document ids (count signed 64-bit), a bit each for null ids
    offset of the index and count, unsigned 64-bit | magic

The header names the dictionary by its SHA-256; the dictionary lies beside the shards.  Any
document can be read with one small read of its frame, once the index is known.
"""

from __future__ import annotations

import hashlib
import json
import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citemill.llm import storage
from citemill.llm.bytescan import slices
from citemill.llm.tokens import encoder

MAGIC = b"CMTK0002"
DICT_BYTES = 1 << 16
DICT_SAMPLE = 400  # documents that the dictionary is fitted on


def width(vocabulary: int) -> int:
    return 2 if vocabulary <= 1 << 16 else 4


class ShardWriter:
    def __init__(self, uri: str, id_bytes: int, dictionary: bytes, level: int = 3):
        import zstandard as zstd

        self.out, self.id_bytes = storage.open_write(uri), id_bytes
        data = zstd.ZstdCompressionDict(dictionary) if dictionary else None
        self.pack = zstd.ZstdCompressor(level=level, dict_data=data, write_checksum=True, write_content_size=True)
        head = json.dumps({"id_bytes": id_bytes, "dictionary": hashlib.sha256(dictionary).hexdigest()}).encode()
        self._put(MAGIC + struct.pack("<I", len(head)) + head, 0)
        self.offsets, self.sizes, self.docs = [self.at], [], []

    def _put(self, data: bytes, at: int | None = None) -> None:
        self.at = (self.at if at is None else at) + len(data)
        self.out.write(data)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self._put(self.pack.compress(ids.astype(f"<u{self.id_bytes}").tobytes()))
        self.offsets.append(self.at)
        self.sizes.append(len(ids))
        self.docs.append(doc_id)

    def close(self) -> None:
        at = self.at
        none = np.array([d is None for d in self.docs], bool)
        for values, kind in ((self.offsets, "<u8"), (self.sizes, "<u4"), ([d or 0 for d in self.docs], "<i8")):
            self._put(np.array(values, kind).tobytes())
        self._put(np.packbits(none).tobytes() + struct.pack("<QQ", at, len(self.docs)) + MAGIC)
        self.out.close()


class ShardReader:
    """Documents of a shard by position; ``find`` gives the positions of a document id."""

    def __init__(self, uri: str):
        import zstandard as zstd

        self.file = storage.open_read(uri)
        end = self.file.size()
        self.file.seek(max(0, end - 24))
        at, n, magic = struct.unpack("<QQ8s", self.file.read(24).rjust(24))
        self.file.seek(0)
        if magic != MAGIC or self.file.read(8) != MAGIC:
            raise ValueError(f"{uri} is no token shard")
        head = json.loads(self.file.read(struct.unpack("<I", self.file.read(4))[0]))
        self.id_bytes = head["id_bytes"]
        self.file.seek(at)
        index = self.file.read(end - 24 - at)
        self.count = n
        self.offsets = np.frombuffer(index, "<u8", n + 1)
        self.sizes = np.frombuffer(index, "<u4", n, 8 * (n + 1))
        self.docs = np.frombuffer(index, "<i8", n, 8 * (n + 1) + 4 * n)
        self.none = np.unpackbits(np.frombuffer(index, np.uint8, -1, 20 * n + 8), count=n).astype(bool)
        data = storage.read_bytes(f"{uri.rsplit('/', 1)[0]}/{head['dictionary']}.dict")
        if hashlib.sha256(data).hexdigest() != head["dictionary"]:
            raise ValueError(f"{uri}: the dictionary is another one")
        self.unpack = zstd.ZstdDecompressor(dict_data=zstd.ZstdCompressionDict(data) if data else None)

    def find(self, doc_id: int | None) -> list[int]:
        return np.flatnonzero(self.none if doc_id is None else (self.docs == doc_id) & ~self.none).tolist()

    def read(self, i: int) -> np.ndarray:
        self.file.seek(int(self.offsets[i]))
        raw = self.unpack.decompress(self.file.read(int(self.offsets[i + 1] - self.offsets[i])))
        return np.frombuffer(raw, f"<u{self.id_bytes}")

    def batches(self, most: int = 4 << 20):
        """(position, ids) of all documents in order, by large reads."""
        i = 0
        while i < self.count:
            j = max(i + 1, int(np.searchsorted(self.offsets, self.offsets[i] + np.uint64(most), "right")) - 1)
            self.file.seek(int(self.offsets[i]))
            block, base = self.file.read(int(self.offsets[j] - self.offsets[i])), int(self.offsets[i])
            for k in range(i, j):
                raw = self.unpack.decompress(block[int(self.offsets[k]) - base : int(self.offsets[k + 1]) - base])
                yield k, np.frombuffer(raw, f"<u{self.id_bytes}")
            i = j


def _train(docs: DataFrame, tokenizer: str, end_id: int, id_bytes: int, text: str, doc_id: str) -> bytes:
    """A dictionary fitted on DICT_SAMPLE documents, those whose ids hash lowest; empty where they are too few."""
    picked = docs.select(F.xxhash64(doc_id).alias("h"), F.col(doc_id).alias("d")).orderBy("h", "d").limit(DICT_SAMPLE).agg(F.max("h")).first()[0]
    if picked is None:
        return b""
    sample = docs.where(F.xxhash64(doc_id) <= picked).select(F.col(text).alias("t")).limit(4 * DICT_SAMPLE)  # one id may be on very many rows

    def fit(batches):
        import zstandard as zstd

        samples = []
        for batch in batches:
            ids, at = encoder(tokenizer).encode(batch.column("t"))
            for i in range(batch.num_rows):
                samples.append(np.append(ids[at[i] : at[i + 1]], end_id).astype(f"<u{id_bytes}").tobytes())
        try:
            data = zstd.train_dictionary(DICT_BYTES, samples, threads=0).as_bytes() if len(samples) >= 8 else b""
        except zstd.ZstdError:  # too little to learn from
            data = b""
        yield pa.RecordBatch.from_pydict({"d": pa.array([data], pa.binary())})

    rows = sample.mapInArrow(fit, "d binary").collect()
    return bytes(rows[0].d) if rows else b""


def write_token_files(docs: DataFrame, tokenizer: str, end_id: int, text: str = "text", doc_id: str = "doc_id") -> tuple[str, list[tuple[str, int, int]]]:
    """Writes ``docs`` in ascending order of their ids; the folder and, in order, each shard's (uri, documents, ids).

    Every document is its whole text's ids and ``end_id``; null and empty texts have ``end_id`` alone.
    Rows are range-partitioned, so one task writes one shard of neighbours, streaming, and only the
    list of shards comes to the driver; the rows of one id may be dealt to several tasks.  Repeated rows
    are repeated documents; null ids come first; an empty table has no shards; other columns are not read.
    """
    spark = docs.sparkSession
    id_bytes = width(max(end_id + 1, encoder(tokenizer).lib.get_vocab_size()))
    folder = storage.fresh(spark, "tokens")
    docs = docs.select(F.col(doc_id).cast("long").alias("d"), F.col(text).alias("t"))
    dictionary = _train(docs, tokenizer, end_id, id_bytes, "t", "d")
    storage.write_bytes(f"{folder}/{hashlib.sha256(dictionary).hexdigest()}.dict", dictionary)

    def write(batches):
        from pyspark import TaskContext

        uri, writer, total = f"{folder}/shard-{uuid.uuid4().hex}.tok", None, 0
        for batch in batches:
            for i, j in slices(batch, "t"):
                part = batch.slice(i, j - i)
                if part.num_rows and writer is None:
                    writer = ShardWriter(uri, id_bytes, dictionary)
                ids, at = encoder(tokenizer).encode(part.column("t"))
                total += len(ids) + part.num_rows
                for k, d in enumerate(part.column("d").to_pylist()):
                    writer.add(d, np.append(ids[at[k] : at[k + 1]], np.uint32(end_id)))
        if writer is not None:
            writer.close()
            yield pa.RecordBatch.from_pydict({"p": [TaskContext.get().partitionId()], "uri": [uri], "n": [len(writer.docs)], "ids": [total]})

    docs = docs.withColumn("p", F.spark_partition_id())
    shards = docs.repartitionByRange("d", "p").sortWithinPartitions("d", "p").select("d", "t").mapInArrow(write, "p long, uri string, n long, ids long").collect()
    return folder, [(x.uri, x.n, x.ids) for x in sorted(shards, key=lambda x: x.p)]


def read_token_files(spark, shards: list[tuple[str, int, int]]) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, shard, position) of each document, from the files."""
    starts = np.cumsum([0, *(x[2] for x in shards)]).tolist()
    rows = [(uri, starts[i]) for i, (uri, _, _) in enumerate(shards)]
    listed = spark.createDataFrame(rows, "uri string, start long").repartition(max(1, len(rows)))

    def read(batches):
        for batch in batches:
            for uri, start in zip(batch.column("uri").to_pylist(), batch.column("start").to_pylist(), strict=True):
                shard = ShardReader(uri)
                crc = np.zeros(shard.count, np.int64)
                for k, ids in shard.batches():
                    crc[k] = zlib.crc32(ids.astype("<u4").tobytes())
                sizes = shard.sizes.astype(np.int64)
                docs = pa.array(shard.docs, mask=shard.none)
                out = {"doc_id": docs, "start": start + np.cumsum(sizes) - sizes, "n_tokens": sizes, "ids_crc32": crc, "shard": [uri.rsplit("/", 1)[1]] * shard.count, "position": np.arange(shard.count)}
                yield pa.RecordBatch.from_pydict(out)

    return listed.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long, shard string, position long")
