"""Document lengths of flat token files that have no index: a scan for the end-of-document id."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from citemill.llm import storage
from citemill.llm.bytescan import slices
from citemill.llm.tokens import encoder

BLOCK_BYTES = 4 << 20


def id_bytes(tokenizer: str, end_id: int) -> int:
    """Bytes of an id in flat files: 2 where all ids and the end fit, else 4."""
    return 2 if max(end_id + 1, encoder(tokenizer).lib.get_vocab_size()) <= 1 << 16 else 4


def write_flat(docs: DataFrame, tokenizer: str, end_id: int, text: str = "text", doc_id: str = "doc_id") -> tuple[str, DataFrame]:
    """Flat files of ids of id_bytes() each, each document followed by ``end_id``, and (file, ordinal, doc_id) of what lies in them.

    The ids of a text never hold ``end_id`` if that is an id the model can't produce, such as one
    beyond its vocabulary; one that it can produce raises an error, as no scan could tell it from an
    end.  (A special token's id is produced by texts that quote it.)  Nothing is shuffled.
    """
    spark = docs.sparkSession
    folder, kind = storage.fresh(spark, "flat"), f"<u{id_bytes(tokenizer, end_id)}"

    def write(batches):
        name, out, n = f"{uuid.uuid4().hex}.ids", None, 0
        for batch in batches:
            for i, j in slices(batch, "t"):
                part = batch.slice(i, j - i)
                if part.num_rows == 0:
                    continue
                ids, at = encoder(tokenizer).encode(part.column("t"))
                if (ids == end_id).any():
                    raise ValueError(f"a text has the end-of-document id {end_id}")
                out = out or storage.open_write(f"{folder}/{name}")
                out.write(np.insert(ids, at[1:], end_id).astype(kind).tobytes())
                yield pa.RecordBatch.from_pydict({"file": [name] * part.num_rows, "ordinal": np.arange(n, n + part.num_rows), "doc_id": part.column("d")})
                n += part.num_rows
        if out:
            out.close()

    rows = docs.select(F.col(doc_id).cast("long").alias("d"), F.col(text).alias("t"))
    return folder, storage.cut(rows.mapInArrow(write, "file string, ordinal long, doc_id long"), "flat-docs")


def count_tokens(spark: SparkSession, folder: str, files: DataFrame, end_id: int, block_bytes: int = BLOCK_BYTES, wide: int = 2) -> DataFrame:
    """(file, ordinal, n_tokens) of each document of flat files; n_tokens counts its end.

    ``files`` has a column file with their names; an id has ``wide`` bytes, and ``block_bytes`` is a multiple of that.  Blocks are scanned on their own: each yields
    its number of ends, the length of what follows its last one and the offsets of its ends.  A
    prefix scan over the blocks of a file (a few numbers each) then gives the ordinal of a block's
    first document and how much of it lies in earlier blocks.  Ids after the last end are a
    document without one and come as such, with its length.
    """

    def sizes(batches):
        for batch in batches:
            for name in batch.column("file").to_pylist():
                with storage.open_read(f"{folder}/{name}") as f:
                    n = f.size()
                if n == 0:
                    continue
                starts = np.arange(0, n, block_bytes)
                yield pa.RecordBatch.from_pydict({"file": [name] * len(starts), "block": np.arange(len(starts)), "at": starts, "last": starts + block_bytes >= n})

    blocks = files.select("file").distinct().mapInArrow(sizes, "file string, block long, at long, last boolean")
    blocks = storage.cut(blocks, "flat-blocks").repartition("file", "block")

    def scan(batches):
        for batch in batches:
            for name, block, at, last in zip(*(batch.column(c).to_pylist() for c in ("file", "block", "at", "last")), strict=True):
                with storage.open_read(f"{folder}/{name}") as f:
                    f.seek(at)
                    ids = np.frombuffer(f.read(block_bytes), f"<u{wide}")
                ends = np.flatnonzero(ids == end_id)
                tail = len(ids) - (int(ends[-1]) + 1 if len(ends) else 0)
                lens = np.diff(ends, prepend=-1)
                yield pa.RecordBatch.from_pydict({"file": [name], "block": [block], "last": [last], "n": [len(ends)], "tail": [tail], "lens": pa.array([lens.tolist()], pa.list_(pa.int64()))})

    found = storage.cut(blocks.mapInArrow(scan, "file string, block long, last boolean, n long, tail long, lens array<long>"), "flat-ends")
    by = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    scanned = found.select("file", "block", "n", "tail")
    scanned = scanned.withColumn("before", F.coalesce(F.sum("n").over(by), F.lit(0)))
    scanned = scanned.withColumn("since", F.max(F.when(F.col("n") > 0, F.col("block"))).over(by))
    carry = F.sum(F.when((F.col("n") == 0), F.col("tail")).otherwise(0)).over(by)
    whole = scanned.withColumn("run", carry)
    # tails of the last block with an end, and of all blocks without one since then
    ends = whole.select("file", F.col("block").alias("since"), F.col("tail").alias("last_tail"), F.col("run").alias("run_then"))
    whole = whole.join(ends, ["file", "since"], "left").select("file", "block", "before", (F.coalesce("run", F.lit(0)) - F.coalesce("run_then", F.lit(0)) + F.coalesce("last_tail", F.lit(0))).alias("carried"))
    joined = found.join(whole, ["file", "block"])
    # a document that its file ends without: what is carried into the last block, or lies in it
    rest = joined.where("last").select("file", (F.col("before") + F.col("n")).alias("ordinal"), F.when(F.col("n") > 0, F.col("tail")).otherwise(F.col("carried") + F.col("tail")).alias("n_tokens")).where("n_tokens > 0")
    docs = joined.select("file", "before", "carried", F.posexplode("lens").alias("k", "len"))
    docs = docs.select("file", (F.col("before") + F.col("k")).alias("ordinal"), (F.col("len") + F.when(F.col("k") == 0, F.col("carried")).otherwise(0)).alias("n_tokens"))
    return docs.unionByName(rest)


def token_counts(docs: DataFrame, tokenizer: str, end_id: int, text: str = "text", doc_id: str = "doc_id", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, n_tokens) of each document, its end included, from flat files written and scanned.

    Null and empty texts count 1; repeated rows are documents of their own, and so are rows with a null
    id; an empty table gives none; other columns are not read.  The files go once they are scanned.
    """
    with storage.temporary() as made:
        folder, listed = write_flat(docs, tokenizer, end_id, text, doc_id)
        counts = count_tokens(docs.sparkSession, folder, listed, end_id, block_bytes, id_bytes(tokenizer, end_id))
        made.keep("flat-docs", "flat-ends")
    return listed.join(counts, ["file", "ordinal"]).select("doc_id", "n_tokens")
