"""WARC archives: revisit records for repeated payloads, and reading by chains of record boundaries."""

from __future__ import annotations

import bisect
import hashlib
import re
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citemill.llm import storage
from citemill.llm.bytescan import spark_hash

LEAST_BYTES = 1000
BLOCK_BYTES = 4 << 20
MOST_BITS = 27  # of the bitmap: a power of two
MAGIC = re.compile(rb"WARC/1\.[01]\r\n")
HEADER_BYTES = 16 << 20  # no header is longer: the writer refuses to make one, the reader doesn't look further
DATE = "2024-01-01T00:00:00Z"
_LENGTH = re.compile(rb"(?i)content-length[ \t]*:[ \t]*(\d{1,18})[ \t]*\Z")
_ID = re.compile(r"<urn:page:(-?\d+|none)>")


def _again(slim: DataFrame) -> DataFrame:
    """(_p, _digest, _bytes, _refers) of the pages that repeat another one's payload; only digests meet, pre-aggregated."""
    groups = slim.groupBy("_digest", "_bytes").agg(F.max("_p").alias("_refers"), F.count("*").alias("n")).where("n > 1 AND _refers IS NOT NULL").drop("n")
    return storage.cut(slim.join(groups, ["_digest", "_bytes"]).where("NOT (_p <=> _refers)").distinct(), "warc-again")


def _bitmap(again: DataFrame) -> np.ndarray:
    """A bit for each hash of a page id in ``again``: eight bits a page, MOST_BITS at most, whatever the input."""
    bits = 1 << min(MOST_BITS, max(15, (8 * again.count()).bit_length()))
    at = F.pmod(F.xxhash64("_p"), F.lit(bits)) + 1
    out = np.zeros(bits // 8, np.uint8)
    for r in again.groupBy(F.bitmap_bucket_number(at).alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("b")).collect():
        out[(r.k - 1) * 4096 : r.k * 4096] = np.frombuffer(r.b, np.uint8)
    return out


def _marked(ids: pa.Array, bitmap: np.ndarray) -> np.ndarray:
    """Rows whose page id is perhaps in the bitmap; null ids are."""
    at = spark_hash(ids.fill_null(0).to_numpy().view(np.uint64)) % (8 * len(bitmap))
    return (bitmap[at >> 3] >> (at & 7).astype(np.uint8)) & 1 | ids.is_null().to_numpy(zero_copy_only=False)


def _record(page: int | None, url: str | None, payload: bytes, refers: int | None) -> bytes:
    size, digest = len(payload), hashlib.sha1(payload).hexdigest()
    name = lambda p: f"<urn:page:{'none' if p is None else p}>"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    head = [f"WARC-Type: {'response' if refers is None else 'revisit'}", f"WARC-Record-ID: {name(page)}", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    head.append(f"WARC-Payload-Digest: sha1:{digest}")
    if refers is not None:
        head += [f"WARC-Refers-To: {name(refers)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
        payload = b""
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(http) + len(payload)}"]
    lines = "\r\n".join(head).encode()
    if len(lines) > HEADER_BYTES - 64:
        raise ValueError(f"the header of page {page} has more than {HEADER_BYTES} bytes")
    return b"WARC/1.1\r\n" + lines + b"\r\n\r\n" + http + payload + b"\r\n\r\n"


def write_warc(pages: DataFrame, page_id: str = "page_id", url: str = "url", payload: str = "html", least_bytes: int = LEAST_BYTES) -> tuple[str, list[str]]:
    """Writes one record per row to archives in the shared folder: the folder and the archives' names.

    Of equal payloads of ``least_bytes`` or more, the one with the largest page id is a response and
    the others refer to it; repeated rows of that page are responses each.  A null payload is empty.

    Pages that repeat no payload are written where they are read: a bitmap of a bounded size, of the
    hashes of the others' ids, tells them apart.  The others, and those that share a bit with one, move
    once, compressed, to meet what they refer to.  Payloads of any length are written whole; repeated
    rows have records with one id, rows without an id records named none; other columns are not read.  An
    address that makes a header of more than HEADER_BYTES is an error.  The bitmap has 2 ** MOST_BITS bits at most, so with
    far more than 16 million repeated pages nearly all pages share a bit with one and move.
    """
    folder = storage.fresh(pages.sparkSession, "warc")
    rows = pages.select(F.col(page_id).cast("long").alias("p"), F.col(url).alias("u"), F.col(payload).alias("t"))
    body = F.coalesce(F.col("t"), F.lit("")).cast("binary")
    with storage.temporary():
        large = rows.where(F.octet_length(body) >= least_bytes).select(F.col("p").alias("_p"), F.sha1(body).alias("_digest"), F.octet_length(body).cast("long").alias("_bytes"))
        again = _again(storage.cut(large, "warc-digests"))
        bitmap = _bitmap(again)

        def put(records):
            name, out = f"{uuid.uuid4().hex}.warc", None
            for record in records:
                out = out or storage.open_write(f"{folder}/{name}")
                out.write(_record(*record))
            if out:
                out.close()
                yield pa.RecordBatch.from_pydict({"file": [name]})

        def write_first(batches):
            def records():
                for batch in batches:
                    for i in np.flatnonzero(_marked(batch.column("p"), bitmap) == 0).tolist():
                        p, u, t = (batch.column(c)[i].as_py() for c in ("p", "u", "t"))
                        yield p, u, (t or "").encode(), None

            yield from put(records())

        def squeeze(batches):
            import zstandard

            pack = zstandard.ZstdCompressor(level=3)
            for batch in batches:
                some = batch.filter(pa.array(_marked(batch.column("p"), bitmap) != 0))
                if some.num_rows:
                    bodies = [(t.as_py() or "").encode() for t in some.column("t")]
                    digests, sizes = [hashlib.sha1(x).hexdigest() for x in bodies], [len(x) for x in bodies]
                    packed = pa.array([pack.compress(x) for x in bodies], pa.binary())
                    yield pa.RecordBatch.from_arrays([some.column("p"), some.column("u"), pa.array(digests), pa.array(sizes, pa.int64()), packed], names=["p", "u", "d", "b", "packed"])

        def write_rest(batches):
            import zstandard

            unpack = zstandard.ZstdDecompressor()

            def records():
                for batch in batches:
                    cols = [batch.column(c) for c in ("p", "u", "packed", "_refers")]
                    for i in range(batch.num_rows):
                        p, u, packed, refers = (c[i].as_py() for c in cols)
                        yield p, u, unpack.decompress(packed), refers

            yield from put(records())

        some = rows.mapInArrow(squeeze, "p long, u string, d string, b long, packed binary")
        match = F.col("p").eqNullSafe(F.col("_p")) & (F.col("d") == F.col("_digest")) & (F.col("b") == F.col("_bytes"))
        rest = some.join(again, match, "left").mapInArrow(write_rest, "file string")
        return folder, sorted(r.file for r in rows.mapInArrow(write_first, "file string").unionByName(rest).collect())


def _header(data: bytes, at: int) -> tuple[dict[str, str], int, int] | None:
    """Fields, end of the header and length of the block of a record that would start at ``at``; None if none can."""
    end = data.find(b"\r\n\r\n", at)
    if end < 0:
        return None
    fields: dict[str, str] = {}
    for line in data[at:end].split(b"\r\n")[1:]:
        key, colon, value = line.partition(b":")
        if not colon:
            return None
        fields[key.decode("utf-8", "replace").strip().lower()] = value.decode("utf-8", "replace").strip()
    size = fields.get("content-length", "")
    return (fields, end + 4, int(size)) if re.fullmatch(r"\d{1,18}", size) else None


def _more(f, at: int, want: int, size: int) -> bytes:
    f.seek(at)
    return f.read(min(want, size - at))


def _possible(data: bytes, most: int) -> tuple[list[tuple[int, int]], bool]:
    """(start, length of the whole record) of places before ``most`` where a record might start; whether more data could show others.

    Lines are told apart once, so the time is linear in ``data`` however many magics it has: from each line on,
    the next one that is empty or has no colon says whether a header may go on to there.
    """
    raw = np.frombuffer(data, np.uint8)
    starts = [m.start() for m in MAGIC.finditer(data, 0, min(len(data), most + 10)) if m.start() < most]
    if not starts:
        return [], False
    ends = np.flatnonzero((raw[:-1] == 13) & (raw[1:] == 10))
    firsts = np.concatenate([[0], ends[:-1] + 2])
    empty = firsts == ends
    colons = np.flatnonzero(raw == 58)
    stops = empty | (np.searchsorted(colons, firsts) == np.searchsorted(colons, ends))
    n = len(ends)
    stop = np.append(np.minimum.accumulate(np.where(stops, np.arange(n), n)[::-1])[::-1], n)
    named = np.flatnonzero((ends - firsts > 15) & ((raw[firsts] | 32) == 99))  # lines that begin with a c
    named = [k for k in named.tolist() if data[firsts[k] : firsts[k] + 14].lower() == b"content-length"]
    found, more = [], False
    for at in starts:
        line = int(np.searchsorted(ends, at + 8)) + 1
        to = int(stop[line])
        if to == n:
            more = True
            continue
        last = bisect.bisect_left(named, to) - 1
        if not empty[to] or last < 0 or named[last] < line or ends[to] - at > HEADER_BYTES:
            continue
        size = _LENGTH.match(data, int(firsts[named[last]]), int(ends[named[last]]))
        if size:
            found.append((at, int(ends[to]) + 2 - at + int(size[1]) + 4))
    return found, more


def candidate_links(spark: SparkSession, folder: str, files: list[str], block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(file, size, at, exit): each place where a record might start, and where the chain from there leaves its block.

    Payloads may hold the magic too; nothing is decided here.  Each task reads a block, and more, up to
    HEADER_BYTES, for a header that crosses its end, and follows successors inside the block.
    """
    listed = spark.createDataFrame([(x,) for x in files], "file string")

    def sizes(batches):
        for batch in batches:
            for name in batch.column("file").to_pylist():
                with storage.open_read(f"{folder}/{name}") as f:
                    n = f.size()
                starts = list(range(0, n, block_bytes))
                yield pa.RecordBatch.from_pydict({"file": [name] * len(starts), "size": [n] * len(starts), "begin": starts})

    blocks = listed.repartition(max(1, len(files))).mapInArrow(sizes, "file string, size long, begin long")

    def scan(batches):
        for batch in batches:
            for name, size, begin in zip(*(batch.column(c).to_pylist() for c in ("file", "size", "begin")), strict=True):
                with storage.open_read(f"{folder}/{name}") as f:
                    extra = 1 << 16
                    while True:
                        data = _more(f, begin, block_bytes + extra, size)
                        found, more = _possible(data, block_bytes)
                        if not more or begin + len(data) >= size or extra >= HEADER_BYTES:
                            break
                        extra *= 4
                succ = {begin + at: begin + at + length for at, length in found if begin + at + length <= size}
                exits: dict[int, int] = {}
                for at in sorted(succ, reverse=True):
                    exits[at] = exits.get(succ[at], succ[at])
                yield pa.RecordBatch.from_pydict({"file": [name] * len(exits), "size": [size] * len(exits), "at": list(exits), "exit": list(exits.values())}, schema=_LINKS)

    return blocks.repartition("file", "begin").mapInArrow(scan, "file string, size long, at long, exit long")


_LINKS = pa.schema([("file", pa.string()), ("size", pa.int64()), ("at", pa.int64()), ("exit", pa.int64())])


def reachable(links: DataFrame, count: int) -> DataFrame:
    """(file, at) where the chain from a file's start enters a block: pointer jumping, so the number of joins grows with the logarithm of the blocks in a file.

    ``count`` is the number of files; one that doesn't begin with a record, or whose chain ends
    before the file does, is an error.
    """
    links = storage.cut(links, "warc-links")
    if links.where("at = 0").count() < count:
        raise ValueError("an archive doesn't begin with a record")
    # only places where a chain can come in from another block take part from here on: one or a few a block
    entries = links.select("file", F.col("exit").alias("at")).distinct()
    jumps = links.join(entries, ["file", "at"], "left_semi").unionByName(links.where("at = 0")).distinct()
    jumps = storage.cut(jumps, "warc-jumps")
    reach, known = jumps.where("at = 0").select("file", "at", "size"), -1
    reach = storage.cut(reach, "warc-reach")
    while (n := reach.count()) > known:
        known = n
        step = reach.join(jumps.select("file", "at", "exit"), ["file", "at"]).select("file", F.col("exit").alias("at"), "size")
        reach = storage.cut(reach.unionByName(step).distinct(), "warc-reach")
        far = jumps.select("file", F.col("at").alias("exit"), F.col("exit").alias("further"))
        jumps = storage.cut(jumps.join(far, ["file", "exit"], "left").select("file", "size", "at", F.coalesce("further", "exit").alias("exit")), "warc-jumps")
    files = reach.groupBy("file").agg(F.max("at").alias("at"), F.first("size").alias("size"))
    if bad := [r.file for r in files.where("at <> size").limit(5).collect()]:
        raise ValueError(f"chains of records break off in {bad}")
    return reach.where("at < size").select("file", "at", "size")


def read_warc(spark: SparkSession, folder: str, files: list[str], block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(page_id, url, record_type, refers_to, payload_bytes, payload_digest, payload, file, at) of each record.

    Only records that the chain from the start of their file reaches are kept, so a payload that
    looks like a record stays a payload.  Digests are those of the bytes read, or the recorded
    ones for revisits, whose payload is null.  A digest that doesn't hold, and a chain that
    breaks off, raise an error.  No files give an empty table.
    """
    schema = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary, file string, at long"
    if not files:
        return spark.createDataFrame([], schema)
    with storage.temporary() as made:
        entries = storage.cut(reachable(candidate_links(spark, folder, files, block_bytes), len(files)), "warc-entries")
        made.keep("warc-entries")

    def number(text: str) -> int | None:
        m = _ID.fullmatch(text)
        return int(m[1]) if m and m[1] != "none" else None

    def read(batches):
        for batch in batches:
            for name, at, size in zip(*(batch.column(c).to_pylist() for c in ("file", "at", "size")), strict=True):
                rows: list[tuple] = []
                stop, held = (at // block_bytes + 1) * block_bytes, 0
                with storage.open_read(f"{folder}/{name}") as f:
                    base, data = at, _more(f, at, stop - at, size)
                    while at < min(stop, size):
                        got = _header(data, at - base)
                        if got is None or base + got[1] + got[2] + 4 > base + len(data):
                            want = (1 << 16) if got is None else got[1] - (at - base) + got[2] + 4
                            base, data = at, _more(f, at, max(want, 2 * len(data) if got is None and base == at else want), size)
                            continue
                        fields, body, length = got
                        block = data[body : body + length]
                        if data[body + length : body + length + 4] != b"\r\n\r\n":
                            raise ValueError(f"{name} at {at}: no end of record")
                        http, _, payload = block.partition(b"\r\n\r\n")
                        kind, digest = fields.get("warc-type"), fields.get("warc-payload-digest", "").removeprefix("sha1:")
                        if kind == "response":
                            if hashlib.sha1(payload).hexdigest() != digest:
                                raise ValueError(f"{name} at {at}: the payload is another one")
                            count = len(payload)
                        else:
                            count, payload = int(re.search(rb"(?i)\ncontent-length: *(\d+)", http)[1]), None
                        rows.append((number(fields.get("warc-record-id", "")), fields.get("warc-target-uri"), kind, number(fields.get("warc-refers-to", "")), count, digest, payload, name, at))
                        held += length
                        at = base + body + length + 4
                        if held > 4 << 20:
                            yield _rows(rows)
                            rows, held = [], 0
                yield _rows(rows)

    return entries.repartition("file", "at").mapInArrow(read, schema)


_RECORD = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary()), ("file", pa.string()), ("at", pa.int64())])


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in _RECORD]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _RECORD, strict=True)], schema=_RECORD)
