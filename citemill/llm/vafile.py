"""Exact top-k inner products with vector-approximation files."""

from __future__ import annotations

import io
import struct
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citemill.llm import storage

CELLS = 256  # a dimension's values are known to one of this many cells in the approximation, one byte
FILE_ROWS, QUERY_BLOCK = 1 << 13, 1024
STEP = 128  # queries whose bounds are held at once
NEAR = 32  # exact vectors that lie no more rows apart are read together
MOST_TASKS = 20_000
EXACT = 2.0**53  # sums of products below are exact in double precision
LONG = (1 << 63) - 1
HUGE = 1 << 500  # beyond it, sums may leave the doubles; such vectors are not bounded but all read


def _scaled(batch: pa.RecordBatch) -> list[tuple[np.ndarray, np.ndarray]]:
    """(ids, whole-number vectors) of the usable rows, by number of components; doubles, or Python integers where those are not exact."""
    vectors = batch.column("v")
    sizes = np.where(np.asarray(vectors.is_null()), -1, np.asarray(vectors.value_lengths().fill_null(-1)))
    values = vectors.flatten().cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False)
    ends = np.cumsum(np.maximum(sizes, 0))
    ids = batch.column("id")
    known = ~np.asarray(ids.is_null())
    ids = ids.fill_null(0).to_numpy()
    out = []
    for d in np.unique(sizes[sizes > 0]).tolist():
        rows = np.flatnonzero((sizes == d) & known)
        x = values[(ends[rows] - d)[:, None] + np.arange(d)]
        fine = np.isfinite(x).all(1)
        x, rows = x[fine], rows[fine]
        small = (np.abs(x) < 2.0**22).all(1)
        out += [(ids[rows[small]], np.floor(256.0 * x[small]))] if small.any() else []
        if not small.all():  # 256 * x is whole wherever |x| is large, and may be beyond the doubles
            whole = [[int(np.floor(256.0 * v)) if abs(v) < 2.0**44 else int(v) * 256 for v in row] for row in x[~small].tolist()]
            out.append((ids[rows[~small]], np.array(whole, object).reshape(-1, d)))
    return out


def _near(x: np.ndarray) -> np.ndarray:
    """``x`` in doubles, rounded where it holds Python integers."""
    if x.dtype != object:
        return x.astype(float)
    return np.array([[float(max(min(v, HUGE), -HUGE)) for v in row] for row in x.tolist()]).reshape(x.shape)


def _huge(x: np.ndarray | None) -> bool:
    return x is not None and x.dtype == object and any(abs(v) > HUGE for v in x.ravel())


def _sortable(v: int) -> bytes:
    """Bytes whose order is that of whole numbers: their length, then the digits, complemented below zero."""
    size = (abs(v).bit_length() + 7) // 8
    digits = abs(v).to_bytes(size, "big")
    return (0x8000 + size).to_bytes(2, "big") + digits if v >= 0 else (0x8000 - size).to_bytes(2, "big") + bytes(255 - b for b in digits)


def _kind(x: np.ndarray) -> str:
    """The smallest type of whole numbers that holds ``x``; O for Python integers."""
    if x.dtype == object:
        return "O"
    most = float(np.abs(x).max()) if x.size else 0.0
    return "<i2" if most < 2**15 else "<i4" if most < 2**31 else "<i8"


def _pack(ids: np.ndarray, x: np.ndarray) -> dict:
    kind = _kind(x)
    return {"ids": ids, "x": np.array([[str(v) for v in row] for row in x.tolist()]) if kind == "O" else x.astype(kind)}


def _unpack(x: np.ndarray) -> np.ndarray:
    return np.array([[int(v) for v in row] for row in x.tolist()], object).reshape(x.shape) if x.dtype.kind == "U" else x


def write_file(uri: str, ids: np.ndarray, x: np.ndarray) -> None:
    """A file of vectors: its head, the ids, the cells (one byte a component), then the exact vectors, row after row.

    Rows lie in the order of their ids.  Python integers are kept as text, in the head.
    """
    order = np.argsort(ids, kind="stable")
    ids, x = ids[order], x[order]
    kind = _kind(x)
    near = _near(x)
    low = near.min(0)
    width = np.maximum(np.ceil((near.max(0) - low + 1) / CELLS), 1)
    cells = np.minimum((near - low) // width, CELLS - 1).astype(np.uint8)
    head = io.BytesIO()
    np.savez(head, low=low, width=width, rows=len(ids), kind=kind, big=np.array([[str(v) for v in row] for row in x.tolist()]) if kind == "O" else np.zeros(0))
    with storage.open_write(uri) as f:
        f.write(struct.pack("<Q", head.tell()) + head.getvalue())
        f.write(ids.astype("<i8").tobytes())
        f.write(cells.tobytes())
        if kind != "O":
            f.write(x.astype(kind).tobytes())


class VaFile:
    """A file of vectors: ids and cells in memory, exact vectors on demand."""

    def __init__(self, uri: str):
        self.file = storage.open_read(uri)
        size = struct.unpack("<Q", self.file.read(8))[0]
        head = np.load(io.BytesIO(self.file.read(size)))
        self.low, self.width, n, self.kind = head["low"], head["width"], int(head["rows"]), str(head["kind"])
        self.d = len(self.low)
        self.ids = np.frombuffer(self.file.read(8 * n), "<i8")
        self.cells = np.frombuffer(self.file.read(n * self.d), np.uint8).reshape(n, self.d)
        self.at = 8 + size + n * (8 + self.d)
        self.big = _unpack(head["big"]) if self.kind == "O" else None
        self.middle = (self.cells * self.width + (self.low + (self.width - 1) / 2)).T
        self.read = 0
        self.first = np.append(True, self.ids[1:] != self.ids[:-1])  # of the rows with one id

    def exact(self, rows: np.ndarray) -> np.ndarray:
        """The vectors of some rows, which are in order; neighbours are read together."""
        self.read += len(rows)
        if self.big is not None:
            return self.big[rows]
        wide = self.d * np.dtype(self.kind).itemsize
        out = np.empty((len(rows), self.d), self.kind)
        breaks = np.flatnonzero(np.diff(rows) > NEAR) + 1
        for a, b in zip([0, *breaks.tolist()], [*breaks.tolist(), len(rows)], strict=True):
            i, j = int(rows[a]), int(rows[b - 1]) + 1
            self.file.seek(self.at + i * wide)
            out[a:b] = np.frombuffer(self.file.read((j - i) * wide), self.kind).reshape(-1, self.d)[rows[a:b] - i]
        return out

    def bounds(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Middle of what each row's score can be, by the cells alone, and how far from it the score can lie, a number a query.

        A cell's middle stands for all its values, so one matrix product bounds all scores; what the
        product's rounding can add is in the distance too.
        """
        with np.errstate(over="ignore", invalid="ignore"):
            score = queries @ self.middle
            size = np.abs(queries) @ np.maximum(np.abs(self.low), np.abs(self.low + CELLS * self.width))
            far = np.abs(queries) @ ((self.width - 1) / 2) + size * (self.d + 4) * 2.0**-50
        return score, far

    def search(self, queries: np.ndarray, own: np.ndarray, k: int) -> list[tuple[int, int, int]]:
        """(query number, candidate id, score) of each query's ``k`` best ids, ties to the smaller one."""
        score, far = self.bounds(_near(queries))
        if _huge(queries) or _huge(self.big):
            score[:], far[:] = 0, np.inf
        a, b = np.searchsorted(self.ids, own, "left"), np.searchsorted(self.ids, own, "right")
        for q in np.flatnonzero(b > a).tolist():
            score[q, a[q] : b[q]] = -np.inf
        waiting: list[np.ndarray] = []
        for q in range(len(queries)):
            firsts = score[q, self.first]
            n = min(k, int(np.isfinite(firsts).sum()))
            if not n:
                waiting.append(np.zeros(0, np.int64))
                continue
            kth = np.partition(firsts, len(firsts) - n)[len(firsts) - n] - far[q]
            maybe = np.flatnonzero(np.isfinite(score[q]) & (score[q] + far[q] >= kth))
            waiting.append(maybe[np.argsort(-score[q, maybe], kind="stable")])
        best: list[list[tuple[int, int]]] = [[] for _ in waiting]
        at, open_ = 0, [q for q, rows in enumerate(waiting) if len(rows)]
        while open_:  # the next rows of all open queries, in order of their bounds, until no bound can reach the kth best
            some = {q: waiting[q][at : at + 4 * k] for q in open_}
            rows = np.unique(np.concatenate(list(some.values())))
            exact = self.exact(rows)
            for q, mine in some.items():
                values = products(exact[np.searchsorted(rows, mine)], queries[q])
                top = dict(best[q])
                for i, v in zip(self.ids[mine].tolist(), values, strict=True):
                    top[i] = max(v, top.get(i, v))
                best[q] = sorted(top.items(), key=lambda x: (-x[1], x[0]))[:k]
            at += 4 * k
            open_ = [q for q in open_ if at < len(waiting[q]) and (len(best[q]) < k or float(score[q, waiting[q][at]] + far[q]) >= best[q][-1][1])]
        return [(q, i, v) for q, found in enumerate(best) for i, v in found]


def products(x: np.ndarray, q: np.ndarray) -> list[int]:
    """Exact inner products with ``q`` as Python integers."""
    if x.dtype != object and q.dtype != object:
        most = float(np.abs(x).max()) * float(np.abs(q).max()) * x.shape[1] if x.size else 0.0
        if most < EXACT:
            return (x.astype(float) @ q.astype(float)).astype(np.int64).tolist()
    return [sum(int(a) * int(b) for a, b in zip(row, q.tolist(), strict=True)) for row in x.tolist()]


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` candidates of the largest inner product for each query row.

    Components are floor(256 * x).  Candidates are all rows but those with the query's own id.
    Vectors that are null, empty or hold null or non-finite components take no part, nor do rows
    with a null id; vectors meet only vectors of the same length.  Ties go to the smaller id.
    Several rows with one id are one query or candidate, which has the best score of its vectors.
    Scores are exact whatever their size, and ranked so; one beyond 64 bits is given as the nearest long.
    An empty table gives no rows; other columns are not read.

    Candidates are written as files of FILE_ROWS vectors, cells apart from exact vectors, and queries
    as blocks, to the shared folder.  A task takes one file and one block: it bounds all scores from
    the cells and then reads the exact vectors of those that can still be among the best.  So neither
    side has to fit on one machine, and a lost executor costs single pairs of file and block.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(vec_id).cast("long").alias("id"), F.col(embedding).alias("v"), is_query.alias("q"))

    def blocks(df: DataFrame, folder: str, most: int, put) -> DataFrame:
        """(uri, d) of files of at most ``most`` vectors of one kind and length, as they come."""

        def write(batches):
            held: dict[tuple, list] = {}

            def flush(key):
                ids, x = (np.concatenate(c) for c in zip(*held.pop(key), strict=True))
                for i in range(0, len(ids), most):
                    uri = f"{folder}/{uuid.uuid4().hex}"
                    put(uri, ids[i : i + most], x[i : i + most])
                    yield pa.RecordBatch.from_pydict({"uri": [uri], "d": pa.array([key[0]], pa.int64())})

            for batch in batches:
                for ids, x in _scaled(batch):
                    key = (x.shape[1], x.dtype == object)
                    held.setdefault(key, []).append((ids, x))
                    if sum(len(a) for a, _ in held[key]) >= most:
                        yield from flush(key)
            for key in list(held):
                yield from flush(key)

        return df.mapInArrow(write, "uri string, d long")

    def put_queries(uri: str, ids: np.ndarray, x: np.ndarray) -> None:
        out = io.BytesIO()
        np.savez(out, **_pack(ids, x))
        storage.write_bytes(uri, out.getvalue())

    with storage.temporary() as made:
        counts = rows.agg(F.count("*").alias("n"), F.count_if("q").alias("q")).first()
        queries = rows.where("q").select("id", "v").dropDuplicates().repartition(max(1, -(-counts.q // QUERY_BLOCK)))
        few = 16 + 4 * -(-counts.n // FILE_ROWS)  # tasks of few rows would write small files
        rows = rows.coalesce(few) if rows.rdd.getNumPartitions() > few else rows
        asked = storage.cut(blocks(queries, storage.fresh(spark, "va-queries"), QUERY_BLOCK, put_queries), "va-asked")
        files = storage.cut(blocks(rows.select("id", "v"), storage.fresh(spark, "va-files"), FILE_ROWS, write_file), "va-listed")
        jobs = storage.cut(files.join(asked.withColumnRenamed("uri", "asked"), "d").select("uri", "asked"), "va-jobs")
        jobs = jobs.repartition(max(1, min(jobs.count(), MOST_TASKS)), "uri", "asked")

        def search(batches):
            for batch in batches:
                for uri, block in zip(batch.column("uri").to_pylist(), batch.column("asked").to_pylist(), strict=True):
                    file, found = VaFile(uri), np.load(io.BytesIO(storage.read_bytes(block)))
                    own, queries = found["ids"], _unpack(found["x"])
                    for i in range(0, len(own), STEP):
                        best = file.search(queries[i : i + STEP], own[i : i + STEP], k)
                        columns = [own[i : i + STEP][[q for q, _, _ in best]], [c for _, c, _ in best], [max(min(v, LONG), -LONG - 1) for _, _, v in best]]
                        yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns), pa.array([_sortable(v) for _, _, v in best], pa.binary())], names=["query_id", "vec_id", "score", "order"])

        best = storage.cut(jobs.mapInArrow(search, "query_id long, vec_id long, score long, order binary"), "va-best")
        made.keep("va-best")
    best = best.groupBy("query_id", "vec_id").agg(F.max(F.struct("order", "score")).alias("s"))
    order = Window.partitionBy("query_id").orderBy(F.desc("s.order"), "vec_id")
    best = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return best.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", F.col("s.score").alias("score"))
