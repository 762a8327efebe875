"""Near-duplicate documents: b-bit MinHash signatures joined by chunks with errors, confirmed on whole shingle sets."""

from __future__ import annotations

import io
import uuid
from collections import OrderedDict

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citemill.llm import storage
from citemill.llm.bytescan import LOWER, SPACE, U64, hash_runs, mix, runs, slices, spread, strings
from citemill.llm.components import local_components

WORDS = 5
SHARE = 75  # percent
CHUNKS, SYMBOLS, BITS = 12, 7, 8  # a chunk is SYMBOLS minima of BITS bits each, one long
PLACES = CHUNKS * SYMBOLS
#: Signatures differ in at most so many of the 84 symbols: 21 are expected at a similarity of 0.75, with a deviation of 4.
MOST_DIFFERENCES = 38
NEAR = 8  # a row of a bucket meets so many rows before it, and the bucket's first one
GATHER = 4096  # signatures whose keys are sorted together before the shuffle
BLOCK_SHINGLES = 1 << 17  # of a block of shingle sets, with EXTRA more for each set
EXTRA = 512
BLOCKS_A_JOB = 64
MOST_TASKS = 20_000

_rng = np.random.default_rng(20240229)
_A = (_rng.integers(0, 1 << 32, PLACES, dtype=np.uint64) | U64(1)).astype(np.uint32)
_P = U64(0x9FB21C651E98DF25)


def shingle_sets(column: pa.Array) -> list[np.ndarray]:
    """The sorted distinct shingles of each text, as 64-bit hashes."""
    buf, offsets = strings(column)
    low = LOWER[buf]
    starts, lens, first = runs(~SPACE[buf], offsets)
    h = hash_runs(low, starts, lens)
    n = len(h) - WORDS + 1
    if n > 0:
        acc = h[:n].copy()
        for k in range(1, WORDS):
            acc = acc * _P + h[k : k + n]
        acc = mix(acc)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= WORDS:
            s = np.sort(acc[a : b - WORDS + 1])
            out.append(s[np.append(True, s[1:] != s[:-1])])
        elif b > a:
            one = np.array([b - a], U64)
            for x in h[a:b]:
                one = mix(one * _P + x)
            out.append(one)
        else:
            out.append(np.zeros(0, U64))
    return out


def signature(shingles: np.ndarray) -> np.ndarray:
    """CHUNKS longs of SYMBOLS bytes each; a byte is a hash of the shingle that is smallest in one of PLACES orders."""
    x = (shingles >> U64(32)).astype(np.uint32)
    low = np.full(PLACES, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), 1024):
        np.minimum(low, (_A[:, None] * x[None, i : i + 1024]).min(1), out=low)
    symbols = ((low * np.uint32(0x9E3779B1)) ^ (low >> np.uint32(15))) * np.uint32(0x85EBCA6B) >> np.uint32(24)
    shift = U64(8) * np.arange(SYMBOLS, dtype=U64)
    return (symbols.reshape(CHUNKS, SYMBOLS).astype(U64) << shift).sum(1, dtype=U64).view(np.int64)


SIG = [f"s{i}" for i in range(CHUNKS)]


def signatures(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    """(doc_id, n, f0, f1, s0 ..): number of shingles, a 128-bit fingerprint of the set, the signature."""

    def scan(batches):
        for batch in batches:
            for i, j in slices(batch, "t"):
                part = batch.slice(i, j - i)
                if not part.num_rows:
                    continue
                sets = shingle_sets(part.column("t"))
                prints = np.frombuffer(b"".join(xxhash.xxh3_128_digest(s.tobytes()) for s in sets), np.int64).reshape(-1, 2)
                sigs = np.stack([signature(s) for s in sets])
                cols = {"doc_id": part.column("d"), "n": [len(s) for s in sets], "f0": prints[:, 0], "f1": prints[:, 1]}
                yield pa.RecordBatch.from_pydict(cols | {c: sigs[:, k] for k, c in enumerate(SIG)})

    schema = "doc_id long, n long, f0 long, f1 long, " + ", ".join(f"{c} long" for c in SIG)
    return docs.select(F.col(doc_id).cast("long").alias("d"), F.col(text).alias("t")).mapInArrow(scan, schema)


def bucket_keys(sig: np.ndarray) -> np.ndarray:
    """PLACES keys of each signature (a row of CHUNKS longs): for each chunk, its symbols less any one of them.

    Two chunks with one error at most share one of these.
    """
    keys = np.empty((len(sig), PLACES), U64)
    for c in range(CHUNKS):
        for k in range(SYMBOLS):
            mask = U64(((1 << 8 * SYMBOLS) - 1) ^ (0xFF << 8 * k))
            keys[:, c * SYMBOLS + k] = mix((sig[:, c] & mask) + U64((c * SYMBOLS + k + 1) * 0x9E3779B97F4A7C15 % (1 << 64)))
    return keys


def differences(a: str, b: str) -> Column:
    """Number of differing symbols of two signatures: bytes of each long's exclusive or that aren't zero."""
    low = F.lit(int("7F" * SYMBOLS, 16))
    high = F.lit(int("80" * SYMBOLS, 16))
    total = F.lit(0)
    for c in SIG:
        x = F.col(f"{a}.{c}").bitwiseXOR(F.col(f"{b}.{c}"))
        total = total + F.bit_count(((x.bitwiseAND(low)) + low).bitwiseOR(x).bitwiseAND(high))
    return total


def _candidates(reps: DataFrame) -> DataFrame:
    """(a, b, null, null) pairs that meet in a bucket, and (rep, null, key, n) for rows of buckets with more than NEAR + 1 rows.

    Buckets stream by in the order of their keys.  The first NEAR + 1 rows of a bucket, which is the
    whole of most, all meet; later ones meet the first two.  So no bucket is held and the rows that
    come out are in proportion to those that go in; what a large bucket hides is left to _outside().
    The same is done before the shuffle with the keys of each GATHER rows: of one key, NEAR + 1 rows
    at most go on from there, so the largest bucket has few rows a task whatever it holds.
    """

    def deal(batches):
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(x.num_rows for x in held) >= GATHER:
                yield from settle(held)
                held = []
        yield from settle(held)

    def settle(held):
        table = pa.Table.from_batches(held) if held else None
        if table is None or not table.num_rows:
            return
        rep, n = table.column("rep").to_numpy(), table.column("n").to_numpy()
        keys = bucket_keys(np.stack([table.column(c).to_numpy().view(U64) for c in SIG], axis=1)).view(np.int64).ravel()
        row = np.repeat(np.arange(len(rep)), PLACES)
        order = np.argsort(keys, kind="stable")
        key, row = keys[order], row[order]
        fresh = np.append(True, key[1:] != key[:-1])
        begin = np.maximum.accumulate(np.where(fresh, np.arange(len(key)), 0))
        place = np.arange(len(key)) - begin
        on = place <= NEAR
        yield _dealt(key[on], key[on], rep[row[on]], n[row[on]])
        far = np.flatnonzero(~on)
        if len(far):
            large = np.zeros(len(key), bool)
            large[begin[far]] = True
            member = np.flatnonzero(large[begin])
            yield _dealt(rep[row[member]], key[member], rep[row[member]], n[row[member]], 1)
            heads = np.concatenate([row[begin[far]], row[begin[far] + 1]])
            pairs = np.unique(np.stack([heads, np.concatenate([row[far], row[far]])]), axis=1)
            x, y, nx, ny = rep[pairs[0]], rep[pairs[1]], n[pairs[0]], n[pairs[1]]
            fine = (x != y) & (100 * np.minimum(nx, ny) >= SHARE * np.maximum(nx, ny))
            x, y = x[fine], y[fine]
            yield _dealt(y, x, y, np.zeros(len(x), np.int64), 2)

    def stream(batches):
        carry = {c: np.zeros(0, np.int64) for c in ("key", "rep", "n")}
        lead = (0, 0, 0, 0, 0)  # the two first rows of the bucket that the last batch ended in, and the place of the first carried row
        for batch in batches:
            kind = batch.column("kind").to_numpy()
            if (kind > 0).any():  # what is settled passes by
                done = batch.filter(pa.array(kind > 0))
                key, rep, n, kind_ = (done.column(c).to_numpy() for c in ("key", "rep", "n", "kind"))
                pair = kind_ == 2
                yield pa.RecordBatch.from_arrays([pa.array(np.where(pair, np.minimum(key, rep), rep)), pa.array(np.maximum(key, rep), mask=~pair), pa.array(key, mask=pair), pa.array(n, mask=pair)], names=["a", "b", "key", "n"])
                batch = batch.filter(pa.array(kind == 0))
            if not batch.num_rows:
                continue
            old = len(carry["key"])
            col = {c: np.concatenate([carry[c], batch.column(c).to_numpy()]) for c in carry}
            key, rep, n = col["key"], col["rep"], col["n"]
            size = len(key)
            fresh = np.append(True, key[1:] != key[:-1])
            begin = np.maximum.accumulate(np.where(fresh, np.arange(size), 0))
            second = np.minimum(begin + 1, size - 1)
            heads = [rep[begin], n[begin], rep[second], n[second]]
            place = np.arange(size) - begin
            if old and lead[4]:
                going = begin == 0
                for k in range(4):
                    heads[k] = np.where(going, lead[k], heads[k])
                place = np.where(going, place + lead[4], place)
            at = np.arange(old, size)
            left, right = [], []
            for d in range(1, NEAR + 1):
                i = at[(place[at] >= d) & (place[at] <= NEAR)]
                left.append(np.stack([rep[i - d], n[i - d]]))
                right.append(np.stack([rep[i], n[i]]))
            far = at[place[at] > NEAR]
            for k in (0, 2):
                left.append(np.stack([heads[k][far], heads[k + 1][far]]))
                right.append(np.stack([rep[far], n[far]]))
            x, y = np.concatenate(left, axis=1), np.concatenate(right, axis=1)
            fine = (x[0] != y[0]) & (100 * np.minimum(x[1], y[1]) >= SHARE * np.maximum(x[1], y[1]))
            pairs = np.stack([np.minimum(x[0], y[0])[fine], np.maximum(x[0], y[0])[fine]])
            if pairs.shape[1]:
                pairs = np.unique(pairs, axis=1)
            member = np.zeros(size, bool)
            member[far] = True
            turn = at[place[at] == NEAR + 1]
            for d in range(1, NEAR + 2):
                member[turn - d] = True
            m = np.flatnonzero(member)
            none = pa.nulls(pairs.shape[1], pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1]), none, none], names=["a", "b", "key", "n"])
            if len(m):
                yield pa.RecordBatch.from_arrays([pa.array(rep[m]), pa.nulls(len(m), pa.int64()), pa.array(key[m]), pa.array(n[m])], names=["a", "b", "key", "n"])
            cut = max(0, size - NEAR - 1)
            lead = (*(int(h[cut]) for h in heads), int(place[cut]))
            carry = {c: col[c][cut:] for c in carry}

    dealt = reps.where("n > 0").select("rep", "n", *SIG).mapInArrow(deal, "to long, key long, rep long, n long, kind int")
    return dealt.repartition("to").sortWithinPartitions("kind", "key", "rep").mapInArrow(stream, "a long, b long, key long, n long")


def _dealt(to: np.ndarray, key: np.ndarray, rep: np.ndarray, n: np.ndarray, kind: int = 0) -> pa.RecordBatch:
    """Rows of kind 0 still have to meet others of their key; 1 are members of a large bucket, 2 are pairs (in key and rep)."""
    return pa.RecordBatch.from_pydict({"to": to, "key": key, "rep": rep, "n": n, "kind": np.full(len(key), kind, np.int32)})


def _texts(docs: DataFrame, pairs: DataFrame, text: str, doc_id: str) -> DataFrame:
    """(id, t) of the documents that ``pairs`` name. The texts are shuffled here once; later joins read what is left of them."""
    texts = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("t"))
    need = pairs.select(F.col("a").alias("id")).distinct().unionByName(pairs.select(F.col("b").alias("id")).distinct()).distinct()
    return storage.cut(texts.join(need.hint("merge"), "id", "left_semi"), "near-texts")


def confirm(pairs: DataFrame, texts: DataFrame, share: int = SHARE) -> DataFrame:
    """The (a, b) of ``pairs`` whose whole shingle sets overlap enough."""
    with_a = pairs.join(texts.select(F.col("id").alias("a"), F.col("t").alias("ta")).hint("merge"), "a")
    both = with_a.join(texts.select(F.col("id").alias("b"), F.col("t").alias("tb")).hint("merge"), "b").select("a", "b", "ta", "tb")

    def check(batches):
        held: OrderedDict[int, np.ndarray] = OrderedDict()
        for batch in batches:
            for i, j in slices(batch, "ta"):
                part = batch.slice(i, j - i)
                if not part.num_rows:
                    continue
                a, b = part.column("a").to_pylist(), part.column("b").to_pylist()
                new = [k for k in dict.fromkeys(range(len(a))) if a[k] not in held]
                new = list({a[k]: k for k in new}.values())
                for k, s in zip(new, shingle_sets(part.column("ta").take(pa.array(new, pa.int64()))) if new else [], strict=True):
                    held[a[k]] = s
                right = shingle_sets(part.column("tb"))
                ok = []
                for k in range(len(a)):
                    x, y = held[a[k]], right[k]
                    both_ = len(np.intersect1d(x, y, assume_unique=True))
                    ok.append(len(x) > 0 and 100 * both_ >= share * (len(x) + len(y) - both_))
                    held.move_to_end(a[k])
                total = sum(len(s) for s in held.values())
                while total > 1 << 21:
                    total -= len(held.popitem(last=False)[1])
                yield pa.RecordBatch.from_pydict({"a": pa.array([x for x, y in zip(a, ok, strict=True) if y], pa.int64()), "b": pa.array([x for x, y in zip(b, ok, strict=True) if y], pa.int64())})

    return both.mapInArrow(check, "a long, b long")


def _close(pairs: DataFrame, reps: DataFrame) -> DataFrame:
    """(a, b, d) of the pairs whose signatures differ in MOST_DIFFERENCES symbols at most."""
    sig = reps.select("rep", *SIG)
    out = pairs.join(sig.select(F.col("rep").alias("a"), F.struct(*SIG).alias("x")), "a").join(sig.select(F.col("rep").alias("b"), F.struct(*SIG).alias("y")), "b")
    return out.select("a", "b", differences("x", "y").alias("d")).where(F.col("d") <= MOST_DIFFERENCES)


def _grow(comp: DataFrame | None, links: DataFrame, name: str) -> DataFrame:
    """Components (node, component) after more links; a known component is a star of edges."""
    if comp is not None:
        links = links.unionByName(comp.where("node <> component").select(F.col("node").alias("a"), F.col("component").alias("b")))
    return local_components(links, name)


def _named(pairs: DataFrame, comp: DataFrame) -> DataFrame:
    """``pairs`` with ca and cb, the components of a and b."""
    out = pairs.join(comp.select(F.col("node").alias("a"), F.col("component").alias("ca")), "a", "left")
    out = out.join(comp.select(F.col("node").alias("b"), F.col("component").alias("cb")), "b", "left")
    return out.withColumns({"ca": F.coalesce("ca", "a"), "cb": F.coalesce("cb", "b")})


def _outside(members: DataFrame, comp: DataFrame) -> DataFrame:
    """(rep, main): rows of large buckets that aren't one component, and the component with most rows of their bucket, where it isn't their own."""
    rows = members.join(comp.select(F.col("node").alias("rep"), "component"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    tops = rows.groupBy("key", "component").agg(F.count("*").alias("c")).groupBy("key").agg(F.max(F.struct("c", "component")).alias("top"), F.count("*").alias("kinds"))
    rows = rows.join(tops.where("kinds > 1").select("key", F.col("top.component").alias("main")), "key")
    return storage.cut(rows.where("component <> main").select("rep", "main").distinct(), "near-outside")


def _with_component(rows: DataFrame, comp: DataFrame) -> DataFrame:
    return rows.join(comp.select(F.col("node").alias("rep"), "component"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))


def _open_groups(tried: DataFrame, others: DataFrame, comp: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both sides (rep, main, component) of the groups, named by main, where a row may still find another component."""
    tried, others = _with_component(tried, comp), _with_component(others, comp)
    kinds = tried.groupBy("main").agg(F.min("component").alias("low"), F.max("component").alias("high"))
    some = others.join(kinds, "main").where("NOT (component = low AND component = high)").select("rep", "main", "component")
    some = storage.cut(some, "near-others")
    return tried.join(some.select("main").distinct(), "main", "left_semi"), some


def _links(tried: DataFrame, others: DataFrame, texts: DataFrame) -> DataFrame:
    """(a, b): rows of ``tried`` and, for each, a near-duplicate of another component in each stretch of its group, if there is one.

    Each side is written as blocks of shingle sets.  A task holds one block of rows and reads
    BLOCKS_A_JOB blocks of the others one by one, counting the common shingles of a row with all sets
    of a block at once; a row leaves with its first link, so no more than a link a row comes out.
    """
    folder = storage.fresh(texts.sparkSession, "near-sets")

    def write(table: pa.Table) -> pa.Table:
        sets = shingle_sets(table.column("t"))
        out = io.BytesIO()
        np.savez(out, ids=table.column("rep").to_numpy(), kind=table.column("component").to_numpy(), sizes=np.array([len(x) for x in sets]), flat=np.concatenate(sets))
        uri = f"{folder}/{uuid.uuid4().hex}.npz"
        storage.write_bytes(uri, out.getvalue())
        return pa.table({"main": table.column("main").slice(0, 1), "block": table.column("block").slice(0, 1), "uri": [uri]})

    def blocks(side: DataFrame) -> DataFrame:
        sizes = side.join(texts.select("rep", "size"), "rep").groupBy("main").agg(F.ceil(F.sum(F.col("size") + EXTRA) / BLOCK_SHINGLES).alias("blocks"))
        placed = side.join(sizes, "main").withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")))
        # dealt by block, as a group may be large; texts move only now
        return placed.join(texts, "rep").repartition("main", "block").groupBy("main", "block").applyInArrow(write, "main long, block long, uri string")

    stretches = blocks(others).groupBy("main", F.floor(F.col("block") / BLOCKS_A_JOB).alias("s")).agg(F.collect_list("uri").alias("ys"))
    jobs = blocks(tried).select("main", F.col("uri").alias("x")).join(stretches.select("main", "ys"), "main")
    jobs = storage.cut(jobs.select("x", "ys"), "near-jobs")
    jobs = jobs.repartition(max(1, min(jobs.count(), MOST_TASKS)), "x", "ys")

    def compare(batches):
        for batch in batches:
            for x, ys in zip(batch.column("x").to_pylist(), batch.column("ys").to_pylist(), strict=True):
                left = np.load(io.BytesIO(storage.read_bytes(x)))
                own, kind, sizes, flat = (left[c] for c in ("ids", "kind", "sizes", "flat"))
                begin = np.cumsum(sizes) - sizes
                live, a, b = np.arange(len(own)), [], []
                for y in ys:
                    right = np.load(io.BytesIO(storage.read_bytes(y)))
                    order = np.argsort(right["flat"], kind="stable")
                    theirs, owner = right["flat"][order], np.repeat(np.arange(len(right["ids"])), right["sizes"])[order]
                    ids, other, n = right["ids"], right["kind"], right["sizes"]
                    stay = np.ones(len(live), bool)
                    for at, k in enumerate(live.tolist()):
                        mine = flat[begin[k] : begin[k] + sizes[k]]
                        i, j = np.searchsorted(theirs, mine, "left"), np.searchsorted(theirs, mine, "right")
                        both = np.bincount(owner[spread(i, j - i)], minlength=len(ids))
                        ok = np.flatnonzero((both > 0) & (100 * both >= SHARE * (sizes[k] + n - both)) & (other != kind[k]))
                        if len(ok):
                            a.append(int(own[k]))
                            b.append(int(ids[ok[0]]))
                            stay[at] = False
                    live = live[stay]
                    if not len(live):
                        break
                yield pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return storage.cut(jobs.mapInArrow(compare, "a long, b long"), "near-links")


def _join_outside(tried: DataFrame, comp: DataFrame, reps: DataFrame, docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    """Components after each row outside a large bucket's main component has met all of that component and the other rows outside it.

    A row that finds no link to another component is done: components only grow, so whatever is like it
    is in its own for good.  Rows that found one are tried again, as there may be more components that
    they belong to.  Each round every component with a link to another is joined, so there are no more
    rounds than doublings of the number of rows.
    """
    named = _with_component(reps.select("rep"), comp).select("rep", F.col("component").alias("main")).distinct()
    inside = storage.cut(named.join(tried.select("main").distinct(), "main", "left_semi"), "near-inside")
    need = tried.select("rep").unionByName(inside.select("rep")).distinct()
    texts = docs.select(F.col(doc_id).cast("long").alias("rep"), F.col(text).alias("t")).where(F.length("t") > 0)
    texts = texts.join(need.hint("merge"), "rep", "left_semi").withColumn("size", F.length("t") / 6)  # about a word a shingle
    texts = storage.cut(texts, "near-texts")
    while True:
        left, others = _open_groups(tried, inside.select("rep", "main").unionByName(tried.select("rep", "main")), comp)
        if others.isEmpty():
            return comp
        links = _links(left, others, texts)
        if links.isEmpty():
            return comp
        comp = _grow(comp, links, "near-joined")
        tried = storage.cut(tried.join(links.select(F.col("a").alias("rep")).distinct(), "rep", "left_semi"), "near-outside")


def _same_id(sigs: DataFrame, reps: DataFrame) -> DataFrame:
    """(a, b): an id on several rows, and the class of each of their sets."""
    some = sigs.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("c")).where("c > 1")
    rows = sigs.where("n > 0").select("doc_id", "f0", "f1").join(some.select("doc_id"), "doc_id", "left_semi").distinct()
    return rows.join(reps.select("f0", "f1", "rep"), ["f0", "f1"]).where("doc_id <> rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row.

    Words are runs without ASCII white space, A-Z lower-cased.  Documents whose sets of distinct
    shingles of WORDS words overlap by SHARE percent or more are linked; a component is named by its
    smallest document id.  A text of fewer words is one shingle; null texts and texts without words
    have none and are linked with nothing.  Rows that share an id are one document, which is linked by
    each of its texts and kept or dropped as a whole; each such row has its own n_shingles.  Null ids
    link nothing of their own; such a row takes the component of an equal set, else null.  An empty
    table gives an empty result; columns other than the two named are not read.

    Equal sets are merged first.  The others meet where a chunk of their signatures has one error at
    most, so all pairs within 2 * CHUNKS - 1 differing symbols meet, and most pairs far beyond; of
    these, pairs within MOST_DIFFERENCES symbols are tried.  A pair counts once the whole sets confirm
    it.  For every document its closest candidate is tried first; later ones only where they would
    join different components.
    """
    with storage.temporary() as made:
        sigs = storage.cut(signatures(docs, text, doc_id), "near-signatures")
        reps = sigs.where("n > 0 AND doc_id IS NOT NULL").groupBy("f0", "f1").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), *(F.first(c).alias(c) for c in SIG))
        reps = storage.cut(reps, "near-classes")
        found = storage.cut(_candidates(reps), "near-candidates")
        close = storage.cut(_close(found.where("b IS NOT NULL").select("a", "b").distinct(), reps), "near-pairs")
        texts = _texts(docs, close, text, doc_id)
        best = storage.cut(close.groupBy("b").agg(F.min(F.struct("d", "a")).alias("m")).select(F.col("m.a").alias("a"), "b"), "near-best")
        comp = _grow(None, confirm(best, texts).unionByName(_same_id(sigs, reps)), "near-first")
        later = _named(close, comp).where("ca <> cb").select("a", "b").join(best, ["a", "b"], "left_anti")
        later = storage.cut(later, "near-later")
        if not later.isEmpty():
            links = storage.cut(confirm(later, texts), "near-links")
            if not links.isEmpty():
                comp = _grow(comp, links, "near-second")
        members = found.where("b IS NULL").select(F.col("a").alias("rep"), "key").distinct()
        tried = _outside(members, comp)
        if not tried.isEmpty():
            comp = _join_outside(tried, comp, reps, docs, text, doc_id)
        classes = reps.join(comp.select(F.col("node").alias("rep"), "component"), "rep", "left").select("f0", "f1", F.coalesce("component", "rep").alias("component_id"))
        slim = sigs.select("doc_id", "n", "f0", "f1")
        linked = slim.where("n > 0").join(classes, ["f0", "f1"], "left").select("doc_id", "n", "component_id")
        bare = slim.where("n = 0").select("doc_id", "n").join(comp.select(F.col("node").alias("doc_id"), "component"), "doc_id", "left")
        out = linked.unionByName(bare.select("doc_id", "n", F.coalesce("component", "doc_id").alias("component_id")))
        out = out.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
        out = storage.cut(out, "near-duplicates")
        made.keep("near-duplicates")
    return out


def drop_near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``docs`` without the documents that near_duplicates() doesn't keep; rows without an id stay unless a document with one has the same set."""
    gone = near_duplicates(docs, text, doc_id).where("NOT kept").select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, docs[doc_id].cast("long") == gone["_gone"], "left_anti")
