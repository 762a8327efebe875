"""Structure of conversations: faults of their rows, and the cheapest edits to alternating roles.

A conversation is well formed if its roles' initials read ``(s?(ua)+)?``.  Of each row only a sign
matters to its edits: its initial, whether it has to go, whether its text is cut off.  The signs of a
conversation, last row first, are inserted in sorted order into a prefix trie whose nodes keep the least cost
from each state to the end and the edit that attains it; these layers are computed once for all
conversations that end alike.  (Read from the front, the least audit among equal costs can't be
decided: it depends on the rows still to come.)  A walk from a conversation's terminal node to the root then
reads its edits from the first row to the last.

Two passes over sorted rows, both as streams: the first sees flags and digests only and gives audits,
the second sees texts and the audit ahead of them.  A task keeps one conversation's signs, digests and audit
(some 150 bytes a row), never its texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from citemill.llm import storage

KEEP, REROLE, DELETE, INSERT, CUT_OFF = 0, 3, 4, 3, 3  # costs; CUT_OFF comes on top for a truncated row that stays
MOST_NODES, MOST_SIGNS = 1 << 20, 1 << 20
ROLES = {"u": "user", "a": "assistant"}
_NEXT = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}  # state, initial -> state
_STATES = list(_NEXT)
_GIVEN = {"": "u", "s": "u", "u": "a", "a": "u"}  # the initial that an inserted or renamed row gets
_ENDS = ("", "a")
_FAR = 1 << 60
_BLANK, _WHOLE_END = r"[^\x20\x09-\x0D]", r"[.!?][\x20\x09-\x0D]*\z"
#: Signs: ``-`` has to go; otherwise the initial (``o``: none of the three), in upper case if truncated.
_PAIRS = ("su", "ua", "au")
_RESULT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


class Trie:
    """Signs from the last row to the first, with the costs still to come at each node."""

    def __init__(self):
        self.parent, self.down = [-1], [{}]
        cost = [0 if q in _ENDS else _FAR for q in _STATES]
        edit = [""] * len(_STATES)
        self._insertions(cost, edit)
        self.cost, self.edit = [cost], [edit]

    @staticmethod
    def _insertions(cost: list[int], edit: list[str]) -> None:
        """An inserted row leads to another state before the same row; costs only fall, so three rounds reach the least."""
        for _ in range(3):
            for i, q in enumerate(_STATES):
                c = INSERT + cost[_STATES.index(_GIVEN[q])]
                if c < cost[i] or c == cost[i] and "I" < edit[i]:
                    cost[i], edit[i] = c, "I"

    def _grow(self, node: int, sign: str) -> int:
        after, cost, edit = self.cost[node], [], []
        extra = CUT_OFF if sign.isupper() else 0
        for i, q in enumerate(_STATES):
            ways = [(DELETE + after[i], "D")]
            if sign != "-":
                kept = _NEXT[q].get(sign.lower())
                if kept is not None:
                    ways.append((KEEP + extra + after[_STATES.index(kept)], "K"))
                ways.append((REROLE + extra + after[_STATES.index(_GIVEN[q])], "R"))
            c, e = min(ways)
            cost.append(c)
            edit.append(e)
        self._insertions(cost, edit)
        self.parent.append(node)
        self.down.append({})
        self.cost.append(cost)
        self.edit.append(edit)
        new = len(self.parent) - 1
        self.down[node][sign] = new
        return new

    def solve(self, signs: str) -> tuple[int, str]:
        """Cost and audit of a conversation's signs in their order."""
        node = 0
        for sign in reversed(signs):
            below = self.down[node].get(sign)
            node = self._grow(node, sign) if below is None else below
        cost, state, audit, at = self.cost[node][0], "", [], 0
        while True:
            edit = self.edit[node][_STATES.index(state)]
            if not edit:
                return cost, "".join(audit)
            audit.append(edit)
            if edit == "I":
                state = _GIVEN[state]
                continue
            if edit == "R":
                state = _GIVEN[state]
            elif edit == "K":
                state = _NEXT[state][signs[at].lower()]
            node, at = self.parent[node], at + 1


class _Conversation:
    """What the first pass keeps of one conversation."""

    def __init__(self, key):
        self.key, self.signs, self.seen, self.before = key, [], set(), None
        self.least = self.most = self.last = None
        self.turns = self.blank = self.duplicate = self.truncated = self.illegal = 0

    def add(self, turn, initial: str, blank: bool, cut_off: bool, digest: bytes) -> None:
        if turn is not None:
            self.least = turn if self.least is None else self.least
            self.turns += turn != self.last
            self.most = self.last = turn
        if self.before is not None:
            self.illegal += self.before + initial not in _PAIRS
        self.before = initial
        known = digest in self.seen
        self.seen.add(digest)
        sign = initial if initial in ("s", "u", "a") else "o"
        if blank or known:
            sign = "-"
            self.blank += blank
            self.duplicate += not blank
        elif cut_off:
            sign = sign.upper()
            self.truncated += 1
        self.signs.append(sign)

    def counts(self) -> tuple:
        gaps = 0 if self.least is None else self.most - self.least + 1 - self.turns
        return gaps, self.blank, self.duplicate, self.truncated, self.illegal


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def _audits(batches: Iterator[pa.RecordBatch], kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    """Counts, cost and audit of each conversation, from its rows' flags in order."""
    schema = pa.schema([("_conv", kind), *[(x.split()[0], pa.string() if x.endswith("string") else pa.int64()) for x in _RESULT.split(", ")]])
    trie, done, held, now = Trie(), [], 0, None

    def flush():
        nonlocal trie, done, held
        solved = {}
        for signs in sorted({x.signs[::-1] for x in done}):
            if len(trie.parent) > MOST_NODES:
                trie = Trie()
            solved[signs] = trie.solve(signs[::-1])
        rows = [(x.key, *x.counts(), *solved[x.signs[::-1]]) for x in done]
        done, held = [], 0
        return _batch(rows, schema)

    def close():
        nonlocal held
        now.signs, now.seen = "".join(now.signs), None
        done.append(now)
        held += len(now.signs) + 100

    for batch in batches:
        for key, turn, initial, blank, cut_off, digest, dropped in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if now is None or key != now.key:
                if now is not None:
                    close()
                now = _Conversation(key)
                if held > MOST_SIGNS:
                    yield flush()
            if not dropped:
                now.add(turn, initial, blank, cut_off, digest)
    if now is not None:
        close()
        yield flush()


def _mended(batches: Iterator[pa.RecordBatch], kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    """Of rows with their conversation's audit ahead: the rows that stay, and those inserted, in order."""
    schema = pa.schema([("_conv", kind), ("_position", pa.int64()), ("role", pa.string()), ("text", pa.string())])
    key, state, audit, at, position = None, "", "", 0, 0
    out: list[tuple] = []
    held = 0

    def put(role, text):
        nonlocal position, held
        out.append((key, position, role, text))
        position += 1
        held += len(text) + 50

    def insertions():
        nonlocal state, at
        while at < len(audit) and audit[at] == "I":
            state = _GIVEN[state]
            put(ROLES[state], "")
            at += 1

    for batch in batches:
        for conv, script, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if script is not None:
                key, state, audit, at, position = conv, "", script, 0, 0
                insertions()
                continue
            edit = audit[at]
            at += 1
            if edit == "K":
                state = _NEXT[state][role[:1]]
                put(role, text)
            elif edit == "R":
                state = _GIVEN[state]
                put(ROLES[state], text)
            insertions()
            if held > MOST_SIGNS:
                yield _batch(out, schema)
                out, held = [], 0
    if out:
        yield _batch(out, schema)


def _ordered(rows: DataFrame, *more: str) -> DataFrame:
    """Rows of a conversation in one task, by turn (null first), then role and digest of the text."""
    return rows.repartition("_conv").sortWithinPartitions("_conv", *more, F.col("_turn").asc_nulls_first(), "_role", "_digest")


def _prepared(rows: DataFrame, conv: str, turn: str, role: str, text: str, dropped: Column | None) -> DataFrame:
    """Rows as both passes need them; null roles and texts are one space."""
    return rows.select(
        F.col(conv).alias("_conv"),
        F.col(turn).cast("long").alias("_turn"),
        F.coalesce(F.col(role), F.lit(" ")).alias("_role"),
        F.coalesce(F.col(text), F.lit(" ")).alias("_text"),
        (F.lit(False) if dropped is None else F.coalesce(dropped, F.lit(False))).alias("_dropped"),
    ).withColumn("_digest", F.unhex(F.sha2(F.concat("_role", F.lit("\0"), "_text"), 256)))


def repair(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", dropped: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(one row a conversation, rows of the repaired conversations).

    The first has ``_conv``, the counts gaps, blank, duplicate, truncated and illegal, the ``cost`` and the ``audit``
    of the cheapest edits (K keep, R rename, D delete, I insert; the ASCII-least of equal costs).
    The second has ``_conv``, ``_position`` from 0, ``role`` and ``text``.  Rows where ``dropped`` is true
    don't count, but their conversation does.

    Null roles and texts are one space, so such a text is blank; a row whose role is empty or begins with
    another initial can't be kept as it is.  Rows of one turn are ordered by role, then by a digest of
    role and text; repeated rows are duplicates of the first.  Null turns come first and make no gap;
    rows without a conversation's id are one conversation.  A table without rows gives none; other columns are ignored.
    """
    rows = _prepared(rows, conv, turn, role, text, dropped)
    flags = rows.withColumn("_blank", ~F.col("_text").rlike(_BLANK)).withColumn("_cut", ~F.col("_text").rlike(_WHOLE_END)).withColumn("_initial", F.substring("_role", 1, 1))
    flags = _ordered(flags.drop("_text")).select("_conv", "_turn", "_initial", "_blank", "_cut", "_digest", "_dropped")
    field = rows.schema["_conv"].dataType
    name, kind = field.simpleString(), to_arrow_type(field)
    audits = storage.cut(flags.mapInArrow(lambda batches: _audits(batches, kind), f"_conv {name}, {_RESULT}"), "audits")
    none = F.lit(None).cast("string")
    scripts = audits.select("_conv", none.cast("long").alias("_turn"), none.alias("_role"), none.alias("_text"), none.cast("binary").alias("_digest"), F.col("audit").alias("_script"), F.lit(0).alias("_kind"))
    texts = rows.where(~F.col("_dropped")).select("_conv", "_turn", "_role", "_text", "_digest", none.alias("_script"), F.lit(1).alias("_kind"))
    mended = _ordered(scripts.unionByName(texts), "_kind").select("_conv", "_script", "_role", "_text")
    return audits, mended.mapInArrow(lambda batches: _mended(batches, kind), f"_conv {name}, _position long, role string, text string")


def transcripts(mended: DataFrame) -> DataFrame:
    """One row a conversation with rows: ``_conv`` and ``_sha256`` of its ``role:text`` lines, joined by line ends.

    The rows have to come in order, as those of :func:`repair` do; texts pass as a stream.
    """

    field = mended.schema["_conv"].dataType
    schema = pa.schema([("_conv", to_arrow_type(field)), ("_sha256", pa.string())])

    def hashes(batches):
        key, h, done = None, None, []
        for batch in batches:
            for conv, position, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if position == 0:
                    if h is not None:
                        done.append((key, h.hexdigest()))
                    key, h = conv, hashlib.sha256()
                else:
                    h.update(b"\n")
                h.update(f"{role}:{text}".encode())
            if len(done) > 4096:
                yield _batch(done, schema)
                done = []
        if h is not None:
            done.append((key, h.hexdigest()))
        if done:
            yield _batch(done, schema)

    return mended.select("_conv", "_position", "role", "text").mapInArrow(hashes, f"_conv {field.simpleString()}, _sha256 string")
