"""Repair of the structure of conversations: the cheapest edits that make the roles alternate.

Rows of a conversation, in order, are kept (0), given another role (3) or
deleted (4), and empty turns are inserted (3), so that the initials of the roles
read ``(s?(ua)+)?``; a truncated row that stays costs 3 more, blank and repeated
rows must go. That is a shortest path over places and four states (nothing yet,
after s, after u, after a), in which a new role is given by the state.

``Repair`` is the dynamic programme with square-root checkpoints: going
backwards it keeps the cost vectors of every n ** 0.5-th place only; going
forwards it computes each block's vectors anew and takes, of the edits that keep
the least cost, the one whose initial is least.

Conversations of over SEGMENT different rows are cut into segments. The costs of a segment
form a matrix between states, all of which are computed side by side; chained
from the end, they give the cost vector behind each segment. The walk itself
passes over the sorted rows with one segment in memory. The digest of a
repaired conversation can't be split, so that its rows pass one task in order;
they are never collected there.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import isqrt

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ranking import ranked
from .common import BATCH_BYTES, written

#: Different rows of a conversation in a segment.
SEGMENT = 4096
NEVER = 1 << 60
END = [0, NEVER, NEVER, 0]
#: After a new role in each state: the state, and the role. States: nothing yet, after s, after u, after a.
TURN, ROLE = (2, 2, 3, 2), ("user", "user", "assistant", "user")
#: The state after a kept row of this initial in each state, where it may stay.
STAY = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}
_ORDER = ["turn", "said_role", "said"]


class Row:
    """Equal rows in a row: of which the first must be deleted if ``gone``, and the others in any case."""

    __slots__ = ("gone", "initial", "more", "role", "text", "truncated")

    def __init__(self, role: str, text: str, gone: bool, truncated: bool, more: int = 0):
        self.role, self.text, self.gone, self.truncated, self.more, self.initial = role, text, gone, truncated, more, role[:1]


def inserted(v: list[int]) -> list[int]:
    """Costs with empty turns inserted where that is cheaper."""
    u, a = min(v[2], v[3] + 3), min(v[3], v[2] + 3)
    return [min(v[0], u + 3), min(v[1], u + 3), u, a]


def before(row: Row, v: list[int]) -> list[int]:
    """The cost vector before a row, from that behind it."""
    v = [x + 4 * row.more for x in v]
    if row.gone:
        return [x + 4 for x in v]
    late = 3 if row.truncated else 0
    stay = STAY.get(row.initial, {})
    return inserted([min(v[s] + 4, v[TURN[s]] + 3 + late, v[stay[s]] + late if s in stay else NEVER) for s in range(4)])


class Repair:
    """Edits of the rows before a cost vector, from a state on."""

    def __init__(self, rows: list[Row], behind: list[int]):
        self.rows, self.step = rows, isqrt(len(rows)) + 1
        v, self.checkpoints = behind, {len(rows): behind}
        for k in range(len(rows) - 1, -1, -1):
            v = before(rows[k], v)
            if k % self.step == 0:
                self.checkpoints[k] = v
        self.start = v

    def walk(self, state: int) -> Iterator[tuple[str, Row | None, int]]:
        """(edit, row or None, state after it) in order; edits that come after the last row aren't told."""
        for first in range(0, len(self.rows), self.step):
            last = min(first + self.step, len(self.rows))
            vectors = [self.checkpoints[last]]
            for k in range(last - 1, first - 1, -1):
                vectors.append(before(self.rows[k], vectors[-1]))
            vectors.reverse()
            for k in range(first, last):
                row, here, rest = self.rows[k], vectors[k - first], [x + 4 * self.rows[k].more for x in vectors[k - first + 1]]
                while True:
                    if here[state] == rest[state] + 4:
                        edit = "D"
                    elif here[state] == here[TURN[state]] + 3:
                        state = TURN[state]
                        yield "I", None, state
                        continue
                    elif (then := STAY.get(row.initial, {}).get(state)) is not None and here[state] == rest[then] + 3 * row.truncated:
                        edit, state = "K", then
                    else:
                        edit, state = "R", TURN[state]
                    yield edit, row, state
                    break
                for _ in range(row.more):
                    yield "D", row, state


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows with what happened to them: conv_id, key (of the conversation), turn, said_role and said (a digest of the text) as they were, code, role, text.

    Nulls of role and text, and of ids in the checksum, are one space. Code 0 is
    dropped, 3 comes twice; rows are in order of turn (null first), then of the
    role and text's md5 before damage.
    """
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = conversations.select("conv_id", F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("key"), "turn", space("role").alias("said_role"), space("text").alias("was"), F.pmod(F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")), F.lit(20)).cast("int").alias("code"))
    text = F.when(F.col("code").isin(0, 1), "").when(F.col("code") == 2, F.regexp_replace("was", "[.!?]", "")).otherwise(F.col("was"))
    return rows.select("conv_id", "key", "turn", "said_role", F.md5("was").alias("said"), "code", F.when(F.col("code") == 4, "user").otherwise(F.col("said_role")).alias("role"), text.alias("text"))


def blank(text: Column) -> Column:
    """No character but white space."""
    return ~text.rlike(r"[^\x20\x09-\x0D]")


def truncated(text: Column) -> Column:
    """The last character that isn't white space is none of ``.!?``."""
    return ~text.rlike(r"[.!?][\x20\x09-\x0D]*\z")


def repeats(turns: DataFrame) -> DataFrame:
    """Of different rows (key, turn, said_role, said, mark) those whose mark an earlier one of the conversation has."""
    order = F.struct(*_ORDER)
    first = turns.groupBy("key", "mark").agg(F.min(order).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    return turns.join(written(first, "firsts"), ["key", "mark"]).where(order != F.col("first")).select("key", *_ORDER)


def segment_ends(turns: DataFrame, gone: DataFrame, segment: int) -> DataFrame:
    """For conversations of over ``segment`` different rows: the first row of each segment (key, turn, said_role, said) and the cost vector behind the segment (behind)."""
    long = written(turns.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > segment).select("key"), "long")
    if long.isEmpty():
        return gone.select("key", *_ORDER, F.lit(None).cast("array<long>").alias("behind")).limit(0)
    rows = turns.join(long, "key", "left_semi").alias("t").join(gone.alias("g"), _same("t", "g"), "left")
    rows = rows.select(*[F.col(f"t.{c}") for c in turns.columns], F.col("g.key").isNotNull().alias("again"))
    placed = ranked(rows, ["key"], _ORDER).withColumn("segment", F.floor(F.col("rank") / segment))
    heads = placed.where(F.col("rank") % segment == 0).select("key", *_ORDER, "segment")

    def costs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, matrix = None, []
        out: list[tuple] = []

        def told() -> Iterator[pa.RecordBatch]:
            keys, segments, lists = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(segments, pa.int64()), pa.array(lists, pa.list_(pa.int64()))], ["key", "segment", "matrix"])

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("key", "segment", "initial", "gone", "cut", "more")]
            for key, number, initial, lost, cut, more in zip(*columns, strict=True):
                if now != (key, number):
                    if now:
                        out.append((*now, [x for v in matrix for x in v]))
                    # behind the segment in one state each, with what can be inserted there
                    now, matrix = (key, number), [inserted([0 if s == t else NEVER for s in range(4)]) for t in range(4)]
                row = Row(initial, "", lost, cut, more)
                matrix = [before(row, v) for v in matrix]
            if len(out) >= 1024:
                yield from told()
                out = []
        if now:
            out.append((*now, [x for v in matrix for x in v]))
        if out:
            yield from told()

    def chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, v = None, END
        for batch in batches:
            behind = []
            for key, matrix in zip(batch.column("key").to_pylist(), batch.column("matrix").to_pylist(), strict=True):
                if key != now:
                    now, v = key, inserted(END)
                behind.append(v)
                v = [min(NEVER, min(matrix[4 * t + s] + v[t] for t in range(4))) for s in range(4)]
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("segment"), pa.array(behind, pa.list_(pa.int64()))], ["key", "segment", "behind"])

    lost = F.col("blank") | F.col("again")
    light = placed.select("key", "segment", "rank", "initial", lost.alias("gone"), (F.col("cut") & ~lost).alias("cut"), (F.col("n") - 1).alias("more"))
    matrices = light.repartition("key", "segment").sortWithinPartitions("key", "segment", F.desc("rank")).drop("rank").mapInArrow(costs, "key string, segment long, matrix array<long>")
    ends = matrices.repartition("key").sortWithinPartitions("key", F.desc("segment")).mapInArrow(chained, "key string, segment long, behind array<long>")
    return heads.join(ends, ["key", "segment"]).select("key", *_ORDER, "behind")


def _same(a: str, b: str) -> Column:
    same = F.col(f"{a}.key") == F.col(f"{b}.key")
    for c in _ORDER:
        same &= F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}"))
    return same


class _Walker:
    """One conversation as its rows pass by."""

    def __init__(self, conv_id: int | None):
        self.conv_id, self.state, self.cost, self.audit, self.digest, self.first = conv_id, 0, 0, [], hashlib.sha256(), True
        self.counts = dict.fromkeys(("blank", "duplicate", "truncated", "illegal"), 0)
        self.low, self.high, self.turns, self.turn, self.initial = None, None, 0, None, None
        self.rows: list[Row] = []
        self.last: tuple | None = None

    def write(self, role: str, text: str) -> None:
        self.digest.update(f"{'' if self.first else chr(10)}{role}:{text}".encode("utf-8", "surrogatepass"))
        self.first = False

    def settle(self, behind: list[int]) -> None:
        """Walks over the rows that wait."""
        if self.rows:
            for edit, row, state in Repair(self.rows, behind).walk(self.state):
                old, self.state = self.state, state
                self.audit.append(edit)
                self.cost += {"D": 4, "I": 3, "K": 0, "R": 3}[edit]
                if row is None:
                    self.write(ROLE[old], "")
                elif edit in "KR":
                    self.cost += 3 * row.truncated
                    self.write(row.role if edit == "K" else ROLE[old], row.text)
        self.rows = []

    def add(self, key: tuple, turn: int | None, role: str, text: str, copies: int, again: bool, is_blank: bool, cut: bool) -> None:
        same = key == self.last
        self.last = key
        if turn is not None:
            self.low, self.high = turn if self.low is None else self.low, turn
            self.turns += turn != self.turn
            self.turn = turn
        gone = is_blank or again or same
        for k in range(copies):
            fault = "blank" if is_blank else "duplicate" if gone or k else "truncated" if cut else None
            if fault:
                self.counts[fault] += 1
            if self.initial is not None:
                self.counts["illegal"] += self.initial + role[:1] not in ("su", "ua", "au")
            self.initial = role[:1]
        if same:
            self.rows[-1].more += copies
        else:
            self.rows.append(Row(role, text, gone, cut and not gone, copies - 1))

    def ended(self) -> dict:
        """The conversation's row; what must still be inserted is."""
        self.settle(inserted(END))
        while self.state not in (0, 3):
            self.write(ROLE[self.state], "")
            self.state, self.cost = TURN[self.state], self.cost + 3
            self.audit.append("I")
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return {"conv_id": self.conv_id, "gaps": gaps, **self.counts, "cost": self.cost, "audit": "".join(self.audit), "repaired_sha256": self.digest.hexdigest()}


SCHEMA = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def repaired(conversations: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """A row for each conversation of (conv_id, turn, role, text), the null one included: faults after damage, and its cheapest repair.

    Empty and very long texts are as any other; further columns aren't read.
    Equal rows that follow one another are held once, with their number. A
    conversation all of whose rows are dropped has zeros; no rows give none.
    """
    rows = damaged(conversations)
    kept = rows.where("code <> 0")
    mark = F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"))
    light = kept.select("key", *_ORDER, F.when(F.col("code") == 3, 2).otherwise(1).alias("n"), mark.alias("mark"), F.left("role", F.lit(1)).alias("initial"), blank(F.col("text")).alias("blank"), truncated(F.col("text")).alias("cut"))
    turns = written(light.groupBy("key", *_ORDER, "mark", "initial", "blank", "cut").agg(F.sum("n").alias("n")), "turns")
    gone = written(repeats(turns), "repeats")
    notes = gone.select("key", *_ORDER, F.lit(None).cast("array<long>").alias("behind")).unionByName(segment_ends(turns, gone, segment))
    told = rows.select("key", *_ORDER, F.lit(2).alias("kind"), F.lit(None).cast("array<long>").alias("behind"), "conv_id", "role", "text", "code", blank(F.col("text")).alias("blank"), truncated(F.col("text")).alias("cut"))
    kind = F.when(F.col("behind").isNull(), 1).otherwise(0)
    both = told.unionByName(notes.select("key", *_ORDER, kind.alias("kind"), "behind"), allowMissingColumns=True)
    fields = ("key", *_ORDER, "kind", "behind", "conv_id", "role", "text", "code", "blank", "cut")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, noted, again, held = None, None, None, object()
        done: list[dict] = []
        size = 0
        for batch in batches:
            for key, turn, said_role, said, kind, behind, conv_id, role, text, code, is_blank, cut in zip(*[batch.column(c).to_pylist() for c in fields], strict=True):
                if key != held:
                    if now:
                        done.append(now.ended())
                        size += len(done[-1]["audit"]) + 200
                    now, held, noted = None, key, inserted(END)
                place = (turn, said_role, said)
                if kind == 1:
                    again = (key, place)
                    continue
                if kind == 0:
                    if now:
                        now.settle(noted)
                    noted = behind
                    continue
                now = now or _Walker(conv_id)
                if code:
                    now.add(place, turn, role, text, 2 if code == 3 else 1, again == (key, place), is_blank, cut)
            if size > BATCH_BYTES:
                yield from pa.Table.from_pylist(done, _ARROW).to_batches()
                done, size = [], 0
        if now:
            done.append(now.ended())
        if done:
            yield from pa.Table.from_pylist(done, _ARROW).to_batches()

    return both.repartition("key").sortWithinPartitions("key", *_ORDER, "kind").select(*fields).mapInArrow(walk, SCHEMA)


_ARROW = pa.schema([(part.split()[0], pa.string() if part.endswith("string") else pa.int64()) for part in SCHEMA.split(", ")])
