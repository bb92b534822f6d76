"""Conversation structure repair: the cheapest edits that give a conversation the order of roles `(s?(ua)+)?`.

A row may be kept (0), given the role user or assistant (1) or deleted (2); a user or assistant row without text may be inserted anywhere (5). Blank
and repeated rows have to go, and a truncated row that stays costs 5 more. Of the cheapest edits, those of the least audit
(their initials in order, compared as ASCII) are taken.

Both are decided by one number. The weight of what is left of a conversation is an integer whose high digits are the cost
and whose low digits, a fixed number of octal ones, are the audit's letters from the left with zeros behind its end; so the
smaller number is the cheaper repair and, of equal cost, the lesser audit. Going through the rows from the last to the first, the weight at each row and
state of the order is the least of the edits' weights: a shortest path in a graph of rows x states, solved on integers alone.

A conversation of up to SEGMENT rows is sorted into one task's stream and repaired there. A longer one is dealt by ranges of its rows into segments.
A segment's paths from each state to each state are solved in the same way (what ends at a segment's last row is no
beginning of another such path, so audits of segments compare like those of wholes); the segments' costs, a few numbers each, are chained; and the rows are
streamed once in order for the digest of the repaired text, which only their order can give. Nothing holds more than a segment's
rows, but for the audit, which is part of the result.

Cases: a null identifier is a conversation of its own; null turns come first; a null role or text is one space (so such a text is blank). Rows of equal turn are
taken by role and then by text, in code-point order. A role counts by its initial; one without characters fits no order.
Repeated rows are rows. A conversation without rows after damage has zeros, an empty audit and the digest of an empty text. An empty table gives
an empty result; other columns are ignored, whatever their names. The texts of a segment's rows are held in memory while they are repaired.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerline.llm.common import staged, table

# What an edit costs, and the letters of an audit in ASCII order; their digits are 1 to 4.
KEEP, REROLE, DELETE, INSERT, TRUNCATED_STAYS = 0, 1, 2, 5, 5
LETTERS = "DIKR"
D, I, K, R = 1, 2, 3, 4
#: States of the order: nothing yet, after a system row, after a user row, after an assistant row. What may follow each, and what is made there.
AFTER_KEPT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
MADE = (("user", 2), ("user", 2), ("assistant", 3), ("user", 2))
STATES, ACCEPTED, IN_ORDER = range(4), (0, 3), frozenset(("su", "ua", "au"))
BLANK, DUPLICATE, TRUNCATED = 1, 2, 3
#: Rows of a segment.
SEGMENT = 2000
BLANKS = r"[\x20\x09-\x0D]"


# --- the weights ------------------------------------------------------------------------------------------------------


class Weights:
    """Integers that carry a cost above `width` octal digits of an audit."""

    def __init__(self, width: int):
        self.width, self.bits = width, 3 * width
        self.none = 1 << (self.bits + 60)  # more than any repair costs

    def before(self, letter: int, cost: int, rest: int) -> int:
        """The weight of an edit and what follows it."""
        if rest >= self.none:
            return self.none
        high = rest >> self.bits
        low = rest - (high << self.bits)
        return ((high + cost) << self.bits) + (letter << (self.bits - 3)) + (low >> 3)

    def audit(self, weight: int) -> str:
        low = weight & ((1 << self.bits) - 1)
        return f"{low:0{self.width}o}".rstrip("0").translate(str.maketrans("1234", LETTERS)) if low else ""

    def cost(self, weight: int) -> int:
        return weight >> self.bits

    def inserted(self, rest: list[int]) -> list[int]:
        """The weights in front of a row, from those at the row: up to two rows may be inserted (a third would come back to a state at a cost)."""
        once = [min(rest[s], self.before(I, INSERT, rest[MADE[s][1]])) for s in STATES]
        return [min(rest[s], self.before(I, INSERT, once[MADE[s][1]])) for s in STATES]

    def solved(self, rows: tuple[tuple[str, int], ...], after: list[int]) -> list[int]:
        """The weights in front of rows (initial, fault), by state, from those behind them."""
        for initial, fault in reversed(rows):
            extra = TRUNCATED_STAYS if fault == TRUNCATED else 0
            here = [self.before(D, DELETE, after[s]) for s in STATES]
            if fault not in (BLANK, DUPLICATE):
                for s in STATES:
                    here[s] = min(here[s], self.before(R, REROLE + extra, after[MADE[s][1]]))
                    if (s, initial) in AFTER_KEPT:
                        here[s] = min(here[s], self.before(K, KEEP + extra, after[AFTER_KEPT[s, initial]]))
            after = self.inserted(here)
        return after


def _width(rows: int) -> int:
    """Letters that the cheapest edits of so many rows can have: deleting all bounds the cost, so inserts as well."""
    return rows + (DELETE * rows + 2 * INSERT) // INSERT + 1


@lru_cache(maxsize=1 << 14)
def _cheapest(rows: tuple[tuple[str, int], ...]) -> tuple[int, str]:
    w = Weights(_width(len(rows)))
    end = w.inserted([0 if s in ACCEPTED else w.none for s in STATES])
    best = w.solved(rows, end)[0]
    return w.cost(best), w.audit(best)


def cheapest(rows: tuple[tuple[str, int], ...]) -> tuple[int, str]:
    """(cost, audit) of rows (initial, fault). Short conversations repeat the same few; what they give is remembered."""
    return _cheapest(rows) if len(rows) <= 32 else _cheapest.__wrapped__(rows)


def paths(rows: tuple[tuple[str, int], ...]) -> tuple[list[int], list[str]]:
    """(costs, audits) of the cheapest edits of rows from each state to each state, at 4 * from + to; -1 where there is no way."""
    w = Weights(_width(len(rows)))
    ways = [w.solved(rows, [0 if s == to else w.none for s in STATES]) for to in STATES]
    found = [ways[to][s] for s in STATES for to in STATES]
    return [-1 if x >= w.none else w.cost(x) for x in found], ["" if x >= w.none else w.audit(x) for x in found]


class Repair:
    """Applies an audit, row by row, and digests what it leaves."""

    def __init__(self):
        self.digest, self.state, self.first = hashlib.sha256(), 0, True

    def _write(self, role: str, text: str) -> None:
        self.digest.update(f"{'' if self.first else chr(10)}{role}:{text}".encode("utf-8", "surrogatepass"))
        self.first = False

    def make(self, text: str = "") -> None:
        role, self.state = MADE[self.state]
        self._write(role, text)

    def row(self, letter: str, role: str, text: str) -> None:
        if letter == "R":
            self.make(text)
        elif letter == "K":
            self.state = AFTER_KEPT[self.state, role[:1]]
            self._write(role, text)


# --- rows after damage ------------------------------------------------------------------------------------------------


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, gone, tie) after the damage that the CRC-32 of `conv_id:turn` deals; dropped rows are kept as gone, without texts."""
    as_text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    h = F.crc32(F.concat_ws(":", as_text("conv_id"), as_text("turn")).cast("binary")) % 20
    rows = conversations.select("conv_id", "turn", as_text("role").alias("role"), as_text("text").alias("text"), h.alias("h"), F.explode(F.sequence(F.lit(1), F.when(h == 3, 2).otherwise(1))).alias("copy"))
    role = F.when(F.col("h") == 0, "").when(F.col("h") == 4, "user").otherwise(F.col("role"))
    text = F.when(F.col("h").isin(0, 1), "").when(F.col("h") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    # The tie is counted where the rows are read, so that a task that runs again counts alike.
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("h") == 0).alias("gone"), F.monotonically_increasing_id().alias("tie"))


def own_fault(text: Column) -> Column:
    """BLANK, TRUNCATED or 0, by a row's text alone."""
    last = F.substring(F.regexp_replace(text, f"{BLANKS}+$", ""), -1, 1)
    return F.when(~text.rlike(r"[^\x20\x09-\x0D]"), BLANK).when(~last.isin(".", "!", "?"), TRUNCATED).otherwise(0)


def faults(rows: list[tuple[str, str]]) -> list[int]:
    """The first fault of each row (role, text) of a conversation, 0 without one."""
    out, seen = [], set()
    for row in rows:
        text = row[1].rstrip(" \t\n\v\f\r")
        out.append(BLANK if not text else DUPLICATE if row in seen else 0 if text[-1] in ".!?" else TRUNCATED)
        seen.add(row)
    return out


RESULT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def repaired(rows: list[tuple]) -> tuple:
    """RESULT of a conversation's rows (turn, role, text), in order."""
    turns = [r[0] for r in rows if r[0] is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    found = faults([r[1:] for r in rows])
    initials = [r[1][:1] for r in rows]
    cost, audit = cheapest(tuple(zip(initials, found)))
    repair, at = Repair(), 0
    for letter in audit:
        if letter == "I":
            repair.make()
        else:
            repair.row(letter, *rows[at][1:])
            at += 1
    illegal = sum(a + b not in IN_ORDER for a, b in zip(initials, initials[1:]))
    return gaps, found.count(BLANK), found.count(DUPLICATE), found.count(TRUNCATED), illegal, cost, audit, repair.digest.hexdigest()


def _streamed(rows: DataFrame, schema: T.StructType, runs: Callable[[Iterator[tuple]], Iterator[tuple]]) -> DataFrame:
    """What `runs` makes of each task's rows, as they come."""
    names, kinds = schema.names, [pa.int64() if isinstance(f.dataType, T.LongType) else pa.string() for f in schema.fields[1:]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key: list[pa.DataType] = []

        def each() -> Iterator[tuple]:
            for batch in batches:
                key[:] = [batch.schema.field(0).type]
                yield from zip(*(c.to_pylist() for c in batch.columns))

        def packed(out: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), key + kinds)], names=names)

        out = []
        for row in runs(each()):
            out.append(row)
            if len(out) >= 1000:
                yield packed(out)
                out = []
        if out:
            yield packed(out)

    return rows.mapInArrow(run, schema)


def _short(rows: DataFrame, schema: T.StructType) -> DataFrame:
    """Conversations that one task may hold: (conv_id, *RESULT) of damaged rows."""

    def runs(rows: Iterator[tuple]) -> Iterator[tuple]:
        now, held = None, []
        for conv_id, turn, role, text, gone in rows:
            if now != (conv_id,):
                if now:
                    yield (*now, *repaired(held))
                now, held = (conv_id,), []
            if not gone:
                held.append((turn, role, text))
        if now:
            yield (*now, *repaired(held))

    return _streamed(rows.select("conv_id", "turn", "role", "text", "gone").repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text"), schema, runs)


# --- long conversations -----------------------------------------------------------------------------------------------


def _segment_paths(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """One row of a segment's (name, segment) rows (place, initial, fault): costs and audits between states, and their order from each state."""
    rows = rows.sort_values("place")
    initials = rows["initial"].tolist()
    costs, audits = paths(tuple(zip(initials, rows["fault"].tolist())))
    ranks = [sorted(audits[4 * (k // 4) : 4 * (k // 4) + 4]).index(audits[k]) for k in range(16)]
    illegal = sum(a + b not in IN_ORDER for a, b in zip(initials, initials[1:]))
    return pd.DataFrame([(*key, rows["place"].iloc[0], costs, ranks, audits, illegal, initials[0], initials[-1])], columns=_SEGMENTS)


_SEGMENTS = ["name", "segment", "place", "costs", "ranks", "audits", "illegal", "first", "last"]


def _chained(segments: pd.DataFrame) -> pd.DataFrame:
    """Which path each segment of a conversation takes: (name, segment, pick, tail, cost, illegal); the last two are the conversation's."""
    segments = segments.sort_values("place")
    # What is left behind the last row: nothing where the order is whole, else one or two rows to insert.
    left, picks = [0, 2 * INSERT, INSERT, 0], []
    for costs, ranks in zip(reversed(segments["costs"].tolist()), reversed(segments["ranks"].tolist())):
        # Cost above rank above state: the least number is the cheapest way and, of equals, the one of the least audit.
        best = [min(((costs[4 * s + t] + left[t]) * 16 + ranks[4 * s + t] * 4 + t for t in STATES if costs[4 * s + t] >= 0), default=None) for s in STATES]
        picks.append([None if b is None else b % 4 for b in best])
        left = [1 << 50 if b is None else b // 16 for b in best]
    state, taken = 0, []
    for pick in reversed(picks):
        taken.append(4 * state + pick[state])
        state = pick[state]
    inner = zip(segments["last"].tolist(), segments["first"].tolist()[1:])
    illegal = int(segments["illegal"].sum()) + sum(a + b not in IN_ORDER for a, b in inner)
    out = segments[["name", "segment"]].assign(pick=taken, tail="", cost=left[0], illegal=illegal)
    out.loc[out.index[-1], "tail"] = ("", "II", "I", "")[state]
    return out


def _long(rows: DataFrame, schema: T.StructType, segment: int) -> DataFrame:
    """Conversations that no task may hold: (conv_id, *RESULT) of damaged rows, each conversation split over tasks."""
    name = F.to_json(F.struct("conv_id"), {"ignoreNullFields": "false"})  # no null, so that joins meet it
    order = ["name", "turn", "role", "text", "tie"]
    ranged = rows.withColumn("name", name).repartitionByRange(*order).sortWithinPartitions(*order)
    ranged = staged(ranged.drop("tie").withColumn("place", F.monotonically_increasing_id()))
    live = ranged.where("NOT gone")
    digest = F.sha2(F.col("text").cast("binary"), 256)
    firsts = live.groupBy("name", "role", digest.alias("digest")).agg(F.min("place").alias("place")).select("place", F.lit(True).alias("is_first"))
    narrow = live.select("name", "place", "turn", F.substring("role", 1, 1).alias("initial"), own_fault(F.col("text")).alias("own")).join(firsts, "place", "left")
    fault = F.when((F.col("own") != BLANK) & F.col("is_first").isNull(), DUPLICATE).otherwise(F.col("own"))
    narrow = staged(narrow.select("name", "place", "turn", "initial", fault.alias("fault"), F.floor(F.col("place") / segment).alias("segment")))

    kind = "name string, segment long, place long, costs array<long>, ranks array<int>, audits array<string>, illegal long, first string, last string"
    segments = staged(narrow.select("name", "segment", "place", "initial", "fault").groupBy("name", "segment").applyInPandas(_segment_paths, kind))
    chained = staged(segments.drop("audits").groupBy("name").applyInPandas(_chained, "name string, segment long, pick int, tail string, cost long, illegal long"))
    turns = narrow.groupBy("name", "turn").agg(*(F.count(F.when(F.col("fault") == f, 1)).alias(f"f{f}") for f in (BLANK, DUPLICATE, TRUNCATED)))
    gaps = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0))
    counts = turns.groupBy("name").agg(gaps.cast("long").alias("gaps"), *(F.sum(f"f{f}").alias(f"f{f}") for f in (BLANK, DUPLICATE, TRUNCATED)))
    totals = counts.join(chained.groupBy("name").agg(F.first("illegal").alias("illegal"), F.first("cost").alias("cost")), "name")
    heads = ranged.groupBy("name").agg(F.first("conv_id").alias("conv_id")).join(totals, "name", "left")

    # One stream a conversation, in order: its head, and each segment's audit in front of the segment's rows.
    numbers = ["gaps", f"f{BLANK}", f"f{DUPLICATE}", f"f{TRUNCATED}", "illegal", "cost"]
    nothing = {"conv_id": F.lit(None).cast(rows.schema["conv_id"].dataType), **{c: F.lit(None).cast("long") for c in numbers}, **{c: F.lit(None).cast("string") for c in ("audit", "role", "text")}}
    columns = ["conv_id", "name", "place", "step", *numbers, "audit", "role", "text"]
    parts = (
        heads.withColumns({"place": F.lit(-1).cast("long"), "step": F.lit(0)}),
        segments.join(chained.drop("illegal", "cost"), ["name", "segment"]).select("name", "place", F.lit(1).alias("step"), F.concat(F.get("audits", "pick"), "tail").alias("audit")),
        live.select("name", "place", F.lit(2).alias("step"), "role", "text"),
    )
    both = None
    for p in parts:
        p = p.withColumns({c: v for c, v in nothing.items() if c not in p.columns}).select(*columns)
        both = p if both is None else both.unionByName(p)

    def runs(rows: Iterator[tuple]) -> Iterator[tuple]:
        head, repair, audits, at = None, None, [], 0

        def made() -> None:
            """Makes the rows that the audit inserts next."""
            nonlocal at
            while audits and at < len(audits[-1]) and audits[-1][at] == "I":
                repair.make()
                at += 1

        def result() -> tuple:
            return (*head, "".join(audits), repair.digest.hexdigest())

        for conv_id, _, _, step, *found, audit, role, text in rows:
            if step == 0:
                if head:
                    yield result()
                head, repair, audits, at = (conv_id, *(x or 0 for x in found)), Repair(), [], 0
            elif step == 1:
                audits.append(audit)
                at = 0
                made()
            else:
                repair.row(audits[-1][at], role, text)
                at += 1
                made()
        if head:
            yield result()

    return _streamed(both.repartition("name").sortWithinPartitions("name", "place", "step"), schema, runs)


def repair_conversations(conversations: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """(conv_id, *RESULT) of every conversation of rows (conv_id, turn, role, text), after damage."""
    schema = T.StructType([conversations.schema["conv_id"], *T._parse_datatype_string(RESULT).fields])
    rows = damaged(conversations)
    # At most one in so many rows makes a conversation long, so this table is as much smaller than the corpus.
    long = staged(conversations.groupBy("conv_id").agg(F.count("*").alias("n")).where(F.col("n") > segment).select(F.col("conv_id").alias("long_id")))
    same = F.col("conv_id").eqNullSafe(F.col("long_id"))
    short = _short(rows.join(long, same, "left_anti"), schema)
    return short if long.isEmpty() else short.unionByName(_long(rows.join(long, same, "left_semi"), schema, segment))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_conversations(table(spark, sf_dir, "conversations"))
