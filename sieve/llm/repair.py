"""Conversation structure repair by integer shortest paths.

A conversation is the sequence of its rows by turn.  Every row is kept, gets another
role or is deleted, and empty turns may be inserted, so that the initials of the roles
read ``(s?(ua)+)?`` (states: start, after s, after u, after a).  The weight of a path of
edits is one integer: the cost stands in the high digits; below it, ``width`` digits of
three bits hold the edits' letters, the first edit in the highest digit and zeros at the
end.  An edge adds ``cost << 3 * width`` and its letter at the place of the next edit, and
a node keeps the smallest integer that reaches it; no second criterion is compared.
(Of two cheapest paths to one node neither audit is a prefix of the other: both edit
the same rows, and the rest of the longer one would be inserts, which cost something.
So a node needs one integer, however many edits lie behind it.)

Spark does the work on rows of facts (hash of role and text, initial, fault), without
texts: equal rows of a turn are aggregated, the first place of each role and text is an
aggregate joined back, and the rows are dealt by ranges of (conversation, turn), so
that a conversation of any size falls into segments of at most ``SEGMENT`` rows.  A
segment is solved from each state to each state; its solutions are edges of the same
kind, and the segments of a conversation are put together along their order.  The
texts are moved once, to be hashed: SHA-256 reads a conversation's text in order, so
that step streams a conversation through one task, holding a batch of it at a time.

Defined results: a null role or text is one space, and so is a null conversation or
turn in the key that decides the damage; rows of null conv_id are a conversation; rows
of the same turn are ordered by the hash of role and text, copies side by side; other
columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import column_slices, cut_lineage, n_partitions

SPACE = " \t\n\x0b\f\r"
SEGMENT = 256
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}  # the state after an inserted or renamed turn
STEPS = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
FINAL = (START, ASSISTANT)
LETTERS = " DIKR"  # a letter's digit is its place: in ASCII order, 0 is the padding
DIGIT = {c: i for i, c in enumerate(LETTERS)}
COST = {"K": 0, "R": 3, "D": 4, "I": 3}
TRUNCATED = 3
ROLE = {USER: "user", ASSISTANT: "assistant"}
BITS = 3

Label = tuple[int, int]  # the integer of the best path to a node, and its number of edits


def better(labels: dict[int, Label], state: int, label: Label) -> None:
    if state not in labels or label[0] < labels[state][0]:
        labels[state] = label


def inserts(labels: dict[int, Label], width: int) -> dict[int, Label]:
    """With up to two inserted turns; they reach every state that inserts reach."""
    out, last = dict(labels), labels
    for _ in range(2):
        now: dict[int, Label] = {}
        for q, (w, n) in last.items():
            better(now, NEXT[q], (w + (COST["I"] << BITS * width) + (DIGIT["I"] << BITS * (width - 1 - n)), n + 1))
        for q, label in now.items():
            better(out, q, label)
        last = now
    return out


def over_row(labels: dict[int, Label], row: str, width: int) -> dict[int, Label]:
    """``row``: the role's initial, then ``.`` (sound), ``t`` (truncated) or ``d`` (must go)."""
    out: dict[int, Label] = {}
    for q, (w, n) in labels.items():
        place = BITS * (width - 1 - n)
        better(out, q, (w + (COST["D"] << BITS * width) + (DIGIT["D"] << place), n + 1))
        if row[1] != "d":
            extra = TRUNCATED if row[1] == "t" else 0
            if (q, row[0]) in STEPS:
                better(out, STEPS[q, row[0]], (w + (COST["K"] + extra << BITS * width) + (DIGIT["K"] << place), n + 1))
            better(out, NEXT[q], (w + (COST["R"] + extra << BITS * width) + (DIGIT["R"] << place), n + 1))
    return out


def letters_of(label: Label, width: int) -> tuple[int, str]:
    w, n = label
    digits = (w & (1 << BITS * width) - 1) >> BITS * (width - n)
    return w >> BITS * width, oct(digits)[2:].translate({ord(str(i)): c for i, c in enumerate(LETTERS)}) if n else ""


@lru_cache(maxsize=4096)
def segment(rows: str) -> tuple[tuple[int, int, int, str], ...]:
    """(from state, to state, cost, audit) of the best edits of a stretch of rows (two
    characters each), inserts after the last row left out."""
    width, out = 3 * (len(rows) // 2), []
    for start in range(4):
        labels: dict[int, Label] = {start: (0, 0)}
        for i in range(0, len(rows), 2):
            labels = over_row(inserts(labels, width), rows[i : i + 2], width)
        out += [(start, q, *letters_of(label, width)) for q, label in sorted(labels.items())]
    return tuple(out)


def number(audit: str) -> int:
    return int(audit.translate({ord(c): str(i) for i, c in enumerate(LETTERS)}), 8) if audit else 0


class Path:
    """Best edits of a conversation whose segments come one after the other.  The digits
    grow with the conversation: ``width`` is that of the longest path so far."""

    def __init__(self) -> None:
        self.labels: dict[int, Label] = {START: (0, 0)}
        self.width = 0

    def _widen(self, by: int) -> None:
        # more zeros at the end of every path
        self.labels = {q: (w << BITS * by, n) for q, (w, n) in self.labels.items()}
        self.width += by

    def add(self, edges: list[tuple[int, int, int, str]]) -> None:
        longest = max(n for _, n in self.labels.values())
        self._widen(max(0, longest + max(len(e[3]) for e in edges) - self.width))
        out: dict[int, Label] = {}
        for start, end, cost, audit in edges:
            if start in self.labels:
                w, n = self.labels[start]
                better(out, end, (w + (cost << BITS * self.width) + (number(audit) << BITS * (self.width - n - len(audit))), n + len(audit)))
        self.labels = out

    def finish(self) -> tuple[int, str]:
        self._widen(2)
        labels = inserts(self.labels, self.width)
        return letters_of(min(labels[q] for q in FINAL if q in labels), self.width)


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, copies: each row as often as ``copies`` says (0: dropped)."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fate = F.crc32(F.concat(said("conv_id"), F.lit(":"), said("turn"))) % 20
    text = F.when(fate == 1, "").when(fate == 2, F.translate(said("text"), ".!?", "")).otherwise(said("text"))
    return conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.when(fate == 4, "user").otherwise(said("role")).alias("role"),
                                text.alias("text"), F.when(fate == 0, 0).when(fate == 3, 2).otherwise(1).cast("long").alias("copies"))


def turn_key(role: Column, text: Column) -> Column:
    """128 bits that stand for a role and a text."""
    return F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)))


ORDER = ["conv_id", "timed", "turn", "key"]  # null turns first, as false < true


def facts(rows: DataFrame) -> DataFrame:
    """One row for the equal rows of a turn: initial, blank, cut (truncated), copies, and
    repeated: whether an earlier turn has the same role and text."""
    rest = F.rtrim(F.col("text"), F.lit(SPACE))
    initial = F.substring("role", 1, 1)
    one = rows.select("conv_id", F.col("turn").isNotNull().alias("timed"), "turn", turn_key(F.col("role"), F.col("text")).alias("key"), "copies",
                      F.when(initial.isin("s", "u", "a"), initial).otherwise("x").alias("initial"),
                      (rest == "").alias("blank"), (~F.substring(rest, -1, 1).isin(".", "!", "?")).alias("cut"))
    one = cut_lineage(one.groupBy(*ORDER).agg(F.sum("copies").alias("copies"), *[F.first(c).alias(c) for c in ("initial", "blank", "cut")]))
    place = F.struct("timed", "turn")
    first = one.filter("copies > 0").groupBy(F.col("conv_id").alias("_c"), F.col("key").alias("_k")).agg(F.min(place).alias("_first"))
    met = one.join(first, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("key") == F.col("_k")), "left")
    return met.select(*one.columns, F.coalesce(~place.eqNullSafe(F.col("_first")), F.lit(False)).alias("repeated"))


SEGMENTS = ("conv_id long, timed boolean, turn long, key binary, part long, head string, tail string, blank long, duplicate long, truncated long, illegal long, "
            "edges array<struct<a:int,b:int,cost:long,audit:string>>")


def segments(known: DataFrame, rows: int = SEGMENT) -> DataFrame:
    """Stretches of a conversation, named by their first row (copies of one row may make
    several, then ``part`` counts on), with their faults and solutions; head and tail are
    the initials at the ends."""
    dealt = known.repartitionByRange(n_partitions(known.sparkSession), *ORDER).sortWithinPartitions(*ORDER)

    def run(batches):
        held, part = None, 0  # [name, initials and faults, counts]

        def solved(held, part):
            name, items, blank, duplicate, truncated = held
            initials = [x[0] for x in items]
            illegal = sum(x + y not in ("su", "ua", "au") for x, y in zip(initials, initials[1:], strict=False))
            return (*name, part, initials[0] if items else "", initials[-1] if items else "", blank, duplicate, truncated, illegal,
                    [dict(zip(("a", "b", "cost", "audit"), e, strict=True)) for e in segment("".join(items))] if items else [])

        for batch in batches:
            out = []
            for conv, timed, turn, key, copies, initial, blank, cut, repeated in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held is None or held[0][0] != conv:
                    if held is not None:
                        out.append(solved(held, part))
                        part += 1
                    held = [(conv, timed, turn, key), [], 0, 0, 0]
                left = copies
                if left and not blank and not repeated:
                    held[1].append(initial + ("t" if cut else "."))
                    held[4] += cut
                    left -= 1
                held[2 if blank else 3] += left
                while left:  # copies, too, in stretches of bounded length
                    some = min(left, max(1, rows - len(held[1])))
                    held[1] += [initial + "d"] * some
                    left -= some
                    if len(held[1]) >= rows and left:
                        out.append(solved(held, part))
                        part += 1
                        held = [(conv, timed, turn, key), [], 0, 0, 0]
                if len(held[1]) >= rows:
                    out.append(solved(held, part))
                    part += 1
                    held = None
            yield from as_batches(out, SEGMENTS_ARROW)
        if held is not None:
            yield from as_batches([solved(held, part)], SEGMENTS_ARROW)

    return dealt.select(*ORDER, "copies", "initial", "blank", "cut", "repeated").mapInArrow(run, SEGMENTS)


_EDGE = pa.struct([("a", pa.int32()), ("b", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())])
SEGMENTS_ARROW = pa.schema([("conv_id", pa.int64()), ("timed", pa.bool_()), ("turn", pa.int64()), ("key", pa.binary()), ("part", pa.int64()), ("head", pa.string()), ("tail", pa.string()),
                            ("blank", pa.int64()), ("duplicate", pa.int64()), ("truncated", pa.int64()), ("illegal", pa.int64()), ("edges", pa.list_(_EDGE))])
COUNTS = ("blank", "duplicate", "truncated", "illegal", "cost")
PATHS_ARROW = pa.schema([("conv_id", pa.int64()), *((c, pa.int64()) for c in COUNTS), ("audit", pa.string())])
REPAIRED_ARROW = pa.schema([*PATHS_ARROW, ("gaps", pa.int64()), ("repaired_sha256", pa.string())])


def as_batches(rows: list[tuple], schema: pa.Schema, size: int = 4096):
    for lo in range(0, len(rows), size):
        cols = zip(*rows[lo : lo + size], strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)


def ddl(schema: pa.Schema) -> str:
    kinds = {pa.int64(): "long", pa.string(): "string"}
    return ", ".join(f"{f.name} {kinds[f.type]}" for f in schema)


def paths(parts: DataFrame) -> DataFrame:
    """(conv_id, blank, duplicate, truncated, illegal, cost, audit): a conversation's
    segments in order."""
    dealt = parts.repartition(n_partitions(parts.sparkSession), "conv_id").sortWithinPartitions(*ORDER, "part")

    def run(batches):
        open_, conv, path, tail, sums = False, None, None, "", [0] * 4

        def row():
            return (conv, *sums, *path.finish())

        for batch in batches:
            out = []
            for own, head, end, *counts, edges in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if not open_ or own != conv:
                    if open_:
                        out.append(row())
                    open_, conv, path, tail, sums = True, own, Path(), "", [0] * 4
                sums = [x + y for x, y in zip(sums, counts, strict=True)]
                if edges:
                    sums[3] += bool(tail) and tail + head not in ("su", "ua", "au")
                    tail = end
                    path.add([(e["a"], e["b"], e["cost"], e["audit"]) for e in edges])
            yield from as_batches(out, PATHS_ARROW)
        if open_:
            yield from as_batches([row()], PATHS_ARROW)

    return dealt.select("conv_id", "head", "tail", "blank", "duplicate", "truncated", "illegal", "edges").mapInArrow(run, ddl(PATHS_ARROW))


def edited(audit: str, state: int, at: int, role: str, text: str) -> tuple[list[tuple[str, str]], int, int]:
    """The turns that a row becomes, with inserted ones before it; the new state and
    place in the audit."""
    out = []
    while audit[at] == "I":
        state = NEXT[state]
        out.append((ROLE[state], ""))
        at += 1
    if audit[at] == "K":
        state = STEPS[state, role[:1]]
        out.append((role, text))
    elif audit[at] == "R":
        state = NEXT[state]
        out.append((ROLE[state], text))
    return out, state, at + 1


def apply_repairs(rows: DataFrame, repairs: DataFrame) -> DataFrame:
    """``repairs`` (conv_id, audit, and counts) with repaired_sha256; rows as ``damaged`` gives them."""
    names = [f.name for f in PATHS_ARROW] + ["gaps"]
    none = lambda c, t: F.lit(None).cast(t).alias(c)
    lead = repairs.select("conv_id", F.lit(False).alias("body"), none("timed", "boolean"), none("turn", "long"), none("key", "binary"), none("role", "string"),
                          none("text", "string"), none("copies", "long"), F.struct(*names[1:]).alias("repair"))
    body = rows.filter("copies > 0").select("conv_id", F.lit(True).alias("body"), F.col("turn").isNotNull().alias("timed"), "turn", turn_key(F.col("role"), F.col("text")).alias("key"),
                                            "role", "text", "copies", none("repair", lead.schema["repair"].dataType))
    order = ["conv_id", "body", "timed", "turn", "key"]
    dealt = lead.unionByName(body).repartition(n_partitions(rows.sparkSession), "conv_id").sortWithinPartitions(*order)

    def run(batches):
        now = None  # [conversation, its repair, state, place in the audit, hash, whether a turn was hashed]

        def put(turns):
            for role, text in turns:
                now[4].update((("\n" if now[5] else "") + f"{role}:{text}").encode("utf-8", "surrogatepass"))
                now[5] = True

        def row():
            repair = now[1]
            for _ in repair["audit"][now[3] :]:  # inserts after the last row
                now[2] = NEXT[now[2]]
                put([(ROLE[now[2]], "")])
            return (now[0], *(repair[c] for c in names[1:]), now[4].hexdigest())

        for batch in batches:
            out = []
            for part, _ in column_slices(batch, "text"):
                for conv, body, role, text, copies, repair in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    if not body:
                        if now is not None:
                            out.append(row())
                        now = [conv, repair, START, 0, hashlib.sha256(), False]
                        continue
                    for _ in range(copies):
                        turns, now[2], now[3] = edited(now[1]["audit"], now[2], now[3], role, text)
                        put(turns)
            yield from as_batches(out, REPAIRED_ARROW)
        if now is not None:
            yield from as_batches([row()], REPAIRED_ARROW)

    return dealt.select("conv_id", "body", "role", "text", "copies", "repair").mapInArrow(run, ddl(REPAIRED_ARROW))


def repair(rows: DataFrame, segment_rows: int = SEGMENT) -> DataFrame:
    """One row for each conversation of ``rows`` (conv_id, turn, role, text, copies)."""
    known = cut_lineage(facts(rows))
    turns = known.filter("copies > 0").groupBy("conv_id", "turn").agg(F.lit(1).alias("_one")).groupBy(F.col("conv_id").alias("_c")).agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).alias("gaps"))
    solved = paths(segments(known, segment_rows)).join(turns, F.col("conv_id").eqNullSafe(F.col("_c")), "left").drop("_c")
    return apply_repairs(rows, solved.withColumn("gaps", F.coalesce("gaps", F.lit(0))))


def repair_damaged(conversations: DataFrame) -> DataFrame:
    """Damage, then repair; every conv_id of the table has its row."""
    own = repair(damaged(conversations))
    return own.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
