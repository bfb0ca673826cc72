"""Conversation structure repair by composing weighted finite-state machines.

A conversation is an acceptor: its rows in order, each a symbol made of its role's initial and its fault. The edit transducer keeps a row (K, cost 0), gives it
the other role (R, 2), deletes it (D, 3) or inserts one (I, 2); a grammar accepts role sequences ``(s?(ua)+)?``. The composition is formed lazily: a state is a
row's position and a grammar state, and what leads from one position to the next is worked out once for each symbol and each vector of the grammar states' costs-to-go that occur
(relative to the least of them there are few), then looked up. Weights are (cost, label string), compared in that order; the labels that leave a state differ, so the least string of equal cost
begins with the least label, and one label a state stands for it.

The shortest path runs through Spark in two passes over rows that one shuffle deals by conversation: from the last row to the first, which notes with each row the best labels from every
grammar state, then from the first to the last, which follows them. Both stream over sorted rows with a state of four numbers, so neither a conversation's length nor its texts are
held; the sorts spill. A conversation is read in order by one task, as its order and its digest demand; its audit, a byte an edit, is the only thing that grows with it.

Defined results: null roles and texts count as one space, a null conv_id is a conversation of its own, null turns come first; rows of one turn go by role and text; a role counts
by its first character, and one that isn't s, u or a can't be kept; an empty table gives no rows; no other column than those named is read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skyspark.llm import common as C
from skyspark.llm.sharding import crc_step

SPACES = " \t\n\x0b\x0c\r"
RELABEL, DELETE, INSERT, CUT_SHORT = 2, 3, 2, 1
#: Grammar: by state, what each initial leads to. 0 begins, 1 follows a system row, 2 a user row, 3 an assistant row.
GRAMMAR = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
ACCEPTING = (0, 3)
#: The role that may be inserted or given, by state.
GIVEN = tuple(next(c for c in "ua" if c in moves) for moves in GRAMMAR)
ROLES = {"u": "user", "a": "assistant"}
FAULTS = ("", "blank", "duplicate", "truncated")
FAR = 1 << 60


def relaxed(cost: list[int], first: list[str]) -> tuple[list[int], list[str]]:
    """Costs-to-go and first labels of a position's states, once inserted rows, which stay at the position, are allowed."""
    for _ in GRAMMAR:  # a path of insertions that comes back to a state is never best
        for g, moves in enumerate(GRAMMAR):
            c = INSERT + cost[moves[GIVEN[g]]]
            if (c, "I") < (cost[g], first[g]):
                cost[g], first[g] = c, "I"
    return cost, first


def labels(first: list[str], g: int) -> str:
    """Labels from grammar state g up to the one that takes the row."""
    out = ""
    while first[g] == "I":
        out, g = out + "I", GRAMMAR[g][GIVEN[g]]
    return out + first[g]


class Composition:
    """Costs-to-go of the grammar's states, relative to their least, and the lazily made moves between them."""

    def __init__(self):
        cost, first = relaxed([0 if g in ACCEPTING else FAR for g in range(len(GRAMMAR))], ["" if g in ACCEPTING else "~" for g in range(len(GRAMMAR))])
        self.end, self.last = self.least(cost), [labels([f.replace("~", "") for f in first], g) for g in range(len(GRAMMAR))]
        self.known: dict[tuple[tuple[int, ...], str, int], tuple[tuple[int, ...], str]] = {}

    @staticmethod
    def least(cost: list[int]) -> tuple[int, ...]:
        low = min(cost)
        return tuple(c - low for c in cost)

    def before(self, ahead: tuple[int, ...], initial: str, fault: int) -> tuple[tuple[int, ...], str]:
        """The costs before a row, from those behind it, and the best labels from each state, joined by commas."""
        key = (ahead, initial, fault)
        if key not in self.known:
            more = CUT_SHORT if FAULTS[fault] == "truncated" else 0
            cost, first = [], []
            for g, moves in enumerate(GRAMMAR):
                ways = [(DELETE + ahead[g], "D")]
                if FAULTS[fault] not in ("blank", "duplicate"):
                    if initial in moves:
                        ways.append((more + ahead[moves[initial]], "K"))
                    ways.append((RELABEL + more + ahead[moves[GIVEN[g]]], "R"))
                c, label = min(ways)
                cost.append(c)
                first.append(label)
            cost, first = relaxed(cost, first)
            self.known[key] = self.least(cost), ",".join(labels(first, g) for g in range(len(GRAMMAR)))
        return self.known[key]


def initial(role: str) -> str:
    """The grammar's letter of a role, or none."""
    return role[:1] if role[:1] in ("s", "u", "a") else ""


def backward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (conv_id, turn, role, text, fault) from a conversation's last to its first, with ``left``, how many come after, and ``labels``. Rows of null fault are absent."""
    machine, now, left = Composition(), (None, False), 0
    ahead = machine.end
    for b in C.slices(batches, 1000):
        conv, role, fault = [b.column(k).to_pylist() for k in (0, 2, 4)]
        lefts, found = [], []
        for c, r, f in zip(conv, role, fault, strict=True):
            if (c, True) != now:
                now, left, ahead = (c, True), 0, machine.end
            lefts.append(left)
            left += 1
            if f is None:
                found.append("")
            else:
                ahead, way = machine.before(ahead, initial(r), f)
                found.append(way)
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(lefts, pa.int64()), pa.array(found, pa.string())], ["conv_id", "turn", "role", "text", "fault", "left", "labels"])


EDITED = ("conv_id", "at", "edit", "fault", "illegal", "turn", "role", "text")
EDITED_TYPES = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.bool_(), pa.int64(), pa.string(), pa.string())


def forward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edited conversations from what ``backward`` noted, each in order: a row for each edit, with the role and text that it leaves (null where deleted). Absent rows have a null edit."""
    machine, now, g, at, before = Composition(), None, 0, 0, None

    def closing(out):
        nonlocal g, at
        for _ in machine.last[g] if now else "":
            out.append((now[0], at, "I", None, False, None, ROLES[GIVEN[g]], ""))
            g, at = GRAMMAR[g][GIVEN[g]], at + 1

    def batch(out):
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(EDITED_TYPES)], list(EDITED))

    for b in C.slices(batches, 1000):
        out = []
        conv, turns, roles, texts, faults, _, ways = [b.column(k) for k in range(7)]
        for i, (c, turn, role, fault, way) in enumerate(zip(*[x.to_pylist() for x in (conv, turns, roles, faults, ways)], strict=True)):
            if now is None or c != now[0]:
                closing(out)
                now, g, at, before = (c,), 0, 0, None
            if fault is None:
                out.append((c, None, None, None, False, turn, None, None))
                continue
            illegal = before is not None and before + role[:1] not in ("su", "ua", "au")
            before = role[:1]
            for edit in way.split(",")[g]:
                named = FAULTS[fault] or None
                if edit == "I":
                    out.append((c, at, edit, None, False, None, ROLES[GIVEN[g]], ""))
                elif edit == "D":
                    out.append((c, at, edit, named, illegal, turn, None, None))
                else:
                    out.append((c, at, edit, named, illegal, turn, role if edit == "K" else ROLES[GIVEN[g]], texts[i].as_py()))
                if edit != "D":
                    g = GRAMMAR[g][initial(role) if edit == "K" else GIVEN[g]]
                at += 1
        yield batch(out)
    out = []
    closing(out)
    yield batch(out)


SUMMARY = ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


class Summary:
    """Running figures of one conversation."""

    def __init__(self, conv_id):
        self.conv_id, self.turns, self.low, self.high, self.turn = conv_id, 0, None, None, None
        self.faults, self.illegal, self.cost, self.audit = dict.fromkeys(FAULTS[1:], 0), 0, 0, bytearray()
        self.digest, self.rows = hashlib.sha256(), 0

    def add(self, edit, fault, illegal, turn, role, text) -> None:
        self.audit += edit.encode()
        if edit != "I":
            if turn is not None:  # turns come in order
                self.turns += self.turn is None or turn != self.turn
                self.low, self.high, self.turn = turn if self.low is None else self.low, turn, turn
            if fault:
                self.faults[fault] += 1
            self.illegal += illegal
        self.cost += {"K": 0, "R": RELABEL, "D": DELETE, "I": INSERT}[edit] + (CUT_SHORT if fault == "truncated" and edit != "D" else 0)
        if edit != "D":
            self.digest.update(f"{chr(10) if self.rows else ''}{role}:{text}".encode("utf-8", "surrogatepass"))
            self.rows += 1

    def row(self) -> tuple:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return (self.conv_id, gaps, *self.faults.values(), self.illegal, self.cost, self.audit.decode(), self.digest.hexdigest())


def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row of SUMMARY for each conversation of what ``forward`` gives."""
    kinds = [pa.int64()] * 7 + [pa.string()] * 2
    now = None

    def batch(out):
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], list(SUMMARY))

    for b in batches:
        out = []
        for c, _, *rest in zip(*[x.to_pylist() for x in b.columns], strict=True):
            if now is None or now.conv_id != c:
                if now is not None:
                    out.append(now.row())
                now = Summary(c)
            if rest[0] is not None:
                now.add(*rest)
        yield batch(out)
    if now is not None:
        yield batch([now.row()])


def noted(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", absent: str | None = None) -> DataFrame:
    """Rows with their fault and the labels of ``backward``, dealt by conversation and sorted from first to last inside partitions. Rows whose ``absent`` column is true stand for their conversation only."""
    gone = F.coalesce(F.col(absent), F.lit(False)) if absent else F.lit(False)
    plain = rows.select(
        F.col(conv_id).cast("long").alias("conv_id"), F.col(turn).cast("long").alias("turn"), gone.alias("gone"),
        F.when(~gone, F.coalesce(F.col(role), F.lit(" "))).alias("role"), F.when(~gone, F.coalesce(F.col(text), F.lit(" "))).alias("text"),
    ).repartition("conv_id")
    trimmed = F.rtrim(F.col("text"), F.lit(SPACES))
    seen = Window.partitionBy("conv_id", "gone", "role", "digest").orderBy(F.col("turn").asc_nulls_first())
    fault = F.when(F.col("gone"), None).when(trimmed == "", 1).when(F.col("again"), 2).when(~F.substring(trimmed, -1, 1).isin(".", "!", "?"), 3).otherwise(0)
    facts = plain.withColumn("digest", F.sha2(F.col("text").cast("binary"), 256)).withColumn("again", F.row_number().over(seen) > 1).withColumn("fault", fault.cast("int"))
    last_first = [F.col("turn").desc_nulls_last(), F.col("role").desc_nulls_last(), F.col("text").desc_nulls_last(), F.col("again").desc()]
    sorted_ = facts.sortWithinPartitions("conv_id", *last_first).select("conv_id", "turn", "role", "text", "fault")
    back = sorted_.mapInArrow(backward, "conv_id long, turn long, role string, text string, fault int, left long, labels string")
    return back.sortWithinPartitions("conv_id", F.col("left").desc())


def repair(rows: DataFrame, **columns) -> DataFrame:
    """The cheapest edits of every conversation: conv_id, at (from 0), edit (K, R, D or I), fault, illegal, turn, and the role and text that stay. The repaired conversation is what isn't D, by ``at``."""
    return noted(rows, **columns).mapInArrow(forward, "conv_id long, at long, edit string, fault string, illegal boolean, turn long, role string, text string").where(F.col("edit").isNotNull())


def audited(rows: DataFrame, **columns) -> DataFrame:
    """A row of figures for each conversation: those of SUMMARY, from its edited rows as they pass."""
    return noted(rows, **columns).mapInArrow(lambda batches: summarise(forward(batches)), ", ".join(f"{c} {'string' if c in SUMMARY[-2:] else 'long'}" for c in SUMMARY))


def damage(rows: DataFrame) -> DataFrame:
    """conversations with planted faults, by a hash of conversation and turn: conv_id, turn, role, text, absent."""
    named = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.pmod(F.crc32(F.concat(named("conv_id"), F.lit(":"), named("turn")).cast("binary")), F.lit(20))
    plain = rows.select("conv_id", "turn", named("role").alias("role"), named("text").alias("text"), kind.alias("kind"))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    twice = F.explode(F.array_repeat(F.lit(0), F.when(F.col("kind") == 3, 2).otherwise(1)))
    return plain.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("kind") == 0).alias("absent"), twice.alias("copy")).drop("copy")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op13: all conversations, damaged and repaired."""
    return audited(damage(C.table(spark, sf_dir, "conversations")), absent="absent")


SQL = rf"""
WITH RECURSIVE raw AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
  xor(list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(hex(encode(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '))), '..'), lambda p: ('0x' || p)::BIGINT)), lambda a, v: {crc_step()}), 4294967295) % 20 AS kind
  FROM conversations),
damaged AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
  CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM raw, unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) WHERE kind <> 0),
seen AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST) > 1 AS again, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS trimmed FROM damaged),
rows_ AS (SELECT conv_id, turn, role, text, left(role, 1) AS i, coalesce(lag(left(role, 1)) OVER w || left(role, 1) NOT IN ('su', 'ua', 'au'), false) AS illegal, row_number() OVER w AS pos,
  CASE WHEN trimmed = '' THEN 1 WHEN again THEN 2 WHEN right(trimmed, 1) NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS fault
  FROM seen WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, again)),
grammar(g, i, h) AS (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)),
ins(g, h, n, s) AS (SELECT DISTINCT g, g, 0, '' FROM grammar UNION ALL SELECT ins.g, x.h, n + 1, s || 'I' FROM ins JOIN grammar x ON x.g = ins.h AND x.i <> 's' WHERE n < 3),
edit AS (SELECT g, i, 'K' AS label, 0 AS cost, h FROM grammar UNION ALL SELECT g, NULL, 'R', 2, h FROM grammar WHERE i <> 's' UNION ALL SELECT DISTINCT g, NULL, 'D', 3, g FROM grammar),
path(conv_id, pos, g, w) AS (
  SELECT DISTINCT conv_id, 0::BIGINT, 0, struct_pack(cost := 0::BIGINT, audit := '') FROM conversations
  UNION ALL
  SELECT p.conv_id, r.pos, e.h, min(struct_pack(cost := p.w.cost + 2 * ins.n + e.cost + CASE WHEN r.fault = 3 AND e.label <> 'D' THEN 1 ELSE 0 END, audit := p.w.audit || ins.s || e.label))
  FROM path p JOIN rows_ r ON r.conv_id IS NOT DISTINCT FROM p.conv_id AND r.pos = p.pos + 1 JOIN ins ON ins.g = p.g
  JOIN edit e ON e.g = ins.h AND (e.label = 'D' OR r.fault NOT IN (1, 2) AND (e.label = 'R' OR e.i = r.i)) GROUP BY 1, 2, 3),
ends AS (SELECT conv_id, max(pos) AS pos FROM path GROUP BY 1),
best AS (SELECT p.conv_id, min(struct_pack(cost := p.w.cost + 2 * ins.n, audit := p.w.audit || ins.s)) AS w
  FROM path p JOIN ends ON ends.conv_id IS NOT DISTINCT FROM p.conv_id AND ends.pos = p.pos JOIN ins ON ins.g = p.g AND ins.h IN (0, 3) GROUP BY 1),
steps AS (SELECT b.conv_id, k, substr(b.w.audit, k::INT, 1) AS label, k - len(replace(substr(b.w.audit, 1, k::INT), 'I', '')) AS inserted FROM best b, unnest(range(1, len(b.w.audit) + 1)) u(k)),
left_ AS (SELECT s.conv_id, s.k, s.label, r.role, r.text, row_number() OVER w AS j, coalesce(first_value(s.label || r.i) OVER w, '') = 'Ks' AS headed
  FROM steps s LEFT JOIN rows_ r ON s.label <> 'I' AND r.conv_id IS NOT DISTINCT FROM s.conv_id AND r.pos = s.k - s.inserted WHERE s.label <> 'D' WINDOW w AS (PARTITION BY s.conv_id ORDER BY s.k)),
said AS (SELECT conv_id, string_agg(CASE WHEN label = 'K' THEN role WHEN (j - headed::INT) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN label = 'I' THEN '' ELSE text END, chr(10) ORDER BY k) AS said FROM left_ GROUP BY 1),
facts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate,
  count(*) FILTER (fault = 3) AS truncated, count(*) FILTER (illegal) AS illegal FROM rows_ GROUP BY 1)
SELECT b.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  b.w.cost AS cost, b.w.audit AS audit, sha256(coalesce(said, '')) AS repaired_sha256
FROM best b LEFT JOIN facts f ON f.conv_id IS NOT DISTINCT FROM b.conv_id LEFT JOIN said s ON s.conv_id IS NOT DISTINCT FROM b.conv_id
"""
