"""Conversation structure repair: the cheapest edits that make a conversation follow a grammar.

Roles, by their first letters, must read (s?(ua)+)?: nothing, or a system turn
at most and then user and assistant in turn. Edits are Keep, Rerole, Delete and
Insert; of equally cheap edits those whose letters come first in ASCII order.

Turns are dealt by range of (conversation, turn, role, text), so that a very
long conversation lies in many tasks, and are cut there into segments of
SEGMENT turns at most. Segments are hash-partitioned in batches, without their
texts. In a batch a DuckDB recursive query advances one turn for all segments,
keeping minimum cost and audit per state of the grammar, from each state that
a segment can begin in. Segments of one conversation are then joined pairwise
(min-plus products of 4 x 4 states), so that their number halves each round.
Of two equally cheap audits over the same turns neither begins with the other
(what follows it would be inserts, which cost), so the lesser stays the lesser
whatever comes after, and keeping one per state is exact.

The edits are applied in one pass over the turns in order, which streams; so
does the digest, which is one hash over a conversation and hence sequential.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import duckdb
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleaner.llm.shared import null_safe, written

#: Turns of a segment at most, as a power of two, and turns that a recursive query takes at once about.
SEGMENT_BITS, BATCH_TURNS = 8, 20_000
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
#: States of the grammar: nothing yet, after the system turn, after a user turn, after an assistant turn.
START, SYSTEM, USER, ASSISTANT = range(4)
#: The turn that may be made (by rerole or insert) in each state: its role and the state after it.
NEXT = {START: ("user", USER), SYSTEM: ("user", USER), USER: ("assistant", ASSISTANT), ASSISTANT: ("user", USER)}
#: Inserts that complete a conversation which ends in a state.
CLOSING = {START: "", SYSTEM: "II", USER: "I", ASSISTANT: ""}
NOT_SPACE = r"[^\x20\x09-\x0D]"
EDITS = "conv_id long, place long, edit string, turn long, old_role string, role string, text string, fault string"
DIGEST = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def kept_as(state: int, initial: str) -> int | None:
    """The state after a turn with this initial that is kept, or None where the grammar has no such turn."""
    if initial == "s":
        return SYSTEM if state == START else None
    role, to = NEXT[state]
    return to if initial == role[0] else None


def moves() -> list[tuple[int, str, bool, int, int, str]]:
    """What a turn can do: state before, initial, whether it must be deleted, state after, cost without truncation, edits.

    Inserts before the turn are part of its move; three would come back to a state at a cost, so two are enough.
    """
    out = []
    for initial in ("s", "u", "a", ""):
        for must in (False, True):
            for state in range(4):
                now = state
                for inserts in range(3):
                    pre, cost = "I" * inserts, INSERT * inserts
                    out.append((state, initial, must, now, cost + DELETE, pre + "D"))
                    if not must:
                        out.append((state, initial, must, NEXT[now][1], cost + REROLE, pre + "R"))
                        if (to := kept_as(now, initial)) is not None:
                            out.append((state, initial, must, to, cost, pre + "K"))
                    now = NEXT[now][1]
    return out


_WALK = f"""
WITH RECURSIVE walk(seg, i, origin, state, best) AS (
  SELECT s.seg, 0::BIGINT, o.state, o.state, {{'cost': 0::BIGINT, 'audit': ''}} FROM (SELECT DISTINCT seg FROM turns) s, (SELECT DISTINCT state FROM moves) o
  UNION ALL
  SELECT w.seg, w.i + 1, w.origin, m.after,
         min({{'cost': w.best.cost + m.cost + CASE WHEN t.truncated AND NOT m.deletes THEN {TRUNCATED} ELSE 0 END, 'audit': w.best.audit || m.edits}})
  FROM walk w JOIN turns t ON t.seg = w.seg AND t.i = w.i + 1 JOIN moves m ON m.state = w.state AND m.initial = t.initial AND m.must = t.must
  GROUP BY w.seg, w.i, w.origin, m.after
)
SELECT w.seg, w.origin, w.state, w.best.cost AS cost, w.best.audit AS audit FROM walk w JOIN (SELECT seg, max(i) AS i FROM turns GROUP BY seg) e ON e.seg = w.seg AND e.i = w.i
"""


def _walk_segments(batch_turns: int):
    """Rows (key, none, block, initial, must, truncated) come sorted by segment and place. Gives the costs and audits of each segment."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        con = duckdb.connect(config={"threads": 1})
        con.register("all_moves", pa.Table.from_pylist([dict(zip(("state", "initial", "must", "after", "cost", "edits"), m, strict=True)) for m in moves()]))
        con.execute("CREATE TABLE moves AS SELECT *, right(edits, 1) = 'D' AS deletes FROM all_moves")
        held, segs, i, now = {c: [] for c in ("seg", "i", "initial", "must", "truncated")}, [], 0, None

        def walked() -> pa.RecordBatch:
            con.register("given", pa.table({"seg": pa.array(held["seg"], pa.int64()), "i": pa.array(held["i"], pa.int64()), "initial": pa.array(held["initial"], pa.string()), "must": pa.array(held["must"], pa.bool_()), "truncated": pa.array(held["truncated"], pa.bool_())}))
            con.execute("CREATE OR REPLACE TABLE turns AS SELECT * FROM given")
            rows = con.execute(_WALK).fetchall()
            keys = [segs[r[0]] for r in rows]
            columns = [pa.array([k[c] for k in keys], kind) for c, kind in ((0, pa.int64()), (1, pa.bool_()), (2, pa.int64()))]
            columns += [pa.array([r[c] for r in rows], kind) for c, kind in ((1, pa.int32()), (2, pa.int32()), (3, pa.int64()), (4, pa.string()))]
            return pa.RecordBatch.from_arrays(columns, ["key", "none", "block", "origin", "state", "cost", "audit"])

        for batch in batches:
            for key, none, block, initial, must, cut in zip(*(batch.column(c).to_pylist() for c in ("key", "none", "block", "initial", "must", "truncated")), strict=True):
                if (key, none, block) != now:
                    if len(held["i"]) >= batch_turns:
                        yield walked()
                        held, segs = {c: [] for c in held}, []
                    now, i = (key, none, block), 0
                    segs.append(now)
                i += 1
                for c, value in (("seg", len(segs) - 1), ("i", i), ("initial", initial if initial in ("s", "u", "a") else ""), ("must", must), ("truncated", cut)):
                    held[c].append(value)
        if segs:
            yield walked()
        con.close()

    return run


def ordered_turns(turns: DataFrame) -> DataFrame:
    """turns (conv_id, turn, role, text; null role and text become one space), written, with pos in their order and the first fault of each.

    The order is by turn, null first, then by role and text, so that repeated turns have one too.
    """
    rows = turns.select(*null_safe("conv_id", "long"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    by = ["none", "key", F.asc_nulls_first("turn"), "role", "text"]
    # The place in ranges that are dealt and sorted is the place in the whole; writing fixes it. Segments are blocks of it.
    dealt = written(rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("pos", F.monotonically_increasing_id()).withColumn("sha", F.unhex(F.sha2("text", 256))), "turns")
    first = written(dealt.groupBy("key", "none", "role", "sha").agg(F.min("pos").alias("first")), "first-turns")
    blank = ~F.col("text").rlike(NOT_SPACE)
    whole = F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")
    fault = F.when(blank, "blank").when(F.col("pos") > F.col("first"), "duplicate").when(~whole, "truncated")
    return written(dealt.join(first, ["key", "none", "role", "sha"]).select("key", "none", "pos", "turn", "role", "text", fault.alias("fault")), "faults")


def audits(ordered: DataFrame, segment_bits: int = SEGMENT_BITS, batch_turns: int = BATCH_TURNS) -> DataFrame:
    """From ordered_turns(): key, none, cost, audit of each conversation."""
    conv = ["key", "none"]
    narrow = ordered.select(*conv, "pos", F.shiftright("pos", segment_bits).alias("block"), F.substring("role", 1, 1).alias("initial"), F.coalesce(F.col("fault").isin("blank", "duplicate"), F.lit(False)).alias("must"), F.coalesce(F.col("fault") == "truncated", F.lit(False)).alias("truncated"))
    segments = narrow.repartition(*conv, "block").sortWithinPartitions(*conv, "block", "pos").drop("pos").mapInArrow(_walk_segments(batch_turns), "key long, none boolean, block long, origin int, state int, cost long, audit string")
    walked = written(segments, "segments")
    count = walked.select(*conv, "block").distinct().groupBy(*conv).agg(F.count("*").alias("n"))
    sized = written(walked.join(count, conv), "sized-segments")
    done = sized.filter("n = 1 AND origin = 0").select(*conv, "state", "cost", "audit")
    many = sized.filter("n > 1")
    places = many.select(*conv, "block").distinct().withColumn("place", F.row_number().over(Window.partitionBy(*conv).orderBy("block")) - 1)
    left = written(many.join(places, [*conv, "block"]).select(*conv, "place", "n", "origin", "state", "cost", "audit"), "segments-0")
    most = left.agg(F.max("n")).first()[0] or 1
    step = 0
    while most > 1:
        step, most = step + 1, (most + 1) // 2
        pair = F.shiftright("place", 1).alias("pair")
        odd = left.filter("place % 2 = 1").select(*conv, pair, F.col("origin").alias("via"), F.col("state").alias("reached"), F.col("cost").alias("more"), F.col("audit").alias("rest"))
        even = left.filter("place % 2 = 0").select(*conv, pair, "place", "n", "origin", "state", "cost", "audit")
        both = even.join(odd, (even.key == odd.key) & (even.none == odd.none) & (even.pair == odd.pair) & (even.state == odd.via)).select(
            even.key, even.none, even.pair, "n", "origin", odd.reached.alias("state"), F.struct((F.col("cost") + F.col("more")).alias("cost"), F.concat("audit", "rest").alias("audit")).alias("best")
        )
        merged = both.groupBy(*conv, "pair", "n", "origin", "state").agg(F.min("best").alias("best")).select(*conv, F.col("pair").alias("place"), F.ceil(F.col("n") / 2).cast("long").alias("n"), "origin", "state", "best.cost", "best.audit")
        last = even.filter("place = n - 1").select(*conv, F.col("pair").alias("place"), F.ceil(F.col("n") / 2).cast("long").alias("n"), "origin", "state", "cost", "audit")
        now = written(merged.unionByName(last), f"segments-{step}")
        done = done.unionByName(now.filter("n = 1 AND origin = 0").select(*conv, "state", "cost", "audit"))
        left = now.filter("n > 1")
    rest = F.element_at(F.array(*[F.lit(CLOSING[s]) for s in range(4)]), F.col("state") + 1)
    best = F.min(F.struct((F.col("cost") + INSERT * F.length(rest)).alias("cost"), F.concat("audit", rest).alias("audit")))
    return done.groupBy(*conv).agg(best.alias("best")).select(*conv, "best.cost", "best.audit")


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by conversation, first one whose text is the audit (pos -1), then the turns in order. Gives a row per edit."""
    names = [c.split()[0] for c in EDITS.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string()]
    out: list[tuple] = []
    conv, audit, at, state = None, "", 0, START

    def inserts() -> None:
        nonlocal at, state
        while at < len(audit) and audit[at] == "I":
            role, state = NEXT[state]
            out.append((conv, at, "I", None, None, role, "", None))
            at += 1

    def batch() -> pa.RecordBatch:
        made = pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], kind) for i, kind in enumerate(kinds)], names)
        out.clear()
        return made

    for whole in batches:
        for lo in range(0, whole.num_rows, 256):
            part = whole.slice(lo, 256)
            for key, none, pos, turn, role, text, fault in zip(*(part.column(c).to_pylist() for c in ("key", "none", "pos", "turn", "role", "text", "fault")), strict=True):
                if pos < 0:
                    inserts()  # what ends the conversation before
                    conv, audit, at, state = None if none else key, text, 0, START
                    continue
                inserts()
                edit, now = audit[at], role
                if edit == "K":
                    state = kept_as(state, role[:1])
                elif edit == "R":
                    now, state = NEXT[state]
                out.append((conv, at, edit, turn, role, now, text, fault))
                at += 1
            yield batch()
    inserts()
    if out:
        yield batch()


def repair(turns: DataFrame, **how) -> DataFrame:
    """One row per edit: conv_id, place (from 0), edit (K, R, D or I), turn, old_role, role, text, fault (blank, duplicate, truncated or null).

    The repaired conversation is the rows that aren't deleted, by place; rows
    of a conversation lie together and in order. Null conv_id is a
    conversation of its own; null turns come first; null role or text is one
    space, which is blank or no role; repeated turns are duplicates; a
    conversation of any length is cut into segments. An empty table gives no
    rows; other columns are ignored.
    """
    ordered = ordered_turns(turns)
    plan = audits(ordered, **how)
    head = plan.select("key", "none", F.lit(-1).cast("long").alias("pos"), F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.col("audit").alias("text"), F.lit(None).cast("string").alias("fault"))
    return ordered.unionByName(head).repartition("none", "key").sortWithinPartitions("none", "key", "pos").mapInArrow(_apply, EDITS)


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in DIGEST.split(", ")]
    kinds = [pa.int64()] * 7 + [pa.string()] * 2
    now, seen, done = None, None, []

    def ended() -> tuple:
        gaps = seen["most"] - seen["least"] + 1 - seen["turns"] if seen["turns"] else 0
        return (now, gaps, seen["blank"], seen["duplicate"], seen["truncated"], seen["illegal"], seen["cost"], seen["audit"].decode(), seen["hash"].hexdigest())

    for whole in batches:
        for lo in range(0, whole.num_rows, 256):
            part = whole.slice(lo, 256)
            for conv, place, edit, turn, old, role, text, fault in zip(*(c.to_pylist() for c in part.columns), strict=True):
                if place == 0:
                    if seen:
                        done.append(ended())
                    now = conv
                    seen = {"least": None, "most": None, "turns": 0, "before": None, "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "cost": 0, "audit": bytearray(), "hash": hashlib.sha256(), "any": False}
                seen["audit"] += edit.encode()
                seen["cost"] += {"K": 0, "R": REROLE, "D": DELETE, "I": INSERT}[edit] + (TRUNCATED if fault == "truncated" and edit != "D" else 0)
                if edit != "D":
                    seen["hash"].update((("\n" if seen["any"] else "") + f"{role}:{text}").encode())
                    seen["any"] = True
                if edit != "I":
                    if fault:
                        seen[fault] += 1
                    if turn is not None:
                        seen["turns"] += turn != seen["most"]
                        seen["least"], seen["most"] = turn if seen["least"] is None else seen["least"], turn
                    if seen["before"] is not None:
                        seen["illegal"] += seen["before"] + old[:1] not in ("su", "ua", "au")
                    seen["before"] = old[:1]
        if done:
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in done], kind) for i, kind in enumerate(kinds)], names)
            done = []
    if seen:
        done.append(ended())
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in done], kind) for i, kind in enumerate(kinds)], names)


def digest(edits: DataFrame, conversations: DataFrame) -> DataFrame:
    """One row per conversation of `conversations` (conv_id): the faults before, the cost, the audit and the SHA-256 of what repair() made.

    gaps: turn numbers missing between the least and the most; illegal:
    neighbours among the turns before whose initials aren't su, ua or au.
    Conversations without turns have zeros and the hash of the empty text.
    """
    made = edits.mapInArrow(_digest, DIGEST).withColumnsRenamed({"conv_id": "of"})  # the edits of a conversation lie together and in order
    of = made.select(*null_safe("of"), *[c for c in made.columns if c != "of"])
    given = conversations.select(F.col("conv_id").cast("long").alias("conv_id")).distinct().select("conv_id", *null_safe("conv_id"))
    joined = given.join(of, ["key", "none"], "left").drop("key", "none")
    counts = {c: F.coalesce(c, F.lit(0).cast("long")) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")}
    return joined.withColumns(counts | {"audit": F.coalesce("audit", F.lit("")), "repaired_sha256": F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest()))})


def damaged(turns: DataFrame) -> DataFrame:
    """turns as the contract of the operator damages them, by crc32 of "conv_id:turn" modulo 20: dropped, emptied, without [.!?], repeated, or made the user's."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = turns.select("conv_id", "turn", text("role").alias("role"), text("text").alias("text"), F.pmod(F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn")).cast("binary")), F.lit(20)).alias("m")).filter("m <> 0")
    said = F.when(F.col("m") == 1, "").when(F.col("m") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    times = F.when(F.col("m") == 3, 2).otherwise(1)
    return rows.select("conv_id", "turn", F.when(F.col("m") == 4, "user").otherwise(F.col("role")).alias("role"), said.alias("text"), F.explode(F.array_repeat(F.lit(0), times)).alias("copy")).drop("copy")
