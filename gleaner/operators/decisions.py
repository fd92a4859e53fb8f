"""The log of single decisions, folded in its order into the table of decisions.

A decision is a toggle: the action that a file has already clears it, another
replaces it. A deletion that leaves one active file of the hash undecided
keeps that file. So the end depends on the order, within a hash.

Files depend on each other only where all active files of a hash but one at
most are decided or named in the log; elsewhere no file is ever the last
undecided one, and each file is folded by itself. So keys are small even for
a hash that a great share of the files has, unless the log names them all, and
then the fold streams through its part of the log with one entry per file.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner import schemas

ACTIONS, SCOPES = schemas.ALLOWED["file_actions", "action"], schemas.ALLOWED["file_actions", "scope"]
_STEPS = ("session_id", "fold", "together", "n", "file_id", "open", "action", "scope", "decided_at")
_AFTER = "session_id long, file_id long, action string, scope string, decided_at string, cleared boolean"


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by (session, fold) and n; those without n say what a file begins with. Gives what the touched files end with."""
    now, state, undecided, out = None, {}, set(), []

    def ended() -> None:
        out.extend((now[0], f, *end) for f, end in state.items() if end[3] is not None)

    def batch() -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.bool_())
        made = pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], kind) for i, kind in enumerate(kinds)], ["session_id", "file_id", "action", "scope", "decided_at", "cleared"])
        out.clear()
        return made

    for rows in batches:
        for session, fold, together, n, file_id, is_open, action, scope, at in zip(*(rows.column(c).to_pylist() for c in _STEPS), strict=True):
            if (session, fold) != now:
                if now:
                    ended()
                now, state, undecided = (session, fold), {}, set()
            if n is None:
                state[file_id] = (action, scope, at, None)  # the last: None as long as nothing was changed, else whether it was cleared
                if is_open:
                    undecided.add(file_id)
                continue
            before, cleared = state[file_id][0], bool(state[file_id][3])
            if before == action:
                state[file_id] = (None, None, None, True)
                if is_open is not None and together:
                    undecided.add(file_id)
                continue
            state[file_id] = (action, scope, at, cleared)
            undecided.discard(file_id)
            if action == "delete" and together and len(undecided) == 1:
                last = undecided.pop()
                state[last] = ("keep", "file", at, bool(state[last][3]))
        if out:
            yield batch()
    if now:
        ended()
    if out:
        yield batch()


def valid(log: DataFrame) -> DataFrame:
    """The entries that count: of a known action and scope."""
    return log.filter(F.col("action").isin(*ACTIONS) & F.col("scope").isin(*SCOPES))


def decide(actions: DataFrame, files: DataFrame, log: DataFrame) -> DataFrame:
    """The decisions after a log (n, file_id, action, scope, decided_at), taken in the order of n.

    Entries of unknown files, actions or scopes do nothing. What was executed
    stays so unless the decision was cleared in between. An entry belongs to
    the session of its file.
    """
    known = files.select(F.col("id").alias("file_id"), "session_id", "pixel_hash", (F.col("status") == "active").alias("active"))
    steps = valid(log).select("n", "file_id", "action", "scope", "decided_at").join(known, "file_id")
    touched = steps.select("file_id").distinct().withColumn("touched", F.lit(True))
    decided = actions.select("session_id", "file_id", F.col("action").alias("had"), F.col("scope").alias("had_scope"), F.col("decided_at").alias("had_at"))
    hashes = steps.filter("pixel_hash IS NOT NULL").select("session_id", "pixel_hash").distinct()
    # Of each touched hash: how many active files are undecided and not in the log, and the least of them.
    others = known.filter("active").join(hashes, ["session_id", "pixel_hash"]).join(touched, "file_id", "left_anti").join(decided, ["session_id", "file_id"], "left_anti")
    left = others.groupBy("session_id", "pixel_hash").agg(F.count("*").alias("left"), F.min("file_id").alias("last"))
    together = F.col("pixel_hash").isNotNull() & (F.coalesce("left", F.lit(0)) <= 1)
    fold = F.when(together, F.concat(F.lit("h"), F.col("pixel_hash"))).otherwise(F.concat(F.lit("f"), F.col("file_id").cast("string")))
    # open: whether an active file of a hash is undecided; null for files that can't be the last one
    entries = steps.join(left, ["session_id", "pixel_hash"], "left").select("session_id", fold.alias("fold"), together.alias("together"), "n", "file_id", F.when(F.col("active"), F.lit(False)).alias("open"), "action", "scope", "decided_at")
    begins = known.join(touched, "file_id").join(left, ["session_id", "pixel_hash"], "left").join(decided, ["session_id", "file_id"], "left")
    none = F.lit(None).cast("long").alias("n")
    begins = begins.select("session_id", fold.alias("fold"), together.alias("together"), none, "file_id", (together & F.col("active") & F.col("had").isNull()).alias("open"), F.col("had").alias("action"), F.col("had_scope").alias("scope"), F.col("had_at").alias("decided_at"))
    text = lambda c: F.lit(None).cast("string").alias(c)
    last = left.filter("left = 1").select("session_id", F.concat(F.lit("h"), F.col("pixel_hash")).alias("fold"), F.lit(True).alias("together"), none, F.col("last").alias("file_id"), F.lit(True).alias("open"), text("action"), text("scope"), text("decided_at"))
    whole = begins.unionByName(last).unionByName(entries)
    after = whole.repartition("session_id", "fold").sortWithinPartitions("session_id", "fold", F.asc_nulls_first("n")).mapInArrow(_fold, _AFTER)
    new = after.select("session_id", "file_id", *[F.col(c).alias(f"new_{c}") for c in ("action", "scope", "decided_at")], "cleared")
    joined = actions.withColumn("there", F.lit(True)).join(new, ["session_id", "file_id"], "full_outer").filter("cleared IS NULL OR new_action IS NOT NULL")
    pick = {c: F.when(F.col("cleared").isNull(), F.col(c)).otherwise(F.col(f"new_{c}")) for c in ("action", "scope", "decided_at") if c in actions.columns}
    if "executed_at" in actions.columns:
        pick["executed_at"] = F.when(~F.coalesce("cleared", F.lit(False)), F.col("executed_at"))
    return joined.withColumns(pick).select(*actions.columns)


def group_actions(actions: DataFrame, files: DataFrame, touched: DataFrame) -> DataFrame:
    """What a change answers: session_id, pixel_hash, file_id, action of the active, decided files of every hash of the touched files (file_id)."""
    key = ["session_id", "pixel_hash"]
    hashes = files.join(touched.select(F.col("file_id").alias("id")).distinct(), "id").filter("pixel_hash IS NOT NULL").select(*key).distinct()
    members = files.filter(F.col("status") == "active").join(hashes, key).select(*key, F.col("id").alias("file_id"))
    return members.join(actions.select("session_id", "file_id", "action"), ["session_id", "file_id"]).select(*key, "file_id", "action")
