"""The log of decisions against a plain fold of it."""

import random

from gleaner.operators import decisions

FILES = "id long, session_id long, pixel_hash string, status string"
ACTIONS = "id long, session_id long, file_id long, action string, scope string, decided_at string, executed_at string"
LOG = "n long, file_id long, action string, scope string, decided_at string"


def folded(actions, files, log):
    state = {(s, f): (i, a, sc, at, ex) for i, s, f, a, sc, at, ex in actions}
    by_id = {f[0]: f for f in files}
    for _, file_id, action, scope, at in sorted(log):
        if action not in ("keep", "delete", "ignore") or scope not in ("file", "folder") or file_id not in by_id:
            continue
        _, session, pixel_hash, _ = by_id[file_id]
        key = (session, file_id)
        if key in state and state[key][1] == action:
            del state[key]
            continue
        old = state.get(key)
        state[key] = (old and old[0], action, scope, at, old and old[4])
        if action == "delete" and pixel_hash:
            open_ = [f[0] for f in files if f[1:] == (session, pixel_hash, "active") and (session, f[0]) not in state]
            if len(open_) == 1:
                state[session, open_[0]] = (None, "keep", "file", at, None)
    return sorted((s, f, a, sc, at, ex) for (s, f), (_, a, sc, at, ex) in state.items())


def after(spark, actions, files, log):
    got = decisions.decide(spark.createDataFrame(actions, ACTIONS), spark.createDataFrame(files, FILES), spark.createDataFrame(log, LOG))
    return sorted(((r.session_id, r.file_id, r.action, r.scope, r.decided_at, r.executed_at) for r in got.collect()), key=lambda r: r[:2])


def test_equals_a_fold_one_by_one(spark):
    made = random.Random(6)
    files = [(i, made.choice([1, 2]), made.choice(["a", "b", "c", None, "d"]), made.choice(["active", "active", "deleted"])) for i in range(40)]
    actions = [(i, files[i][1], i, made.choice(["keep", "delete", "ignore"]), "file", "2024", made.choice([None, "x"])) for i in range(0, 40, 5)]
    log = [(n, made.randrange(42), made.choice(["delete", "delete", "keep", "ignore", "share"]), made.choice(["file", "folder", "all"]), f"t{n}") for n in range(300)]
    # A session's file may be decided under its own session only; ids of cleared rows are gone.
    assert after(spark, actions, files, log) == folded(actions, files, log)


def test_toggles_and_the_last_undecided_file(spark):
    files = [(1, 1, "h", "active"), (2, 1, "h", "active"), (3, 1, "h", "active"), (4, 1, None, "active"), (5, 1, "h", "deleted")]
    log = [(1, 1, "delete", "file", "a"), (2, 2, "delete", "file", "b"), (3, 4, "keep", "file", "c"), (4, 4, "keep", "file", "d"), (5, 3, "keep", "file", "e"), (6, 2, "delete", "file", "f"), (7, 2, "delete", "folder", "g")]
    got = after(spark, [], files, log)
    assert got == folded([], files, log)
    assert (1, 3, "keep", "file", "g", None) in got  # kept at b, cleared at e, kept again at g


def test_a_hash_of_many_files_is_folded_by_file(spark):
    files = [(i, 1, "hot", "active") for i in range(3000)]
    log = [(n, n % 700, "delete", "file", f"t{n}") for n in range(2100)]
    assert after(spark, [], files, log) == folded([], files, log)


def test_no_log_changes_nothing(spark):
    actions = [(1, 1, 1, "keep", "file", "a", None)]
    assert after(spark, actions, [(1, 1, "h", "active")], []) == folded(actions, [(1, 1, "h", "active")], [])
    assert after(spark, [], [], [(1, 1, "keep", "file", "a")]) == []
