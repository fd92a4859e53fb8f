"""Conversation repair against a search over all edits."""

import hashlib
import itertools
import random
import re
import zlib

from gleaner.llm import conversation_repair as cr

SCHEMA = "conv_id long, turn long, role string, text string"


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        m = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if m:
            text = "" if m == 1 else re.sub("[.!?]", "", text) if m == 2 else text
            out += [(conv, turn, "user" if m == 4 else role, text)] * (2 if m == 3 else 1)
    return out


def searched(turns):
    """(cost, audit, repaired) of the best edits, over every string of edits of up to two inserts at a place."""
    best = (10**9, "", "")

    def walk(i, roles, audit, cost, lines):
        nonlocal best
        if cost > best[0] or not re.fullmatch(r"s?(ua)*u?", roles):
            return
        if i == len(turns) and re.fullmatch(r"(s?(ua)+)?", roles):
            best = min(best, (cost, audit, "\n".join(lines)))
        if not audit.endswith("II"):
            for role in ("user", "assistant"):
                walk(i, roles + role[0], audit + "I", cost + 2, [*lines, role + ":"])
        if i < len(turns):
            role, text, fault = turns[i]
            walk(i + 1, roles, audit + "D", cost + 3, lines)
            if fault not in ("blank", "duplicate"):
                more = fault == "truncated"
                if role[:1] in ("s", "u", "a"):
                    walk(i + 1, roles + role[0], audit + "K", cost + more, [*lines, f"{role}:{text}"])
                for new in ("user", "assistant"):
                    walk(i + 1, roles + new[0], audit + "R", cost + 2 + more, [*lines, f"{new}:{text}"])

    walk(0, "", "", 0, [])
    return best


def by_brute_force(rows, after):
    out = []
    for conv in {r[0] for r in rows}:
        mine = sorted((r for r in after if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), r[3].encode()))
        seen, turns, counts = set(), [], {"blank": 0, "duplicate": 0, "truncated": 0}
        for _, _, role, text in mine:
            bare = text.strip(" \t\n\x0b\x0c\r")
            fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None
            seen.add((role, text))
            turns.append((role, text, fault))
            if fault:
                counts[fault] += 1
        numbers = [r[1] for r in mine if r[1] is not None]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(turns))
        cost, audit, repaired = searched(turns) if turns else (0, "", "")
        out.append((conv, gaps, *counts.values(), illegal, cost, audit, hashlib.sha256(repaired.encode()).hexdigest()))
    return sorted(out, key=repr)


def digests(spark, rows, damage=False, **how):
    turns = spark.createDataFrame(rows, SCHEMA)
    found = cr.digest(cr.repair(cr.damaged(turns) if damage else turns, **how), turns)
    return sorted((tuple(r) for r in found.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256").collect()), key=repr)


def messy(n, turns, seed):
    made = random.Random(seed)
    rows = []
    for conv in range(n):
        for turn in range(made.randint(1, turns)):
            role = made.choice(["system", "user", "user", "assistant", "assistant", "tool", "", None])
            text = made.choice(["Yes.", "No!", "cut", "  ", "", None, "So? \n", "Yes.\x1c", f"t{turn}.", "a ."])
            rows.append((made.choice([conv, conv, conv, None]), made.choice([turn, turn, turn, turn + 2, None]), role, text))
    return rows


def test_equals_a_search_over_all_edits(spark):
    rows = [r for r in messy(40, 6, 1) if r[0] is not None]
    want = by_brute_force(rows, [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows])
    assert digests(spark, rows) == want
    assert digests(spark, rows, segment_bits=1, batch_turns=3) == want  # segments of two turns, joined pairwise


def test_damage_is_the_contracts(spark):
    rows = [(None, t, "user", "One.") for t in range(3)] + [r for r in messy(60, 5, 2) if r[0] is not None]
    assert digests(spark, rows, damage=True) == by_brute_force(rows, damaged(rows))


def test_conversation_without_turns_and_empty_table(spark):
    gone = next(i for i in range(500) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    assert digests(spark, [(gone, 0, "user", "Hi.")], damage=True) == [(gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
    assert digests(spark, [], damage=True) == []


def test_long_conversation_in_segments_equals_one_segment(spark):
    rows = [(5, t, ("user", "assistant", "user")[t % 3], f"Turn {t}" + ".!? "[t % 4]) for t in range(700)] + [(6, 0, "user", "word. " * 200_000)]
    once = digests(spark, rows, segment_bits=20)
    assert once == digests(spark, rows, segment_bits=3, batch_turns=50) == digests(spark, rows)
    assert len(once[0][7]) > 700


def test_edits_give_the_repaired_turns(spark):
    turns = spark.createDataFrame([(1, 0, "user", "Hi.", 1, 2), (1, 1, "user", "Oh.", 1, 2), (1, 2, "assistant", " ", 1, 2)], SCHEMA + ", pos int, key int")
    rows = [(r.place, r.edit, r.old_role, r.role, r.text, r.fault) for r in cr.repair(turns).collect()]
    assert rows == [(0, "K", "user", "user", "Hi.", None), (1, "R", "user", "assistant", "Oh.", None), (2, "D", "assistant", "assistant", " ", "blank")]
