"""Repair of conversations and their prefix trie against brute force."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from ledgerloom.llm import repair

SF_DIR = "/root/testdata/sf0.01"
COLUMNS = "conv_id long, turn long, role string, text string"
SPACE = " \t\n\v\f\r"


def random_turns(seed: int, conversations: int = 40) -> list[tuple]:
    rng = random.Random(seed)
    roles = ["user", "assistant", "system", "user", "assistant", None, "", "tool", "unknown"]
    texts = ["Yes.", "No!", "cut", "a\n", "", "  \t", None, "Why?  ", "Yes.", "é."]
    rows = []
    for conv in range(conversations):
        turn = rng.randint(-3, 3)
        for _ in range(rng.choice([1, 2, 3, 5, 8, 30])):
            rows.append((conv * 7, rng.choice([turn, turn, turn, None]), rng.choice(roles), rng.choice(texts)))
            turn += rng.choice([0, 1, 1, 1, 3])
    return rows


def sha(text) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def digest(role: str, text: str) -> bytes:
    return hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()


def in_order(rows: list[tuple]) -> dict:
    """Per conversation: (turn, role, text) by turn, nulls first, then by digest."""
    groups = defaultdict(list)
    for conv, turn, role, text in rows:
        groups[conv].append((turn, role, text))
    key = lambda r: (r[0] is not None, r[0] or 0, digest(r[1], r[2]))
    return {c: sorted(g, key=key) for c, g in groups.items()}


def damaged_by_hand(rows: list[tuple]) -> list[tuple]:
    out = []
    for conv, turn, role, text in rows:
        names = [" " if v is None else str(v) for v in (conv, turn)]
        kind = zlib.crc32(":".join(names).encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind == 1:
            text = ""
        if kind == 2:
            text = "".join(c for c in text if c not in ".!?")
        if kind == 4:
            role = "user"
        out += [(conv, turn, role, text)] * {0: 0, 3: 2}.get(kind, 1)
    return out


def repaired_by_hand(rows: list[tuple]) -> tuple:
    """Every state's cheapest, then least, edits, carried forward over the rows of one conversation."""
    kept = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    forced = {"": "user", "s": "user", "u": "assistant", "a": "user"}
    counts, seen, illegal = [0, 0, 0], set(), 0
    best = {"": (0, "", ())}

    def with_inserts(states: dict) -> dict:
        for _ in range(3):
            for state, (cost, audit, out) in list(states.items()):
                role = forced[state]
                option = (cost + 5, audit + "I", (*out, f"{role}:"))
                states[role[0]] = min(states.get(role[0], option), option)
        return states

    for i, (_, role, text) in enumerate(rows):
        fault = 0
        if not text.strip(SPACE):
            fault = 1
        elif (role, text) in seen:
            fault = 2
        elif text.rstrip(SPACE)[-1] not in ".!?":
            fault = 3
        seen.add((role, text))
        if fault:
            counts[fault - 1] += 1
        illegal += i > 0 and rows[i - 1][1][:1] + role[:1] not in ("su", "ua", "au")
        after = {}
        for state, (cost, audit, out) in with_inserts(dict(best)).items():
            options = [(state, (cost + 2, audit + "D", out))]
            if fault not in (1, 2):
                extra = 5 if fault == 3 else 0
                if (state, role[:1]) in kept:
                    options.append((kept[state, role[:1]], (cost + extra, audit + "K", (*out, f"{role}:{text}"))))
                to = forced[state]
                options.append((to[0], (cost + extra + 1, audit + "R", (*out, f"{to}:{text}"))))
            for to, option in options:
                after[to] = min(after.get(to, option), option)
        best = after
    ends = with_inserts(dict(best))
    cost, audit, out = min(ends[s] for s in ("", "a") if s in ends)
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return gaps, *counts, illegal, cost, audit, sha("\n".join(out)), out


def summary_by_hand(rows: list[tuple], every) -> set:
    groups = in_order(rows)
    empty = (0, 0, 0, 0, 0, 0, "", sha(""))
    return {(c, *(repaired_by_hand(groups[c])[:8] if c in groups else empty)) for c in every}


def as_rows(df) -> list[tuple]:
    return [tuple(r) for r in df.select(
        "conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256").collect()]


@pytest.mark.parametrize("block_bits", [1, 3, 16])
def test_repair_against_forward_search(spark, block_bits):
    rows = random_turns(block_bits)
    rows += [(None, k, r, t) for k, (_, _, r, t) in enumerate(rows[:20])]
    df = spark.createDataFrame(rows, COLUMNS).repartition(3)
    plain = [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows]
    found = as_rows(repair.repair_summary(df, df, block_bits))
    assert len(found) == len(set(found)) and set(found) == summary_by_hand(plain, {r[0] for r in rows})


def test_damage_and_repair_of_whole_table(spark):
    table = spark.read.parquet(f"{SF_DIR}/conversations.parquet")
    rows = [tuple(r) for r in table.select("conv_id", "turn", "role", "text").collect()]
    damaged = repair.damage(table)
    assert sorted(map(str, map(tuple, damaged.collect()))) == sorted(map(str, damaged_by_hand(rows)))
    found = as_rows(repair.repair_summary(damaged, table))
    assert set(found) == summary_by_hand(damaged_by_hand(rows), {r[0] for r in rows})


def test_damage_of_nulls(spark):
    rows = [(None if k % 3 else k, None if k % 2 else k, None, None if k % 5 else f"a.b!{k}?") for k in range(200)]
    found = repair.damage(spark.createDataFrame(rows, COLUMNS)).collect()
    assert sorted(map(str, map(tuple, found))) == sorted(map(str, damaged_by_hand(rows)))


def test_repaired_turns(spark):
    rows = [(c, t, r or "x", x or "") for c, t, r, x in random_turns(9)]
    df = spark.createDataFrame(rows, COLUMNS).repartition(4)
    found = defaultdict(list)
    for r in repair.Repair(df, 2).turns().orderBy("conv_id", "row", "part").collect():
        found[r.conv_id].append(f"{r.role}:{r.text}")
    groups = in_order(rows)
    assert all(tuple(found.get(c, ())) == repaired_by_hand(g)[8] for c, g in groups.items())


def test_one_very_long_conversation(spark):
    """One conversation holds nearly all rows, one text all of its duplicates."""
    rows = [(1, k, ("user", "assistant")[k % 2], f"t{k if k % 3 else 0}.") for k in range(3000)] + [(2, 0, "user", "x" * 200_000)]
    df = spark.createDataFrame(rows, COLUMNS).repartition(6)
    assert set(as_rows(repair.repair_summary(df, df, 8))) == summary_by_hand(rows, {1, 2})


def test_repair_of_nothing_and_clashing_names(spark):
    empty = spark.createDataFrame([], COLUMNS)
    assert repair.repair_summary(empty, empty).count() == 0
    df = spark.createDataFrame([(4, 0, "user", "Hi.")], COLUMNS).selectExpr(
        "*", "1 as row", "2 as kind", "'x' as digest", "3 as block", "null as audit")
    assert as_rows(repair.repair_summary(df.where("false"), df)) == [(4, 0, 0, 0, 0, 0, 0, "", sha(""))]
    assert as_rows(repair.repair_summary(df, df)) == [(4, 0, 0, 0, 0, 0, 2, "D", sha(""))]


def test_checkpoints_are_few():
    codes = bytes(random.Random(3).choices(range(16), k=10_000))
    back = repair.Backward(codes, repair._END)
    assert len(back.marks) <= 101
    cost, audit = back.start[0], back.walk(0, True)[0]
    assert cost >= 0 and len(audit.replace("I", "")) == len(codes)
