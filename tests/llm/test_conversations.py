"""Repair of conversations against brute force, in SQL, and in blocks."""

import hashlib
import random
import zlib
from functools import cache

import duckdb
import pytest

from stackloom.llm import conversations as C
from stackloom.llm import queries

COLUMNS = ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
NEXT = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}


def cheapest(turns, costs=C.Costs(), inserts=3):
    """(cost, audit) by trying everything, with up to so many inserts."""

    @cache
    def go(at, state, left):
        out = [(0, "")] if at == len(turns) and state in ("", "a") else []

        def add(cost, edit, rest):
            if rest:
                out.append((cost + rest[0], edit + rest[1]))

        if at < len(turns):
            initial, fault = turns[at]
            add(costs.delete, "D", go(at + 1, state, left))
            if fault not in "bd":
                extra = costs.truncated if fault == "t" else 0
                if (state, initial) in NEXT:
                    add(costs.keep + extra, "K", go(at + 1, NEXT[state, initial], left))
                for role in "ua":
                    if (state, role) in NEXT:
                        add(costs.rerole + extra, "R", go(at + 1, NEXT[state, role], left))
        if left:
            for role in "ua":
                if (state, role) in NEXT:
                    add(costs.insert, "I", go(at, NEXT[state, role], left - 1))
        return min(out) if out else None

    return go(0, "", inserts)


@pytest.mark.parametrize("costs", [C.Costs(), C.Costs(insert=1, delete=3), C.Costs(keep=1, rerole=1, insert=2)])
def test_search_is_optimal_and_takes_the_first_audit(costs):
    draw = random.Random(5)
    for _ in range(600):
        turns = tuple((draw.choice("suuaax"), draw.choice("....ttbd")) for _ in range(draw.randint(0, 8)))
        assert C.search(turns, costs=costs) == cheapest(turns, costs, 4)


def test_search_is_linear():
    draw = random.Random(6)
    turns = [(draw.choice("suuaax"), draw.choice("....ttbd")) for _ in range(50_000)]
    cost, audit = C.search(turns)
    assert len(audit) >= len(turns) and cost <= 2 * len(turns)


def expected(rows, hurt=True):
    """The contract, row by row, for (conv, turn, role, text)."""
    name = lambda v: " " if v is None else v
    by = {}
    for conv, turn, role, text in rows:
        by.setdefault(conv, [])
        role, text = name(role), name(text)
        draw = zlib.crc32(f"{name(conv)}:{name(turn)}".encode()) % 20 if hurt else 19
        if draw == 0:
            continue
        text = "" if draw == 1 else "".join(c for c in text if c not in ".!?") if draw == 2 else text
        by[conv] += [(turn, "user" if draw == 4 else role, text)] * (2 if draw == 3 else 1)
    out = []
    for conv, turns in by.items():
        turns.sort(key=lambda t: (t[0] is not None, t[0] or 0, t[1].encode(), t[2].encode()))
        seen, faults = set(), []
        for _, role, text in turns:
            body = text.rstrip(" \t\n\v\f\r")
            faults.append("b" if not body else "d" if (role, text) in seen else "." if body[-1] in ".!?" else "t")
            seen.add((role, text))
        cost, audit = cheapest(tuple((t[1][:1], f) for t, f in zip(turns, faults, strict=True)))
        state, left, shown = "", iter(turns), []
        for edit in audit:
            _, role, text = (None, "", "") if edit == "I" else next(left)
            if edit == "D":
                continue
            if edit in "IR":
                role = "assistant" if state == "u" else "user"
            state = NEXT[state, role[:1]]
            shown.append(f"{role}:{text}")
        known = sorted({t[0] for t in turns if t[0] is not None})
        gaps = known[-1] - known[0] + 1 - len(known) if known else 0
        pairs = [a[1][:1] + b[1][:1] for a, b in zip(turns, turns[1:], strict=False)]
        out.append((conv, gaps, *(faults.count(f) for f in "bdt"), sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256("\n".join(shown).encode()).hexdigest()))
    return sorted(out, key=repr)


def got(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=repr)


def odd_rows():
    draw = random.Random(7)
    rows = [(None, 0, "user", "Hi."), (None, None, None, None), (1, None, "user", "a."), (1, None, "user", "a."), (1, 5, "assistant", "b!"), (1, 5, "assistant", "b!"), (1, -3, "system", "s?")]
    rows += [(2, t, "", "x.") for t in range(3)] + [(3, 0, "assistant", " "), (3, 1, "user", "end.\n \t"), (4, 0, "user", "\xa0"), (5, 0, "user", "w " * 200_000 + ".")]
    for conv in range(10, 60):
        rows += [(conv, draw.choice([None, *range(9)]), draw.choice(["user", "assistant", "system", "tool", None]), draw.choice(["Yes.", "No", "", " \n", "Well?", "é …", None])) for _ in range(draw.randint(1, 8))]
    return rows


def test_odd_rows_whole_and_in_blocks(spark):
    rows = odd_rows()
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, audit string, cost int")
    want = expected(rows)
    assert got(C.repair(C.damage(df))) == want
    assert got(C.repair(C.damage(df), max_turns=2)) == want  # long conversations in blocks of two turns
    assert got(C.repair(C.plain(df), max_chars=3)) == expected(rows, hurt=False)


def test_one_long_conversation_is_searched_in_blocks(spark):
    draw = random.Random(8)
    rows = [(1, t, draw.choice(["user", "assistant"]), draw.choice(["a.", "b", ""]) + str(t % 7) + draw.choice(".x")) for t in range(3_000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert got(C.repair(C.plain(df), max_turns=250)) == got(C.repair(C.plain(df)))


def test_inserts_at_the_ends_of_blocks(spark):
    costs = C.Costs(insert=1, delete=9, rerole=9)
    rows = [(1, t, role, f"{t}.") for t, role in enumerate(["user", "user", "assistant", "assistant", "user"])]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    whole = got(C.repair(C.plain(df), costs=costs))
    assert whole[0][7] == "KIKKIKKI"
    assert got(C.repair(C.plain(df), costs=costs, max_turns=1)) == whole


def test_empty_table_and_clashing_names(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert C.repair(C.damage(empty)).collect() == []
    with pytest.raises(ValueError):
        C.repair(C.damage(empty), conv_name="cost")


def test_query_equals_sql_and_brute_force(spark, sf_dir):
    mine = got(queries.op11_conversations(spark, sf_dir))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{sf_dir}/conversations.parquet'")
    assert sorted(con.execute(queries.ORACLE_SQL["op11_conversations"]).fetchall(), key=repr) == mine
    rows = con.execute("SELECT conv_id, turn, role, text FROM conversations").fetchall()
    assert expected(rows) == mine
