import itertools
import os

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from docgrid.llm import conversation, queries
from docgrid.llm.sql import SQL

SF = "/root/testdata/sf0.001"
ROLE = {"u": "user", "a": "assistant"}


def legal(initials):
    body = initials[1:] if initials.startswith("s") else initials
    return initials == "" or (body and body == "ua" * (len(body) // 2))


def cheapest(rows):
    """By trial of all edits: (cost, audit, turns) of rows (role, text, fault)."""
    found = (3 * len(rows), "D" * len(rows), [])  # to delete all is always allowed

    def go(i, cost, audit, turns, inserts):
        nonlocal found
        if cost > found[0]:
            return
        if i == len(rows) and legal("".join(r[:1] for r, _ in turns)):
            key = (cost, audit, turns)
            if key[:2] < found[:2]:
                found = key
        if inserts < 3:
            for c in "ua":
                go(i, cost + 2, audit + "I", [*turns, (ROLE[c], "")], inserts + 1)
        if i < len(rows):
            role, text, fault = rows[i]
            go(i + 1, cost + 3, audit + "D", turns, 0)
            if fault in "nt":
                go(i + 1, cost + (fault == "t"), audit + "K", [*turns, (role, text)], 0)
                for c in "ua":
                    go(i + 1, cost + 2 + (fault == "t"), audit + "R", [*turns, (ROLE[c], text)], 0)

    go(0, 0, "", [], 0)
    return found


def letters(rows):
    return "".join(chr(65 + 4 * conversation.INITIALS.index(r[:1] if r[:1] in "sua" and r else "x") + conversation.FAULTS.index(f)) for r, _, f in rows)


@pytest.mark.parametrize("n", [0, 1, 2])
def test_every_short_signature(n):
    for rows in itertools.product([(r, "t", f) for r in ("system", "user", "assistant", "tool") for f in "nbdt"], repeat=n):
        cost, audit, _ = cheapest(rows)
        assert conversation.solve(letters(rows)) == (cost, audit), rows


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["system", "user", "assistant", "x"]), st.just("t"), st.sampled_from("nnnbdt")), min_size=3, max_size=4))
def test_longer_signatures(rows):
    cost, audit, turns = cheapest(rows)
    assert conversation.solve(letters(rows)) == (cost, audit)
    replayed = conversation._Replay(audit)
    got = [(r, t) for role, text, _ in rows for _, r, t in replayed.row(role, text)] + [(r, t) for _, r, t in replayed.end()]
    assert got == turns


@given(st.text("ABCDEFGHIJKLMNOP", max_size=300))
def test_halves_agree_with_one_row_at_a_time(signature):
    costs, edits, ends = conversation._END, ["", "II", "I", ""], None
    for letter in reversed(signature):
        costs, left, to = conversation._row(letter, costs)
        edits = [left[s] + edits[to[s]] for s in range(4)]
    assert conversation.solve(signature) == ((costs[0], edits[0]) if signature else (0, ""))


def test_a_very_long_signature():
    cost, audit = conversation.solve("EIK" * 100_000)
    assert len(audit) >= 300_000 and cost > 0


def oracle(con):
    return {r[0]: r[1:] for r in con.sql(SQL["op13_conversations"]).fetchall()}, [d[0] for d in con.sql(SQL["op13_conversations"]).description]


def compare(spark, tmp_path, rows):
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, conv string").repartition(3).write.mode("overwrite").parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    con.sql(f"create view conversations as select * from '{tmp_path}/conversations.parquet/*.parquet'")
    want, columns = oracle(con)
    out = queries.op13_conversations(spark, str(tmp_path))
    assert sorted(out.columns) == sorted(columns)
    got = {r["conv_id"]: tuple(r[c] for c in columns[1:]) for r in out.collect()}
    assert got == want
    return got


def test_against_sql(spark, tmp_path):
    import random

    rng = random.Random(5)
    rows = []
    for c in [None, *range(120)]:
        for t in range(rng.randrange(0, 9)):
            turn = None if rng.random() < 0.1 else t + rng.randrange(0, 2)
            rows.append((c, turn, rng.choice(["user", "assistant", "system", "user", "assistant", None, "", "tool", "User"]), rng.choice(["yes.", "no", "so?  ", None, "", " \t", "ok.", "a.b!c?", "é.", "long " * 500 + "!"]), "x"))
    rows += rows[:10]
    got = compare(spark, tmp_path, rows)
    assert {c for v in got.values() for c in v[6]} == {*"DIKR"}


def test_hot_conversation_and_empty(spark, tmp_path):
    rows = [(7, i, "user" if i % 3 else "assistant", f"text {i % 50}.", None) for i in range(700)] + [(8, None, "user", "same.", None)] * 90
    compare(spark, tmp_path, rows)
    compare(spark, tmp_path / "none", [])


def test_turns(spark):
    rows = [(1, 0, "user", "hello."), (1, 1, "user", "again?"), (1, 2, "assistant", "cut o"), (2, 0, "assistant", " ")]
    df = spark.createDataFrame(rows, "conv_id string, turn int, role string, text string")
    audits, ordered = conversation.audit_conversations(df)
    assert {r["conv"]: r["audit"] for r in audits.collect()} == {"1": "KIKK", "2": "D"}
    turns = conversation.replay(audits, ordered).orderBy("conv", "position").collect()
    assert [(r["edit"], r["role"], r["text"]) for r in turns] == [("K", "user", "hello."), ("I", "assistant", ""), ("K", "user", "again?"), ("K", "assistant", "cut o")]


def test_query(spark):
    out = {r["conv_id"]: r for r in queries.op13_conversations(spark, SF).collect()}
    path = f"{SF}/conversations.parquet"
    con = duckdb.connect()
    con.sql(f"create view conversations as select * from '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    want, columns = oracle(con)
    assert {k: tuple(r[c] for c in columns[1:]) for k, r in out.items()} == want
