"""Turn repair against SQL and against shortest ways over whole conversations."""

import hashlib
import random

import duckdb
import pytest

from matchloom.llm.turnrepair import BLOCK, OP12_SQL, Conversation, align, damaged, op12_turn_repair, repaired

NAMES = {"s": "system", "u": "user", "a": "assistant", "o": "tool"}


def shortest(rows):
    """Cost and audit over all edits: the cheapest way after every row for each state, compared as whole audits."""
    never = (10**9, "~")
    add = lambda x, c, letter: (x[0] + c, x[1] + letter) if x[0] < 10**9 else never

    def inserted(v):
        w = dict(v)
        w["u"] = min(v["u"], *(add(v[q], 3, "I") for q in "^sa"))
        w["a"] = min(v["a"], add(w["u"], 3, "I"))
        return w

    v = {"^": (0, ""), "s": never, "u": never, "a": never}
    for r in rows:
        w, low, extra = inserted(v), r.lower(), 3 * r.isupper()
        before_u = min(w["^"], w["s"], w["a"])
        v = {q: add(w[q], 4, "D") for q in w}
        if low == "s":
            v["s"] = min(v["s"], add(w["^"], extra, "K"))
        v["u"] = min(v["u"], add(before_u, extra, "K") if low == "u" else add(before_u, 3 + extra, "R"))
        v["a"] = min(v["a"], add(w["u"], extra, "K") if low == "a" else add(w["u"], 3 + extra, "R"))
    w = inserted(v)
    return min(w["^"], w["a"])


@pytest.mark.parametrize("scale", ["sf0.001", "sf0.01"])
def test_equals_sql(spark, scale):
    folder = f"/root/testdata/{scale}"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{folder}/conversations.parquet'")
    assert sorted(map(tuple, op12_turn_repair(spark, folder).collect())) == sorted(con.execute(OP12_SQL).fetchall())


def test_odd_rows_equal_sql(spark):
    """Null ids, turns, roles and texts, equal turns, repeats, blanks of several kinds, dropped conversations, other roles, clashing names."""
    rnd = random.Random(3)
    texts = [None, "", " \t\r\n", "Yes.", "No", "Why?\n", "Oh! ", " ", "ab\x85", "x" * 5000 + "."]
    rows = [(rnd.choice([None, *range(40)]), rnd.choice([None, *range(9)]), rnd.choice(["user", "assistant", "system", None, "", "User", "umpire", "tool"]), rnd.choice(texts)) for _ in range(1200)]
    rows += [(1000 + i, 0, "user", "Hi.") for i in range(60)] + [(2000, 5 * i, "user" if i % 2 else "assistant", f"t {i}.") for i in range(300)]
    rows = list(dict.fromkeys(rows))
    frame = spark.createDataFrame([(*r, 1, "c") for r in rows], "conv_id long, turn long, role string, text string, `a.b` int, audit string").repartition(4)
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    key = lambda r: (r[0] is not None, r[0])
    got = sorted(map(tuple, repaired(damaged(frame)).collect()), key=key)
    assert got == sorted(con.execute(OP12_SQL).fetchall(), key=key)
    assert any(r[7] == "" and r[0] is not None and r[0] >= 1000 for r in got) and got[0][0] is None
    assert repaired(damaged(frame.where("false"))).count() == 0


def test_random_conversations_equal_shortest_ways():
    """Also over many blocks, with and without stretches in order."""
    rnd = random.Random(5)
    for k in range(1200):
        n = rnd.choice([0, 1, 2, 3, 5, 9, 17, 33, 60])
        letters = rnd.choice(["ua", "suaoSUAO", "uuuuaaaaUAso"])
        rows = "".join(rnd.choice(letters) for _ in range(n)) if k % 3 else "".join(c if rnd.random() < 0.9 else rnd.choice("suaoUA") for c in ("s" * rnd.randrange(2) + "ua" * n)[:n])
        talk = Conversation(k)
        for i, r in enumerate(rows):
            talk.add(i, NAMES[r.lower()], f"text {i}" + "." * r.islower(), False)
        assert talk.result()[6:8] == shortest(rows), rows


def test_bands_do_not_change_alignments():
    rnd = random.Random(9)
    for _ in range(300):
        turns, target = "".join(rnd.choice("suaoUA") for _ in range(rnd.randrange(8))), ("s" * rnd.randrange(2) + "ua" * 6)[: rnd.randrange(9)]
        wide = align(turns, target, 10**6)
        if wide:
            assert align(turns, target, wide[0]) == wide and align(turns, target, wide[0] - 1) is None


def test_long_conversations_need_no_more_than_a_block():
    """Turns in order, all of one role, out of order, blank."""
    for role in (lambda i: ("user", "assistant")[i % 2], lambda i: "user", lambda i: ("user", "assistant", "user")[i % 3]):
        talk, most = Conversation(1), 0
        for i in range(5000):
            talk.add(i, role(i), f"text {i}." if i % 4 else " ", False)
            most = max(most, len(talk.rows))
        got = talk.result()
        assert most <= 2 * BLOCK and (got[6] - 4 * 1250, got[7].replace("D", "")) == (lambda x: (x[0], x[1].replace("D", "")))(shortest("".join(role(i)[0] for i in range(5000) if i % 4)))


def test_digest_is_of_the_repaired_text():
    talk = Conversation(1)
    for i, (role, text) in enumerate([("assistant", "A."), ("user", " "), ("user", "B."), ("user", "C."), ("assistant", "D")]):
        talk.add(i, role, text, False)
    got = talk.result()
    assert got[6:8] == (3 + 4 + 3 + 3, "IKDKIKK")
    assert got[8] == hashlib.sha256(b"user:\nassistant:A.\nuser:B.\nassistant:\nuser:C.\nassistant:D").hexdigest()
