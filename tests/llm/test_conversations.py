"""Operator 12 against an exhaustive search over edits, against SQL, and over conversations longer than a task's share."""

import hashlib
import random
import re

import pytest

from siltstone.llm.conversations import ASSISTANT, START, _Tables, advanced, closed, damaged, op12_conversation_repair, passed, repair, table
from siltstone.llm.queries import SQL

from ..oracle import connection, duck_rows, spark_rows
from .helpers import save

ROWS = "conv_id long, turn long, role string, text string"
RESULT = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def cheapest(rows):
    """(cost, audit, turns) over all edits with two insertions at a place at most; rows are (role, text, forced, truncated)."""
    best = None

    def go(i, said, cost, audit, room):
        nonlocal best
        initials = "".join(r[:1] for r, _ in said)
        if not re.fullmatch(r"s?(ua)*u?", initials) or (best and cost > best[0]):
            return
        if i == len(rows) and re.fullmatch(r"(s?(ua)+)?", initials):
            best = min([(cost, audit, said), *([best] if best else [])], key=lambda x: x[:2])
        if room:
            for role in ("user", "assistant"):
                go(i, [*said, (role, "")], cost + 2, audit + "I", room - 1)
        if i < len(rows):
            role, text, forced, truncated = rows[i]
            go(i + 1, said, cost + 3, audit + "D", 2)
            if not forced:
                go(i + 1, [*said, (role, text)], cost + truncated, audit + "K", 2)
                for other in ("user", "assistant"):
                    go(i + 1, [*said, (other, text)], cost + 2 + truncated, audit + "R", 2)

    go(0, [], 0, "", 2)
    return best


def brute(rows):
    """rows: (turn, role, text) of one conversation, in order."""
    seen, kinds, blank, duplicate, truncated = set(), [], 0, 0, 0
    for _, role, text in rows:
        bare = text.rstrip(" \t\n\x0b\x0c\r")
        fault = "b" if not bare else "d" if (role, text) in seen else "t" if bare[-1] not in ".!?" else ""
        seen.add((role, text))
        blank, duplicate, truncated = blank + (fault == "b"), duplicate + (fault == "d"), truncated + (fault == "t")
        kinds.append((role, text, fault in ("b", "d"), int(fault == "t")))
    turns = {t for t, _, _ in rows if t is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    cost, audit, said = cheapest(kinds)
    return gaps, blank, duplicate, truncated, illegal, cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in said).encode()).hexdigest()


def test_equals_exhaustive_search(spark):
    rng, given, want = random.Random(1), [], {}
    for conv in range(60):
        rows = sorted(((rng.choice([None, *range(7)]), rng.choice(["system", "user", "assistant", "tool", "admin", " "]), rng.choice(["Hi.", "What?", "so", " ", "", "Oh! \n", "x\x0b"])) for _ in range(rng.randint(1, 5))), key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(f"{len(r[1])}:{r[1]}:{r[2]}".encode()).hexdigest()))
        given += [(conv, *row) for row in rows]
        want[conv] = brute(rows)
    got = {r.conv_id: tuple(r[c] for c in RESULT) for r in repair(spark.createDataFrame(given, ROWS).repartition(5)).collect()}
    assert got == want


def test_tables_multiply():
    rng = random.Random(2)
    for _ in range(50):
        rows = [(rng.choice("suax"), rng.random() < 0.2, rng.random() < 0.3, rng.randint(1, 3)) for _ in range(40)]
        layer = closed(((0, ""), None, None, None))
        for row in rows:
            layer = advanced(layer, *row)
        tables, at = _Tables(), 0
        while at < len(rows):
            size = rng.randint(1, 9)
            tables.add(table(tuple(rows[at : at + size])), size)
            at += size
        assert passed(closed(((0, ""), None, None, None)), tables.product()) == layer == table(tuple(rows))[START]


def test_one_conversation_with_most_rows(spark):
    """It is spread over ranges; the result is that of one pass."""
    rng, rows = random.Random(3), []
    for turn in range(20_000):
        rows.append((1, turn, rng.choice(["user", "assistant", "assistant", "system"]), f"{turn}" + rng.choice([".", "", "?"])))
    rows += [(1, 7, "user", "again.")] * 3000 + [(c, 0, "user", "Hi.") for c in range(2, 500)]
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = {r.conv_id: r for r in repair(spark.createDataFrame(rows, ROWS).repartition(7)).collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    layer, copies = closed(((0, ""), None, None, None)), {}
    for row in rows[:23_000]:
        copies[row[1:]] = copies.get(row[1:], 0) + 1
    order = sorted(copies, key=lambda r: (r[0], r[1], hashlib.sha256(f"{len(r[1])}:{r[1]}:{r[2]}".encode()).hexdigest()))
    for row in order:
        layer = advanced(layer, row[1][0], False, row[2][-1] not in ".?", copies[row])
    cost, audit = min(x for x in (layer[START], layer[ASSISTANT]) if x)
    assert (got[1].cost, got[1].audit) == (cost, audit) and got[1].duplicate == 2999 and len(got) == 499
    assert (got[2].cost, got[2].audit) == (2, "KI")


def test_empty_nulls_and_further_columns(spark):
    assert repair(spark.createDataFrame([], ROWS)).collect() == []
    rows = spark.createDataFrame([(None, None, None, None), (None, None, "user", "Hi."), (5, None, "user", None)], ROWS).selectExpr("*", "3 AS n", "1 AS part", "'x' AS first", "2 AS row", "0 AS fault")
    got = {r.conv_id: tuple(r[c] for c in RESULT[:7]) for r in repair(rows).collect()}
    assert got == {None: (0, 1, 0, 0, 1, 5, "DKI"), 5: (0, 1, 0, 0, 0, 3, "D")}
    assert damaged(rows).columns == ["conv_id", "turn", "role", "text", "n"]


@pytest.mark.parametrize("null", [False, True])
def test_query_equals_sql(spark, tmp_path, null):
    rng = random.Random(4)
    rows = [(rng.choice([None, *range(30)]) if null else c, rng.choice([None, *range(9)]) if null else t, rng.choice(["user", "assistant", "system", None] if null else ["user", "assistant"]), rng.choice(["Yes.", "No?", "and so", "!", None if null else "?"])) for c in range(30) for t in range(7)]
    folder = save(spark.createDataFrame(rows, ROWS), tmp_path, "conversations")
    assert spark_rows(op12_conversation_repair(spark, folder)) == duck_rows(connection(folder), SQL["op12_conversation_repair"])
