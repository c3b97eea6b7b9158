"""Conversation repair against its SQL, a search over all edits, and its hard cases."""

import hashlib
import random
import re
from collections import defaultdict
from itertools import product

import pytest
from pyspark.sql import functions as F

from lengthloom.llm import queries, repair
from lengthloom.session import ship

from ..oracle_check import both

SCHEMA = "conv_id long, turn long, role string, text string"
WHITE = " \t\n\r\x0b\x0c"


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        core = text.rstrip(WHITE)
        out.append("b" if not core else "d" if (role, text) in seen else "t" if core[-1] not in ".!?" else "-")
        seen.add((role, text))
    return out


def brute(rows):
    """Least (cost, audit) with its repaired rows over all sequences of edits, row by row over every reachable result."""
    reach = {"": (0, "", [])}
    insert = lambda ways: [(o + r[0], (c + 3, a + "I", m + [(r, "")])) for o, (c, a, m) in ways for r in ("user", "assistant")]

    def best(ways):
        out = {}
        for o, w in ways:
            if re.fullmatch(r"s?(ua)*u?", o):
                o = o if len(o) < 2 else ("", "s", "u", "ua")[("s" == o[-1]) + 2 * ("u" == o[-1]) + 3 * ("a" == o[-1])]
                out[o] = min(out.get(o, w), w)
        return out

    for (_, role, text), fault in zip(rows, faults(rows), strict=True):
        ways = list(reach.items())
        ways += insert(ways)
        ways += insert(ways)
        more = []
        for o, (c, a, m) in ways:
            more.append((o, (c + 4, a + "D", m)))
            if fault in "t-":
                x = 3 * (fault == "t")
                more += [(o + role[0], (c + x, a + "K", m + [(role, text)]))] if role else []
                more += [(o + r[0], (c + 3 + x, a + "R", m + [(r, text)])) for r in ("user", "assistant")]
        reach = best(more)
    ways = list(reach.items())
    ways += insert(ways)
    ways += insert(ways)
    return min(w for o, w in best(ways).items() if o in ("", "ua"))


def want(table, ids):
    """Result rows of damaged (conv_id, turn, role, text) rows."""
    by = defaultdict(list)
    for c, t, r, x in table:
        by[c].append((t, r, x))
    out = {}
    for c in ids:
        rows = sorted(by[c], key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        kinds, turns = faults(rows), [t for t, _, _ in rows if t is not None]
        cost, audit, made = brute(rows)
        pairs = [a[1][:1] + b[1][:1] for a, b in zip(rows, rows[1:])]
        out[c] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, kinds.count("b"), kinds.count("d"), kinds.count("t"), sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256("\n".join(f"{r}:{x}" for r, x in made).encode()).hexdigest())
    return out


def some(seed, convs=60, longest=9):
    rng = random.Random(seed)
    texts = ["a.", "b!", "c?", "open", " \t\n", "", "é…", "x .  "]
    return [(c, rng.choice([None, 0, 1, 2, 3, 7]) if c % 3 else t, rng.choice(["user", "assistant", "system", "tool", " ", "", "u"]), rng.choice(texts)) for c in range(convs) for t in range(rng.randrange(longest))]


def test_query_equals_sql(spark):
    ship(spark)
    got, want_ = both(spark, queries.queries()["op12_duckdb_repair"], queries.oracle_sql()["op12_duckdb_repair"], "/root/testdata/sf0.001")
    assert got == want_


def test_query_on_hard_rows_equals_sql(spark, tmp_path):
    ship(spark)
    rows = some(1) + [(None, None, None, None), (None, 3, "user", None), (5, None, None, "x."), (5, 2, None, None), (900, 1, "user", "same"), (900, 1, "user", "same"), (901, 4, "user", "wörd " * 30_000 + ".")]
    spark.createDataFrame([(*r, "x") for r in rows], SCHEMA + ", audit string").repartition(3).write.parquet(f"{tmp_path}/conversations.parquet")
    table = spark.read.parquet(f"{tmp_path}/conversations.parquet").toPandas()
    table.to_parquet(f"{tmp_path}/one.parquet")
    got = sorted(map(str, (r.asDict() for r in repair.query(spark, str(tmp_path)).collect())))
    import duckdb

    con = duckdb.connect()
    con.execute(f"create view conversations as select conv_id::bigint as conv_id, turn::bigint as turn, role, text from '{tmp_path}/one.parquet'")
    cur = con.execute(repair.ORACLE)
    names = [d[0] for d in cur.description]
    assert got == sorted(str(dict(zip(names, r, strict=True))) for r in cur.fetchall())


@pytest.mark.parametrize("segment", [2, 128])
def test_edits_equal_a_search(spark, monkeypatch, segment):
    """Also where conversations lie in many segments and ranges."""
    ship(spark)
    monkeypatch.setattr(repair, "SEGMENT", segment)
    monkeypatch.setattr(repair, "BATCH", 7 * segment)
    monkeypatch.setattr(repair, "RANGE", 20 if segment == 2 else 200_000)
    table = some(7)
    ids = [*range(60), 77]
    every = spark.createDataFrame([(i,) for i in ids], "conv_id long")
    d = spark.createDataFrame(table, SCHEMA).repartition(4)
    got = {r[0]: tuple(r)[1:] for r in repair.repair(d, "conv_id", F.col("turn"), F.col("role"), F.col("text"), None, every).collect()}
    assert got == want(table, ids)


def test_a_conversation_with_a_third_of_all_rows(spark, monkeypatch):
    ship(spark)
    monkeypatch.setattr(repair, "RANGE", 500)
    rng = random.Random(2)
    table = [(0, t, rng.choice(["user", "assistant"]), f"t{t % 700}{rng.choice('.?x')}") for t in range(2000)] + [(c, t, ("user", "assistant")[t % 2], f"{t}.") for c in range(1, 1000) for t in range(4)]
    got = {r["conv_id"]: r for r in repair.repair(spark.createDataFrame(table, SCHEMA), "conv_id", F.col("turn"), F.col("role"), F.col("text")).collect()}
    r = want([x for x in table if x[0] == 0], [0])[0]
    assert tuple(got[0])[1:] == r and len(got) == 1000
    assert all(got[c]["audit"] == "KKKK" and got[c]["cost"] == 0 for c in range(1, 1000))


def test_repeated_rows_cost_one_row(spark):
    table = [(1, 1, "user", "a.")] * 5000 + [(1, 2, "assistant", "b.")]
    r = repair.repair(spark.createDataFrame(table, SCHEMA), "conv_id", F.col("turn"), F.col("role"), F.col("text")).first()
    assert (r["cost"], r["audit"], r["duplicate"], r["illegal"]) == (4 * 4999, "K" + "D" * 4999 + "K", 4999, 4999)


def test_an_empty_table_gives_no_rows(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/conversations.parquet")
    assert repair.query(spark, str(tmp_path)).collect() == []


def test_moves_are_the_cheapest():
    assert len({m[:3] for m in repair.moves()}) == len(repair.moves())
    assert ("u-", 0, 2, 0, "K") in repair.moves() and ("ab", 0, 0, 4, "D") in repair.moves()
    assert not [m for m in product("KR", "b") if any(k[0][1] == "b" and k[4][-1] in "KR" for k in repair.moves())]
