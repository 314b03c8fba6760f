"""Registered queries against their SQL, and random predicates against DuckDB."""

import random

import duckdb
import pytest

from larkspur import queries
from larkspur.engine import Engine

SF = "/root/testdata/sf0.001"
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "documents", "labels")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


def normal(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(str(r[i]) for i in order) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_matches_its_sql(spark, duck, name):
    df = queries.QUERIES[name](spark, SF)
    want = duck.sql(queries.ORACLE_SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert normal(df.collect(), df.columns) == normal(want.fetchall(), want.columns)


LEAVES = [
    ("orders.o_orderkey", ("{}L", "{}"), (5, 400, 900)),
    ("orders.o_custkey", ("{}L", "{}"), (3, 50, 120)),
    ("orders.o_totalprice", ("{}", "{}::DOUBLE"), (1000.5, 100000.25, 250000.75)),
    ("orders.o_orderstatus", ("'{}'", "'{}'"), ("F", "O", "P")),
    ("orders.o_orderpriority", ("'{}'", "'{}'"), ("1-URGENT", "3-MEDIUM", "5-LOW")),
]


def predicate(rng, depth):
    if not depth or rng.random() < 0.25:
        attr, (ours, theirs), values = rng.choice(LEAVES)
        op, value = rng.choice(("=", "!=", "<", "<=", ">", ">=")), rng.choice(values)
        return f"{attr} {op} {ours.format(value)}", f"{attr.split('.')[1]} {op} {theirs.format(value)}"
    (a, x), (b, y) = predicate(rng, depth - 1), predicate(rng, depth - 1)
    op = rng.choice(("AND", "OR"))
    return f"({a} {op} {b})", f"({x} {op} {y})"


def test_random_predicates(spark, duck):
    rng = random.Random(7)
    e, bag = (Engine(spark, or_mode=m).register_parquet(SF, "orders") for m in ("set", "bag"))
    for _ in range(25):
        ours, theirs = predicate(rng, 4)
        want = normal(duck.sql(f"SELECT o_orderkey FROM orders WHERE {theirs}").fetchall(), ["o_orderkey"])
        text = f"PROJECT (SELECT FROM orders WHERE {ours}) OVER orders.o_orderkey;"
        assert normal(e.query(text).collect(), ["o_orderkey"]) == want
        assert normal(bag.query(text).distinct().collect(), ["o_orderkey"]) == want
