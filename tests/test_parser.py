import pytest

from larkspur.errors import ParseError
from larkspur.functions.domains import Literal
from larkspur.plans import tree as t
from larkspur.plans.parser import parse

A, B = t.AttrName("r", "a"), t.AttrName("r", "b")


def test_numbers_have_domains():
    node = parse("INSERT INTO r (r.a) VALUES (1, -2, 3U, 4L, 5UL, 1.5F, -1.5, 'it\\'s');")
    assert [x.domain for x in node.values] == ["INT", "INT", "UINT", "LONG", "ULONG", "FLOAT", "DOUBLE", "STRING"]
    assert node.values[1].value == -2 and node.values[-1].value == "it's"


def test_and_binds_tighter_than_or():
    node = parse("SELECT FROM r WHERE r.a = 1 OR r.a = 2 AND r.b = 3;").where
    assert node.op == "OR" and node.right.op == "AND"
    node = parse("SELECT FROM r WHERE (r.a = 1 OR r.a = 2) AND r.b = 3").where
    assert node.op == "AND" and node.left.op == "OR"


@pytest.mark.parametrize(
    "text",
    [
        "SELECT FROM $v WHERE r.a >= 5L;",
        "PROJECT (JOIN r, s ON r.a = s.a) OVER r.a, s.b;",
        "UNION (SELECT FROM r WHERE r.a < 1), (SELECT FROM r);",
        "SORT r BY r.a DESC, r.b ASC, r.c;",
        "CREATE TABLE s (i INT PRIMARY KEY, n STRING(8) FOREIGN KEY(r,a), x BYTES(4));",
        "DROP TABLE s;",
        "CREATE VIEW $v AS JOIN r, s;",
        "DROP VIEW $v;",
        "CREATE INDEX ON r (a);",
        "DROP INDEX r (a);",
        "DELETE r WHERE r.a != 'x';",
        "UPDATE r SET r.a = 1, r.b = 'x' WHERE r.a <= 3;",
        "AVG('SELECT FROM r', 'a');",
    ],
)
def test_trees_survive_json(text):
    import json

    node = parse(text)
    assert t.from_json(json.loads(json.dumps(t.to_json(node)))) == node


@pytest.mark.parametrize("text", ["", "SELECT r;", "select FROM r;", "SELECT FROM r WHERE 1 = r.a;", "SELECT FROM r WHERE r.a = r.b;", "JOIN r, s ON r.a = 1;", "DROP r;", "SELECT FROM r; SELECT FROM r;", "INSERT INTO r (a) VALUES (1);", "CREATE TABLE r (a STRING(0));", "SELECT FROM r WHERE r.a = -1U;", "PRIMARY  KEY"])
def test_rejected(text):
    with pytest.raises(ParseError):
        parse(text)


def test_alternatives_are_minimal():
    one, two = t.Compare(A, "=", Literal("INT", 1)), t.Compare(B, "=", Literal("INT", 2))
    assert t.conjunctions(t.Bool("OR", one, t.Bool("AND", one, two))) == [(one,)]
    both = t.conjunctions(t.Bool("AND", t.Bool("OR", one, two), t.Bool("OR", one, two)))
    assert sorted(map(len, both)) == [1, 1]
