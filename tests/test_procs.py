import pytest

from larkspur.engine import Engine
from larkspur.errors import ProcedureError
from larkspur.procs.values import INVALID, Single


@pytest.fixture
def engine(spark):
    e = Engine(spark)
    e.define("CREATE TABLE r (i INT PRIMARY KEY, f FLOAT, s STRING(8));")
    for i, s in enumerate(("5", "x7", "12ab")):
        e.modify(f"INSERT INTO r (r.i, r.f, r.s) VALUES ({i}, {i}.5F, '{s}');")
    return e


def run(engine, expr, kind="AUTO"):
    engine.create_procedure(f"PROCEDURE p(INT x) BEGIN {kind} y; y := {expr}; RETURN y; END")
    return engine.call("p", 7)


@pytest.mark.parametrize(
    "expr, want",
    [
        ("((-x) / 2)", -3), ("(x / 2)", 3), ("(x / 2.0)", 3.5), ("(x + 0.5)", 7.5), ('(x + "a")', "7a"), ('("a" + 1.5)', "a1.500000"),
        ("(x = 7)", 1), ("(x != 7)", 0), ("(x >= 7.0)", 1.0), ('("a" < "b")', 1), ('((x < 3) or (x > 5))', 1), ('("" and x)', 0),
        ('!strlen("äb")', 3), ('!substr("hello", 1, 3)', "ell"), ('!substr("hello", 4, (-2))', "ll"), ('!strindex("hello", "lo")', 3), ('!strindex("hello", "z")', -1),
        ("!is_int(x)", 1), ("!is_float(x)", 0), ('!is_string("")', 1), ('!to_int("12ab")', 12), ('!to_int("z")', 0), ("!to_int(3.9)", 3), ('!to_float("1.5x")', 1.5), ("!to_string(x)", "7"),
    ],
)
def test_expressions(engine, expr, want):
    got = run(engine, expr)
    assert got == want and isinstance(got, Single) == isinstance(want, float)


@pytest.mark.parametrize("expr", ['(x - "a")', '!substr("abc", 2, 5)', '(x < "a")', '!strlen(x)', "(x / 0)"])
def test_invalid_values_do_not_assign(engine, expr):
    assert run(engine, expr) is INVALID


def test_loops_and_queries(engine):
    engine.create_procedure(
        """procedure total(STRING query, AUTO attr)
        begin
            TUPLE t; FLOAT sum; INT n; AUTO v; STRING names;
            sum := 0.0; n := 0; names := "";  # running values
            foreach (t in query) do
                v := !attrval(t, attr);
                if (!is_float(v)) sum := (sum + v);
                n := (n + !attrcount(t));
            end
            while ((n > 4)) n := (n - 4);
            !echo(n); !newline();
            return sum;
        end"""
    )
    assert engine.procedure("total('SELECT FROM r', 'f');") == pytest.approx(4.5)
    assert engine.procedure("total('SELECT FROM r', 1);") == pytest.approx(4.5)
    assert engine.printed == ["1", "\n"] * 2


def test_exec_reports_success(engine):
    engine.create_procedure('PROCEDURE add(INT i) BEGIN STRING q; q := (("INSERT INTO r (r.i, r.f, r.s) VALUES (" + i) + ", 1.0F, \'z\');"); RETURN !exec(q); END'.replace("\\'", "'"))
    assert [engine.call("add", 10), engine.call("add", 10)] == [1, 0]


def test_workload_generator(engine):
    assert engine.procedure("CreateDBs('w', 50);") == 0
    assert engine.procedure("COUNT('SELECT FROM w');") == 50
    assert not engine.execute("INSERT INTO w (w.i, w.s, w.t) VALUES (49, 'a', 'b');").success


@pytest.mark.parametrize("source", ["PROCEDURE p(INT x) BEGIN RETURN x; ", "PROCEDURE p(INT x) BEGIN y = 1; END", "PROCEDURE p(INT x) BEGIN !nothing(); END", "PROCEDURE p(INT x, INT x) BEGIN RETURN x; END", "PROCEDURE p(INT x) BEGIN RETURN x + 1; END"])
def test_rejected(engine, source):
    with pytest.raises(ProcedureError):
        engine.create_procedure(source)


def test_missing_return(engine):
    engine.create_procedure("PROCEDURE p(INT x) BEGIN x := 1; END")
    assert not engine.execute("p(1);").success
    assert not engine.execute("p(1, 2);").success


def test_first_of_equal_names_counts(engine):
    engine.define("CREATE TABLE q (s STRING(8), i INT);")
    engine.modify("INSERT INTO q (q.s, q.i) VALUES ('5', 77);")
    engine.create_procedure('PROCEDURE f(STRING query) BEGIN TUPLE t; AUTO v; FOREACH (t IN query) v := !attrval(t, "i"); RETURN v; END')
    assert engine.procedure("f('JOIN r, q ON r.s = q.s');") == 0
