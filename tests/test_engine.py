"""Statements end to end: tables with keys, cascades, views, joins, sorts, aggregates."""

import pytest
from pyspark.sql import functions as F

from larkspur.engine import Engine, bind
from larkspur.errors import ConstraintError, ParseError, SemanticError
from larkspur.operators import compiler
from larkspur.plans import tree as t
from larkspur.script import AssertionFailed, Script


@pytest.fixture
def staff(spark):
    e = Engine(spark)
    e.define("CREATE TABLE staff (name STRING(32) PRIMARY KEY, note STRING(64));")
    e.define("CREATE TABLE pay (name STRING(32) FOREIGN KEY(staff,name), age INT, amount FLOAT);")
    e.define("CREATE TABLE town (town STRING(32), name STRING(32) FOREIGN KEY(staff,name));")
    for name in ("Ada", "Bo", "Cleo", "Dov"):
        e.modify(f"INSERT INTO staff (staff.name, staff.note) VALUES ('{name}', 'n {name}');")
    for name, age, amount in (("Ada", 21, 10.5), ("Bo", 57, 13.1), ("Cleo", 21, -1.0)):
        e.modify(f"INSERT INTO pay (pay.amount, pay.name, pay.age) VALUES ({amount}F, '{name}', {age});")
    for name, town in (("Ada", "Ulm"), ("Cleo", "Bonn"), ("Ada", "Kiel")):
        e.modify(f"INSERT INTO town (town.name, town.town) VALUES ('{name}', '{town}');")
    return e


def rows(e, text):
    return sorted(map(tuple, e.query(text).collect()))


def test_keys_are_enforced(staff):
    with pytest.raises(ConstraintError):
        staff.modify("INSERT INTO staff (staff.name, staff.note) VALUES ('Ada', 'again');")
    with pytest.raises(ConstraintError):
        staff.modify("INSERT INTO pay (pay.name, pay.age, pay.amount) VALUES ('Nobody', 1, 1.0F);")
    assert len(rows(staff, "SELECT FROM pay;")) == 3


def test_domains_are_exact(staff):
    for bad in ("SELECT FROM pay WHERE pay.age = 21L;", "SELECT FROM pay WHERE pay.amount = 13.1;", "SELECT FROM pay WHERE pay.age = '21';", "JOIN staff, pay ON staff.name = pay.age;"):
        assert not staff.execute(bad).success
    assert len(rows(staff, "SELECT FROM pay WHERE pay.amount = 13.1F;")) == 1


def test_strings_are_cut_to_their_bytes(spark):
    e = Engine(spark)
    e.define("CREATE TABLE s (a STRING(4));")
    e.modify("INSERT INTO s (s.a) VALUES ('abcdef');")
    e.modify("INSERT INTO s (s.a) VALUES ('aäöü');")
    assert rows(e, "SELECT FROM s;") == [("abc",), ("aä",)]
    e.insert_rows("s", spark.createDataFrame([("xäöü",), ("abcdef",)], "a string"))
    assert rows(e, "SELECT FROM s;") == [("abc",), ("abc",), ("aä",), ("xä",)]


def test_joins(staff):
    natural = staff.execute("JOIN staff, pay;")
    assert natural.attrs == ["staff.name", "staff.note", "pay.name", "pay.age", "pay.amount"]
    assert natural.relation.df.count() == 3
    assert len(rows(staff, "JOIN staff, pay ON staff.name = pay.name;")) == 3
    assert len(rows(staff, "JOIN staff, pay ON staff.name < pay.name;")) == 3
    assert len(rows(staff, "JOIN staff, pay ON staff.name != pay.name;")) == 9
    assert len(rows(staff, "JOIN (JOIN staff, pay), town;")) == 3
    assert not staff.execute("JOIN staff, staff;").success
    assert not staff.execute("JOIN (JOIN staff, pay), pay;").success
    product = Engine(staff.spark)
    product.define("CREATE TABLE p (a INT);")
    product.define("CREATE TABLE q (b INT);")
    for i in range(3):
        product.modify(f"INSERT INTO p (p.a) VALUES ({i});")
        product.modify(f"INSERT INTO q (q.b) VALUES ({i});")
    assert len(rows(product, "JOIN p, q;")) == 9
    assert len(rows(product, "JOIN p, q ON p.a <= q.b;")) == 6


def test_projection_union_and_sort(staff):
    assert len(rows(staff, "PROJECT pay OVER pay.age;")) == 3
    assert [r[0] for r in staff.query("SORT (PROJECT pay OVER pay.age) BY pay.age DESC;").collect()] == [57, 21]
    assert staff.query("PROJECT pay OVER pay.age, pay.age;").columns == ["age", "age_2"]
    assert len(rows(staff, "UNION (SELECT FROM pay WHERE pay.age = 21), pay;")) == 5
    assert not staff.execute("UNION staff, pay;").success
    assert not staff.execute("UNION staff, town;").success
    ordered = staff.query("SELECT FROM (SORT pay BY pay.age, pay.name DESC) WHERE pay.age >= 21;").collect()
    assert [r["name"] for r in ordered] == ["Cleo", "Ada", "Bo"]


def test_or_mode(staff):
    text = "SELECT FROM pay WHERE pay.age = 21 OR pay.amount > 0.0F;"
    assert len(rows(staff, text)) == 3
    bag = Engine(staff.spark, or_mode="bag")
    bag.register("pay", staff.catalog.frame(staff.catalog.table("pay")))
    assert len(rows(bag, text)) == 4


def test_nand_and_nor(staff):
    leaf = lambda op, v: t.Compare(t.AttrName("pay", "age"), op, t.Literal("INT", v))
    for op, want in (("NAND", 3), ("NOR", 1)):
        assert staff.run_tree(t.Select(t.Table("pay"), t.Bool(op, leaf("=", 21), leaf("<", 0)))).relation.df.count() == want


def test_views_are_late_bound(staff):
    staff.define("CREATE VIEW $all AS SORT (PROJECT (JOIN (JOIN staff, town), pay) OVER staff.name, town.town, pay.age) BY town.town;")
    staff.define("CREATE VIEW $young AS SELECT FROM $all WHERE pay.age <= 30;")
    assert [r[1] for r in staff.query("SELECT FROM $all;").collect()] == ["Bonn", "Kiel", "Ulm"]
    staff.modify("DELETE staff WHERE staff.name = 'Cleo';")
    assert len(rows(staff, "SELECT FROM $young;")) == 2
    assert not staff.execute("DELETE $young;").success
    assert not staff.execute("CREATE VIEW $all AS SELECT FROM staff;").success
    staff.define("DROP VIEW $young;")
    assert not staff.execute("SELECT FROM $young;").success


def test_delete_and_update_cascade(staff):
    assert staff.modify("UPDATE staff SET staff.name = 'Eve' WHERE staff.name = 'Ada';") == 4
    assert len(rows(staff, "SELECT FROM town WHERE town.name = 'Eve';")) == 2
    assert staff.modify("DELETE staff WHERE staff.name = 'Eve';") == 4
    assert len(rows(staff, "SELECT FROM town;")) == 1 and len(rows(staff, "SELECT FROM pay;")) == 2
    assert staff.modify("DELETE pay WHERE pay.age > 100;") == 0
    assert staff.modify("UPDATE pay SET pay.age = 1 WHERE pay.age < 100 OR pay.age > 50;") == 2
    with pytest.raises(ConstraintError):
        staff.modify("UPDATE staff SET staff.name = 'Bo' WHERE staff.name = 'Dov';")
    with pytest.raises(ConstraintError):
        staff.modify("UPDATE staff SET staff.name = 'New';")
    with pytest.raises(ConstraintError):
        staff.modify("UPDATE pay SET pay.name = 'Nobody';")
    assert len(rows(staff, "SELECT FROM staff;")) == 3
    assert staff.modify("DELETE staff;") == 3 + 2 + 1
    assert rows(staff, "SELECT FROM town;") == []


def test_two_level_cascade_over_two_keys(spark):
    e = Engine(spark)
    e.define("CREATE TABLE part (Id UINT PRIMARY KEY, Name STRING(16));")
    e.define("CREATE TABLE link (Id ULONG PRIMARY KEY, One UINT FOREIGN KEY(part,Id), Two UINT FOREIGN KEY(part,Id));")
    e.define("CREATE TABLE note (Link ULONG FOREIGN KEY(link,Id), Text STRING(16));")
    for i in range(1, 6):
        e.modify(f"INSERT INTO part (part.Id, part.Name) VALUES ({i}U, 'p{i}');")
    assert not e.execute("INSERT INTO part (part.Id, part.Name) VALUES (6, 'int');").success
    for i, (a, b) in enumerate(((1, 2), (2, 3), (3, 3), (4, 5))):
        e.modify(f"INSERT INTO link (link.Id, link.One, link.Two) VALUES ({i + (1 << 63)}UL, {a}U, {b}U);")
        e.modify(f"INSERT INTO note (note.Link, note.Text) VALUES ({i + (1 << 63)}UL, 'x');")
    assert e.modify("UPDATE part SET part.Id = 99U WHERE part.Name = 'p3';") == 3
    assert len(rows(e, "SELECT FROM link WHERE link.One = 99U OR link.Two = 99U;")) == 2
    assert e.modify("DELETE part WHERE part.Id = 99U;") == 1 + 2 + 2
    assert [len(rows(e, f"SELECT FROM {n};")) for n in ("part", "link", "note")] == [4, 2, 2]
    e.define("DROP TABLE part;")
    assert not e.catalog.tables


def test_aggregates(staff):
    calls = {"COUNT('SELECT FROM pay')": 3, "MIN('SELECT FROM pay', 'name')": "Ada", "MAX('SELECT FROM pay;', 0)": "Cleo", "MIN('SELECT FROM pay', 'age')": 21, "AVG('SELECT FROM pay', 'age')": 33.0, "AVG('SELECT FROM pay', 'name')": 0.0, "SUM('SELECT FROM pay', 'age')": 99, "VAR('SELECT FROM pay', 'age')": 288.0, "SUM('SELECT FROM pay', 'name')": 9}
    for call, want in calls.items():
        assert staff.procedure(call + ";") == pytest.approx(want) if isinstance(want, float) else staff.procedure(call + ";") == want
    none = "SELECT FROM pay WHERE pay.age > 100"
    assert [staff.procedure(f"{f}('{none}', 'name');") for f in ("MIN", "MAX")] == [0, 0]
    assert staff.procedure(f"AVG('{none}', 'age');") == 0.0 and staff.procedure(f"COUNT('{none}');") == 0
    assert not staff.execute("MIN('SELECT FROM pay', 'nothing');").success


def test_indexes_are_marks(staff):
    staff.define("CREATE INDEX ON pay (age);")
    assert not staff.execute("CREATE INDEX ON pay (age);").success
    staff.define("DROP INDEX pay (age);")
    staff.define("CREATE INDEX ON pay (age);")


def test_catalog_survives(spark, tmp_path):
    with Engine(spark, str(tmp_path)) as e:
        e.define("CREATE TABLE r (a INT PRIMARY KEY, b STRING(8));")
        e.modify("INSERT INTO r (r.a, r.b) VALUES (1, 'x');")
        e.define("CREATE VIEW $v AS SELECT FROM r WHERE r.a = 1;")
        e.create_procedure('PROCEDURE p(INT x) BEGIN INT y; y := (x + 1); RETURN y; END')
    again = Engine(spark, str(tmp_path))
    assert rows(again, "SELECT FROM $v;") == [(1, "x")]
    assert again.procedure("p(4);") == 5


def test_bulk_insert_is_atomic(staff):
    spark = staff.spark
    good = spark.createDataFrame([("Ada", 1, 1.0), ("Bo", 2, 2.0)], "name string, age int, amount float")
    assert staff.insert_rows("pay", good) == 2
    for bad in ([("Ada", 1, 1.0), ("Nobody", 2, 2.0)], [("Ada", None, 1.0)]):
        with pytest.raises((ConstraintError, SemanticError)):
            staff.insert_rows("pay", spark.createDataFrame(bad, "name string, age int, amount float"))
    with pytest.raises(ConstraintError):
        staff.insert_rows("staff", spark.createDataFrame([("Zoe", "a"), ("Zoe", "b")], "name string, note string"))
    assert len(rows(staff, "SELECT FROM pay;")) == 5


def test_formatting(staff):
    assert bind("SELECT FROM r WHERE r.a = '%e' AND r.b = %ld", "it's", 5) == "SELECT FROM r WHERE r.a = 'it\\'s' AND r.b = 5L;"
    staff.executef("INSERT INTO staff (staff.name, staff.note) VALUES ('%e', '%s')", "D'Arcy", "x")
    found = staff.executef("SELECT FROM staff WHERE staff.name = '%e'", "D'Arcy")
    assert [r["staff.name"] for r in found.records()] == ["D'Arcy"]
    assert "| staff.name |" in found.table()
    with pytest.raises(SemanticError):
        bind("%d")


def test_kinds(staff):
    assert [staff.execute(s).kind for s in ("SELECT FROM pay;", "DELETE pay WHERE pay.age = 0;", "CREATE INDEX ON pay (age);", "COUNT('SELECT FROM pay');", "nonsense")] == ["query", "modification", "definition", "procedure", "error"]
    with pytest.raises(ParseError):
        staff.query("nonsense")


def test_script(staff, tmp_path):
    (tmp_path / "more.txt").write_text("# comment\ncount b SELECT FROM staff;\n")
    (tmp_path / "main.txt").write_text("count a SELECT FROM pay;\nassert a = 3\n@more.txt\nassert a + 1 = b\nassert b > a\necho b\nprofiling-on\nSELECT FROM pay WHERE pay.age = 57;\nDELETE pay WHERE pay.age = 57;\nstore gone\nassert gone = 1\nbroken statement\nexit\nassert 1 = 2\n")
    done = Script(staff).run_file(tmp_path / "main.txt")
    assert done.output[0] == "b = 4" and "57" in done.output[1]
    assert len(done.errors) == 1 and len(done.timings) == 3
    with pytest.raises(AssertionFailed):
        Script(staff).run("assert 1 = 2")


def test_predicates_reach_the_scan(spark, tmp_path):
    spark.range(100).selectExpr("CAST(id AS INT) AS a", "CAST(id AS STRING) AS b").write.parquet(str(tmp_path / "r.parquet"))
    e = Engine(spark).register_parquet(str(tmp_path), "r")
    plan = e.query("PROJECT (SELECT FROM r WHERE r.a >= 5) OVER r.a;")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(a,5)" in plan and "ReadSchema: struct<a:int>" in plan


def test_streams(spark, tmp_path):
    from larkspur.streaming import over_stream

    spark.range(10).selectExpr("CAST(id AS INT) AS a").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("a int").parquet(str(tmp_path / "in"))
    out = over_stream(Engine(spark), "s", stream, "SELECT FROM s WHERE s.a >= 5;")
    q = out.writeStream.format("memory").queryName("larkspur_s").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("larkspur_s").count() == 5
    with pytest.raises(SemanticError):
        over_stream(Engine(spark), "s", stream, "SORT s BY s.a;")


def test_keys_save_the_shuffle_of_a_sort(staff):
    plan = lambda text: staff.query(text)._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan("SORT (SELECT FROM staff WHERE staff.name > 'A') BY staff.note;")
    assert "Aggregate" in plan("SORT (PROJECT staff OVER staff.note) BY staff.note;")
    assert "Aggregate" in plan("SORT (UNION staff, staff) BY staff.note;")
    assert "Aggregate" in plan("SORT (JOIN staff, pay) BY pay.age;")
    assert len(rows(staff, "SORT (UNION staff, staff) BY staff.note;")) == 4


SPREAD = "JOIN many, few ON many.k = few.k AND many.v < few.v;"


def test_pairs_of_one_key_are_made_by_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(compiler, "_PRODUCT_BYTES", 1 << 26, raising=False)
    many = spark.range(0, 100_000, 1, 1).selectExpr("id AS i", "pmod(id, 1L) AS k", "pmod(id * 7919, 100000L) AS v")
    few = spark.range(0, 100, 1, 1).selectExpr("id AS j", "pmod(id, 1L) AS k", "10 * id AS v")
    for text in (SPREAD, "JOIN few, many ON few.v > many.v AND few.k = many.k;"):
        e = Engine(spark)
        e.register("many", many)
        e.register("few", few)
        got = e.query(text)
        parts = [r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()]
        assert sum(parts) == sum(10 * j for j in range(100)) == got.select("i", "j").distinct().count()
        assert len(parts) >= 6 and max(parts) < 0.5 * sum(parts)


@pytest.mark.parametrize("mode", ("set", "bag"))
def test_dealt_joins_keep_rows(spark, mode, monkeypatch):
    monkeypatch.setattr(compiler, "_PRODUCT_BYTES", 1)
    # every row twice, keys that one side lacks
    many = [(i % 7, i * 37 % 101, f"m{i % 5}") for i in range(300)] * 2
    few = [(j % 9, j * 53 % 101, f"m{j % 3}") for j in range(20)] * 2
    e = Engine(spark, or_mode=mode)
    for name, table in (("many", many), ("few", few)):
        # a range, as Spark knows its size
        cell = lambda i, t=table: F.element_at(F.array(*(F.lit(r[i]) for r in t)), F.col("id").cast("int") + 1)
        e.register(name, spark.range(len(table)).select(*(cell(i).alias(c) for i, c in enumerate(("k", "v", "s")))))
    pairs = [(a, b) for a in many for b in few if a[0] == b[0] and a[1] < b[1]]
    assert rows(e, SPREAD) == sorted(a + b for a, b in pairs)
    assert "larkspur:deal" in e.query(SPREAD)._jdf.queryExecution().analyzed().toString()
    assert rows(e, "JOIN few, many ON few.v > many.v AND few.k = many.k;") == sorted(b + a for a, b in pairs)
    assert rows(e, f"SORT ({SPREAD[:-1]}) BY many.v;") == sorted({a + b for a, b in pairs})
    assert rows(e, f"UNION ({SPREAD[:-1]}), ({SPREAD[:-1]});") == sorted(2 * [a + b for a, b in pairs])
    either = "JOIN many, few ON many.k = few.k AND many.v < few.v AND (many.s = few.s OR many.v != few.v);"
    want = [a + b for a, b in pairs for met in ([a[2] == b[2], True] if mode == "bag" else [True]) if met]
    assert rows(e, either) == sorted(want)
