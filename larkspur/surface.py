"""Registered queries over what is not a query: procedures, definitions, storage, scripts, the API and XML.

Each returns rows that its SQL states from the same tables, so a wrong step shows
as a wrong value.
"""

from __future__ import annotations

import tempfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, functions as F

from .engine import Engine
from .errors import EngineError
from .script import Script
from .sources.catalog import Catalog

Query = Callable[[SparkSession, str], DataFrame]

_NATIONS = "SORT nation BY nation.n_nationkey"


def _engine(spark: SparkSession, sf_dir: str, *tables: str) -> Engine:
    return Engine(spark).register_parquet(sf_dir, *tables)


def _root(spark: SparkSession) -> str:
    """A root for engines that follow one another; it goes when the interpreter ends."""
    catalog = Catalog(spark)
    return catalog.root


def _items(spark: SparkSession, *rows: tuple[str, object]) -> DataFrame:
    return spark.createDataFrame([(name, str(value)) for name, value in rows], "item string, value string")


# procedures: an expression for each nation, joined in order of the key

_EACH = """PROCEDURE Each(STRING query, STRING attr) BEGIN
  TUPLE t; STRING out; AUTO v; AUTO w; INT n;
  out := "";
  FOREACH (t IN query) DO
    v := !attrval(t, attr);
    w := "-";
    {body}
    out := ((out + w) + "|");
  END
  RETURN out;
END"""

#: name -> (attribute, body, SQL of one nation's part)
_PROCEDURES: dict[str, tuple[str, str, str]] = {
    "proc_substr": ("n_name", "w := !substr(v, 7, 2);", "CASE WHEN length(n_name) >= 9 THEN substr(n_name, 8, 2) ELSE '-' END"),
    "proc_substr_backward": ("n_name", "w := !substr(v, 6, (-3));", "substr(n_name, 4, 3)"),
    "proc_strindex": ("n_name", 'w := !strindex(v, "_2");', "strpos(n_name, '_2') - 1"),
    "proc_strlen": ("n_name", "w := !strlen(v);", "length(n_name)"),
    "proc_is_int": ("n_nationkey", 'w := (!is_int(v) + (10 * !is_int("x")));', "1"),
    "proc_is_float": ("n_nationkey", "w := (!is_float((v / 2.0)) + (10 * !is_float(v)));", "1"),
    "proc_is_string": ("n_name", "w := (!is_string(v) + (10 * !is_string(1)));", "1"),
    "proc_to_int": ("n_name", 'w := !to_int((!substr(v, 7, 1) + "x"));', "substr(n_name, 8, 1)::INTEGER"),
    "proc_to_float": ("n_nationkey", 'w := !to_float((v + ".5"));', "printf('%.6f', n_nationkey + 0.5)"),
    "proc_to_string": ("n_nationkey", "w := !strlen(!to_string((v * 100)));", "length((n_nationkey * 100)::VARCHAR)"),
    "proc_arithmetic": ("n_nationkey", "w := (((v * 7) - 50) / 4);", "trunc((n_nationkey * 7 - 50) / 4.0)::INTEGER"),
    "proc_float_arithmetic": ("n_nationkey", "w := ((v * 0.5) - 2);", "printf('%.6f', n_nationkey * 0.5 - 2)"),
    "proc_negation": ("n_nationkey", "w := (-v);", "-n_nationkey"),
    "proc_concatenation": ("n_nationkey", 'w := (("<" + v) + ">");', "'<' || n_nationkey || '>'"),
    "proc_comparisons": (
        "n_nationkey",
        'w := ((((((v = 7) + (10 * (v != 7))) + (100 * (v < 7))) + (1000 * (v <= 7))) + (10000 * (v > 7))) + (100000 * (v >= 7)));',
        "(n_nationkey = 7)::INT + 10 * (n_nationkey <> 7)::INT + 100 * (n_nationkey < 7)::INT + 1000 * (n_nationkey <= 7)::INT + 10000 * (n_nationkey > 7)::INT + 100000 * (n_nationkey >= 7)::INT",
    ),
    "proc_logic": ("n_nationkey", "w := (((v > 5) AND (v < 20)) OR (v = 2));", "((n_nationkey > 5 AND n_nationkey < 20) OR n_nationkey = 2)::INT"),
    "proc_truth": ("n_nationkey", 'n := 0; IF (v) n := (n + 1); IF ("") n := (n + 10); IF ("x") n := (n + 100); IF (0.0) n := (n + 1000); w := n;', "100 + (n_nationkey <> 0)::INT"),
    "proc_while": ("n_nationkey", "n := 0; WHILE ((v > 0)) DO n := (n + v); v := (v - 1); END w := n;", "n_nationkey * (n_nationkey + 1) // 2"),
    "proc_blocks": ("n_nationkey", "n := v; WHILE ((n > 9)) DO IF ((n > 19)) DO n := (n - 20); END IF ((n > 9)) n := (n - 10); END w := n;", "n_nationkey % 10"),
    "proc_failed_assignment": ("n_name", 'n := 5; n := v; n := (v - 1); n := (1 / 0); w := n;', "5"),
    "proc_attrcount": ("n_name", "w := !attrcount(t);", "3"),
    "proc_attrname": ("n_name", "n := 0; w := \"\"; WHILE ((n < !attrcount(t))) DO w := ((w + !attrname(t, n)) + \",\"); n := (n + 1); END", "'n_nationkey,n_name,n_regionkey,'"),
    "proc_attrval": ("n_name", 'w := ((!attrval(t, 0) + "/") + !attrval(t, "n_regionkey"));', "n_nationkey || '/' || n_regionkey"),
}


def _each(attr: str, body: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        e = _engine(spark, sf_dir, "nation")
        e.create_procedure(_EACH.format(body=body))
        return spark.createDataFrame([(e.procedure(f"Each('{_NATIONS}', '{attr}');"),)], "value string")

    return run


def proc_exec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A procedure that inserts what it reads; each row's second insertion fails."""
    e = _engine(spark, sf_dir, "nation")
    e.define("CREATE TABLE copy (k INT PRIMARY KEY, ok INT);")
    e.create_procedure(
        """PROCEDURE Copy(STRING query) BEGIN
             TUPLE t; INT good; STRING s;
             good := 0;
             FOREACH (t IN query) DO
               s := (("INSERT INTO copy (copy.k, copy.ok) VALUES (" + !attrval(t, 0)) + ", 1);");
               good := (good + !exec(s));
               good := (good + (100 * !exec(s)));
             END
             RETURN good;
           END"""
    )
    good = e.call("Copy", "SELECT FROM nation")
    return e.query("SELECT FROM copy;").withColumn("good", F.lit(good))


def proc_echo(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _engine(spark, sf_dir, "nation")
    e.create_procedure('PROCEDURE Say(STRING query) BEGIN TUPLE t; FOREACH (t IN query) DO !echo(!attrval(t, 1)); !newline(); END RETURN 0; END')
    e.call("Say", _NATIONS)
    return spark.createDataFrame([("".join(e.printed),)], "value string")


def proc_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A procedure and a view of one engine, called and read by the next one on the same root."""
    root = _root(spark)
    with Engine(spark, root) as one:
        one.define("CREATE TABLE n (k INT PRIMARY KEY, name STRING(32));")
        one.insert_rows("n", spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name")))
        one.define("CREATE VIEW $small AS SORT (SELECT FROM n WHERE n.k < 7 OR n.k = 20) BY n.name;")
        one.create_procedure("PROCEDURE Half(INT x) BEGIN RETURN (x / 2); END")
    two = Engine(spark, root)
    return two.query("SELECT FROM $small;").withColumn("half", F.lit(two.call("Half", 15)))


def row_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    script = Script(_engine(spark, sf_dir, "orders"))
    script.run("count a SELECT FROM orders WHERE orders.o_custkey < 50L;\ncount b SELECT FROM orders;\nassert a < b\nassert b - a > 0\necho a")
    return _items(spark, ("a", script.variables["a"]), ("b", script.variables["b"]), ("errors", len(script.errors)))


# definitions and storage


def _outcomes(e: Engine, *statements: str) -> list[tuple[str, object]]:
    return [(s, int(e.execute(s).success)) for s in statements]


def drop_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dropping a table drops what refers to it, and leaves no file behind."""
    root = _root(spark)
    e = Engine(spark, root)
    for s in ("CREATE TABLE a (k INT PRIMARY KEY);", "CREATE TABLE b (k INT PRIMARY KEY, a INT FOREIGN KEY(a,k));", "CREATE TABLE c (b INT FOREIGN KEY(b,k));", "CREATE TABLE d (k INT);"):
        e.define(s)
    for name, rows in (("a", [(1,)]), ("b", [(5, 1)]), ("c", [(5,)]), ("d", [(7,)])):
        e.insert_rows(name, spark.createDataFrame(rows, ", ".join(f"{a.name} int" for a in e.catalog.table(name).attrs)))
    folders = [e.catalog._path(f"{root}/{n}") for n in "abcd"]
    e.define("DROP TABLE b;")
    left = [(n, int(e.execute(f"SELECT FROM {n};").success)) for n in "abcd"]
    return _items(spark, *left, *((f"{n} files", str(e.catalog._fs(p).exists(p)).lower()) for n, p in zip("abcd", folders, strict=True)))


def drop_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _engine(spark, sf_dir, "nation")
    return _items(spark, *_outcomes(e, "CREATE VIEW $v AS SELECT FROM nation;", "SELECT FROM $v;", "DROP VIEW $v;", "SELECT FROM $v", "DROP VIEW $v; "))


def indexes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = Engine(spark)
    e.define("CREATE TABLE t (k INT PRIMARY KEY, v INT);")
    return _items(spark, *_outcomes(e, "CREATE INDEX ON t (v);", "CREATE INDEX ON t (v)  ;", "DROP INDEX t (v);", "DROP INDEX t (v)  ;", "CREATE INDEX ON t (v) ;", "DROP INDEX t (k);", "CREATE INDEX ON t (nothing);"))


def key_rejections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What single and bulk insertions, updates and deletions refuse leaves the tables as they were."""
    e = Engine(spark)
    e.define("CREATE TABLE zone (key INT PRIMARY KEY, name STRING(64));")
    e.define("CREATE TABLE land (key INT PRIMARY KEY, zone INT FOREIGN KEY(zone,key));")
    region, nation = (spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in ("region", "nation"))
    e.insert_rows("zone", region.select(F.col("r_regionkey").alias("key"), F.col("r_name").alias("name")))
    land = nation.select(F.col("n_nationkey").alias("key"), F.col("n_regionkey").alias("zone"))
    e.insert_rows("land", land)
    for bad in (land, land.withColumn("key", F.col("key") + 100).withColumn("zone", F.lit(77)), land.withColumn("key", F.lit(200))):
        try:
            e.insert_rows("land", bad)
        except EngineError:
            continue
        raise AssertionError("a bad row went in")
    for bad in ("INSERT INTO land (land.key, land.zone) VALUES (3, 1);", "INSERT INTO land (land.key, land.zone) VALUES (300, 9);", "UPDATE land SET land.key = 4 WHERE land.key = 5;", "UPDATE land SET land.zone = 9 WHERE land.key = 5;"):
        if e.execute(bad).success:
            raise AssertionError(bad)
    return e.query("SELECT FROM land;")


def reopened(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a table after changes by two engines, one after the other."""
    root = _root(spark)
    with Engine(spark, root) as one:
        one.define("CREATE TABLE c (k LONG PRIMARY KEY, name STRING(32), bal DOUBLE);")
        customer = spark.read.parquet(f"{sf_dir}/customer.parquet")
        one.insert_rows("c", customer.select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("bal")))
        one.modify("DELETE c WHERE c.bal < 0.0;")
    with Engine(spark, root) as two:
        two.modify("UPDATE c SET c.name = 'rich' WHERE c.bal > 9000.0;")
        two.modify("INSERT INTO c (c.k, c.name, c.bal) VALUES (-1L, 'new', 0.5);")
    return Engine(spark, root).query("SELECT FROM c;")


def insert_multibyte(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strings cut to five bytes inside characters of two, three and four bytes, in bulk and one by one."""
    e = Engine(spark)
    e.define("CREATE TABLE s (k INT PRIMARY KEY, way STRING(8), name STRING(6));")
    long = F.concat(F.repeat(F.lit("a"), F.col("n_nationkey") % 6), F.when(F.col("n_nationkey") % 2 == 0, "ö€😀é").otherwise("€😀öé"))
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet")
    e.insert_rows("s", nation.select(F.col("n_nationkey").alias("k"), F.lit("bulk").alias("way"), long.alias("name")))
    for i in range(12):
        name = "a" * (i % 6) + ("ö€😀é" if i % 2 == 0 else "€😀öé")
        e.modify(f"INSERT INTO s (s.k, s.way, s.name) VALUES ({100 + i}, 'single', '{name}');")
    return e.query("SELECT FROM s;")


# results, scripts and the API


def ascii_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ASCII table of a query, one row a line."""
    result = _engine(spark, sf_dir, "nation").execute("SORT (PROJECT nation OVER nation.n_nationkey, nation.n_name) BY nation.n_nationkey;")
    return spark.createDataFrame([(i, line) for i, line in enumerate(result.lines())], "nth long, line string")


def cursor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows by position, drawn one at a time."""
    result = _engine(spark, sf_dir, "nation").execute(f"{_NATIONS};")
    return spark.createDataFrame([(i, r[1], r[2]) for i, r in enumerate(result.rows())], "nth long, name string, region int")


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows as records under ``table.attribute``."""
    result = _engine(spark, sf_dir, "nation", "region").execute("JOIN nation, region ON nation.n_regionkey = region.r_regionkey;")
    return spark.createDataFrame([(r["nation.n_name"], r["region.r_name"]) for r in result.records()], "nation string, region string")


def kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _engine(spark, sf_dir, "nation")
    e.define("CREATE TABLE k (a INT);")
    statements = ("SELECT FROM nation;", "INSERT INTO k (k.a) VALUES (1);", "CREATE INDEX ON k (a);", "COUNT('SELECT FROM nation');", "SELECT nothing;", "SELECT FROM nothing;", "SELECT FROM nation WHERE nation.n_name = 1;")
    results = [(s, e.execute(s)) for s in statements]
    return _items(spark, *((s, f"{r.kind} {type(r.exception).__name__ if r.exception else '-'}") for s, r in results))


def counts_and_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each kind of result holds."""
    e = _engine(spark, sf_dir, "nation")
    query, change, call = (e.execute(s) for s in ("SELECT FROM nation;", "DELETE nation WHERE nation.n_regionkey = 1;", "COUNT('SELECT FROM nation');"))
    return _items(spark, ("attributes", ",".join(query.attrs)), ("deleted", change.count), ("left", call.value))


def placeholders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statements with values filled in."""
    e = _engine(spark, sf_dir, "customer", "nation")
    e.define("CREATE TABLE quoted (s STRING(32));")
    e.executef("INSERT INTO quoted (quoted.s) VALUES ('%e')", "it's")
    found = e.executef("SELECT FROM %s WHERE customer.c_custkey < %ld AND customer.c_acctbal > %lf", "customer", 200, 100.5)
    quote = e.executef("SELECT FROM quoted WHERE quoted.s = '%e'", "it's").relation.df.count()
    return found.df.select("c_custkey", F.lit(quote).cast("long").alias("quoted"))


def freed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What changes left behind is removed: one part is left of a table changed three times."""
    root = _root(spark)
    with Engine(spark, root) as e:
        e.define("CREATE TABLE c (k INT PRIMARY KEY, v INT);")
        e.insert_rows("c", spark.range(100).selectExpr("CAST(id AS INT) AS k", "0 AS v").coalesce(1))
        for i in (1, 2, 3):
            e.modify(f"UPDATE c SET c.v = {i} WHERE c.k = 5;")
    folder = e.catalog._path(f"{root}/c")
    parts = len(e.catalog._fs(folder).listStatus(folder))
    return Engine(spark, root).query("SELECT FROM c WHERE c.v > 0;").withColumn("parts", F.lit(parts))


def script_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A script that runs another, stores counts, asserts, echoes, times statements and goes on after errors."""
    script = Script(_engine(spark, sf_dir, "orders", "nation"), stop_at_failure=False)
    # scripts are the driver's own files
    with tempfile.TemporaryDirectory() as folder:
        Path(folder, "inner.txt").write_text("# counts\ncount n SELECT FROM nation;\nDELETE nation WHERE nation.n_nationkey >= 20;\nstore gone\n")
        Path(folder, "outer.txt").write_text(
            "count o SELECT FROM orders;\n@inner.txt\ncount rest SELECT FROM nation;\nassert rest + gone = n\nassert n = 0\nnonsense\nprofiling-on\nSELECT FROM nation WHERE nation.n_nationkey = 3;\nCOUNT('SELECT FROM nation');\nprofiling-off\necho gone\nexit\nassert 1 = 2\n"
        )
        script.run_file(Path(folder, "outer.txt"))
    return _items(spark, *sorted(script.variables.items()), ("errors", len(script.errors)), ("timed", len(script.timings)), ("echoed", script.output[-1]), ("counted", script.output[-2]))


def workload_joins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two generated tables joined on an indexed and on a plain string, sorted by strings."""
    e = Engine(spark)
    e.procedure("CreateDBs('i', 3000);")
    e.procedure("CreateDBs('j', 2000);")
    e.modify("UPDATE j SET j.t = '77' WHERE j.i >= 1990;")
    return e.query("SORT (PROJECT (JOIN i, j ON i.s = j.t) OVER i.i, j.i, j.s) BY j.s DESC, i.i;")


# XML


def _shelves(spark: SparkSession, sf_dir: str):
    """Regions as documents with typed attributes and their nations inside, loaded."""
    from .xmlmap.dtd import DTD, parse_dtd
    from .xmlmap.mapping import create, load

    dtd = parse_dtd(
        """<!ELEMENT region (name, nation*, note?)><!ATTLIST region key CDATA #REQUIRED DBTkey CDATA #FIXED "STRING(8)" size CDATA #REQUIRED DBTsize CDATA #FIXED "INT">
           <!ELEMENT name (#PCDATA)><!ATTLIST name DBT CDATA #FIXED "STRING(30)"><!ELEMENT note EMPTY>
           <!ELEMENT nation (#PCDATA)><!ATTLIST nation id CDATA #REQUIRED odd CDATA #IMPLIED>""",
        "region",
    )
    dtd = DTD.from_json(dtd.to_json())
    region, nation = (spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in ("region", "nation"))
    one = F.concat(F.lit('<nation id="'), F.col("n_nationkey").cast("string"), F.lit('"'), F.when(F.col("n_nationkey") % 2 == 1, ' odd="y"').otherwise(""), F.lit(">a&amp;b "), "n_name", F.lit("</nation>"))
    inner = nation.withColumn("one", one).groupBy("n_regionkey").agg(F.array_sort(F.collect_list(F.struct("n_nationkey", "one"))).alias("all"))
    inner = inner.select("n_regionkey", F.array_join("all.one", "").alias("inner"), F.size("all").alias("n"))
    xml = F.concat(F.lit('<region key="'), F.col("r_regionkey").cast("string"), F.lit('" size="'), F.col("n").cast("string"), F.lit('"><name>'), "r_name", F.lit("</name>"), "inner", F.when(F.col("r_regionkey") == 2, "<note/>").otherwise(""), F.lit("</region>"))
    docs = region.join(inner, region.r_regionkey == inner.n_regionkey).select(F.col("r_regionkey").alias("doc_no"), xml.alias("xml"))
    e = Engine(spark)
    create(e, dtd)
    load(e, dtd, docs)
    return e, dtd


def xml_rebuild(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents, shredded and rebuilt."""
    from .xmlmap.mapping import rebuilt

    return rebuilt(*_shelves(spark, sf_dir), "/region").select("xml")


def xml_predicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elements below a parent with a given attribute, rebuilt."""
    from .xmlmap.mapping import rebuilt

    return rebuilt(*_shelves(spark, sf_dir), "/region[key='2']/nation").select("xml")


def xml_typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An attribute declared INT compared as one."""
    e, _ = _shelves(spark, sf_dir)
    return e.query("PROJECT (SELECT FROM E_region WHERE E_region.A_size >= 1) OVER E_region.A_key, E_region.A_size;")


def xml_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The definitions that a saved and loaded DTD graph gives."""
    from .xmlmap.dtd import DTD, parse_dtd
    from .xmlmap.mapping import statements

    dtd = parse_dtd("<!ELEMENT a (b+, c?)><!ATTLIST a id ID #REQUIRED><!ELEMENT b (#PCDATA)><!ELEMENT c EMPTY>", "a")
    return spark.createDataFrame([(s,) for s in statements(DTD.from_json(dtd.to_json()))], "statement string")


_NATION_XML = "'<nation id=\"' || n_nationkey || '\"' || CASE WHEN n_nationkey % 2 = 1 THEN ' odd=\"y\"' ELSE '' END || '>a&amp;b ' || n_name || '</nation>'"
_ITEMS = "SELECT item, value FROM (VALUES {}) v(item, value)"


def _stated(*rows: tuple[str, str]) -> str:
    """SQL for item and value; a value starting with SELECT is a query."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    return _ITEMS.format(", ".join(f"({quote(i)}, {f'({v})::VARCHAR' if v.startswith('SELECT') else quote(v)})" for i, v in rows))


_MORE: dict[str, tuple[Query, str]] = {
    "proc_exec": (proc_exec, "SELECT n_nationkey AS k, 1 AS ok, (SELECT count(*)::INTEGER FROM nation) AS good FROM nation"),
    "proc_echo": (proc_echo, "SELECT string_agg(n_name || chr(10), '' ORDER BY n_nationkey) AS value FROM nation"),
    "proc_kept": (proc_kept, "SELECT n_nationkey AS k, n_name AS name, 7 AS half FROM nation WHERE n_nationkey < 7 OR n_nationkey = 20"),
    "row_count": (row_count, _stated(("a", "SELECT count(*) FROM orders WHERE o_custkey < 50"), ("b", "SELECT count(*) FROM orders"), ("errors", "0"))),
    "drop_table": (drop_table, _stated(("a", "1"), ("b", "0"), ("c", "0"), ("d", "1"), ("a files", "true"), ("b files", "false"), ("c files", "false"), ("d files", "true"))),
    "drop_view": (drop_view, _stated(("CREATE VIEW $v AS SELECT FROM nation;", "1"), ("SELECT FROM $v;", "1"), ("DROP VIEW $v;", "1"), ("SELECT FROM $v", "0"), ("DROP VIEW $v; ", "0"))),
    "indexes": (indexes, _stated(("CREATE INDEX ON t (v);", "1"), ("CREATE INDEX ON t (v)  ;", "0"), ("DROP INDEX t (v);", "1"), ("DROP INDEX t (v)  ;", "0"), ("CREATE INDEX ON t (v) ;", "1"), ("DROP INDEX t (k);", "0"), ("CREATE INDEX ON t (nothing);", "0"))),
    "key_rejections": (key_rejections, "SELECT n_nationkey AS key, n_regionkey AS zone FROM nation"),
    "reopened": (reopened, "SELECT c_custkey AS k, CASE WHEN c_acctbal > 9000 THEN 'rich' ELSE c_name END AS name, c_acctbal AS bal FROM customer WHERE c_acctbal >= 0 UNION ALL SELECT -1, 'new', 0.5::DOUBLE"),
    "insert_multibyte": (
        insert_multibyte,
        """WITH s AS (SELECT n_nationkey AS k, 'bulk' AS way, n_nationkey AS i FROM nation UNION ALL SELECT 100 + r.i::INTEGER, 'single', r.i::INTEGER FROM range(12) r(i)),
        t AS (SELECT k, way, repeat('a', i % 6) || CASE WHEN i % 2 = 0 THEN 'ö€😀é' ELSE '€😀öé' END AS long FROM s)
        SELECT k::INTEGER AS k, way, left(long, list_max(list_filter(range(10), lambda n: octet_length(encode(left(long, n))) <= 5))) AS name FROM t""",
    ),
    "ascii_table": (
        ascii_table,
        """WITH w AS (SELECT greatest(18, max(length(n_nationkey::VARCHAR))) AS a, greatest(13, max(length(n_name))) AS b FROM nation),
        r AS (SELECT '+' || repeat('-', (a + 2)::INTEGER) || '+' || repeat('-', (b + 2)::INTEGER) || '+' AS rule FROM w),
        n AS (SELECT count(*) AS n FROM nation),
        b AS (SELECT row_number() OVER (ORDER BY n_nationkey) + 2 AS nth, '| ' || rpad(n_nationkey::VARCHAR, a::INTEGER, ' ') || ' | ' || rpad(n_name, b::INTEGER, ' ') || ' |' AS line FROM nation, w)
        SELECT 0::BIGINT AS nth, rule AS line FROM r UNION ALL SELECT 1, '| ' || rpad('nation.n_nationkey', a::INTEGER, ' ') || ' | ' || rpad('nation.n_name', b::INTEGER, ' ') || ' |' FROM w
        UNION ALL SELECT 2, rule FROM r UNION ALL SELECT nth, line FROM b UNION ALL SELECT n + 3, rule FROM r, n""",
    ),
    "cursor": (cursor, "SELECT row_number() OVER (ORDER BY n_nationkey) - 1 AS nth, n_name AS name, n_regionkey AS region FROM nation"),
    "records": (records, "SELECT n_name AS nation, r_name AS region FROM nation JOIN region ON n_regionkey = r_regionkey"),
    "kinds": (
        kinds,
        _stated(
            ("SELECT FROM nation;", "query -"), ("INSERT INTO k (k.a) VALUES (1);", "modification -"), ("CREATE INDEX ON k (a);", "definition -"), ("COUNT('SELECT FROM nation');", "procedure -"),
            ("SELECT nothing;", "error ParseError"), ("SELECT FROM nothing;", "error SemanticError"), ("SELECT FROM nation WHERE nation.n_name = 1;", "error SemanticError"),
        ),
    ),
    "counts_and_values": (counts_and_values, _stated(("attributes", "nation.n_nationkey,nation.n_name,nation.n_regionkey"), ("deleted", "SELECT count(*) FROM nation WHERE n_regionkey = 1"), ("left", "SELECT count(*) FROM nation WHERE n_regionkey <> 1"))),
    "placeholders": (placeholders, "SELECT c_custkey, 1::BIGINT AS quoted FROM customer WHERE c_custkey < 200 AND c_acctbal > 100.5"),
    "freed": (freed, "SELECT 5 AS k, 3 AS v, 1 AS parts"),
    "script_files": (
        script_files,
        _stated(
            ("gone", "SELECT count(*) FROM nation WHERE n_nationkey >= 20"), ("n", "SELECT count(*) FROM nation"), ("o", "SELECT count(*) FROM orders"), ("rest", "SELECT count(*) FROM nation WHERE n_nationkey < 20"),
            ("errors", "2"), ("timed", "2"), ("echoed", "SELECT 'gone = ' || count(*) FROM nation WHERE n_nationkey >= 20"), ("counted", "SELECT count(*) FROM nation WHERE n_nationkey < 20"),
        ),
    ),
    "workload_joins": (workload_joins, "WITH j AS (SELECT j::INTEGER AS j, j::VARCHAR AS s, CASE WHEN j >= 1990 THEN '77' ELSE j::VARCHAR END AS t FROM range(2000) r(j)) SELECT i::INTEGER AS i_i, j AS j_i, s FROM range(3000) r(i) JOIN j ON i::VARCHAR = t"),
    "xml_rebuild": (
        xml_rebuild,
        f"""SELECT '<region key="' || r_regionkey || '" size="' || count(*) || '"><name>' || r_name || '</name>' || string_agg({_NATION_XML}, '' ORDER BY n_nationkey)
        || CASE WHEN r_regionkey = 2 THEN '<note />' ELSE '' END || '</region>' AS xml FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY r_regionkey, r_name""",
    ),
    "xml_predicate": (xml_predicate, f"SELECT {_NATION_XML} AS xml FROM nation WHERE n_regionkey = 2"),
    "xml_typed": (xml_typed, "SELECT n_regionkey::VARCHAR AS A_key, count(*)::INTEGER AS A_size FROM nation GROUP BY n_regionkey"),
    "xml_statements": (
        xml_statements,
        """SELECT statement FROM (VALUES ('CREATE TABLE E_a (id UINT PRIMARY KEY, E_c UINT, A_id STRING(255));'), ('CREATE INDEX ON E_a (A_id);'), ('CREATE TABLE E_a__to__E_b (id UINT PRIMARY KEY, E_a UINT FOREIGN KEY(E_a,id), E_b UINT);'),
        ('CREATE TABLE E_b (id UINT PRIMARY KEY, data STRING(255));'), ('CREATE TABLE E_c (id UINT PRIMARY KEY);')) v(statement)""",
    ),
}

QUERIES: dict[str, Query] = {name: _each(attr, body) for name, (attr, body, _) in _PROCEDURES.items()} | {name: query for name, (query, _) in _MORE.items()}

ORACLE_SQL: dict[str, str] = {name: f"SELECT string_agg(({sql})::VARCHAR || '|', '' ORDER BY n_nationkey) AS value FROM nation" for name, (_, _, sql) in _PROCEDURES.items()} | {name: sql for name, (_, sql) in _MORE.items()}
