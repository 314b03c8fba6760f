"""Queries over the test tables, one or more for each operator, with the SQL that states their results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import surface
from .engine import Engine
from .plans import tree as t

Query = Callable[[SparkSession, str], DataFrame]

#: name -> (tables, statement, SQL)
STATEMENTS: dict[str, tuple[str, str, str]] = {
    "scan_table": ("customer", "SELECT FROM customer;", "SELECT * FROM customer"),
    "select_eq_int": ("part", "SELECT FROM part WHERE part.p_size = 7;", "SELECT * FROM part WHERE p_size = 7"),
    "select_ne_string": ("part", "SELECT FROM part WHERE part.p_brand != 'Brand#13';", "SELECT * FROM part WHERE p_brand <> 'Brand#13'"),
    "select_lt_long": ("orders", "SELECT FROM orders WHERE orders.o_custkey < 100L;", "SELECT * FROM orders WHERE o_custkey < 100"),
    "select_le_string": ("customer", "SELECT FROM customer WHERE customer.c_mktsegment <= 'BUILDING';", "SELECT * FROM customer WHERE c_mktsegment <= 'BUILDING'"),
    "select_gt_double": ("supplier", "SELECT FROM supplier WHERE supplier.s_acctbal > 500.0;", "SELECT * FROM supplier WHERE s_acctbal > 500"),
    "select_ge_double": ("orders", "SELECT FROM orders WHERE orders.o_totalprice >= 100000.0;", "SELECT * FROM orders WHERE o_totalprice >= 100000"),
    "select_and": ("lineitem", "SELECT FROM lineitem WHERE lineitem.l_quantity >= 30.0 AND lineitem.l_discount < 0.05 AND lineitem.l_returnflag = 'R';", "SELECT * FROM lineitem WHERE l_quantity >= 30 AND l_discount < 0.05::DOUBLE AND l_returnflag = 'R'"),
    "select_or": ("lineitem", "SELECT FROM lineitem WHERE lineitem.l_quantity < 3.0 OR lineitem.l_linenumber = 7;", "SELECT * FROM lineitem WHERE l_quantity < 3 OR l_linenumber = 7"),
    "select_precedence": ("lineitem", "SELECT FROM lineitem WHERE lineitem.l_linenumber = 7 OR lineitem.l_linenumber = 6 AND (lineitem.l_quantity < 5.0 OR lineitem.l_quantity > 45.0);", "SELECT * FROM lineitem WHERE l_linenumber = 7 OR (l_linenumber = 6 AND (l_quantity < 5 OR l_quantity > 45))"),
    "project_bag": ("lineitem", "PROJECT lineitem OVER lineitem.l_linestatus, lineitem.l_returnflag;", "SELECT l_linestatus, l_returnflag FROM lineitem"),
    "sort_distinct": ("lineitem", "SORT (PROJECT lineitem OVER lineitem.l_returnflag, lineitem.l_linestatus) BY lineitem.l_returnflag;", "SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem"),
    "sort_multi_desc": ("customer", "SORT customer BY customer.c_mktsegment DESC, customer.c_acctbal ASC;", "SELECT DISTINCT * FROM customer ORDER BY c_mktsegment DESC, c_acctbal"),
    "select_above_sort": ("orders", "SELECT FROM (SORT (PROJECT orders OVER orders.o_orderstatus, orders.o_orderpriority) BY orders.o_orderpriority) WHERE orders.o_orderstatus = 'F';", "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders WHERE o_orderstatus = 'F'"),
    "union_bag": ("orders", "UNION (SELECT FROM orders WHERE orders.o_custkey < 500L), (SELECT FROM orders WHERE orders.o_totalprice < 50000.0);", "SELECT * FROM orders WHERE o_custkey < 500 UNION ALL SELECT * FROM orders WHERE o_totalprice < 50000"),
    "union_distinct_by_sort": ("orders", "SORT (UNION (PROJECT orders OVER orders.o_custkey), (PROJECT (SELECT FROM orders WHERE orders.o_totalprice < 50000.0) OVER orders.o_custkey)) BY orders.o_custkey;", "SELECT o_custkey FROM orders UNION SELECT o_custkey FROM orders"),
    "join_equi": ("orders customer", "JOIN orders, customer ON orders.o_custkey = customer.c_custkey;", "SELECT * FROM orders JOIN customer ON o_custkey = c_custkey"),
    "join_nested": ("lineitem orders customer", "PROJECT (JOIN (JOIN lineitem, orders ON lineitem.l_orderkey = orders.o_orderkey), customer ON orders.o_custkey = customer.c_custkey) OVER customer.c_name, orders.o_orderkey, lineitem.l_linenumber;", "SELECT c_name, o_orderkey, l_linenumber FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey"),
    "join_string": ("lineitem orders", "PROJECT (JOIN (SORT (PROJECT lineitem OVER lineitem.l_linestatus) BY lineitem.l_linestatus), orders ON lineitem.l_linestatus = orders.o_orderstatus) OVER lineitem.l_linestatus, orders.o_orderkey;", "SELECT l_linestatus, o_orderkey FROM (SELECT DISTINCT l_linestatus FROM lineitem) JOIN orders ON l_linestatus = o_orderstatus"),
    "join_theta": ("nation region", "JOIN nation, region ON nation.n_regionkey < region.r_regionkey;", "SELECT * FROM nation JOIN region ON n_regionkey < r_regionkey"),
    "join_theta_ge": ("nation region", "JOIN nation, region ON nation.n_regionkey >= region.r_regionkey;", "SELECT * FROM nation JOIN region ON n_regionkey >= r_regionkey"),
    "join_not_equal": ("nation region", "JOIN nation, region ON nation.n_regionkey != region.r_regionkey;", "SELECT * FROM nation JOIN region ON n_regionkey <> r_regionkey"),
    "join_compound": ("customer supplier", "JOIN customer, supplier ON customer.c_nationkey = supplier.s_nationkey AND customer.c_acctbal < supplier.s_acctbal;", "SELECT * FROM customer JOIN supplier ON c_nationkey = s_nationkey AND c_acctbal < s_acctbal"),
    "join_or": ("nation region", "JOIN nation, region ON nation.n_regionkey = region.r_regionkey OR nation.n_nationkey = region.r_regionkey;", "SELECT * FROM nation JOIN region ON n_regionkey = r_regionkey OR n_nationkey = r_regionkey"),
    "join_natural": ("documents labels", "PROJECT (JOIN documents, labels) OVER documents.doc_id, labels.doc_id, documents.lang, labels.quality, labels.toxic;", "SELECT d.doc_id AS documents_doc_id, l.doc_id AS labels_doc_id, d.lang, l.quality, l.toxic FROM documents d JOIN labels l ON d.doc_id = l.doc_id"),
    "join_product": ("region nation", "JOIN region, nation;", "SELECT * FROM region CROSS JOIN nation"),
}

_AGGREGATES = {
    "agg_count": ("COUNT", "SELECT FROM lineitem WHERE lineitem.l_quantity > 25.0", None, "SELECT count(*) AS value FROM lineitem WHERE l_quantity > 25"),
    "agg_min": ("MIN", "SELECT FROM part", "p_name", "SELECT min(p_name) AS value FROM part"),
    "agg_max": ("MAX", "SELECT FROM orders", "o_totalprice", "SELECT max(o_totalprice) AS value FROM orders"),
    "agg_max_by_position": ("MAX", "SELECT FROM orders", 1, "SELECT max(o_custkey) AS value FROM orders"),
    "agg_avg": ("AVG", "SELECT FROM part", "p_size", "SELECT CAST(avg(p_size) AS FLOAT) AS value FROM part"),
    "agg_sum": ("SUM", "SELECT FROM part", "p_size", "SELECT sum(p_size)::BIGINT AS value FROM part"),
    "agg_sum_of_lengths": ("SUM", "SELECT FROM documents", "text", "SELECT sum(octet_length(encode(text)))::BIGINT AS value FROM documents"),
    "agg_var": ("VAR", "SELECT FROM nation", "n_regionkey", "SELECT var_pop(n_regionkey) AS value FROM nation"),
    "agg_min_empty": ("MIN", "SELECT FROM part WHERE part.p_size < 0", "p_size", "SELECT coalesce(min(p_size), 0) AS value FROM part WHERE p_size < 0"),
    "agg_max_empty": ("MAX", "SELECT FROM orders WHERE orders.o_totalprice < 0.0", "o_totalprice", "SELECT coalesce(max(o_totalprice), 0) AS value FROM orders WHERE o_totalprice < 0"),
    "agg_avg_empty": ("AVG", "SELECT FROM part WHERE part.p_size < 0", "p_size", "SELECT coalesce(avg(p_size), 0)::FLOAT AS value FROM part WHERE p_size < 0"),
    "agg_empty": ("COUNT", "SELECT FROM nation WHERE nation.n_name = ''", None, "SELECT count(*) AS value FROM nation WHERE n_name = ''"),
}


def _engine(spark: SparkSession, sf_dir: str, tables: str, **options) -> Engine:
    return Engine(spark, **options).register_parquet(sf_dir, *tables.split())


def _statement(tables: str, text: str) -> Query:
    return lambda spark, sf_dir: _engine(spark, sf_dir, tables).query(text)


def _aggregate(function: str, query: str, attr: str | int | None) -> Query:
    table = query.split()[2]
    return lambda spark, sf_dir: _engine(spark, sf_dir, table).aggregate(function, query, attr)


def select_or_bag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _engine(spark, sf_dir, "orders", or_mode="bag").query("SELECT FROM orders WHERE orders.o_custkey < 500L OR orders.o_totalprice < 50000.0;")


def join_or_bag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _engine(spark, sf_dir, "nation region", or_mode="bag").query(STATEMENTS["join_or"][1])


def select_nand(spark: SparkSession, sf_dir: str) -> DataFrame:
    leaf = lambda a, op, d, v: t.Compare(t.AttrName("part", a), op, t.Literal(d, v))
    node = t.Select(t.Table("part"), t.Bool("NAND", leaf("p_size", ">", "INT", 10), leaf("p_brand", "=", "STRING", "Brand#13")))
    return _engine(spark, sf_dir, "part").compile(node).output()


def select_nor(spark: SparkSession, sf_dir: str) -> DataFrame:
    leaf = lambda a, op, d, v: t.Compare(t.AttrName("part", a), op, t.Literal(d, v))
    node = t.Select(t.Table("part"), t.Bool("NOR", leaf("p_size", ">", "INT", 10), leaf("p_brand", "=", "STRING", "Brand#13")))
    return _engine(spark, sf_dir, "part").compile(node).output()


def view_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _engine(spark, sf_dir, "orders customer nation")
    e.define("CREATE VIEW $placed AS JOIN orders, customer ON orders.o_custkey = customer.c_custkey;")
    e.define("CREATE VIEW $where AS SORT (PROJECT (JOIN $placed, nation ON customer.c_nationkey = nation.n_nationkey) OVER nation.n_name, customer.c_name, orders.o_orderkey, orders.o_totalprice) BY nation.n_name;")
    return e.query("SELECT FROM $where WHERE orders.o_totalprice >= 150000.0;")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A view over three joined tables, filtered, narrowed and sorted."""
    return view_nested(spark, sf_dir)


def create_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _engine(spark, sf_dir, "region")
    e.define("CREATE TABLE place (id UINT PRIMARY KEY, name STRING(6), weight FLOAT);")
    for i, name in enumerate(("Ulm", "Wuppertal", "Köln")):
        e.modify(f"INSERT INTO place (place.name, place.id, place.weight) VALUES ('{name}', {i}U, {i}.5F);")
    e.execute("INSERT INTO place (place.id, place.name, place.weight) VALUES (1U, 'again', 1.0F);")
    return e.query("SELECT FROM place;")


def insert_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _engine(spark, sf_dir, "nation")
    e.define("CREATE TABLE zone (key INT PRIMARY KEY, name STRING(64));")
    e.define("CREATE TABLE land (key INT PRIMARY KEY, zone INT FOREIGN KEY(zone,key), name STRING(5));")
    region, nation = (spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in ("region", "nation"))
    e.insert_rows("zone", region.select(F.col("r_regionkey").alias("key"), F.col("r_name").alias("name")))
    e.insert_rows("land", nation.select(F.col("n_nationkey").alias("key"), F.col("n_regionkey").alias("zone"), F.col("n_name").alias("name")))
    return e.query("PROJECT land OVER land.key, land.zone, land.name;")


def update_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _engine(spark, sf_dir, "orders")
    e.modify("UPDATE orders SET orders.o_orderstatus = 'X', orders.o_totalprice = 0.0 WHERE orders.o_totalprice < 50000.0 OR orders.o_custkey < 100L;")
    return e.query("SELECT FROM orders;")


def delete_where(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _engine(spark, sf_dir, "lineitem")
    e.modify("DELETE lineitem WHERE lineitem.l_quantity >= 25.0 AND lineitem.l_returnflag != 'N';")
    return e.query("SELECT FROM lineitem;")


def _keyed(spark: SparkSession, sf_dir: str) -> Engine:
    e = Engine(spark)
    read = lambda n: spark.read.parquet(f"{sf_dir}/{n}.parquet")
    e.register("nation", read("nation"), ["n_nationkey"])
    e.register("customer", read("customer"), ["c_custkey"], {"c_nationkey": ("nation", "n_nationkey")})
    e.register("orders", read("orders"), ["o_orderkey"], {"o_custkey": ("customer", "c_custkey")})
    return e


def delete_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _keyed(spark, sf_dir)
    e.modify("DELETE nation WHERE nation.n_nationkey < 10;")
    return e.query("SELECT FROM orders;")


def update_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _keyed(spark, sf_dir)
    e.modify("UPDATE nation SET nation.n_nationkey = 99 WHERE nation.n_nationkey = 3;")
    return e.query("PROJECT customer OVER customer.c_custkey, customer.c_nationkey;")


def affected_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _keyed(spark, sf_dir)
    return spark.createDataFrame([(e.modify("DELETE nation WHERE nation.n_nationkey < 10;"),)], "affected long")


def procedure_loop(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _engine(spark, sf_dir, "nation")
    e.create_procedure(
        """PROCEDURE Longest(STRING query, STRING attr) BEGIN
             TUPLE t; INT best; STRING name; INT n; STRING cur;
             best := 0; name := ""; n := 0;
             FOREACH (t IN query) DO
               n := (n + 1);
               cur := !attrval(t, attr);
               IF (((!strlen(cur) > best) OR ((!strlen(cur) = best) AND (cur < name)))) DO best := !strlen(cur); name := cur; END
             END
             RETURN ((name + ":") + n);
           END"""
    )
    return spark.createDataFrame([(e.procedure("Longest('SELECT FROM nation', 'n_name');"),)], "value string")


def workload_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = Engine(spark)
    e.procedure("CreateDBs('i', 20000);")
    return e.query("SELECT FROM i WHERE i.s >= '99';")


def xml_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions and nations written as XML documents, shredded, and joined again along a path."""
    from .xmlmap.dtd import parse_dtd
    from .xmlmap.mapping import create, load, path_query

    dtd = parse_dtd("<!ELEMENT region (name, nation*)><!ATTLIST region key CDATA #REQUIRED><!ELEMENT name (#PCDATA)><!ELEMENT nation (#PCDATA)>", "region")
    region, nation = (spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in ("region", "nation"))
    inner = nation.groupBy("n_regionkey").agg(F.array_join(F.sort_array(F.collect_list(F.concat(F.lit("<nation>"), "n_name", F.lit("</nation>")))), "").alias("inner"))
    docs = region.join(inner, region.r_regionkey == inner.n_regionkey).select(F.col("r_regionkey").alias("doc_no"), F.concat(F.lit('<region key="'), "r_regionkey", F.lit('"><name>'), "r_name", F.lit("</name>"), "inner", F.lit("</region>")).alias("xml"))
    e = Engine(spark)
    create(e, dtd)
    load(e, dtd, docs)
    query, _ = path_query(dtd, "/region/nation")
    return e.compile(t.Project(query, (t.AttrName("E_region", "A_key"), t.AttrName("E_nation", "data")))).output()


_MORE: dict[str, tuple[Query, str | None]] = {
    "select_or_bag": (select_or_bag, "SELECT * FROM orders WHERE o_custkey < 500 UNION ALL SELECT * FROM orders WHERE o_totalprice < 50000"),
    "join_or_bag": (join_or_bag, "SELECT * FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT * FROM nation JOIN region ON n_nationkey = r_regionkey"),
    "select_nand": (select_nand, "SELECT * FROM part WHERE NOT (p_size > 10 AND p_brand = 'Brand#13')"),
    "select_nor": (select_nor, "SELECT * FROM part WHERE NOT (p_size > 10 OR p_brand = 'Brand#13')"),
    "view_nested": (view_nested, "SELECT DISTINCT n_name, c_name, o_orderkey, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_totalprice >= 150000"),
    "create_insert": (create_insert, "SELECT * FROM (VALUES (0::BIGINT, 'Ulm', 0.5::FLOAT), (1, 'Wuppe', 1.5), (2, 'Köln', 2.5)) v(id, name, weight)"),
    "insert_frame": (insert_frame, "SELECT n_nationkey AS key, n_regionkey AS zone, substr(n_name, 1, 4) AS name FROM nation"),
    "update_case": (update_case, "SELECT o_orderkey, o_custkey, CASE WHEN o_totalprice < 50000 OR o_custkey < 100 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, CASE WHEN o_totalprice < 50000 OR o_custkey < 100 THEN 0.0::DOUBLE ELSE o_totalprice END AS o_totalprice, o_orderdate, o_orderpriority FROM orders"),
    "delete_where": (delete_where, "SELECT * FROM lineitem WHERE NOT (l_quantity >= 25 AND l_returnflag <> 'N')"),
    "delete_cascade": (delete_cascade, "SELECT * FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey < 10)"),
    "update_cascade": (update_cascade, "SELECT c_custkey, CASE WHEN c_nationkey = 3 THEN 99 ELSE c_nationkey END AS c_nationkey FROM customer"),
    "affected_rows": (affected_rows, "SELECT ((SELECT count(*) FROM nation WHERE n_nationkey < 10) + (SELECT count(*) FROM customer WHERE c_nationkey < 10) + (SELECT count(*) FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_nationkey < 10))::BIGINT AS affected"),
    "procedure_loop": (procedure_loop, "SELECT (SELECT n_name FROM nation ORDER BY length(n_name) DESC, n_name LIMIT 1) || ':' || count(*) AS value FROM nation"),
    "workload_tables": (workload_tables, "SELECT i::INTEGER AS i, i::VARCHAR AS s, i::VARCHAR AS t FROM range(20000) r(i) WHERE i::VARCHAR >= '99'"),
    "xml_paths": (xml_paths, "SELECT n_regionkey::VARCHAR AS A_key, n_name AS data FROM nation"),
}

QUERIES: dict[str, Query] = (
    {name: _statement(tables, text) for name, (tables, text, _) in STATEMENTS.items()}
    | {name: _aggregate(f, q, a) for name, (f, q, a, _) in _AGGREGATES.items()}
    | {name: query for name, (query, _) in _MORE.items()}
    | surface.QUERIES
)

ORACLE_SQL: dict[str, str] = {name: sql for name, (_, _, sql) in STATEMENTS.items()} | {name: x[3] for name, x in _AGGREGATES.items()} | {name: sql for name, (_, sql) in _MORE.items() if sql is not None} | surface.ORACLE_SQL
