"""One table for each element, link tables for repeated children, and the way back.

``E_x(id, …)`` holds the elements ``x``: for a child that occurs at most once its
id (0 where absent), for an attribute ``A_y`` its value and, if optional,
``A_y_P`` telling whether it was there, and ``data`` for character data.  A
repeated child has a table ``E_x__to__E_y(id, E_x, E_y)`` whose id keeps document
order.  Documents are shredded where they lie, one row in and many rows out, and
rebuilt where their rows lie, with joins and one aggregation for each repeated
child.  Loading is one change over all tables: all documents go in, or none.
"""

from __future__ import annotations

import re
import uuid
import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..engine import Engine
from ..errors import SemanticError
from ..plans import tree as t
from .dtd import DTD, MANY, OPTIONAL

#: Ids of one document: this many for each of its tables.
ID_STRIDE = 1 << 24


def element_table(name: str) -> str:
    return f"E_{name}"


def link_table(parent: str, child: str) -> str:
    return f"E_{parent}__to__E_{child}"


def _columns(dtd: DTD, name: str, id_type: str) -> list[tuple[str, str, str]]:
    """``(column, SQL type, marks)`` of an element's table."""
    e = dtd.elements[name]
    out = [("id", id_type, " PRIMARY KEY")]
    out += [(element_table(c), id_type, "") for c, q in e.children.items() if q != MANY]
    for a in e.attributes.values():
        out.append((f"A_{a.name}", a.type, ""))
        if not a.required:
            out.append((f"A_{a.name}_P", "INT", ""))
    if e.data:
        out.append(("data", e.data_type, ""))
    return out


def statements(dtd: DTD, id_type: str = "UINT") -> list[str]:
    """The CREATE TABLE and CREATE INDEX statements of the mapping; ``id_type`` LONG holds more documents."""
    out = []
    for name, e in dtd.elements.items():
        table = element_table(name)
        out.append(f"CREATE TABLE {table} ({', '.join(f'{c} {kind}{mark}' for c, kind, mark in _columns(dtd, name, id_type))});")
        out += [f"CREATE INDEX ON {table} (A_{a.name});" for a in e.attributes.values() if a.is_id]
        for child, q in e.children.items():
            if q == MANY:
                out.append(f"CREATE TABLE {link_table(name, child)} (id {id_type} PRIMARY KEY, {table} {id_type} FOREIGN KEY({table},id), {element_table(child)} {id_type});")
    return out


def create(engine: Engine, dtd: DTD, id_type: str = "UINT") -> None:
    for statement in statements(dtd, id_type):
        engine.define(statement)


def _shred(dtd: DTD, root: ET.Element, base: int) -> Iterator[tuple[str, dict[str, object]]]:
    counters: dict[str, int] = {}

    def fresh(table: str) -> int:
        counters[table] = counters.get(table, 0) + 1
        if counters[table] >= ID_STRIDE:
            raise SemanticError("a document has too many elements")
        return base + counters[table]

    def walk(node: ET.Element) -> Iterator[tuple[str, dict[str, object]]]:
        e = dtd.elements.get(node.tag)
        if e is None:
            raise SemanticError(f"undeclared element {node.tag}")
        own = node_ids[node] = fresh(element_table(e.name))
        row: dict[str, object] = {"id": own} | {element_table(c): 0 for c, q in e.children.items() if q != MANY}
        links = []
        for child in node:
            q = e.children.get(child.tag)
            if q is None:
                raise SemanticError(f"{child.tag} cannot be inside {e.name}")
            yield from walk(child)
            if q == MANY:
                link = link_table(e.name, child.tag)
                links.append((link, {"id": fresh(link), element_table(e.name): own, element_table(child.tag): node_ids[child]}))
            else:
                row[element_table(child.tag)] = node_ids[child]
        for a in e.attributes.values():
            if a.required and a.name not in node.attrib and a.default is None:
                raise SemanticError(f"{e.name} lacks attribute {a.name}")
            row[f"A_{a.name}"] = node.attrib.get(a.name, a.default if a.default is not None else "")
            if not a.required:
                row[f"A_{a.name}_P"] = int(a.name in node.attrib)
        for c, q in e.children.items():
            if q not in (MANY, OPTIONAL) and not row[element_table(c)]:
                raise SemanticError(f"{e.name} lacks child {c}")
        if e.data:
            row["data"] = (node.text or "").strip()
        yield element_table(e.name), row
        yield from links

    node_ids: dict[ET.Element, int] = {}
    yield from walk(root)


def _parse(text: str) -> ET.Element:
    return ET.fromstring(re.sub(r"<\?xml.*?\?>", "", text, count=1, flags=re.S).strip())


def load(engine: Engine, dtd: DTD, documents: DataFrame) -> dict[str, int]:
    """Insert ``documents(doc_no int, xml string)``; rows inserted for each table.

    ``doc_no`` keeps documents apart, each with ``ID_STRIDE`` ids: it is less
    than 256 with UINT ids and less than 2**39 with LONG ids.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tables, rows = [], []
            for number, text in zip(batch.column("doc_no").to_pylist(), batch.column("xml").to_pylist(), strict=True):
                for table, row in _shred(dtd, _parse(text), int(number) * ID_STRIDE):
                    tables.append(table)
                    rows.append([(k, str(v)) for k, v in row.items()])
            yield pa.RecordBatch.from_arrays([pa.array(tables, pa.string()), pa.array(rows, pa.map_(pa.string(), pa.string()))], names=["t", "r"])

    catalog = engine.catalog
    path = f"{catalog.root}/_shredded/{uuid.uuid4().hex}"
    try:
        # one file set for each table; what is parsed once is read from the shared folder
        shredded = documents.select(F.col("doc_no").cast("long").alias("doc_no"), "xml").mapInArrow(run, "t string, r map<string,string>")
        shredded.write.partitionBy("t").parquet(path)
        written = engine.spark.read.schema("r map<string,string>, t string").parquet(path)
        # at most one name for each table of the mapping
        names = [row[0] for row in written.select("t").distinct().collect()]
        frames = {}
        # link tables refer to element tables, which therefore come first
        for table in sorted(names, key=lambda n: ("__to__" in n, n)):
            columns = [F.element_at("r", F.lit(a.name)).alias(a.name) for a in catalog.table(table).attrs]
            frames[table] = written.filter(F.col("t") == table).select(*columns)
        return engine.insert_all(frames)
    finally:
        catalog.remove(path)


def load_text(engine: Engine, dtd: DTD, text: str, doc_no: int = 0) -> dict[str, int]:
    """Insert one document."""
    return load(engine, dtd, engine.spark.createDataFrame([(doc_no, text)], "doc_no int, xml string"))


_STEP = re.compile(r"/([\w.-]+)(?:\[\s*([\w.-]+)\s*=\s*(?:'([^']*)'|\"([^\"]*)\"|([^\]]*?))\s*\])?")


def path_query(dtd: DTD, path: str):
    """The query for ``/e/f/g``: joins along the path, sorted by ids; and the last element's name.

    A step may filter by one attribute, ``/e[a='v']``.
    """
    steps = _STEP.findall(path)
    if not steps or "".join(m.group(0) for m in _STEP.finditer(path)) != path:
        raise SemanticError(f"not a path: {path}")
    keys: list[t.SortKey] = []
    query = None
    for i, (name, attr, *values) in enumerate(steps):
        e = dtd.elements.get(name)
        if e is None:
            raise SemanticError(f"undeclared element {name}")
        table = element_table(name)
        step = t.Table(table)
        if attr:
            if attr not in e.attributes:
                raise SemanticError(f"{name} has no attribute {attr}")
            step = t.Select(step, t.Compare(t.AttrName(table, f"A_{attr}"), "=", t.Literal("STRING", next((v for v in values if v), ""))))
        if i == 0:
            query = step
        else:
            above = steps[i - 1][0]
            q = dtd.elements[above].children.get(name)
            if q is None:
                raise SemanticError(f"{name} is no child of {above}")
            holder = element_table(above)
            if q == MANY:
                holder = link_table(above, name)
                query = t.Join(query, t.Table(holder), t.Compare(t.AttrName(element_table(above), "id"), "=", t.AttrName(holder, element_table(above))))
                keys.append(t.SortKey(t.AttrName(holder, "id")))
            # an absent child has id 0, which no row has
            query = t.Join(query, step, t.Compare(t.AttrName(holder, table), "=", t.AttrName(table, "id")))
        keys.append(t.SortKey(t.AttrName(table, "id")))
    return t.Sort(query, tuple(keys)), steps[-1][0]


def rebuilt(engine: Engine, dtd: DTD, path: str) -> DataFrame:
    """``(at, id, xml)``: the text of every element at ``path``, rebuilt whole; ``at`` orders them as in the documents."""
    query, name = path_query(dtd, path)
    relation = engine.compile(query)
    keys = F.struct(*(F.col(f"`{k.attr.rel}.{k.attr.name}`") for k in query.keys))
    met = relation.df.select(keys.alias("at"), F.col(f"`{element_table(name)}.id`").alias("id"))
    texts = _texts(engine, dtd, name, met.select("id").distinct(), ())
    return met.join(texts, "id").select("at", "id", "xml")


def _escaped(column: Column, attribute: bool = False) -> Column:
    """Character data as XML; the ampersand comes first."""
    marks = [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")] + [('"', "&quot;"), ("\r", "&#13;"), ("\n", "&#10;"), ("\t", "&#09;")] * attribute
    for mark, name in marks:
        column = F.replace(column, F.lit(mark), F.lit(name))
    return column


def _texts(engine: Engine, dtd: DTD, name: str, wanted: DataFrame, above: tuple[str, ...]) -> DataFrame:
    """``(id, xml)`` of the elements ``name`` whose ids are ``wanted``."""
    if name in above:
        raise SemanticError(f"{name} contains itself; such elements are rebuilt one level at a time")
    e = dtd.elements[name]
    table = element_table(name)
    frame = lambda n: engine.catalog.frame(engine.catalog.table(n))
    rows = frame(table).join(wanted, "id", "left_semi")
    inside = [_escaped(F.col("data"))] if e.data else []
    for i, (child, q) in enumerate(e.children.items()):
        kid = element_table(child)
        if q == MANY:
            link = link_table(name, child)
            links = frame(link).select(F.col("id").alias("nth"), F.col(f"`{table}`").alias("id"), F.col(f"`{kid}`").alias("kid")).join(wanted, "id", "left_semi")
            texts = _texts(engine, dtd, child, links.select(F.col("kid").alias("id")).distinct(), (*above, name))
            found = links.join(texts.select(F.col("id").alias("kid"), "xml"), "kid").groupBy("id")
            found = found.agg(F.array_sort(F.collect_list(F.struct("nth", "xml"))).alias("xs")).select("id", F.array_join("xs.xml", "").alias(f"kid{i}"))
            rows = rows.join(found, "id", "left")
        else:
            texts = _texts(engine, dtd, child, rows.select(F.col(f"`{kid}`").alias("id")).filter("id <> 0").distinct(), (*above, name))
            rows = rows.join(texts.select(F.col("id").alias(kid), F.col("xml").alias(f"kid{i}")), kid, "left")
        inside.append(F.coalesce(F.col(f"kid{i}"), F.lit("")))
    opening = [F.lit(f"<{name}")]
    for a in e.attributes.values():
        value = F.concat(F.lit(f' {a.name}="'), _escaped(F.col(f"`A_{a.name}`"), True), F.lit('"'))
        opening.append(value if a.required else F.when(F.col(f"`A_{a.name}_P`") != 0, value).otherwise(""))
    body = F.concat(F.lit(""), *inside)
    text = F.concat(*opening, F.when(body == "", " />").otherwise(F.concat(F.lit(">"), body, F.lit(f"</{name}>"))))
    return rows.select("id", text.alias("xml"))


def find(engine: Engine, dtd: DTD, path: str) -> list[ET.Element]:
    """The elements at ``path``, rebuilt whole, in document order, on the driver; ``rebuilt`` leaves them where they are."""
    return [ET.fromstring(row["xml"]) for row in rebuilt(engine, dtd, path).orderBy("at").toLocalIterator()]


def to_text(elements: list[ET.Element]) -> str:
    """The elements as XML, one after the other."""
    return "\n".join(ET.tostring(e, encoding="unicode") for e in elements)
