"""INSERT, DELETE and UPDATE with primary and foreign keys.

Every statement is staged for all tables it reaches, checked, and committed by
one catalog swap.  Foreign keys only point to tables that existed before, so the
tables below one are an acyclic graph: a single pass, parents first, carries a
delete or a key change through all of them with semi-joins, and each row is
counted once.

DELETE and UPDATE first count the rows meant in each data file, reading only the
columns that decide; files without one stay as they are, and a table without one
is not written at all.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..errors import ConstraintError, SemanticError
from ..functions.domains import Literal, checked
from ..plans import tree as t
from ..sources.catalog import Catalog, StoredTable, fitted, misfit
from .predicates import condition
from .relation import Relation, scan


def _scanned(table: StoredTable, df: DataFrame, *more: str) -> Relation:
    return scan(df, table.name, [(a.name, a.domain, a.size) for a in table.attrs], more=more)


def _bare(df: DataFrame, table: StoredTable) -> DataFrame:
    return df.select(*(F.col(f"`{table.name}.{a.name}`").alias(a.name) for a in table.attrs))


def _has(catalog: Catalog, table: StoredTable, attr: str, literal: Literal) -> bool:
    """Whether primary key ``attr`` has the value of ``literal``."""
    stored = checked(literal, table.attr(attr).domain, table.attr(attr).size, f"{table.name}.{attr}")
    return catalog.has_key(table, attr, stored, Literal(literal.domain, stored).column())


class _Touched:
    """The files of a table that hold rows for which ``meant`` is true, and how many such rows there are.

    A registered table, which is read where it lies, counts as one file.
    """

    def __init__(self, catalog: Catalog, table: StoredTable, hits: DataFrame):
        self.catalog, self.table = catalog, table
        # one row for each file with a hit
        counts = {row["file"]: row["n"] for row in hits.groupBy("file").agg(F.count(F.lit(1)).alias("n")).collect()}
        self.rows = sum(counts.values())
        self.files, self.others = [], []
        names = {_tail(f) for f in counts}
        for part in table.parts if self.rows and table.external is None else ():
            held = catalog.files(part)
            mine = [f for f in held if _tail(f) in names]
            self.files += mine
            # a part without a hit keeps its one name
            self.others += [part] if not mine else [f for f in held if f not in mine]

    def frame(self) -> DataFrame:
        return self.catalog.read(self.table, self.files) if self.table.external is None else self.table.external

    def rewritten(self, rows: DataFrame) -> list[str]:
        """The table's parts once ``rows`` stand in for those of the touched files."""
        return [*self.others, self.catalog.write(self.table, rows)]


def _tail(path: str) -> str:
    """A file's part and name, which are unique however the path is written."""
    return "/".join(path.rsplit("/", 2)[1:])


def _with_file(catalog: Catalog, table: StoredTable) -> DataFrame:
    """The table's rows with the ``file`` that holds each; buffered rows are written first."""
    if table.external is not None:
        return table.external.withColumn("file", F.lit(""))
    catalog.flush(table)
    if not table.parts:
        return catalog.frame(table).withColumn("file", F.lit(""))
    return catalog.read(table, table.parts).withColumn("file", F.input_file_name())


def insert(catalog: Catalog, node: t.Insert) -> int:
    table = catalog.table(node.table)
    if any(a.rel != table.name for a in node.attrs):
        raise SemanticError(f"INSERT INTO {table.name} names another table")
    names = [a.name for a in node.attrs]
    if sorted(names) != sorted(a.name for a in table.attrs) or len(names) != len(node.values):
        raise SemanticError(f"INSERT INTO {table.name} needs every attribute once, and a value for each")
    given = dict(zip(names, node.values, strict=True))
    row = tuple(checked(given[a.name], a.domain, a.size, f"{table.name}.{a.name}") for a in table.attrs)
    for a in table.attrs:
        if a.primary and _has(catalog, table, a.name, given[a.name]):
            raise ConstraintError(f"{table.name}.{a.name} = {given[a.name].value!r} exists")
        if a.foreign is not None and not _has(catalog, catalog.table(a.foreign.rel), a.foreign.name, given[a.name]):
            raise ConstraintError(f"{a.foreign} = {given[a.name].value!r} does not exist")
    catalog.add_row(table, row)
    return 1


def insert_frame(catalog: Catalog, name: str, df: DataFrame) -> int:
    """Insert all rows of ``df`` or none; keys are checked with joins."""
    return insert_frames(catalog, {name: df})[name]


def insert_frames(catalog: Catalog, frames: dict[str, DataFrame]) -> dict[str, int]:
    """Insert the rows of all frames, parents first, or none of them; rows for each table."""
    staged: dict[str, str] = {}
    try:
        counts = {name: _stage(catalog, name, df, staged) for name, df in frames.items()}
        for name in frames:
            catalog.own(catalog.table(name))
        catalog.swap({name: [*catalog.table(name).parts, part] for name, part in staged.items()})
    except BaseException:
        catalog.remove(*staged.values())
        raise
    return counts


def _stage(catalog: Catalog, name: str, df: DataFrame, staged: dict[str, str]) -> int:
    table = catalog.table(name)
    missing = [a.name for a in table.attrs if a.name not in df.columns]
    if missing:
        raise SemanticError(f"no column for {table.name}.{missing[0]}")
    staged[name] = catalog.write(table, fitted(df, table))
    rows = catalog.read(table, [staged[name]])
    facts = rows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.bool_or(misfit(table)), F.lit(False)).alias("bad")).first()
    if facts["bad"]:
        raise SemanticError(f"a row does not fit the domains of {name}")
    for a in table.attrs:
        key = rows.select(f"`{a.name}`")
        if a.primary:
            twice = key.groupBy(a.name).count().filter("count > 1")
            if not twice.isEmpty() or not key.join(catalog.frame(table).select(a.name), a.name, "left_semi").isEmpty():
                raise ConstraintError(f"a value of {name}.{a.name} exists")
        if a.foreign is not None:
            above = catalog.table(a.foreign.rel)
            parent = catalog.frame(above)
            if above.name in staged:
                parent = parent.unionAll(catalog.read(above, [staged[above.name]]))
            if not key.join(parent.select(F.col(f"`{a.foreign.name}`").alias(a.name)), a.name, "left_anti").isEmpty():
                raise ConstraintError(f"a value of {name}.{a.name} does not exist in {a.foreign}")
    return facts["n"]


def _reached(catalog: Catalog, table: StoredTable, df: DataFrame, gone: dict[str, DataFrame]) -> tuple[DataFrame, Column]:
    """``df`` joined to the keys that go, and which of its rows refer to one."""
    hits = []
    for i, a in enumerate(a for a in table.attrs if a.foreign is not None and a.foreign.rel in gone):
        keys = gone[a.foreign.rel].select(F.col(f"`{a.foreign.name}`").alias(f"_k{i}")).distinct()
        df = df.join(keys, df[f"`{a.name}`"] == F.col(f"_k{i}"), "left")
        hits.append(F.col(f"_k{i}").isNotNull())
    return df, reduce(lambda x, y: x | y, hits)


def delete(catalog: Catalog, node: t.Delete) -> int:
    """Rows deleted here and in every table below."""
    start = catalog.table(node.table)
    gone: dict[str, DataFrame] = {}
    changed: dict[str, list[str]] = {}
    aside: list[str] = []
    total = 0
    try:
        for table in catalog.below(start.name):
            if table is not start and not any(a.foreign is not None and a.foreign.rel in gone for a in table.attrs):
                continue
            meant = lambda df: _meant(table, df, node.where) if table is start else _reached(catalog, table, df, gone)  # noqa: B023, E731
            marked, hit = meant(_with_file(catalog, table))
            touched = _Touched(catalog, table, marked.filter(hit))
            if not touched.rows:
                if table is start:
                    return 0
                continue
            total += touched.rows
            marked, hit = meant(touched.frame())
            marked = marked.withColumn("_gone", F.coalesce(hit, F.lit(False)))
            names = [F.col(f"`{a.name}`") for a in table.attrs]
            if catalog.children(table.name):
                # the keys that go are read by every table below
                aside.append(catalog.write(table, marked.filter("_gone").select(*names)))
                gone[table.name] = catalog.read(table, aside[-1:])
            changed[table.name] = touched.rewritten(marked.filter("NOT _gone").select(*names))
        catalog.swap(changed)
    except BaseException:
        catalog.remove(*(parts[-1] for parts in changed.values()))
        raise
    finally:
        catalog.remove(*aside)
    return total


def _meant(table: StoredTable, df: DataFrame, where) -> tuple[DataFrame, Column]:
    """``df`` under bare names, and the rows that ``where`` means."""
    # the predicate is built over physical names and applied as one more column
    more = ("file",) if "file" in df.columns else ()
    relation = _scanned(table, df, *more)
    hit = condition(relation, where) if where is not None else F.lit(True)
    marked = relation.df.withColumn("_hit", hit)
    return marked.select(*(F.col(f"`{table.name}.{a.name}`").alias(a.name) for a in table.attrs), *more, "_hit"), F.col("_hit")


def update(catalog: Catalog, node: t.Update) -> int:
    """Rows changed here and, where a key changed, in the tables below."""
    start = catalog.table(node.table)
    sets: dict[str, Literal] = {}
    for attr, literal in node.assignments:
        if attr.rel != start.name:
            raise SemanticError(f"UPDATE {start.name} sets {attr}")
        definition = start.attr(attr.name)
        sets[attr.name] = Literal(definition.domain, checked(literal, definition.domain, definition.size, str(attr)))
    marked, hit = _meant(start, _with_file(catalog, start), node.where)
    touched = _Touched(catalog, start, marked.filter(hit))
    n = total = touched.rows
    if not n:
        return 0
    marked, hit = _meant(start, touched.frame(), node.where)
    keys = [a for a in start.attrs if a.primary and a.name in sets]
    # one row at most where a key is set
    old_keys = marked.filter(hit).select(*(F.col(f"`{a.name}`") for a in keys)).first() if keys and n == 1 else None
    for a in keys:
        if n > 1:
            raise ConstraintError(f"{n} rows would share {start.name}.{a.name} = {sets[a.name].value!r}")
        if old_keys[a.name] != sets[a.name].value and _has(catalog, start, a.name, sets[a.name]):
            raise ConstraintError(f"{start.name}.{a.name} = {sets[a.name].value!r} exists")
    for a in start.attrs:
        if a.foreign is not None and a.name in sets and not _has(catalog, catalog.table(a.foreign.rel), a.foreign.name, sets[a.name]):
            raise ConstraintError(f"{a.foreign} = {sets[a.name].value!r} does not exist")
    columns = [F.when(hit, sets[a.name].column()).otherwise(F.col(f"`{a.name}`")).alias(a.name) if a.name in sets else F.col(f"`{a.name}`") for a in start.attrs]
    staged: dict[str, list[str]] = {}
    try:
        staged[start.name] = touched.rewritten(marked.select(*columns))
        # at most one row has a changed key, so a key change is a pair of values: (table, attribute) -> (old, new)
        moved = {(start.name, a.name): (old_keys[a.name], sets[a.name]) for a in keys}
        moved = {k: v for k, v in moved.items() if v[0] != v[1].value}
        for table in catalog.below(start.name)[1:]:
            here = [(a, *moved[a.foreign.rel, a.foreign.name]) for a in table.attrs if a.foreign is not None and (a.foreign.rel, a.foreign.name) in moved]
            if not here:
                continue
            refers = reduce(lambda x, y: x | y, (F.col(f"`{a.name}`") == Literal(a.domain, old).column() for a, old, _ in here))
            below = _Touched(catalog, table, _with_file(catalog, table).filter(refers))
            if not below.rows:
                continue
            total += below.rows
            df = below.frame()
            for a, old, value in here:
                if a.primary:
                    moved[table.name, a.name] = (old, value)
                df = df.withColumn(a.name, F.when(F.col(f"`{a.name}`") == Literal(a.domain, old).column(), value.column()).otherwise(F.col(f"`{a.name}`")))
            staged[table.name] = below.rewritten(df)
        catalog.swap(staged)
    except BaseException:
        catalog.remove(*(parts[-1] for parts in staged.values()))
        raise
    return total
