"""The engine: statements in, results out."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession, functions as F

from .errors import EngineError, ProcedureError, SemanticError
from .functions.domains import FLOAT, INT, STRING, Literal
from .operators import modify
from .operators.aggregates import aggregate
from .operators.compiler import Compiler
from .operators.relation import Relation
from .plans import tree as t
from .plans.parser import parse
from .procs.language import Interpreter, Procedure, compile_procedure
from .procs.values import Single, of_column
from .sources.catalog import Catalog

#: Procedures that need no loop: one aggregation each, and a table generator.
SHIPPED = {"COUNT": 1, "MIN": 2, "MAX": 2, "AVG": 2, "SUM": 2, "VAR": 2, "CreateDBs": 2}


@dataclass
class Result:
    """What a statement did: its kind, and what there is to read."""

    kind: str
    success: bool = True
    error: str | None = None
    relation: Relation | None = None
    count: int | None = None
    value: Any = None
    exception: EngineError | None = field(default=None, repr=False)

    @property
    def attrs(self) -> list[str]:
        return [str(a.key) for a in self.relation.attrs] if self.relation else []

    @property
    def df(self) -> DataFrame:
        if self.relation is None:
            raise SemanticError(f"a {self.kind} has no rows")
        return self.relation.output()

    def rows(self) -> Iterator[Row]:
        """Rows one at a time, at most a partition on the driver."""
        return self.df.toLocalIterator()

    def records(self) -> Iterator[dict[str, Any]]:
        """Rows as dictionaries keyed ``table.attribute``."""
        names = self.attrs
        for row in self.rows():
            yield dict(zip(names, row, strict=True))

    def lines(self, limit: int | None = None) -> Iterator[str]:
        """An ASCII table of the rows, line by line, at most a partition on the driver; one aggregation finds the widths."""
        names = self.attrs
        shown = self.relation.df if limit is None else self.relation.df.limit(limit)
        # floats have six places, nulls (of registered tables) are empty
        text = lambda f: F.format_string("%.6f", f"`{f.name}`") if f.dataType.typeName() in ("float", "double") else F.col(f"`{f.name}`").cast("string")
        cells = shown.select(*(F.when(F.col(f"`{f.name}`").isNull(), "").otherwise(text(f)).alias(f"c{i}") for i, f in enumerate(shown.schema.fields)))
        found = cells.agg(*(F.coalesce(F.max(F.char_length(f"c{i}")), F.lit(0)) for i in range(len(names)))).first()
        widths = [max(len(n), w) for n, w in zip(names, found, strict=True)]
        rule = "+" + "+".join("-" * (w + 2) for w in widths) + "+"
        show = lambda row: "|" + "|".join(f" {c.ljust(w)} " for c, w in zip(row, widths, strict=True)) + "|"
        yield from (rule, show(names), rule)
        yield from map(show, cells.toLocalIterator())
        yield rule

    def table(self, limit: int | None = None) -> str:
        """``lines`` as one text, which the driver must hold."""
        return "\n".join(self.lines(limit))

    def write_table(self, path: str, limit: int | None = None) -> None:
        """``lines`` into a file of the driver's, one at a time."""
        with open(path, "w", encoding="utf-8") as out:
            out.writelines(line + "\n" for line in self.lines(limit))


class Engine:
    """One catalog and the statements over it.

    ``root`` keeps tables, views and procedures from one engine to the next.
    ``or_mode="bag"`` and ``strict=False`` are described at the compiler.
    """

    def __init__(self, spark: SparkSession, root: str | None = None, or_mode: str = "set", strict: bool = True):
        if or_mode not in ("set", "bag"):
            raise ValueError("or_mode is 'set' or 'bag'")
        self.spark = spark
        self.catalog = Catalog(spark, root)
        self.or_mode, self.strict = or_mode, strict
        self.printed: list[str] = []
        self.compiled: dict[str, Procedure] = {}

    def __enter__(self) -> "Engine":
        return self

    def __exit__(self, *_: object) -> None:
        self.catalog.close()

    def vacuum(self) -> None:
        """Remove what the last change superseded; results older than it can't be read any more."""
        self.catalog.vacuum()

    # tables

    def register(self, name: str, df: DataFrame, primary: Iterable[str] = (), foreign: dict[str, tuple[str, str]] | None = None) -> None:
        """Know ``df`` as table ``name``; its keys are taken as declared, and only cascades and key checks of INSERT and UPDATE use them."""
        self.catalog.register(name, df, primary, {k: t.AttrName(*v) for k, v in (foreign or {}).items()})

    def register_parquet(self, folder: str, *names: str) -> "Engine":
        for name in names:
            self.register(name, self.spark.read.parquet(f"{folder}/{name}.parquet"))
        return self

    def insert_rows(self, table: str, rows: DataFrame) -> int:
        """Insert a DataFrame's rows, all or none."""
        return modify.insert_frame(self.catalog, table, rows)

    def insert_all(self, frames: dict[str, DataFrame]) -> dict[str, int]:
        """Insert the rows of several tables, parents first, as one change."""
        return modify.insert_frames(self.catalog, frames)

    # statements

    def execute(self, text: str) -> Result:
        """Run one statement; a failure is told by the result."""
        try:
            node = parse(text)
        except EngineError as error:
            return Result("error", False, str(error), exception=error)
        return self.run_tree(node)

    def executef(self, form: str, *args: Any) -> Result:
        """``execute`` with ``%s`` (quotes escaped), ``%d``, ``%ld``, ``%f``, ``%lf`` and ``%%`` filled in."""
        return self.execute(bind(form, *args))

    def run_tree(self, node: Any) -> Result:
        try:
            if isinstance(node, t.DEFINITIONS):
                self._define(node)
                return Result("definition")
            if isinstance(node, t.MODIFICATIONS):
                change = {t.Insert: modify.insert, t.Delete: modify.delete, t.Update: modify.update}[type(node)]
                return Result("modification", count=change(self.catalog, node))
            if isinstance(node, t.Call):
                return Result("procedure", value=self.call(node.procedure, *(_argument(a) for a in node.args)))
            return Result("query", relation=self.compile(node))
        except EngineError as error:
            return Result("error", False, str(error), exception=error)

    def query(self, text: str) -> DataFrame:
        """The rows of a query, under bare names; errors are raised."""
        return self._checked(text, "query").df

    def modify(self, text: str) -> int:
        """Rows changed, cascades included."""
        return self._checked(text, "modification").count

    def define(self, text: str) -> None:
        self._checked(text, "definition")

    def procedure(self, text: str) -> Any:
        return self._checked(text, "procedure").value

    def _checked(self, text: str, kind: str) -> Result:
        result = self.execute(text)
        if result.exception is not None:
            raise result.exception
        if result.kind != kind:
            raise SemanticError(f"a {result.kind} where a {kind} is needed")
        return result

    def compile(self, node: Any) -> Relation:
        return Compiler(self.catalog.relation, self.catalog.view, self.or_mode, self.strict).compile(node)

    def _define(self, node: Any) -> None:
        if isinstance(node, t.CreateTable):
            self.catalog.create_table(node)
        elif isinstance(node, t.DropTable):
            self.catalog.drop_table(node.name)
        elif isinstance(node, t.CreateView):
            self.compile(node.query)
            self.catalog.create_view(node.name, node.query)
        elif isinstance(node, t.DropView):
            self.catalog.drop_view(node.name)
        elif isinstance(node, t.CreateIndex):
            self.catalog.create_index(node.table, node.attr)
        else:
            self.catalog.drop_index(node.table, node.attr)

    # aggregates and procedures

    def aggregate(self, function: str, query: str, attr: str | int | None = None, out: str = "value") -> DataFrame:
        """COUNT, MIN, MAX, AVG, SUM or VAR of a query, as a one-row DataFrame."""
        node = parse(query)
        if not isinstance(node, t.QUERIES):
            raise SemanticError("an aggregate needs a query")
        return aggregate(self.compile(node), function, attr, out)

    def create_procedure(self, source: str) -> str:
        """Compile and keep a procedure; returns its name."""
        procedure = compile_procedure(source)
        self.catalog.procedures[procedure.name] = source
        self.compiled[procedure.name] = procedure
        self.catalog.save()
        return procedure.name

    def call(self, name: str, *args: Any) -> Any:
        """Run a procedure with int, float and str arguments."""
        args = tuple(Single(a) if isinstance(a, float) else a for a in args)
        if name in self.catalog.procedures:
            if name not in self.compiled:
                self.compiled[name] = compile_procedure(self.catalog.procedures[name])
            return Interpreter(lambda s: self.execute(s).success, self._rows, self.printed.append).run(self.compiled[name], args)
        if name not in SHIPPED:
            raise ProcedureError(f"unknown procedure {name}")
        if len(args) != SHIPPED[name]:
            raise ProcedureError(f"{name} takes {SHIPPED[name]} arguments")
        if name == "CreateDBs":
            return self.create_workload(*args)
        value = self.aggregate(name, *args).first()[0]
        return 0 if value is None else of_column(value)

    def _rows(self, query: str) -> Iterator[Row]:
        result = self.execute(query)
        if result.kind != "query":
            return iter(())
        # bare names, repeated where tables share them: a procedure takes the first that fits
        return self._held(result.relation.df.toDF(*(a.name for a in result.relation.attrs)))

    def _held(self, df: DataFrame) -> Iterator[Row]:
        """Rows of which no part is removed while they are being read, whatever the loop changes."""
        self.catalog.readers += 1
        try:
            yield from df.toLocalIterator()
        finally:
            self.catalog.readers -= 1

    def create_workload(self, name: str, size: int) -> int:
        """Table ``name(i, s, t)`` of ``size`` rows ``(k, 'k', 'k')`` with an index on ``s``; 0 on success."""
        self.execute(f"DROP TABLE {name};")
        if not self.execute(f"CREATE TABLE {name} (i INT PRIMARY KEY, s STRING(64), t STRING(64));").success:
            return -2
        if not self.execute(f"CREATE INDEX ON {name} (s);").success:
            return -1
        rows = self.spark.range(size).select(F.col("id").cast("int").alias("i"), F.col("id").cast("string").alias("s"), F.col("id").cast("string").alias("t"))
        self.insert_rows(name, rows)
        return 0


def _argument(literal: Literal) -> Any:
    if literal.domain not in (INT, FLOAT, STRING):
        raise ProcedureError(f"a procedure takes no {literal.domain}")
    return Single(literal.value) if literal.domain == FLOAT else literal.value


def bind(form: str, *args: Any) -> str:
    """Fill in a statement's placeholders.

    ``%s`` and ``%S`` put a string as it is, ``%e`` and ``%E`` with its quotes
    escaped; numbers are ``%d``, ``%ld``, ``%f`` (FLOAT literal) and ``%lf``.  A
    closing ``;`` is added.
    """
    out, at, left = [], 0, list(args)
    codes = {"%ld": lambda x: f"{int(x)}L", "%lf": lambda x: f"{float(x):f}", "%d": lambda x: str(int(x)), "%f": lambda x: f"{float(x):f}F"}
    codes |= dict.fromkeys(("%s", "%S"), str) | dict.fromkeys(("%e", "%E"), lambda x: str(x).replace("'", "\\'"))
    while at < len(form):
        code = next((c for c in (form[at : at + 3], form[at : at + 2]) if c in codes), None)
        if form.startswith("%%", at):
            out.append("%")
            at += 2
        elif code is not None:
            if not left:
                raise SemanticError("too few values for the placeholders")
            out.append(codes[code](left.pop(0)))
            at += len(code)
        else:
            out.append(form[at])
            at += 1
    if left:
        raise SemanticError("too many values for the placeholders")
    text = "".join(out).rstrip()
    return text if text.endswith(";") else text + ";"
