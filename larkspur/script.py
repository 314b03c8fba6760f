"""Script runner: statements and a few commands, one on each line.

``count V query`` stores a query's row count, ``store V`` the last count, ``echo
V`` prints one, ``assert A op B`` compares numbers, variables or one operation
on two of them.  ``@file`` runs another script; ``profiling-on`` and ``-off``
time statements; ``#`` starts a comment line; ``exit`` ends the script.
"""

from __future__ import annotations

import operator
import re
import time
from dataclasses import dataclass, field
from pathlib import Path

from .engine import Engine, Result

_COMPARE = {"=": operator.eq, "==": operator.eq, "!=": operator.ne, "<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge}
_ARITH = {"+": operator.add, "-": operator.sub, "*": operator.mul, "/": operator.floordiv}


class AssertionFailed(Exception):
    """An ``assert`` line that does not hold."""


@dataclass
class Script:
    """Runs lines against an engine; keeps variables, output, errors and timings."""

    engine: Engine
    stop_at_failure: bool = True
    variables: dict[str, int] = field(default_factory=dict)
    output: list[str] = field(default_factory=list)
    errors: list[str] = field(default_factory=list)
    timings: list[tuple[str, float]] = field(default_factory=list)
    last_count: int = 0
    profiling: bool = False

    def run_file(self, path: str | Path) -> "Script":
        return self.run(Path(path).read_text(encoding="utf-8"), Path(path).parent)

    def run(self, text: str, folder: str | Path = ".") -> "Script":
        for line in text.splitlines():
            line = line.strip()
            if line == "exit":
                break
            if line and not line.startswith("#"):
                self.line(line, Path(folder))
        return self

    def line(self, line: str, folder: Path) -> None:
        word, _, rest = line.partition(" ")
        rest = rest.strip()
        if line.startswith("@"):
            self.run_file(folder / line[1:].strip())
        elif word in ("profiling-on", "profiling-off"):
            self.profiling = word == "profiling-on"
        elif word == "errors":
            self.output.extend(self.errors)
        elif word == "clearerrors":
            self.errors.clear()
        elif word == "help":
            self.output.append(__doc__ or "")
        elif word == "count":
            name, _, query = rest.partition(" ")
            result = self._timed(query)
            if result.kind != "query":
                self.errors.append(f"no query: {query}")
                return
            self.last_count = self.variables[name] = result.relation.df.count()
        elif word == "store":
            self.variables[rest] = self.last_count
        elif word == "echo":
            self.output.append(f"{rest} = {self.variables[rest]}" if rest in self.variables else f"unknown variable {rest}")
        elif word == "assert":
            self._assert(rest)
        else:
            result = self._timed(line)
            if result.kind == "query":
                self.output.append(result.table())
            elif result.kind == "modification":
                self.last_count = result.count
            elif result.kind == "procedure":
                self.output.append(str(result.value))

    def _timed(self, statement: str) -> Result:
        began = time.monotonic()
        result = self.engine.execute(statement)
        if self.profiling:
            if result.kind == "query":
                result.relation.df.write.format("noop").mode("overwrite").save()
            self.timings.append((statement, time.monotonic() - began))
        if not result.success:
            self.errors.append(result.error or statement)
        return result

    def _number(self, text: str) -> int:
        m = re.fullmatch(r"\s*(\w+)\s*(?:([-+*/])\s*(\w+)\s*)?", text)
        if m is None:
            raise AssertionFailed(f"not an expression: {text}")
        one = self._operand(m[1])
        return _ARITH[m[2]](one, self._operand(m[3])) if m[2] else one

    def _operand(self, text: str) -> int:
        if text.isdigit():
            return int(text)
        if text not in self.variables:
            raise AssertionFailed(f"unknown variable {text}")
        return self.variables[text]

    def _assert(self, text: str) -> None:
        m = re.fullmatch(r"(.+?)\s*(==|!=|<=|>=|=|<|>)\s*(.+)", text)
        if m is None:
            raise AssertionFailed(f"not an assertion: {text}")
        left, right = self._number(m[1]), self._number(m[3])
        if not _COMPARE[m[2]](left, right):
            message = f"assertion failed: {text} ({left} {m[2]} {right})"
            self.errors.append(message)
            if self.stop_at_failure:
                raise AssertionFailed(message)


def main() -> None:
    """``python -m larkspur.script FILE...``"""
    import sys

    from pyspark.sql import SparkSession

    spark = SparkSession.builder.getOrCreate()
    script = Script(Engine(spark), stop_at_failure=False)
    for path in sys.argv[1:]:
        script.run_file(path)
    print("\n".join(script.output))
    print("\n".join(script.errors), file=sys.stderr)


if __name__ == "__main__":
    main()
