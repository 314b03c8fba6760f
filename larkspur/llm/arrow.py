"""``mapInArrow`` whose executors are sure to have this package, on batches of bounded bytes."""

from __future__ import annotations

import tempfile
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

#: Bytes of text that a Python worker works on at a time.
SLICE_BYTES = 2 << 20
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package's sources to the executors, once for each application."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    package = Path(__file__).resolve().parents[1]
    target = Path(tempfile.mkdtemp(prefix="larkspur-src-")) / "larkspur-src.zip"
    with zipfile.ZipFile(target, "w") as z:
        for source in sorted(package.rglob("*.py")):
            z.write(source, source.relative_to(package.parent))
    spark.sparkContext.addPyFile(str(target))
    _shipped.add(app)


def map_arrow(df: DataFrame, run: Callable, schema) -> DataFrame:
    """``df.mapInArrow(run, schema)`` on a cluster that need not have the package installed."""
    ship(df.sparkSession)
    return df.mapInArrow(run, schema)


def utf8(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of a string column; null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def sliced(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Batches cut, without copying, into runs of rows whose ``column`` holds about ``most`` bytes; one row at least."""
    for batch in batches:
        for at, n in cuts(batch.column(column), most):
            yield batch.slice(at, n)


def cuts(column: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """``(first row, rows)`` of such runs."""
    sizes = np.nan_to_num(pc.binary_length(column).to_numpy(zero_copy_only=False)).astype(np.int64)
    at = 0
    while at < len(sizes):
        reached = np.cumsum(sizes[at : at + 4096])
        n = max(1, int(np.searchsorted(reached, most, side="right")))
        yield at, n
        at += n
