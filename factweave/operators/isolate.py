"""Work that may fail on single rows, and the identity of the engine in keys."""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factweave import __version__


def isolated(rows: DataFrame, column: str, work: Callable[[object], str | None], order: str) -> DataFrame:
    """``order, result, error``: ``work`` on the value of each row, in parallel; what it raises becomes the row's
    ``error`` and stops nothing else. ``order`` keeps the rows' places, for tasks end in any order."""
    kind = rows.schema[order].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            results: list[str | None] = []
            errors: list[str | None] = []
            for v in b.column(1).to_pylist():
                try:
                    results.append(work(v))
                    errors.append(None)
                except Exception as e:  # any failure of one row is that row's
                    results.append(None)
                    errors.append(f"{type(e).__name__}: {e}")
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(results, pa.string()), pa.array(errors, pa.string())], names=[order, "result", "error"])

    return rows.select(F.col(order), F.col(column)).mapInArrow(run, f"`{order}` {kind}, result string, error string")


@functools.lru_cache(maxsize=1)
def engine_identity() -> str:
    """The version and a hash of the engine's own sources, so that a changed engine misses old entries."""
    root = Path(__file__).resolve().parent.parent
    digest = hashlib.sha256()
    for f in sorted(root.rglob("*.py")):
        digest.update(str(f.relative_to(root)).encode() + b"\0" + f.read_bytes() + b"\0")
    return f"{__version__}+{digest.hexdigest()[:16]}"
