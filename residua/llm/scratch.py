"""Tables written to the shared folder (``sinks.scratch``), in small Arrow batches where Python makes them."""

from __future__ import annotations

import threading
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from residua.sinks import scratch
from residua.sinks.scratch import shared_dir, tidied

__all__ = ["free_name", "settle", "shared_dir", "small_batches", "tidied"]
ARROW_ROWS = 2000
_LOCK = threading.Lock()
_HELD: dict[int, list] = {}


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """At most ARROW_ROWS rows in an Arrow batch while a table is written: the texts of a batch are held twice, by the executor
    and its Python.  Results don't depend on it.  Writers of one session at a time share one change; the last undoes it."""
    key, name = "spark.sql.execution.arrow.maxRecordsPerBatch", id(spark)
    with _LOCK:
        held = _HELD.setdefault(name, [0, spark.conf.get(key)])
        held[0] += 1
        if held[0] == 1 and not 0 < int(held[1]) <= ARROW_ROWS:
            spark.conf.set(key, str(ARROW_ROWS))
    try:
        yield
    finally:
        with _LOCK:
            held[0] -= 1
            if not held[0]:
                spark.conf.set(key, held[1])
                del _HELD[name]


def settle(df: DataFrame, name: str, *by: str) -> DataFrame:
    """Write ``df`` under a name of its own in the shared folder, in folders by the columns ``by``, and read it back."""
    with small_batches(df.sparkSession):
        return scratch.settle(df, name, *by)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` has it (Spark compares names without regard to case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name
