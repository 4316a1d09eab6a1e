"""Tables written to the folder that driver and executors share, to cut lineage.

A written table survives the loss of any executor, keeps column pruning, and is read again by each later job instead of
being computed again.  The folder is ``spark.checkpoint.dir``, or the checkpoint directory of the SparkContext.  Where
neither is set, a session on one machine (``local[...]``) gets a temporary folder of this process; on a cluster that would
be no shared folder, so it is an error there.

What an operator writes on its way is deleted when its result is written (``tidied``).  Results go when the process ends.
"""

from __future__ import annotations

import atexit
import contextlib
import functools
import re
import shutil
import tempfile
import threading
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_LOCK = threading.Lock()
_OWN: list[str] = []
_RESULTS: list[tuple[SparkSession, str]] = []
_SCOPES = threading.local()


def shared_dir(spark: SparkSession) -> str:
    """The folder for written tables; settings are only read."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found:
        return found.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    with _LOCK:
        if not _OWN:
            _OWN.append(tempfile.mkdtemp(prefix="residua-"))
            atexit.register(shutil.rmtree, _OWN[0], ignore_errors=True)
        return _OWN[0]


def forget(spark: SparkSession, paths: list[str]) -> None:
    """Delete written tables, wherever they are."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for path in paths:
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(conf).delete(at, True)


@atexit.register
def _forget_results() -> None:
    for spark, path in _RESULTS:
        with contextlib.suppress(Exception):  # the session may have ended
            forget(spark, [path])


def place(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder, for a file in any format; it goes like written tables do."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if scopes := getattr(_SCOPES, "open", None):
        scopes[-1].append(path)
    else:
        _RESULTS.append((spark, path))
    return path


def settle(df: DataFrame, name: str, *by: str) -> DataFrame:
    """Write ``df`` under a name of its own in the shared folder, in folders by the columns ``by``, and read it back."""
    spark = df.sparkSession
    path = place(spark, name)
    df.write.parquet(path, partitionBy=list(by) or None)
    return spark.read.schema(df.schema).parquet(path)


def tidied(make: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """An operator whose result is written; the tables that it wrote on the way are deleted then."""

    @functools.wraps(make)
    def run(*args, **kwargs) -> DataFrame:
        scopes = _SCOPES.open = getattr(_SCOPES, "open", [])
        scopes.append([])
        try:
            out = make(*args, **kwargs)
        finally:
            mine = scopes.pop()
        try:
            return settle(out, make.__name__)
        finally:
            forget(out.sparkSession, mine)

    return run
