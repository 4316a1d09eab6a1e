"""Named layers: what has been made of a corpus is written once, and made again only when what it was made from is newer."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


class Layers:
    """The layers of a project, tables in one folder by name and parameter; a session keeps what it has opened."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._open: dict[str, DataFrame] = {}

    def path(self, name: str, param: object = None) -> str:
        return f"{self.folder}/{name}" if param is None else f"{self.folder}/{name}_{param}"

    def written(self, path: str) -> int | None:
        """When the layer at a path was written to its end, in milliseconds; None where it wasn't."""
        jvm = self.spark._jvm
        mark = jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
        fs = mark.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return fs.getFileStatus(mark).getModificationTime() if fs.exists(mark) else None

    def layer(self, name: str, make: Callable[[], DataFrame], param: object = None, after: tuple[str, ...] = ()) -> DataFrame:
        """The layer, from what this session has open, from its table, or made and written anew: where there is no table or a
        path of ``after`` was written later."""
        path = self.path(name, param)
        at = self.written(path)
        fresh = at is not None and all((self.written(x) or 0) <= at for x in after)
        if fresh and path in self._open:
            return self._open[path]
        if not fresh:
            make().write.mode("overwrite").parquet(path)
        self._open[path] = self.spark.read.parquet(path)
        return self._open[path]
