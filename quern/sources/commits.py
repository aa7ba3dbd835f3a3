"""An append log in a folder that outlives its job: parts of Parquet with a mark written after each, so that an interrupted part does not count."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


class CommitLog:
    """Parts 0, 1, ... of one schema below a folder of any store that Spark can write.

    A part is written whole, then its mark is created; a part without one is overwritten by the next attempt.  So a log is read as it was
    after some whole number of commits, however its job ended.  There is one writer.
    """

    def __init__(self, spark: SparkSession, folder: str, schema: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")
        self.schema = StructType.fromDDL(schema)
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._files = self._path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def _marks(self) -> list[str]:
        top = self._path(f"{self.folder}/marks")
        return [f.getPath().getName() for f in self._files.listStatus(top)] if self._files.exists(top) else []

    def commits(self) -> int:
        """How many parts are committed."""
        return sum(m.isdigit() for m in self._marks())

    def append(self, rows: DataFrame) -> int:
        """Write rows as the next part and commit it; its number."""
        n = self.commits()
        rows.select(*self.schema.names).write.mode("overwrite").parquet(f"{self.folder}/parts/{n:08d}")
        self._files.create(self._path(f"{self.folder}/marks/{n:08d}"), False).close()
        return n

    def read(self) -> DataFrame:
        """All committed rows."""
        n = self.commits()
        if not n:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*(f"{self.folder}/parts/{i:08d}" for i in range(n)))

    def finish(self) -> None:
        """Mark the log as complete; nothing more will come."""
        mark = self._path(f"{self.folder}/marks/complete")
        if not self._files.exists(mark):
            self._files.create(mark, False).close()

    def complete(self) -> bool:
        return "complete" in self._marks()
