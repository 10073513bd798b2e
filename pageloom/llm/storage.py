"""Tables that a job writes to the shared folder to cut its lineage."""

from __future__ import annotations

import atexit
import contextlib
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

from pageloom.llm.shipping import ship
from pageloom.session import shared_dir

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


@contextlib.contextmanager
def settings(spark: SparkSession, **changes: str) -> Iterator[None]:
    """Session settings for the jobs that run inside, as they were before afterwards."""
    before = {key: spark.conf.get(key, None) for key in changes}
    for key, value in changes.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


class Scratch:
    """A folder of one run below ``spark.checkpoint.dir``, removed when the session's process ends.

    Results are lazy and may still read a table when the operator returns, so only tables named in
    :meth:`drop` go earlier. All access is by Hadoop's file system, so any store works.
    """

    def __init__(self, spark: SparkSession, name: str) -> None:
        ship(spark)
        self.spark = spark
        self.root = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
        atexit.register(self.drop)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def save(self, df: DataFrame, name: str, batch: int | None = None) -> DataFrame:
        """Write ``df`` and return the table as it is read back.

        Shuffle files of the write are of no use to anything later, so Spark is told to remove them when it
        ends instead of when the driver happens to collect garbage. ``batch`` is the number of rows that go to
        Python workers at once: few where rows hold whole texts, or a batch is a task's whole input.
        """
        rows = {} if batch is None else {ARROW_ROWS: str(batch)}
        with settings(self.spark, **{CLEANUP: "true"}, **rows):
            df.write.mode("overwrite").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        """Delete the named tables, or all."""
        with contextlib.suppress(Exception):  # the session may be gone at exit
            jvm = self.spark._jvm
            for target in [self.path(n) for n in names] or [self.root]:
                path = jvm.org.apache.hadoop.fs.Path(target)
                path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
