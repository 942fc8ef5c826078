"""Session settings and durable intermediate tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def get_spark(app_name: str = "sentloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution; cluster settings come from spark-submit."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder for intermediate tables.

    The cluster names it in ``spark.checkpoint.dir``. Only a local session, where driver and
    executors are one process, may fall back to a temporary folder.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    if not (context.master == "local" or context.master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="sentloom-"))
    return context.getCheckpointDir()


#: Paths stored by the innermost :func:`scratch`; those outside of any stay.
_STORED: ContextVar[list[str] | None] = ContextVar("stored", default=None)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Removes the tables that :func:`materialize` stores inside it, for jobs whose results are written
    elsewhere by then."""
    stored: list[str] = []
    token = _STORED.set(stored)
    try:
        yield
    finally:
        _STORED.reset(token)
        for name in stored:
            _delete(spark, name)


def _delete(spark: SparkSession, name: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def remove(stored: DataFrame) -> None:
    """Deletes a table of :func:`materialize` that nothing reads any more."""
    for name in {file.rpartition("/")[0] for file in stored.inputFiles()}:
        _delete(stored.sparkSession, name)


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Cuts lineage, gives Catalyst real sizes and fixes the rows: a lost executor can not make
    a later stage see another partitioning or another sample than an earlier one saw.
    """
    path = f"{checkpoint_root(df.sparkSession).rstrip('/')}/table-{uuid.uuid4().hex}"
    stored = _STORED.get()
    if stored is not None:
        stored.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
