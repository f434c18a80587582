"""Session factory and the shared folder in which lineage is cut."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_scope: ContextVar[list[tuple[SparkSession, str]] | None] = ContextVar("genoplane_scratch", default=None)


def build_session(app: str = "genoplane", master: str | None = None, **conf: str) -> SparkSession:
    """A session with UTC time, adaptive execution and Arrow transfer; `conf` overrides any setting."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
        "spark.ui.showConsoleProgress": "false",
    } | conf
    builder = SparkSession.builder.appName(app).config(map=settings)
    return (builder.master(master) if master else builder).getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir.

    Where the session names none, a local session (tests, one machine) gets a folder of its own; on a cluster that
    is an error, since every executor would write to a disk that the others cannot read.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise RuntimeError("spark.checkpoint.dir has to name a folder that all executors share")
    own = "file://" + tempfile.mkdtemp(prefix="genoplane-")
    spark.conf.set("spark.checkpoint.dir", own)
    _file_system(spark, own).deleteOnExit(_path(spark, own))
    return own


def _path(spark: SparkSession, path: str):
    return spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)


def _file_system(spark: SparkSession, path: str):
    return _path(spark, path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


@contextmanager
def scratch_tables() -> Iterator[None]:
    """Release, at the end of the block, every table that `cut_lineage` writes inside it.

    Frames that depend on such tables may only be used inside: a long-lived session runs a query and writes its result in
    the block, and the shared folder does not fill.
    """
    outer = _scope.get()
    token = _scope.set(tables := [])
    try:
        yield
    finally:
        _scope.reset(token)
        for spark, path in tables:
            _file_system(spark, path).delete(_path(spark, path), True)
        if outer is not None:
            outer[:] = [x for x in outer if x not in tables]


def cut_lineage(df: DataFrame, stem: str = "cut") -> DataFrame:
    """Write `df` as a table into the shared folder and read it back.

    The written table survives the loss of executors and is columnar, so later readers prune columns and
    the optimizer knows its size. It stays until `release`, the end of the enclosing `scratch_tables`, or until the
    driver's JVM ends: the file system is told to delete it then, which works after the session has been stopped too.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{stem}-{uuid.uuid4().hex}"
    _file_system(spark, path).deleteOnExit(_path(spark, path))
    if (tables := _scope.get()) is not None:
        tables.append((spark, path))
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._genoplane_path = path
    return out


def release(*tables: DataFrame | None) -> None:
    """Remove the tables behind frames that `cut_lineage` returned; nothing may read them afterwards."""
    for df in tables:
        path = getattr(df, "_genoplane_path", None)
        if path:
            _file_system(df.sparkSession, path).delete(_path(df.sparkSession, path), True)
