"""Session construction and the checkpoint directory.

Iterative operators (connected components in the leader dedup) cut lineage with
``DataFrame.checkpoint()``, which writes to the directory named by
``spark.checkpoint.dir``. On a cluster that directory is shared storage chosen by
the operator of the cluster; we only read it. A private directory is created only
when the setting is missing and the master is local (tests, the bench).
"""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from pathlib import Path

from pyspark.sql import SparkSession

_DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_session(master: str | None = None, app: str = "curata",
                shuffle_partitions: int | None = None,
                extra: dict[str, str] | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    conf = dict(_DEFAULT_CONF)
    if master and master.startswith("local"):
        # local mode: the driver JVM is the only executor
        conf["spark.driver.memory"] = os.environ.get("CURATA_DRIVER_MEMORY", "16g")
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the checkpoint directory, registering it with the context.

    Reads ``spark.checkpoint.dir``; when unset, a scratch directory is made only
    for local masters. A cluster without the setting is an error, because a
    machine-local folder would not survive the loss of an executor.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
        "spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
        return sc.getCheckpointDir() or configured
    if not sc.master.startswith("local"):
        raise RuntimeError(
            "spark.checkpoint.dir is not set; point it at shared storage "
            "(HDFS/object store) before running iterative operators")
    path = tempfile.mkdtemp(prefix="curata-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    sc.setCheckpointDir(path)
    return sc.getCheckpointDir() or path


def materialize(df):
    """Cut lineage at a shared intermediate: a reliable checkpoint into
    ``spark.checkpoint.dir`` (survives the loss of an executor; never
    ``localCheckpoint``). Used where one intermediate feeds several branches and
    the plan would otherwise copy its subtree into each."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df, name: str):
    """``df`` written once below ``spark.checkpoint.dir`` as compressed columns and read back:
    for narrow tables with many rows, which a checkpoint would hold several times larger."""
    path = f"{ensure_checkpoint_dir(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    schema = df.schema
    if (held := _PASSING.get()) is not None:
        held.append(path)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(schema).parquet(path)


_PASSING: ContextVar[list[str] | None] = ContextVar("passing", default=None)


@contextmanager
def passing(spark: SparkSession) -> Iterator[None]:
    """What ``stored`` writes inside is removed at the end: for a caller that has written by then
    all that is made of it."""
    held: list[str] = []
    token = _PASSING.set(held)
    try:
        yield
    finally:
        _PASSING.reset(token)
        for path in held:
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def ship_package(spark) -> None:
    """Send this package to the Python workers (once per context), so that functions
    which run there can import it wherever the job was started from."""
    sc = spark.sparkContext
    if getattr(sc, "_curata_shipped", False):
        return
    root = Path(__file__).resolve().parent
    archive = os.path.join(tempfile.mkdtemp(prefix="curata-pkg-"), f"{root.name}.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    sc.addPyFile(archive)
    sc._curata_shipped = True
