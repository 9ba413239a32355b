"""Session set-up and the few services every operator needs: table access, lineage cuts, bounded-size checks."""

from __future__ import annotations

import atexit
import os
import re
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "vitalis", master: str | None = None, cpus: int | None = None) -> SparkSession:
    """A session for tests and benches; on a cluster the caller's session is used as it is."""
    b = SparkSession.builder.appName(app)
    b = b.master(master or f"local[{cpus or '*'}]")
    conf = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.shuffle.partitions": str(cpus or 8),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    }
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once per application: their Python workers need it, wherever the driver runs."""
    sc = spark.sparkContext
    if getattr(sc, "_vitalis_shipped", False):
        return
    home = os.path.dirname(os.path.abspath(__file__))
    handle, path = tempfile.mkstemp(prefix="vitalis-", suffix=".zip")
    os.close(handle)
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, files in os.walk(home):
            for f in files:
                if f.endswith(".py"):
                    z.write(os.path.join(folder, f), os.path.join("vitalis", os.path.relpath(os.path.join(folder, f), home)))
    sc.addPyFile(path)
    sc._vitalis_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: the session's spark.checkpoint.dir.

    Where none is set, a local session (tests) gets one of its own; on a cluster that is an error, as each node has another disk.
    """
    sc = spark.sparkContext
    known = sc._jsc.sc().getCheckpointDir()
    if known.isDefined():
        return known.get()
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = tempfile.mkdtemp(prefix="vitalis-checkpoint-")
    sc.setCheckpointDir(named)
    return sc._jsc.sc().getCheckpointDir().get()


def remove(spark: SparkSession, path: str) -> None:
    """Removes a folder of intermediate data, wherever it lies."""
    sc = spark.sparkContext
    if sc._jsc is None:  # the session has ended
        return
    where = sc._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(sc._jsc.hadoopConfiguration()).delete(where, True)


def scratch(spark: SparkSession, purpose: str) -> str:
    """A new folder in the shared one; it is removed when the application ends, unless remove() did so before."""
    path = f"{shared_dir(spark)}/{purpose}-{uuid.uuid4().hex}"
    atexit.register(_remove_late, spark, path)
    return path


def _remove_late(spark: SparkSession, path: str) -> None:
    try:
        remove(spark, path)
    except Exception:  # noqa: BLE001 - nothing can be done about it any more
        pass


def cut(df: DataFrame) -> DataFrame:
    """Cuts the lineage through a reliable checkpoint in the shared folder; it survives the loss of executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, folder: str) -> DataFrame:
    """Cuts the lineage through a table in a folder from scratch(); plans go by the size that it really has.

    A checkpoint keeps the estimate of its plan, which joins multiply. Where that comes to 10 GB, Spark adds Bloom
    filters of 1 MB a column, which the driver holds and sends with every stage.
    """
    path = f"{folder}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Removes the checkpoint of a cut() result that nothing will read again."""
    plan = df._jdf.queryExecution().analyzed()
    if plan.getClass().getSimpleName() == "LogicalRDD":
        path = plan.rdd().getCheckpointFile()
        if path.isDefined():
            remove(df.sparkSession, path.get())


def bounded_file(path: str, most: int) -> bytes:
    """Content of a file whose size is checked before it is sent to the executors."""
    size = os.path.getsize(path)
    if size > most:
        raise ValueError(f"{path} has {size} bytes; at most {most} are sent to the executors")
    with open(path, "rb") as f:
        return f.read()


def bounded_rows(df: DataFrame, most: int, what: str) -> list:
    """Collects a result that is small by construction, and fails rather than flood the driver when it isn't."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} {what}")
    return rows
