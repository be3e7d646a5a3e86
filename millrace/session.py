"""Session helpers: a tuned local session, table loading, checkpoint folder, shipping the package to executors."""

from __future__ import annotations

import io
import os
import tempfile
import zipfile

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = "*", app: str = "millrace", **conf: str) -> SparkSession:
    """A session for one machine; a cluster passes its own session to every function instead."""
    builder = SparkSession.builder.master(f"local[{cpus}]").appName(app)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.shuffle.partitions": "8",
        "spark.ui.enabled": "false",
        "spark.driver.memory": "8g",
        "spark.sql.adaptive.enabled": "true",
    }
    for key, value in (defaults | conf).items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's spark.checkpoint.dir; only where none is set (tests, one machine) a folder of our own."""
    if spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        return
    given = spark.conf.get("spark.checkpoint.dir", None)
    spark.sparkContext.setCheckpointDir(given or os.path.join(tempfile.gettempdir(), "millrace-checkpoints"))


#: Rows and bytes in one Arrow batch, whichever is met first: a batch of very long texts must still fit a Python worker.
ROWS_PER_BATCH, BYTES_PER_BATCH = 1024, 1 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Lower the session's bounds of Arrow batches to ours, where they are larger; they stay lowered."""
    for key, most in (("maxRecordsPerBatch", ROWS_PER_BATCH), ("maxBytesPerBatch", BYTES_PER_BATCH)):
        now = spark.conf.get(f"spark.sql.execution.arrow.{key}", None)
        if now is None or not 0 < int(now) <= most:
            spark.conf.set(f"spark.sql.execution.arrow.{key}", str(most))


def ship(spark: SparkSession) -> None:
    """Send this package's source to the executors, once per application, so that workers import it wherever they run."""
    context = spark.sparkContext
    if getattr(context, "_millrace_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as archive:
        for folder, _, names in os.walk(root):
            for name in sorted(names):
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    archive.write(path, os.path.relpath(path, os.path.dirname(root)))
    target = os.path.join(tempfile.mkdtemp(prefix="millrace-"), "millrace_src.zip")
    with open(target, "wb") as out:
        out.write(packed.getvalue())
    context.addPyFile(target)
    context._millrace_shipped = True
