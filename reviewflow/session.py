"""Session settings and the shared work folder."""

from __future__ import annotations

import io
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def build_session(master: str = "local[*]", app: str = "reviewflow", **conf) -> SparkSession:
    """A session for tests and benchmarks; a cluster brings its own."""
    settings = {
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.python.sql.dataFrameDebugging.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **conf,
    }
    builder = SparkSession.builder.master(master).appName(app)
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return configure(spark)


def configure(spark: SparkSession) -> SparkSession:
    """Set the session options the operators' semantics rely on."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    # A repeated JSON key keeps its last value.
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    return spark


def ship_package(spark: SparkSession) -> None:
    """Hand this package to the Python workers, which may not have it installed."""
    name = "reviewflow-package.zip"
    context = spark.sparkContext
    if name in context._python_includes:
        return
    package = Path(__file__).resolve().parent
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as archive:
        for source in sorted(package.rglob("*.py")):
            archive.write(source, source.relative_to(package.parent))
    target = spark._jvm.org.apache.hadoop.fs.Path(f"{work_folder(spark, 'package')}/{name}")
    out = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target)
    out.write(packed.getvalue())
    out.close()
    context.addPyFile(target.toString())


def work_folder(spark: SparkSession, purpose: str) -> str:
    """A new folder below the application's in the cluster's shared checkpoint folder.

    The application's folder is removed when the application ends.
    Only a local session without ``spark.checkpoint.dir`` gets a temporary
    folder of this machine.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder all executors can reach")
        shared = os.environ.get("REVIEWFLOW_LOCAL_WORK") or tempfile.mkdtemp(prefix="reviewflow-")
    parent = f"{shared.rstrip('/')}/reviewflow-{spark.sparkContext.applicationId}"
    folder, files = _hadoop(spark, parent)
    if not files.exists(folder):
        files.mkdirs(folder)
        files.deleteOnExit(folder)
    return f"{parent}/{purpose}-{uuid.uuid4().hex}"


def clear_work(spark: SparkSession) -> None:
    """Remove what the application has written to work folders so far.

    They go by themselves when it ends. A session that runs many jobs calls this
    between them, when no result that reads a work folder is needed any more.
    """
    parent = work_folder(spark, "").rsplit("/", 1)[0]
    folder, files = _hadoop(spark, parent)
    for found in files.listStatus(folder):
        if not found.getPath().getName().startswith("package-"):
            files.delete(found.getPath(), True)


def _hadoop(spark: SparkSession, path: str):
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder, folder.getFileSystem(spark._jsc.hadoopConfiguration())


def stored(df, purpose: str, *partition_by: str):
    """The same rows read back from a table written to the shared folder.

    Used where a result is read several times: its input is computed once, and
    a lost executor costs a re-read instead of a recomputation.
    """
    spark = df.sparkSession
    path = work_folder(spark, purpose)
    df.write.partitionBy(*partition_by).parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._stored_at = path
    return back


def discard(*frames) -> None:
    """Remove the folders of frames made by :func:`stored` that nothing will read any more."""
    for frame in frames:
        folder, files = _hadoop(frame.sparkSession, frame._stored_at)
        files.delete(folder, True)
