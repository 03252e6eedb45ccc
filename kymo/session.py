"""What a Spark session needs before the library's Python functions run on executors."""

from __future__ import annotations

import atexit
import io
import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package's sources to the executors once for each application, wherever the driver imported it from."""
    application = spark.sparkContext.applicationId
    if application in _shipped:
        return
    root = Path(__file__).resolve().parent
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as z:
        for source in sorted(root.rglob("*.py")):
            z.write(source, source.relative_to(root.parent))
    path = Path(tempfile.mkdtemp(prefix="kymo-")) / "kymo_sources.zip"
    path.write_bytes(data.getvalue())
    spark.sparkContext.addPyFile(str(path))
    _shipped.add(application)


def checkpoint_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, the folder that driver and executors share.

    Where it is unset, a session on one machine gets a temporary folder of its own. On a cluster that is an error:
    executors would write to disks that nobody else reads.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not path:
        master = spark.sparkContext.master
        if not re.match(r"local(\[|$)", master):
            raise ValueError(f"spark.checkpoint.dir must name a folder that all executors of {master} share")
        path = "file://" + tempfile.mkdtemp(prefix="kymo-shared-")
        spark.conf.set("spark.checkpoint.dir", path)
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def shared_path(spark: SparkSession, tag: str) -> str:
    """A new path in the folder that driver and executors share, removed when the driver's Python ends."""
    path = f"{checkpoint_dir(spark)}/kymo/{tag}-{uuid.uuid4().hex}"
    atexit.register(remove_path, spark, path)
    return path


def remove_path(spark: SparkSession, path: str) -> None:
    """Delete a path in any store that Spark reaches; silent where the session has ended already."""
    try:
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the JVM may be gone at exit
        pass


def stored(df: DataFrame, tag: str) -> DataFrame:
    """``df`` written to the folder that driver and executors share, and read again."""
    path = shared_path(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
