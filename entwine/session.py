"""Session, tables and lineage cuts shared by all operators."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: The setting in which a cluster names the folder that all executors share.
CHECKPOINT_DIR = "spark.checkpoint.dir"


def local_session(cores: int | str = "*", partitions: int = 8, memory: str = "8g", name: str = "entwine") -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def files(spark: SparkSession, path: str):
    """Hadoop's path and the file system that it lies on."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def shared_dir(spark: SparkSession) -> str:
    """The shared folder for cut lineage: the cluster's; on one machine, where none is set, one made for this process."""
    path = spark.conf.get(CHECKPOINT_DIR, None) or spark.sparkContext.getConf().get(CHECKPOINT_DIR)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError(f"{CHECKPOINT_DIR} must name a folder that all executors share")
        path = tempfile.mkdtemp(prefix="entwine-")
        atexit.register(shutil.rmtree, path, ignore_errors=True)
        spark.conf.set(CHECKPOINT_DIR, path)
    return path


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one, on any file system; it goes when this application ends."""
    path = f"{shared_dir(spark)}/entwine/{name}-{uuid.uuid4().hex}"
    p, fs = files(spark, path)
    fs.mkdirs(p)
    fs.deleteOnExit(p)
    return path


def cut(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read again: its lineage ends there and any executor may be lost.

    The table lives as long as its reader may need it, that is until the process ends; a cluster
    whose folder outlives the process clears it by age.
    """
    path = scratch(df.sparkSession, name)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ship(spark: SparkSession) -> None:
    """Gives this package to the executors' Python workers, once for each context; they may lack it otherwise.

    A no-op where the package came as a file of the application already.
    """
    context = spark.sparkContext
    package = Path(__file__).resolve().parent
    if context.applicationId in _shipped or not package.is_dir():
        return
    folder = tempfile.mkdtemp(prefix="entwine-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    with zipfile.ZipFile(f"{folder}/entwine.zip", "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    context.addPyFile(f"{folder}/entwine.zip")  # the driver's file server hands it out, to late executors too
    _shipped.add(context.applicationId)


_shipped: set[str] = set()
