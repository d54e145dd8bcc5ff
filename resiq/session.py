"""Session helpers: tuned local sessions, table access and lineage cutting."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = "*", shuffle: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and benchmarks on one machine; clusters bring their own. Checkpoints go to a folder that is
    removed with the process."""
    folder = tempfile.mkdtemp(prefix="resiq-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", str(shuffle))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", memory)
        .config("spark.checkpoint.dir", folder)
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """Folder that all executors share: spark.checkpoint.dir. Only where it is unset (tests on one
    machine) a temporary folder of this machine is set instead."""
    sc = spark.sparkContext
    known = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if known and sc.getCheckpointDir() is None:
        sc.setCheckpointDir(known)
    if not known:
        known = os.path.join(tempfile.gettempdir(), f"resiq-{sc.applicationId}")
        sc.setCheckpointDir(known)
    return known


def cut(df: DataFrame, eager: bool = True) -> DataFrame:
    """Cut the lineage through a reliable checkpoint, which survives the loss of executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager)


def _folder(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def drop_path(spark: SparkSession, path: str) -> None:
    """Remove a folder wherever it lies."""
    _, at, fs = _folder(spark, path)
    fs.delete(at, True)


def write_bytes(spark: SparkSession, path: str, data: bytes) -> None:
    """A small file on any file system, whole or not at all: written beside and renamed."""
    jvm, at, fs = _folder(spark, path)
    aside = jvm.org.apache.hadoop.fs.Path(at.getParent(), "_" + at.getName())
    out = fs.create(aside, True)
    out.write(bytearray(data))
    out.close()
    if not fs.rename(aside, at):
        raise OSError(f"cannot rename to {path}")


def read_folder(spark: SparkSession, path: str) -> dict[str, bytes]:
    """The small files of a folder by name, without unfinished ones; none if there is no such folder."""
    jvm, at, fs = _folder(spark, path)
    out = {}
    for f in fs.listStatus(at) if fs.exists(at) else []:
        if not f.getPath().getName().startswith(("_", ".")):
            stream = fs.open(f.getPath())
            out[f.getPath().getName()] = bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
            stream.close()
    return out


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ship_by_value() -> None:
    """Have functions of this package pickled whole, so that executors need no copy of it on their path."""
    from pyspark import cloudpickle

    import resiq

    cloudpickle.register_pickle_by_value(resiq)
