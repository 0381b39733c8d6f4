"""Session settings and the shared work folder."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import threading
import uuid

from pyspark.sql import SparkSession


def build_session(cpus: str | int = "*", app: str = "mailtriage", **conf: str) -> SparkSession:
    """Local session for tests and benchmarks; on a cluster use the session the cluster gives."""
    n = os.cpu_count() if cpus == "*" else int(cpus)
    builder = (
        SparkSession.builder.master(f"local[{cpus}]").appName(app)
        .config("spark.sql.shuffle.partitions", str(n))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.files.maxPartitionBytes", "4m")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_OWN_FOLDER: list[str] = []


def _local_folder(master: str) -> str:
    if not re.fullmatch(r"local(\[.*\])?", master):
        raise RuntimeError("spark.checkpoint.dir is unset: name a folder there that the driver and all executors share")
    if not _OWN_FOLDER:
        _OWN_FOLDER.append(tempfile.mkdtemp(prefix="mailtriage-"))
        atexit.register(shutil.rmtree, _OWN_FOLDER[0], ignore_errors=True)
    return _OWN_FOLDER[0]


def work_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder named by ``spark.checkpoint.dir``.

    Where that setting is absent, a local session (tests, benchmarks) gets one folder of this process,
    removed at its end. A cluster session fails instead: what one executor writes to its own disk the
    others cannot read.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or _local_folder(spark.sparkContext.master)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialize(df, name: str):
    """Write ``df`` once to the shared folder and read it back.

    Used where a result feeds several later jobs (fold fits, scoring passes): it cuts the lineage
    and, unlike an executor-local cache, survives the loss of an executor.
    """
    spark = df.sparkSession
    path = work_path(spark, name)
    df.write.mode("errorifexists").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread_groups(df, *keys: str):
    """Hash rows on ``keys`` over all shuffle partitions.

    For grouped Python work whose cost is in the computation: adaptive execution would merge its
    small partitions into a few tasks. The grouping that follows reuses this exchange.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, *keys)


_SHIPPING = threading.Lock()


def ship(spark: SparkSession) -> None:
    """Give every executor this package, once per application.

    Python tasks name its modules, so a worker that does not have the package on its path would fail
    at the first one. Spark serves the archive to the executors itself.
    """
    sc = spark.sparkContext
    # Fits call this from several threads; Spark takes a file of one name once.
    with _SHIPPING:
        if getattr(sc, "_mailtriage_shipped", False):
            return
        here = os.path.dirname(os.path.abspath(__file__))
        target = os.path.join(tempfile.mkdtemp(prefix="mailtriage-ship-"), "mailtriage-src")
        sc.addPyFile(shutil.make_archive(target, "zip", os.path.dirname(here), os.path.basename(here)))
        sc._mailtriage_shipped = True
