"""Session defaults and the shared scratch folder."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


_local_folders: dict[str, str] = {}  # of local sessions without the setting, by application


def build_session(app_name: str = "voxrank", cores: int | str = "*", **settings: str) -> SparkSession:
    """A local session for tests and benchmarks; clusters bring their own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app_name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.files.openCostInBytes", "262144")  # small test files still use every core
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in settings.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def import_on_workers(spark: SparkSession) -> None:
    """Let Python workers on this machine import the package, from whatever folder the session was started.

    A cluster ships the package its own way; there the extra path does nothing.
    """
    root, environment = str(Path(__file__).resolve().parents[1]), spark.sparkContext.environment
    paths = [p for p in environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([root, *paths])


@contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """The session's ``key`` is ``value`` for the jobs run inside."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def scratch_folder(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Only a local session may fall back to a temporary folder: on a cluster the
    executors could not see it.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("Set spark.checkpoint.dir to a folder every executor can reach.")
    application = spark.sparkContext.applicationId
    if application not in _local_folders:
        _local_folders[application] = tempfile.mkdtemp(prefix="voxrank-")
    return _local_folders[application]


def store(df: DataFrame, name: str, **options: str) -> str:
    """Write ``df`` to a new folder of the shared scratch space and return its path."""
    path = f"{scratch_folder(df.sparkSession)}/voxrank/{name}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return path


def materialise(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Cuts the lineage with a real table, so a lost executor costs a re-read and
    never a recomputation, and several consumers share one evaluation.
    """
    return df.sparkSession.read.schema(df.schema).parquet(store(df, name, **options))
