"""One way to make a session for tests and benchmarks; production callers bring their own."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def local_session(name: str = "kosha", cpus: int | None = None, memory: str = "8g") -> SparkSession:
    cpus = cpus or int(os.environ.get("BENCH_CPUS", "8"))
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a temporary one in local mode alone."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):  # local-cluster has executors of their own
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="kosha-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def ship(spark: SparkSession) -> None:
    """Send this package to the workers of a session, once, unless their path holds it already."""
    root = Path(__file__).resolve().parent.parent
    known = {Path(p).resolve() for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p} | {Path.cwd()}
    context = spark.sparkContext
    if root in known or getattr(context, "_kosha_shipped", False):
        return
    folder = tempfile.mkdtemp(prefix="kosha-code-")
    with zipfile.ZipFile(f"{folder}/kosha.zip", "w") as out:
        for file in sorted((root / "kosha").rglob("*.py")):
            out.write(file, file.relative_to(root))
    context.addPyFile(f"{folder}/kosha.zip")
    context._kosha_shipped = True
