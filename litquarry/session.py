"""Session construction with the settings every operator relies on."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import zipfile

from pyspark.sql import SparkSession

SQL_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(cpus: int | None = None, app: str = "litquarry") -> SparkSession:
    """Session for tests and benches; on a cluster use the submitted one."""
    cpus = cpus or int(os.environ.get("BENCH_CPUS", "8"))
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
    )
    for key, value in SQL_SETTINGS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship(spark: SparkSession) -> None:
    """Send the package to the Python workers, once per session, so that a session started anywhere can run the operators.

    The driver writes one archive, which Spark's own file distribution hands to every executor, later ones included; it must
    stay on the driver until the session ends.
    """
    package = os.path.dirname(os.path.abspath(__file__))
    name, context = f"{os.path.basename(package)}.zip", spark.sparkContext
    if name in context._python_includes:
        return
    folder = tempfile.mkdtemp(prefix="litquarry-package-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    path = os.path.join(folder, name)
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as out:
        for place, _, files in os.walk(package):
            for file in files:
                if file.endswith(".py"):
                    found = os.path.join(place, file)
                    out.write(found, os.path.relpath(found, os.path.dirname(package)))
    context.addPyFile(path)
