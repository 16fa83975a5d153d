"""A session with the settings that the library counts on."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def get_spark(name: str = "sparkloom", master: str | None = None, **conf: str) -> SparkSession:
    """UTC, adaptive execution with skew joins; partition counts are left to the cluster or to ``conf``."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.showConsoleProgress": "false",
    }
    for k, v in (settings | conf).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def ship(spark: SparkSession) -> None:
    """Sends the package to the Python workers, once for each context; they may run where it is not installed."""
    context = spark.sparkContext
    if getattr(context, "_sparkloom_sent", False):
        return
    package = Path(__file__).resolve().parent.parent
    target = Path(tempfile.mkdtemp(prefix="sparkloom-")) / "sparkloom.zip"
    with zipfile.ZipFile(target, "w") as out:
        for file in sorted(package.rglob("*.py")):
            out.write(file, file.relative_to(package.parent))
    context.addPyFile(str(target))
    context._sparkloom_sent = True  # type: ignore[attr-defined]
