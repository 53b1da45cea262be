"""Sessions and the shipping of this package to executors."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()


def session(name: str = "palimpsest", **conf: str) -> SparkSession:
    """A session with adaptive execution, UTC and Arrow; `conf` overrides."""
    builder = SparkSession.builder.appName(name)
    for k, v in ({"spark.sql.adaptive.enabled": "true", "spark.sql.session.timeZone": "UTC", "spark.sql.execution.arrow.pyspark.enabled": "true"} | conf).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def ship(spark: SparkSession) -> None:
    """Sends the package's sources to the executors' Python workers, once an application."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    top = Path(__file__).resolve().parents[2]
    folder = tempfile.mkdtemp(prefix="palimpsest-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    import zipfile

    with zipfile.ZipFile(os.path.join(folder, "palimpsest_src.zip"), "w") as z:
        for p in sorted((top / "palimpsest").rglob("*.py")):
            z.write(p, p.relative_to(top))
        if (top / "corpus_pipeline.py").exists():
            z.write(top / "corpus_pipeline.py", "corpus_pipeline.py")
    spark.sparkContext.addPyFile(os.path.join(folder, "palimpsest_src.zip"))
    _SHIPPED.add(app)
