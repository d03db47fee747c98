"""Session helpers."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


#: Bytes of an Arrow batch. A task holds one in the JVM and one in its Python worker, and operators make others of it.
BATCH_BYTES, _BATCH, _DEFAULT = "16m", "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"


def ship_package(spark: SparkSession) -> None:
    """Makes this package importable in the Python workers of the session's application (as --py-files does).

    Arrow batches of the session are of BATCH_BYTES at most, unless it has a number of its own.
    """
    if spark.conf.get(_BATCH) == _DEFAULT:
        spark.conf.set(_BATCH, BATCH_BYTES)
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).resolve().parent
    path = os.path.join(tempfile.mkdtemp(prefix="loreforge-py-"), "loreforge.zip")
    with zipfile.ZipFile(path, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    spark.sparkContext.addPyFile(path)
    _shipped.add(app)


_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir. Where it is unset, a temporary one in local mode; elsewhere that is an error."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        if app not in _own:
            _own[app] = "file://" + tempfile.mkdtemp(prefix="loreforge-")
        base = _own[app]
    return base.rstrip("/")
