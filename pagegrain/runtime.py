"""Session helpers: shipping this package to executors and finding shared storage."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``pagegrain`` importable on every executor, whatever its working directory is.

    The package is zipped once per application and sent with ``addPyFile``.
    """
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    fd, name = tempfile.mkstemp(prefix="pagegrain-", suffix=".zip")
    os.close(fd)
    with zipfile.ZipFile(name, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, str(p.relative_to(root.parent)))
    spark.sparkContext.addPyFile(name)
    _SHIPPED.add(app)


#: Spark's limit of an Arrow batch in bytes, beside that of 10,000 rows, and what it is set to.
BATCH_BYTES, BATCH_MOST = "spark.sql.execution.arrow.maxBytesPerBatch", "2m"


def bound_batches(spark: SparkSession) -> None:
    """Send texts to Python in batches of about ``BATCH_MOST``, however long they are, unless the session has a limit of its own.

    Rows alone bound nothing: 10,000 texts are held at once by the executor, which rounds their buffer up to a power of two,
    and twice by its worker. Plans read the limit when they run, so it stays in the session.
    """
    if spark.conf.get(BATCH_BYTES, None) is None:
        spark.conf.set(BATCH_BYTES, BATCH_MOST)


def shared_root(spark: SparkSession) -> str:
    """The folder that the driver and all executors can reach.

    The cluster names it in ``spark.checkpoint.dir``. Only where that setting is missing (unit tests,
    a laptop) a folder of this machine is used, which is right for a single-machine master alone.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    path = Path(tempfile.gettempdir()) / "pagegrain-shared"
    path.mkdir(exist_ok=True)
    return path.as_uri()


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A new, unused folder name under the shared root."""
    return f"{shared_root(spark)}/{purpose}-{uuid.uuid4().hex}"
