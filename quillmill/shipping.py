"""Makes the package importable on executors, wherever the driver was started."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()
#: Rows of a batch that a Python worker holds at once.
BATCH, ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 1000


def ship(spark: SparkSession) -> SparkSession:
    """Sends the package's sources to this application's executors, once, and keeps the batches of Python workers small."""
    if not 0 < int(spark.conf.get(BATCH, "10000")) <= ROWS:  # whole texts and pages travel in them
        spark.conf.set(BATCH, str(ROWS))
    sc = spark.sparkContext
    if sc.applicationId not in _SHIPPED:
        root = Path(__file__).resolve().parent
        path = Path(tempfile.mkdtemp(prefix="quillmill-")) / "quillmill.zip"
        with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
            for f in sorted(root.rglob("*.py")):
                z.write(f, f"{root.name}/{f.relative_to(root)}")
        sc.addPyFile(str(path))
        _SHIPPED.add(sc.applicationId)
    return spark
