"""Make this package importable in the executors' Python workers, and bound what they are sent at once."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()

#: Arrow batches of texts are bounded by bytes, and by fewer rows than Spark's default of 10,000, since a row may be
#: a long text. A session that sets these itself keeps its own values.
ARROW = {"spark.sql.execution.arrow.maxRecordsPerBatch": "2000", "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20)}


def bound_batches(spark: SparkSession) -> None:
    stated = spark.conf.getAll
    for name, value in ARROW.items():
        if name not in stated:
            spark.conf.set(name, value)


def ship_package(spark: SparkSession) -> None:
    """Send the package's source to the executors, once for each application, and bound the Arrow batches."""
    bound_batches(spark)
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    root = Path(__file__).parent
    target = Path(tempfile.mkdtemp(prefix="outcomelake-src-")) / "outcomelake.zip"
    with zipfile.ZipFile(target, "w") as bundle:
        for source in sorted(root.rglob("*.py")):
            bundle.write(source, source.relative_to(root.parent))
    context.addPyFile(str(target))
    _shipped.add(context.applicationId)
