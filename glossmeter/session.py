"""Getting the package to the Python workers."""

from __future__ import annotations

import os
import shutil
import tempfile

from pyspark.sql import SparkSession

_shipped: set[str] = set()

#: Rows of an Arrow batch; a batch of whole texts is held by the JVM and by its Python worker at once.
BATCH, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", "2000"


def ship(spark: SparkSession) -> SparkSession:
    """Send this package to the executors, once per application.

    Batch functions import it there. The same as submitting with ``--py-files``; harmless
    where the package is installed anyway. Arrow batches get BATCH_ROWS rows unless the
    session's settings name a number.
    """
    context = spark.sparkContext
    if context.getConf().get(BATCH) is None:
        spark.conf.set(BATCH, BATCH_ROWS)
    if context.applicationId not in _shipped:
        package = os.path.dirname(os.path.abspath(__file__))
        target = os.path.join(tempfile.mkdtemp(prefix="glossmeter-ship-"), "glossmeter")
        archive = shutil.make_archive(target, "zip", os.path.dirname(package), os.path.basename(package))
        context.addPyFile(archive)
        _shipped.add(context.applicationId)
    return spark
