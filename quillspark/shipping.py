"""Sends this package to the executors of a session whose workers cannot import it by themselves."""

from __future__ import annotations

import os
import tempfile
import zipfile
from functools import wraps

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Add the package to the context's Python files, once for each context."""
    context = spark.sparkContext
    if getattr(context, "_quillspark_shipped", False):
        return
    here = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="spark-package-"), "quillspark.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(here):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(here)))
    context.addPyFile(path)
    context._quillspark_shipped = True


#: Bytes of an Arrow batch, so that a batch of long texts is as large as one of short ones.
BATCH = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20


def bound_batches(spark: SparkSession) -> None:
    """Bound Arrow batches by bytes, if the session does not bound them closer itself."""
    if int(spark.conf.get(BATCH[0], str(2**31 - 1)).removesuffix("b")) > BATCH[1]:
        spark.conf.set(*BATCH)


def shipped(query):
    """The query, with the package sent ahead and Arrow batches bounded; spark is its first argument."""

    @wraps(query)
    def run(spark, *args, **named):
        ship(spark)
        bound_batches(spark)
        return query(spark, *args, **named)

    return run
