"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Size up to which a table is broadcast in a join, on disk or in rows; larger ones are joined by a shuffle.
BROADCAST_BYTES, BROADCAST_ROWS = 8 << 20, 200_000
#: Rows that a task groups where there are almost as many keys as rows: from so many on tables are dealt to more tasks, and to no fewer than for so many.
TASK_ROWS, MOST_TASK_ROWS = 500_000, 2_000_000


def scratch_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Without one it is an error: no other is known to be shared."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named and spark.sparkContext.master.startswith("local["):
        named = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/scratch"  # one machine: any folder is shared
    if not named:
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return named


def materialize(df: DataFrame, parts: int | None = None) -> DataFrame:
    """Write df to the shared folder and read it back, so that lost executors cost no recomputation.

    parts bounds the number of tasks and files of a table that is known to be small for its input.
    """
    spark = df.sparkSession
    df = df if parts is None else df.coalesce(parts)
    path = f"{scratch_dir(spark).rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder or file of any store that Spark can reach."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def release(*tables: DataFrame) -> None:
    """Delete tables that materialize() wrote, once nothing that is still to run reads them."""
    for df in tables:
        path = getattr(df, "_scratch_path", None)
        if path:
            remove(df.sparkSession, path)


class Tables:
    """Tables that a job writes on its way; all but those it returns are deleted when it is done."""

    def __init__(self) -> None:
        self.held: list[DataFrame] = []

    def keep(self, df: DataFrame, parts: int | None = None) -> DataFrame:
        self.held.append(materialize(df, parts))
        return self.held[-1]

    def drop(self, *tables: DataFrame) -> None:
        """Delete some of them before the others."""
        release(*tables)
        self.held = [t for t in self.held if not any(t is x for x in tables)]

    def close(self, *but: DataFrame) -> None:
        self.drop(*[t for t in self.held if not any(t is x for x in but)])


def small(df: DataFrame, of: DataFrame | None = None) -> DataFrame:
    """df as a broadcast side if it is measured to be small; else as it is, for a join by shuffle.

    of is the written table that df takes rows and columns of (df itself, if it is one): its bytes
    on disk decide, at most BROADCAST_BYTES. Anything else is counted, at most BROADCAST_ROWS. A join
    of two written tables has both shuffles right below it, so that adaptive execution can split
    hot keys.
    """
    path = getattr(df if of is None else of, "_scratch_path", None)
    if not path:
        return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df
    at = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
    size = at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).getContentSummary(at).getLength()
    return F.broadcast(df) if size <= BROADCAST_BYTES else df


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """df dealt out by keys to a task for every TASK_ROWS rows, spark.sql.shuffle.partitions at least.

    For keys that are nearly unique: a grouping by them after this holds no more in a task as the table
    grows, and none in the tasks that scan, where there is next to nothing to put together. These write
    up to bypassMergeThreshold parts without holding rows, so there are more only beyond MOST_TASK_ROWS.
    """
    conf, rows = df.sparkSession.sparkContext.getConf(), df.count()
    unheld = int(conf.get("spark.shuffle.sort.bypassMergeThreshold", "200"))
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(least, min(unheld, -(-rows // TASK_ROWS)), -(-rows // MOST_TASK_ROWS)), *keys)
