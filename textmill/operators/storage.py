"""Tables that cut lineage: written to the folder that spark.checkpoint.dir names, so that they outlive executors."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_made: list[tuple[SparkSession, str]] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where it is unset: a temporary one if all of Spark is in this process, else one in the warehouse."""
    base = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.master.startswith("local") and not spark.sparkContext.master.startswith("local-cluster"):
            base = tempfile.mkdtemp(prefix="textmill-")
            atexit.register(shutil.rmtree, base, True)
        else:
            base = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/textmill"
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def shared_dir(spark: SparkSession, tag: str) -> str:
    """A new path in the shared folder, which goes at the end of the driver."""
    path = f"{shared_folder(spark)}/textmill-{tag}-{uuid.uuid4().hex[:12]}"
    if not _made:
        atexit.register(_clear)
    _made.append((spark, path))
    return path


def _clear() -> None:
    for spark, path in _made:
        with contextlib.suppress(Exception):  # the gateway may be gone
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def stored(df: DataFrame, tag: str, partition_by: list[str] | None = None) -> DataFrame:
    """Writes df and returns the table as read back: lineage ends here, and the files outlive any executor."""
    path, w = shared_dir(df.sparkSession, tag), df.write.mode("overwrite")
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)
    schema = df.schema
    for f in schema.fields:
        f.nullable = True
    return df.sparkSession.read.schema(schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def join_unique(left: DataFrame, right: DataFrame, key: str | list[str], weight: str, n: int | None = None) -> DataFrame:
    """The inner join of two stored tables on a key that right has once, with the number of left's rows in the column weight; n: left's rows, about.

    Keys with more rows than a task's share are joined by broadcast; as their rows add up to left's, they are at most four for each
    shuffle partition. All others are shuffled.
    """
    keys = [key] if isinstance(key, str) else key
    share = max(1000, (left.count() if n is None else n) // (4 * partitions(left.sparkSession)))
    heavy = F.broadcast(right.filter(F.col(weight) > share))
    rest = left.join(heavy.select(*keys), keys, "left_anti").join(right.filter(F.col(weight) <= share), keys)
    return left.join(heavy, keys).unionByName(rest)
