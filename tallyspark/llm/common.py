"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word of every contract: a run without the six ASCII white-space characters.
SPACE_CLASS = r"[\x20\x09-\x0D]"
WORD_RE = r"[^\x20\x09-\x0D]+"
WHITE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Where that is unset, one of our own if all
    runs on this machine, as in tests; on a cluster an error, as executors wouldn't see each other's files."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = f"file://{tempfile.mkdtemp(prefix='spark-')}"
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def sliced(batches, rows: int = 400):
    """Arrow batches cut small, so that a Python worker holds the results of few long texts at once."""
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)


_SHIPPED: set[str] = set()


def shipped(spark: SparkSession) -> SparkSession:
    """Give the executors' Python workers this package, whatever their PYTHONPATH."""
    sc = spark.sparkContext
    if sc.applicationId not in _SHIPPED:
        _SHIPPED.add(sc.applicationId)
        root = Path(__file__).resolve().parents[1]
        with zipfile.ZipFile(Path(tempfile.mkdtemp(prefix="spark-")) / f"{root.name}.zip", "w") as z:
            for p in sorted(root.rglob("*.py")):
                z.write(p, p.relative_to(root.parent))
        sc.addPyFile(str(z.filename))
    return spark


#: Shuffle files go when the query that made them ends; nothing reads them after its result is a table.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, name: str, *partition_cols: str) -> DataFrame:
    """Cut the lineage: write ``df`` as a table in the shared folder and read it again."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").partitionBy(*partition_cols).parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    found = spark.read.schema(df.schema).parquet(path)
    found.table_path = path
    return found


def dropped(*tables: DataFrame) -> None:
    """Delete tables of ``written`` that nothing reads any more: all that came of them is written itself."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df.table_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def lower_ascii(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def words(c: Column) -> Column:
    """The words of a text, an empty array for null."""
    return F.coalesce(F.array_remove(F.split(c, SPACE_CLASS + "+"), ""), F.array().cast("array<string>"))


#: Bound on the rows of a written table that is broadcast.
BROADCAST_ROWS = 500_000


def bounded(rows: DataFrame) -> DataFrame:
    """A written table of short rows, marked for broadcast only if it has no more than ``BROADCAST_ROWS``."""
    return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows
