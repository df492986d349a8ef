"""Tables that later jobs read again: written to the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Used in local mode when the session names no folder.
LOCAL_FOLDER = "/tmp/checkpoints"
#: A side of a join is broadcast up to this many rows of fixed width; beyond it the join shuffles.
BROADCAST_ROWS = 1_000_000
#: Rows and bytes of an Arrow batch.
BATCH_ROWS, BATCH_BYTES = 1000, "4m"
_BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def shared_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; where it is unset, a local folder, in local mode only."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"file://{LOCAL_FOLDER}"


def saved(df: DataFrame, name: str) -> DataFrame:
    """``df``, computed once and written as Parquet; later reads need none of its lineage."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/accordant/{uuid.uuid4().hex}-{name}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._saved_at = path
    return out


def dropped(df: DataFrame) -> None:
    """Deletes what ``saved`` wrote, when nothing reads it any more."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df._saved_at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def ship(spark: SparkSession) -> None:
    """Sends this package to the Python workers once a session, for sessions whose workers can't import it.

    Arrow batches of whole texts are kept small as well: ten thousand long rows a batch, Spark's default, cost hundreds
    of MB on either side of the pipe. A number that the session sets itself stays.
    """
    for name, most in ((_BATCH, str(BATCH_ROWS)), (_BATCH_BYTES, BATCH_BYTES)):
        if spark.conf.get(name, None) is None:
            spark.conf.set(name, most)
    sc = spark.sparkContext
    if getattr(sc, "_accordant_shipped", False):
        return
    root = Path(__file__).resolve().parents[1]
    archive = Path(tempfile.mkdtemp(prefix="accordant-")) / f"{root.name}.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for p in sorted(root.rglob("*.py")):
            out.write(p, p.relative_to(root.parent))
    sc.addPyFile(str(archive))
    sc._accordant_shipped = True
