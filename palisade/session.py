"""Sessions with the settings that the library's plans expect."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = "*", memory: str = "8g", name: str = "palisade") -> SparkSession:
    """A session for one machine. On a cluster, use the cluster's own session: no plan needs these settings."""
    cores = os.cpu_count() if cpus == "*" else int(cpus)
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only a local master may go without (tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='palisade-')}"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def shared_checkpoints(spark: SparkSession) -> None:
    """Checkpoints go to the shared folder."""
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_dir(spark))


#: The folders of the staged frames that are still referred to.
_FOLDERS: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write a frame as Parquet in the shared folder and read it back: cuts lineage and survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    _FOLDERS[back] = path
    return back


def discard(*frames: DataFrame) -> None:
    """Delete the folders of staged frames that nothing will read again."""
    for df in frames:
        path = _FOLDERS.pop(df, None)
        if path:
            folder = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(folder, True)


#: What one Arrow batch of texts holds at most: rows, and bytes before the row that goes beyond.
BATCH_ROWS, BATCH_BYTES = 256, 4 << 20
_BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": BATCH_ROWS, "spark.sql.execution.arrow.maxBytesPerBatch": BATCH_BYTES}


def small_batches(spark: SparkSession) -> None:
    """Texts are long: a Python worker gets few of them at once, however large its task, so that its memory doesn't grow with the input."""
    for name, most in _BATCH.items():
        number, unit = re.fullmatch(r"(-?\d+)([kmgtp]?)b?", spark.conf.get(name).strip().lower()).groups()
        now = int(number) * 1024 ** " kmgtp".index(unit or " ")
        if now <= 0 or now > most:
            spark.conf.set(name, str(most))


def spread(df: DataFrame) -> DataFrame:
    """Rows dealt to all cores where the input has fewer partitions than cores (one small file); else as they are.

    For work that costs far more a row than moving the row does. A large input has more partitions than cores, and
    isn't shuffled.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
