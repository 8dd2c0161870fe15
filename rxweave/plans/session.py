"""Session defaults, the checkpoint folder and size-checked broadcasts."""

from __future__ import annotations

import atexit
import gc
import os
import shutil
import site
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A local session for tests and the bench; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("rxweave")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Gives the executors' Python this package, where it isn't installed or on ``PYTHONPATH``; once per application."""
    sc = spark.sparkContext
    root = Path(__file__).resolve().parents[2]
    known = [*os.environ.get("PYTHONPATH", "").split(os.pathsep), *site.getsitepackages()]
    if sc.applicationId in _SHIPPED or str(root) in {str(Path(p).resolve()) for p in known if p}:
        return
    _SHIPPED.add(sc.applicationId)
    # the driver's own file, which it serves to the executors until it ends; no task reads or writes there
    folder = tempfile.mkdtemp(prefix="rxweave-package-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    with zipfile.PyZipFile(f"{folder}/rxweave.zip", "w") as packed:
        packed.writepy(str(root / "rxweave"))
    sc.addPyFile(f"{folder}/rxweave.zip")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder: ``spark.checkpoint.dir`` where it is set.

    Only a local master, where driver and executors are one process, may fall back to a
    temporary folder; on a cluster a missing setting is an error, because a machine-local
    folder would be lost with its machine.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    wanted = sc.getConf().get("spark.checkpoint.dir")
    if not wanted:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        wanted = tempfile.mkdtemp(prefix="rxweave-checkpoint-")
    sc.setCheckpointDir(wanted)
    return wanted


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage through the shared folder; survives the loss of executors."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def semi_join_checked(big: DataFrame, keys: DataFrame, on: list[str], limit_rows: int = 2_000_000) -> DataFrame:
    """Rows of ``big`` whose key is in ``keys``: by broadcast up to ``limit_rows`` keys, else by a shuffled semi join.

    ``keys`` should be cheap to read again (a checkpoint), as its rows are counted first.
    """
    small = keys.select(*on).distinct()
    if keys.limit(limit_rows + 1).count() <= limit_rows:
        small = F.broadcast(small)
    else:
        small = small.hint("merge")
    return big.join(small, on, "left_semi")


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` over as many partitions as a shuffle has: small rows before costly Python, which would else be one task."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def literal_rows(spark: SparkSession, **columns: list) -> DataFrame:
    """A small table of literals, column by column: one partition, no Python behind it."""
    rows = [F.struct(*(F.lit(v).alias(n) for n, v in zip(columns, row))) for row in zip(*columns.values())]
    return spark.range(1, numPartitions=1).select(F.inline(F.array(*rows)))


_WRITTEN: list[tuple[SparkSession, str]] = []


def materialised(df: DataFrame) -> DataFrame:
    """``df`` written once as parquet to a fresh folder in the shared checkpoint folder, and read from there.

    Like a checkpoint it cuts the lineage and outlives executors; unlike one it is compressed, column-pruned when
    read again, and gives the planner true sizes. The folders are removed by ``release``, or when Python ends.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/written-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _WRITTEN.append((spark, path))
    made = spark.read.schema(df.schema).parquet(path)
    made._written_to = path
    return made


def discard(made: DataFrame) -> None:
    """Removes one table of ``materialised``, the DataFrame itself, that nothing will read again."""
    path = getattr(made, "_written_to", None)
    _remove([entry for entry in _WRITTEN if entry[1] == path])


def sweep(spark: SparkSession) -> None:
    """Lets Spark remove the shuffle files of queries that have ended, which else stay until the driver happens to collect
    its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def release() -> None:
    """Removes all intermediate tables written so far; call it once the results that rest on them have been read."""
    _remove(list(_WRITTEN))


def _remove(entries: list[tuple[SparkSession, str]]) -> None:
    _WRITTEN[:] = [entry for entry in _WRITTEN if entry not in entries]
    for spark, path in entries:
        try:
            jvm = spark.sparkContext._jvm
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
        except Exception:  # the session may be gone
            pass


atexit.register(release)
