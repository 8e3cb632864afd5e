"""Session creation and the shared-folder helpers that every long job uses.

Intermediate results that are read more than once are written to the folder named by
``spark.checkpoint.dir``.  All executors share it, so losing one costs nothing but the running tasks.
"""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Largest number of bytes that a side of a join may have to be broadcast (after its size was checked).
BROADCAST_BYTES = 32 << 20

_made: list[tuple[SparkSession, str]] = []


def build_session(app: str = "cellwright", cores: int | str = "*", **conf: str) -> SparkSession:
    """A local session with the settings that the tests and the benchmark use; on a cluster use your own."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.shuffle.partitions": "8",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g",
    }
    for key, value in (defaults | {k.replace("__", "."): v for k, v in conf.items()}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; only a local master without the setting gets a temporary one."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    for owner, path in _made:
        if owner is spark and path.startswith("file:///") and os.path.isdir(path[7:]):
            return path
    path = "file://" + tempfile.mkdtemp(prefix="cellwright-")
    _made.append((spark, path))
    atexit.register(_remove, path[7:])
    return path


def _remove(path: str) -> None:
    import shutil

    shutil.rmtree(path, ignore_errors=True)


def staged(df: DataFrame) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/cellwright-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_forget, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder's path in the shared folder, of this session alone; it is deleted when the session's program ends."""
    path = f"{shared_dir(spark)}/cellwright-{name}-{uuid.uuid4().hex}"
    atexit.register(_forget, spark, path)
    return path


class Grown:
    """A frame that grows by what is added to it, kept as Parquet in the shared folder: one folder, however many parts."""

    def __init__(self, first: DataFrame):
        self.spark, self.schema = first.sparkSession, first.schema
        self.path = f"{shared_dir(self.spark)}/cellwright-{uuid.uuid4().hex}"
        atexit.register(_forget, self.spark, self.path)
        self.frame = self.add(first)

    def add(self, more: DataFrame) -> DataFrame:
        """Everything added so far with ``more``, which is computed once."""
        more.write.mode("append").parquet(self.path)
        self.frame = self.spark.read.schema(self.schema).parquet(self.path)
        return self.frame


def release(df: DataFrame) -> None:
    """Deletes what :func:`staged` wrote for ``df``; a frame that reads it still must not be used any more."""
    for path in df.inputFiles():
        folder = path.rpartition("/")[0]
        if folder.rpartition("/")[2].startswith("cellwright-"):
            _forget(df.sparkSession, folder)
            return


def _forget(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session has ended; the folder's owner clears it
        pass


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship_package(spark: SparkSession) -> None:
    """Makes the package importable in Python workers, whatever folder or path the driver was started with.

    Workers on this machine get its folder in their path; those of a cluster also get the package itself, once.
    """
    sc = spark.sparkContext
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    have = sc.environment.get("PYTHONPATH", "")
    if root not in have.split(os.pathsep):
        sc.environment["PYTHONPATH"] = os.pathsep.join(x for x in (root, have) if x)
        if not sc.master.startswith("local"):
            import shutil

            folder = tempfile.mkdtemp(prefix="cellwright-package-")
            atexit.register(_remove, folder)
            sc.addPyFile(shutil.make_archive(os.path.join(folder, "cellwright"), "zip", root, "cellwright"))
