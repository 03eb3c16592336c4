"""Session factory and the shared scratch location.

On a cluster the session is created by the platform and ``spark.checkpoint.dir``
names a shared folder; we only read it.  Tests and local runs have no such
setting, so ``shared_dir`` creates one under the system temp folder and
notes it on the session under a key of its own.  What is written
under ``scratch_path`` is deleted when the application ends.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

OWN_FOLDER = "arealens.scratch.dir"  # set only where spark.checkpoint.dir is not

# The JVM runs a method of more bytes than this uncompiled, many times slower; a projection of some dozen columns in
# one generated method is longer.  Beyond it Spark evaluates the columns in several methods.
METHOD_LIMIT = ("spark.sql.codegen.hugeMethodLimit", "8000")

# Settings that matter for correctness or scale, applied to every session we build.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    METHOD_LIMIT[0]: METHOD_LIMIT[1],
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_spark(master: str | None = None, shuffle_partitions: int = 8,
              app_name: str = "arealens", extra: dict | None = None) -> SparkSession:
    master = master or os.environ.get("AREALENS_MASTER", "local[8]")
    builder = SparkSession.builder.master(master).appName(app_name)
    conf = dict(DEFAULT_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.setdefault("spark.driver.memory", "8g")
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def bound_methods(spark: SparkSession) -> None:
    """Sets the limit on generated methods in a session that others have built, for plans made from now on."""
    spark.conf.set(*METHOD_LIMIT)


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can read, as ``spark.checkpoint.dir`` names it.
    Only a session inside one JVM may do without; it gets a folder of its own."""
    current = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get(OWN_FOLDER, None)
    if not current:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        current = tempfile.mkdtemp(prefix="arealens-ckpt-")
        spark.conf.set(OWN_FOLDER, current)
    return current.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path for one written table, in a sub-folder of the shared folder that is deleted at the
    application's end."""
    sc = spark.sparkContext
    folder = f"{shared_dir(spark)}/arealens-{sc.applicationId}"
    path = sc._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(sc._jsc.hadoopConfiguration())
    fs.mkdirs(path)
    fs.deleteOnExit(path)  # takes note of paths that exist
    return f"{folder}/{name}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written under ``scratch_path`` and read again: what several passes read is derived once."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
