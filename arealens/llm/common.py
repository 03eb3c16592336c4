"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Words of every word-based operator: runs of anything but ASCII white space.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"

_OWN_FOLDER = "arealens.llm.scratch.dir"  # set only where spark.checkpoint.dir is not
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    ``spark.checkpoint.dir`` names it.  Only a session inside one JVM (tests)
    may do without; it gets a folder of its own, noted on the session under a
    key of its own.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get(_OWN_FOLDER, None)
    if folder:
        return folder.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="arealens-llm-")
    spark.conf.set(_OWN_FOLDER, folder)
    return folder


@contextlib.contextmanager
def _shuffle_cleanup(spark: SparkSession):
    """Drop the shuffle files of a query as soon as its table is written."""
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


def written(df: DataFrame, label: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage: later steps survive lost executors without recomputing,
    and the shuffles behind the table are deleted once it is written.  The table
    is deleted when the application ends.
    """
    spark = df.sparkSession
    folder = f"{shared_folder(spark)}/arealens-llm-{spark.sparkContext.applicationId}"
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(at)
    fs.deleteOnExit(at)  # takes note of paths that exist
    path = f"{folder}/{label}-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    with _shuffle_cleanup(spark):
        writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def byte_level_alphabet() -> dict[str, int]:
    """The character that stands for each byte in byte-level vocabularies: printable bytes for themselves,
    the others in turn from code point 256 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


# A table is broadcast only when it was counted and its rows stay under this many bytes.
BROADCAST_BYTES = 24 << 20


def broadcast_if_small(df: DataFrame, rows: int, row_bytes: int) -> DataFrame:
    """Hint a broadcast when the counted size is under ``BROADCAST_BYTES``;
    otherwise the planner shuffles (and splits skewed partitions)."""
    return F.broadcast(df) if rows * row_bytes <= BROADCAST_BYTES else df


def row_keys(docs: DataFrame) -> DataFrame | None:
    """``docs`` with a key ``row`` for each row, written, if doc_ids repeat (null is an id); else None.

    Keys follow doc_id, null first, then text."""
    as_id = F.coalesce(F.col("doc_id").cast("bigint"), F.lit(-2**63))
    counts = docs.agg(F.count("*").alias("rows"), F.count_distinct(as_id).alias("ids")).first()
    if counts["rows"] == counts["ids"]:
        return None
    # the last sort key spreads equal rows over the ranges
    ordered = docs.withColumn("row", F.monotonically_increasing_id()).orderBy(as_id, "text", "row")
    return written(ordered.withColumn("row", F.monotonically_increasing_id()), "row-keys")


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Connected components: (id, component) with the smallest id as component.

    ``edges`` (a, b) are unordered links between ids of ``nodes`` (id).  Each
    round lets every node take the smallest label among itself, its neighbours
    and its label's label, so long chains shrink by pointer jumping.  Rounds
    are written tables; the loop ends when a round changes nothing.  Nodes
    without edges keep their own id and never enter the rounds.
    """
    both = written(
        edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        .where("a <> b").distinct(), "cc-edges")
    labels = written(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("a"), F.min("b")).alias("label")),
                     "cc-labels")
    while True:
        seen = labels.select(F.col("id").alias("b"), F.col("label").alias("label_b"))
        near = both.join(seen, "b").groupBy(F.col("a").alias("id")).agg(F.min("label_b").alias("near"))
        step = labels.join(near, "id").select("id", "label", F.least("label", "near").alias("low"))
        # hand the better label to the old label too, then jump
        handed = step.groupBy(F.col("label").alias("id")).agg(F.min("low").alias("handed"))
        hooked = (step.join(handed, "id", "left")
                  .select("id", "label", F.least("low", "handed").alias("low")))
        jump = hooked.select(F.col("id").alias("low"), F.col("low").alias("far"))
        new = written(hooked.join(jump, "low", "left")
                      .select("id", F.col("label").alias("old"),
                              F.least("low", "far").alias("label")), "cc-labels")
        changed = new.where("label <> old").limit(1).count()
        labels = new.select("id", "label")
        if not changed:
            break
    return nodes.join(labels, "id", "left").select("id", F.coalesce("label", "id").alias("component"))
