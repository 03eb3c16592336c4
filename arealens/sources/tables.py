"""Parquet/CSV sources, source fallback, schema repair and table sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table_path(sf_dir: str, name: str) -> str:
    return f"{sf_dir.rstrip('/')}/{name}.parquet"


def load_table(spark: SparkSession, sf_dir: str, name: str, columns=None) -> DataFrame:
    """Parquet scan; selecting ``columns`` here lets Catalyst prune the read schema."""
    df = spark.read.parquet(table_path(sf_dir, name))
    return df.select(*columns) if columns else df


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return bool(fs.exists(p))


def resolve_source(spark: SparkSession, candidates) -> str:
    """First existing path of ``candidates`` (checked at plan-build time)."""
    for path in candidates:
        if _exists(spark, path):
            return path
    raise FileNotFoundError(f"none of the candidate sources exist: {list(candidates)}")


def read_csv_text(spark: SparkSession, path: str) -> DataFrame:
    """CSV with a header, every column read as text (typed later, once).

    Spark strips a UTF-8 byte-order mark itself; header names are trimmed."""
    df = spark.read.option("header", True).option("inferSchema", False).csv(path)
    return strip_header(df)


CORRUPT = "_corrupt_record"


def read_csv_audited(spark: SparkSession, path: str, columns, header: bool = True, line_breaks: bool = True) -> DataFrame:
    """CSV of text columns with ``record_state`` for each record: 'ok', 'short' or 'long' (fewer or more fields than
    ``columns``).  Short records have NULL in the missing fields, long ones lose the surplus; ``_corrupt_record`` has
    the text of both.  An empty field is NULL.  With ``line_breaks`` quoted fields may hold
    line breaks; each file is then one task."""
    schema = ", ".join([*[f"`{c}` string" for c in columns], f"{CORRUPT} string"])
    raw = (spark.read.schema(schema).option("header", header).option("multiLine", line_breaks).option("mode", "PERMISSIVE")
           .option("columnNameOfCorruptRecord", CORRUPT)
           .option("escape", '"').csv(path))
    bare = F.regexp_replace(CORRUPT, r'"([^"]|"")*"', "")  # without what is quoted
    fields = F.length(bare) - F.length(F.replace(bare, F.lit(","), F.lit(""))) + 1
    state = F.when(F.col(CORRUPT).isNull(), "ok").when(fields < len(columns), "short").otherwise("long")
    return raw.withColumn("record_state", state)


def csv_counters(audited: DataFrame) -> DataFrame:
    """Records by state, and how many hold a line break within a field."""
    fields = [F.col(f"`{c}`") for c in audited.columns if c not in (CORRUPT, "record_state")]
    broken = F.lit(False)
    for f in fields:
        broken = broken | F.coalesce(f.contains("\n"), F.lit(False))
    state = lambda s: F.count_if(F.col("record_state") == s)
    return audited.agg(F.count(F.lit(1)).alias("records"), state("ok").alias("complete"), state("short").alias("short"),
                       state("long").alias("long"), F.count_if(broken).alias("with_line_break"))


def strip_header(df: DataFrame) -> DataFrame:
    names = [c.strip() for c in df.columns]
    return df.toDF(*names) if names != df.columns else df


def rename_aliases(df: DataFrame, mapping: dict) -> DataFrame:
    """Rename variant -> canonical for every variant present."""
    present = {k: v for k, v in mapping.items() if k in df.columns}
    return df.withColumnsRenamed(present) if present else df


def harmonise(df: DataFrame, mapping: dict) -> DataFrame:
    """Rename variant -> canonical only when the canonical name is absent."""
    present = {k: v for k, v in mapping.items() if k in df.columns and v not in df.columns}
    return df.withColumnsRenamed(present) if present else df


def first_existing(df: DataFrame, candidates):
    """The first candidate that is a column, or None."""
    return next((c for c in candidates if c in df.columns), None)


def require_columns(df: DataFrame, needed, what: str = "input") -> DataFrame:
    missing = [c for c in needed if c not in df.columns]
    if missing:
        raise ValueError(f"missing expected {what} columns: {missing}")
    return df


def write_table(df: DataFrame, path: str, fmt: str = "parquet") -> str:
    """Table sink. CSV keeps a header and no index, like the reference outputs."""
    w = df.write.mode("overwrite")
    if fmt == "csv":
        w.option("header", True).csv(path)
    else:
        w.format(fmt).save(path)
    return path
