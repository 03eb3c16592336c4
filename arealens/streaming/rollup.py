"""Incremental area rollup with Structured Streaming.

Files arrive one (or ``max_files``) per micro-batch; the per-area totals are
kept in the streaming state and the complete table is written after every
batch.  The state holds one row per postal code (bounded by the code domain).
Writing the complete result per batch with ``overwrite`` is idempotent, so a
replayed batch after a failure leaves the same table.
"""

from __future__ import annotations

import uuid
from threading import Event

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from ..functions import scalar as S
from ..operators.area import incident_rollup


def stream_rollup(spark: SparkSession, source: str, schema, out_path: str, checkpoint: str,
                  violent=S.VIOLENT_PATTERN, prop=S.PROPERTY_PATTERN, max_files: int = 1,
                  prepare=None, marks: dict | None = None) -> dict:
    """Run the stream over a folder or a path pattern to completion (available-now trigger).

    Every micro-batch is counted while it is read (``observe``): rows, rows with a valid postal code and,
    with ``marks`` ({name: aggregate over the source's columns}), further values.  Returns the totals
    ``rows_read`` and ``batches``, and ``progress``, a row (dict) for each batch in turn.  The listener waits for
    the stream's end event, which follows the last batch's report."""
    raw = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(source)
    marks = marks or {}
    if marks:
        raw = raw.observe("marks", *[c.alias(n) for n, c in marks.items()])
    src = raw if prepare is None else prepare(raw)
    zip_code = S.standardize_zip(F.col("ZIP_CODE"), src.schema["ZIP_CODE"].dataType)
    src = src.observe("read", F.count(F.lit(1)).alias("rows_read"), F.count(zip_code).alias("rows_with_valid_zip"))
    progress: dict[int, dict] = {}

    class Progress(StreamingQueryListener):
        def onQueryStarted(self, event):
            if event.name == name:
                query_id[0] = event.id

        def onQueryProgress(self, event):
            seen = event.progress.observedMetrics
            if event.progress.id == query_id[0] and "read" in seen and seen["read"]["rows_read"]:
                row = {k: v for part in seen.values() for k, v in part.asDict().items()}
                progress[event.progress.batchId] = {"batch": event.progress.batchId, **row}

        def onQueryIdle(self, event):
            pass

        def onQueryTerminated(self, event):
            if event.id == query_id[0]:
                ended.set()

    name, query_id, ended, listener = f"rollup-{uuid.uuid4().hex}", [None], Event(), Progress()

    def write(batch: DataFrame, batch_id: int):
        batch.write.mode("overwrite").parquet(out_path)

    spark.streams.addListener(listener)
    try:
        q = (incident_rollup(src, violent, prop).writeStream.outputMode("complete").foreachBatch(write)
             .option("checkpointLocation", checkpoint).queryName(name).trigger(availableNow=True).start())
        try:
            q.awaitTermination()
        finally:
            ended.wait()  # the end is reported after failures too
    finally:
        spark.streams.removeListener(listener)
    rows = [progress[b] for b in sorted(progress)]
    return {"batches": len(rows), "rows_read": sum(r["rows_read"] for r in rows), "progress": rows}


def read_rollup(spark: SparkSession, out_path: str) -> DataFrame:
    return spark.read.parquet(out_path)
