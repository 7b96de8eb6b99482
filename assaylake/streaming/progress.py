"""Progress of exams: from a table, and from a stream with one row of state per exam."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import shared_dir

#: Per cent done after a stage.
STAGES = {"signup": 10, "view": 40, "click": 60, "purchase": 100}


def percent(stage: Column) -> Column:
    out = F.lit(0)
    for name, value in STAGES.items():
        out = F.when(stage == name, value).otherwise(out)
    return out.cast("bigint")


def latest_stage(events: DataFrame) -> DataFrame:
    """events(exam_id, stage, ts, event_id) -> each exam's latest stage; works on tables and streams alike."""
    last = events.groupBy("exam_id").agg(F.max(F.struct("ts", "event_id", "stage")).alias("m"))
    return last.select("exam_id", F.col("m.stage").alias("stage"), percent(F.col("m.stage")).alias("percent"))


def windowed_counts(events: DataFrame, late: str = "1 hour", size: str = "1 day") -> DataFrame:
    """Events by stage and time window; rows later than `late` are dropped with their windows' state."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", size), "stage").count()


def run_to_end(spark: SparkSession, path: str, folder: str | None = None) -> DataFrame:
    """Reads the events at the path as a stream, in bounded batches, and returns the latest stages.

    State, progress and what each batch changed are kept in the folder (default: a new one in the shared folder).
    Given the folder of a run that was cut short, it goes on where that was; given that of a finished one, it
    takes up only new files.
    """
    schema = spark.read.parquet(path).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 100).parquet(path if not path.endswith(".parquet") else path + "*")
    events = stream.select(F.col("user_id").alias("exam_id"), F.col("event_type").alias("stage"), "ts", "event_id")
    folder = folder or f"{shared_dir(spark)}/progress-{uuid.uuid4().hex}"

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/changes/batch={number}")

    latest_stage(events).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    changes = spark.read.parquet(f"{folder}/changes")
    last = changes.groupBy("exam_id").agg(F.max_by(F.struct("stage", "percent"), "batch").alias("m"))
    return last.select("exam_id", "m.stage", "m.percent")
