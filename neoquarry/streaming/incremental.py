"""New input files are picked up as they arrive; a restart goes on behind the last committed file.

Only row-wise stages and joins with fixed tables run this way. Ranks and percentiles describe a whole set and
stay batch.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery


def run_stage(
    spark: SparkSession, source: str, ddl: str, stage: Callable[[DataFrame], DataFrame], target: str, checkpoint: str,
    max_files: int | None = None, available_now: bool = True,
) -> StreamingQuery:
    """Stream tab-separated files through a stage into Parquet, exactly once per input file."""
    reader = spark.readStream.schema(ddl).option("sep", "\t").option("header", True)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    writer = stage(reader.csv(source)).writeStream.format("parquet").outputMode("append")
    writer = writer.option("checkpointLocation", checkpoint).option("path", target)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
