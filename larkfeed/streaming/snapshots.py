"""An extension of ours: feed snapshots that arrive as files, each run through the same batch plan."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def on_snapshots(spark: SparkSession, folder: str, schema: StructType | str, checkpoint: str, run: Callable[[DataFrame], object]) -> StreamingQuery:
    """Call `run` with each new file of `folder`; a file that has been committed isn't run again."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
    return stream.writeStream.foreachBatch(lambda df, _: run(df) and None).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
