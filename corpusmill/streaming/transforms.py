"""The stateless transforms on streams: new text rows are cleaned as they arrive."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..plans.pipelines import text_pipeline


def read_segments(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def checkpoint_of(spark: SparkSession, out: str) -> str:
    """The checkpoint folder of the stream into ``out``, in the shared folder by a digest of
    ``out``; an error without ``spark.checkpoint.dir``, as a temporary folder would not outlive the process."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        raise ValueError("a stream needs a checkpoint folder or spark.checkpoint.dir")
    return f"{base.rstrip('/')}/stream-{hashlib.sha256(out.rstrip('/').encode()).hexdigest()[:32]}"


def clean_stream(segments: DataFrame, out: str, checkpoint: str | None = None, **options) -> StreamingQuery:
    """Runs the text pipeline over what has arrived into a parquet folder, each row once: a
    restarted process finds the checkpoint of the one before it and goes on where that stopped."""
    d = text_pipeline(segments, **options)
    where = checkpoint or checkpoint_of(segments.sparkSession, out)
    return d.writeStream.format("parquet").option("path", out).option("checkpointLocation", where).trigger(availableNow=True).start()
