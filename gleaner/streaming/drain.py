"""Runs a stream over what is there now, or over parts that arrive one after the other, and gives its result as a table."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame

from gleaner.storage import shared_folder
from gleaner.streaming.detectors import rocks


def drained(stream: DataFrame, name: str, mode: str) -> DataFrame:
    """What a stream has emitted at its end ("append"), or its last result ("complete"), written to the shared folder.

    A batch that is run again after a failure writes over its own rows.
    """
    spark = stream.sparkSession
    base = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/out/batch={number if mode == 'append' else 0}")

    with rocks(spark):
        query = stream.writeStream.foreachBatch(keep).outputMode(mode).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
        query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out").select(*stream.columns)


def drained_in_parts(parts: list[DataFrame], make: Callable[[DataFrame], DataFrame], name: str) -> DataFrame:
    """What the stream that make() builds over arriving rows has emitted after all parts (of one schema) came.

    Each part is written into the folder that the stream reads, and the stream
    is started again for it: one micro-batch for each part, and a restart
    between them.
    """
    spark = parts[0].sparkSession
    base = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/out/batch={number}")

    with rocks(spark):
        for part in parts:
            part.write.mode("append").parquet(f"{base}/in")
            stream = make(spark.readStream.schema(part.schema).parquet(f"{base}/in"))
            query = stream.writeStream.foreachBatch(keep).outputMode("append").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
            query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out").select(*stream.columns)
