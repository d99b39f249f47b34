"""Annotation of a stream of regions against a static segmentation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.annotate import annotate_regions


def annotate_stream(regions: DataFrame, segments: DataFrame, active: tuple[str, ...], out: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Appends annotate_regions of each micro-batch to a Parquet folder; a batch is annotated whole, so no state is kept."""

    def write(batch: DataFrame, batch_id: int) -> None:
        annotate_regions(batch, segments, active).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    stream = regions.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (stream.trigger(availableNow=True) if once else stream).start()
