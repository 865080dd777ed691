"""A folder that artifacts are dropped in, decoded as they come.

No file stops the stream: an image that does not decode in every table, or a file that cannot be taken
apart, becomes a row with the reason, and nothing of it is among the images."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources import archive
from ..sources.artifact import SCHEMAS, Artifacts, _batch, arrow, cut_file, decoded, rows_of, verified
from ..sources.dex import CorruptImage
from ..sources.schema import arrow_schema

FILE_SCHEMA = "path string, modificationTime timestamp, length long, content binary"
ROWS = f"state string, path string, {SCHEMAS['images']}, reason string"
OK, FAILED = "ok", "failed"


def arrivals(spark: SparkSession, path: str, whole: bool = True) -> DataFrame:
    """ROWS of each new file: its images (rank within the file as image_seq), each ok or failed with a reason.
    whole: an image is ok only if all its tables decode; else its header is enough."""
    files = spark.readStream.format("binaryFile").schema(FILE_SCHEMA).option("recursiveFileLookup", "true").load(path)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, images = arrow_schema(ROWS), arrow("images")
        blank = [None] * (len(images) - 3)
        for b in it:
            for p, content in rows_of(b, "path", "content"):
                for _, k, label, entry, size, deflated, packed, why in cut_file(p, content):
                    if why is None:
                        data = archive.opened(packed, size, deflated)
                        why = verified(data, label, entry) if whole else None
                        try:
                            row = list(decoded("images", k, label, entry, data, images)[0].to_pylist()[0].values()) if why is None else None
                        except CorruptImage as e:
                            why = f"images: {e}"
                    out = (FAILED, p, k, label, entry, *blank, why) if why else (OK, p, *row, None)
                    yield _batch([out], schema, list(range(len(schema))))

    return files.select("path", "content").mapInArrow(run, ROWS)


def image_stream(spark: SparkSession, path: str, whole: bool = True) -> DataFrame:
    """The images table of each new file, of what decodes."""
    return arrivals(spark, path, whole).where(F.col("state") == OK).select(*arrow("images").names)


def ingest(spark: SparkSession, path: str, out: str, checkpoint: str, whole: bool = True) -> StreamingQuery:
    """Append what arrives to Parquet, in one folder for images (state=ok) and one for failures (state=failed):
    both are committed with the batch, so each file is in one of them once."""
    rows = arrivals(spark, path, whole).writeStream.format("parquet").partitionBy("state")
    return rows.option("checkpointLocation", checkpoint).trigger(availableNow=True).start(out)


def ingested(spark: SparkSession, out: str) -> DataFrame:
    """The images so far."""
    return _so_far(spark, out, OK).select(*arrow("images").names)


def failed(spark: SparkSession, out: str) -> DataFrame:
    """path, image_seq, label, entry, reason of what did not decode."""
    return _so_far(spark, out, FAILED).select("path", "image_seq", "label", "entry", "reason")


def _so_far(spark: SparkSession, out: str, state: str) -> DataFrame:
    return spark.read.schema(ROWS).parquet(out).where(F.col("state") == state)


__all__ = ["Artifacts", "arrivals", "failed", "image_stream", "ingest", "ingested"]
