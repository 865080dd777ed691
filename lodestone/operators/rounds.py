"""Iteration: what one round hands to the next is written once and read again."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_WRITTEN: dict[str, SparkSession] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; one of our own only where none is set and all is one machine."""
    if path := spark.conf.get("spark.checkpoint.dir", None):
        return path
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="lodestone-"))
    return sc.getCheckpointDir()


def settled(rows: DataFrame) -> DataFrame:
    """rows from a Parquet table of their own: their lineage ends here, and no round is computed twice.
    The table stays until it is forgotten, or the program ends."""
    spark = rows.sparkSession
    path = f"{shared_folder(spark)}/round-{uuid.uuid4().hex}"
    _WRITTEN[path] = spark
    rows.write.parquet(path)
    out = spark.read.schema(rows.schema).parquet(path)
    out._round_path = path
    return out


def forget(*frames: DataFrame | None) -> None:
    """Delete the tables of settled frames that nothing reads any more."""
    for df in frames:
        if path := getattr(df, "_round_path", None):
            df._round_path = None
            _delete(path, _WRITTEN.pop(path, df.sparkSession))


def _delete(path: str, spark: SparkSession) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


@atexit.register
def sweep() -> None:
    """What lazy results still read goes when the program ends, as far as its session still runs."""
    for path, spark in list(_WRITTEN.items()):
        with contextlib.suppress(Exception):
            if spark.sparkContext._jsc is not None and not spark.sparkContext._jsc.sc().isStopped():
                _delete(path, spark)
        _WRITTEN.pop(path, None)
