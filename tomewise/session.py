"""Session settings, and the shared folder that lineage is cut into."""

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.serializer": "org.apache.spark.serializer.KryoSerializer",
}


def local_session(cores: int | str = "*", memory: str = "8g", **extra: str) -> SparkSession:
    """A session for tests and benchmarks. On a cluster pass SETTINGS to spark-submit."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("tomewise")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


# Folders made since the innermost open ``scratch``, if any.
_MADE: ContextVar[list[str] | None] = ContextVar("made", default=None)


def shared_dir(spark: SparkSession) -> str:
    """This application's part of the folder that ``spark.checkpoint.dir`` names.

    Every executor has to reach that folder. Only a local session, where driver and executors
    share one disk, may go without it. It can be deleted once the application has ended.
    """
    context = spark.sparkContext
    if not context.getCheckpointDir():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="tomewise-"))
    return context.getCheckpointDir()


def fresh_dir(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if (made := _MADE.get()) is not None:
        made.append(path)
    return path


def delete(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Delete at the end what ``fresh_dir`` and ``cut`` made inside. Results have to be written
    elsewhere by then, since DataFrames over the deleted tables cannot be read any more."""
    made: list[str] = []
    before = _MADE.set(made)
    try:
        yield
    finally:
        _MADE.reset(before)
        for path in made:
            delete(spark, path)


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    What follows neither repeats nor loses the work before it when executors are lost, and
    unlike a checkpoint it reads only the columns it needs and knows how large the table is.
    """
    path = fresh_dir(df.sparkSession, "cut")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
