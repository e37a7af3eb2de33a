"""Session settings, the shared work folder and lineage cuts."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

RECOMMENDED_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # Split hot join keys even where that costs one more exchange downstream.
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # Raw input is many small JSON files: pack more of them into one task.
    "spark.sql.files.openCostInBytes": str(1 << 20),
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(master: str, app_name: str = "palaver", **conf: str) -> SparkSession:
    builder = SparkSession.builder.master(master).appName(app_name)
    for key, value in {**RECOMMENDED_CONF, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def work_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, taken from ``spark.checkpoint.dir``.

    A temporary folder is made only for a local session that names none.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        base = tempfile.mkdtemp(prefix="palaver-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/palaver/{spark.sparkContext.applicationId}"


#: Shuffle files go when the query that wrote them ends, not when the driver next collects its garbage.
_DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def _shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    before = spark.conf.get(_DROP_SHUFFLES)
    spark.conf.set(_DROP_SHUFFLES, "true")
    try:
        yield
    finally:
        spark.conf.set(_DROP_SHUFFLES, before)


def stage(df: DataFrame, name: str = "stage", partition_by: tuple[str, ...] = (), **options: str) -> DataFrame:
    """Write ``df`` to the work folder and read it back.

    Cuts the lineage, survives lost executors, and keeps column pruning and filter
    pushdown for whatever reads the result. What was shuffled on the way is dropped: nothing reads it again.
    """
    path = f"{work_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    with _shuffles_dropped(df.sparkSession):
        df.write.options(**options).partitionBy(*partition_by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def one_row(df: DataFrame) -> Column:
    """The single row of a global aggregate as a struct-valued scalar subquery."""
    return df.select(F.struct("*")).scalar()
