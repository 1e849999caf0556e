"""Session defaults and the reliable-checkpoint helper."""
from __future__ import annotations

import os
import tempfile
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "matchlake", master: str | None = None, **conf) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        "spark.ui.enabled": "false",
    }
    for key, value in {**defaults, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the folder the session names.

    Only a session without ``spark.checkpoint.dir`` in local mode (tests) gets a folder here;
    on a cluster a missing setting is an error, because a machine-local folder would not
    survive the loss of an executor.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named:
            if not sc.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
            named = tempfile.mkdtemp(prefix="matchlake-checkpoint-", dir=os.environ.get("TMPDIR"))
        sc.setCheckpointDir(named)
    return df.checkpoint(eager=True)


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared one the session names (a temporary one only in local mode)."""
    import uuid

    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        named = tempfile.mkdtemp(prefix="matchlake-", dir=os.environ.get("TMPDIR"))
    return f"{named.rstrip('/')}/{name}-{uuid.uuid4().hex}"


@contextmanager
def settings(spark: SparkSession, **conf):
    """Settings (dots as ``__``) that hold inside the block only."""
    named = {key.replace("__", "."): value for key, value in conf.items()}
    before = {key: spark.conf.get(key, None) for key in named}
    for key, value in named.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def many_files(spark: SparkSession) -> dict[str, str]:
    """Settings for folders of very many small files: by default every path becomes a task when they are listed, and every four or so
    when they are read."""
    return {"spark__sql__sources__parallelPartitionDiscovery__parallelism": str(max(16, 2 * spark.sparkContext.defaultParallelism)),
            "spark__sql__files__openCostInBytes": str(256 << 10)}


def own_session(spark: SparkSession, **conf) -> SparkSession:
    """A copy of the session with further settings. A stream's source lists and opens its files, whenever a batch comes, by the
    settings of the session it was made with."""
    own = SparkSession(spark.sparkContext, spark._jsparkSession.cloneSession())
    for key, value in conf.items():
        own.conf.set(key.replace("__", "."), value)
    return own


def stored(df: DataFrame, name: str, by: str | None = None, **conf) -> DataFrame:
    """Write to a fresh folder below the shared one and read back: the lineage is cut and the size is known to the planner. Shuffle
    files of the job go with it, since nothing else reads them. With ``by`` the rows are filed by that column, a file for each of
    its values open at a time (up to 32, else they are sorted first). ``conf``: further ``settings`` of the job."""
    spark = df.sparkSession
    path = scratch_dir(spark, name)
    with settings(spark, spark__sql__classic__shuffleDependency__fileCleanup__enabled="true", spark__sql__maxConcurrentOutputFileWriters="32", **conf):
        (df.write.partitionBy(by) if by else df.write).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
