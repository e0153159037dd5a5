"""Session settings and the shared folder used to cut lineage."""

from __future__ import annotations

import re
import tempfile
import uuid
import warnings

from pyspark.sql import DataFrame, SparkSession

_CHECKPOINT_KEY = "spark.checkpoint.dir"
_CLEANUP_KEY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

# Settings every job of this package expects. All of them are run-time SQL settings, so
# they can also be applied to a session somebody else created.
SQL_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(
    app: str = "titlelab", master: str | None = None, settings: dict[str, str] | None = None
) -> SparkSession:
    """Create (or get) a session with the settings this package expects."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SQL_SETTINGS, **(settings or {})}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """Folder for intermediate tables and stream progress.

    It is the one the session names in ``spark.checkpoint.dir``. A session whose driver is
    its only executor (``local`` or ``local[...]``) may leave it out: a temporary folder is
    then set, and said so in a warning. Anywhere else a machine-local folder would be lost
    with its machine, so a missing setting is an error.
    """
    context = spark.sparkContext
    named = spark.conf.get(_CHECKPOINT_KEY, None) or context.getCheckpointDir()
    if named is None:
        if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise RuntimeError(f"set {_CHECKPOINT_KEY} to a folder all executors can reach")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="titlelab-"))
        named = context.getCheckpointDir()
        warnings.warn(f"{_CHECKPOINT_KEY} is not set; this local session uses {named}", stacklevel=2)
    return named


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder no earlier run has used."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def durable(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared folder once and read it from there afterwards.

    Used where several later steps read the same rows, or must see exactly the same row
    placement. It cuts lineage: a lost executor costs a re-read, not a recomputation. The
    planner sees the table's true size when it picks joins, and a lookup side read from a
    table is shuffled for the join itself, which is what lets adaptive execution split a
    hot key on the other side (it cannot when an aggregate feeds the join directly).
    """
    spark = df.sparkSession
    path = scratch_path(spark, "table")
    before = spark.conf.get(_CLEANUP_KEY, None)
    spark.conf.set(_CLEANUP_KEY, "true")  # the written table is read from now on, never the shuffles behind it
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP_KEY)
        else:
            spark.conf.set(_CLEANUP_KEY, before)
    return spark.read.schema(df.schema).parquet(path)


def release(*tables: DataFrame) -> None:
    """Delete tables that ``durable`` wrote, once later tables hold all that is still needed of them."""
    for df in tables:
        spark = df.sparkSession
        for folder in {name.rsplit("/", 1)[0] for name in df.inputFiles()}:
            if not re.fullmatch(r"table-[0-9a-f]{32}", folder.rsplit("/", 1)[1]):
                raise ValueError(f"{folder} is no table of this package")
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
