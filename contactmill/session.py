"""Session settings the operators rely on.

Only run-time SQL settings are changed, and only where the session does not carry a
value of its own, so a cluster's tuning always wins.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Needed for right results: every "day" and "hour" in the package is a UTC one.
REQUIRED = {"spark.sql.session.timeZone": "UTC"}

# Defaults for speed; a value given by the cluster is kept.
PREFERRED = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Long pages: keep the Arrow batches handed to the HTML pass small.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "256",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the settings above to a running session and return it."""
    for key, value in REQUIRED.items():
        spark.conf.set(key, value)
    given = {key for key, _ in spark.sparkContext.getConf().getAll()}
    for key, value in PREFERRED.items():
        if key not in given:
            spark.conf.set(key, value)
    return spark


def local_session(cpus: int = 8, app: str = "contactmill", **extra: str) -> SparkSession:
    """A local session for tests and the benchmark."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", str(cpus))
        # Recording the call site of every Column costs more than building it.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    for key, value in extra.items():
        builder = builder.config(key, value)
    spark = configure(builder.getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def scratch(spark: SparkSession, root: str | None = None) -> str:
    """The path of a new folder, not yet made, below the shared one."""
    return f"{root or checkpoint_root(spark)}/stored-{uuid.uuid4().hex}"


def stored(df: DataFrame, root: str | None = None) -> DataFrame:
    """Write a DataFrame to the shared folder and read it back.

    Cuts the lineage like a checkpoint: several uses cost one computation, and lost executors cost
    a re-read. For results that must stay the same once fixed, such as a send plan.
    """
    path = scratch(df.sparkSession, root)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder for checkpoints and streaming state.

    Read from ``spark.checkpoint.dir``. A temporary folder is made only where the setting
    is absent, which is the case in local tests.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    return tempfile.mkdtemp(prefix="contactmill-")
