"""Session settings the operators rely on."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Catalyst does the physical planning; these are the run-time re-plan switches
# (skew splitting, partition coalescing) and the time zone all formulas assume.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # The JVM never compiles methods above 8 000 bytes of code, it interprets them. Stages whose generated method is larger
    # are run operator by operator instead, whose expressions Spark cuts into small methods.
    "spark.sql.codegen.hugeMethodLimit": "8000",
}


#: Bytes of an Arrow batch where Python makes several matrices of a batch's size; Spark's own limit is 64 MB. With 4 MB a worker
#: gives its memory back and takes it again for each piece of a batch, and is a quarter slower.
BATCH_BYTES = 16 << 20


def build_session(app: str = "flowspark", master: str | None = None, **conf: str) -> SparkSession:
    """Create (or get) a session with the settings above; ``conf`` keys use ``__`` for dots."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def compiled(spark: SparkSession) -> SparkSession:
    """The session, also one made elsewhere, with the limit on generated methods."""
    name = "spark.sql.codegen.hugeMethodLimit"
    if spark.conf.get(name) != SETTINGS[name]:
        spark.conf.set(name, SETTINGS[name])
    return spark


@contextmanager
def set_for(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    """The setting for what is run inside."""
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def small_batches(spark: SparkSession):
    """Arrow batches of BATCH_BYTES for what is run inside, so that a Python worker's memory doesn't follow its partition."""
    return set_for(spark, "spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def checkpoint_folder(spark: SparkSession) -> str:
    """The cluster's shared folder (``spark.checkpoint.dir``); a temporary one only where the session names none (tests)."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="flowspark-"))
    return sc.getCheckpointDir()


def durable(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint in the shared folder."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, name: str = "table") -> DataFrame:
    """The rows as a Parquet table in the shared folder: computed once, and each later use reads only the columns it needs.

    What was shuffled for it is deleted with the table's last task, not when the driver happens to collect its garbage.
    """
    path = f"{checkpoint_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    with set_for(df.sparkSession, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true"):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
