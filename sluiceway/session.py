"""Session settings and the shared scratch folder."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Settings the results depend on (time zone, ANSI casts) come first; the rest let
# adaptive execution split hot join partitions even when an extra shuffle follows.
RUNTIME_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.maxConcurrentOutputFileWriters": "16",
}

_local_scratch: str | None = None


def get_session(app_name: str = "sluiceway", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings above; `master` is left to spark-submit when not given."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**RUNTIME_SETTINGS, "spark.ui.enabled": "false", **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def apply_runtime_settings(spark: SparkSession) -> SparkSession:
    """Put the settings above on a session somebody else built."""
    for key, value in RUNTIME_SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def scratch_root(spark: SparkSession) -> str:
    """The folder every executor can reach. Only a local master may fall back to a temp folder."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir is not set: it must name a folder shared by all executors")
    global _local_scratch
    if _local_scratch is None:
        _local_scratch = tempfile.mkdtemp(prefix="sluiceway-")
    return _local_scratch


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new, never reused path under the scratch root."""
    return f"{scratch_root(spark)}/sluiceway/{label}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame, label: str = "cut") -> DataFrame:
    """Write `df` once to the shared scratch folder and read it back.

    The copy survives lost executors, is scanned with column pruning and statistics, and is
    computed once however often it is read.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def time_limit(spark: SparkSession, seconds: float | None, what: str) -> Iterator[None]:
    """Cancel the Spark jobs started inside the block once it has run too long, and raise TimeoutError."""
    if seconds is None:
        yield
        return
    context, tag, expired = spark.sparkContext, f"limit-{uuid.uuid4().hex}", threading.Event()

    def stop() -> None:
        expired.set()
        context.cancelJobsWithTag(tag)

    timer = threading.Timer(seconds, stop)
    context.addJobTag(tag)
    timer.start()
    try:
        yield
    except Exception as exc:
        if expired.is_set():
            raise TimeoutError(f"{what} did not finish within {seconds:g} s and was stopped") from exc
        raise
    finally:
        timer.cancel()
        context.removeJobTag(tag)
    if expired.is_set():
        raise TimeoutError(f"{what} did not finish within {seconds:g} s and was stopped")
