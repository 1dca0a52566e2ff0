"""Session helpers: table access and cutting of lineage in the cluster's shared folder."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_STAGED: list[tuple[SparkSession, str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table `name` of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """Folder that all executors share: `spark.checkpoint.dir`. Where that is unset, a local session (one process) gets
    a folder of its own; on a cluster this raises, for a machine's own folder would lose data there."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError(f"spark.checkpoint.dir must name a folder that all executors share (master {master})")
        named = "file://" + tempfile.mkdtemp(prefix="turnwise-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def staged(df: DataFrame) -> DataFrame:
    """`df` written once as parquet into the shared folder and read back, which cuts the lineage.

    The files outlive lost executors; they are deleted when the Python driver ends, or at the end of the `staging` block
    in which they were written.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/staged-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _STAGED.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def _drop(staged_files: list[tuple[SparkSession, str]]) -> None:
    for spark, path in staged_files:
        try:
            p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # the JVM may be gone already
            return


@contextmanager
def staging() -> Iterator[None]:
    """Drops what is staged inside the block when it ends: for sessions that run many queries. Results must have been
    written or collected before."""
    before = len(_STAGED)
    try:
        yield
    finally:
        _drop(_STAGED[before:])
        del _STAGED[before:]


@atexit.register
def _drop_staged() -> None:
    _drop(_STAGED)
