"""Session set-up for local runs, and the shared folder that jobs write to."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"


def local_session(cores: int | str = "*", memory: str = "8g", app: str = "loanweave") -> SparkSession:
    """A single-machine session for tests and benchmarks; on a cluster the caller passes its own session in."""
    partitions = str(cores) if str(cores).isdigit() else "8"
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", partitions)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )


# Folders made in each scope that is open, the innermost last.
_open_scopes: list[list[str]] = []


def removed(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared file system, if it is there."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[None]:
    """Remove the intermediate tables made inside, once what is built on them is written.

    What is to stay must be written to a path taken before. A table that reads an intermediate and is not yet written when
    the scope ends cannot be read any more.
    """
    made: list[str] = []
    _open_scopes.append(made)
    try:
        yield
    finally:
        _open_scopes.remove(made)
        for path in made:
            removed(spark, path)


def scratch_path(spark: SparkSession, purpose: str) -> str:
    """A fresh path every executor can reach.

    The cluster names its shared folder in ``spark.checkpoint.dir``. A machine-local temporary folder is used only
    where that is unset and the whole session lives on one machine.
    """
    shared = spark.sparkContext.getConf().get(CHECKPOINT_CONF)
    name = f"loanweave-{purpose}-{uuid.uuid4().hex}"
    if shared:
        return _listed(f"{shared.rstrip('/')}/{name}")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"set {CHECKPOINT_CONF} to a folder that all executors share")
    return _listed(f"{tempfile.mkdtemp(prefix='loanweave-')}/{name}")


def _listed(path: str) -> str:
    if _open_scopes:
        _open_scopes[-1].append(path)
    return path


def written(df: DataFrame, purpose: str) -> DataFrame:
    """A narrow table written to the shared folder and read back: what lies below it runs once, however many passes
    follow."""
    path = scratch_path(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
