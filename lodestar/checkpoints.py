"""Cutting lineage in the shared folder that the cluster names."""

from __future__ import annotations

import gc
import re
import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: With a true value, Spark removes an execution's shuffle files when it ends.
FREES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Share of the driver's largest heap that may be taken from the system before garbage is collected.
HEAP_SHARE = 0.5


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names in spark.checkpoint.dir.

    Where none is set, a folder of this machine does if the session runs on this
    machine alone (tests); on a cluster it raises, since executors couldn't share it.
    """
    given = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if given is None and current.isDefined():
        return current.get()
    if given is None:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir is not set: name a folder that the driver and all executors share")
        given = tempfile.mkdtemp(prefix="lodestar-checkpoint-")
    if not current.isDefined():
        spark.sparkContext.setCheckpointDir(given)
    return given


@contextmanager
def freed(df: DataFrame) -> Iterator[DataFrame]:
    """df for one action, whose shuffle files go as that ends.

    Else they stay until the driver happens to collect its garbage, and the disk
    holds those of all steps so far.
    """
    conf = df.sparkSession.conf
    before = conf.get(FREES, None)
    conf.set(FREES, "true")
    try:
        yield df.select("*")  # the setting counts for plans made under it
    finally:
        if before is None:
            conf.unset(FREES)
        else:
            conf.set(FREES, before)


def tidy(spark: SparkSession) -> None:
    """Collects the driver's garbage if its heap has grown over HEAP_SHARE of the most.

    Each stage leaves megabytes (its broadcast plan, its shuffle's table of maps by
    partitions).  Left alone, the JVM takes all of its heap before it collects
    them; a full collection also gives heap back.
    """
    runtime = spark._jvm.java.lang.Runtime.getRuntime()
    if runtime.totalMemory() > HEAP_SHARE * runtime.maxMemory():
        gc.collect()  # what Python still names is no garbage
        spark._jvm.System.gc()


def cut(df: DataFrame) -> DataFrame:
    """df computed once and kept in the shared checkpoint folder, without its lineage and its shuffle files."""
    checkpoint_dir(df.sparkSession)
    with freed(df) as own:
        out = own.checkpoint()
    del own
    tidy(df.sparkSession)
    return out
