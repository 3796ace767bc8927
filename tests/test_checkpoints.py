"""What cut() leaves behind: nothing of the plan that was run."""

import gc
import time

from pyspark.sql import functions as F

from lodestar import checkpoints


def _shuffles(spark):
    """Ids of the shuffles of which there are files."""
    files = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllFiles()
    return {name.split("_")[1] for i in range(files.size()) if (name := files.apply(i).getName()).startswith("shuffle_")}


def _within(seconds, holds):
    end = time.time() + seconds
    while not holds() and time.time() < end:
        time.sleep(0.2)
    return holds()


def _grouped(spark):
    return spark.range(1000).groupBy((F.col("id") % 10).alias("k")).count()


def test_shuffle_files_go_with_the_cut(spark):
    before, df = _shuffles(spark), _grouped(spark)
    kept = checkpoints.cut(df)
    assert _within(5, lambda: _shuffles(spark) <= before)
    assert kept.agg(F.sum("count"), F.count("*")).first()[:] == (1000, 10)
    assert df.agg(F.sum("count")).first()[0] == 1000  # the plan itself can be run again
    assert spark.conf.get(checkpoints.FREES) == "false"


def test_a_grown_heap_is_collected(spark, monkeypatch):
    collections = lambda: sum(x.getCollectionCount() for x in spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans() if "Old" in x.getName() or "MarkSweep" in x.getName())
    gc.collect()
    monkeypatch.setattr(checkpoints, "HEAP_SHARE", 1.1)
    before = collections()
    checkpoints.tidy(spark)
    assert collections() == before
    monkeypatch.setattr(checkpoints, "HEAP_SHARE", 0.0)
    checkpoints.cut(_grouped(spark))
    assert collections() > before
