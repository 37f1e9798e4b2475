"""What the steps of an operator leave behind."""

import time

from tessera.llm.common import fixed_bitmap
from tessera.sources.scratch import CLEANUP, Scratch


def shuffled(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return sum(files.apply(i).getName().startswith("shuffle_") for i in range(files.size()))


def test_shuffle_files_of_a_step_go_with_it(spark):
    scratch, rows = Scratch(spark, "test"), spark.range(5000).selectExpr("id % 100 as k").groupBy("k").count()
    before, held = spark.conf.get(CLEANUP), shuffled(spark)
    saved = scratch.save(rows)
    fixed_bitmap(saved)
    for _ in range(50):  # they go in the background
        if (left := shuffled(spark)) <= held:
            break
        time.sleep(0.2)
    assert left <= held and saved.count() == rows.count() == 100 and spark.conf.get(CLEANUP) == before
    scratch.drop(saved)
