"""Stages let their files go."""

import time

from leafspan.session import cut_stage


def test_shuffles_of_a_stage_go_while_its_frame_is_held(spark):
    statuses = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker().shuffleStatuses()
    cut_stage(spark.range(10))
    before = statuses.size()
    held = spark.range(1_000).repartition(7).groupBy("id").count()
    made = cut_stage(held)
    time.sleep(1)
    # What the last job still held goes with the next stage.
    cut_stage(spark.range(10))
    until = time.time() + 20
    while statuses.size() > before and time.time() < until:
        time.sleep(0.2)
    assert statuses.size() <= before
    assert made.count() == held.count() == 1_000
