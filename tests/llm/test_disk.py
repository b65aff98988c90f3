"""What the operators leave on disk must not follow the number of their steps."""

import time
from pathlib import Path

from pyspark.sql import functions as F

from hirelake.llm import jaccard_join
from hirelake.llm.common import cut

from .helpers import read


def test_a_cuts_shuffles_go_with_it(spark):
    top = Path(spark.conf.get("spark.local.dir"))
    held = lambda: {p.name for p in top.rglob("shuffle_*.data")}
    before = held()
    for _ in range(3):
        assert cut(spark.range(3000).groupBy((F.col("id") % 700).alias("k")).count(), "counted").count() == 700
    time.sleep(2)  # executors delete them on their own time
    assert len(held() - before) <= 3  # those of the counts above, no cut's
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"


def test_texts_are_dealt_once_to_keep_one(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        kept = jaccard_join.keep_one(read(spark, "documents"))
        plan = kept._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("partial_max_by") == 1 and "Exchange" not in plan.split("partial_max_by")[0]
