"""What grows with the packets does not go through the driver's memory; small tables, on which the planner would broadcast it."""

from pyspark.sql import functions as F

import __spark_entry__ as entry
from packetlake.operators import models
from packetlake.operators.features import FEATURES
from packetlake.operators.stored import stored

SF = "/root/testdata/sf0.001"


def joins(df):
    """The joins of the plan, but for those with a row for 4096 windows (_group), two for an hour (cell), or one for a key and block of time (_block)."""
    return [x for x in df._jdf.queryExecution().sparkPlan().toString().splitlines() if "Join" in x and "_group#" not in x and "cell#" not in x and "_block#" not in x]


def test_numbered_windows_are_not_broadcast(spark):
    rows = stored(spark.range(50).select((F.col("id") * 3).alias("slot"), *[(F.col("id") * 1.5).alias(f) for f in FEATURES]))
    got = models.numbered(rows)
    assert len(joins(got)) == 1 and "SortMergeJoin" in joins(got)[0]
    assert [(r.slot, r.number, r.x[0]) for r in got.orderBy("slot").collect()] == [(3 * k, k, 1.5 * k) for k in range(50)]


def test_scores_of_windows_are_not_broadcast(spark):
    for name in ("l9_anomaly_alerts", "a23_daily_summary", "a24_recent_scores"):
        found = [x for x in joins(entry.queries()[name](spark, SF)) if "[slot#" in x or "[dst_ip#" in x]
        assert len(found) >= 5 and all("SortMergeJoin" in x for x in found)
