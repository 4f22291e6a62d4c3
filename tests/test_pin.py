from pyspark.sql import functions as F

from evoq import session


def test_pin_leaves_no_shuffle_files_and_the_setting_as_it_was(spark):
    before = spark.conf.get(session.SHUFFLE_CLEANUP)
    statuses = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker().shuffleStatuses()
    held = statuses.size()
    table = session.pin(spark.range(10_000).groupBy((F.col("id") % 100).alias("k")).count())
    assert statuses.size() == held and spark.conf.get(session.SHUFFLE_CLEANUP) == before
    assert table.count() == 100
