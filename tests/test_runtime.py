import time

from pyspark.sql import functions as F

from quern.runtime import stored


def shuffle_files(spark):
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n")
    return {f for f in files.split("\n") if "shuffle_" in f}


def test_shuffles_go_with_what_is_stored(spark):
    before = shuffle_files(spark)
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    had = spark.conf.get(key, None)
    out = stored(spark.range(2000).groupBy((F.col("id") % 100).alias("k")).agg(F.sum("id").alias("s")).join(spark.range(100).withColumnRenamed("id", "k").hint("merge"), "k"), "shuffled")
    end = time.time() + 20
    while shuffle_files(spark) - before and time.time() < end:
        time.sleep(0.2)
    assert not shuffle_files(spark) - before
    assert spark.conf.get(key, None) == had and out.count() == 100 and out.agg(F.sum("s")).first()[0] == 1999 * 1000
