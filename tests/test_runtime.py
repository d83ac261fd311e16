import os
import tempfile
import time

from pyspark.sql import functions as F

from codeloom.runtime import RELEASE, checkpoint


def test_checkpoint_leaves_no_shuffle_files(spark):
    local = spark.sparkContext.getConf().get("spark.local.dir") or tempfile.gettempdir()
    files = lambda: {f for folder, _, names in os.walk(local) for f in names if f.startswith("shuffle_") and f.endswith(".data")}
    df = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).agg(F.count(F.lit(1)).alias("n"))
    before = files()
    kept = checkpoint(df)
    for _ in range(50):  # they go in the background
        if files() - before:
            time.sleep(0.1)
    assert not files() - before and spark.conf.get(RELEASE) == "false"
    assert kept.count() == df.count() == 7
