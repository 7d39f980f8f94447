"""Enough tasks for stages whose work is in Python."""

from pyspark.sql import DataFrame


def spread(scan: DataFrame) -> DataFrame:
    """A scan over as many partitions as there are cores where its files give fewer splits than that, as one small file does; else as it is, unshuffled.

    Only the planner's estimate of the scan's bytes is looked at: nothing runs. A split has at least the bytes that opening a file counts for, so a scan of
    fewer than that a core has too few of them.
    """
    spark = scan.sparkSession
    cores = spark.sparkContext.defaultParallelism
    least = int(spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get("spark.sql.files.openCostInBytes")))
    leaves = scan._jdf.queryExecution().optimizedPlan().collectLeaves()
    size = sum(int(str(leaves.apply(k).stats().sizeInBytes())) for k in range(leaves.size()))
    return scan.repartition(cores) if size < cores * least else scan
