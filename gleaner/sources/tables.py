"""Index tables at rest."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``; where unset and Spark is one process, one of our own."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("gleaner.work.dir", None)
    if not path:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="spark-gleaner-", dir="/tmp")
        spark.conf.set("gleaner.work.dir", path)
    return path.rstrip("/") if "://" in path or path.startswith("file:") else "file://" + path.rstrip("/")


#: For tables whose rows are megabytes: a few rows to a row group, because writers hold a group and readers take one (up to 4,096 rows) at once.
LARGE_ROWS = {"parquet.block.size": 16 << 20, "parquet.page.size.row.check.min": 1, "parquet.block.row.count.limit": 8}


class Workspace:
    """Tables that several steps of one job read: written once, so they cut lineage and outlive executors."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root, self.made = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}", {}

    def write(self, df: DataFrame, name: str, **options) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").options(**options).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def once(self, name: str, make, **options) -> DataFrame:
        """The table of this name, made and written on first use."""
        if name not in self.made:
            self.made[name] = self.write(make(), name, **options)
        return self.made[name]

    def under(self, name: str):
        """``write`` for a step with names of its own."""
        return lambda df, part: self.write(df, f"{name}-{part}")


def spread(df: DataFrame) -> DataFrame:
    """Dealt out evenly where the input has fewer parts than there are cores, before work that is costly for each row. Larger inputs stay as they are: nothing is shuffled."""
    cores = df.sparkSession._jsc.sc().defaultParallelism()
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def write(df: DataFrame, path: str, mode: str = "overwrite", form: str = "parquet") -> None:
    df.write.mode(mode).format(form).save(path)


def read_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The table, or an empty one where none was written yet."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)
    return spark.read.schema(schema).parquet(path) if there else spark.createDataFrame([], schema)
