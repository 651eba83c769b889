"""Intermediate tables of one job in the shared folder: what is read back has no lineage, so a lost
executor costs no recomputation of what went before."""

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession

from shelfrank.session import shared_folder


class Scratch:
    """Tables under a folder of their own; ``drop`` removes those that nothing reads any more."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid4().hex}"

    def path(self, table: str) -> str:
        return f"{self.root}/{table}"

    def keep(self, df: DataFrame, table: str) -> DataFrame:
        df.write.mode("overwrite").parquet(self.path(table))
        return self.spark.read.schema(df.schema).parquet(self.path(table))

    def drop(self, *tables: str) -> None:
        jvm = self.spark._jvm
        for table in tables:
            path = jvm.org.apache.hadoop.fs.Path(self.path(table))
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
