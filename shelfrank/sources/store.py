"""Intermediate tables in the shared folder, and restartable output."""

from collections.abc import Callable
from hashlib import sha1
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfrank.session import shared_folder


def _files(df: DataFrame) -> list[tuple[str, int, int]]:
    """Name, size and time of the files that a table is read from."""
    spark, found = df.sparkSession, []
    for name in sorted(df.inputFiles()):
        path = spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI(name))
        status = path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path)
        found.append((name, status.getLen(), status.getModificationTime()))
    return found


def _content(df: DataFrame) -> tuple:
    """Number of rows and sums of their digests, whatever their order."""
    mixed = F.xxhash64(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]), {"ignoreNullFields": "false"}))
    return tuple(df.agg(F.count("*"), F.sum(mixed.bitwiseAND(0xFFFFFFFF)), F.sum(F.shiftrightunsigned(mixed, 32))).first())


def _whole_plan(df: DataFrame) -> str:
    """The plan's text with all of its fields and places."""
    conf, limits = df.sparkSession.conf, {"spark.sql.debug.maxToStringFields": "100000", "spark.sql.maxMetadataStringLength": "100000"}
    before = {name: conf.get(name) for name in limits}
    for name, value in limits.items():
        conf.set(name, value)
    try:
        return df._jdf.queryExecution().optimizedPlan().canonicalized().toString()
    finally:
        for name, value in before.items():
            conf.set(name, value)


def identity(part: object) -> str:
    """What tells inputs and parameters apart: of a table its schema, its whole plan, and the name, size and
    time of every file; where any of its rows come from elsewhere, which a plan does not show, their
    number and digest instead, at the cost of one pass. Else the text."""
    if not isinstance(part, DataFrame):
        return repr(part)
    leaves = part._jdf.queryExecution().optimizedPlan().collectLeaves()
    kinds = [leaves.apply(i).getClass().getSimpleName() for i in range(leaves.size())]
    if any(kind != "LogicalRelation" for kind in kinds):
        return f"{part.schema.simpleString()} {_content(part)}"
    return f"{part.schema.simpleString()} {_files(part)} {_whole_plan(part)}"


class TableStore:
    """Parquet tables named by what they hold and the day they start at.

    Without a root, tables live in the shared folder under this application's own name, so they
    are never stale; give a root to reuse tables across applications. ``about`` narrows a store to
    tables made with the given parameters and from the given inputs."""

    def __init__(self, spark: SparkSession, root: str | None = None):
        self.spark = spark
        own = f"{shared_folder(spark)}/{spark.sparkContext.applicationId}"
        self.root = (root or own).rstrip("/")

    def about(self, *parts: object) -> "TableStore":
        digest = sha1("\n".join(map(identity, parts)).encode()).hexdigest()[:16]
        return TableStore(self.spark, f"{self.root}/{digest}")

    def path(self, name: str, day: str) -> str:
        return f"{self.root}/{name}/{day}"

    def _hadoop(self, path: str):
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return hadoop.getFileSystem(self.spark._jsc.hadoopConfiguration()), hadoop

    def _has(self, path: str) -> bool:
        """Only a finished write leaves the marker file."""
        files, marker = self._hadoop(f"{path}/_SUCCESS")
        return files.exists(marker)

    def has(self, name: str, day: str) -> bool:
        return self._has(self.path(name, day))

    def write(
        self, name: str, day: str, df: DataFrame,
        sort_by: list[str] | None = None, partition_by: list[str] | None = None,
    ) -> DataFrame:
        """``sort_by`` orders each file, so that scans skip its row groups and pages by their
        bounds, without a shuffle of its own; ``partition_by`` makes a folder per value. The table
        is written beside its place and moved there, so it is never seen half done. A plan that
        reads the table it is to replace is refused."""
        path = self.path(name, day)
        files, target = self._hadoop(path)
        within = files.makeQualified(target).toUri().getPath().rstrip("/") + "/"
        if any(within in f for f in df.inputFiles()):
            raise ValueError(f"{path} would be written from itself")
        if sort_by:
            df = df.sortWithinPartitions(*sort_by)
        beside = f"{path}.{uuid4().hex}"
        df.write.parquet(beside, partitionBy=partition_by)
        files.delete(target, True)
        if not files.rename(self._hadoop(beside)[1], target):
            raise OSError(f"could not move {beside} to {path}")
        return self.read(name, day)

    def read(self, name: str, day: str) -> DataFrame:
        return self.spark.read.parquet(self.path(name, day))

    def reuse(
        self, name: str, day: str, make: Callable[[], DataFrame],
        sort_by: list[str] | None = None, partition_by: list[str] | None = None,
    ) -> DataFrame:
        """The stored table if there is one, else make and store it. What is read back has no
        lineage, so a lost executor costs no recomputation of what went before."""
        if self.has(name, day):
            return self.read(name, day)
        return self.write(name, day, make(), sort_by, partition_by)


def unfinished(customers: DataFrame, finished: DataFrame) -> DataFrame:
    return customers.join(finished.select("customer_id"), "customer_id", "left_anti")


def customer_bucket(n_buckets: int) -> Column:
    return F.pmod(F.xxhash64("customer_id"), F.lit(n_buckets)).cast("int")


def write_restartable(df: DataFrame, path: str, n_buckets: int) -> None:
    """One folder per customer bucket; a repeated write replaces only the buckets it holds."""
    (
        df.withColumn("bucket", customer_bucket(n_buckets))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("bucket")
        .parquet(path)
    )
