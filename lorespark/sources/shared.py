"""Intermediate results and stored tables in the folder that all executors share."""

from __future__ import annotations

import gc
import tempfile
from collections.abc import Callable
from hashlib import sha256

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, or a temporary folder where that is unset and driver and executors are one machine."""
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    known = context._jsc.sc().getCheckpointDir()
    if known.isDefined():
        return known.get().rsplit("/", 1)[0]  # Spark puts a folder of its own into the one that was named
    if not context.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return "file://" + tempfile.mkdtemp(prefix="checkpoint")


def kept(df: DataFrame) -> DataFrame:
    """The same rows, computed once and written to ``spark.checkpoint.dir``, so that a lost executor loses none of them.

    Where that is unset a folder is made, but only on one machine. With ``spark.cleaner.referenceTracking.cleanCheckpoints``
    Spark removes what is no longer in use.
    """
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def release(spark: SparkSession) -> None:
    """Has Spark remove the shuffle files and checkpoints of what is no longer in use now, not when the driver's memory happens to run short."""
    gc.collect()
    spark._jvm.System.gc()


def spread(df: DataFrame) -> DataFrame:
    """The same rows over all cores, if a scan of few or small files leaves cores idle; for work that costs far more than moving rows.

    A table of many files already has more partitions than there are cores and is left as it is: no shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df._jdf.rdd().getNumPartitions() < cores else df


def file_system(spark: SparkSession, path: str):
    """(Hadoop file system, path) of a path of any kind."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def one_row(spark: SparkSession) -> DataFrame:
    """A local relation of one row: what is selected from it is computed by the optimizer, without a job."""
    return spark.sql("select * from values (1) as t(one)")


def read_file(spark: SparkSession, path: str) -> str:
    """A small text file, read by the driver."""
    fs, at = file_system(spark, path)
    stream = fs.open(at)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def state_of(spark: SparkSession, *paths: str) -> str:
    """A mark of the files at some paths: names, lengths and times of change. Other files give another mark."""
    marks = []
    for path in paths:
        fs, at = file_system(spark, path)
        if fs.exists(at):
            files = fs.listFiles(at, True)
            while files.hasNext():
                f = files.next()
                marks.append(f"{f.getPath()} {f.getLen()} {f.getModificationTime()}")
    return sha256("\n".join(sorted(marks)).encode()).hexdigest()[:24]


def stored(spark: SparkSession, name: str, inputs: list[str], build: Callable[[], DataFrame], by: str | None = None, buckets: int = 32) -> DataFrame:
    """A table that is derived from files once and read from then on, for as long as these files stay as they are.

    It lies in the shared folder, under the state of its inputs, written beside and renamed when complete. With ``by`` it is
    laid out for lookups of that column: partitions ``bucket`` by its hash, sorted within files, so that a filter on
    ``bucket`` and the column reads few row groups. See ``looked_up``.
    """
    root = shared_folder(spark)
    path = f"{root}/stored/{name}-{state_of(spark, *inputs)}"
    fs, at = file_system(spark, path)
    if not fs.exists(at):
        df = build()
        beside = f"{root}/stored/new-{name}-{spark._jvm.java.util.UUID.randomUUID()}"
        write_by(df, beside, by, buckets)
        new = file_system(spark, beside)[1]
        if not fs.rename(new, at) or not fs.exists(at):
            if not fs.exists(at):  # else another session was first
                raise OSError(f"could not publish {path}")
        fs.delete(new, True)
        del df
        release(spark)
    return spark.read.parquet(path)


def write_by(df: DataFrame, path: str, by: str | None, buckets: int = 32, small: bool = False) -> None:
    """Laid out for lookups of a column. What is small is one sorted file, in which ``bucket`` is a column like others."""
    if by is None:
        df.write.option("compression", "zstd").parquet(path)
        return
    from pyspark.sql import functions as F

    # a hot value's rows are spread over the tasks by a salt; each bucket is some files, sorted for row-group statistics
    laid = df.withColumn("bucket", F.pmod(F.xxhash64(by), F.lit(buckets)).cast("int"))
    if small:
        laid.coalesce(1).sortWithinPartitions("bucket", by).write.parquet(path)
        return
    laid.repartition("bucket", F.floor(F.rand(5) * 4)).sortWithinPartitions("bucket", by).write.partitionBy("bucket").parquet(path)


def looked_up(df: DataFrame, by: str, values: list[str], buckets: int = 32) -> DataFrame:
    """The rows of a stored table with one of a few values: buckets are pruned and the values pushed into the scan."""
    from pyspark.sql import functions as F

    spark = df.sparkSession
    wanted = list(dict.fromkeys(values))
    if not wanted:
        return df.where("false").drop("bucket")
    at = one_row(spark).select(F.transform(F.array(*map(F.lit, wanted)), lambda v: F.pmod(F.xxhash64(v), F.lit(buckets)).cast("int"))).first()[0]
    return df.where(F.col("bucket").isin(sorted(set(at))) & F.col(by).isin(wanted)).drop("bucket")
