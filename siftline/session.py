"""Session helpers: one place that knows how jobs size partitions and cut lineage."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ROW_GROUP_BYTES = 8 << 20


def local_session(app: str = "siftline", cores: str = "*", **conf: str) -> SparkSession:
    """A local session for tests and the bench; on a cluster the caller brings their own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """This application's folder among those that all executors share.

    It lies in ``spark.checkpoint.dir``, or in a temporary folder of the driver's machine where that is unset and the
    executors are threads of the driver (tests).
    """
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if conf:
        return f"{conf.rstrip('/')}/siftline-{spark.sparkContext.applicationId}"
    if spark.sparkContext.master.split("[")[0] == "local":
        own = _OWN.get(spark.sparkContext.applicationId)
        if own is None:
            own = _OWN[spark.sparkContext.applicationId] = tempfile.mkdtemp(prefix="siftline-")
            atexit.register(shutil.rmtree, own, ignore_errors=True)
        return own
    raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")


def materialise(df: DataFrame, name: str = "t") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage and survives a lost executor.

    Row groups are small, so that the next stage reads a file in as many tasks as there are cores.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").option("parquet.block.size", ROW_GROUP_BYTES).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clean(spark: SparkSession) -> None:
    """Deletes what ``materialise`` has written in this application; call it when the results have been read or stored."""
    path = spark._jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def numbered(df: DataFrame, *order: str, name: str = "uid") -> DataFrame:
    """Adds ``name``: the place of each row, from 0, in the order of the given columns, which tell all rows apart.

    Rows are sorted by range over all executors and written once; each partition's rows are counted, and a row's number is
    its place in its partition after those before. Only one count a partition is joined.
    """
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    placed = materialise(placed.withColumn("_part", F.shiftright("_at", 33)).withColumn("_at", F.col("_at").bitwiseAND((1 << 33) - 1)), "numbered")
    counts = placed.groupBy("_part").agg(F.count("*").alias("_n"))
    before = counts.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return placed.join(F.broadcast(before), "_part").withColumn(name, F.col("_before") + F.col("_at")).drop("_part", "_at", "_before")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """``df``, a scan, over ``spark.siftline.scan.partitions`` partitions where that is set, else as it is.

    For Python stages on a few large files of one row group, which no scan can split: set it to the number of cores.
    """
    n = df.sparkSession.conf.get("spark.siftline.scan.partitions", None)
    return df.repartition(int(n)) if n else df
