"""Reading the driver's parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One driver table; column pruning and filters reach the parquet scan."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _row_groups(spark: SparkSession, df: DataFrame, enough: int) -> tuple[int, int]:
    """(row groups, bytes) of the parquet files behind ``df``, from their footers; stops once ``enough`` are found."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    files = df._jdf.inputFiles()
    if len(files) >= enough:
        return len(files), 0
    groups = size = 0
    for f in files:
        path = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(f))
        reader = jvm.org.apache.parquet.hadoop.ParquetFileReader.open(
            jvm.org.apache.parquet.hadoop.util.HadoopInputFile.fromPath(path, conf))
        try:
            groups += reader.getRowGroups().size()
        finally:
            reader.close()
        size += path.getFileSystem(conf).getFileStatus(path).getLen()
    return groups, size


def spread_table(spark: SparkSession, sf_dir: str, name: str, least_bytes: int = 1 << 20) -> DataFrame:
    """A driver table for work that is heavy per row (tokenising): as many partitions as the cluster has cores.

    A parquet file is split at its row groups only, so a table of few row groups would
    be worked on by as few tasks. Such a table (by its files' footers, at most one a
    core is opened; no job) is dealt out once. Tables with enough row groups, and those
    below ``least_bytes``, are read as they are. The rows are the same either way.
    """
    df = table(spark, sf_dir, name)
    cores = spark.sparkContext.defaultParallelism
    groups, size = _row_groups(spark, df, cores)
    return df if groups >= cores or size < least_bytes else df.repartition(cores)


def register_views(spark: SparkSession, sf_dir: str, names=None) -> None:
    for n in names or TABLES:
        table(spark, sf_dir, n).createOrReplaceTempView(n)


def land_bucketed(df: DataFrame, table_name: str, key: str, buckets: int, path: str) -> DataFrame:
    """Write ``df`` once as a parquet table bucketed and sorted by ``key``.

    Two tables landed with the same key and bucket count join without a
    shuffle (each bucket pairs with the same bucket of the other side), so the
    wide text side never moves across the network for the documents-labels join.
    ``path`` must be in shared storage (e.g. below ``spark.checkpoint.dir``).
    """
    (df.write.mode("overwrite").format("parquet").bucketBy(buckets, key).sortBy(key)
       .option("path", path).saveAsTable(table_name))
    return df.sparkSession.table(table_name)
