"""Device message tables and other Parquet tables: create, append, read, size of files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidegauge import schema as S
from tidegauge.session import scratch

# Table properties, with the format's names for them.
TABLE_PROPERTIES = {
    "format-version": "2",
    "write.format.default": "parquet",
    "write.target-file-size-bytes": str(S.TARGET_FILE_BYTES),
}


def ensure_table(spark: SparkSession, name: str, using: str = "parquet",
                 location: str | None = None, partitioned_by: str | None = None) -> None:
    """Create the device message table if there is none; its columns are never NULL."""
    columns = ", ".join(f"{f.name} {f.dataType.simpleString()} NOT NULL"
                        for f in S.DEVICE_MESSAGE.fields)
    properties = ", ".join(f"'{k}' = '{v}'" for k, v in TABLE_PROPERTIES.items())
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING {using}"
        + (f" PARTITIONED BY ({partitioned_by})" if partitioned_by else "")
        + (f" LOCATION '{location}'" if location else "")
        + f" TBLPROPERTIES ({properties})")


def complete_messages(rows: DataFrame) -> DataFrame:
    """The columns of the device message table; a NULL in any of them stops the write."""
    def stop(name: str, kind) -> Column:
        return F.raise_error(F.lit(f"NULL in {name}")).cast(kind)

    return rows.select(*[F.coalesce(F.col(f.name), stop(f.name, f.dataType)).alias(f.name)
                         for f in S.DEVICE_MESSAGE.fields])


def append_table(rows: DataFrame, name: str) -> None:
    """Append to a table of the session's catalog (Parquet, or Iceberg when installed)."""
    complete_messages(rows).write.insertInto(name)


def sized_write(df: DataFrame, path: str, target_bytes: int = S.TARGET_FILE_BYTES,
                max_rows: int | None = None, mode: str = "append") -> None:
    """Write files near the target size.

    The rebalance hint lets adaptive execution merge small and split large shuffle partitions
    towards the target, also where one value dominates; ``max_rows`` bounds the rows of a file.
    """
    spark = df.sparkSession
    setting = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    earlier = spark.conf.get(setting)
    spark.conf.set(setting, str(target_bytes))
    try:
        writer = df.hint("rebalance").write.mode(mode)
        if max_rows:
            writer = writer.option("maxRecordsPerFile", max_rows)
        writer.parquet(path)
    finally:
        spark.conf.set(setting, earlier)


def append_batch(rows: DataFrame, path: str, batch_id: int) -> None:
    """Write one micro-batch into its own folder; repeating a batch replaces it."""
    rows.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")


def append_messages(rows: DataFrame, path: str, batch_id: int) -> None:
    """Write a micro-batch of device messages into its own folder, in files near the target size."""
    sized_write(complete_messages(rows), f"{path}/batch_id={batch_id}", mode="overwrite")


def read_device_messages(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a device message table kept as folders of micro-batches."""
    return (spark.read.schema(S.DEVICE_MESSAGE).option("basePath", path)
            .option("recursiveFileLookup", "true").parquet(path))


def round_trip(df: DataFrame, name: str) -> DataFrame:
    """Write a table below the shared scratch folder and read it back."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
