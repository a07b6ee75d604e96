"""Registry table in a relational database."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Table and columns of the registry.
REGISTRY_TABLE = "proxy_served_device"
REGISTRY_COLUMNS = ("id", "mac_addr", "timestamp")


def read_options(url: str, partitions: int | None = None, lower: int = 0,
                 upper: int | None = None) -> dict[str, str]:
    """Source options; ranges of the id are read in parallel when an upper bound is known."""
    options = {"url": url, "dbtable": REGISTRY_TABLE, "fetchsize": "10000"}
    if partitions and upper is not None:
        options |= {"partitionColumn": "id", "lowerBound": str(lower), "upperBound": str(upper),
                    "numPartitions": str(partitions)}
    return options


def read_registry(spark: SparkSession, url: str, **kwargs) -> DataFrame:
    return (spark.read.format("jdbc").options(**read_options(url, **kwargs)).load()
            .select(*REGISTRY_COLUMNS))


def upsert_statement() -> str:
    """Insert a device or, when the MAC is known, overwrite its time."""
    return (f"INSERT INTO {REGISTRY_TABLE} (mac_addr, timestamp) VALUES (?, ?) "
            "ON DUPLICATE KEY UPDATE timestamp = VALUES(timestamp)")


def merge_statement(table: str, source: str) -> str:
    """The same upsert on a table format with MERGE."""
    return (f"MERGE INTO {table} t USING {source} s ON t.mac_addr = s.mac_addr "
            "WHEN MATCHED THEN UPDATE SET t.timestamp = s.timestamp "
            "WHEN NOT MATCHED THEN INSERT (id, mac_addr, timestamp) "
            "VALUES (s.id, s.mac_addr, s.timestamp)")
