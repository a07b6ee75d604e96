import pytest

from tidegauge.sources import jdbc, kafka
from tidegauge.sources.tables import TABLE_PROPERTIES


def test_topic_reader_options():
    o = kafka.read_options("b:9092", group="storage")
    assert o["subscribe"] == "iota.edge.raw.v1" and o["startingOffsets"] == "earliest"
    assert (o["minOffsetsPerTrigger"], o["maxTriggerDelay"]) == ("50000", "60s")
    assert "maxOffsetsPerTrigger" not in o and o["kafka.fetch.max.wait.ms"] == "1000"
    assert kafka.read_options("b", max_rows=10**9)["maxOffsetsPerTrigger"] == "1000000000"
    assert kafka.read_options("b", start="latest")["startingOffsets"] == "latest"
    with pytest.raises(ValueError):
        kafka.read_options("b", start="middle")


def test_topic_writer_waits_for_all_replicas():
    assert kafka.write_options("b")["kafka.acks"] == "all"


def test_registry_options():
    assert "partitionColumn" not in jdbc.read_options("jdbc:x")
    assert jdbc.read_options("jdbc:x", partitions=8, upper=99)["numPartitions"] == "8"
    assert "WHEN MATCHED" in jdbc.merge_statement("t", "s")
    assert "ON DUPLICATE KEY" in jdbc.upsert_statement()


def test_table_properties():
    assert TABLE_PROPERTIES["write.target-file-size-bytes"] == str(134217728)
