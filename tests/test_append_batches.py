"""Appending device messages: the work of a batch that is written again."""

from tidegauge.queries import source_queries as Q
from tidegauge.sources import tables as T


def test_a_repeated_batch_is_parsed_once(spark, sf_dir, monkeypatch):
    plans = []
    append = T.append_batch

    def watched(rows, path, batch_id):
        plans.append((batch_id, rows._jdf.queryExecution().optimizedPlan().toString()))
        append(rows, path, batch_id)

    monkeypatch.setattr(T, "append_batch", watched)
    out = Q.append_device_messages(spark, sf_dir)
    assert [i for i, _ in plans] == [0, 1, 1]
    assert "from_json" in plans[0][1]
    assert not any("from_json" in plan for _, plan in plans[1:])
    wanted = Q.shown(Q.E.device_messages(Q.E.parse_envelopes(Q.X.envelopes(spark, sf_dir))))
    assert sorted(map(str, out.collect())) == sorted(map(str, wanted.collect()))
