import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from lodestar.functions.documents import canonical, value_hash
from lodestar.sources import sinks
from lodestar.sources.connectors import kafka_messages
from lodestar.streaming import ingest

STATE = "topic string, id long, v string"


def test_each_topic_keeps_a_part_of_the_state(spark):
    fold = ingest.topics_transform(
        {"people": ingest.upsert_transform(["id"], ["at"]), "gone": ingest.change_feed_transform(["id"], ["at"], F.col("v") == "x"), "idle": lambda incoming, previous: None}
    )
    previous = spark.createDataFrame([("people", 1, "old"), ("people", 2, "kept"), ("gone", 1, "here"), ("idle", 1, "same"), ("other", 5, "stays"), (None, 6, "stays")], STATE)
    incoming = spark.createDataFrame([("people", 1, "new", 2), ("people", 1, "newer", 3), ("gone", 1, "x", 1), ("gone", 3, "y", 1), ("idle", 1, "z", 1), ("unknown", 9, "q", 1), (None, 9, "q", 1)], STATE + ", at long")
    got = {tuple(r) for r in fold(incoming, previous).select("topic", "id", "v").collect()}
    assert got == {("people", 1, "newer"), ("people", 2, "kept"), ("gone", 3, "y"), ("idle", 1, "same"), ("other", 5, "stays"), (None, 6, "stays")}
    assert ingest.topics_transform({"idle": lambda incoming, previous: None})(incoming, previous) is None


def test_topics_through_a_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    state = ingest.StateTable(spark, str(tmp_path / "state"), STATE)
    stream = spark.readStream.schema(STATE + ", at long").json(str(tmp_path / "in"))
    fold = ingest.topics_transform({"a": ingest.upsert_transform(["id"], ["at"]), "b": ingest.upsert_transform(["id"], ["at"])})
    for at, rows in enumerate([[("a", 1, "x"), ("b", 1, "y")], [("a", 1, "z")]]):
        (tmp_path / "in" / f"{at}.json").write_text("\n".join(json.dumps({"topic": t, "id": i, "v": v, "at": at}) for t, i, v in rows))
        ingest.keyed_ingest(stream, state, fold, str(tmp_path / "checkpoint")).awaitTermination(60)
    assert {tuple(r) for r in state.current().collect()} == {("a", 1, "z"), ("b", 1, "y")}


def test_kafka_messages_keep_headers(spark):
    schema = "key binary, value binary, headers array<struct<key:string,value:binary>>, topic string, timestamp timestamp"
    raw = spark.createDataFrame([(b"k", "é".encode(), [("trace", b"7"), ("empty", None)], "t", datetime(2024, 1, 1)), (None, None, None, "t", None)], schema)
    first, second = kafka_messages(raw).collect()
    assert (first.key, first.value, [tuple(h) for h in first.headers], first.topic) == ("k", "é", [("trace", "7"), ("empty", None)], "t")
    assert first.timestamp == int(datetime(2024, 1, 1).timestamp()) and (second.key, second.headers, second.timestamp) == (None, None, None)


def test_records_and_index_lines(spark):
    df = spark.createDataFrame([(1, "a"), (2, None)], "id long, name string")
    records = sinks.kafka_records(df, F.col("id"), F.concat(F.lit("t-"), "id")).collect()
    assert [(r.key, r.topic, json.loads(r.value)) for r in records] == [("1", "t-1", {"id": 1, "name": "a"}), ("2", "t-2", {"id": 2})]
    assert sinks.kafka_records(df).columns == ["value"]
    lines = sinks.index_lines("events", F.col("id"))(df).first().lines.split("\n")
    assert [json.loads(x) for x in lines[:2]] == [{"index": {"_index": "events", "_id": "1"}}, {"id": 1, "name": "a"}] and lines[2] == ""


@pytest.mark.parametrize(
    ("a", "b", "equal"),
    [
        ('{"b":1,"a":[1,2.0,{"z":1,"c":null}]}', '{"a": [1.0, 2, {"c": null, "z": 1e0}], "b": 1.00}', True),
        ("10", "1e1", True),
        ("[1,2]", "[2,1]", False),
        ('"1.0"', '"1"', False),
        ('{"t":"say \\"2.0\\", then"}', '{"t":"say \\"2\\", then"}', False),
        ('"1"', "1", False),
        ("-0.5", "-5e-1", True),
        ('{"a":null}', "{}", False),
    ],
)
def test_equal_documents_have_one_hash(spark, a, b, equal):
    x, y = (r.h for r in spark.createDataFrame([(a,), (b,)], "t string").select(value_hash(F.col("t")).alias("h")).collect())
    assert (x == y) is equal


def test_bad_documents_have_no_hash(spark):
    rows = spark.createDataFrame([("{",), (None,)], "t string").select(value_hash(F.col("t")).alias("h"), canonical(F.col("t")).alias("c")).collect()
    assert [(r.h, r.c) for r in rows] == [(None, None)] * 2
