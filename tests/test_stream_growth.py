"""What a stream costs must not grow with its keys; the state is a stand-in that counts its calls."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from packetlake.operators import detect
from packetlake.plans import packets as plan
from packetlake.plans import q_stream
from packetlake.streaming import stateful

SCHEMA = pa.schema([("src_ip", pa.string()), ("ts_ms", pa.int64()), ("pkt_id", pa.int64()), (stateful._AT, pa.int64())])


class Handle:
    def __init__(self):
        self.calls, self.timers = 0, set()

    def registerTimer(self, at):
        self.calls += 1
        self.timers.add(at)

    def getListState(self, name, schema):
        return State(self)


class State:
    def __init__(self, handle):
        self.handle, self.rows = handle, []

    def exists(self):
        self.handle.calls += 1
        return bool(self.rows)

    def get(self):
        self.handle.calls += 1
        return iter(self.rows)

    def put(self, rows):
        self.handle.calls += 1
        self.rows = list(rows)

    def appendValue(self, row):
        self.put([*self.rows, row])

    def clear(self):
        self.put([])


class Now:
    def __init__(self, ms):
        self.ms = ms

    def getCurrentWatermarkInMs(self):
        return self.ms


def taken(rows, step, now=0, **settings):
    """The rows that come out behind the watermark, and the calls to the state."""
    made = stateful._InOrder(step, SCHEMA, ["src_ip"], settings.pop("columns"), settings.pop("width", 0), settings.pop("idle_ms", None))
    handle = Handle()
    made.init(handle)
    ips, t, ids = zip(*rows)
    table = pa.table({"src_ip": ips, "ts_ms": t, "pkt_id": ids, "ts": pa.array([x * 1000 for x in t], pa.timestamp("us", tz="UTC")), "bucket": [0] * len(t)})
    for pack in stateful._packing(SCHEMA)(table.to_batches()):
        list(made.handleInputRows((0,), [pack.to_pandas()], Now(now)))
    out = [r for pdf in made.handleExpiredTimer((0,), Now(max(t)), None) for r in pdf.drop(columns="ts").itertuples(index=False, name=None)]
    return out, handle, made


def count(rows, places, memory):
    return [np.searchsorted(places.t, places.at, "right") - np.searchsorted(places.t, places.at - 10, "right")], None, None


def test_calls_to_the_state_do_not_grow_with_keys():
    rows = [(f"10.0.{k // 250}.{k % 250}", 1000 + k % 7, k) for k in range(2000)] + [(None, 1003, 5000), (None, 1012, 5001), (None, 1013, 5002)]
    few, many = taken(rows[-3:], count, columns=["n"], width=10), taken(rows, count, columns=["n"], width=10)
    assert many[1].calls == few[1].calls < 20
    assert len(many[0]) == len(rows) and {r[2]: r[3] for r in many[0] if r[2] >= 5000} == {5000: 1, 5001: 2, 5002: 2} and sum(r[3] for r in many[0] if r[2] < 5000) == 2000


def test_late_rows_of_a_pack_are_dropped_and_the_rest_counts():
    out, _, _ = taken([("a", 90, 1), ("a", 100, 2), ("a", 101, 3), ("b", 99, 4), ("b", 200, 5)], count, now=100, columns=["n"], width=10)
    assert sorted(out) == [("a", 101, 3, 1), ("b", 200, 5, 1)]


def test_values_of_many_keys_are_kept_and_forgotten_one_by_one():
    keep = lambda rows, places, memory: ([], None, ["x"] * len(places.keys))
    _, handle, made = taken([("a", 10, 1), ("b", 60, 2), ("c", 100, 3)], keep, columns=[], idle_ms=50)
    left = made._table(made.memory, made.kept).to_pydict()
    assert left == {"src_ip": ["b", "c"], "value": ["x", "x"], "last_ms": [60, 100]} and 110 in handle.timers
    list(made.handleExpiredTimer((0,), Now(110), None))
    assert made._table(made.memory, made.kept)["src_ip"].to_pylist() == ["c"]


def test_a_batch_is_several_files(spark):
    rows = plan.packets(spark, "/root/testdata/sf0.001").select(*detect.NEEDED, "ts")
    got = q_stream.run(spark, rows, lambda s: s.withColumn("file", F.input_file_name()), most=2000)
    sizes = [r[1] for r in got.groupBy("file").count().collect()]
    assert sum(sizes) == rows.count() and max(sizes) <= 2400 // q_stream.FILES
